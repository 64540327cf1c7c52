"""python -m ledgerloom.simulator CONFIG.toml FOLDER"""

import shutil
import sys

from ledgerloom.simulator.config import parse
from ledgerloom.simulator.world import World

if len(sys.argv) != 3:
    sys.exit(__doc__)
with open(sys.argv[1]) as config:
    World(parse(config.read())).run().save(sys.argv[2])
shutil.copy(sys.argv[1], f"{sys.argv[2]}/config.toml")
