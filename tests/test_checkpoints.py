from types import SimpleNamespace

import pytest

from ledgerloom import checkpoints


def context(master, conf=None):
    own = {}
    return SimpleNamespace(master=master, getCheckpointDir=lambda: own.get("dir"), setCheckpointDir=lambda d: own.update(dir=d), getConf=lambda: SimpleNamespace(get=lambda k: conf))


def test_folder():
    with pytest.raises(RuntimeError, match="share"):
        checkpoints.folder(context("spark://host:7077"))
    with pytest.raises(RuntimeError, match="share"):
        checkpoints.folder(context("local-cluster[3,2,1000]"))
    assert checkpoints.folder(context("yarn", "hdfs://x/ck")) == "hdfs://x/ck"
    assert "ledgerloom-" in checkpoints.folder(context("local[4]")) and checkpoints.folder(context("local"))


def test_cut_is_reliable(spark):
    df = checkpoints.cut(spark.range(10))
    assert df.count() == 10 and "ExistingRDD" in df._jdf.queryExecution().toString()
