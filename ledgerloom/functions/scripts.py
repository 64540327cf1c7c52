"""Output scripts: their types, and the columns that follow from them."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.arrow import by_cell

#: The numbers and names of the output types.
P2PKH, P2SH, P2WPKH, P2WSH, P2TR, OP_RETURN, NON_STANDARD = range(7)
TYPE_NAMES = ("p2pkh", "p2sh", "p2wpkh", "p2wsh", "p2tr", "op_return", "non_standard")
UNSPENDABLE = (OP_RETURN, NON_STANDARD)
#: Hexadecimal head, tail and length of the standard scripts.
PATTERNS = (
    (P2PKH, "76a914", "88ac", 25),
    (P2SH, "a914", "87", 23),
    (P2WPKH, "0014", "", 22),
    (P2WSH, "0020", "", 34),
    (P2TR, "5120", "", 34),
)


def output_type(spk: Column) -> Column:
    """The type of a script (binary); OP_RETURN is looked for first, and what fits nothing is non-standard."""
    code = F.lower(F.hex(spk))
    found = F.when(code.startswith("6a"), F.lit(OP_RETURN))
    for number, head, tail, size in PATTERNS:
        found = found.when((F.length(spk) == size) & code.startswith(head) & code.endswith(tail), F.lit(number))
    return found.otherwise(F.lit(NON_STANDARD))


def is_spendable(type_: Column) -> Column:
    return ~type_.isin(*UNSPENDABLE)


def type_name(type_: Column) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in TYPE_NAMES]), type_.cast("int") + 1)


def hash160(data: bytes) -> bytes:
    return hashlib.new("ripemd160", hashlib.sha256(data).digest(), usedforsecurity=False).digest()


def spk_hash(df: DataFrame, spk: str = "spk") -> Column:
    """The 20-byte hash of each script of df, null where there is none; Spark itself has no RIPEMD-160."""

    def work(cells: pa.Array) -> pa.Array:
        return pa.array([None if x is None else hash160(x) for x in cells.to_pylist()], pa.binary())

    return by_cell(df, spk, work, T.BinaryType())
