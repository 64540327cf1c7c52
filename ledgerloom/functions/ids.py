"""Identifiers: one signed number for both id spaces."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def loose_tx(key: Column) -> Column:
    """The id of an unconfirmed transaction, from its key (1 or more)."""
    return -key.cast("long")


def loose_out(key: Column, index: Column) -> Column:
    """The id of an unconfirmed transaction's output or input: minus (key, index) packed into 64 bits."""
    return -(F.shiftleft(key.cast("long"), 32).bitwiseOR(index.cast("long")))


def is_dense(id: Column) -> Column:
    return id >= 0


def loose_key(id: Column) -> Column:
    """The transaction's key of a packed id, null for confirmed ids and where the key is 0."""
    key = F.shiftright(-id, 32)
    return F.when((id < 0) & (key > 0), key)


def loose_index(id: Column) -> Column:
    """The index part of a packed id, null where ``loose_key`` is."""
    return F.when(loose_key(id).isNotNull(), (-id).bitwiseAND(F.lit(0xFFFFFFFF)))
