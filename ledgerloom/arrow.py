"""Python over Arrow batches of bounded size."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of an Arrow batch between Spark and Python, about; a longer row stands alone.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def column(name: str) -> Column:
    """A column by its exact name, dots and backticks included."""
    return F.col(quoted(name))


def _bounded(spark: SparkSession) -> None:
    """Arrow batches by bytes, where the session asks for larger ones: rows may be whole texts, and 10,000 of them are many."""
    if int(spark.conf.get(_BATCH).rstrip("b")) > BATCH_BYTES:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def give_back() -> None:
    """What Arrow and numpy keep for later goes back to the system; workers are used again and again."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not the GNU library
        pass


def mapped(df: DataFrame, task: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
    """``df.mapInArrow`` with batches of bounded size, whose task gives its memory back."""
    _bounded(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from task(batches)
        finally:
            give_back()

    return df.mapInArrow(run, schema)


def by_cell(df: DataFrame, name: str, work: Callable[[pa.Array], pa.Array], kind: T.DataType) -> Column:
    """``work`` over one column of df, as a column: only its cells go to Python, and only the results come back."""
    _bounded(df.sparkSession)

    @F.arrow_udf(kind)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        try:
            for cells in batches:
                yield work(cells)
        finally:
            give_back()

    return run(column(name))
