"""The corpus pipeline: each stage works on all that its predecessor kept, written and read again in between.

The last stage, packing, returns pieces; all others return the columns of documents.

Defined cases, for each stage as its operator's module says: null and empty
texts are kept by all stages (they hold nothing to reject) and packed as the
single id 0; texts of any length are worked on whole; repeated rows are scored,
cut and packed each, and of rows with one doc_id near-dedup keeps all or none; a
null doc_id is kept; ties (a score at the threshold is toxic, a line at the
ratio stays, of near-duplicates the smallest id stays); documents may have more
columns, of any name, which all stages but packing hand on; empty tables give
empty tables.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.checkpoints import folder, removed
from ledgerloom.llm import decontaminate, line_dedup, minhash, packing, toxicity
from ledgerloom.llm.common import column, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model scores under its threshold."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their source's boilerplate lines; n_chars follows the text.

    A document of such lines alone stays as it is: copies as a whole are left to the next stage.
    """
    out = line_dedup.drop_boilerplate(docs, keep_whole=True)
    if "n_chars" not in docs.columns:
        return out
    kind = docs.schema["n_chars"].dataType
    return out.withColumn("n_chars", F.when(column("text").isNull(), column("n_chars")).otherwise(F.length("text")).cast(kind))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, that with the smallest id; links are those of op2's contract."""
    return minhash.drop_near_duplicates(docs, shingle=2)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of the benchmark."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences."""
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: The classifier and the tokenizer have no SQL form; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is a Parquet table in the shared checkpoint folder, gone once the next is written."""
    target = f"{folder(spark.sparkContext)}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{target}/{k}-{name}.parquet"
        stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            removed(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
