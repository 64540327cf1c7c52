"""The ledger as a stream: what a batch adds to masks, sets and clusterings.

Each sink is a folder of Parquet tables, a table for each batch, named by its
number.  A batch that runs again overwrites its own table, so results are exactly
once.  Reading combines the tables as ``plans.facts`` does.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerloom.checkpoints import removed
from ledgerloom.operators.clustering import changes, cluster, grown, star

Step = Callable[[DataFrame], DataFrame]


def maintain(stream: DataFrame, step: Step, folder: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Runs ``step`` on what is new (in update mode: on what has changed) and keeps its facts below ``folder``; ends when all that is there now is read."""

    def write(batch: DataFrame, number: int) -> None:
        step(batch).withColumn("fact", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/fact={number:012d}")

    return stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _facts(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.option("recursiveFileLookup", "true").parquet(folder)


def mask(spark: SparkSession, folder: str) -> DataFrame:
    """The latest flag of each key."""
    return _facts(spark, folder).groupBy("key").agg(F.max_by("flag", "fact").alias("flag"))


def bag(spark: SparkSession, folder: str) -> DataFrame:
    """All that the batches gave, repeats kept."""
    return _facts(spark, folder).drop("fact")


def clustering(spark: SparkSession, folder: str) -> DataFrame:
    """The clusters of all edges (a, b) so far; clusters only merge, so edges are all that needs to be kept."""
    return cluster(_facts(spark, folder).select("a", "b"))


#: Batches after which the whole clustering is written anew.
WHOLE_EVERY = 16


def maintain_clustering(stream: DataFrame, step: Step, folder: str, checkpoint: str, whole_every: int = WHOLE_EVERY) -> StreamingQuery:
    """Keeps the clustering itself: each batch's edges (a, b) only join clusters of the state before it.

    A batch writes the labels that it changes, as a table named by its number;
    every ``whole_every`` batches it is the whole clustering, which stands for all before it.  A
    batch that runs again begins from the tables before it and writes its own
    anew.  Tables that a whole one stands for are left to ``forget``.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark, edges = batch.sparkSession, step(batch)
        before = _state(spark, folder, number)
        whole = before is None or number % whole_every == 0
        now = cluster(edges) if before is None else grown(before, edges) if whole else changes(before, edges)
        now.write.mode("overwrite").parquet(f"{folder}/{'whole' if whole else 'state'}={number:012d}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _states(spark: SparkSession, folder: str) -> list[tuple[int, str]]:
    """(batch, name) of the tables that are there and whole, in order."""
    context = spark.sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path(folder)
    system = place.getFileSystem(context._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in system.listStatus(place)] if system.exists(place) else []
    done = [n for n in names if n.partition("=")[0] in ("state", "whole") and system.exists(context._jvm.org.apache.hadoop.fs.Path(f"{folder}/{n}/_SUCCESS"))]
    return sorted((int(n.partition("=")[2]), n) for n in done)


def _state(spark: SparkSession, folder: str, end: int | None = None) -> DataFrame | None:
    """The clustering as of the batches before ``end``, or of all: of a member's labels the least, since they only fall."""
    names = [n for number, n in _states(spark, folder) if end is None or number < end]
    if not names:
        return None
    last = max((k for k, n in enumerate(names) if n.startswith("whole")), default=0)
    rows = spark.read.parquet(*[f"{folder}/{n}" for n in names[last:]])
    return rows.groupBy("member").agg(F.min("cluster_id").alias("cluster_id")) if len(names) > last + 1 else rows.select("member", "cluster_id")


def clustering_state(spark: SparkSession, folder: str) -> DataFrame:
    """The clustering as of the last batch."""
    out = _state(spark, folder)
    if out is None:
        raise FileNotFoundError(f"no batch was written to {folder}")
    return out


def forget(spark: SparkSession, folder: str) -> None:
    """Takes away the tables that a later whole one stands for; no reader of an older state may be under way."""
    names = [n for _, n in _states(spark, folder)]
    last = max((k for k, n in enumerate(names) if n.startswith("whole")), default=0)
    for name in names[:last]:
        removed(spark, f"{folder}/{name}")


def compact(spark: SparkSession, folder: str, target: str) -> DataFrame:
    """Writes the clusters so far as star edges, which stand for all edges, to be the first fact of a new folder."""
    edges = star(clustering(spark, folder)).withColumn("fact", F.lit(0))
    edges.write.mode("overwrite").parquet(f"{target}/fact={0:012d}")
    return edges


def relink(unresolved: DataFrame, outputs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(linked, still unresolved) of inputs (prev_txid, prev_vout, ..) against outputs (txid, vout, out_id) that came with or after them."""
    known = outputs.select(F.col("txid").alias("prev_txid"), F.col("vout").alias("prev_vout"), F.col("out_id").alias("prev_out_id"))
    both = unresolved.join(known, ["prev_txid", "prev_vout"], "left")
    return both.where("prev_out_id IS NOT NULL"), both.where("prev_out_id IS NULL").drop("prev_out_id")


def event_counts(events: DataFrame, every: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events by type and window of event time, with a watermark; for event streams beside the ledger."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", every), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def sliding_counts(events: DataFrame, width: str = "3 hours", every: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events by type and overlapping windows of event time, with the sum of their values."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    by = timed.groupBy(F.window("ts", width, every), "event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") > 10).alias("n_large"))
    return by.select(F.col("window.start").alias("start"), "event_type", "n", "n_large")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """(user_id, start, finish, n, last_event) of each user's sessions: events that follow each other by less than the gap; sessions that an event joins are merged."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    by = timed.groupBy("user_id", F.session_window("ts", gap)).agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("last_event"))
    return by.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("finish"), "n", "last_event")


def latest_windows(spark: SparkSession, folder: str, *keys: str) -> DataFrame:
    """What the batches of a stream in update mode have told last of each window."""
    rows = _facts(spark, folder)
    last = F.max_by(F.struct(*[c for c in rows.columns if c not in (*keys, "fact")]), "fact").alias("last")
    return rows.groupBy(*keys).agg(last).select(*keys, "last.*")


def appended(stream: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Writes the rows that a stream has finished as a Parquet table; ends when all that is there now is read."""
    return stream.writeStream.format("parquet").outputMode("append").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
