"""The thin queries over the corpus tables, one for each operator; their SQL is in ``oracles``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import caps, decontaminate, divergence, lexical, license_scan, line_dedup, minhash, packing, quality, sharding, toxicity, url_filter, warc
from ledgerloom.llm.common import table
from ledgerloom.llm.learning import is_held_out
from ledgerloom.llm.oracles import ORACLES as ORACLES


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.drop_boilerplate(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), counts=("n_lines", "n_dropped"))
    gone = (F.col("n_dropped") > 0) & (F.col("n_dropped") == F.col("n_lines"))
    return out.select("doc_id", "n_lines", "n_dropped", gone.alias("all_dropped"), F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("kept_chars"), F.md5("text").alias("kept_md5"))


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), shingle=2)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return _judged(scored, toxicity.MODULUS, toxicity.HELD_OUT, toxicity.THRESHOLD)


def _judged(scored: DataFrame, modulus: int, remainder: int, threshold: float) -> DataFrame:
    return scored.select("doc_id", is_held_out("doc_id", modulus, remainder).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return caps.near_duplicates(table(spark, sf_dir, "embeddings"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))
    return _judged(scored, quality.MODULUS, quality.HELD_OUT, quality.THRESHOLD)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.write(table(spark, sf_dir, "pages").select("page_id", "url", "html"), warc.archive_folder(spark))
    return warc.digests(warc.read(index))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found, _ = decontaminate.matches(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict", "url_score")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = license_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "license_digest", "license_id", F.array_join("line_licenses", ",").alias("line_licenses"))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents").select("text", "lang", "source"))


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text", sharding.size(text).alias("size"), sharding.crc32(text).alias("text_crc32"))
    return sharding.interleave(docs).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lexical.ranked(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("item").alias("item_id"), "rank", F.col("doc").alias("doc_id"), "score")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_minhash": op2_minhash,
    "op3_toxicity": op3_toxicity,
    "op4_packing": op4_packing,
    "op5_caps": op5_caps,
    "op6_quality": op6_quality,
    "op7_warc": op7_warc,
    "op8_decontaminate": op8_decontaminate,
    "op9_url_filter": op9_url_filter,
    "op10_license_scan": op10_license_scan,
    "op11_divergence": op11_divergence,
    "op12_sharding": op12_sharding,
    "op13_lexical_search": op13_lexical_search,
}
