import os
import sys

import corpus_pipeline
import duckdb
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import queries
from ledgerloom.llm.packing import Encoder

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
sys.path.insert(0, os.path.dirname(__file__))  # the brute-force forms of the other tests


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    df = queries.QUERIES[name](spark, DIR)
    names = sorted(df.columns)
    want = con.sql(f"SELECT {', '.join(names)} FROM ({queries.ORACLES[name]})").fetchall()
    assert sorted(map(tuple, df.select(*names).collect()), key=repr) == sorted(want, key=repr)


def test_columns_of_the_contracts(spark):
    want = {
        "op2_minhash": {"doc_id", "n_shingles", "component_id", "kept"},
        "op3_toxicity": {"doc_id", "held_out", "score", "predicted"},
        "op4_packing": {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"},
        "op5_caps": {"vec_id", "n_links", "component_id", "kept"},
        "op6_quality": {"doc_id", "held_out", "score", "predicted"},
        "op7_warc": {"page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"},
        "op8_decontaminate": {"doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"},
        "op9_url_filter": {"page_id", "host", "path", "rule", "verdict"},
    }
    for name, columns in want.items():
        df = queries.QUERIES[name](spark, DIR)
        assert columns <= set(df.columns), name
        table, key = ("embeddings", "vec_id") if "vec_id" in columns else ("pages", "page_id") if "page_id" in columns else ("documents", "doc_id")
        ids = {r[0] for r in spark.read.parquet(f"{DIR}/{table}.parquet").select(key).collect()}
        assert {r[0] for r in df.select(key).collect()} == ids, name


def test_stages(spark):
    """Each stage's decisions take effect and only they do."""
    docs = spark.read.parquet(f"{DIR}/documents.parquet").cache()
    columns, encoder = docs.columns, Encoder()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontamination", "packing"]
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DIR)
        assert out.columns == columns and out.schema["n_chars"].dataType == docs.schema["n_chars"].dataType
        out = spark.createDataFrame(out.collect(), docs.schema)
        assert ids(out) <= ids(docs)
        if name == "line_dedup":
            assert ids(out) == ids(docs) and all(r["n_chars"] == len(r["text"]) for r in out.collect())
        docs = out
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, DIR).collect()
    assert ids(docs) == {r["doc_id"] for r in pieces}
    assert sum(r["length"] for r in pieces) == sum(len(encoder.encode(r["text"] or "")) + 1 for r in docs.collect())


def test_stages_against_brute_force(spark):
    """Each stage on what its predecessor kept, held against plain Python."""
    import pyarrow as pa
    from test_decontaminate import brute as hit
    from test_line_dedup import brute as lines
    from test_minhash import brute as groups

    from ledgerloom.llm import line_dedup, toxicity

    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    odd = [(-1, None, "en", "src0", None), (-2, "", "en", "src0", 0), (-3, "long " * 300_000 + "end.", "en", "src1", 5), (-4, "long " * 300_000 + "end.", "en", "src1", 5), (None, "no id", None, None, 5)]
    docs = docs.union(spark.createDataFrame([*odd, odd[2]], docs.schema))
    labels, benchmark = (spark.read.parquet(f"{DIR}/{t}.parquet") for t in ("labels", "benchmark"))
    items = [(str(r["item_id"]), r["text"]) for r in benchmark.collect()]
    stages, seen = dict(corpus_pipeline.STAGES), docs
    of = lambda df: sorted(((r["doc_id"], r["source"], r["text"]) for r in df.collect()), key=repr)
    again = lambda df: spark.createDataFrame(df.collect(), docs.schema)

    model = toxicity.fit(docs, labels)
    seen, before = again(stages["toxicity"](spark, seen, DIR)), of(seen)
    assert of(seen) == [r for r in before if model(pa.array([r[2]], pa.string()))[0] < toxicity.THRESHOLD]
    seen, before = again(stages["line_dedup"](spark, seen, DIR)), of(seen)
    assert of(seen) == sorted(lines(before, line_dedup.MAX_RATIO, line_dedup.MIN_PAGES, keep_whole=True), key=repr)
    seen, before = again(stages["near_dedup"](spark, seen, DIR)), of(seen)
    least, _ = groups([(i, t) for i, _, t in before], 2)
    assert of(seen) == [r for r in before if r[0] is None or least[r[0]] == r[0]] and len(seen.where("doc_id = -3").collect()) == 0
    seen, before = again(stages["decontamination"](spark, seen, DIR)), of(seen)
    assert of(seen) == [r for r in before if len(r[2] or "") > 100_000 or not hit(r[2], items)[4]]
    pieces = stages["packing"](spark, seen, DIR).collect()
    assert sum(r["length"] for r in pieces) == sum(len(Encoder().encode(t or "")) + 1 for _, _, t in of(seen))


def test_run(spark):
    """What run gives is what the stages give, and what it wrote in between is gone."""
    from pathlib import Path

    place = Path(spark.sparkContext.getCheckpointDir().removeprefix("file:"))
    before = set(place.glob("pipeline-*"))
    out = corpus_pipeline.run(spark, DIR)
    assert out.count() > 0 and "sequence_id" in out.columns
    (new,) = set(place.glob("pipeline-*")) - before
    assert [p.name for p in new.iterdir()] == ["4-packing.parquet"]


def test_more_columns_with_clashing_names(spark):
    """Extra columns go through all stages but packing, whatever their names, and change nothing."""
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    names = ["__score", "__key", "drops", "rep", "component_id", "n_words", "__found", "Contaminated", "host_hash", "a.b", "start"]
    wide = docs.select("*", *[F.lit(k).alias(n) for k, n in enumerate(names)])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs, wide = stage(spark, docs, DIR), stage(spark, wide, DIR)
        assert wide.columns == [*docs.columns, *names]
        docs, wide = spark.createDataFrame(docs.collect(), docs.schema), spark.createDataFrame(wide.collect(), wide.schema)
        assert sorted(map(tuple, wide.select(*docs.columns).collect())) == sorted(map(tuple, docs.collect()))
        assert all(tuple(r)[-len(names) :] == tuple(range(len(names))) for r in wide.collect())
    assert corpus_pipeline.STAGES[-1][1](spark, wide, DIR).count() > 0


def test_empty_and_odd_documents(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    odd = docs.limit(0).union(spark.createDataFrame([(None, None, None, None, None), (7, None, None, None, None), (7, "", "en", "s", 0)], docs.schema))
    for df, n in ((docs.limit(0), 0), (odd, 3)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            df = spark.createDataFrame(stage(spark, df, DIR).collect(), docs.schema)
            assert df.count() == n
        assert sum(r["length"] for r in corpus_pipeline.STAGES[-1][1](spark, df, DIR).collect()) == n
