"""Every query against its SQL at the smallest scale."""

import os

import duckdb
import pytest

from ledgerloom import queries

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


def plain(x):
    return round(float(x), 6) if isinstance(x, float) else x


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql(spark, con, name):
    df = queries.QUERIES[name](spark, DIR)
    names = sorted(df.columns)
    want = con.sql(f"SELECT {', '.join(names)} FROM ({queries.ORACLES[name]})").fetchall()
    order = lambda rows: sorted((tuple(plain(x) for x in r) for r in rows), key=repr)
    assert order(df.select(*names).collect()) == order(want)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_runs(spark, name):
    assert queries.QUERIES[name](spark, DIR).count() >= 0


def test_ids(spark):
    from pyspark.sql import functions as F

    from ledgerloom.functions import ids

    row = spark.createDataFrame([(5, 3)], "k long, i long").select(ids.loose_out(F.col("k"), F.col("i")).alias("id"))
    assert row.first()[0] == -((5 << 32) | 3)
    back = row.select(ids.loose_key(F.col("id")), ids.loose_index(F.col("id")), ids.loose_key(-F.col("id"))).first()
    assert tuple(back) == (5, 3, None)
