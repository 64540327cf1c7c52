"""Tables in versions: snapshots, writers that meet, writes that die, compaction."""

import pytest
from pyspark.sql import functions as F

from ledgerloom.sources import versions
from ledgerloom.sources.versions import Versioned


@pytest.fixture
def table(spark, tmp_path):
    return Versioned(spark, str(tmp_path / "table"), "part")


def rows(spark, *some):
    return spark.createDataFrame(list(some), "id long, part long, text string")


def ids(df):
    return sorted((r["id"], r["text"]) for r in df.collect())


def test_versions(spark, table):
    with pytest.raises(FileNotFoundError):
        table.rows()
    table.overwrite(rows(spark, (1, 0, "a"), (2, 0, "b"), (3, 7, "c")))
    table.append(rows(spark, (4, 7, "d"), (5, -1, "e")))
    table.put(rows(spark, (2, 0, "new"), (6, 0, "more")), "id")
    assert table.numbers() == [0, 1, 2]
    assert ids(table.rows(0)) == [(1, "a"), (2, "b"), (3, "c")]
    assert ids(table.rows(1)) == [(1, "a"), (2, "b"), (3, "c"), (4, "d"), (5, "e")]
    assert ids(table.rows()) == [(1, "a"), (2, "new"), (3, "c"), (4, "d"), (5, "e"), (6, "more")]
    assert ids(table.rows(low=1)) == [(3, "c"), (4, "d")] and ids(table.rows(low=8)) == [] and table.rows(low=8).columns == ["id", "part", "text"]
    before = table.version(1).parts
    assert table.version(2).parts[7] == before[7] and table.version(2).parts[0] != before[0]  # only the part that it touches


def test_a_reader_keeps_its_version(spark, table):
    table.overwrite(rows(spark, (1, 0, "a")))
    reader = table.rows()
    table.put(rows(spark, (1, 0, "new")), "id")
    table.overwrite(rows(spark, (9, 9, "all")))
    assert ids(reader) == [(1, "a")] and ids(table.rows()) == [(9, "all")]


def test_a_write_that_dies_leaves_the_table_whole(spark, table, monkeypatch):
    table.overwrite(rows(spark, (1, 0, "a")))
    bad = rows(spark, (1, 0, "b"), (2, 0, "c")).withColumn("text", F.when(F.col("id") == 2, F.raise_error(F.lit("dead"))).otherwise(F.col("text")).cast("string"))
    for write in (table.append, table.overwrite, lambda df: table.put(df, "id")):
        with pytest.raises(Exception, match="dead"):
            write(bad)
    monkeypatch.setattr(Versioned, "_commit", lambda *_: (_ for _ in ()).throw(KeyboardInterrupt()))
    with pytest.raises(KeyboardInterrupt):  # killed with its rows written
        table.put(rows(spark, (1, 0, "late")), "id")
    monkeypatch.undo()
    assert table.numbers() == [0] and ids(table.rows()) == [(1, "a")]


def test_writers_that_meet(spark, table):
    table.overwrite(rows(spark, (1, 0, "a")))
    seen = table.version()
    table.append(rows(spark, (2, 0, "b")))
    with pytest.raises(versions.Conflict):
        table._commit(seen, seen.schema, {})
    assert table.numbers() == [0, 1] and not [p for p in table._system().listStatus(table._path("versions")) if p.getPath().getName().startswith("_")]
    # one that was second begins anew from what the first has made
    calls, commit = [], Versioned._commit

    def slow(self, after, schema, parts):
        if not calls:
            calls.append(1)
            commit(self, after, schema, after.parts | self._write(rows(spark, (3, 5, "first"))))
        return commit(self, after, schema, parts)

    table._commit = slow.__get__(table)
    table.put(rows(spark, (1, 0, "second")), "id")
    assert ids(table.rows()) == [(1, "second"), (2, "b"), (3, "first")]


def test_compact_and_vacuum(spark, table, tmp_path):
    for k in range(3):
        table.append(rows(spark, (k, 0, "x"), (10 + k, k, "y")))
    whole = ids(table.rows())
    assert len(table.version().parts[0]) == 3
    table.compact()
    assert ids(table.rows()) == whole and [len(v) for _, v in sorted(table.version().parts.items())] == [1, 1, 1]
    assert table.compact().number == table.version().number == 3  # nothing to do
    table.vacuum(1)
    assert table.numbers() == [3] and ids(table.rows()) == whole
    left = [p for p in (tmp_path / "table/data").glob("*/*") if p.is_dir()]
    assert len(left) == 3
