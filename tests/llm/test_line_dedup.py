from collections import Counter

import pytest

from ledgerloom.llm import line_dedup


def brute(pages, ratio, least, keep_whole=False):
    hosts = Counter(h for _, h, _ in pages)
    lines = Counter((h, x) for _, h, t in pages if t is not None for x in {y.strip(" ") for y in t.split("\n")} - {""})
    out = []
    for i, h, t in pages:
        bad = {x for (g, x), n in lines.items() if g == h and n >= least and n > ratio * hosts[h]}
        full = [] if t is None else [x for x in t.split("\n") if x.strip(" ")]
        keep = t
        if any(x.strip(" ") in bad for x in full) and not (keep_whole and all(x.strip(" ") in bad for x in full)):
            keep = "\n".join(x for x in t.split("\n") if x.strip(" ") not in bad)
        out.append((i, h, keep))
    return out


def pages():
    rows = [(k, "a" if k % 3 else "b", f"menu\nbody {k}\n  menu \n\nfoot {k % 2}") for k in range(40)]
    rows += [(100, "a", None), (101, "a", ""), (102, None, "menu\nx"), (103, "a", "menu\nmenu"), (104, "c", "menu\ny")]
    rows += [(0, "b", "menu\nbody 0\n  menu \n\nfoot 0")] * 2  # the same row again
    return rows


def order(rows):
    return sorted(rows, key=repr)


@pytest.mark.parametrize(("ratio", "least", "whole"), [(0.4, 5, False), (0.4, 5, True), (0.1, 2, False)])
@pytest.mark.parametrize("broadcast", [line_dedup.BROADCAST_LINES, 0])
def test_against_brute_force(spark, monkeypatch, ratio, least, whole, broadcast):
    monkeypatch.setattr(line_dedup, "BROADCAST_LINES", broadcast)
    df = spark.createDataFrame(pages(), "doc_id long, source string, text string")
    got = line_dedup.drop_boilerplate(df, max_ratio=ratio, min_pages=least, keep_whole=whole)
    assert order(map(tuple, got.collect())) == order(brute(pages(), ratio, least, whole))


def test_defaults_are_the_plain_method(spark):
    """A line goes if its share of the host's pages exceeds the ratio; at the ratio it stays, and so does what one page alone has."""
    rows = [(k, "h", f"often\nrare\nown {k}" if k < 2 else "often" if k < 11 else f"x{k}") for k in range(20)] + [(50, "one", "alone")]
    got = {r["doc_id"]: r["text"] for r in line_dedup.drop_boilerplate(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()}
    assert got == {k: f"rare\nown {k}" if k < 2 else "" if k < 11 else f"x{k}" for k in range(20)} | {50: "alone"}


def test_columns_and_counts(spark):
    df = spark.createDataFrame([(k, "a", f"menu\n{k}", "z", 1, 2) for k in range(9)], "doc_id long, source string, text string, `__drops` string, `__host` int, `line.hash` int")
    got = line_dedup.drop_boilerplate(df, max_ratio=0.5, min_pages=5, counts=("n", "gone"))
    assert got.columns == [*df.columns, "n", "gone"]
    assert {(r["text"], r["n"], r["gone"], r["__drops"]) for r in got.collect()} == {(str(k), 2, 1, "z") for k in range(9)}


def test_long_text_and_empty_table(spark):
    long = "\n".join(f"line {k}" for k in range(50_000))
    df = spark.createDataFrame([(k, "a", f"menu\n{long if k == 0 else k}") for k in range(8)], "doc_id long, source string, text string")
    got = {r["doc_id"]: r["text"] for r in line_dedup.drop_boilerplate(df, max_ratio=0.5, min_pages=5).collect()}
    assert got[0] == long and got[1] == "1"
    assert line_dedup.drop_boilerplate(df.limit(0)).count() == 0


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame(pages(), "doc_id long, source string, text string")
    plan = line_dedup.drop_boilerplate(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
