import re
import textwrap
from pathlib import Path

import pytest

from ledgerloom.llm import license_scan as s

MIT = next(t for n, t in s.texts() if n == "MIT" and t.startswith("MIT License"))
FOLDER = Path("/usr/share/common-licenses")
FILES = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0-only", "GPL-3": "GPL-3.0-only", "LGPL-2.1": "LGPL-2.1-only", "LGPL-3": "LGPL-3.0-only", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}


def variants():
    out = [(name, text) for name, text in s.texts()]
    out += [(name, f"Copyright (c) 2020 Someone <a@b>\nAll rights reserved.\n{text.upper()}") for name, text in s.texts()]
    out += [(name, "/*\n * " + "\n * ".join(textwrap.wrap(text, 50) if "\n" not in text else text.split("\n")).replace("holder", "owner").replace("acknowledgment", "acknowledgement") + "\n */") for name, text in s.texts()]
    out += [("MIT", "# (C) 1999 Them\n" + MIT.replace("sublicense", "sub-license").replace(", ", ",\n  ").replace("NONINFRINGEMENT", "non-infringement"))]
    out += [("CC-BY-NC-4.0", "This work is licenced under a Creative Commons Attribution-Non-Commercial 4.0 International Licence")]
    return out


def test_whole_texts(spark):
    rows = [(k, t) for k, (_, t) in enumerate(variants())]
    rows += [(1000, None), (1001, ""), (1002, MIT + " And more."), (1003, "no match, license"), (1004, "x " * 300_000 + "license"), rows[0]]
    df = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, digest string")
    got = s.scan(df).collect()
    assert len(got) == len(rows)
    names = dict(enumerate(n for n, _ in variants()))
    for r in got:
        assert r["license_id"] == names.get(r["doc_id"]), r["text"]
        assert r["digest"] == "k"
        assert (r["license_digest"] is None) == (r["doc_id"] in (1000, 1001))


@pytest.mark.skipif(not FOLDER.exists(), reason="the texts are not here")
def test_full_texts(spark):
    """Long licences as whole texts, wrapped, spelt and marked otherwise."""
    rows = []
    for file, name in FILES.items():
        text = (FOLDER / file).read_text()
        rows += [(name, text), (name, "Copyright (C) 2021 Them\n\n" + re.sub(r"\blicense\b", "licence", text).replace("http://", "https://").upper()), (name, "\n".join(f"// {x}" for x in text.replace(", ", " - ").split("\n"))), (None, text + " And more.")]
    df = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(rows)], "doc_id long, text string")
    assert {r["doc_id"]: r["license_id"] for r in s.scan(df).collect()} == {k: n for k, (n, _) in enumerate(rows)}


def test_wrapped_text_is_no_copyright_line():
    a, b = "the above\ncopyright notice, this list\ncopyright 2020 me\nwarranty", "the above copyright notice, this list\n(c) them\nwarranty"
    assert s.canonical(a) == s.canonical(b) == "the above copyright notice this list warranty"


def test_lines(spark):
    text = "Some prose.\nReleased under the MIT License!\n  licensed under CC BY-NC 4.0.\nLicensed under the MIT licence\nmentions the MIT License"
    df = spark.createDataFrame([(1, text), (2, "prose"), (3, None)], "doc_id long, text string")
    got = {r["doc_id"]: (r["license_id"], r["line_licenses"]) for r in s.scan(df).collect()}
    assert got == {1: (None, ["CC-BY-NC-4.0", "MIT"]), 2: (None, []), 3: (None, [])}


def test_both_forms_agree(spark):
    texts = [t for _, t in variants()] + ["A–B “c” ‘d’ É", "(c) x\nkeep", "copyright\n\n copyright owner", "favour favour"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    from pyspark.sql import functions as F

    assert [r[0] for r in df.select(s.canonical_column(F.col("t"))).collect()] == [s.canonical(t) for t in texts]


def test_known_forms_hold_a_mark():
    assert all(any(m in s.canonical(t) for m in s.MARKS) for _, t in s.texts())
    assert len(dict((d, n) for n, d in s.known())) == len(s.known())


def test_empty(spark):
    assert s.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, "Released under the MIT License.", "mine", 5)], "doc_id long, text string, license_id string, `__key` int")
    got = s.scan(df)
    assert got.columns[:4] == df.columns and got.first()["license_id"] == "mine" and got.first()["__license_id"] == "MIT"
