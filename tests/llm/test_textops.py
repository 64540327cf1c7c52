import re

import numpy as np
import pyarrow as pa
from hypothesis import given
from hypothesis import strategies as st

from ledgerloom.llm import textops

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet=st.sampled_from("aAbZ é\t\n0-.漢"), max_size=40)), max_size=8)


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


@given(TEXTS)
def test_words(texts):
    for table, pattern in ((textops.NOT_SPACE, r"[^\x20\x09-\x0D]+"), (textops.ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        data, offsets = textops.buffers(pa.array(texts, pa.string()))
        data = textops.lowered(data)
        s, e, first = textops.words(data, offsets, table)
        for k, t in enumerate(texts):
            got = [bytes(data[s[i] : e[i]]).decode() for i in range(first[k], first[k + 1])]
            assert got == re.findall(pattern, low(t or ""))


def test_hashes_depend_on_the_word_alone(monkeypatch):
    words = [f"word{k % 50}" for k in range(400)] + ["x" * 300]
    hashes = []
    for segment in (64, 1 << 20):
        monkeypatch.setattr(textops, "SEGMENT", segment)
        data, offsets = textops.buffers(pa.array([" ".join(words)]))
        s, e, _ = textops.words(data, offsets, textops.NOT_SPACE)
        hashes.append(textops.word_hashes(data, s, e))
    assert (hashes[0] == hashes[1]).all()
    assert len(np.unique(hashes[0])) == 51


def test_slices():
    offsets = np.array([0, 5, 5, 30, 31, 40])
    assert list(textops.slices(offsets, 10)) == [(0, 2), (2, 3), (3, 5)]
    assert list(textops.slices(np.array([0]), 10)) == []
