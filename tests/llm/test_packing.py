import random
import zlib

import numpy as np
import pytest

from ledgerloom.llm import packing


def texts():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh éß") for _ in range(rng.randrange(1, 9)))
    out = [" ".join(word() for _ in range(rng.randrange(1, 700))) for _ in range(120)]
    return [*out, None, "", "<|endoftext|> x", "a\n" * 3000, "漢字 text   wide", "tab\tand\x85next\xa0line", "y" * 5000, "q " * 30_000]


@pytest.fixture(scope="module")
def encoder():
    return packing.Encoder()


def slow_ids(encoder, text):
    return np.append(encoder.slow(text or ""), np.uint32(0)).astype("<u4")


def test_fast_and_slow_ids_agree(encoder):
    rng = random.Random(9)
    alphabet = [chr(c) for c in [*range(9, 11), 13, *range(32, 127), *range(0xA1, 0x250), *range(0x2010, 0x2021)]]
    for _ in range(400):
        t = "".join(rng.choices(alphabet, k=rng.randrange(60)))
        assert packing._COMMON.fullmatch(t)
        assert encoder.fast.encode_ordinary(t) == encoder.slow(t).tolist(), repr(t)
    for t in texts():
        assert encoder.encode(t or "").tolist() == encoder.slow(t or "").tolist()


def test_ids_are_those_of_an_untouched_tokenizer(encoder):
    """Special tokens that a text spells out included."""
    import public_tokenizers
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for t in [*texts(), "hello <|endoftext|> world", "<|endoftext|>", "a<|endoftext|><|endoftext|>", "<|endoftext|", "x" * 3000 + "\ny <|endoftext|>"]:
        assert encoder.encode(t or "").tolist() == plain.encode(t or "", add_special_tokens=False).ids


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a b", 7, "x")], "doc_id long, text string, `start` int, `Sequence_ID` string")
    rows = packing.pack(df).toPandas()
    assert list(rows.columns) == packing._NAMES and rows.length.sum() == rows.doc_tokens.iloc[0] == 3


def test_parts_of_long_texts(encoder, monkeypatch):
    monkeypatch.setattr(packing, "PART", 50)
    for t in ["one line\nand 's another\n\n two blank\n \nend " * 20, "x" * 400, "a\nb" * 200]:
        assert "".join(encoder._parts(t)) == t and encoder.encode(t).tolist() == encoder.slow(t).tolist()
    assert len(encoder._parts("a\nb" * 200)) > 3


@pytest.mark.parametrize(("window", "pool", "parts"), [(1024, 4096, 1), (256, 16, 3), (64, 5, 2)])
def test_pieces(spark, encoder, window, pool, parts):
    docs = list(enumerate(texts()))
    df = spark.createDataFrame([*docs, (None, "no id")], "doc_id long, text string").repartition(parts)
    rows = packing.pack(df, window=window, pool_size=pool, step_ids=4 * window).toPandas()
    for i, t in docs:
        ids, at = slow_ids(encoder, t), 0
        for r in rows[rows.doc_id == i].sort_values("start").itertuples():
            assert r.start == at and r.doc_tokens == len(ids) and r.length > 0
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for _, s in rows.sort_values("offset").groupby("sequence_id"):
        assert (s.offset == s.length.cumsum() - s.length).all()
        n = int(s.length.sum())
        assert n <= window and n & (n - 1) == 0 and (s.tier == n).all() and s.step_group.nunique() == 1
    groups = rows.groupby("step_group").length.sum()
    assert groups.max() <= 6 * window


def test_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([(1, "same text"), (1, "same text")], "doc_id long, text string")
    rows = packing.pack(df).toPandas()
    assert rows.length.sum() == 2 * rows.doc_tokens.iloc[0]
    assert packing.pack(df.limit(0)).count() == 0
    with pytest.raises(ValueError, match="power"):
        packing.pack(df, window=1000)
