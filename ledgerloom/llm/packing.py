"""Hierarchical multi-length packing of token ids.

Each task packs the rows of its own partition, so nothing is shuffled and no
group is gathered: texts come in Arrow batches, are tokenised, and leave as
piece rows.  A document is its ids and then id 0.

Routing: full windows of ``window`` ids are cut off a document as they come.
What is left (under a window) is routed to the smallest of the tiers that holds
it (window, window / 2, window / 4).  When the pool of leftovers is full, the
tiers are packed from the longest: a leftover opens a window of its tier; the
gap is filled with whole leftovers of shorter tiers, largest first, then by
cutting the smallest leftover that covers what is left.  So every sequence is
full.  What a pool cannot fill waits for the next; at the end of a partition
the rest is laid into sequences of falling powers of two, which need no padding.

Sequences of a pool are dealt over its step groups, the largest first, each to
the group with the fewest ids, so that the groups of a pool weigh the same.

Sequence and step ids carry the partition number in their upper bits; the same
input splits give the same ids again when a lost task is run anew.

Defined cases: null and empty texts are the single id 0; a null id stays null;
repeated rows are packed each; an empty table gives no pieces.  Memory is
bounded by an Arrow batch, one document's ids and the pool.
"""

from __future__ import annotations

import base64
import functools
import heapq
import json
import re
import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ledgerloom.llm.common import column, mapped

WINDOW = 1024
POOL = 4096
STEP_IDS = 1 << 16
#: Longer texts are encoded in parts of about so many characters, cut where the tokenizer's pattern cuts too.
PART = 1 << 20

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("start", T.LongType()),
    T.StructField("length", T.LongType()),
    T.StructField("ids_crc32", T.LongType()),
    T.StructField("doc_tokens", T.LongType()),
    T.StructField("sequence_id", T.LongType()),
    T.StructField("offset", T.LongType()),
    T.StructField("tier", T.LongType()),
    T.StructField("step_group", T.LongType()),
])
_NAMES = [f.name for f in SCHEMA]
#: Texts of these characters alone: both libraries split and encode them alike. Others go the way of the slower one.
_COMMON = re.compile(r"[\t\n\r\x20-\x7e¡-ɏ‐-†]*")
_SAFE_CUT = re.compile(r"(?<=[^\s]\n)(?=[^\s])")


class Encoder:
    """Text to ids of the byte-level vocabulary, as the ``tokenizers`` library gives them without special tokens added.

    ``encode`` takes the same vocabulary by ``tiktoken`` for texts of common
    characters, where the ids are the same at a quarter of the time.  A text
    that spells a special token out has its id there, as the library does it.
    """

    def __init__(self, path: str | None = None, ranks_path: str | None = None) -> None:
        import public_tokenizers
        import tiktoken

        self.path = path or public_tokenizers.path("byte_bpe_50k.json")
        with open(ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        with open(self.path, encoding="utf-8") as f:
            added = [t["content"] for t in json.load(f)["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, added)) or "(?!)")
        self._slow = None

    def slow(self, text: str) -> np.ndarray:
        if self._slow is None:
            from tokenizers import Tokenizer

            self._slow = Tokenizer.from_file(self.path)
        return np.array(self._slow.encode(text, add_special_tokens=False).ids, np.uint32)

    def encode(self, text: str) -> np.ndarray:
        parts = [self.fast.encode_to_numpy(p) if _COMMON.fullmatch(p) and not self.special.search(p) else self.slow(p) for p in self._parts(text)]
        return parts[0] if len(parts) == 1 else np.concatenate(parts)

    def _parts(self, text: str) -> list[str]:
        if len(text) <= 2 * PART:
            return [text]
        out, at = [], 0
        while len(text) - at > 2 * PART and (m := _SAFE_CUT.search(text, at + PART)):
            out.append(text[at : m.start()])
            at = m.start()
        return [*out, text[at:]]


@functools.lru_cache(maxsize=1)
def encoder_of(path: str | None) -> Encoder:
    """The worker's encoder: one for all its tasks."""
    return Encoder(path)


class _Pool:
    """Leftovers by length; each is (length, number, doc_id, start, ids, doc_tokens)."""

    def __init__(self) -> None:
        self.by: list[tuple] = []
        self.ids = 0
        self.count = 0

    def add(self, doc, start: int, ids: np.ndarray, total: int) -> None:
        insort(self.by, (len(ids), self.count, doc, start, ids, total))
        self.count += 1
        self.ids += len(ids)

    def take(self, at: int) -> tuple:
        x = self.by.pop(at)
        self.ids -= x[0]
        return x

    def at_most(self, n: int) -> int:
        """The place of the longest leftover of at most n ids, or -1."""
        return bisect_right(self.by, (n + 1,)) - 1

    def at_least(self, n: int) -> int:
        at = bisect_left(self.by, (n,))
        return at if at < len(self.by) else -1


def _fill(pool: _Pool, size: int, first: tuple | None = None) -> list[tuple]:
    """Pieces of one full sequence: whole leftovers, largest first, then one cut."""
    pieces, gap = ([first], size - first[0]) if first else ([], size)
    while gap:
        at = pool.at_most(gap)
        small = at >= 0 and (pool.by[at][0] == gap or len(pieces) < 12)
        if small:
            x = pool.take(at)
        else:
            if (at := pool.at_least(gap)) < 0:
                at = len(pool.by) - 1
            x = pool.take(at)
            if x[0] > gap:
                _, _, doc, start, ids, total = x
                pool.add(doc, start + gap, ids[gap:], total)
                x = (gap, 0, doc, start, ids[:gap], total)
        pieces.append(x)
        gap -= x[0]
    return pieces


def _pack(pool: _Pool, window: int, last: bool) -> list[tuple[int, list[tuple]]]:
    """(tier, pieces) of the sequences that the pool fills; with last, all of it."""
    out = []
    for tier in (window, window // 2, window // 4):
        # leftovers over half a tier open its windows, longest first, as long as there is enough to fill them
        while pool.ids >= tier and pool.by[-1][0] > tier // 2:
            if pool.by[-1][0] > tier:  # cut anew by an earlier fill
                break
            out.append((tier, _fill(pool, tier, pool.take(len(pool.by) - 1))))
    while pool.ids >= window:
        out.append((window, _fill(pool, window)))
    while last and pool.ids:
        size = 1 << (pool.ids.bit_length() - 1)
        out.append((size, _fill(pool, size)))
    return out


def pack(docs: DataFrame, id: str = "doc_id", text: str = "text", window: int = WINDOW, pool_size: int = POOL, step_ids: int = STEP_IDS, path: str | None = None) -> DataFrame:
    """One row a piece (``SCHEMA``); window: a power of two, 4 at least."""
    if window < 4 or window & (window - 1):
        raise ValueError("window must be a power of two, 4 at least")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, pool = encoder_of(path), _Pool()
        base = TaskContext.get().partitionId() << 40
        rows: list[list] = [[] for _ in _NAMES]
        state = {"sequence": 0, "group": 0}

        def emit(sequences: list[tuple[int, list[tuple]]]) -> None:
            n = max(1, -(-sum(s for s, _ in sequences) // step_ids))
            groups = [(0, state["group"] + k) for k in range(n)]
            state["group"] += n
            for size, pieces in sorted(sequences, key=lambda s: -s[0]):
                load, group = heapq.heappop(groups)
                heapq.heappush(groups, (load + size, group))
                offset = 0
                for length, _, doc, start, ids, total in pieces:
                    for out, x in zip(rows, (doc, start, length, zlib.crc32(ids), total, base + state["sequence"], offset, size, base + group), strict=True):
                        out.append(x)
                    offset += length
                state["sequence"] += 1

        def batch() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in rows], _NAMES)
            for x in rows:
                x.clear()
            return out

        full: list[tuple[int, list[tuple]]] = []
        for b in batches:
            for doc, body in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = np.append(encoder.encode(body.as_py() or ""), np.uint32(0)).astype("<u4")
                total, start = len(ids), 0
                while total - start >= window:
                    full.append((window, [(window, 0, doc, start, ids[start : start + window], total)]))
                    start += window
                if start < total:
                    pool.add(doc, start, ids[start:].copy(), total)
                if len(pool.by) >= pool_size or len(full) * window >= 4 * step_ids:
                    emit(full + (_pack(pool, window, False) if len(pool.by) >= pool_size else []))
                    full.clear()
                    yield batch()
        emit(full + _pack(pool, window, True))
        yield batch()

    return mapped(docs.select(column(id).cast("long").alias("doc_id"), column(text).alias("text")), task, SCHEMA)
