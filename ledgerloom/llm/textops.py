"""Vectorised text primitives for the Arrow-batched operators.

Everything works on the UTF-8 bytes of a whole Arrow batch at once; no
per-word Python objects are made.  Null texts count as empty.  Work buffers
are bounded by ``SEGMENT`` bytes whatever the length of a text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SEGMENT = 1 << 18
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: dict[int, np.ndarray] = {}


def class_table(*ranges: tuple[int, int]) -> np.ndarray:
    """A 256-entry table, true for the bytes in any of the closed ranges."""
    table = np.zeros(256, bool)
    for lo, hi in ranges:
        table[lo : hi + 1] = True
    return table


#: Word bytes of ``[^\\x20\\x09-\\x0D]+``.
NOT_SPACE = ~class_table((0x20, 0x20), (0x09, 0x0D))
#: Word bytes of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``.
ALNUM = ~class_table((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser; x is left as it is."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def buffers(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row, and the n + 1 offsets of each in them."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
    if not (pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)):
        wide = pa.large_binary() if pa.types.is_binary(texts.type) else pa.large_string()
        texts = texts.cast(wide)
    if texts.null_count:
        texts = texts.fill_null("" if pa.types.is_large_string(texts.type) else b"")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, most: int = 2 * SEGMENT) -> Iterator[tuple[int, int]]:
    """Runs of documents of at most ``most`` bytes in all; one longer stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z lower-cased; other bytes, those of other alphabets too, stay."""
    return _LOWER[data]


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of ``table``'s bytes, and the first word of each text (n + 1 entries)."""
    inside = table[data]
    edge = np.empty(len(data) + 1, bool)
    edge[0], edge[-1] = (inside[0], inside[-1]) if len(data) else (False, False)
    np.not_equal(inside[1:], inside[:-1], out=edge[1:-1])
    cut = offsets[1:-1]
    cut = np.unique(cut[(cut > 0) & (cut < len(data))])
    cut = cut[inside[cut] & inside[cut - 1]]  # a run that goes over the end of a text
    at = np.flatnonzero(edge)
    if len(cut):
        at = np.sort(np.concatenate([at, cut, cut]))
    starts, ends = at[0::2], at[1::2]
    return starts, ends, np.searchsorted(starts, offsets)


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if n not in _powers:
        out = []
        for base in (_BASE, _INVERSE):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _powers.clear()
        _powers[n] = tuple(out)
    return _powers[n]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes: a polynomial by prefix sums, then ``mix``."""
    out = np.empty(len(starts), np.uint64)
    k, n = 0, len(starts)
    while k < n:
        m = max(k + 1, int(np.searchsorted(ends, starts[k] + SEGMENT, "right")))
        lo, hi = int(starts[k]), int(ends[m - 1])
        size = SEGMENT if hi - lo <= SEGMENT else 1 << (hi - lo - 1).bit_length()
        up, down = _power(size)
        sums = np.empty(hi - lo + 1, np.uint64)
        sums[0] = 0
        part = data[lo:hi].astype(np.uint64)
        part += np.uint64(1)
        part *= up[: hi - lo]
        np.cumsum(part, out=sums[1:])
        s = starts[k:m] - lo
        out[k:m] = (sums[ends[k:m] - lo] - sums[s]) * down[s]
        k = m
    return mix(out)


def owners(first: np.ndarray) -> np.ndarray:
    """For each element, the text it belongs to; first has n + 1 entries."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))
