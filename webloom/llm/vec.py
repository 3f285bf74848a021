"""Vectorised words and shingles: whole Arrow batches of text as numpy arrays, without a Python step per word.

Words are runs of bytes other than ASCII white space (0x20, 0x09-0x0D), ASCII letters lower-cased. A word is a 64-bit
polynomial hash of its bytes, mixed; a shingle mixes the hashes of its words with their number.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_BASE = 0x9E3779B97F4A7C55
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_WORD = ~_SPACE
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: Texts are worked on in slices of about so many bytes, so that memory doesn't grow with a batch; the arrays of a slice take
#: some forty times as much.
SLICE_BYTES = 500_000
#: Batches whose rows are worked on at once are cut into parts of about so many bytes of text.
PART_BYTES = 4_000_000
#: Powers for spans of so many bytes stay in memory; those for a longer text are made anew and freed again.
_KEPT = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _made(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_BASE, _BASE_INVERSE):
        p = np.full(n, base, U)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


_kept = functools.lru_cache(maxsize=1)(_made)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, n at least of each."""
    return _kept(_KEPT) if n <= _KEPT else _made(n)


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow string array and the offsets of its texts in them; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, "i8")[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return (raw[at[0] : at[-1]], at - at[0]) if len(at) else (raw[:0], np.zeros(1, "i8"))


def slices(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of successive slices of whole texts."""
    data, at = flat(texts)
    row, n = 0, len(at) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(at, at[row] + SLICE_BYTES, "right")) - 1)
        yield row, data[at[row] : at[end]], at[row : end + 1] - at[row]
        row = end


@functools.lru_cache(maxsize=1)
def _allocator():
    """The C library's call that gives freed memory back, where it has one."""
    return getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Returns memory that a task has freed: a Python worker lives on after its task, beside those of later stages."""
    pa.default_memory_pool().release_unused()
    if (trim := _allocator()) is not None:
        trim(0)


def parts(batches, column: int, size: int):
    """Parts of record batches with about `size` bytes of text in `column`, so that a worker's memory doesn't grow with a batch."""
    for batch in batches:
        # lengths alone, without a copy of the texts
        ends, row = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False), dtype="i8"), 0
        while row < batch.num_rows:
            done = ends[row - 1] if row else 0
            end = max(row + 1, int(np.searchsorted(ends, done + size, "right")))
            yield batch.slice(row, end - row)
            row = end
    give_back()


def spans(data: np.ndarray, at: np.ndarray, is_word: np.ndarray = _WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in `data`, and the number of the first word of each text (and of the end)."""
    if not len(data):
        none = np.zeros(0, "i8")
        return none, none, np.zeros(len(at), "i8")
    word = is_word[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    start, end = word.copy(), word.copy()
    start[1:] &= ~word[:-1] | edge[1:-1]
    end[:-1] &= ~word[1:] | edge[1:-1]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, at)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each span."""
    if not len(starts):
        return np.zeros(0, U)
    power, inverse = _powers(len(data))
    values = (_LOWER[data] if lower else data).astype(U) + U(1)
    sums = np.zeros(len(data) + 1, U)
    np.cumsum(values * power[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(U) * U(0xD6E8FEB86659FD93))


def words(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, word hashes, number of the first word of each text and of the end) by slices."""
    for row, data, at in slices(texts):
        starts, ends, first = spans(data, at)
        yield row, hashes(data, starts, ends), first


def shingles(word: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """k-word shingles in order, and the number of the first of each text; a text of fewer words is one shingle."""
    n = len(word)
    total = np.zeros(n, U)
    for j in range(k):
        part = word[j:] if j else word
        total[: n - j] += mix(part * U(2 * j + 1) + U(j * 0x51_7C_C1B7 + k)) if len(part) else U(0)
    total = mix(total)
    length = np.diff(first)
    keep = np.ones(n, bool)
    for j in range(1, k):
        at = first[1:][length >= j] - j
        keep[at] = False
    short = np.flatnonzero((length > 0) & (length < k))
    for d in short:
        a, b = first[d], first[d + 1]
        total[a] = mix(np.array([np.sum(mix(word[a:b] * (np.arange(b - a).astype(U) * U(2) + U(1)))) + U(b - a)], U) ^ U(0xA5A5_5A5A_0F0F_F0F0))[0]
        keep[a] = True
    counts = np.where(length >= k, length - k + 1, (length > 0).astype("i8"))
    return total[keep], np.concatenate([[0], np.cumsum(counts)])


def sets(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct k-word shingles of each text."""
    for _, word, first in words(texts):
        values, at = shingles(word, first, k)
        for a, b in zip(at[:-1], at[1:], strict=True):
            part = np.sort(values[a:b])
            yield part[np.concatenate([[True], part[1:] != part[:-1]])] if b - a > 1 else part
