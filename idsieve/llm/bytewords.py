"""Vectorised splitting and hashing of texts, shared by the operators of this package.

An Arrow column of texts is looked at as one run of UTF-8 bytes, some MB at a time. Tokens are
spans of that run, and every span gets a 64-bit hash from prefix sums, so no Python object is
made per word. Nulls count as empty texts.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20
_MULT = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: A random number per byte value, the same in every process.
_BYTE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes of words after A-Z are lower-cased: digits, a-z and whatever is not ASCII.
WORD = np.zeros(256, bool)
WORD[48:58] = WORD[97:123] = WORD[128:] = True
#: Bytes of tokens that end at white space.
SOLID = np.ones(256, bool)
SOLID[[32, *range(9, 14)]] = False
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        _powers[:] = [np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(size - 1, m, np.uint64)))) for m in (_MULT, _INV)]
    return _powers[0], _powers[1]


def as_strings(column: pa.Array | pa.ChunkedArray) -> pa.LargeStringArray:
    """One array without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):  # several chunks that were too large for one
        column = pa.concat_arrays(column.chunks)
    return pc.fill_null(column.cast(pa.large_string()), "")


def chunked(texts: pa.LargeStringArray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, end, bytes, offsets into them) of runs of whole texts with about ``limit`` bytes."""
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case."""
    return _LOWER[data]


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first span of each text and the end) of the runs of true bytes; a run ends with its text."""
    n = len(inside)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    before[edge[:n]] = False
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    after[edge[1:]] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads each bit over all."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span; depends on its bytes alone."""
    up, down = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * down[starts])


def hash_of(text: str | bytes) -> int:
    """The hash of one token, for tests and fixed words."""
    raw = np.frombuffer(text.encode() if isinstance(text, str) else text, np.uint8)
    return int(span_hashes(raw, np.array([0]), np.array([len(raw)]))[0])


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, first word of each text and the end) after A-Z are lower-cased."""
    low = lowered(data)
    starts, ends, first = spans(WORD[low], offsets)
    return span_hashes(low, starts, ends), first


def gram_hashes(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each run of ``k`` words that ends in its text, first run of each text and the end).

    A text with 1 to k-1 words has one run, of all its words; one without words has none.
    """
    counts = np.diff(first)
    runs = np.where(counts >= k, counts - k + 1, (counts > 0).astype(counts.dtype))
    begin = np.concatenate(([0], np.cumsum(runs)))
    text = np.repeat(np.arange(len(counts)), runs)
    at = first[:-1][text] + np.arange(begin[-1]) - begin[:-1][text]
    length = np.minimum(counts, k)[text]
    h = length.astype(np.uint64)
    padded = np.concatenate((words, np.zeros(k, np.uint64)))
    for i in range(k):
        h = h * _MULT + np.where(length > i, padded[at + i], np.uint64(0))
    return mixed(h), begin


def lists(values: np.ndarray, offsets: np.ndarray) -> pa.ListArray:
    """An Arrow list column from flat values; counts are small enough for Spark's 32-bit offsets."""
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values))


def gathered(flat: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The pieces flat[begin:begin+length], one after the other."""
    ends = np.cumsum(length)
    if not len(ends):
        return flat[:0]
    return flat[np.arange(ends[-1]) + np.repeat(begin - (ends - length), length)]


class PieceCache:
    """Ids of tokens by their 64-bit hashes, in a table of fixed size; each token has two slots that may hold it.

    ``encode(tokens)`` gives a list of lists or arrays of ids for a list of byte strings, or all ids and how many each has. A slot also has the token's bytes, and
    counts only for the same bytes. Memory is bounded by ``slots`` and ``ids``; what was put out is encoded again when
    it comes back.
    """

    def __init__(self, encode, slots: int = 1 << 20, ids: int = 8_000_000, dtype=np.int32):
        self.encode, self.slots, self.limit, self.dtype = encode, slots, ids, dtype
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(self.slots, np.uint64)
        self.begin = np.zeros(self.slots, np.int64)
        self.length = np.zeros(self.slots, np.int32)
        self.raw_begin = np.zeros(self.slots, np.int64)
        self.raw_length = np.zeros(self.slots, np.int32)
        self.flat, self.used = np.zeros(1 << 16, self.dtype), 0
        self.raw, self.raw_used = np.zeros(1 << 16, np.uint8), 0

    @staticmethod
    def _with(store: np.ndarray, used: int, more: np.ndarray) -> np.ndarray:
        """The store with more behind what is used of it."""
        if used + len(more) > len(store):
            store = np.concatenate((store[:used], np.zeros(max(len(more), len(store)), store.dtype)))
        store[used : used + len(more)] = more
        return store

    def _same(self, slot: np.ndarray, which: np.ndarray, data: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether the slots of those tokens hold the tokens' bytes."""
        out = np.zeros(len(slot), bool)
        likely = np.flatnonzero(which & (self.raw_length[slot] == length))
        size = length[likely]
        equal = gathered(self.raw, self.raw_begin[slot[likely]], size) == gathered(data, begin[likely], size)
        ends = np.cumsum(size)
        wrong = np.concatenate(([0], np.cumsum(~equal)))
        out[likely] = wrong[ends] == wrong[ends - size]
        return out

    def ids(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(all ids in order, number of ids of each span)."""
        hashes = span_hashes(data, starts, ends)
        unique, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        if self.used > self.limit or self.raw_used > 4 * self.limit:
            self.clear()
        at, size = starts[first], (ends - starts)[first]
        slot = (unique & np.uint64(self.slots - 1)).astype(np.int64)
        other = (unique >> np.uint64(40) & np.uint64(self.slots - 1)).astype(np.int64)
        there = self._same(slot, self.keys[slot] == unique, data, at, size)
        there_too = self._same(other, ~there & (self.keys[other] == unique), data, at, size)
        found = np.where(there, slot, other)
        begin, length = self.begin[found], self.length[found].copy()
        missing = np.flatnonzero(~there & ~there_too)
        if len(missing):
            raw = data.tobytes()
            new = self.encode([raw[a : a + n] for a, n in zip(at[missing].tolist(), size[missing].tolist(), strict=True)])
            if isinstance(new, tuple):
                flat, sizes = new
            else:
                sizes = np.fromiter(map(len, new), np.int64, len(new))
                flat = np.fromiter(itertools.chain.from_iterable(new), self.dtype, int(sizes.sum()))
            self.flat = self._with(self.flat, self.used, flat)
            own = gathered(data, at[missing], size[missing])
            self.raw = self._with(self.raw, self.raw_used, own)
            ids_at, raw_at = self.used + np.cumsum(sizes) - sizes, self.raw_used + np.cumsum(size[missing]) - size[missing]
            self.used, self.raw_used = self.used + len(flat), self.raw_used + len(own)
            begin[missing], length[missing] = ids_at, sizes
            put = np.where(self.keys[slot[missing]] == 0, slot[missing], other[missing])
            self.keys[put], self.begin[put], self.length[put], self.raw_begin[put], self.raw_length[put] = unique[missing], ids_at, sizes, raw_at, size[missing]
        return gathered(self.flat, begin[back], length[back].astype(np.int64)), length[back]
