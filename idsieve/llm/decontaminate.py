"""Benchmark passages in documents, by SimHash fingerprints of item-sized windows.

For each benchmark item, every window of as many words is fingerprinted: 64 signs of the weighted sum of
its 5-word shingles. Items are indexed by four blocks of their fingerprints, under every value that
differs in as few bits as the pigeonhole principle asks for, so that each window within the radius meets
its items. Candidates are verified by the exact similarity of the weighted shingles. A text with fewer
words than an item is one window, verified with all items that share a shingle with it.

The radius follows from the similarity: that many bits differ, at most, but for the given share of pairs.
Windows without any shingle of the benchmark have similarity 0 to all items and get no fingerprint.
Documents are not shuffled. Items go to every task as an index of INDEX_BYTES at most; where they are too many for one,
a filter of fixed size over all their shingles first takes out the documents that hold any, in one pass over all, and the
passes with an index each read these alone.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytewords as B
from . import scratch

GRAM_WORDS, SIMILARITY = 5, 0.8
SURE = 3.1  # standard deviations: one pair in a thousand is farther apart
BLOCKS, BLOCK_BITS = 4, 16
INDEX_BYTES = 128 << 20
FILTER_BITS = 20
SLOT_BITS = 27  # of the filter over all shingles: 16 MB


def radius(similarity: float) -> int:
    """Bits in which the fingerprints of two windows of this similarity differ, at most."""
    cosine = 2 * similarity / (1 + similarity)
    p = math.acos(cosine) / math.pi
    return math.ceil(64 * p + SURE * math.sqrt(64 * p * (1 - p)))


def signs(grams: np.ndarray) -> np.ndarray:
    """+1 or -1 for each bit of each shingle, a byte each."""
    bits = np.unpackbits(np.ascontiguousarray(grams, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return (bits << 1).view(np.int8) - np.int8(1)


def packed(sums: np.ndarray) -> np.ndarray:
    """Fingerprints of rows of 64 sums."""
    return np.packbits(sums > 0, axis=1, bitorder="little").view("<u8").ravel()


@dataclass
class Items:
    """One pass of benchmark items."""

    ids: list[int]
    sizes: np.ndarray  # words
    bags: list[Counter]
    prints: np.ndarray
    known: np.ndarray  # all shingles, in order
    filter: np.ndarray  # whether a shingle with these last bits may be among them
    holders: tuple[np.ndarray, np.ndarray]  # where the items of each known shingle begin, and the items
    index: list[tuple[np.ndarray, np.ndarray]]  # by block: where the items of each value begin, and the items
    short: dict[int, tuple[np.ndarray, np.ndarray]]  # by number of words under k: hashes and items


def _neighbours(bits: int, distance: int) -> np.ndarray:
    masks = [sum(1 << b for b in c) for d in range(distance + 1) for c in itertools.combinations(range(bits), d)]
    return np.array(masks, np.int64)


def items_a_pass(within: int) -> int:
    """How many items INDEX_BYTES hold: each stands under all near values of its blocks."""
    return max(1, INDEX_BYTES // (4 * BLOCKS * len(_neighbours(BLOCK_BITS, within // BLOCKS))))


def _shingles(text: str | None, k: int) -> tuple[int, np.ndarray]:
    """(words of a shingle, hashes): a text with fewer than k words has one of all of them."""
    raw = np.frombuffer((text or "").encode(), np.uint8)
    words, first = B.word_hashes(raw, np.array([0, len(raw)]))
    n = min(k, len(words))
    return n, B.gram_hashes(words, first, n)[0] if n else words


def prepare(rows: list[tuple[int, str | None]], k: int, within: int) -> Items:
    """Items without words are left out."""
    ids, sizes, bags, prints, short = [], [], [], [], {}
    for item, text in rows:
        n, grams = _shingles(text, k)
        if not n:
            continue
        if n < k:
            short.setdefault(n, []).append((int(grams[0]), item))
            continue
        ids.append(item), sizes.append(len(grams) + k - 1), bags.append(Counter(grams.tolist()))
        prints.append(packed(signs(grams).sum(0, keepdims=True))[0])
    prints = np.array(prints, np.uint64)
    known = np.unique(np.array([g for b in bags for g in b], np.uint64))
    held = sorted((g, i) for i, b in enumerate(bags) for g in b)
    holders = np.searchsorted(np.array([g for g, _ in held], np.uint64), known), np.array([i for _, i in held], np.int64)
    marks = np.zeros(1 << FILTER_BITS, bool)
    marks[known & np.uint64(len(marks) - 1)] = True
    masks, index = _neighbours(BLOCK_BITS, within // BLOCKS), []
    for b in range(BLOCKS):
        own = (prints >> np.uint64(b * BLOCK_BITS)).astype(np.int64) & ((1 << BLOCK_BITS) - 1)
        values = (own[:, None] ^ masks).ravel()
        order = np.argsort(values, kind="stable")
        index.append((np.searchsorted(values[order], np.arange((1 << BLOCK_BITS) + 1)), (order // len(masks)).astype(np.int32)))
    table = {n: (np.array([h for h, _ in sorted(x)], np.uint64), np.array([i for _, i in sorted(x)])) for n, x in short.items()}
    return Items(ids, np.array(sizes, np.int64), bags, prints, known, marks, holders, index, table)


def _near(prints: np.ndarray, items: Items, within: int) -> tuple[np.ndarray, np.ndarray]:
    """(window, item) for all fingerprints within the radius, each pair once."""
    found = []
    for b, (begin, item) in enumerate(items.index):
        value = (prints >> np.uint64(b * BLOCK_BITS)).astype(np.int64) & ((1 << BLOCK_BITS) - 1)
        n = begin[value + 1] - begin[value]
        found.append(np.repeat(np.arange(len(prints)), n) * len(items.ids) + B.gathered(item, begin[value], n))
    pairs = np.unique(np.concatenate(found))
    window, item = pairs // max(len(items.ids), 1), pairs % max(len(items.ids), 1)
    close = np.bitwise_count(prints[window] ^ items.prints[item]) <= within
    return window[close], item[close]


def _whole_texts(best: dict, grams: np.ndarray, begin: np.ndarray, first: np.ndarray, hit: np.ndarray, items: Items, k: int, similarity: float) -> None:
    """Adds matches of texts that have fewer words than the item."""
    text = np.searchsorted(begin, hit, side="right") - 1
    brief = (begin[text + 1] - begin[text]) < items.sizes.max() - k + 1
    hit, text = hit[brief], text[brief]
    if not len(hit):
        return
    at = np.searchsorted(items.known, grams[hit])
    ends = np.append(items.holders[0], len(items.holders[1]))
    n = ends[at + 1] - ends[at]
    pairs = np.unique(np.repeat(text, n) * len(items.ids) + B.gathered(items.holders[1], ends[at], n))
    text, item = pairs // len(items.ids), pairs % len(items.ids)
    own, wanted = begin[text + 1] - begin[text], items.sizes[item] - k + 1
    some = (own < wanted) & (own >= similarity * wanted - 1e-9)
    for t, i in zip(text[some].tolist(), item[some].tolist(), strict=True):
        bag = Counter(grams[begin[t] : begin[t + 1]].tolist())
        common = (bag & items.bags[i]).total()
        got = common / (bag.total() + items.bags[i].total() - common)
        if got >= similarity:
            best[t, items.ids[i]] = got, 0, int(first[t + 1] - first[t])


def passages(data: np.ndarray, offsets: np.ndarray, items: Items, k: int, similarity: float, within: int) -> dict[tuple[int, int], tuple[float, int, int]]:
    """(similarity, first word, words) of the best window, by text and item."""
    best: dict[tuple[int, int], tuple[float, int, int]] = {}
    words, first = B.word_hashes(data, offsets)
    for n, (hashes, of) in items.short.items():
        grams, begin = B.gram_hashes(words, first, n)
        at = np.flatnonzero(np.isin(grams, hashes))
        text = np.searchsorted(begin, at, side="right") - 1
        for t, a in zip(text.tolist(), at.tolist(), strict=True):
            if first[t + 1] - first[t] >= n:
                for i in of[hashes == grams[a]].tolist():
                    best.setdefault((t, i), (1.0, a - int(begin[t]), n))
    if not items.ids:
        return best
    grams, begin = B.gram_hashes(words, first, k)
    hit = np.flatnonzero(items.filter[grams & np.uint64(len(items.filter) - 1)])
    hit = hit[items.known[np.minimum(np.searchsorted(items.known, grams[hit]), len(items.known) - 1)] == grams[hit]]
    if not len(hit):
        return best
    _whole_texts(best, grams, begin, first, hit, items, k, similarity)
    # stretches of shingles, within one text, from which a window with a hit can be cut
    reach = int(items.sizes.max()) - k
    text = np.searchsorted(begin, hit, side="right") - 1
    lo, hi = np.maximum(hit - reach, begin[text]), np.minimum(hit + reach + 1, begin[text + 1])
    new = np.concatenate(([True], lo[1:] > hi[:-1]))
    new[1:] |= text[1:] != text[:-1]
    lo, hi, text = lo[new], hi[np.append(np.flatnonzero(new)[1:] - 1, len(hi) - 1)], text[new]
    length = hi - lo
    flat = B.gathered(np.arange(len(grams)), lo, length)
    stretch = np.repeat(np.arange(len(lo)), length)
    hits = np.concatenate(([0], np.cumsum(np.isin(flat, hit))))
    sums = np.zeros((len(flat) + 1, 64), np.int32)
    np.cumsum(signs(grams[flat]), axis=0, dtype=np.int32, out=sums[1:])
    for size in np.unique(items.sizes).tolist():
        m = size - k + 1
        if len(flat) < m:
            continue
        start = np.flatnonzero((stretch[m - 1 :] == stretch[: len(flat) - m + 1]) & (hits[m:] > hits[:-m]))
        if not len(start):
            continue
        window, item = _near(packed(sums[start + m] - sums[start]), items, within)
        same = items.sizes[item] == size
        for w, i in zip(start[window[same]].tolist(), item[same].tolist(), strict=True):
            t = int(text[stretch[w]])
            bag = items.bags[i]
            common = sum((Counter(grams[flat[w : w + m]].tolist()) & bag).values())
            got = common / (2 * m - common)
            if got >= similarity and (-got, at := int(flat[w] - begin[t])) < (lambda b: (-b[0], b[1]))(best.get((t, items.ids[i]), (0.0, at, 0))):
                best[t, items.ids[i]] = got, at, size
    return best


def touching(docs: DataFrame, slots: np.ndarray, sizes: list[int], k: int) -> DataFrame:
    """The rows whose text holds a shingle of k words, or of as many as one of ``sizes``, in a slot of the filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in B.chunked(B.as_strings(batch.column("text"))):
                words, first = B.word_hashes(data, offsets)
                keep = np.zeros(hi - lo, bool)
                for n in (k, *sizes):
                    grams, begin = B.gram_hashes(words, first, n)
                    slot = grams & np.uint64(len(slots) * 8 - 1)
                    hit = np.flatnonzero(slots[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8) & 1)
                    keep[np.searchsorted(begin, hit, side="right") - 1] = True
                yield batch.slice(lo, hi - lo).filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)


def benchmark_matches(docs: DataFrame, benchmark: DataFrame, k: int = GRAM_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, text_key, item_id, similarity, first_word and n_words: the best window of each document for each item in it.

    Weighted similarity of two bags of shingles: the sum of the smaller counts over that of the larger.
    Items with fewer than k words match windows of the same words. A text with fewer words than the item is
    its own only window. Null or empty texts match nothing, nor do items without an id. Repeated rows have a
    result each; an empty table on either side gives none. Other columns, whatever their names, are left aside.
    """
    within = radius(similarity)
    listed = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("item_id IS NOT NULL")
    passes = max(1, math.ceil(listed.count() / items_a_pass(within)))
    schema = "doc_id long, text_key long, item_id long, similarity double, first_word long, n_words long"
    whole = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).withColumn("text_key", F.xxhash64("text"))

    def rows_of(n: int) -> list[tuple[int, str]]:
        rows = listed.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == n).distinct().collect()
        return sorted((r.item_id, r.text or "") for r in rows)

    if passes > 1:
        slots, sizes = np.zeros((1 << SLOT_BITS) // 8, np.uint8), set()
        for n in range(passes):
            for _, text in rows_of(n):
                size, grams = _shingles(text, k)
                sizes.add(size)
                slot = grams & np.uint64((1 << SLOT_BITS) - 1)
                np.bitwise_or.at(slots, (slot >> np.uint64(3)).astype(np.int64), np.uint8(1) << (slot & np.uint64(7)).astype(np.uint8))
        whole = scratch.saved(touching(whole, slots, sorted(sizes - {0, k}), k), "benchmark-touching")

    def one(n: int) -> DataFrame:
        items = prepare(rows_of(n), k, within)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for lo, _, data, offsets in B.chunked(B.as_strings(batch.column("text"))):
                    found = passages(data, offsets, items, k, similarity, within)
                    if found:
                        at = pa.array([lo + t for t, _ in found])
                        made = [pa.array(c) for c in zip(*((i, *v) for (_, i), v in found.items()), strict=True)]
                        yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(at), batch.column("text_key").take(at), *made], ["doc_id", "text_key", "item_id", "similarity", "first_word", "n_words"])

        return whole.mapInArrow(run, schema)

    return functools.reduce(DataFrame.union, (one(n) for n in range(passes)))


def without_benchmark(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no benchmark item; of repeated rows all or none."""
    text_key, bad_id, bad_key = scratch.unused(docs, "text_key", "bad_id", "bad_key")
    keyed = docs.withColumn(text_key, F.xxhash64(F.col("text").cast("string")))
    found = benchmark_matches(docs, benchmark, **options).select("doc_id", "text_key").distinct().toDF(bad_id, bad_key)
    return keyed.join(found, F.col("doc_id").cast("long").eqNullSafe(F.col(bad_id)) & (F.col(text_key) == F.col(bad_key)), "left_anti").drop(text_key)


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All benchmark items in all documents.

    Null or empty texts and items give no rows; repeated rows a result each; an empty table an empty result.
    """
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return benchmark_matches(docs, items).drop("text_key")
