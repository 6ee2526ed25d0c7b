"""Toxicity scores: gradient-boosted trees over dense features of a text, with isotonic calibration.

The features are densities of lexicon words (a fixed list, and words and word beginnings learned from
labelled rows), their closeness to a second person, and rates of capitals, punctuation and obfuscation.
A bounded sample of labelled rows fits lexicon, trees and calibration, each on a part of its own; every
document is scored in one pass without a shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytewords as B

MAX_LABELLED = 20_000  # labelled rows that fit the model; the rest of the table is only scored
HELD_OUT_OF, HELD_OUT = 5, 0
PREFIX_BYTES = (4, 5, 6, 7, 8, 10)
MIN_SUPPORT, MIN_PRECISION = 4, 0.9
NEAR_WORDS = 5
ROUNDS, DEPTH, RATE, BINS, MIN_LEAF = 80, 3, 0.15, 32, 8
# Insults, and words of the second person, in the languages of the corpus.
INSULTS = "idiot idiots moron morons stupid pathetic disgusting trash garbage scum loser losers clown worthless dumb imbecile filth vermin idiota imbécil estúpido basura idiote imbécile stupide ordure dummkopf abschaum blöd trottel".split()
SECOND_PERSON = "you your yours yourself du dich dir dein deine deinen ihr euch tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros".split()
FEATURES = ["log_words", "fixed_density", "learned_density", "learned_count", "weight_density", "weight_most", "near_second_person", "second_person", "capitals", "shouted_words", "punctuation", "exclamations", "questions", "obfuscated", "repeated", "word_bytes"]

_UPPER, _LETTER, _PUNCT, _MASK, _DIGIT = (np.zeros(256, bool) for _ in range(5))
_UPPER[65:91] = True
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_PUNCT[33:48] = _PUNCT[58:65] = _PUNCT[91:97] = _PUNCT[123:127] = True
_MASK[[ord(c) for c in "*@$#!%&"]] = True
_DIGIT[48:58] = True


def _hashes(words: list[str]) -> np.ndarray:
    return np.sort(np.array([B.hash_of(w) for w in words], np.uint64))


def _among(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Index in ``ordered`` of each value; -1 if it isn't there."""
    if not len(ordered):
        return np.full(len(values), -1)
    at = np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)
    return np.where(ordered[at] == values, at, -1)


def _word_keys(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """For each word its hash, and that of its beginnings; 0 where it is no longer than the beginning."""
    size = ends - starts
    keys = [B.span_hashes(low, starts, ends)]
    for n in PREFIX_BYTES:
        long = size > n
        h = np.zeros(len(starts), np.uint64)
        h[long] = B.span_hashes(low, starts[long], starts[long] + n) ^ np.uint64(n)
        keys.append(h)
    return keys


def _per_text(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0.0], np.cumsum(values, dtype=np.float64)))
    return total[at[1:]] - total[at[:-1]]


def features(data: np.ndarray, offsets: np.ndarray, lexicon: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """A row of FEATURES for each text. lexicon: hashes in order, and their weights."""
    low = B.lowered(data)
    starts, ends, first = B.spans(B.WORD[low], offsets)
    n = np.maximum(np.diff(first), 1).astype(float)
    size = np.maximum(np.diff(offsets), 1).astype(float)
    keys = _word_keys(low, starts, ends)
    fixed = _among(keys[0], _hashes(INSULTS)) >= 0
    weight = np.zeros(len(starts))
    for k in keys:
        at = _among(k, lexicon[0])
        weight = np.maximum(weight, np.where(at >= 0, lexicon[1][at] if len(lexicon[1]) else 0.0, 0.0))
    hit = (weight > 0) | fixed
    person = _among(keys[0], _hashes(SECOND_PERSON)) >= 0
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    near = np.zeros(len(starts), bool)
    for d in range(1, NEAR_WORDS + 1):
        for a, b in ((slice(d, None), slice(None, -d)), (slice(None, -d), slice(d, None))):
            near[a] |= hit[a] & person[b] & (text[a] == text[b])
    most = np.zeros(len(offsets) - 1)
    np.maximum.at(most, text, weight)
    upper, letter, punct = _UPPER[data], _LETTER[data], _PUNCT[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    inner = (_MASK[data] | _DIGIT[data])[1:-1] & letter[:-2] & letter[2:] & ~edge[1 : len(data) - 1] & ~edge[2 : len(data)] if len(data) > 2 else np.zeros(0, bool)
    same = (data[2:] == data[1:-1]) & (data[1:-1] == data[:-2]) & letter[2:] & ~edge[1 : len(data) - 1] & ~edge[2 : len(data)] if len(data) > 2 else np.zeros(0, bool)
    pad = lambda x: np.concatenate((x, np.zeros(len(data) - len(x), bool)))
    ups = np.concatenate(([0], np.cumsum(upper)))
    shouted = (ups[ends] - ups[starts] == ends - starts) & (ends - starts > 2)
    letters = np.maximum(_per_text(letter, offsets), 1)
    return np.column_stack(
        [
            np.log1p(np.diff(first)),
            _per_text(fixed, first) / n,
            _per_text(weight > 0, first) / n,
            np.log1p(_per_text(hit, first)),
            _per_text(weight, first) / n,
            most,
            _per_text(near, first) / n,
            _per_text(person, first) / n,
            _per_text(upper, offsets) / letters,
            _per_text(shouted, first) / n,
            _per_text(punct, offsets) / size,
            _per_text(data == 33, offsets) / size,
            _per_text(data == 63, offsets) / size,
            _per_text(pad(inner), offsets) / size,
            _per_text(pad(same), offsets) / size,
            _per_text(ends - starts, first) / n,
        ]
    )


@dataclass
class Trees:
    """Boosted regression trees of fixed depth on the log-odds; node i has the children 2i+1 and 2i+2."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    start: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for f, t, v in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            out += v[node - (2**DEPTH - 1)]
        return out


def boosted(x: np.ndarray, y: np.ndarray) -> Trees:
    """Newton steps on the logistic loss; splits are sought among at most BINS quantiles of a feature."""
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    binned = np.column_stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T, strict=True)])
    rate = min(max(y.mean(), 1e-3), 1 - 1e-3)
    start = math.log(rate / (1 - rate))
    score = np.full(len(y), start)
    inner, leaves = 2**DEPTH - 1, 2**DEPTH
    all_f, all_t, all_v = [], [], []
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-score))
        grad, hess = y - p, np.maximum(p * (1 - p), 1e-6)
        f, t, node = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(len(y), np.int64)
        for i in range(inner):
            inside = np.flatnonzero(node == i)
            best = (1e-6, None)
            if len(inside) >= 2 * MIN_LEAF:
                g, h = grad[inside], hess[inside]
                for j, cut in enumerate(cuts):
                    if not len(cut):
                        continue
                    b = binned[inside, j]
                    gs, hs, ns = (np.cumsum(np.bincount(b, w, len(cut) + 1))[:-1] for w in (g, h, None))
                    gain = gs**2 / (hs + 1) + (g.sum() - gs) ** 2 / (h.sum() - hs + 1) - g.sum() ** 2 / (h.sum() + 1)
                    gain[(ns < MIN_LEAF) | (len(inside) - ns < MIN_LEAF)] = 0
                    if gain.max() > best[0]:
                        best = (gain.max(), (j, cut[gain.argmax()]))
            if best[1]:
                f[i], t[i] = best[1]
            node[inside] = 2 * i + 1 + (x[inside, f[i]] > t[i])
        leaf = node - inner
        g, h = np.bincount(leaf, grad, leaves), np.bincount(leaf, hess, leaves)
        v = RATE * g / (h + 1)
        score += v[leaf]
        all_f.append(f), all_t.append(t), all_v.append(v)
    return Trees(np.array(all_f), np.array(all_t), np.array(all_v), start)


def isotonic(raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the best rising fit (pool adjacent violators), joined by straight lines between the pools' means."""
    order = np.argsort(raw, kind="stable")
    pools: list[list[float]] = []  # mean of y, weight, sum of raw
    for r, v in zip(raw[order].tolist(), y[order].tolist(), strict=True):
        pools.append([v, 1.0, r])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            v2, w2, r2 = pools.pop()
            v1, w1, r1 = pools.pop()
            pools.append([(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, r1 + r2])
    return np.array([r / w for _, w, r in pools]), np.array([(v * w + 0.5 * 0.1) / (w + 0.1) for v, w, _ in pools])


@dataclass
class Model:
    lexicon: tuple[np.ndarray, np.ndarray]
    trees: Trees | None = None
    knots: tuple[np.ndarray, np.ndarray] | None = None

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.trees is None:  # no labels to learn from: the fixed list alone
            return np.minimum(1.0, 20 * x[:, 1])
        raw = self.trees.raw(x)
        if self.knots is None:
            return 1 / (1 + np.exp(-raw))
        # a trace of the raw score keeps the order within a pool
        return np.clip(0.999 * np.interp(raw, *self.knots) + 0.001 / (1 + np.exp(-raw)), 0.0, 1.0)


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> DataFrame:
    """text, toxic and part (0 to 9) of at most ``most`` labelled texts outside the held-out fold, the same ones each time.

    A doc_id with several labels counts as toxic if any says so; of repeated rows of documents one is taken.
    """
    doc_id, text = F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
    y = labels.select(doc_id, F.col("toxic").cast("int").alias("toxic")).where(F.col("toxic").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % HELD_OUT_OF != HELD_OUT))
    y = y.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).withColumn("at", F.xxhash64("doc_id"))
    y = y.orderBy("at", "doc_id").limit(most)  # its size is bounded, so it can be sent to every task
    texts = docs.select(doc_id, text).withColumn("key", F.xxhash64("text"))
    # several texts of one doc_id count against the bound too
    chosen = texts.select("doc_id", "key").join(F.broadcast(y), "doc_id").distinct().orderBy("at", "doc_id", "key").limit(most)
    found = texts.join(F.broadcast(chosen), ["doc_id", "key"]).dropDuplicates(["doc_id", "key"])
    return found.select("text", "toxic", F.pmod("at", F.lit(10)).cast("int").alias("part"))


def learned_lexicon(sample: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Words and beginnings of words that occur almost only in toxic rows, and their log odds.

    The result is bounded by the sample. Rows of parts 0 to 4 are counted.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = batch.column("toxic").to_numpy()
            for lo, hi, data, offsets in B.chunked(B.as_strings(batch.column("text"))):
                low = B.lowered(data)
                starts, ends, first = B.spans(B.WORD[low], offsets)
                text = np.repeat(np.arange(hi - lo), np.diff(first))
                keys = _word_keys(low, starts, ends)
                pairs = np.unique(np.rec.fromarrays([np.concatenate(keys), np.tile(text, len(keys))], names="k,t"))
                pairs = pairs[pairs.k != 0]
                bad = toxic[lo:hi][pairs.t]
                keys, back = np.unique(pairs.k, return_inverse=True)
                pos = np.bincount(back, bad, len(keys)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(pos), pa.array(np.bincount(back, minlength=len(keys)) - pos)], ["key", "pos", "neg"])

    counts = sample.where("part < 5").select("text", "toxic").mapInArrow(run, "key long, pos long, neg long")
    counts = counts.groupBy("key").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    rows = counts.where((F.col("pos") >= MIN_SUPPORT) & (F.col("pos") >= MIN_PRECISION * (F.col("pos") + F.col("neg")))).collect()
    keys = np.array([r.key for r in rows], np.int64).view(np.uint64)
    weights = np.array([math.log((r.pos + 0.5) / (r.neg + 0.5)) for r in rows])
    order = np.argsort(keys)
    return keys[order], weights[order]


def fit(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> Model:
    """Lexicon from half of the sample, trees from three tenths, calibration from two tenths."""
    from . import scratch

    sample = scratch.saved(labelled_sample(docs, labels, most), "toxicity-sample")
    lexicon = learned_lexicon(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in B.chunked(B.as_strings(batch.column("text"))):
                x = features(data, offsets, lexicon)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in x.T] + [batch.column(c).slice(lo, hi - lo) for c in ("toxic", "part")], [*FEATURES, "toxic", "part"])

    rows = sample.where("part >= 5").mapInArrow(run, ", ".join(f"{f} double" for f in FEATURES) + ", toxic int, part int").toArrow()
    rows = rows.sort_by([(c, "ascending") for c in rows.column_names])  # the same trees whatever the order of tasks
    x, y, part = np.column_stack([rows[f].to_numpy() for f in FEATURES]), rows["toxic"].to_numpy().astype(float), rows["part"].to_numpy()
    grow = part < 8
    if not 0 < y[grow].sum() < grow.sum():
        return Model(lexicon)
    trees = boosted(x[grow], y[grow])
    rest = ~grow
    return Model(lexicon, trees, isotonic(trees.raw(x[rest]), y[rest]) if rest.sum() >= 50 and 0 < y[rest].sum() < rest.sum() else None)


def scored(docs: DataFrame, model: Model, column: str = "toxicity") -> DataFrame:
    """The columns of ``docs`` and one more, a score from 0 to 1, in one pass; it takes the place of one with that name.

    A null text is an empty one; repeated rows get the same score; an empty table stays one.
    """
    kept = [c for c in docs.columns if c != column]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for lo, hi, data, offsets in B.chunked(B.as_strings(batch.column("text").cast(pa.large_string()))):
                out[lo:hi] = model.scores(features(data, offsets, model.lexicon))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], [*kept, column])

    rows = docs.select(*(f"`{c}`" for c in kept))
    return rows.mapInArrow(run, rows.select("*").schema.add(column, "double"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and prediction for every document.

    Null or empty texts get the score of a text without words. Repeated rows: a result each. A null doc_id is not
    held out. Without labels of both kinds, the fixed list alone scores. An empty table gives no rows.
    """
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    rows = scored(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), fit(docs, labels))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % HELD_OUT_OF == HELD_OUT, F.lit(False))
    return rows.select("doc_id", held_out.alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))
