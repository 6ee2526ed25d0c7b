"""Language-model scores by deleted interpolation.

The model mixes maximum-likelihood estimates of a word after the words before it, after fewer of them,
alone, and of any word at all. The mixture weights depend on how often the longest known context was seen,
and are learned by expectation-maximisation on a fold of the training texts that the estimates leave out
("deleted"). Scoring then uses the counts of all training texts.

1. Texts are packed to blocks of one fold each and written to the shared folder.
2. A block asks for each different n-gram in it once, with its own count; requests are dealt out by hash
   ranges, so that a word of a third of all tokens weighs no more than any other: one entry a block. What a
   range answers to a block is a list of totals in the order that was asked for.
3. Blocks of the deleted fold, joined with their answers, give the different tuples of counts behind each
   estimate and how often they occur. A step of expectation-maximisation is one aggregation of that table.
4. Every block is joined with its answers and scored.

The numbers shuffled are in proportion to the text; a task holds a block of texts or a range of requests, both of bounded size. A
single text longer than a block is one by itself. There is a row for each block and range that have n-grams in common, so the more
text there is, the fewer numbers a row has: from some tens of thousands of blocks on, rows weigh more than their numbers, and blocks
and ranges should be larger.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytewords as B
from . import scratch

ORDER = 2  # words of the longest n-gram
FOLDS, HELD_OUT, DELETED = 7, 2, 3  # remainder of the texts that are only scored, and of those that fit the weights
KEPT = 0  # stands for the other folds
BLOCK_BYTES, RANGE_BYTES = 8 << 20, 16 << 20  # of text: in a block, and for each range of requests
STEPS, CLOSE = 25, 1e-4  # steps at most, and the change of every weight at which they end
LEAST = 1e-6  # of a weight that no estimate but any word's or the word's own has
_END = np.uint64(1)
_BEGIN = np.uint64(7)  # before the first word
_TOTALS = -1  # block of the rows that hold a range's totals


def fold(doc_id: int | None) -> int:
    """crc32 of doc_id as text, modulo FOLDS; a null doc_id counts as 0."""
    return 0 if doc_id is None else zlib.crc32(str(doc_id).encode()) % FOLDS


def squeezed(numbers: np.ndarray) -> bytes:
    """Whole numbers of 0 and more, byte by byte of all numbers, without the bytes that are 0 in all."""
    planes = numbers.astype("<u8").view(np.uint8).reshape(-1, 8).T
    used = int(planes.any(axis=1).nonzero()[0].max(initial=-1)) + 1
    return zstandard.ZstdCompressor(level=1).compress(bytes([used]) + np.ascontiguousarray(planes[:used]).tobytes())


def expanded(raw: bytes, n: int) -> np.ndarray:
    """The ``n`` numbers that ``squeezed`` was given."""
    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
    planes = np.zeros((8, n), np.uint8)
    planes[: data[0]] = data[1:].reshape(data[0], n)
    return np.ascontiguousarray(planes.T).view("<u8").ravel()


def blocks_of(docs: DataFrame) -> DataFrame:
    """block (its number), fold (KEPT, DELETED or HELD_OUT), n_bytes and payload: the doc_ids and texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        held: dict[int, list[pa.RecordBatch]] = {f: [] for f in (KEPT, DELETED, HELD_OUT)}
        size = dict.fromkeys(held, 0)

        def flush(f: int) -> pa.RecordBatch:
            nonlocal number
            own, n = pa.Table.from_batches(held[f]).combine_chunks(), size[f]
            held[f], size[f] = [], 0
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, own.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))) as to:
                to.write_table(own)
            number += 1
            return pa.RecordBatch.from_arrays([pa.array([number - 1]), pa.array([f], pa.int32()), pa.array([n]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["block", "fold", "n_bytes", "payload"])

        for batch in batches:
            folds = np.array([x if (x := fold(i)) in (DELETED, HELD_OUT) else KEPT for i in batch.column("doc_id").to_pylist()], np.int64)
            texts = B.as_strings(batch.column("text"))
            for lo, hi, _, _ in B.chunked(texts):
                part = pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), texts.slice(lo, hi - lo)], ["doc_id", "text"])
                for f in held:
                    own = part.filter(pa.array(folds[lo:hi] == f))
                    if own.num_rows:
                        held[f].append(own)
                        size[f] += pc.sum(pc.binary_length(own.column("text"))).as_py()
                    if size[f] >= BLOCK_BYTES:
                        yield flush(f)
        for f in held:
            if held[f]:
                yield flush(f)

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "block long, fold int, n_bytes long, payload binary")


@dataclass
class Grams:
    """The n-grams of a block, by order: hashes in the order of the text, different hashes, and where each is among these."""

    ids: pa.Array
    at: np.ndarray  # first token of each text and the end
    first: np.ndarray  # whether a token is the first of its text
    unique: list[np.ndarray]
    back: list[np.ndarray]
    counts: list[np.ndarray]


def grams_of(payload: bytes, order: int) -> Grams:
    """N-grams that begin before a text have a mark there, and are one with the shorter n-gram of all words so far."""
    table = pa.ipc.open_stream(payload).read_all()
    tokens, lengths = [], []
    for _, _, data, offsets in B.chunked(B.as_strings(table["text"])):
        low = B.lowered(data)
        starts, ends, first = B.spans(B.SOLID[low], offsets)
        tokens.append(np.insert(B.span_hashes(low, starts, ends), first[1:], _END))
        lengths.append(np.diff(first) + 1)
    words = np.concatenate(tokens)
    at = np.concatenate(([0], np.cumsum(np.concatenate(lengths))))
    first = np.zeros(len(words), bool)
    first[at[:-1]] = True
    out = Grams(table["doc_id"].combine_chunks(), at, first, [], [], [])
    own = words
    for n in range(order):
        if n:
            before = np.where(first, _BEGIN + np.uint64(n), np.append(own[:1], own[:-1]))
            own = B.mixed(before * np.uint64(0x9E3779B97F4A7C15) + words)
        for to, found in zip((out.unique, out.back, out.counts), np.unique(own, return_inverse=True, return_counts=True), strict=True):
            to.append(found)
    return out


def requests(blocks: DataFrame, ranges: int, order: int) -> DataFrame:
    """part (range of hashes), order, block, fold, n, and packed: the different n-grams of a block and their counts there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, f, payload in zip(batch.column("block").to_pylist(), batch.column("fold").to_pylist(), batch.column("payload"), strict=True):
                grams = grams_of(payload.as_py(), order)
                rows = []
                for n, (keys, counts) in enumerate(zip(grams.unique, grams.counts, strict=True), 1):
                    part = ((keys >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
                    cuts = np.flatnonzero(np.diff(part, prepend=-1, append=ranges))
                    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                        rows.append((int(part[a]), n, block, f, b - a, squeezed(np.diff(keys[a:b], prepend=np.uint64(0))), squeezed(counts[a:b])))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _ASKED, strict=True)], ["part", "n", "block", "fold", "size", "keys", "counts"])

    return blocks.mapInArrow(run, "part int, n int, block long, fold int, size int, keys binary, counts binary")


_ASKED = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
_ANSWER = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
_ANSWERS = "part int, n int, block long, size int, trained binary, kept binary, tokens long, tokens_kept long, kinds long"


def answers(asked: DataFrame) -> DataFrame:
    """For each request the n-grams' counts in all training texts, and for blocks of the deleted fold those in the rest of them.

    A row with block _TOTALS has the numbers of training tokens and of different ones among the range's single words.
    """

    def run(table: pa.Table) -> pa.Table:
        sizes = table["size"].to_numpy()
        ends = np.cumsum(sizes)
        folds = np.repeat(table["fold"].to_numpy(), sizes)
        keys = np.concatenate([np.cumsum(expanded(k.as_py(), n), dtype=np.uint64) for k, n in zip(table["keys"], sizes.tolist(), strict=True)])
        counts = np.concatenate([expanded(c.as_py(), n) for c, n in zip(table["counts"], sizes.tolist(), strict=True)]).astype(np.float64)  # exact below 2**53
        unique, back = np.unique(keys, return_inverse=True)
        del keys
        trained, kept = (np.bincount(back, np.where(which, counts, 0), len(unique)).astype(np.int64) for which in (folds != HELD_OUT, folds == KEPT))
        part, n = table["part"][0].as_py(), table["n"][0].as_py()
        rows = []
        for block, f, size, end in zip(table["block"].to_pylist(), table["fold"].to_pylist(), sizes.tolist(), ends.tolist(), strict=True):
            own = back[end - size : end]
            rows.append((part, n, block, size, squeezed(trained[own]), squeezed(kept[own]) if f == DELETED else None, None, None, None))
        if n == 1:
            rows.append((part, n, _TOTALS, 0, None, None, int(trained.sum()), int(kept.sum()), int((trained > 0).sum())))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _ANSWER, strict=True)], [c.split()[0] for c in _ANSWERS.split(", ")])

    return asked.groupBy("n", "part").applyInArrow(run, _ANSWERS)


def _totals(given: pa.Table, column: str, order: int) -> list[np.ndarray]:
    """By order, the answers to a block in the order of its n-grams."""
    order_of = np.lexsort((given["part"].to_numpy(), given["n"].to_numpy()))
    out: list[list[np.ndarray]] = [[np.zeros(0, np.uint64)] for _ in range(order)]
    ns, sizes, raw = given["n"].to_numpy(), given["size"].to_numpy(), given[column]
    for i in order_of.tolist():
        out[ns[i] - 1].append(expanded(raw[i].as_py(), int(sizes[i])))
    return [np.concatenate(x).astype(np.int64) for x in out]


def _estimates(grams: Grams, totals: list[np.ndarray], texts: int, tokens: int) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """(bucket, counts of the n-grams, counts of their contexts) at each token; the lists go by order, the shortest first.

    The bucket is that of the longest context that has a count: its order and binary logarithm.
    """
    count = [t[b] for t, b in zip(totals, grams.back, strict=True)]
    context = [np.full(len(count[0]), tokens)] + [np.where(grams.first, texts, np.append(c[:1], c[:-1])) for c in count[:-1]]
    bucket = np.zeros(len(count[0]), np.int64)
    for n, c in enumerate(context[1:], 1):
        some = c > 0
        bucket[some] = 64 * n + np.frexp(c[some].astype(np.float64))[1]
    return bucket, count, context


def events(blocks: DataFrame, given: DataFrame, model: Model, order: int) -> DataFrame:
    """bucket, the counts behind the estimates (g1 and c1 to the highest order) and number of such tokens, by block of the deleted fold."""
    names = ["bucket", *(f"{x}{n}" for n in range(1, order + 1) for x in ("g", "c")), "number"]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        grams = grams_of(left["payload"][0].as_py(), order)
        bucket, count, context = _estimates(grams, _totals(right, "kept", order), model.texts_kept, model.tokens_kept)
        columns = [bucket, *(x for pair in zip(count, context, strict=True) for x in pair)]
        kinds, back, number = _different(columns)
        return pa.table([pa.array(c[kinds].astype(np.int64)) for c in columns] + [pa.array(number)], names)

    own = blocks.where(F.col("fold") == DELETED).select("block", "payload")
    return own.groupBy("block").cogroup(given.where("kept IS NOT NULL").groupBy("block")).applyInArrow(run, ", ".join(f"{n} long" for n in names))


def _different(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(where each different row comes first, the kind of each row, number of each kind)."""
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for c in columns:
        own = c[order]
        new[1:] |= own[1:] != own[:-1]
    kind = np.cumsum(new) - 1
    back = np.empty(len(order), np.int64)
    back[order] = kind
    return order[new], back, np.bincount(kind, minlength=int(new.sum())).astype(np.int64)


@dataclass
class Model:
    """Totals of the training texts, and by bucket the weights of any word, the word alone, and so on to the longest n-gram."""

    order: int
    tokens: int
    tokens_kept: int
    kinds: int
    texts: int = 0
    texts_kept: int = 0
    weights: dict[int, list[float]] | None = None

    def start(self) -> list[float]:
        rest = 1 - 0.1
        return [0.1, *(rest / self.order for _ in range(self.order))]

    def of(self, buckets: np.ndarray) -> np.ndarray:
        """Rows of weights. A bucket without events has those of the next lower one with any, or else of the next higher one."""
        known = np.array(sorted(self.weights or {}), np.int64)
        if not len(known):
            return np.tile(self.start(), (len(buckets), 1))
        table = np.array([self.weights[b] for b in known.tolist()])
        return table[np.maximum(np.searchsorted(known, buckets, side="right") - 1, 0)]


def _step(found: DataFrame, model: Model, weights: dict[int, list[float]]) -> dict[int, list[float]]:
    """One step of expectation-maximisation for all buckets."""
    known = sorted(weights)
    where = F.array_position(F.array(*(F.lit(b).cast("long") for b in known)), F.col("bucket")).cast("int")
    weight = lambda i: F.element_at(F.array(*(F.lit(float(weights[b][i])) for b in known)), where)
    ratio: list[Column] = [F.lit(1 / (model.kinds + 1))]
    ratio += [F.col(f"g{n}") / F.greatest(F.col(f"c{n}"), F.lit(1)) for n in range(1, model.order + 1)]
    shares = found.select("bucket", "number", *((weight(i) * r).alias(f"s{i}") for i, r in enumerate(ratio)))
    whole = sum((F.col(f"s{i}") for i in range(1, len(ratio))), F.col("s0"))
    sums = shares.withColumn("per", F.col("number") / whole).groupBy("bucket").agg(F.sum("number").alias("number"), *(F.sum(F.col("per") * F.col(f"s{i}")).alias(f"s{i}") for i in range(len(ratio))))
    return {r["bucket"]: [r[f"s{i}"] / r["number"] for i in range(len(ratio))] for r in sums.collect()}


def learned_weights(found: DataFrame, model: Model) -> dict[int, list[float]]:
    """Weights by bucket: at most STEPS steps, until no weight changes by more than CLOSE. The driver sees sums by bucket alone."""
    weights = {r["bucket"]: model.start() for r in found.select("bucket").distinct().collect()}
    for _ in range(STEPS if weights else 0):
        before, weights = weights, _step(found, model, weights)
        if max(abs(x - y) for b in weights for x, y in zip(weights[b], before[b], strict=True)) <= CLOSE:
            break
    out = {}
    for b, mix in weights.items():
        mix = [max(mix[0], LEAST), max(mix[1], LEAST), *mix[2:]]
        out[b] = [x / sum(mix) for x in mix]
    return out


def scored(blocks: DataFrame, given: DataFrame, model: Model, order: int) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score and score of each text."""
    names = ["doc_id", "n_tokens", "n_known", "base_score", "score"]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        grams = grams_of(left["payload"][0].as_py(), order)
        bucket, count, context = _estimates(grams, _totals(right, "trained", order), model.texts, model.tokens)
        different, back = np.unique(bucket, return_inverse=True)
        mix = model.of(different)
        p = mix[back, 0] / (model.kinds + 1)
        for n, (g, c) in enumerate(zip(count, context, strict=True), 1):
            p += mix[back, n] * (g / np.maximum(c, 1))
        sums = lambda x: np.add.reduceat(x, grams.at[:-1])
        length = np.diff(grams.at)
        base = sums(np.log10(count[0] + 1.0)) - length * math.log10(model.tokens + model.kinds + 1)
        return pa.table([grams.ids, pa.array(length), pa.array(sums((count[0] > 0).astype(np.int64))), pa.array(base), pa.array(sums(np.log10(p)))], names)

    return blocks.select("block", "payload").groupBy("block").cogroup(given.groupBy("block")).applyInArrow(run, "doc_id long, n_tokens long, n_known long, base_score double, score double")


def interpolated_scores(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of ``docs``.

    Texts of fold HELD_OUT teach nothing, those of fold DELETED the weights alone until these are known.
    Null or empty text: the end alone. Repeated rows: a result each. Null doc_id: a training text. Without
    training texts every estimate is that of any word. An empty table gives no rows. Other columns, whatever
    their names, are left aside.
    """
    blocks = scratch.saved(blocks_of(docs), "lm-blocks")
    ranges = max(1, math.ceil((blocks.agg(F.sum("n_bytes")).first()[0] or 0) / RANGE_BYTES))
    given = scratch.saved(answers(requests(blocks, ranges, order)), "lm-answers")
    sums = given.where(F.col("block") == _TOTALS).agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("tokens", "tokens_kept", "kinds"))).first()
    given = given.where(F.col("block") != _TOTALS).select("part", "n", "block", "size", "trained", "kept")
    model = Model(order, *sums)
    folds = F.crc32(F.col("doc_id").cast("string")) % FOLDS
    held_out = F.coalesce(folds == HELD_OUT, F.lit(False))
    texts = docs.select(held_out.alias("held"), F.coalesce(folds == DELETED, F.lit(False)).alias("deleted")).agg(F.count_if(~F.col("held")).alias("texts"), F.count_if(~F.col("held") & ~F.col("deleted")).alias("kept")).first()
    model.texts, model.texts_kept = texts["texts"], texts["kept"]
    model.weights = learned_weights(scratch.saved(events(blocks, given, model, order), "lm-events"), model)
    whole = scored(blocks, given, model, order)
    return whole.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op8_interpolated_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and model scores of every document; odd rows as in ``interpolated_scores``."""
    return interpolated_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))
