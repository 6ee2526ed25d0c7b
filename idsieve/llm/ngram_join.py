"""Self-join of texts whose sets of word 5-grams have a Jaccard similarity of 0.8 or more.

1. One pass hashes every text's n-grams to a digest of the set and the keys of its MinHash bands. Texts
   with the same set are one node from here on, however many copies there are.
2. Nodes meet on band keys. A bucket is not expanded to pairs: it links its nodes to their least one, and
   the connected components of these links hold all pairs of candidates.
3. The n-grams of candidates, and of no other text, are dealt out: those of small components by component,
   those of others by bucket, a large bucket as pairs of blocks. There a pair is compared in the first band
   that it shares, and nowhere else. Each task compares full sets by counting common n-grams in matrix
   products, and emits a row for each node: how many it is linked to, and its least node among those linked
   directly or not.
4. Components of the verified links are the classes.

The numbers of bands and rows follow from the similarity and the recall asked for.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytewords as B
from . import scratch
from .components import components

GRAM_WORDS, SIMILARITY, RECALL = 5, 0.8, 0.9995
MAX_HASHES = 256
BLOCK_GRAMS, BLOCK_NODES = 1_000_000, 1200
COLUMNS, ROWS = 2048, 128


def choose_bands(similarity: float, recall: float, most: int = MAX_HASHES) -> tuple[int, int]:
    """(bands, rows): the most selective rows with which a pair of this similarity meets in a band with the given probability."""
    best = None
    for rows in range(1, most + 1):
        p = max(similarity**rows, 1e-300)
        bands = 1 if p >= recall else math.ceil(math.log1p(-recall) / math.log1p(-p))
        if bands * rows <= most:
            best = bands, rows
    if best is None:
        raise ValueError("no number of bands reaches this recall")
    return best


def gram_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(different n-gram hashes of each text in order, first of each text and the end)."""
    words, first = B.word_hashes(data, offsets)
    grams, begin = B.gram_hashes(words, first, k)
    sets = [np.unique(grams[a:b]) for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)]
    return np.concatenate([*sets, grams[:0]]), np.concatenate(([0], np.cumsum([len(s) for s in sets], dtype=np.int64)))


def band_keys(grams: np.ndarray, begin: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A row of 64-bit band keys for each text with n-grams; zeros for one without."""
    multiply = np.random.default_rng(11).integers(0, 1 << 32, (2, bands * rows), dtype=np.uint64).astype(np.uint32)
    out = np.zeros((len(begin) - 1, bands), np.uint64)
    some = np.flatnonzero(np.diff(begin))
    if not len(some):
        return out
    high = (grams >> np.uint64(32)).astype(np.uint32)
    at = begin[some]
    for b in range(bands):
        key = np.full(len(some), b + 1, np.uint64)
        for r in range(b * rows, (b + 1) * rows):
            least = np.minimum.reduceat(high * (multiply[0, r] | np.uint32(1)) + multiply[1, r], at)
            key = B.mixed(key ^ least.astype(np.uint64)) + np.uint64(r)
        out[some, b] = key
    return out


def signed(docs: DataFrame, k: int, bands: int, rows: int) -> DataFrame:
    """doc_id, text_key, digest (of the n-gram set; null without words), n (its size) and keys of the bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in B.chunked(B.as_strings(batch.column("text"))):
                grams, begin = gram_sets(data, offsets, k)
                keys = band_keys(grams, begin, bands, rows)
                raw = memoryview(grams.tobytes())
                nodes = [hashlib.blake2b(raw[8 * a : 8 * b], digest_size=16).digest() if b > a else None for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)]
                cut = [batch.column(c).slice(lo, hi - lo) for c in ("doc_id", "text_key")]
                yield pa.RecordBatch.from_arrays([*cut, pa.array(nodes, pa.binary()), pa.array(np.diff(begin)), B.lists(keys.view(np.int64).ravel(), np.arange(hi - lo + 1) * bands)], ["doc_id", "text_key", "digest", "n", "keys"])

    keyed = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).withColumn("text_key", F.xxhash64("text"))
    return keyed.mapInArrow(run, "doc_id long, text_key long, digest binary, n long, keys array<long>")


def _parts(n: int) -> Iterator[slice]:
    """Runs of rows of a matrix, so that what is made of them is small beside it."""
    return (slice(a, a + ROWS) for a in range(0, n, ROWS))


def _labels(linked: np.ndarray) -> np.ndarray:
    """The least index of each component of a symmetric matrix of links."""
    label = np.arange(len(linked))
    while True:
        new = label.copy()
        for part in _parts(len(linked)):
            new[part] = np.minimum(label[part], np.where(linked[part], label[None, :], len(linked)).min(1, initial=len(linked)))
        new = new[new]
        if (new == label).all():
            return label
        label = new


def common_counts(grams: list[np.ndarray]) -> np.ndarray:
    """How many n-grams each two sets have in common, from matrix products over blocks of n-grams that several have."""
    sizes = np.array([len(g) for g in grams])
    row = np.repeat(np.arange(len(grams)), sizes)
    flat = np.concatenate(grams)
    order = np.argsort(flat, kind="stable")
    flat, row = flat[order], row[order]
    new = np.concatenate(([True], flat[1:] != flat[:-1]))
    column = np.cumsum(new) - 1
    several = np.bincount(column)[column] > 1
    row, column = row[several], column[several]
    column = np.cumsum(np.concatenate(([0], (np.diff(column) > 0).astype(np.int64)))) if len(column) else column
    out = np.zeros((len(grams), len(grams)), np.float32)
    cuts = np.searchsorted(column, np.arange(0, (column[-1] if len(column) else -1) + COLUMNS + 1, COLUMNS))
    for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        if b > a:
            x = np.zeros((len(grams), COLUMNS), np.float32)
            x[row[a:b], column[a:b] - i * COLUMNS] = 1
            out += x @ x.T
    return out


def _shared_before(keys: np.ndarray, band: int) -> np.ndarray:
    """Whether each two rows of band keys agree in a band before this one."""
    out = np.zeros((len(keys), len(keys)), bool)
    for b in range(band):
        out |= keys[:, b][:, None] == keys[:, b][None, :]
    return out


def compared(members: DataFrame, similarity: float) -> DataFrame:
    """Verify groups of candidates. Rows: node, linked (documents in other nodes linked to it in this group) and hub.

    members: cell, grp, i, j, block, band, keys, node, copies and grams. A task gets one cell: small components (band is -1), or
    one pair of blocks of a bucket. There, pairs that share an earlier band are left to it, and nodes of the same
    block are only compared where i = j.
    """
    share = similarity / (1 + similarity)

    def run(table: pa.Table) -> pa.Table:
        nodes, groups = table["node"].to_numpy(), table["grp"].to_numpy()
        copies, block = table["copies"].to_numpy(), table["block"].to_numpy()
        i, j, band = (table[c][0].as_py() for c in ("i", "j", "band"))
        lists = table["grams"].combine_chunks()
        lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
        flat, at = lists.values.to_numpy(), lists.offsets.to_numpy()
        order = np.lexsort((nodes, groups))  # the least node of a group is its first
        rows = []
        for own in np.split(order, np.flatnonzero(np.diff(groups[order])) + 1):
            left = ~np.eye(len(own), dtype=bool)
            if band > 0:
                left &= ~_shared_before(np.array([table["keys"][x].as_py()[:band] for x in own.tolist()], np.int64), band)
            if i != j:
                left &= block[own][:, None] != block[own][None, :]
            if left.any():
                sizes = (at[own + 1] - at[own]).astype(np.float64)
                common = common_counts([flat[at[x] : at[x + 1]] for x in own])
                for part in _parts(len(own)):
                    left[part] &= common[part] >= share * (sizes[part, None] + sizes[None, :]) - 1e-6
                del common
            linked = np.concatenate([left[part] @ copies[own] for part in _parts(len(own))])
            rows.append((nodes[own], linked, nodes[own][_labels(left)]))
        return pa.table([pa.array(np.concatenate(c)) for c in zip(*rows, strict=True)], ["node", "linked", "hub"])

    return members.groupBy("cell", "i", "j").applyInArrow(run, "node long, linked long, hub long")


def _blocks() -> Column:
    """How many blocks of bounded size hold what has these sums."""
    return F.greatest(F.ceil(F.col("grams") / BLOCK_GRAMS), F.ceil(F.col("members") / BLOCK_NODES)).cast("int")


def _cells(found: DataFrame, met: DataFrame) -> tuple[DataFrame, bool]:
    """The candidates with ``cells``: where each is compared, as structs (cell, grp, band, blocks). Whether there are large components."""
    sums = [F.sum("n").alias("grams"), F.count("*").alias("members")]
    sizes = scratch.saved(found.groupBy("root").agg(*sums).select("root", "grams", _blocks().alias("blocks")), "join-sizes")
    small, large = sizes.agg(F.sum(F.expr("IF(blocks = 1, grams, 0)")), F.coalesce(F.max("blocks") > 1, F.lit(False))).first()
    bins = max(1, math.ceil((small or 0) / BLOCK_GRAMS))
    of_bin = F.array(F.struct(F.concat(F.lit("c"), F.pmod(F.xxhash64("root"), F.lit(bins))).alias("cell"), F.col("root").alias("grp"), F.lit(-1).alias("band"), F.lit(1).alias("blocks")))
    if not large:
        return found.withColumn("cells", of_bin), False
    among = scratch.saved(sizes.where("blocks > 1").select("root", F.lit(True).alias("large")), "join-large")  # few, so mostly sent to all tasks
    found = scratch.saved(found.join(among, "root", "left").withColumn("large", F.coalesce("large", F.lit(False))), "join-found")
    inside = scratch.saved(met.join(found.where("large").select("node", "n"), "node"), "join-inside")
    buckets = inside.groupBy("key", "band").agg(*sums).where("members > 1").select("key", "band", _blocks().alias("blocks"))
    inside = inside.join(scratch.saved(buckets, "join-buckets"), ["key", "band"])
    of_buckets = inside.groupBy("node").agg(F.collect_list(F.struct(F.concat(F.lit("b"), "key").alias("cell"), F.col("key").alias("grp"), "band", "blocks")).alias("of_buckets"))  # one for each band at most
    found = found.join(of_buckets, "node", "left")
    return found.withColumn("cells", F.when(F.col("large"), F.col("of_buckets")).otherwise(of_bin)).drop("of_buckets", "large"), True


def _verified(docs: DataFrame, k: int, similarity: float, recall: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(texts with their digests, nodes, and of each node in a group of candidates ``linked`` and ``class``)."""
    bands, rows = choose_bands(similarity, recall)
    texts = scratch.saved(signed(docs, k, bands, rows), "join-texts")
    nodes = texts.where("digest IS NOT NULL").groupBy("digest").agg(F.min(F.struct("doc_id", "text_key")).alias("first"), F.min("doc_id").alias("least"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("keys").alias("keys"))
    nodes = scratch.saved(nodes.withColumn("node", F.monotonically_increasing_id()), "join-nodes")
    met = nodes.select("node", F.posexplode("keys").alias("band", "key"))
    hubs = scratch.saved(met.groupBy("key", "band").agg(F.min("node").alias("hub"), F.max("node").alias("last")).where("hub < last").select("key", "band", "hub"), "join-hubs")
    met = scratch.saved(met.join(hubs, ["key", "band"]), "join-met")
    roots = components(met.select(F.col("hub").alias("a"), F.col("node").alias("b")))
    found = scratch.saved(nodes.drop("digest", "least").join(roots, "node"), "join-candidates")
    found, large = _cells(found, met.drop("hub"))
    wanted = found.select("node", "copies", "keys", "cells", F.col("first.doc_id").alias("id"), F.col("first.text_key").alias("key"))
    whole = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).withColumn("key", F.xxhash64("text"))
    near = whole.join(wanted, whole["id"].eqNullSafe(wanted["id"]) & (whole["key"] == wanted["key"])).drop(wanted["id"]).drop(wanted["key"]).drop("id", "key")

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in B.chunked(B.as_strings(batch.column("text"))):
                flat, begin = gram_sets(data, offsets, k)
                cut = [batch.column(c).slice(lo, hi - lo) for c in ("node", "copies", "keys", "cells")]
                yield pa.RecordBatch.from_arrays([*cut, B.lists(flat.view(np.int64), begin)], ["node", "copies", "keys", "cells", "grams"])

    members = near.mapInArrow(grams, "node long, copies long, keys array<long>, cells array<struct<cell: string, grp: long, band: int, blocks: int>>, grams array<long>")
    members = members.withColumn("at", F.explode("cells")).select("node", "copies", "grams", "at.*", F.when(F.col("at.band") > 0, F.col("keys")).alias("keys"))
    members = members.withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    members = members.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).drop("blocks", "other")
    # identical rows of one document would come twice
    members = members.dropDuplicates(["cell", "grp", "i", "j", "node"]) if _repeats(texts) else members
    checked = scratch.saved(compared(members, similarity), "join-checked")
    linked = checked.groupBy("node").agg(F.sum("linked").alias("linked"), F.min("hub").alias("class"))
    if large:
        classes = components(checked.select(F.col("node").alias("a"), F.col("hub").alias("b")))
        linked = linked.drop("class").join(classes.withColumnRenamed("root", "class"), "node", "left")
    return texts, nodes, scratch.saved(linked, "join-linked")


def similarity_join(docs: DataFrame, k: int = GRAM_WORDS, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """doc_id, text_key, class_key, class_id, links and class_size for every row of ``docs``.

    Two texts are linked if their sets of word k-grams have the similarity or more; a text with fewer words
    has one gram of all its words. ``links`` counts the documents linked to this one, ``class_id`` is the
    least doc_id among those linked directly or through others: null if all are null, and the same for two
    classes whose least doc_id is. ``class_key`` is a class's own. A text without words (null, empty) links to
    none and is its own class, without a key. Other columns, whatever their names, are left aside.
    """
    texts, nodes, linked = _verified(docs, k, similarity, recall)
    nodes = nodes.select("node", "digest", "least", "copies").join(linked, "node", "left")
    nodes = scratch.saved(nodes.select("digest", "least", "copies", F.coalesce("linked", F.lit(0)).alias("linked"), F.coalesce("class", "node").alias("class_key")), "join-nodes")
    of_class = scratch.saved(nodes.groupBy("class_key").agg(F.min("least").alias("class_id"), F.sum("copies").alias("class_size")), "join-classes")
    nodes = nodes.join(of_class, "class_key").select("digest", "class_key", (F.col("copies") - 1 + F.col("linked")).alias("links"), "class_id", "class_size")
    alone = F.col("digest").isNull()
    return texts.select("doc_id", "text_key", "digest").join(scratch.saved(nodes, "join-result"), "digest", "left").select("doc_id", "text_key", "class_key", F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("class_size", F.lit(1)).alias("class_size"))


def _repeats(texts: DataFrame) -> bool:
    """Whether any row of the same id and text comes twice."""
    return not texts.groupBy("doc_id", "text_key").count().where("count > 1").isEmpty()


def one_of_each_class(docs: DataFrame, k: int = GRAM_WORDS, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """The rows of ``docs``, all columns, that come first in their class: least doc_id (nulls first), then least text key.

    Of rows with equal doc_id and text one stays: that whose columns, as JSON, have the least digest. Texts without words all stay,
    but for repeated rows. An empty table stays one.
    """
    texts, nodes, linked = _verified(docs, k, similarity, recall)
    # a node has the first of its copies, nulls first
    groups = nodes.select("node", "first").join(linked.select("node", "class"), "node", "left").groupBy(F.coalesce("class", "node")).agg(F.min("first").alias("first"))
    text_key, keep_id, keep_key = scratch.unused(docs, "text_key", "keep_id", "keep_key")
    kept = groups.select("first.doc_id", "first.text_key").union(texts.where("digest IS NULL").select("doc_id", "text_key")).toDF(keep_id, keep_key)
    keyed = docs.withColumn(text_key, F.xxhash64(F.col("text").cast("string")))
    kept = keyed.join(kept, F.col("doc_id").cast("long").eqNullSafe(F.col(keep_id)) & F.col(text_key).eqNullSafe(F.col(keep_key)), "left_semi")
    row = F.struct(*(f"`{c}`" for c in docs.columns))
    # of rows that differ in other columns only, the choice is the same whenever a task is run again
    first = F.min_by(row, F.sha2(F.to_json(row), 256)).alias(keep_key)
    return kept.groupBy("doc_id", text_key).agg(first).select(f"`{keep_key}`.*")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and number of links of every document.

    Null or empty texts: links 0, a class of their own. Equal texts: one class, linked to each other. An
    empty table gives no rows. Texts of any length are compared whole.
    """
    return similarity_join(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "class_id", "links", "class_size")
