"""Token ids as ORC files: stripes with integer run-length encoding, row indexes and Bloom filters on document ids.

Documents are dealt out by ranges of ``doc_id`` and sorted, so that each file and each stripe covers a
narrow range of ids: a lookup skips files by their statistics, stripes by row index and Bloom filter,
and a scan reads stripes in parallel.
"""

from __future__ import annotations

import functools
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bytewords as B
from . import scratch

END_ID = 0
STRIPE_BYTES = 32 << 20
INDEX_STRIDE = 1000
LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 0
# The code points with the property White_Space.
_WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@functools.lru_cache(1)
def _classes() -> np.ndarray:
    kinds = np.fromiter((ord(unicodedata.category(chr(c))[0]) for c in range(0x110000)), np.uint8, 0x110000)
    out = np.zeros(0x110000, np.uint8)
    out[kinds == ord("L")] = LETTER
    out[kinds == ord("N")] = NUMBER
    out[_WHITE] = SPACE
    return out


def pretoken_starts(data: np.ndarray, offsets: np.ndarray, classes: np.ndarray | None = None) -> np.ndarray:
    """Byte offsets at which the byte-level BPE's pattern begins a new piece, for whole texts at once. ``classes`` says of each code
    point whether it is a letter, a number, white space or other; by default as Python's tables do.

    The pattern is: a contraction; runs of letters, of numbers or of other characters, each with one
    space before it if there is one; or white space, whose last character is left to what follows.
    """
    at = np.flatnonzero((data & 0xC0) != 0x80)
    if not len(at):
        return at
    chars = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    kind = (_classes() if classes is None else classes)[chars]
    n = len(chars)
    edge = np.zeros(n + 1, bool)
    edge[np.searchsorted(at, offsets)] = True
    first = edge[:n]
    before = np.concatenate(([OTHER], kind[:-1]))
    space = kind == SPACE
    blank_before = np.concatenate(([False], chars[:-1] == 32)) & ~first
    start = first | ((kind != before) & ~(~space & blank_before))
    last_white = space[:-1] & ~space[1:] & ~first[1:]
    start[:-1] |= last_white
    # contractions: a lone apostrophe that begins a piece, with s t m d re ve ll after it
    quote = np.flatnonzero((chars == 39) & start)
    for i in quote.tolist():
        if i + 1 >= n or first[i + 1] or (kind[i + 1] != LETTER):
            continue
        two = i + 2 < n and not first[i + 2]
        a, b = chr(chars[i + 1]), chr(chars[i + 2]) if two else ""
        size = 1 if a in "stmd" else 2 if a + b in ("re", "ve", "ll") else 0
        if size:
            start[i + 1] = False
            end = i + 1 + size
            if end < n and not first[end] and kind[end] == LETTER:
                start[end] = True
    return at[start]


@functools.lru_cache(2)
def _cache(tokenizer: str) -> B.PieceCache:
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(tokenizer)
    model.encode_special_tokens = True  # their strings in a text are ordinary text

    def one_by_one(pieces: list[bytes]) -> list[np.ndarray]:
        return [np.array(e.ids, np.int32) for e in model.encode_batch_fast([p.decode() for p in pieces], add_special_tokens=False)]

    line_end = one_by_one([b"\n"])[0][0]

    def encode(pieces: list[bytes]) -> list[np.ndarray]:
        """Pieces joined by line ends go through the library in one call; white space goes alone."""
        solid = [i for i, p in enumerate(pieces) if not p.isspace() and not p.decode().isspace()]
        out: list = [None] * len(pieces)
        for lo in range(0, len(solid), 5000):
            part = solid[lo : lo + 5000]
            text = "\n".join(pieces[i].decode() for i in part)
            ids = np.array(model.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int32)
            cut = np.flatnonzero(ids == line_end)
            if len(cut) == len(part) - 1:
                for i, a, b in zip(part, [0, *(cut + 1).tolist()], [*cut.tolist(), len(ids)], strict=True):
                    out[i] = ids[a:b]
            else:
                for i, x in zip(part, one_by_one([pieces[i] for i in part]), strict=True):
                    out[i] = x
        rest = [i for i, x in enumerate(out) if x is None]
        for i, x in zip(rest, one_by_one([pieces[i] for i in rest]), strict=True):
            out[i] = x
        return out

    return B.PieceCache(encode, slots=1 << 21, ids=8_000_000)


def encode_texts(texts: pa.LargeStringArray, tokenizer: str, end_id: int = END_ID) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, end, ids, offsets of the texts in them), with the end id after each text."""
    cache = _cache(tokenizer)
    for lo, hi, data, offsets in B.chunked(texts):
        starts = pretoken_starts(data, offsets)
        ends = np.append(starts[1:], len(data)).astype(np.int64)
        ids, sizes = cache.ids(data, starts, ends)
        begin = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))
        before = begin[np.searchsorted(starts, offsets)]  # ids before each text
        yield lo, hi, np.insert(ids, before[1:], np.int32(end_id)), before + np.arange(hi - lo + 1)


def encode_documents(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """doc_id and ids: the byte-level BPE ids of the whole text and the end id. A null text is an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, ids, offsets in encode_texts(B.as_strings(batch.column("text")), tokenizer, end_id):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), B.lists(ids, offsets)], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, ids array<int>")


def write_tokens(docs: DataFrame, to: str, tokenizer: str, end_id: int = END_ID) -> None:
    """Write the ids of all documents below ``to`` in ascending order of doc_id: over the files, and within each.

    Texts cross the shuffle, as they are smaller than their ids; encoding follows in the writing task. A doc_id that many
    rows have, or none, is dealt out over several files by the rows' places in the input.
    """
    order = [F.col("doc_id"), F.col("place")]
    ordered = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("place")).repartitionByRange(*order).sortWithinPartitions(*order)
    (
        encode_documents(ordered, tokenizer, end_id)
        .write.option("compression", "zstd")
        .option("orc.stripe.size", STRIPE_BYTES)
        .option("orc.create.index", "true")
        .option("orc.row.index.stride", INDEX_STRIDE)
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .orc(to)
    )


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id and ids of all documents."""
    return spark.read.schema("doc_id long, ids array<int>").orc(path)


def lookup(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """Ids of some documents; statistics, row indexes and Bloom filters keep other stripes from being read."""
    return read_tokens(spark, path).where(F.col("doc_id").isin(doc_ids))


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, from the files.

    ``start`` counts the ids of all documents before: those of earlier files, and in the same file of
    smaller doc_id (equal ones in the order of n_tokens and ids_crc32). Null doc_ids come first.
    """

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            raw = memoryview(np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False)).astype("<u4", copy=False)).cast("B")
            at = ids.offsets.to_numpy().astype(np.int64)
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("doc_id"), pa.array(np.diff(at)), pa.array(crc, pa.int64())], ["file", "doc_id", "n_tokens", "ids_crc32"])

    rows = read_tokens(spark, path).select("doc_id", "ids", F.col("_metadata.file_name").alias("file"))
    rows = scratch.saved(rows.mapInArrow(measure, "file string, doc_id long, n_tokens long, ids_crc32 long"), "token-index")
    # a row for each file; only the first ones have rows without doc_id
    files = rows.groupBy("file").agg(F.sum("n_tokens").alias("n"), F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
    before = Window.orderBy(F.col("least").asc_nulls_first(), F.col("most").asc_nulls_first(), "file").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("file").orderBy(F.col("doc_id").asc_nulls_first(), "n_tokens", "ids_crc32").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    return rows.join(files, "file").select("doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def op7_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written as ORC and read back.

    Null text: the end id alone. Null doc_id: kept, before the others. An empty table gives no rows.
    """
    import public_tokenizers

    to = scratch.path(spark, "tokens-orc")
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), to, public_tokenizers.path("byte_bpe_50k.json"))
    return token_index(spark, to)
