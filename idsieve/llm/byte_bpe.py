"""Byte-level BPE by a finite-state transducer, and decoding by an incremental UTF-8 state machine.

The merges of a rank file are compiled into a transducer that reads a piece of text (a match of the splitting
pattern) byte by byte and emits its tokens as soon as they are certain. Two facts make that possible: the tokens of a
prefix are those of a shorter prefix and one more token, and a token may follow another just if merging
their joint bytes gives those two again. So for every place where a token of the vocabulary could still begin, the
transducer keeps the tokens that lead there; when all of them begin alike, that beginning is emitted. No more
bytes than the longest token has are looked at again.

A state is what is kept: the last token emitted, the bytes behind each open place (as a node of the vocabulary's trie), and the
tokens that lead to it. States and transitions are made when a text first needs them (lazy determinisation), up to
MAX_TRANSITIONS, after which they are made anew. A piece takes time in proportion to its length, however long it is.

Ranks come from the file; nothing is trained.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import os
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from . import bytewords as B
from .token_orc import LETTER, NUMBER, SPACE, pretoken_starts

MAX_TRANSITIONS = 400_000
MAX_PAIRS = 400_000  # pairs of tokens that are remembered


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens and their ranks, which are their ids: a line each, base64 and a number."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@functools.lru_cache(1)
def _classes() -> np.ndarray:
    """The class of each code point by the library's own tables, as versions of Unicode differ: what a pattern matches comes back."""
    import tiktoken

    points = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    out = np.zeros(0x110000, np.uint8)
    for pattern, kind in ((r"\p{L}", LETTER), (r"\p{N}", NUMBER), (r"\s", SPACE)):
        library = tiktoken.Encoding(pattern, pat_str=pattern, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
        out[np.frombuffer(bytes(library.encode_ordinary(points)).decode().encode("utf-32-le"), np.uint32)] = kind
    return out


class Transducer:
    """Encodes pieces by ranks, as merging the neighbours of lowest joint rank, leftmost first, does.

    A state is (the id emitted last or -1, open places); a place is (node in the trie of the tokens that the bytes behind it
    lead to, ids from the emitted ones up to it), the end of the input, at the root, last.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token: dict[int, bytes] = {rank: t for t, rank in ranks.items()}
        self.longest = max(map(len, ranks))
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("every byte needs a rank")
        #: By node of the trie the nodes that follow, and the id of the token that ends there; -1 if none does that merging makes.
        self.kids: list[dict[int, int]] = [{}]
        self.ends: list[int] = [-1]
        self.halves: dict[int, tuple[int, int]] = {}
        for t, rank in ranks.items():
            parts, last = self.merge(t)
            node = 0
            for b in t:
                at = self.kids[node].get(b)
                if at is None:
                    at = self.kids[node][b] = len(self.kids)
                    self.kids.append({})
                    self.ends.append(-1)
                node = at
            if len(parts) == 1:  # others come only as whole pieces
                self.ends[node] = rank
            if last and len(parts) == 1:
                self.halves[rank] = ranks[last[0]], ranks[last[1]]
                if max(self.halves[rank]) >= rank:
                    raise ValueError(f"{t!r} has a lower rank than a part that it is made of")
        self.pairs: dict[int, bool] = {}
        self.forget()

    def forget(self) -> None:
        """Let go of all states."""
        self.states: list[tuple] = []
        self.numbers: dict[tuple, int] = {}
        self.steps: dict[int, int] = {}  # by 256 * state + byte: 2 * next state, and 1 more if ids are emitted
        self.emitted: dict[int, tuple[int, ...]] = {}
        self.number((-1, ((0, ()),)))

    def number(self, state: tuple) -> int:
        n = self.numbers.get(state)
        if n is None:
            n = self.numbers[state] = len(self.states)
            self.states.append(state)
        return n

    def merge(self, text: bytes) -> tuple[list[bytes], tuple[bytes, bytes] | None]:
        """The tokens of a short text by merging, and the two merged last."""
        parts, last = [text[i : i + 1] for i in range(len(text))], None
        while True:
            best = min(((self.ranks[a + b], n) for n, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in self.ranks), default=None)
            if best is None:
                return parts, last
            n = best[1]
            last = parts[n], parts[n + 1]
            parts[n : n + 2] = [last[0] + last[1]]

    def follows(self, left: int, right: int) -> bool:
        """Whether merging their joint bytes gives just these two.

        The merges that made the two are undone, the later one first (of equal ones the right one). Before each the ids that meet in
        the middle must not merge earlier than what has been undone.
        """
        token, ranks, halves = self.token, self.ranks, self.halves
        limit = len(token) + 1 << 32
        first = False  # whether a joint of the same rank would have come first, too
        while True:
            joint = ranks.get(token[left] + token[right])
            if joint is not None and (joint < limit or (first and joint == limit)):
                return False
            a, b = left if left in halves else -1, right if right in halves else -1
            if a > b:
                limit, first, left = a, False, halves[left][1]
            elif b < 0:
                return True
            else:
                limit, first, right = b, True, halves[right][0]

    def step(self, number: int, byte: int) -> tuple[int, int]:
        """(key, entry of ``steps``) of a state and a byte, made now."""
        last, places = self.states[number]
        if len(self.steps) >= MAX_TRANSITIONS:
            self.forget()
            number = self.number((last, places))
        kids, ends, pairs = self.kids, self.ends, self.pairs
        to, chain = [], None
        for node, ids in places:
            after = kids[node].get(byte)
            if after is None:
                continue
            if chain is None and (own := ends[after]) >= 0:
                before = ids[-1] if ids else last
                if before < 0:
                    chain = *ids, own
                else:
                    pair = before << 32 | own
                    fits = pairs.get(pair)
                    if fits is None:
                        if len(pairs) >= MAX_PAIRS:
                            pairs.clear()
                        fits = pairs[pair] = self.follows(before, own)
                    if fits:
                        chain = *ids, own
            if kids[after]:
                to.append((after, ids))
        to.append((0, chain))
        certain: tuple[int, ...] = os.path.commonprefix([ids for _, ids in to]) if to[0][1] else ()
        if n := len(certain):
            last, to = certain[-1], [(node, ids[n:]) for node, ids in to]
        key = number << 8 | byte
        entry = self.steps[key] = self.number((last, tuple(to))) << 1 | (n > 0)
        if n:
            self.emitted[key] = certain
        return key, entry

    def ids(self, piece: bytes) -> list[int]:
        """The ids of one piece; a piece that is itself a token is that one."""
        if len(piece) <= self.longest and piece in self.ranks:
            return [self.ranks[piece]]
        out: list[int] = []
        state = 0
        for byte in piece:
            key = state << 8 | byte
            entry = self.steps.get(key)
            if entry is None:
                key, entry = self.step(state, byte)
            if entry & 1:
                out.extend(self.emitted[key])
            state = entry >> 1
        out.extend(self.states[state][1][-1][1])
        return out


# UTF-8 as (first byte from, to, second byte from, to, bytes that follow the second), by the Unicode standard.
_UTF8 = [
    (0xC2, 0xDF, 0x80, 0xBF, 0),
    (0xE0, 0xE0, 0xA0, 0xBF, 1),
    (0xE1, 0xEC, 0x80, 0xBF, 1),
    (0xED, 0xED, 0x80, 0x9F, 1),
    (0xEE, 0xEF, 0x80, 0xBF, 1),
    (0xF0, 0xF0, 0x90, 0xBF, 2),
    (0xF1, 0xF3, 0x80, 0xBF, 2),
    (0xF4, 0xF4, 0x80, 0x8F, 2),
]
BETWEEN, BROKEN = 0, 1  # states: between two characters; after bytes that are no UTF-8


@functools.lru_cache(1)
def utf8_states() -> np.ndarray:
    """The state after a byte, by state and byte; states over 1 wait for further bytes of a character."""
    table = [np.full(256, BROKEN, np.uint8), np.full(256, BROKEN, np.uint8)]
    table[BETWEEN][:128] = BETWEEN
    known: dict[tuple[int, int, int], int] = {}

    def waiting(lo: int, hi: int, more: int) -> int:
        if (lo, hi, more) not in known:
            known[lo, hi, more] = len(table)
            table.append(np.full(256, BROKEN, np.uint8))
            here = table[-1]
            here[lo : hi + 1] = waiting(0x80, 0xBF, more - 1) if more else BETWEEN
        return known[lo, hi, more]

    for first, to, lo, hi, more in _UTF8:
        table[BETWEEN][first : to + 1] = waiting(lo, hi, more)
    return np.array(table)


class Vocabulary:
    """What encoding and decoding by one rank file need."""

    def __init__(self, path: str):
        ranks = read_ranks(path)
        self.transducer = Transducer(ranks)
        size = max(ranks.values()) + 1
        token: list[bytes] = [b""] * size
        for t, rank in ranks.items():
            token[rank] = t
        self.known = np.zeros(size, bool)
        self.known[list(ranks.values())] = True
        self.bytes, self.at = np.frombuffer(b"".join(token), np.uint8), np.cumsum([0, *map(len, token)])
        spelt = [b"%d," % i for i in range(size)]
        self.spelt, self.spelt_at = np.frombuffer(b"".join(spelt), np.uint8), np.cumsum([0, *map(len, spelt)])
        self.token = token
        self.after: list[dict[int, int]] = [{} for _ in utf8_states()]  # the state after a token, by state
        self.whole = np.array([self.state_after(BETWEEN, i) == BETWEEN for i in range(size)])
        self.cache = B.PieceCache(lambda pieces: list(map(self.transducer.ids, pieces)), slots=1 << 20, ids=4_000_000)

    def state_after(self, state: int, i: int) -> int:
        out = self.after[state].get(i)
        if out is None:
            out, table = state, utf8_states()
            for byte in self.token[i]:
                out = int(table[out, byte])
            self.after[state][i] = out
        return out

    def raw(self, ids: np.ndarray) -> np.ndarray:
        return B.gathered(self.bytes, self.at[ids], self.at[ids + 1] - self.at[ids])


@functools.lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Decoder:
    """Decodes ids as they come: ``feed`` gives the bytes of all characters that are complete, ``state`` says what is missing.

    From the first byte on that can't belong to UTF-8 all bytes are given out as they come, and the state is BROKEN.
    """

    def __init__(self, words: Vocabulary):
        self.words, self.state, self.rest = words, BETWEEN, b""

    def feed(self, ids: np.ndarray) -> bytes:
        parts = np.flatnonzero(~self.words.whole[ids])  # tokens that end within a character or begin in one
        n, at, done, state = len(ids), 0, 0, self.state
        while at < n and state != BROKEN:
            if state == BETWEEN:
                k = np.searchsorted(parts, at)
                at = done = int(parts[k]) if k < len(parts) else n
                if at == n:
                    break
            state = self.words.state_after(state, int(ids[at]))
            at += 1
            if state == BETWEEN:
                done = at
        self.state = state
        if state == BROKEN:
            done = n
        if not done:
            self.rest += self.words.raw(ids).tobytes()
            return b""
        out = self.rest + self.words.raw(ids[:done]).tobytes()
        self.rest = self.words.raw(ids[done:]).tobytes()
        return out

    def finish(self) -> bytes:
        """What is left of a character that has not been completed."""
        out, self.rest = self.rest, b""
        return out


FEED = 1 << 16  # ids that are decoded at a time


def decoded_parts(ids: np.ndarray, words: Vocabulary) -> tuple[list[bytes], bool]:
    """The bytes of a list of ids in parts of whole characters, and whether they are UTF-8."""
    if len(ids) and (ids.min() < 0 or ids.max() >= len(words.known) or not words.known[ids].all()):
        raise ValueError("an id is not in the vocabulary")
    decoder = Decoder(words)
    parts = [decoder.feed(ids[lo : lo + FEED]) for lo in range(0, len(ids), FEED)]
    return [*parts, decoder.finish()], decoder.state == BETWEEN


def encode_texts(texts: pa.LargeStringArray, path: str) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, end, ids, offsets of the texts in them). Each distinct piece goes through the transducer once as long as a
    cache of bounded size holds it."""
    cache = vocabulary(path).cache
    for lo, hi, data, offsets in B.chunked(texts):
        starts = pretoken_starts(data, offsets, _classes())
        ids, sizes = cache.ids(data, starts, np.append(starts[1:], len(data)).astype(np.int64))
        begin = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))
        yield lo, hi, ids, begin[np.searchsorted(starts, offsets)]


def encoded(docs: DataFrame, ranks: str, column: str = "ids") -> DataFrame:
    """The columns of ``docs`` and the ids of the whole text, in place of a column so named. A null text has none."""
    kept = [c for c in docs.columns if c != column]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, ids, offsets in encode_texts(B.as_strings(batch.column("text")), ranks):
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(lo, hi - lo) for c in kept), B.lists(ids, offsets)], [*kept, column])

    rows = docs.select(*(f"`{c}`" for c in kept))
    return rows.mapInArrow(run, rows.select("*").schema.add(column, ArrayType(IntegerType())))


def decoded(rows: DataFrame, ranks: str, column: str = "ids", to: str = "text") -> DataFrame:
    """The columns of ``rows`` and the text of its ids; a null list gives a null text, bytes that are no UTF-8 the mark U+FFFD.

    An id that the vocabulary does not have is an error.
    """
    kept = [c for c in rows.columns if c != to]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(ranks)
        for batch in batches:
            lists = batch.column(column)
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            ends = np.cumsum(np.concatenate(([0], pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))))
            texts = [b"".join(decoded_parts(flat[a:b], words)[0]).decode(errors="replace") for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            made = pa.array(texts, pa.string(), mask=lists.is_null().to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), made], [*kept, to])

    chosen = rows.select(*(f"`{c}`" for c in kept))
    return chosen.mapInArrow(run, chosen.select("*").schema.add(to, "string"))


def _digest(parts: Sequence[bytes | memoryview]) -> str:
    h = hashlib.sha256()
    for p in parts:
        h.update(p)
    return h.hexdigest()


def measured(docs: DataFrame, ranks: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the ids in decimal, joined by commas), decoded_sha256 (of the decoded bytes) and
    round_trip: whether decoding gives whole characters and just the text. Encoding and decoding meet in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(ranks)
        for batch in batches:
            texts = B.as_strings(batch.column("text"))
            for lo, hi, ids, offsets in encode_texts(texts, ranks):
                wanted = pc.binary_length(texts.slice(lo, hi - lo)).to_pylist()
                spelt = memoryview(B.gathered(words.spelt, words.spelt_at[ids], words.spelt_at[ids + 1] - words.spelt_at[ids]))
                spelt_ends = np.concatenate(([0], np.cumsum(words.spelt_at[ids + 1] - words.spelt_at[ids])))[offsets].tolist()
                of_ids, of_text, same = [], [], []
                for n, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
                    of_ids.append(_digest([spelt[spelt_ends[n] : max(spelt_ends[n], spelt_ends[n + 1] - 1)]]))
                    parts, whole = decoded_parts(ids[a:b], words)
                    of_text.append(_digest(parts))
                    same.append(whole and sum(map(len, parts)) == wanted[n] and of_text[-1] == _digest([texts[lo + n].as_buffer()]))
                columns = [batch.column("doc_id").slice(lo, hi - lo), pa.array(np.diff(offsets)), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string()), pa.array(same, pa.bool_())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "round_trip"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, round_trip boolean")


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded by the transducer and decoded by the state machine.

    Null or empty text: no tokens, and digests of nothing. Null doc_id: kept. Repeated rows: a result each. An empty table gives no
    rows, and other columns do not matter. A text of any length is cut into pieces by the pattern; one unbroken piece of a
    million characters takes time in proportion to its length.
    """
    import public_tokenizers

    return measured(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
