"""SentencePiece encoding and decoding with shared prefixes.

A text is cut at marked words, a run of word marks (blanks) and what follows up to the next one, and within
them where two characters meet that stand side by side in no piece. Nothing is merged over such a cut, so
each distinct word is encoded once. The distinct words of a block are sorted, so that those with a shared prefix
are neighbours and every distinct prefix is one node of their trie. The trie is walked level by level, all nodes of a
level at once in arrays: pieces that end at a node are found by its characters backwards, and the forward states of a
level follow from those of the levels before. Levels that few words reach are not worth that: such words are walked
one after the other, depth first, and keep the forward states of the prefix shared with the word before.

The forward state of a prefix is the best last piece (Viterbi) by the best sum of scores, as the library
encodes with a unigram model. A model of merges comes with scores too, but its own ids follow from merging;
``encode_words`` gives both. For merging, a piece may follow the prefix before it only if the pair of pieces is
what merging makes of their joint characters; exactly one piece per prefix can, so the walk gives the merges'
result.

Vocabularies come from the model file; nothing is trained. Models must keep texts as they are (identity
normalisation), mark a beginning, and have byte pieces for unknown characters.
"""

from __future__ import annotations

import functools
import itertools
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from . import bytewords as B

MARK = "▁"
UNIGRAM, MERGES = 1, 2
MAX_PAIRS = 150_000  # pairs of pieces that are remembered
PAIR_SLOTS = 1 << 19  # slots for pairs of pieces that the walk by levels remembers
BLOCK_CHARS = 1 << 18  # characters of words that are walked together
FEW = 32  # words by which a level must be reached


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(raw):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(key & 7) or varint()
            yield key >> 3, raw[at : at + size]
            at += size


class Model:
    """Pieces of a SentencePiece model file, and the encoding of marked words."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        parts = dict(_fields(model.serialized_model_proto()))
        trainer, normal = dict(_fields(parts[2])), dict(_fields(parts[3]))
        self.kind = trainer.get(3, UNIGRAM)
        if self.kind not in (UNIGRAM, MERGES) or normal.get(2) or normal.get(4, 1) or not normal.get(3, 1) or not trainer.get(35, 0) or trainer.get(24, 0):
            raise ValueError("only unigram and merge models that keep texts as they are, with byte pieces, are supported")
        size = model.get_piece_size()
        self.bytes = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)])
        special = {i for i in range(size) if model.is_control(i) or model.is_unknown(i) or model.is_byte(i)}
        self.pieces = [model.id_to_piece(i) for i in range(size)]
        self.ids = {p: i for i, p in enumerate(self.pieces) if i not in special}
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece has a mark after other characters")
        self.score = [model.get_score(i) for i in range(size)]

        self.unknown_score = min(self.score[i] for i in self.ids.values()) - 10.0
        #: Whether two bytes may stand side by side in a piece; where they don't, nothing is ever merged. Bytes beyond ASCII may.
        self.joint = np.zeros((256, 256), bool)
        self.joint[128:] = self.joint[:, 128:] = True
        for p in self.ids:
            raw = np.frombuffer(p.replace(MARK, " ").encode(), np.uint8)
            self.joint[raw[:-1], raw[1:]] = True
        self.rank = {p: -self.score[i] if len(p) > 1 else -math.inf for p, i in self.ids.items()}
        self.halves: dict[str, tuple[str, str]] = {}
        self.whole = {p for p in self.ids if len(p) == 1}
        if self.kind == MERGES:
            for p in self.ids:
                if len(p) > 1:
                    parts, last = self.merge(p)
                    if parts == [p]:
                        self.whole.add(p)
                        self.halves[p] = last
        self.ends = self.by_ends()
        self.known: dict[tuple[str, str], bool] = {}
        byte_of = np.full(size, -1)
        byte_of[self.bytes] = np.arange(256)
        self.decoded = [b"" if i in special and byte_of[i] < 0 else bytes([byte_of[i]]) if byte_of[i] >= 0 else p.replace(MARK, " ").encode() for i, p in enumerate(self.pieces)]

    def by_ends(self) -> dict:
        """A trie of the pieces from their last character to their first: by character, (what goes before, id of the piece up
        to here or -1, whether merging can give it)."""
        root: dict = {}
        for p in {*self.ids, *self.whole}:
            node = root
            for c in reversed(p):
                if c not in node:
                    node[c] = [{}, -1, False]
                last, node = node[c], node[c][0]
            last[1:] = self.ids.get(p, -1), p in self.whole
        return root

    def merge(self, text: str) -> tuple[list[str], tuple[str, str] | None]:
        """Merge neighbours, best score first and leftmost among equals, as long as they form a piece; and the last two merged."""
        parts, last = list(text), None
        while True:
            best = None
            for n in range(len(parts) - 1):
                i = self.ids.get(parts[n] + parts[n + 1])
                if i is not None and (best is None or self.score[i] > best[0]):
                    best = self.score[i], n
            if best is None:
                return parts, last
            n = best[1]
            last = parts[n], parts[n + 1]
            parts[n : n + 2] = [parts[n] + parts[n + 1]]

    def follows(self, left: str, right: str) -> bool:
        """Whether merging their joint characters gives just these two.

        The merges that made the two are undone, the later one first. At each point the pieces that meet
        in the middle must not form one that would have come before the merges undone so far; at the same
        rank the leftmost comes first.
        """
        rank, limit, equal = self.rank, math.inf, False
        while True:
            joint = rank.get(left + right)
            if joint is not None and (joint < limit or (equal and joint == limit)):
                return False
            a, b = rank.get(left, -math.inf), rank.get(right, -math.inf)
            if a > b:
                limit, equal, left = a, False, self.halves[left][1]
            elif b == -math.inf:
                return True
            else:
                limit, equal, right = b, True, self.halves[right][0]

    @functools.cached_property
    def tables(self) -> Tables:
        return Tables(self)

    def encode_words(self, words: list[str], *kinds: int) -> list[list[list[int]]]:
        """For each kind, by merges (MERGES) or sums of scores (UNIGRAM), the ids of all marked words."""
        made = [(flat.tolist(), np.concatenate(([0], np.cumsum(sizes))).tolist()) for flat, sizes in self.ids_of_words(words, *kinds)]
        return [[flat[a:b] for a, b in itertools.pairwise(at)] for flat, at in made]

    def ids_of_words(self, words: list[str], *kinds: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each kind the ids of all marked words, one after the other, and how many each word has. Of paths with equal
        sums the one whose last piece is longer counts."""
        if MERGES in kinds and self.kind != MERGES:
            raise ValueError("only a model of merges tells how to merge")
        order = np.array(sorted(range(len(words)), key=words.__getitem__), np.int64)
        sizes = np.fromiter(map(len, words), np.int64, len(words))[order]
        block = np.cumsum(sizes) // BLOCK_CHARS
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(block)) + 1, [len(words)])).tolist()
        which, parts = [order[:0]], [[(np.zeros(0, np.int64), np.zeros(0, np.int64))] for _ in kinds]
        for lo, hi in itertools.pairwise(cuts):
            limit = np.partition(sizes[lo:hi], -FEW)[-FEW] if hi - lo >= FEW else 0
            for long in (False, True):
                own = order[lo:hi][(sizes[lo:hi] > limit) == long]
                if len(own):
                    which.append(own)
                    walk = self.walk_words if long else self.tables.walk_levels
                    for part, ids in zip(parts, walk([words[i] for i in own.tolist()], *kinds), strict=True):
                        part.append(ids)
        at = np.argsort(np.concatenate(which))
        made = []
        for part in parts:
            flat, own = np.concatenate([ids for ids, _ in part]), np.concatenate([n for _, n in part])
            made.append((B.gathered(flat, (np.cumsum(own) - own)[at], own[at]), own[at]))
        return made

    def walk_words(self, words: list[str], *kinds: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """``ids_of_words`` of words in sorted order, one after the other; states of shared prefixes stay."""
        made: dict[int, list[list[int]]] = {k: [] for k in kinds}
        merging, scoring = MERGES in kinds, UNIGRAM in kinds
        ids, score, unknown, root, follows, known = self.ids, self.score, self.unknown_score, self.ends, self.follows, self.known
        merged: list[str] = [""]  # last piece of each prefix of the current word, by merging
        found: list[str] = [""]  # and by the best sum of scores, which follows
        best: list[float] = [0.0]
        before = ""
        for word in words:
            shared = 0
            for a, b in zip(before, word, strict=False):
                if a != b:
                    break
                shared += 1
            del merged[shared + 1 :], found[shared + 1 :], best[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                piece, first = word[end - 1], end - 1
                most = -math.inf if piece in ids else best[first] + unknown if scoring else 0.0
                ends, start, node = [], end, root
                while start:
                    start -= 1
                    step = node.get(word[start])
                    if step is None:
                        break
                    node, i, whole = step
                    if i >= 0 and scoring:
                        s = best[start] + score[i]
                        if s >= most:
                            first, most = start, s
                    if whole and merging:
                        ends.append(start)
                if scoring:
                    found.append(word[first:end])
                    best.append(most)
                if merging:
                    for start in reversed(ends):
                        own = word[start:end]
                        if start == 0:
                            piece = own
                            break
                        pair = merged[start], own
                        fits = known.get(pair)
                        if fits is None:
                            if len(known) >= MAX_PAIRS:
                                known.clear()
                            fits = known[pair] = follows(*pair)
                        if fits:
                            piece = own
                            break
                    merged.append(piece)
            before = word
            for kind in kinds:
                last_of = merged if kind == MERGES else found
                got: list[int] = []
                end = len(word)
                while end:
                    piece = last_of[end]
                    i = ids.get(piece)
                    if i is None:
                        got.extend(self.bytes[list(reversed(piece.encode()))].tolist())
                    else:
                        got.append(i)
                    end -= len(piece)
                got.reverse()
                made[kind].append(got)
        return [(np.array([i for ids in made[k] for i in ids], np.int64), np.array([len(ids) for ids in made[k]], np.int64)) for k in kinds]


class Tables:
    """Pieces of a model in arrays, and the walk through a trie of words by levels.

    A symbol is the id of a piece, or else the number of pieces and the code of a character that is none; characters of no piece
    have code 0.
    """

    def __init__(self, model: Model):
        self.model, self.size = model, len(model.pieces)
        chars = sorted({c for p in model.ids for c in p})
        self.code = np.zeros(0x110000, np.int32)
        self.code[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.codes = len(chars) + 1
        self.symbols = self.size + self.codes
        symbol = model.ids | {c: self.size + n for n, c in enumerate(chars, 1) if c not in model.ids}
        self.single = np.array([self.size, *(symbol[c] for c in chars)])
        self.score = np.array(model.score)
        self.whole = np.zeros(self.size, bool)
        self.whole[[model.ids[p] for p in model.whole]] = True
        self.trie(model.ends)
        if model.kind == MERGES:
            self.rank = np.full(self.symbols, -np.inf)
            self.left, self.right = np.zeros((2, self.symbols), np.int64)
            for p, rank in model.rank.items():
                self.rank[symbol[p]] = rank
            for p, (a, b) in model.halves.items():
                self.left[symbol[p]], self.right[symbol[p]] = symbol[a], symbol[b]
            joint = {symbol[p[:n]] * self.symbols + symbol[p[n:]]: r for p, r in model.rank.items() for n in range(1, len(p)) if p[:n] in symbol and p[n:] in symbol}
            joint[-1] = math.inf
            self.joint = np.array(sorted(joint))
            self.joint_rank = np.array([joint[k] for k in self.joint.tolist()])
            self.pairs, self.fits = np.full(PAIR_SLOTS, -1), np.zeros(PAIR_SLOTS, bool)

    def trie(self, ends: dict) -> None:
        """Numbers for the nodes of a trie of the pieces from their ends, the root 0: sorted keys (node, code) with the nodes
        they lead to, and of each node the id of the piece up to it or -1."""
        keys, below, self.piece, todo = [], [], [-1], [(0, ends)]
        while todo:
            node, children = todo.pop()
            for c, (further, i, _) in children.items():
                keys.append(node * self.codes + int(self.code[ord(c)]))
                below.append(len(self.piece))
                todo.append((len(self.piece), further))
                self.piece.append(i)
        order = np.argsort(keys)
        self.keys, self.below, self.piece = np.array(keys)[order], np.array(below)[order], np.array(self.piece)
        self.inner = np.zeros(len(self.piece), bool)
        self.inner[self.keys // self.codes] = True

    def follow(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """``Model.follows`` of pairs of symbols."""
        out, todo = np.ones(len(left), bool), np.arange(len(left))
        limit, equal = np.full(len(left), np.inf), np.zeros(len(left), bool)
        while len(todo):
            pair = left * self.symbols + right
            at = np.searchsorted(self.joint, pair, side="right") - 1
            joint = np.where(self.joint[at] == pair, self.joint_rank[at], np.inf)
            before = (joint < limit) | (equal & (joint == limit))
            out[todo[before]] = False
            a, b = self.rank[left], self.rank[right]
            over = a > b
            further = ~before & (over | (b > -np.inf))
            limit, equal = np.where(over, a, b)[further], ~over[further]
            left, right, todo = np.where(over, self.right[left], left)[further], np.where(over, right, self.left[right])[further], todo[further]
        return out

    def pair_fits(self, pair: np.ndarray) -> np.ndarray:
        """``follow`` of pairs, left * symbols + right, of which those met last are remembered."""
        slot = ((pair.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.int64) & (PAIR_SLOTS - 1)
        out = self.fits[slot]
        new = np.flatnonzero(self.pairs[slot] != pair)
        if len(new):
            unique, first, back = np.unique(pair[new], return_index=True, return_inverse=True)
            fits = self.follow(unique // self.symbols, unique % self.symbols)
            out[new] = fits[back]
            put, of = np.unique(slot[new[first]], return_index=True)
            self.pairs[put], self.fits[put] = unique[of], fits[of]
        return out

    def levels(self, codes: np.ndarray, begin: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
        """Nodes of the trie of sorted words, the root 0 first, level by level: each one's parent and code; the last node of each word;
        and the first node of each level and the end."""
        last = np.zeros(len(sizes), np.int64)
        parents, own, first = [np.zeros(1, np.int64)], [np.zeros(1, codes.dtype)], [0, 1]
        words, depth = np.flatnonzero(sizes), 0
        while len(words):
            code, parent = codes[begin[words] + depth], last[words]
            new = np.ones(len(words), bool)
            new[1:] = (code[1:] != code[:-1]) | (parent[1:] != parent[:-1])
            last[words] = first[-1] - 1 + np.cumsum(new)
            parents.append(parent[new])
            own.append(code[new])
            first.append(first[-1] + len(parents[-1]))
            depth += 1
            words = words[sizes[words] > depth]
        return np.concatenate(parents), np.concatenate(own), last, first

    def matches(self, parent: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(node, node before the piece, id) of all pieces that end at a node, by node and from short to long."""
        end = cur = np.arange(1, len(parent))
        at = np.zeros(len(end), np.int64)
        found = [(end[:0], end[:0], end[:0])]
        while len(end):
            key = at * self.codes + code[cur]
            n = np.searchsorted(self.keys, key, side="right") - 1
            there = np.flatnonzero(self.keys[n] == key)
            end, cur, at = end[there], parent[cur[there]], self.below[n[there]]
            is_piece = self.piece[at] >= 0
            found.append((end[is_piece], cur[is_piece], self.piece[at[is_piece]]))
            further = np.flatnonzero((cur > 0) & self.inner[at])
            end, cur, at = end[further], cur[further], at[further]
        end, start, piece = map(np.concatenate, zip(*found, strict=True))
        order = np.argsort(end, kind="stable")
        return end[order], start[order], piece[order]

    def walk_levels(self, words: list[str], *kinds: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """``Model.ids_of_words`` of words in sorted order."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        begin = np.cumsum(sizes) - sizes
        parent, code, word_at, first = self.levels(self.code[points], begin, sizes)
        end, start, piece = self.matches(parent, code)
        depth = np.repeat(np.arange(len(first) - 1), np.diff(first))
        made = []
        for kind in kinds:
            symbol, back = self.single[code], parent.copy()
            if kind == MERGES:
                self.by_merges(first, *(x[self.whole[piece]] for x in (end, start, piece)), symbol, back)
            else:
                self.by_scores(first, end, start, piece, symbol, back)
            made.append(self.traced(points, begin, word_at, symbol, back, depth))
        return made

    def by_merges(self, first: list[int], end: np.ndarray, start: np.ndarray, piece: np.ndarray, symbol: np.ndarray, back: np.ndarray) -> None:
        """Put each node's last piece by merging into ``symbol``, and the node before it into ``back``."""
        for lo, hi in itertools.pairwise(np.searchsorted(end, first[1:]).tolist()):
            at, own = start[lo:hi], piece[lo:hi]
            fits = at == 0
            inner = np.flatnonzero(~fits)
            fits[inner] = self.pair_fits(symbol[at[inner]] * self.symbols + own[inner])
            to = end[lo:hi][fits]
            symbol[to], back[to] = own[fits], at[fits]  # of several the longest, which comes last

    def by_scores(self, first: list[int], end: np.ndarray, start: np.ndarray, piece: np.ndarray, symbol: np.ndarray, back: np.ndarray) -> None:
        """The same by the best sum of scores."""
        score, best = self.score[piece], np.full(len(symbol), -np.inf)
        best[0] = 0.0
        unknown = np.flatnonzero(symbol >= self.size)
        unknown = unknown[unknown > 0]
        groups = np.flatnonzero(np.diff(end, prepend=0))
        cuts = zip(*(itertools.pairwise(np.searchsorted(x, first[1:]).tolist()) for x in (end, end[groups], unknown)), strict=True)
        for (lo, hi), (a, b), (c, d) in cuts:
            best[unknown[c:d]] = best[back[unknown[c:d]]] + self.model.unknown_score
            if lo < hi:
                sums, to = best[start[lo:hi]] + score[lo:hi], end[lo:hi]
                of = end[groups[a:b]]
                best[of] = np.maximum(best[of], np.maximum.reduceat(sums, groups[a:b] - lo))
                top = sums >= best[to]
                symbol[to[top]], back[to[top]] = piece[lo:hi][top], start[lo:hi][top]  # of several the longest, which comes last

    def traced(self, points: np.ndarray, begin: np.ndarray, word_at: np.ndarray, symbol: np.ndarray, back: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the paths that end at the words' last nodes, and how many each word has."""
        word = np.flatnonzero(word_at)
        cur, steps = word_at[word], []
        while len(word):
            steps.append((word, cur))
            cur = back[cur]
            word, cur = word[cur > 0], cur[cur > 0]
        count = np.bincount(np.concatenate([w for w, _ in steps]), minlength=len(word_at)) if steps else np.zeros(len(word_at), np.int64)
        ends = np.cumsum(count)
        node = np.zeros(count.sum(), np.int64)
        for n, (w, c) in enumerate(steps):
            node[ends[w] - 1 - n] = c
        ids = symbol[node]
        unknown = np.flatnonzero(ids >= self.size)
        if len(unknown):
            word = np.searchsorted(ends, unknown, side="right")
            chars = points[begin[word] + depth[node[unknown]] - 1]
            width = np.ones(len(ids), np.int64)
            width[unknown] = 1 + (chars >= 0x80).astype(np.int64) + (chars >= 0x800) + (chars >= 0x10000)
            count = np.diff(np.concatenate(([0], np.cumsum(width)))[np.concatenate(([0], ends))])
            ids, as_bytes = np.repeat(ids, width), np.repeat(ids >= self.size, width)
            ids[as_bytes] = self.model.bytes[np.frombuffer(chars.tobytes().decode("utf-32-le").encode(), np.uint8)]
        return ids, count


@functools.lru_cache(2)
def _model(path: str) -> tuple[Model, np.ndarray, np.ndarray]:
    model = Model(path)
    sizes = np.array([len(d) for d in model.decoded])
    return model, np.frombuffer(b"".join(model.decoded), np.uint8), np.concatenate(([0], np.cumsum(sizes)))


@functools.lru_cache(2)
def _cache(path: str, *kinds: int) -> B.PieceCache:
    """The ids of a word by each kind, one after the other, after the numbers of ids of all kinds but the last."""
    model = _model(path)[0]

    def encode(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        by = model.ids_of_words([w.decode().replace(" ", MARK) for w in words], *kinds)
        parts = [np.ones(len(words), np.int64)] * (len(kinds) - 1) + [n for _, n in by]
        flat = np.concatenate([*(n for _, n in by[:-1]), *(ids for ids, _ in by)])
        lengths = np.concatenate(parts)
        begin, order = np.cumsum(lengths) - lengths, np.arange(len(lengths)).reshape(len(parts), -1).T.ravel()
        return B.gathered(flat, begin[order], lengths[order]), sum(parts)

    return B.PieceCache(encode, slots=1 << 20, ids=4_000_000)


def encode_texts(texts: pa.LargeStringArray, path: str, *kinds: int) -> Iterator[tuple[int, int, list[tuple[np.ndarray, np.ndarray]]]]:
    """(first text, end, for each kind of encoding all ids and the offsets of the texts in them); by default of the model's own
    kind. Marks in a text count as blanks."""
    model = _model(path)[0]
    kinds = kinds or (model.kind,)
    cache = _cache(path, *kinds)
    texts = pc.replace_substring(texts, MARK, " ")
    texts = pc.if_else(pc.equal(texts, ""), "", pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), texts, pa.scalar("", pa.large_string())))
    for lo, hi, data, offsets in B.chunked(texts):
        start = np.zeros(len(data), bool)
        start[1:] = ~model.joint[data[:-1], data[1:]]
        start[offsets[:-1][np.diff(offsets) > 0]] = True
        starts = np.flatnonzero(start)
        flat, sizes = cache.ids(data, starts, np.append(starts[1:], len(data)).astype(np.int64))
        at, made = np.cumsum(sizes, dtype=np.int64) - sizes, []
        texts_at = np.searchsorted(starts, offsets)
        lengths = [flat[at + k].astype(np.int64) for k in range(len(kinds) - 1)]
        at, rest = at + len(kinds) - 1, sizes - (len(kinds) - 1)
        for n in [*lengths, rest - sum(lengths)]:
            made.append((B.gathered(flat, at, n) if len(kinds) > 1 else flat, np.concatenate(([0], np.cumsum(n, dtype=np.int64)))[texts_at]))
            at = at + n
        yield lo, hi, made


def sums_of_scores(ids: np.ndarray, offsets: np.ndarray, path: str) -> np.ndarray:
    """The sum of scores of each list of ids; an unknown character has one score for all its bytes."""
    model = _model(path)[0]
    score = np.array(model.score)
    score[model.bytes] = 0.0
    score[np.concatenate((model.bytes[:128], model.bytes[192:]))] = model.unknown_score
    return np.diff(np.concatenate(([0.0], np.cumsum(score[ids])))[offsets])


def decode_ids(ids: np.ndarray, offsets: np.ndarray, path: str) -> list[bytes]:
    """UTF-8 of each list of ids: pieces joined, marks as blanks, without the one that marks the beginning."""
    _, flat, at = _model(path)
    data = B.gathered(flat, at[ids], at[ids + 1] - at[ids]).tobytes()
    ends = np.concatenate(([0], np.cumsum(at[ids + 1] - at[ids])))[offsets]
    return [data[a + 1 : b] if data[a : a + 1] == b" " else data[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def encoded(docs: DataFrame, model: str, column: str = "ids") -> DataFrame:
    """The columns of ``docs`` and the ids of the whole text, in place of a column so named. A null text has none."""
    kept = [c for c in docs.columns if c != column]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, [(ids, offsets)] in encode_texts(B.as_strings(batch.column("text")), model):
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(lo, hi - lo) for c in kept), B.lists(ids, offsets)], [*kept, column])

    rows = docs.select(*(f"`{c}`" for c in kept))
    return rows.mapInArrow(run, rows.select("*").schema.add(column, ArrayType(IntegerType())))


def decoded(rows: DataFrame, model: str, column: str = "ids", to: str = "text") -> DataFrame:
    """The columns of ``rows`` and the text of its ids; a null list gives a null text, bytes that are no UTF-8 the mark U+FFFD."""
    kept = [c for c in rows.columns if c != to]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(column)
            flat = lists.flatten()
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            texts = decode_ids(flat.to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(sizes))), model)
            made = pa.array([t.decode(errors="replace") for t in texts], pa.string(), mask=lists.is_null().to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), made], [*kept, to])

    return rows.select(*kept).mapInArrow(run, rows.select(*kept).schema.add(to, "string"))


def measured(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_chars, n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit integers), best_tokens, best_crc32 and
    best_score (of the path with the best sum of scores), and round_trip: whether decoding either gives the text back.

    Encoding and decoding meet in one pass, so ids aren't moved about.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = B.as_strings(batch.column("text"))
            n_chars = pc.utf8_length(texts)
            want = pc.replace_substring(texts, MARK, " ")
            for lo, hi, both in encode_texts(texts, model, MERGES, UNIGRAM):
                wanted = [x.encode() for x in want.slice(lo, hi - lo).to_pylist()]
                same, columns = np.ones(hi - lo, bool), [batch.column("doc_id").slice(lo, hi - lo), n_chars.slice(lo, hi - lo).cast(pa.int64())]
                for ids, offsets in both:
                    same &= np.array([a == b for a, b in zip(decode_ids(ids, offsets, model), wanted, strict=True)], bool)
                    raw = memoryview(ids.astype("<u4")).cast("B")
                    crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                    columns += [pa.array(np.diff(offsets)), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(sums_of_scores(*both[1], model)), pa.array(same)], names)

    names = ["doc_id", "n_chars", "n_tokens", "ids_crc32", "best_tokens", "best_crc32", "best_score", "round_trip"]
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, n_chars long, n_tokens long, ids_crc32 long, best_tokens long, best_crc32 long, best_score double, round_trip boolean")


def op4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number and checksum of every document's ids, by merges and by the best sum of scores, and whether decoding gives its text back.

    Null text: no ids. Repeated rows: a result each. An empty table gives no rows. A text with the mark
    character itself comes back with blanks instead, and is compared so.
    """
    import public_tokenizers

    return measured(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))
