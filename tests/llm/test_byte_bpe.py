"""Byte-level BPE by the transducer against the library, and decoding byte by byte."""

import hashlib
import random
import time

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

from idsieve.llm import byte_bpe, queries
from idsieve.llm import bytewords as B
from tests.llm.tables import documents
from tests.llm.test_tokens import ODD, noise

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={})


def ids_of(texts):
    return [ids[offsets[i] : offsets[i + 1]].tolist() for lo, hi, ids, offsets in byte_bpe.encode_texts(B.as_strings(pa.array(texts)), RANKS) for i in range(hi - lo)]


def test_ids_are_the_library_s(spark, small_dir, library, monkeypatch):
    monkeypatch.setattr(B, "CHUNK_BYTES", 5000)
    texts = ODD + noise(400, 2) + [r.text for r in spark.read.parquet(f"{small_dir}/documents.parquet").select("text").collect()]
    assert ids_of(texts) == [library.encode_ordinary(t) for t in texts]


def test_every_code_point(library):
    """Each character between a letter and a digit, and twice after a blank: classes of the pattern and bytes of all characters."""
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{c}1 {c}{c}" for c in points[lo : lo + 997]) for lo in range(0, len(points), 997)]
    wrong = [t for t, own in zip(texts, ids_of(texts), strict=True) if own != library.encode_ordinary(t)]
    assert not wrong


@pytest.mark.parametrize("limit", [7, 400_000])
def test_random_pieces_and_small_limits(library, monkeypatch, limit):
    """Bytes in any order, also when states are made anew all the time."""
    monkeypatch.setattr(byte_bpe, "MAX_TRANSITIONS", limit)
    monkeypatch.setattr(byte_bpe, "MAX_PAIRS", limit)
    t = byte_bpe.Transducer(byte_bpe.read_ranks(RANKS))
    r = random.Random(5)
    for _ in range(300):
        piece = bytes(r.choices(r.choice([b"aeinrst", b"abcdefghijklmnopqrstuvwxyz", bytes(range(256)), b" ", b"=-_", "äöüñéß".encode()]), k=r.randrange(1, 60)))
        assert t.ids(piece) == library._encode_single_piece(piece)


def test_random_vocabularies():
    """Vocabularies made by merging at random, with merges of merges: tokens equal those of plain merging."""
    r = random.Random(11)
    for _ in range(60):
        letters = [bytes([b]) for b in b"abc"]
        ranks = {bytes([b]): b for b in range(256)}
        parts = list(letters)
        while len(ranks) < 256 + r.randrange(2, 25):
            token = r.choice(parts) + r.choice(parts)
            if token not in ranks:
                ranks[token] = len(ranks)
                parts.append(token)
        try:
            t = byte_bpe.Transducer(ranks)
        except ValueError:
            continue  # ranks that no merging gives
        for _ in range(60):
            piece = bytes(r.choices(b"abc", k=r.randrange(1, 40)))
            assert t.ids(piece) == ([ranks[piece]] if piece in ranks else [ranks[p] for p in t.merge(piece)[0]]), (ranks, piece)


def test_tokens_are_emitted_early_and_in_linear_time():
    t = byte_bpe.vocabulary(RANKS).transducer
    state, held = 0, 0
    for byte in ("Donaudampfschifffahrtsgesellschaftskapitän" * 50).encode():
        key = state << 8 | byte
        state = (t.steps[key] if key in t.steps else t.step(state, byte)[1]) >> 1
        held = max(held, sum(len(t.token[i]) for i in t.states[state][1][-1][1]))
    assert held <= 3 * t.longest
    for text in ("a" * 1_000_000, "qxz" * 300_000, "ñ" * 400_000):
        began = time.time()
        ids = t.ids(text.encode())
        assert time.time() - began < 10 and b"".join(byte_bpe.vocabulary(RANKS).token[i] for i in ids) == text.encode()


def test_state_machine_is_utf8():
    """The states accept just what the codec does, over all two-byte beginnings and random bytes."""
    table = byte_bpe.utf8_states()

    def state(raw):
        s = 0
        for b in raw:
            s = table[s, b]
        return s

    r = random.Random(3)
    some = [bytes([a, b]) for a in range(256) for b in range(256)] + [bytes(r.choices([0x41, 0x80, 0x9F, 0xA0, 0xBF, 0xC2, 0xE0, 0xED, 0xEF, 0xF0, 0xF4, 0x8F, 0x90], k=r.randrange(1, 6))) for _ in range(20000)]
    for raw in some:
        try:
            raw.decode()
            want = 0
        except UnicodeDecodeError as e:
            want = 2 if e.reason == "unexpected end of data" else 1
        assert min(state(raw), 2) == want, raw


def test_decoding_piece_by_piece():
    """Characters come out as soon as they are whole, whatever the sizes of the parts fed."""
    words = byte_bpe.vocabulary(RANKS)
    text = "añ漢\U0001f600ß‰ x\U00010348"
    ids = np.array([words.transducer.ranks[bytes([b])] for b in text.encode()])  # a token for each byte
    for size in (1, 2, 3, 5, 100):
        decoder = byte_bpe.Decoder(words)
        parts = [decoder.feed(ids[lo : lo + size]) for lo in range(0, len(ids), size)]
        assert [p.decode() for p in parts] and b"".join(parts).decode() == text and decoder.finish() == b""
    parts, whole = byte_bpe.decoded_parts(ids[:2], words)
    assert (b"".join(parts), whole) == (text.encode()[:2], False)
    bad = np.array([words.transducer.ranks[bytes([b])] for b in b"a\xff\xc3b"])
    assert byte_bpe.decoded_parts(bad, words) == ([b"a\xff\xc3b", b""], False)
    with pytest.raises(ValueError):
        byte_bpe.decoded_parts(np.array([60_000]), words)


def test_query_against_the_library(spark, library, tmp_path):
    rows = [(1, "Das ist's  gut"), (1, "Das ist's  gut"), (2, None), (3, ""), (None, "x\n\n y"), (4, "ab " * 70_000), (5, "z" * 200_000), (6, "漢字\U0001f600 ñandú")]
    got = {}
    for row in queries.QUERIES["op13_byte_bpe"](spark, documents(spark, tmp_path, rows)).collect():
        got.setdefault(row.doc_id, []).append((row.n_tokens, row.ids_sha256, row.decoded_sha256, row.round_trip))
    want = {}
    for i, text in rows:
        ids = library.encode_ordinary(text or "")
        want.setdefault(i, []).append((len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest(), True))
    assert got == want
    assert queries.QUERIES["op13_byte_bpe"](spark, documents(spark, tmp_path / "none", [])).count() == 0


def test_columns_are_kept(spark):
    docs = spark.createDataFrame([(1, "a ñ", "own"), (2, None, None)], "doc_id long, text string, ids string")
    there = byte_bpe.encoded(docs, RANKS)
    assert there.columns == ["doc_id", "text", "ids"]
    back = byte_bpe.decoded(there.withColumnRenamed("text", "was"), RANKS)
    assert [(r.was, r.text) for r in back.orderBy("doc_id").collect()] == [("a ñ", "a ñ"), (None, "")]
    odd = spark.createDataFrame([(None,), ([195],)], "ids array<int>")
    assert [r.text for r in byte_bpe.decoded(odd, RANKS).collect()][0] is None
