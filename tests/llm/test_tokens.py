"""Token ids: both encoders against their libraries, ORC files read back, decoding."""

import random
import sys
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.orc
import pytest
import sentencepiece
import tokenizers
from pyspark.sql import functions as F

from idsieve.llm import bytewords as B
from idsieve.llm import pieces, token_orc
from tests.llm.tables import documents

BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = ["it's 's's''s x'll don'T", "  a  b \n\n c\t\td   e", "x　y  ", "   ", "", "12ab 3 ½Ⅷ", "<|endoftext|> <s> <0x41>", "éÀ'sà", "\n\n a", "a \n", "a​b\x1c c", "'", "aaaa" * 40, "日本語 漢字 \U0001f600", "▁x ▁", "if (x==1) {\n\t\treturn;\n        }", "\x00\x01", "=====----....", " " * 41 + "b", "1234567890 3.14159"]


def noise(n, seed):
    r = random.Random(seed)
    parts = ["the", " ", "  ", "\n", "er", "ing", "É", "ß", "1", "42", ".", "'", "s", "'re", "x", "Qu", "_", "—", "é", "\t", "ll", "\U0001f600", "字"]
    return ["".join(r.choice(parts) for _ in range(r.randrange(60))) for _ in range(n)]


@pytest.fixture(scope="module")
def texts(spark, small_dir):
    return ODD + noise(300, 1) + [r.text for r in spark.read.parquet(f"{small_dir}/documents.parquet").select("text").collect()]


def split(parts):
    return [ids[offsets[i] : offsets[i + 1]].tolist() for lo, hi, ids, offsets in parts for i in range(hi - lo)]


def bpe(texts):
    model = tokenizers.Tokenizer.from_file(BPE)
    model.encode_special_tokens = True
    return [e.ids + [0] for e in model.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_byte_level_ids_are_the_library_s(texts, monkeypatch):
    monkeypatch.setattr(B, "CHUNK_BYTES", 5000)
    assert split(token_orc.encode_texts(B.as_strings(pa.array(texts)), BPE)) == bpe(texts)


def test_piece_ids_are_the_library_s(texts):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    assert split_pieces(texts) == model.encode(texts)


def split_pieces(texts, *kinds):
    return split((lo, hi, *made[0]) for lo, hi, made in pieces.encode_texts(B.as_strings(pa.array(texts)), PIECES, *kinds))


def test_best_paths_are_the_library_s(texts):
    """The library, told that the same pieces and scores are a unigram model, finds paths with the same sums of scores."""
    raw = sentencepiece.SentencePieceProcessor(model_file=PIECES).serialized_model_proto()
    trainer = dict(pieces._fields(raw))[2]
    kind = trainer.index(bytes([3 << 3, pieces.MERGES]))
    assert trainer.count(bytes([3 << 3, pieces.MERGES])) == 1
    unigram = trainer[:kind] + bytes([3 << 3, pieces.UNIGRAM]) + trainer[kind + 2 :]
    assert raw.count(trainer) == 1
    library = sentencepiece.SentencePieceProcessor(model_proto=raw.replace(trainer, unigram))
    own = sorted({w for t in texts for w in t.split() if len(w) < 20})[:4000]
    # of several paths the library searches its whole lattice; for a single one it takes a shortcut that misses better ones
    want, have = [library.nbest_encode_as_ids(w, 2)[0] for w in own], split_pieces(own, pieces.UNIGRAM)
    sums = lambda lists: pieces.sums_of_scores(np.concatenate([np.array(x, np.int64) for x in lists]), np.cumsum([0, *map(len, lists)]), PIECES)
    more = sums(have) - sums(want)  # the library adds up in single precision
    assert len(own) > 2000 and (more >= -1e-2).all() and (more <= 1e-2 - 1e-6 * sums(want)).all()
    assert sum(a == b for a, b in zip(want, have, strict=True)) > 0.9 * len(own)  # others are of equal sums
    assert [library.decode(x) for x in have] == [w.replace("▁", " ") for w in own]


def test_cached_ids_count_for_the_same_bytes_only(monkeypatch):
    """With hashes that collide all the time, ids are those of each token."""
    cache = B.PieceCache(lambda words: [np.frombuffer(w, np.uint8).astype(np.int32) for w in words], slots=4)
    monkeypatch.setattr(B, "span_hashes", lambda data, starts, ends: (ends - starts).astype(np.uint64))
    for word in (b"ab", b"cd", b"ab", b"xyz", b"cd", b"ab"):
        ids, sizes = cache.ids(np.frombuffer(word, np.uint8), np.array([0]), np.array([len(word)]))
        assert ids.tolist() == list(word) and sizes.tolist() == [len(word)]


def test_every_piece_follows_as_merging_says():
    model = pieces._model(PIECES)[0]
    r = random.Random(4)
    whole = sorted(model.whole)
    for _ in range(4000):
        a, b = r.choice(whole), r.choice(whole)
        assert model.follows(a, b) == (model.merge(a + b)[0] == [a, b]), (a, b)


def test_unigram_walk_finds_the_best_path(monkeypatch):
    model = pieces.Model.__new__(pieces.Model)
    words = {"a": -1.0, "b": -1.5, "ab": -2.2, "aba": -2.6, "bab": -4.0, "▁": -1.0, "▁a": -1.2}
    model.kind, model.pieces, model.ids = pieces.UNIGRAM, list(words), {p: i for i, p in enumerate(words)}
    model.score, model.unknown_score, model.bytes = list(words.values()), -20.0, np.arange(100, 356)
    model.known, model.whole = {}, set()
    model.ends = model.by_ends()

    def best(word):
        if not word:
            return 0.0
        return max(words[word[:n]] + best(word[n:]) for n in range(1, len(word) + 1) if word[:n] in words)

    own = ["▁" + "".join(x) for n in range(1, 7) for x in __import__("itertools").product("ab", repeat=n)]
    for word, ids in zip(own, model.encode_words(own, pieces.UNIGRAM)[0], strict=True):
        assert "".join(model.pieces[i] for i in ids) == word
        assert abs(sum(model.score[i] for i in ids) - best(word)) < 1e-9


def test_many_words_are_walked_level_by_level(monkeypatch):
    """Many distinct words cost few steps of the interpreter each (9.9; 318 when every character was a step); ids are those of words walked one by one."""
    model, kinds = pieces._model(PIECES)[0], (pieces.MERGES, pieces.UNIGRAM)
    r = random.Random(5)
    parts = ["and", "on", "th", "a", "é", "ß", "字", "\n", "\x00", "\U0001f600", "▁", "tion", "er"]
    words = list({"▁" + "".join(r.choice(parts) for _ in range(r.randrange(9))) for _ in range(6000)}) + ["", "a", "ab" * 3000, "ba" * 20, "a"]
    model.encode_words(words[:100], *kinds)  # what is made once
    lines = 0

    def count(frame, event, arg):
        nonlocal lines
        if frame.f_code.co_filename != pieces.__file__:
            return None
        lines += event == "line"
        return count

    before = sys.gettrace()
    sys.settrace(count)
    try:
        got = model.encode_words([w for w in words if len(w) < 30], *kinds)
    finally:
        sys.settrace(before)
    assert lines < 20 * len(words)
    assert [len(x) for x in got] == [sum(len(w) < 30 for w in words)] * 2
    levels = model.encode_words(words, *kinds)
    for size in (3, 2000):  # blocks that end between neighbours, and words that are too few for a level
        monkeypatch.setattr(pieces, "BLOCK_CHARS", size)
        assert model.encode_words(words, *kinds) == levels
    monkeypatch.setattr(pieces, "FEW", len(words) + 1)
    assert model.encode_words(words, *kinds) == levels
    assert all(model.encode_words([w], *kinds) == [[levels[0][n]], [levels[1][n]]] for n, w in enumerate(words[:300]))


ROWS = [(5, "five"), (1, "one two"), (None, "no id"), (3, None), (2, ""), (5, "five"), (5, "another five"), (4, "x " * 30000)]


def test_orc_files(spark, tmp_path):
    docs = spark.read.parquet(documents(spark, tmp_path, ROWS) + "/documents.parquet")
    to = str(tmp_path / "orc")
    token_orc.write_tokens(docs, to, BPE)
    back = token_orc.read_tokens(spark, to).collect()
    assert sorted((str(r.doc_id), list(r.ids)) for r in back) == sorted((str(i), ids) for (i, _), ids in zip(ROWS, bpe([t for _, t in ROWS]), strict=True))
    assert [list(r.ids) for r in token_orc.lookup(spark, to, [4]).collect()] == bpe([ROWS[-1][1]])
    last = None
    for f in sorted((tmp_path / "orc").glob("*.orc")):
        file = pyarrow.orc.ORCFile(str(f))
        ids = [x if x is not None else -1 for x in file.read(columns=["doc_id"])["doc_id"].to_pylist()]
        assert ids == sorted(ids) and (last is None or not ids or ids[0] >= last)
        last = ids[-1] if ids else last
        assert file.row_index_stride == token_orc.INDEX_STRIDE


def test_token_index(spark, tmp_path):
    check_index(token_orc.op7_token_orc(spark, documents(spark, tmp_path, ROWS)).collect(), ROWS)
    assert token_orc.op7_token_orc(spark, documents(spark, tmp_path, [])).collect() == []


def check_index(got, rows):
    """Every document's ids, one after the other in the order of doc_ids, those without first."""
    key = lambda i: (i is not None, i or 0)
    got = sorted(got, key=lambda r: r.start)
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)])[:-1].tolist()
    assert [key(r.doc_id) for r in got] == sorted(key(i) for i, _ in rows)
    want = [(i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for (i, _), x in zip(rows, bpe([t for _, t in rows]), strict=True)]
    assert sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in got), key=str) == sorted(want, key=str)


def test_one_id_over_several_files(spark, tmp_path):
    rows = [(None, f"text {n % 3}") for n in range(300)] + [(7, "seven")] * 300 + [(n, f"text {n}") for n in range(50)]
    docs = spark.read.parquet(documents(spark, tmp_path, rows) + "/documents.parquet")
    to = str(tmp_path / "orc")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else these few rows are one file
    try:
        token_orc.write_tokens(docs, to, BPE)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = [pyarrow.orc.ORCFile(str(f)).nrows for f in (tmp_path / "orc").glob("*.orc")]
    assert len(sizes) >= 4 and max(sizes) < 300
    check_index(token_orc.token_index(spark, to).collect(), rows)


def test_lookups_skip_stripes_and_row_groups(spark, tmp_path):
    docs = spark.range(0, 40_000, 2).select(F.col("id").alias("doc_id"), F.concat(F.lit("some text "), F.col("id")).alias("text")).repartition(3)
    to = str(tmp_path / "orc")
    token_orc.write_tokens(docs, to, BPE)

    def rows_read(found):
        found.collect()
        scan = found._jdf.queryExecution().executedPlan().collectLeaves().head()
        return scan.metrics().apply("numOutputRows").value()

    found = token_orc.lookup(spark, to, [12_344])
    assert [list(r.ids) for r in found.collect()] == bpe(["some text 12344"])
    assert 1 <= rows_read(token_orc.lookup(spark, to, [12_344])) <= 2 * token_orc.INDEX_STRIDE
    # an odd id lies between the least and the most of its row group: the Bloom filter alone tells that it isn't there
    assert sum(rows_read(token_orc.lookup(spark, to, [n])) == 0 for n in range(10_001, 10_041, 2)) >= 18


def test_all_code_points(monkeypatch):
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{c}1{c} {c}" for c in points[i : i + 64]) for i in range(0, len(points), 64)]
    assert split(token_orc.encode_texts(B.as_strings(pa.array(texts)), BPE)) == bpe(texts)


def test_piece_round_trip(spark, tmp_path):
    rows = [*ROWS, *((100 + n, t) for n, t in enumerate(ODD))]
    folder = documents(spark, tmp_path, rows)
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    want = sorted((str(i), len(t or ""), len(x), zlib.crc32(np.array(x, "<u4").tobytes()), True) for (i, t), x in zip(rows, model.encode([t or "" for _, t in rows]), strict=True))
    got = pieces.op4_pieces(spark, folder).collect()
    assert sorted((str(r.doc_id), r.n_chars, r.n_tokens, r.ids_crc32, r.round_trip) for r in got) == want
    best = split_pieces([t or "" for _, t in rows], pieces.UNIGRAM)
    assert sorted((str(r.doc_id), r.best_tokens, r.best_crc32) for r in got) == sorted((str(i), len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for (i, _), x in zip(rows, best, strict=True))
    own = split_pieces([t or "" for _, t in rows])
    of = lambda x: float(pieces.sums_of_scores(np.array(x, np.int64), np.array([0, len(x)]), PIECES)[0])
    assert sorted((str(r.doc_id), round(r.best_score, 3)) for r in got) == sorted((str(i), round(of(x), 3)) for (i, _), x in zip(rows, best, strict=True))
    assert all(of(b) >= of(o) - 1e-3 for b, o in zip(best, own, strict=True))
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    back = pieces.decoded(pieces.encoded(docs.select("doc_id", "text", "part"), PIECES).drop("text"), PIECES)
    assert back.columns == ["doc_id", "part", "ids", "text"]
    assert sorted((str(r.doc_id), r.text) for r in back.collect()) == sorted((str(i), (t or "").replace("▁", " ")) for i, t in rows)
    assert pieces.op4_pieces(spark, documents(spark, tmp_path, [])).collect() == []
