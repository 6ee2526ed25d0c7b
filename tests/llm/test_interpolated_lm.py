"""Scores against a plain computation of the same model, from dictionaries."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from idsieve.llm import interpolated_lm as lm
from tests.llm.tables import documents, write


def lowered_tokens(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), None]


def grams(tokens, n):
    """(context, n-gram) at each token; contexts that begin before the text have marks there."""
    padded = ["<s>"] * (n - 1) + tokens
    return [(tuple(padded[i : i + n - 1]), tuple(padded[i : i + n])) for i in range(len(tokens))]


def counted(texts, order):
    """By order, counts of contexts and of n-grams."""
    out = [(Counter(), Counter()) for _ in range(order)]
    for own in texts:
        for n in range(order):
            for c, g in grams(own, n + 1):
                out[n][0][c] += 1
                out[n][1][g] += 1
    return out


def bucket(counts, contexts):
    """The order and binary logarithm of the longest context that was seen; 0 without any."""
    for n in range(len(contexts) - 1, 0, -1):
        if seen := counts[n][0][contexts[n]]:
            return n, math.floor(math.log2(seen))
    return 0, 0


def estimates(counts, own, i, any_word):
    return [any_word] + [(n_grams[own[n][i][1]] / contexts[own[n][i][0]] if contexts[own[n][i][0]] else 0.0) for n, (contexts, n_grams) in enumerate(counts)]


def expected(docs, order=2):
    tokens = [lowered_tokens(t) for _, t in docs]
    folds = [0 if i is None else zlib.crc32(str(i).encode()) % 7 for i, _ in docs]
    kept = counted([t for t, f in zip(tokens, folds, strict=True) if f not in (2, 3)], order)
    every = counted([t for t, f in zip(tokens, folds, strict=True) if f != 2], order)
    total, kinds = every[0][1].total(), len(every[0][1])
    any_word = 1 / (kinds + 1)
    # expectation-maximisation, token by token
    seen = defaultdict(list)
    for own, f in zip(tokens, folds, strict=True):
        if f == 3:
            by = [grams(own, n + 1) for n in range(order)]
            for i in range(len(own)):
                seen[bucket(kept, [by[n][i][0] for n in range(order)])].append(estimates(kept, by, i, any_word))
    start = [0.1] + [0.9 / order] * order
    mix = dict.fromkeys(seen, start)
    for _ in range(25 if seen else 0):
        new = {}
        for b, rows in seen.items():
            sums = [0.0] * (order + 1)
            for r in rows:
                p = sum(m * x for m, x in zip(mix[b], r, strict=True))
                for k in range(order + 1):
                    sums[k] += mix[b][k] * r[k] / p
            new[b] = [s / len(rows) for s in sums]
        moved = max(abs(x - y) for b in new for x, y in zip(new[b], mix[b], strict=True))
        mix = new
        if moved <= 1e-4:
            break
    for b, m in mix.items():
        m = [max(m[0], 1e-6), max(m[1], 1e-6), *m[2:]]
        mix[b] = [x / sum(m) for x in m]
    out = []
    for (i, _), f, own in zip(docs, folds, tokens, strict=True):
        by = [grams(own, n + 1) for n in range(order)]
        score = 0.0
        for k in range(len(own)):
            b = bucket(every, [by[n][k][0] for n in range(order)])
            m = mix.get(max([x for x in mix if x <= b], default=min(mix, default=None)), start) if mix else start
            score += math.log10(sum(w * e for w, e in zip(m, estimates(every, by, k, any_word), strict=True)))
        base = sum(math.log10((every[0][1][(w,)] + 1) / (total + kinds + 1)) for w in own)
        out.append((i, i is not None and f == 2, len(own), sum(every[0][1][(w,)] > 0 for w in own), total, round(base, 5), round(score, 5)))
    return sorted(out, key=str)


def rows_of(df):
    return sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5), round(r.score, 5)) for r in df.collect()), key=str)


def got(spark, folder):
    return rows_of(lm.op8_interpolated_lm(spark, folder))


ODD = [(1, "The cat sat on the mat"), (1, "The cat sat on the mat"), (2, None), (3, ""), (4, " \t\n"), (None, "the the the"), (5, "THE cat\x0bsat é É"), (6, "x" * 5000), (5, "another text of id five")]
MORE = ODD + [(i, f"rare{i % 9} word{i % 4} the cat {i % 5} sat on rare{i % 7} rare{i % 9} mat of {i}") for i in range(10, 90)]


@pytest.mark.parametrize("rows", [ODD, MORE], ids=["odd", "more"])
def test_odd_rows(spark, tmp_path, rows):
    assert got(spark, documents(spark, tmp_path, rows)) == expected(rows)


def test_longer_ngrams(spark, tmp_path):
    docs = spark.read.parquet(f"{documents(spark, tmp_path, MORE)}/documents.parquet")
    assert rows_of(lm.interpolated_scores(docs, order=3)) == expected(MORE, 3)


def test_empty_table(spark, tmp_path):
    assert got(spark, documents(spark, tmp_path, [])) == []


def test_corpus(spark, small_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small_dir}/documents.parquet").select("doc_id", "text").collect()]
    want, have = expected(rows), got(spark, small_dir)
    assert have == want
    held = [r for r in have if r[1]]
    assert sum(r[6] for r in held) > sum(r[5] for r in held)  # better than add-one unigrams on texts not learned from


def test_results_do_not_depend_on_blocks_and_ranges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(lm, "BLOCK_BYTES", 300)
    monkeypatch.setattr(lm, "RANGE_BYTES", 500)
    assert got(spark, documents(spark, tmp_path, MORE)) == expected(MORE)


def test_clashing_names(spark, tmp_path):
    docs = spark.read.parquet(f"{documents(spark, tmp_path, ODD)}/documents.parquet")
    more = docs.select("*", *(F.lit("x").alias(c) for c in ("block", "fold", "payload", "held", "score", "bucket")))
    assert rows_of(lm.interpolated_scores(more)) == expected(ODD)


def test_only_held_out_texts(spark, tmp_path):
    rows = [(i, "a b a c") for i in range(40) if lm.fold(i) == lm.HELD_OUT]
    assert got(spark, documents(spark, tmp_path, rows)) == expected(rows)


def test_packed_numbers():
    for own in ([], [0, 0], [1, 255, 256], [2**64 - 1, 0, 5]):
        x = np.array(own, np.uint64)
        assert (lm.expanded(lm.squeezed(x), len(x)) == x).all()
