"""Links and classes against all pairs, compared one by one."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from idsieve.llm import ngram_join as nj
from idsieve.llm.components import components
from tests.llm.tables import documents


def gram_set(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def expected(rows):
    sets = [gram_set(t) for _, t in rows]
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if common and 5 * common >= 4 * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                root[find(a)] = find(b)
    of = {}
    for n, (i, _) in enumerate(rows):
        of.setdefault(find(n), []).append(i)
    out = []
    for n, (i, _) in enumerate(rows):
        own = of[find(n)]
        out.append((i, min((x for x in own if x is not None), default=None) if sets[n] else i, links[n], len(own)))
    return sorted(out, key=str)


def got(spark, folder):
    return sorted(map(tuple, nj.op1_ngram_join(spark, folder).collect()), key=str)


def near_copies(n, words=60, seed=3):
    r = random.Random(seed)
    base = [f"w{r.randrange(500)}" for _ in range(words)]
    rows = []
    for i in range(n):
        own = list(base)
        for _ in range(r.randrange(3)):
            own[r.randrange(words)] = f"x{r.randrange(10**6)}"
        rows.append((i, " ".join(own)))
    return rows


ODD = [(1, "a b c d e f g"), (1, "a b c d e f g"), (2, "A, b. C d e f g!"), (3, None), (4, ""), (5, "!!!"), (6, "one two"), (7, "one two"), (None, "null id words here now yes"), (9, "null id words here now yes"), (10, "z " * 3000), (11, "z z z z z z")]


def test_odd_rows(spark, tmp_path):
    assert got(spark, documents(spark, tmp_path, ODD)) == expected(ODD)


def test_empty_table(spark, tmp_path):
    assert got(spark, documents(spark, tmp_path, [])) == []


@pytest.mark.parametrize("nodes", [1200, 13])
def test_near_copies_in_one_block_and_in_several(spark, tmp_path, monkeypatch, nodes):
    monkeypatch.setattr(nj, "BLOCK_NODES", nodes)
    rows = near_copies(70) + [(100 + i, t) for i, t in near_copies(10, 40, 5)] + [(200, "something else entirely is written in this text")]
    assert got(spark, documents(spark, tmp_path, rows)) == expected(rows)


def test_corpus(spark, small_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{small_dir}/documents.parquet").select("doc_id", "text").collect()]
    want = expected(rows)
    assert got(spark, small_dir) == want
    assert any(r[2] for r in want)


def test_one_of_each_class_keeps_columns(spark, tmp_path):
    rows = [*ODD, *((20 + i, t) for i, t in near_copies(9))]
    docs = spark.read.parquet(documents(spark, tmp_path, rows) + "/documents.parquet")
    kept = nj.one_of_each_class(docs)
    assert kept.columns == docs.columns
    ids = sorted((r.doc_id for r in kept.collect()), key=str)
    classes = {}
    for i, c, _, size in expected(rows):
        classes.setdefault((c, size > 1 or i), []).append(i)
    assert len(ids) == len(classes)


def test_one_of_each_class_without_ids_and_of_equal_ids(spark, tmp_path):
    a, b, c, d = (" ".join(f"{x}{n}" for n in range(20)) for x in "abcd")
    rows = [(None, a), (None, a + "!"), (None, b), (None, b + "!"), (1, c), (2, c), (1, d), (3, d), (None, None), (None, "")]
    docs = spark.read.parquet(documents(spark, tmp_path, rows) + "/documents.parquet")
    kept = [(r.doc_id, (r.text or "").rstrip("!")) for r in nj.one_of_each_class(docs).collect()]
    assert sorted(kept, key=str) == sorted([(None, a), (None, b), (1, c), (1, d), (None, ""), (None, "")], key=str)
    assert got(spark, str(tmp_path)) == expected(rows)


def test_clashing_names(spark, tmp_path):
    docs = spark.read.parquet(documents(spark, tmp_path, ODD) + "/documents.parquet")
    more = docs.select("*", *(F.lit("x").alias(c) for c in ("node", "class_key", "text_key", "keep_id", "keep_key", "Cells", "first")))
    kept = nj.one_of_each_class(more)
    assert kept.columns == more.columns and {tuple(r[-7:]) for r in kept.collect()} == {("x",) * 7}
    assert sorted((r.doc_id, r.class_id, r.links, r.class_size) for r in nj.similarity_join(more).collect() if r.doc_id) == sorted(r for r in got(spark, str(tmp_path)) if r[0])


def test_a_chain_through_many_blocks(spark, tmp_path, monkeypatch):
    """Each text is near the next only, so the class is one and links are few."""
    monkeypatch.setattr(nj, "BLOCK_NODES", 7)
    rows = [(i, " ".join(f"w{n}" for n in range(3 * i, 3 * i + 64))) for i in range(60)]
    assert got(spark, documents(spark, tmp_path, rows)) == expected(rows)


def test_bands_reach_the_recall():
    bands, rows = nj.choose_bands(0.8, 0.9995)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.9995 and bands * rows <= nj.MAX_HASHES
    with pytest.raises(ValueError):
        nj.choose_bands(0.05, 0.9999, 4)


def test_common_counts(monkeypatch):
    monkeypatch.setattr(nj, "COLUMNS", 7)
    r = np.random.default_rng(0)
    sets = [np.unique(r.integers(0, 60, 30)).astype(np.int64) for _ in range(12)] + [np.array([10**12])]
    want = [[len(set(a) & set(b)) for b in sets] for a in sets]
    have = nj.common_counts(sets)
    np.fill_diagonal(have, 0)
    want = np.array(want)
    np.fill_diagonal(want, 0)
    assert (have == want).all()


def test_components_of_a_path(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (5, 5)] + [(900, n) for n in range(200, 260)]
    have = sorted(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert have == sorted([(i, 0) for i in range(41)] + [(100, 100), (101, 100), (102, 100), (900, 200)] + [(n, 200) for n in range(200, 260)])


def test_rows_that_differ_in_other_columns_only(spark):
    """The row that stays does not depend on how rows are dealt out."""
    rows = [(1, "one two three four five six", {"k": n}, f"v{n}") for n in range(9)] + [(2, "", {}, "a"), (2, "", {}, "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, m map<string, int>, extra string")
    kept = [sorted(r.extra for r in nj.one_of_each_class(docs.repartition(n, "extra")).collect()) for n in (1, 3, 7)]
    assert kept[0] == kept[1] == kept[2] and len(kept[0]) == 2
