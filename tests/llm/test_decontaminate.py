"""Matches against a comparison of every window with every item."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from idsieve.llm import decontaminate as de
from tests.llm.tables import documents, write


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def bag(own):
    return Counter(tuple(own[i : i + 5]) for i in range(max(1, len(own) - 4)))


def expected(rows, items):
    out = []
    for i, t in rows:
        own = words(t)
        for item, text in items:
            w = words(text)
            if not w or item is None:
                continue
            want, best = bag(w), None
            for at in range(len(own) - len(w) + 1):
                have = bag(own[at : at + len(w)])
                common = (have & want).total()
                s = common / (have.total() + want.total() - common)
                if s >= 0.8 and (best is None or s > best[0]):
                    best = (s, at, len(w))
            if best:
                out.append((i, item, *best))
    return sorted(out, key=str)


def run(spark, folder):
    return sorted(((r.doc_id, r.item_id, r.similarity, r.first_word, r.n_words) for r in de.op6_decontaminate(spark, folder).collect()), key=str)


def tables(spark, folder, rows, items):
    write(spark, folder, "benchmark", items, "item_id long, text string")
    return documents(spark, folder, rows)


def text(r, n):
    return [r.choice("the of and to in it is was thing ration edble onor shand".split()) + r.choice(["", "s", "er", "ing"]) for _ in range(n)]


@pytest.fixture(scope="module")
def planted():
    r = random.Random(5)
    items = [(n, " ".join(text(r, r.randrange(14, 60)))) for n in range(40)] + [(90, "Only three words"), (91, None), (92, "..."), (None, "no id for this item at all")]
    rows = [(n, " ".join(text(r, 150))) for n in range(30)]
    for n in range(30):
        passage = items[n][1].split()
        if n % 3 == 1 and len(passage) > 45:
            passage[0] = "changed"
        before, after = text(r, 40), text(r, 30)
        rows.append((100 + n, " ".join(before) + "!! " + "*** ".join(passage).upper() + ". " + " ".join(after)))
    return [*rows, (200, None), (201, ""), (None, items[3][1]), (203, items[4][1]), (203, items[4][1]), (204, "x only three words y"), (205, items[5][1] + " " + items[6][1])], items


def test_planted(spark, tmp_path, planted):
    rows, items = planted
    want = expected(rows, items)
    assert run(spark, tables(spark, tmp_path, rows, items)) == want
    assert len(want) >= 30 and any(s[2] < 1 for s in want)


def test_several_passes(spark, tmp_path, planted, monkeypatch):
    monkeypatch.setattr(de, "INDEX_BYTES", 15 * 40_272)
    assert de.items_a_pass(19) == 15
    rows, items = planted
    assert run(spark, tables(spark, tmp_path, rows, items)) == expected(rows, items)


def test_empty_tables(spark, tmp_path, planted):
    assert run(spark, tables(spark, tmp_path, [], planted[1])) == []
    assert run(spark, tables(spark, tmp_path, planted[0], [])) == []


def test_anti_join_keeps_clean_rows(spark, tmp_path, planted):
    rows, items = planted
    folder = tables(spark, tmp_path, rows, items)
    docs, bench = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "benchmark"))
    kept = de.without_benchmark(docs, bench)
    assert kept.columns == docs.columns
    bad = {i for i, *_ in expected(rows, items)}
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted((i for i, _ in rows if i not in bad), key=str)


def test_clashing_names(spark, tmp_path, planted):
    rows, items = planted
    folder = tables(spark, tmp_path, rows, items)
    docs, bench = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "benchmark"))
    more = docs.select("*", *(F.lit("x").alias(c) for c in ("text_key", "bad_id", "bad_key", "item_id", "similarity")))
    kept = de.without_benchmark(more, bench)
    assert kept.columns == more.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted((r.doc_id for r in de.without_benchmark(docs, bench).collect()), key=str)


def test_recall_just_over_the_similarity(spark, tmp_path):
    """Fingerprints find all windows but for one in a thousand, measured on windows that have 0.8 to 0.85 of the item's shingles."""
    r = random.Random(2)
    items, rows = [], []
    while len(rows) < 400:
        own = [f"{w}{r.randrange(4)}" for w in text(r, r.randrange(40, 90))]
        other = list(own)
        for _ in range(r.randrange(1, 4)):
            other[r.randrange(len(other))] = "changed"
        common = (bag(own) & bag(other)).total()
        if 0.8 <= common / (bag(own).total() + bag(other).total() - common) <= 0.85:
            items.append((len(items), " ".join(own)))
            rows.append((len(rows), " ".join([*text(r, 20), *other, *text(r, 20)])))
    found = {(i, item) for i, item, *_ in run(spark, tables(spark, tmp_path, rows, items))}
    assert len(found & {(n, n) for n in range(400)}) >= 0.99 * 400


def test_corpus(spark, small_dir):
    rows, items = ([tuple(r) for r in spark.read.parquet(f"{small_dir}/{t}.parquet").select(c, "text").collect()] for t, c in (("documents", "doc_id"), ("benchmark", "item_id")))
    assert run(spark, small_dir) == expected(rows, items)


def test_radius():
    assert de.radius(0.8) == 19


def expected_with_short(rows, items):
    """As expected(), and a text with fewer words than the item is one window."""
    out = expected(rows, items)
    for i, t in rows:
        own = words(t)
        for item, text in items:
            w = words(text)
            if own and item is not None and len(own) < len(w):
                common = (bag(own) & bag(w)).total()
                s = common / (bag(own).total() + bag(w).total() - common)
                if s >= 0.8:
                    out.append((i, item, s, 0, len(own)))
    return sorted(out, key=str)


def test_texts_with_fewer_words_than_the_item(spark, tmp_path):
    r = random.Random(8)
    items = [(n, " ".join(text(r, 8 + n))) for n in range(30)] + [(50, "w " * 30), (51, "w " * 28), (52, "few words"), (53, None)]
    rows = [(100 * n + cut, " ".join(t.split()[:-cut])) for n, t in items[:30] for cut in (1, 2, 5)]
    rows += [(100 * n + 50, " ".join(t.split()[1:])) for n, t in items[:30]] + [(9000, "w " * 27), (9001, "few"), (9002, None), (9003, "w " * 29), (9004, items[29][1] + " more")]
    folder = tables(spark, tmp_path, rows, items)
    want = expected_with_short(rows, items)
    assert run(spark, folder) == want
    assert len(want) > len(expected(rows, items)) + 60
    docs, bench = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "benchmark"))
    bad = {i for i, *_ in want}
    assert sorted(x.doc_id for x in de.without_benchmark(docs, bench).collect()) == sorted(i for i, _ in rows if i not in bad)
