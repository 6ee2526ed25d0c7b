"""Features and trees against plain Python that looks at one word and one byte after the other."""

import math
import random
import re

import numpy as np
import pyarrow as pa

from idsieve.llm import bytewords as B
from idsieve.llm import toxicity

LEXICON = {("grob", True): 2.0, ("idiot", False): 1.5, ("schei", True): 3.0, ("dumm", False): 0.5, ("über", True): 2.5}


def lexicon():
    rows = []
    for (word, beginning), weight in LEXICON.items():
        raw = word.encode()
        rows.append((B.hash_of(word) ^ (len(raw) if beginning else 0), weight))
    rows.sort()
    return np.array([h for h, _ in rows], np.uint64), np.array([w for _, w in rows])


def plain(text):
    raw = text.encode()
    low = bytes(b + 32 if 65 <= b <= 90 else b for b in raw)
    found = [(m.start(), m.end()) for m in re.finditer(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)]
    words = [low[a:b] for a, b in found]
    n, size = max(len(words), 1), max(len(raw), 1)

    def weight(w):
        return max([v for (x, beginning), v in LEXICON.items() if (len(w) > len(x.encode()) and w.startswith(x.encode()) if beginning else w == x.encode())], default=0.0)

    fixed = [w.decode("utf-8", "replace") in toxicity.INSULTS for w in words]
    weights = [weight(w) for w in words]
    hit = [f or w > 0 for f, w in zip(fixed, weights, strict=True)]
    person = [w.decode("utf-8", "replace") in toxicity.SECOND_PERSON for w in words]
    near = [h and any(person[j] for j in range(max(0, i - 5), min(len(words), i + 6)) if j != i) for i, h in enumerate(hit)]
    letter = lambda b: 65 <= b <= 90 or 97 <= b <= 122 or b >= 128
    letters = max(sum(map(letter, raw)), 1)
    triples = list(zip(raw, raw[1:], raw[2:], strict=False))
    return [
        math.log1p(len(words)),
        sum(fixed) / n,
        sum(w > 0 for w in weights) / n,
        math.log1p(sum(hit)),
        sum(weights) / n,
        max(weights, default=0.0),
        sum(near) / n,
        sum(person) / n,
        sum(65 <= b <= 90 for b in raw) / letters,
        sum(b - a > 2 and all(65 <= c <= 90 for c in raw[a:b]) for a, b in found) / n,
        sum(chr(b) in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" for b in raw) / size,
        raw.count(b"!") / size,
        raw.count(b"?") / size,
        sum(letter(a) and letter(c) and (chr(b) in "*@$#!%&" or 48 <= b <= 57) for a, b, c in triples) / size,
        sum(a == b == c and letter(c) for a, b, c in triples) / size,
        sum(b - a for a, b in found) / n,
    ]


def texts():
    r = random.Random(6)
    parts = ["idiot", "Idiot", "you", "DU", "grobian", "grob", "scheibe", "dumm", "überall", "ÜBER", "house", "LOUD", "A", "s0up", "id!ot", "sooo", "aaaa", "1 2", "é", "ñandú", "!", "??", "...", "\n", "trash", "your", "#x", "~", "日本"]
    return ["", "x", "!!", "aa", "a1b"] + [r.choice(["", " "]).join(r.choice(parts) + r.choice([" ", " ", ", ", ""]) for _ in range(r.randrange(25))) for _ in range(400)]


def test_features_of_each_text():
    own = texts()
    columns = B.as_strings(pa.array(own))
    for limit in (100, 1 << 20):
        got = np.concatenate([toxicity.features(data, offsets, lexicon()) for _, _, data, offsets in B.chunked(columns, limit)])
        assert got.shape == (len(own), len(toxicity.FEATURES))
        np.testing.assert_allclose(got, np.array([plain(t) for t in own]), atol=1e-9)


def test_trees_learn_what_one_split_tells():
    r = np.random.default_rng(1)
    x = r.random((600, 3))
    y = ((x[:, 1] > 0.4) ^ (r.random(600) < 0.02)).astype(float)
    trees = toxicity.boosted(x, y)
    again = trees.raw(np.array([[0.5, 0.1, 0.5], [0.5, 0.9, 0.5]]))
    assert again[0] < -1 < 1 < again[1] and ((trees.raw(x) > 0) == (x[:, 1] > 0.4)).mean() > 0.97


def test_isotonic_pools_are_the_best_rising_fit():
    """Against the means of all runs: the fit at i is the largest, over beginnings up to i, of the least mean of a run to an end from i."""
    r = np.random.default_rng(2)
    raw, y = np.sort(r.random(60)), (r.random(60) < np.linspace(0.1, 0.9, 60)).astype(float)
    want = [max(min(y[a : b + 1].mean() for b in range(i, 60)) for a in range(i + 1)) for i in range(60)]
    x, p = toxicity.isotonic(raw, y)
    smooth = np.interp(raw, x, p)
    assert (np.diff(smooth) >= -1e-12).all() and np.abs(smooth - np.array(want)).mean() < 0.12
