"""Clusters by annulus search against plain numpy, and the search itself with ties."""

import hashlib

import numpy as np
import pandas as pd
import pytest

from idsieve.llm import annulus, queries
from tests.llm.tables import write

SCHEMA = "vec_id long, embedding array<float>, label int, cluster string, distance string, vector string"


def plain(rows):
    kept = [(i, [int(np.floor(1024 * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) and abs(x) < 65536 for x in v)]
    if not kept:
        return []
    key = sorted((hashlib.sha256(f"3:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in kept)
    centroids = [v for _, v in key[:8]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centroids))

    for _ in range(10):
        own = [nearest(v)[1] for _, v in kept]
        for n in range(len(centroids)):
            members = [v for (_, v), k in zip(kept, own, strict=True) if k == n]
            if members:
                centroids[n] = [sum(x) // len(members) for x in zip(*members, strict=True)]
    final = [nearest(v) for _, v in kept]
    inertia = [sum(d for d, k in final if k == n) for n in range(len(centroids))]
    return sorted(((i, k, d, inertia[k], sum(inertia), hashlib.sha256(",".join(map(str, centroids[k])).encode()).hexdigest()) for (i, _), (d, k) in zip(kept, final, strict=True)), key=str)


def got(spark, folder):
    return sorted(map(tuple, queries.QUERIES["op12_annulus"](spark, folder).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()), key=str)


def vectors(n, seed, spread=1.0):
    r = np.random.default_rng(seed)
    return [[float(np.float32(x)) for x in v] for v in r.normal(0, spread, (n, 64)) * r.choice([0.1, 1, 3], (n, 1))]


def test_given_vectors(spark, small_dir):
    frame = pd.read_parquet(f"{small_dir}/embeddings.parquet")
    assert got(spark, small_dir) == plain(list(zip(frame.vec_id.tolist(), frame.embedding.tolist(), strict=True)))


def test_odd_rows(spark, tmp_path):
    v = vectors(60, 2)
    rows = list(enumerate(v)) + [(1, v[1]), (1, v[5]), (None, v[7]), (None, None), (100, v[0][:63]), (101, [*v[0], 0.0]), (102, [*v[0][:63], None]), (103, [*v[0][:63], float("nan")]), (104, [*v[0][:63], float("inf")]), (105, [1e20] * 64), (106, []), (107, [0.0] * 64), (108, [-0.0] * 64)]
    write(spark, tmp_path, "embeddings", [(*r, 1, "a", "b", "c") for r in rows], SCHEMA)
    assert got(spark, str(tmp_path)) == plain(rows)


@pytest.mark.parametrize("n", [0, 1, 5])
def test_few_rows(spark, tmp_path, n):
    rows = list(enumerate(vectors(n, 3)))
    write(spark, tmp_path, "embeddings", [(*r, 1, "a", "b", "c") for r in rows], SCHEMA)
    assert got(spark, str(tmp_path)) == plain(rows)


def test_ties_and_equal_vectors(spark, tmp_path):
    """Few different vectors, so that centroids coincide, clusters are empty and distances are equal."""
    rows = [(i, [float((i // 3) % 3)] + [0.0] * 63) for i in range(60)]
    write(spark, tmp_path, "embeddings", [(*r, 1, "a", "b", "c") for r in rows], SCHEMA)
    assert got(spark, str(tmp_path)) == plain(rows)


@pytest.mark.parametrize(("k", "pairs"), [(1, 1 << 15), (2, 3), (40, 7), (300, 1 << 15)])
def test_search_is_exact(monkeypatch, k, pairs):
    """With small numbers there are ties of distances and of norms; blocks may be smaller than an annulus."""
    monkeypatch.setattr(annulus, "PAIRS", pairs)
    r = np.random.default_rng(k)
    x, c = r.integers(-2, 3, (200, 4)), r.integers(-2, 3, (k, 4))
    d = ((x[:, None] - c[None]) ** 2).sum(2)
    for home in (None, r.integers(0, k, 200)):
        cluster, distance, compared = annulus.Annuli(c).nearest(x, home)
        assert (cluster == d.argmin(1)).all() and (distance == d.min(1)).all() and compared <= 200 * k


def test_an_annulus_leaves_out_most_centroids():
    r = np.random.default_rng(1)
    c = r.normal(0, 1, (500, 16)) * np.geomspace(1, 1e6, 500)[:, None]
    c = c.astype(np.int64)
    x = c[r.integers(0, 500, 1000)] + r.integers(-3, 4, (1000, 16))
    assert annulus.Annuli(c).nearest(x)[2] < 1000 * 500 / 10
    assert annulus.Annuli(c).nearest(x, annulus.Annuli(c).nearest(x)[0])[2] < 1000 * 500 / 20
