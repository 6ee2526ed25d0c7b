"""Clusters around centroids, with an annulus search for the nearest one.

A vector's distance to a centroid is at least the difference of their norms. So if some centroid is at distance u, the
nearest has a norm within u of the vector's own: centroids are sorted by norm, that annulus is found by binary search,
and only what lies in it is compared, exactly, in integers. The centroid that gives u is the one to which the vector belonged
after the first round, or in that round the one whose norm is closest.

Centroids (k times d numbers) go to all tasks and come back as sums, which built-in aggregates add up; vectors
stay where they are. They are written once, after the first round, and each round reads them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scratch

LARGEST = 1 << 26  # components are below this, so that sums of 256 squared differences fit 64 bits
DIMENSIONS = 64
CLUSTERS = 8
ROUNDS = 10
PAIRS = 1 << 15  # vectors and centroids that are compared at a time


def quantised(x: Column, dimensions: int = DIMENSIONS, scale: int = 1024) -> Column:
    """The components as integers floor(scale * x); null for a vector of another length or with a component that is null, not
    finite, or whose integer is LARGEST or more in size, as squared distances would not fit 64 bits."""
    whole = F.transform(x, lambda v: F.floor(F.lit(scale) * F.when(F.abs(v.cast("double")) < LARGEST / scale, v.cast("double"))))
    fits = (F.size(x) == dimensions) & ~F.exists(whole, lambda v: v.isNull())
    return F.when(fits, F.transform(whole, lambda v: v.cast("int")))


class Annuli:
    """Centroids sorted by norm."""

    def __init__(self, centroids: np.ndarray):
        norms = np.sqrt((centroids**2).sum(axis=1, dtype=np.int64))
        self.order = np.argsort(norms, kind="stable")
        self.norms, self.sorted, self.centroids = norms[self.order], centroids[self.order], centroids

    def near(self, norms: np.ndarray) -> np.ndarray:
        """Of each norm the centroid of the closest one."""
        at = np.clip(np.searchsorted(self.norms, norms), 1, max(1, len(self.norms) - 1))
        if len(self.norms) > 1:
            at = at - (norms - self.norms[at - 1] < self.norms[at] - norms)
        else:
            at = np.zeros(len(norms), np.int64)
        return self.order[at]

    def bounds(self, norms: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and end of the sorted centroids whose norms are within ``most`` of the norms; rounding only widens it."""
        slack = 1e-6 + 1e-12 * (norms + most)
        return np.searchsorted(self.norms, norms - most - slack), np.searchsorted(self.norms, norms + most + slack, side="right")

    def nearest(self, vectors: np.ndarray, home: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, int]:
        """(number of the nearest centroid, the smallest of several; squared distance; number of comparisons)."""
        norms = np.sqrt((vectors**2).sum(axis=1, dtype=np.int64))
        home = self.near(norms) if home is None else home
        most = np.sqrt(((vectors - self.centroids[home]) ** 2).sum(axis=1, dtype=np.int64))
        lo, hi = self.bounds(norms, most)
        cluster, distance = np.zeros(len(vectors), np.int64), np.zeros(len(vectors), np.int64)
        ends = np.cumsum(hi - lo)
        first = 0
        while first < len(vectors):
            before = ends[first] - (hi[first] - lo[first])
            end = max(first + 1, int(np.searchsorted(ends, before + PAIRS, side="right")))
            best = None  # the annulus of a single vector may be longer than a block
            for skip in range(0, int((hi[first:end] - lo[first:end]).max()), PAIRS):
                a, b = lo[first:end] + skip, np.minimum(hi[first:end], lo[first:end] + skip + PAIRS)
                size = b - a
                start = np.cumsum(size) - size
                which = np.repeat(np.arange(first, end), size)
                among = np.arange(len(which)) + np.repeat(a - start, size)
                d = ((vectors[which] - self.sorted[among]) ** 2).sum(axis=1, dtype=np.int64)
                least = np.minimum.reduceat(d, start)
                number = np.minimum.reduceat(np.where(d == np.repeat(least, size), self.order[among], len(self.order)), start)
                if best is None:
                    best = least, number
                else:
                    closer = (least < best[0]) | ((least == best[0]) & (number < best[1]))
                    best = np.where(closer, least, best[0]), np.where(closer, number, best[1])
            distance[first:end], cluster[first:end] = best
            first = end
        return cluster, distance, int(ends[-1]) if len(ends) else 0


def _matrix(lists: pa.ListArray, dimensions: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dimensions)


def assigned(rows: DataFrame, centroids: np.ndarray, vector: str = "vector", home: str | None = None, to: tuple[str, str] = ("cluster", "distance")) -> DataFrame:
    """The columns of ``rows``, where ``vector`` has as many integers as a centroid, with the number of the nearest centroid and the
    squared distance, in place of columns named as ``to`` says. ``home`` names a column with some centroid that is likely near."""
    kept = [c for c in rows.columns if c not in to]
    near = Annuli(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cluster, distance, _ = near.nearest(_matrix(batch.column(vector), centroids.shape[1]), batch.column(home).to_numpy() if home else None)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(cluster.astype(np.int32)), pa.array(distance)], [*kept, *to])

    chosen = rows.select(*(f"`{c}`" for c in kept))
    return chosen.mapInArrow(run, chosen.select("*").schema.add(to[0], "integer").add(to[1], "long"))


def means(rows: DataFrame, centroids: np.ndarray, vector: str = "vector", cluster: str | None = None, home: str | None = None) -> np.ndarray:
    """The componentwise floor of the mean of the vectors nearest to each centroid; a centroid that has none stays.

    ``cluster`` names the column with the nearest one if that is known. Each task gives k sums; built-in aggregates add those up,
    and k times d numbers come back.
    """
    k, d = centroids.shape
    near = Annuli(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((k, d), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            vectors = _matrix(batch.column(vector), d)
            found = batch.column(cluster).to_numpy() if cluster else near.nearest(vectors, batch.column(home).to_numpy() if home else None)[0]
            counts += np.bincount(found, minlength=k)
            order = np.argsort(found, kind="stable")
            there, start = np.unique(found[order], return_index=True)
            if len(there):
                sums[there] += np.add.reduceat(vectors[order], start, axis=0)
        some = np.flatnonzero(counts)
        offsets = np.arange(len(some) + 1, dtype=np.int32) * d
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(counts[some]), pa.ListArray.from_arrays(pa.array(offsets), pa.array(sums[some].ravel()))], ["cluster", "n", "sums"])

    parts = rows.select(*{c for c in (vector, cluster, home) if c}).mapInArrow(run, "cluster int, n long, sums array<long>")
    totals = parts.select("cluster", "n", F.posexplode("sums").alias("at", "part")).groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum("part").alias("total"))
    out = centroids.copy()
    for r in totals.collect():  # k times d rows
        out[r["cluster"], r["at"]] = r["total"] // r["n"]
    return out


def first_centroids(rows: DataFrame, k: int, seed: int, key: str = "vec_id", vector: str = "vector") -> np.ndarray:
    """The vectors with the k smallest hashes of seed and key; a null key counts as none. Equal keys follow in the vectors' order."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)
    chosen = rows.select(order.alias("order"), F.col(vector).alias("vector")).orderBy("order", "vector").limit(k).collect()
    return np.array([r["vector"] for r in chosen], np.int64)


def clustered(rows: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, seed: int = 3, key: str = "vec_id", vector: str = "vector") -> tuple[DataFrame, np.ndarray]:
    """The rows with ``cluster`` and ``distance`` after all rounds, and the final centroids. ``vector`` has the integers.

    With fewer than k rows there are fewer centroids; with none, no row comes out.
    """
    centroids = first_centroids(rows, k, seed, key, vector)
    if not len(centroids):
        return rows.drop("cluster", "distance").withColumns({"cluster": F.lit(0), "distance": F.lit(0).cast("long")}), centroids
    home, rest = scratch.unused(rows, "home", "rest")
    stored = scratch.saved(assigned(rows, centroids, vector, to=(home, rest)).drop(rest), "vectors")
    for n in range(rounds):
        centroids = means(stored, centroids, vector, cluster=None if n else home, home=home)
    return assigned(stored, centroids, vector, home).drop(home), centroids


def op12_annulus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight clusters of all vectors after ten rounds.

    A vector counts if it has 64 components, none of them null, not finite, or 65,536 or more in size (squared distances would not
    fit a long). Null vec_id: kept, hashed as an empty one. Repeated rows: a result each. Fewer than eight vectors: as many
    clusters; none: no rows. Other columns do not matter.
    """
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").cast("long"), quantised(F.col("embedding")).alias("vector")).where("vector IS NOT NULL")
    found, centroids = clustered(rows)
    found = scratch.saved(found.select("vec_id", "cluster", "distance"), "clusters")
    sums = {r["cluster"]: r["inertia"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()}  # one row each
    each = [(n, sums.get(n, 0), sum(sums.values()), hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for n, c in enumerate(centroids)]
    clusters = spark.createDataFrame(each, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(clusters), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql(k: int, rounds: int) -> str:
    parts = [
        f"""v AS MATERIALIZED (SELECT row_number() OVER () AS i, vec_id, list_transform(embedding, lambda t: CAST(floor(1024 * CAST(t AS DOUBLE)) AS BIGINT)) AS x
        FROM embeddings WHERE len(embedding) = {DIMENSIONS}
        AND len(list_filter(embedding, lambda t: t IS NULL OR NOT isfinite(CAST(t AS DOUBLE)) OR abs(CAST(t AS DOUBLE)) >= {LARGEST // 1024})) = 0)""",
        f"""c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, x) - 1 AS k, x AS c
        FROM (SELECT sha256('3:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h, x FROM v) ORDER BY h, x LIMIT {k})""",
    ]
    for n in range(rounds + 1):
        parts.append(f"""a{n} AS MATERIALIZED (SELECT i, any_value(vec_id) AS vec_id, any_value(x) AS x,
        min({{'d': list_sum(list_transform(list_zip(x, c), lambda t: (t[1] - t[2]) * (t[1] - t[2]))), 'k': k}}) AS best FROM v, c{n} GROUP BY i)""")
        if n < rounds:
            parts.append(f"""c{n + 1} AS MATERIALIZED (SELECT k, coalesce(m.c, c{n}.c) AS c FROM c{n} LEFT JOIN (SELECT k, list(q ORDER BY p) AS c FROM
        (SELECT k, p, CAST((sum(t) - ((sum(t) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS q
        FROM (SELECT best.k AS k, unnest(x) AS t, generate_subscripts(x, 1) AS p FROM a{n}) GROUP BY k, p) GROUP BY k) AS m USING (k))""")
    return f"""WITH {", ".join(parts)}
        SELECT vec_id, CAST(best.k AS INTEGER) AS cluster, CAST(best.d AS BIGINT) AS distance, CAST(sum(best.d) OVER (PARTITION BY best.k) AS BIGINT) AS cluster_inertia,
        CAST(sum(best.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} ON best.k = k"""


OP12_SQL = _sql(CLUSTERS, ROUNDS)
