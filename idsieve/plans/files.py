"""Image files: each vector of 64 numbers is a PNG of 64x64 samples in 8x8 grey squares; some are damaged, some name an editor."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from idsieve.operators import forensics
from idsieve.plans.registry import query
from idsieve.sources import images, tables


def files(table):
    """doc_id and content; every seventh file is cut off, every eleventh has no content."""

    def run(frames):
        for frame in frames:
            out = []
            for n, squares in zip(frame["doc_id"], frame["squares"], strict=True):
                image = np.kron(np.array(squares, np.uint8).reshape(8, 8), np.ones((8, 8), np.uint8))[:, :, None]
                data = images.encode_png(image if n % 2 else np.repeat(image, 3, 2), (int(n) % 5, 4, 1), "Adobe Photoshop 25" if n % 4 == 0 else None)
                out.append(None if n % 11 == 5 else data[: len(data) * 2 // 3] if n % 7 == 3 else data)
            yield pd.DataFrame({"doc_id": frame["doc_id"], "content": out})

    squares = F.transform("embedding", lambda e: (F.floor(F.abs(e.cast("double")) * 1000) % 256).cast("int"))
    return tables.spread(table("embeddings").select("vec_id", "embedding")).select(F.col("vec_id").alias("doc_id"), squares.alias("squares")).mapInPandas(run, "doc_id long, content binary")


_FILES = """WITH f AS (SELECT vec_id AS k, list_transform(embedding, lambda e: (floor(abs(e::double) * 1000) % 256)::int) AS v, vec_id % 11 = 5 AS gone, vec_id % 7 = 3 AND vec_id % 11 <> 5 AS cut FROM embeddings)"""


@query(
    f"""{_FILES}, h AS (SELECT *, array_to_string(list_transform(range(0, 8), lambda r: repeat(array_to_string(list_transform(range(0, 8), lambda c: repeat(printf('%02X', v[r * 8 + c + 1]), 24)), ''), 8)), '') AS rgb FROM f)
    SELECT k AS doc_id, CASE WHEN NOT gone AND NOT cut THEN 'PNG' END AS format, CASE WHEN NOT gone AND NOT cut THEN 64 END AS width, CASE WHEN NOT gone AND NOT cut THEN 3 END AS channels, CASE WHEN NOT gone AND NOT cut THEN sha256(unhex(rgb)) END AS pixels_sha256, gone OR cut AS failed FROM h"""
)
def pages_of_files(table):
    rows = forensics.pages(files(table), ["doc_id"])
    return rows.select("doc_id", "format", "width", "channels", F.sha2("pixels", 256).alias("pixels_sha256"), F.col("error").isNotNull().alias("failed"))


@query(f"{_FILES} SELECT k AS doc_id, CASE WHEN NOT gone THEN 'PNG' END AS format, CASE WHEN NOT gone THEN 64 END AS width, CASE WHEN NOT gone THEN 64 END AS height, CASE WHEN k % 4 = 0 AND NOT gone THEN 'Adobe Photoshop 25' END AS software, gone AS failed FROM f")
def headers_of_files(table):
    rows = forensics.headers(files(table), ["doc_id"])
    return rows.select("doc_id", "format", "width", "height", "software", F.col("error").isNotNull().alias("failed"))


_SCORE = "round_even(greatest(0, least(1, CASE WHEN std < 1e-6 THEN 0 ELSE (most - mean) / std END / 8) * least(1, most / {scale})) + 1e-9, 3)"


@query(
    # a square has one coefficient, 8 (v - 128), which quality 90 quantises by 3
    f"""{_FILES}, s AS (SELECT k, gone OR cut AS failed, unnest(v) AS v, generate_subscripts(v, 1) - 1 AS i FROM f),
    q AS (SELECT *, 3 * abs(v - greatest(0, least(255, 128 + floor(3 * sign(v - 128) * floor(abs(8 * (v - 128)) / 3::double + 0.5) / 8 + 0.5)))) AS d FROM s),
    b AS (SELECT k, failed, (i // 8) // 2 AS y, (i % 8) // 2 AS x, var_pop(v) AS var, avg(d) AS level FROM q GROUP BY 1, 2, 3, 4),
    n AS (SELECT k, failed, {_SCORE.format(scale=100)} AS noise_score FROM (SELECT k, failed, avg(var) AS mean, stddev_pop(var) AS std, max(var) AS most FROM b GROUP BY 1, 2)),
    e AS (SELECT k, mean, {_SCORE.format(scale=20)} AS ela_score FROM (SELECT k, avg(level) AS mean, stddev_pop(level) AS std, max(level) AS most FROM b GROUP BY 1)),
    c AS (SELECT k, failed, mean, noise_score, ela_score, round_even(least(0.45::double * 0.3::double * ela_score + 0.35::double * noise_score + CASE WHEN k % 4 = 0 THEN 0.2::double ELSE 0 END, 1), 2) AS confidence FROM n JOIN e USING (k))
    SELECT k AS doc_id, CASE WHEN NOT failed THEN round(mean + 1e-7, 3) END AS ela_mean, CASE WHEN NOT failed THEN noise_score END AS noise_score, CASE WHEN NOT failed THEN ela_score END AS ela_score, CASE WHEN failed THEN 0 ELSE confidence END AS confidence, NOT failed AND confidence >= 0.5 AS detected,
    CASE WHEN failed THEN 1 ELSE (ela_score >= 0.4)::int + (noise_score >= 0.4)::int + (k % 4 = 0)::int + 2 END AS indicators FROM c"""
)
def files_examined(table):
    """From bytes to signs of tampering; files that can't be decoded have one indicator, the reason."""
    rows = forensics.examined(files(table), ["doc_id"])
    return rows.select("doc_id", F.round(F.col("ela_mean") + 1e-7, 3).alias("ela_mean"), "noise_score", "ela_score", "tampering.confidence", "tampering.detected", F.size("tampering.indicators").alias("indicators"))


@query(
    f"""{_FILES}, r AS (SELECT *, 'i' || k % 40 AS identity, 'h' || CASE WHEN k % 9 = 0 THEN k % 40 ELSE k END AS hash, k % 6 > 0 AS registered FROM f),
    p AS (SELECT *, last_value(CASE WHEN registered THEN {{'k': k, 'hash': hash}} END IGNORE NULLS) OVER (PARTITION BY hash ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS a, last_value(CASE WHEN registered THEN {{'k': k, 'hash': hash}} END IGNORE NULLS) OVER (PARTITION BY identity ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM r),
    m AS (SELECT p.k AS record_id, o.k AS prior_id, p.gone OR p.cut OR o.gone OR o.cut AS failed, list_filter(range(0, 64), lambda i: p.v[i + 1] <> o.v[i + 1]) AS c FROM p JOIN f o ON o.k = coalesce(a, b).k WHERE coalesce(a, b).hash <> p.hash)
    SELECT record_id, prior_id, CASE WHEN failed THEN 'UNAVAILABLE' WHEN len(c) = 0 THEN 'IDENTICAL' ELSE 'CHANGED' END AS comparison, CASE WHEN NOT failed THEN len(c) * 64 END AS changed, CASE WHEN NOT failed AND len(c) > 0 THEN list_min(list_transform(c, lambda i: i % 8)) * 8 END AS x, CASE WHEN NOT failed AND len(c) > 0 THEN list_max(list_transform(c, lambda i: i // 8)) * 8 + 8 END AS y2, CASE WHEN failed THEN 1 ELSE 2 END AS reasons FROM m"""
)
def pixels_against_prior(table):
    """Of files whose record differs from the prior one of the same holder: what changed in their pixels."""
    k = F.col("record_id")
    stored = files(table).withColumnRenamed("doc_id", "record_id")
    hashes = F.concat(F.lit("h"), F.when(k % 9 == 0, k % 40).otherwise(k).cast("string"))
    records = table("embeddings").select(F.col("vec_id").alias("record_id"))
    records = records.select("record_id", F.when(k % 6 > 0, "CONFIRMED").otherwise("FAILED").alias("status"), hashes.alias("document_hash"), F.lit("passport_number").alias("identity_type"), F.concat(F.lit("i"), (k % 40).cast("string")).alias("identity_key"))
    rows = forensics.compared_with_prior(records, stored, ["record_id"])
    reasons = forensics.pixel_reasons(F.array(F.lit("Document content changed")), F.col("comparison"), F.col("percent"), [F.col(c) for c in ("x", "y", "x2", "y2")])
    return rows.select("record_id", "prior_id", "comparison", "changed", "x", "y2", F.size(reasons).alias("reasons"))
