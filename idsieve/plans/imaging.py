"""Image signals: vectors of 64 numbers stand for 8x8 images, numbers of line items for measured regions."""

from __future__ import annotations

from pyspark.sql import functions as F

from idsieve.functions import display
from idsieve.operators import imaging
from idsieve.plans.registry import query

# samples from 0 to 255 of an 8x8 image, and statistics of its 4x4 blocks of 2x2 samples
_PIXELS = "WITH p AS (SELECT vec_id, unnest(list_transform(embedding, lambda e: floor(abs(e::double) * 1000) % 256)) AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings), b AS (SELECT vec_id, (i // 8) // 2 AS y, (i % 8) // 2 AS x, var_pop(v) AS var, avg(v) AS mean FROM p GROUP BY 1, 2, 3)"


@query(f"{_PIXELS} SELECT vec_id, round(avg(var) + 1e-7, 4) AS mean, round(max(var) + 1e-7, 4) AS most, round(CASE WHEN stddev_pop(var) < 1e-6 THEN 0 ELSE (max(var) - avg(var)) / stddev_pop(var) END, 4) AS ratio FROM b GROUP BY 1")
def block_noise(table):
    """As a grouped aggregate: exploded samples, blocks by whole division of their places."""
    values = table("embeddings").select("vec_id", F.posexplode(F.transform("embedding", lambda e: F.floor(F.abs(e.cast("double")) * 1000) % 256)).alias("i", "v"))
    stats = imaging.grouped_block_statistics(values, "vec_id", 8, 2)
    return stats.select("vec_id", F.round(F.col("mean") + 1e-7, 4).alias("mean"), F.round(F.col("most") + 1e-7, 4).alias("most"), F.round(imaging.anomaly_ratio(F.col("mean"), F.col("std"), F.col("most")), 4).alias("ratio"))


def images(table):
    """Grey images of 64x64 samples: each number of a vector fills an 8x8 square."""
    level = F.transform("embedding", lambda e: F.lpad(F.hex((F.floor(F.abs(e.cast("double")) * 1000) % 256).cast("int")), 2, "0"))
    return _drawn(table("embeddings").select(F.col("vec_id").alias("doc_id"), level.alias("squares")), 8, 1)


def _drawn(rows, side: int, channels: int):
    """Images of 8x8 squares; each square is the hexadecimal digits of one sample, ``side`` samples wide and high."""
    band = lambda r: F.repeat(F.array_join(F.transform(F.slice("squares", r * 8 + 1, 8), lambda c: F.repeat(c, F.lit(side))), ""), F.lit(side))
    pixels = F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), band), ""))
    return rows.withColumn("pixels", pixels).drop("squares").withColumns({"height": F.lit(8 * side), "width": F.lit(8 * side), "channels": F.lit(channels)})


@query(
    f"""{_PIXELS}, s AS (SELECT vec_id, avg(var) AS mean, stddev_pop(var) AS std, max(var) AS most FROM b GROUP BY 1)
    SELECT vec_id AS doc_id, round(mean + 1e-7, 3) AS noise_mean, round_even(greatest(0, least(1, CASE WHEN std < 1e-6 THEN 0 ELSE (most - mean) / std END / 8) * least(1, most / 100)) + 1e-9, 3) AS noise_score FROM s"""
)
def noise_of_images(table):
    rows = imaging.block_statistics(images(table))
    return rows.select("doc_id", F.round(F.col("noise_mean") + 1e-7, 3).alias("noise_mean"), imaging.anomaly_score(F.col("noise_mean"), F.col("noise_std"), F.col("noise_max"), imaging.NOISE_SCALE).alias("noise_score"))


_OTHER = "FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id - a.vec_id % 2"


@query(
    f"""WITH p AS (SELECT a.vec_id AS doc_id, list_filter(range(0, 64), lambda i: floor(abs(a.embedding[i + 1]::double) * 1000) % 256 <> floor(abs(b.embedding[i + 1]::double) * 1000) % 256) AS c {_OTHER})
    SELECT doc_id, CASE WHEN len(c) > 0 THEN 'CHANGED' ELSE 'IDENTICAL' END AS status, len(c) * 64 AS changed, round_even(100.0 * len(c) / 64, 4) AS percent, list_min(list_transform(c, lambda i: i % 8)) * 8 AS x, list_min(list_transform(c, lambda i: i // 8)) * 8 AS y, list_max(list_transform(c, lambda i: i % 8)) * 8 + 8 AS x2, list_max(list_transform(c, lambda i: i // 8)) * 8 + 8 AS y2 FROM p"""
)
def compared_images(table):
    rows = images(table)
    other = rows.select(F.col("doc_id").alias("other_id"), *(F.col(c).alias(f"other_{c}") for c in ("pixels", "height", "width", "channels")))
    pairs = rows.join(other, F.col("other_id") == F.col("doc_id") - F.col("doc_id") % 2).drop("other_id")
    return imaging.compared(pairs)


@query(
    """WITH t AS (SELECT l_orderkey, l_linenumber, l_quantity / 77 AS ela, l_tax * 10 / 7 AS noise, l_returnflag = 'A' AS edited, l_linestatus = 'O' AS jpeg FROM lineitem), c AS (SELECT *, round_even(least(CASE WHEN jpeg THEN 0.45::double ELSE 0.45::double * 0.3::double END * ela + 0.35::double * noise + CASE WHEN edited THEN 0.2::double ELSE 0 END, 1), 2) AS confidence FROM t)
    SELECT l_orderkey, l_linenumber, confidence, confidence >= 0.5 AS detected, (ela >= 0.4)::int + (noise >= 0.4)::int + edited::int AS indicators FROM c"""
)
def tampering_scores(table):
    edited = F.when(F.col("l_returnflag") == "A", imaging.editing_software(F.lit("Adobe Photoshop 25")))
    t = imaging.tampering(F.col("l_quantity") / 77, F.col("l_tax") * 10 / 7, edited, F.col("l_linestatus") == "O")
    return table("lineitem").select("l_orderkey", "l_linenumber", t.alias("t")).select("l_orderkey", "l_linenumber", "t.confidence", "t.detected", F.size("t.indicators").alias("indicators"))


@query(
    """SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 4 THEN 'Unavailable' ELSE printf('%d%%, %d%% | %d%% x %d%%', floor(l_discount * 100::double + 0.5)::int, floor(l_tax * 100::double + 0.5)::int, floor(l_quantity / 64 * 100 + 0.5)::int, floor(l_linenumber / 8 * 100 + 0.5)::int) END AS box FROM lineitem"""
)
def boxes_shown(table):
    box = F.struct(F.col("l_discount").alias("x"), F.col("l_tax").alias("y"), (F.col("l_quantity") / 64).alias("width"), (F.col("l_linenumber") / 8).alias("height"))
    return table("lineitem").select("l_orderkey", "l_linenumber", display.box_text(F.when(F.col("l_linenumber") != 4, box)).alias("box"))


_GATE = "CASE WHEN a > 2.8 OR f < 0.06 OR c < 0.04 THEN 'NO_STAMP_DETECTED' WHEN e >= 0.68 AND NOT (low AND e < 0.82) THEN 'STAMP_DETECTED' WHEN e >= 0.45 THEN 'UNCERTAIN' ELSE 'NO_STAMP_DETECTED' END"


@query(
    f"""WITH r AS (SELECT l_orderkey, l_linenumber, 1 + l_quantity / 20 AS a, l_discount * 5 AS f, l_tax * 3 AS c, l_linestatus = 'O' AS low FROM lineitem), s AS (SELECT *, CASE WHEN a BETWEEN 1 AND 2.4 THEN 1 ELSE 0.65::double END * 0.35::double + CASE WHEN f BETWEEN 0.09 AND 0.42 THEN 1 ELSE 0.55::double END * 0.2::double + least(1, c / 0.18::double) * 0.45::double AS e FROM r)
    SELECT l_orderkey, l_linenumber, {_GATE} AS status FROM s"""
)
def stamp_gates(table):
    status = imaging.stamp_gate(1 + F.col("l_quantity") / 20, F.col("l_discount") * 5, F.col("l_tax") * 3, F.when(F.col("l_linestatus") == "O", "LOW").otherwise("ADEQUATE"))
    return table("lineitem").select("l_orderkey", "l_linenumber", status.alias("status"))


@query()
def boxes_without_overlaps(table):
    """Boxes of a document's line items: the larger ones stay, those that overlap one of them go."""
    box = F.struct((F.col("l_partkey") % 90 / 100).alias("x"), (F.col("l_suppkey") % 90 / 100).alias("y"), (F.col("l_quantity") / 200).alias("width"), (F.col("l_linenumber") / 20).alias("height"))
    boxes = table("lineitem").groupBy("l_orderkey").agg(F.collect_list(box).alias("boxes"))
    return boxes.select("l_orderkey", F.posexplode(imaging.without_overlaps(F.col("boxes"))).alias("at", "b")).select("l_orderkey", F.concat(F.lit("STAMP-"), F.lpad((F.col("at") + 1).cast("string"), 2, "0")).alias("region_id"), "b.x", "b.y")


@query(
    """WITH s AS (SELECT doc_id, trim(coalesce(text, '')) AS t FROM documents) SELECT doc_id, CASE WHEN t = '' THEN 'UNREADABLE' ELSE 'READABLE' END AS status, regexp_extract_all(t, '\\b[0-9]{1,2}[/-][0-9]{1,2}[/-][0-9]{2,4}\\b|\\b[0-9]{4}[/-][0-9]{1,2}[/-][0-9]{1,2}\\b') AS dates,
    list_sort(list_distinct(regexp_extract_all(upper(t), '\\b(?:ENTRY|EXIT|ADMIT|VISA|IMMIGRATION|ARRIVAL|DEPARTURE|PORT|VALID|UNTIL)\\b'))) AS terms FROM s"""
)
def stamp_texts(table):
    """Dates and terms of every document's text, read as a stamp's."""
    return table("documents").select("doc_id", imaging.stamp_text(F.col("text")).alias("s")).select("doc_id", "s.status", "s.dates", "s.terms")


def ink_images(table):
    """Images of 96x96 samples in colour: positive numbers of a vector are red ink, larger ones dark, the others paper."""
    colour = F.transform("embedding", lambda e: F.when(e > 0.1, "782840").when(e > 0, "C83C46").otherwise("FAFAF5"))
    rows = table("embeddings").select(F.col("vec_id").alias("doc_id"), F.when(F.col("vec_id") % 5 == 0, "AADHAAR").when(F.col("vec_id") % 2 == 0, "visa").otherwise("PASSPORT").alias("document_type"), F.when(F.col("vec_id") % 3 == 0, "PNG").otherwise("JPEG").alias("format"), colour.alias("squares"))
    return _drawn(rows, 12, 3).withColumn("pixels", F.when(F.col("doc_id") % 11 > 0, F.col("pixels")))


@query()
def stamps_of_images(table):
    """Stamp analysis of coloured images whose first region reads as an entry stamp; some are of other types or have no samples."""
    images_ = ink_images(table)
    texts = images_.select("doc_id", F.lit("STAMP-01").alias("region_id"), F.concat(F.lit("entry port 12/03/20"), F.lpad((F.col("doc_id") % 100).cast("string"), 2, "0"), F.lit(" Entry")).alias("text"))
    rows = imaging.stamp_analysis(images_, texts)
    return rows.select("doc_id", "status", "quality_status", F.size("regions").alias("regions"), "flagged", F.array_join(F.transform("regions", lambda r: F.concat_ws(" ", r["region_id"], r["x"].cast("string"), r["y"].cast("string"), r["width"].cast("string"), r["height"].cast("string"), F.array_join(r["dates"], "+"), F.array_join(r["terms"], "+"))), ";").alias("found"), F.array_join("indicators", ",").alias("indicators"), F.size("limitations").alias("limitations"))
