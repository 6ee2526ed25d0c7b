"""From the bytes of files to pages and to the signals that tell of tampering.

Files are rows with ``content``, as Spark's binaryFile source or a table of bytes gives them. Bytes are decoded and measured in one
pass of a task, so that samples, which are many times the bytes, are not moved; ``pages`` gives them where another operator
needs them. A file that can't be decoded is a row with the reason.
"""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from idsieve.operators import imaging, integrity
from idsieve.operators.isolation import isolated
from idsieve.sources import images

QUALITY = 90
STRIP = 256  # rows of samples that are transformed at a time
# Quantisers of luminance and of colour differences that the JPEG standard gives as examples (K.1, K.2), by rows.
LUMINANCE = """16 11 10 16 24 40 51 61
12 12 14 19 26 58 60 55
14 13 16 24 40 57 69 56
14 17 22 29 51 87 80 62
18 22 37 56 68 109 103 77
24 35 55 64 81 104 113 92
49 64 78 87 103 121 120 101
72 92 95 98 112 100 103 99"""
CHROMINANCE = """17 18 24 47 99 99 99 99
18 21 26 66 99 99 99 99
24 26 56 99 99 99 99 99
47 66 99 99 99 99 99 99
99 99 99 99 99 99 99 99
99 99 99 99 99 99 99 99
99 99 99 99 99 99 99 99
99 99 99 99 99 99 99 99"""


@functools.cache
def quantisers(table: str, quality: int) -> np.ndarray:
    """A table scaled for a quality from 1 to 100, as the usual programs do."""
    scale = 5000 // quality if quality < 50 else 200 - 2 * quality
    return np.clip((np.array(table.split(), np.int64) * scale + 50) // 100, 1, 255).reshape(8, 8)


def _through(plane: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """A plane after its blocks' coefficients have been quantised; sides are multiples of 8."""
    out = np.empty(plane.shape, np.uint8)
    for lo in range(0, len(plane), STRIP):
        c = images.to_cosines(images.blocks_of(plane[lo : lo + STRIP])) / steps
        whole = np.copysign(np.floor(np.abs(c) + (0.5 + 1e-9)), c)
        out[lo : lo + STRIP] = images.plane_of(images.from_cosines(whole * steps))
    return out


def recompressed(rgb: np.ndarray, quality: int = QUALITY) -> np.ndarray:
    """RGB samples as they come back from a baseline JPEG of a quality, with colour at half the size each way.

    Coding itself loses nothing, so only what does is done: colours, halving, cosines and quantisers. Edges are padded with what
    stands there.
    """
    height, width = rgb.shape[:2]
    tall, wide = -height % 16, -width % 16
    planes = []
    for k, plane in enumerate(images.ycc_of(rgb)):
        if k:  # means of four, rounded down and up in turn along a row
            even = np.pad(plane, ((0, height % 2), (0, width % 2)), mode="edge")
            sums = even[::2, ::2] + even[1::2, ::2] + even[::2, 1::2] + even[1::2, 1::2]
            plane = (sums + 1 + np.arange(sums.shape[1]) % 2) >> 2
        high, across = plane.shape
        padded = np.pad(plane, ((0, (height + tall) // (2 if k else 1) - high), (0, (width + wide) // (2 if k else 1) - across)), mode="edge")
        back = _through(padded, quantisers(CHROMINANCE if k else LUMINANCE, quality))[:high, :across]
        if k:
            back = images.doubled(back, True) if across > 2 else np.repeat(np.repeat(back, 2, 0), 2, 1)
        planes.append(back[:height, :width])
    return images.rgb_of(*planes)


def error_levels(rgb: np.ndarray, quality: int = QUALITY) -> np.ndarray:
    """Differences to the recompressed image, summed over the colours, as means of blocks."""
    return imaging.block_means(np.abs(rgb.astype(np.int16) - recompressed(rgb, quality)).sum(2))


PAGE = "page int, format string, width int, height int, channels int, pixels binary"


def pages(files: DataFrame, keep: list[str], content: str = "content") -> DataFrame:
    """A row for each page of each file: page (from 0), format, width, height, channels (3) and pixels (RGB, row by row).

    PNG and JPEG have one page. A file that can't be decoded, null content included, is one row with ``error``.
    """

    def step(frame: pd.DataFrame) -> pd.DataFrame:
        out = []
        for found in images.decoded(frame[content].map(_bytes)):
            out.append((*(None,) * 6, str(found)) if isinstance(found, images.Unreadable) else (0, found[0], found[1].shape[1], found[1].shape[0], 3, found[1].tobytes(), None))
        return pd.DataFrame(out, columns=[c.split()[0] for c in PAGE.split(", ")] + ["unreadable"], index=frame.index, dtype=object)

    return _with_error(isolated(files, step, PAGE + ", unreadable string", [content], keep))


def _bytes(data) -> bytes | None:
    return None if data is None else bytes(data)


def _with_error(rows: DataFrame) -> DataFrame:
    """Files that a step itself tells to be unreadable are rows with ``error``, as those by which it fails; it needs no further calls for them."""
    return rows.withColumn("error", F.coalesce("unreadable", "error")).drop("unreadable")


HEADERS = "format string, width int, height int, software string, text_software string"
SIGNALS = HEADERS + ", noise_mean double, noise_std double, noise_max double, ela_mean double, ela_std double, ela_max double"


def headers(files: DataFrame, keep: list[str], content: str = "content") -> DataFrame:
    """format, width, height, software (of Exif data) and text_software of each file, without a look at its samples."""

    def step(frame: pd.DataFrame) -> pd.DataFrame:
        told = [{"unreadable": "there is no content"} if data is None else images.described(bytes(data)) for data in frame[content]]
        return pd.DataFrame(told, columns=[*(c.split()[0] for c in HEADERS.split(", ")), "unreadable"], index=frame.index, dtype=object)

    return _with_error(isolated(files, step, HEADERS + ", unreadable string", [content], keep))


def measured(files: DataFrame, keep: list[str], content: str = "content") -> DataFrame:
    """Headers, and mean, deviation and maximum of the blocks' noise and error levels, of each file in one pass.

    A file whose samples can't be decoded has what its headers tell, no numbers, and ``unreadable`` with the reason.
    """

    def step(frame: pd.DataFrame) -> pd.DataFrame:
        out = []
        for data, found in zip(frame[content], images.decoded(frame[content].map(_bytes)), strict=True):
            about = dict.fromkeys(c.split()[0] for c in HEADERS.split(", ")) if data is None else images.described(bytes(data))
            if isinstance(found, images.Unreadable):
                out.append((*about.values(), *(None,) * 6, str(found)))
                continue
            kind, rgb = found
            numbers = [x for part in (imaging.block_variances(imaging.grey(rgb)), error_levels(rgb)) for x in (part.mean(), part.std(), part.max())]
            out.append((kind, rgb.shape[1], rgb.shape[0], about["software"], about["text_software"], *numbers, None))
        names = [c.split()[0] for c in SIGNALS.split(", ")]
        return pd.DataFrame(out, columns=[*names, "unreadable"], index=frame.index, dtype=object)

    rows = isolated(files, step, SIGNALS + ", unreadable string", [content], keep)
    return rows.withColumn("unreadable", F.coalesce("unreadable", "error")).drop("error")


def jpeg_derived(kind: Column) -> Column:
    return F.coalesce(F.upper(kind).isin("JPEG", "JPG"), F.lit(False))


def tampering_of(kind: Column, width: Column, height: Column, software: Column, noise: Column, ela: Column, unreadable: Column) -> Column:
    """Struct of detected, confidence and indicators, warnings of the headers among the latter; where the image could not be read,
    nothing is detected and the reason is the one indicator."""
    found = imaging.tampering(ela, noise, imaging.editing_software(software), jpeg_derived(kind))
    told = F.struct(found["detected"].alias("detected"), found["confidence"].alias("confidence"), F.concat(found["indicators"], imaging.metadata_warnings(kind, width, height)).alias("indicators"))
    failed = F.struct(F.lit(False).alias("detected"), F.lit(0.0).alias("confidence"), F.array(F.concat(F.lit("The image could not be examined: "), unreadable)).alias("indicators"))
    return F.when(unreadable.isNotNull(), failed).otherwise(told)


def examined(files: DataFrame, keep: list[str], content: str = "content") -> DataFrame:
    """Everything that ``measured`` gives, noise_score, ela_score and ``tampering``."""
    rows = measured(files, keep, content)
    score = lambda n, scale: F.when(F.col(f"{n}_mean").isNotNull(), imaging.anomaly_score(F.col(f"{n}_mean"), F.col(f"{n}_std"), F.col(f"{n}_max"), scale))
    rows = rows.withColumns({"noise_score": score("noise", imaging.NOISE_SCALE), "ela_score": score("ela", imaging.ELA_SCALE)})
    return rows.withColumn("tampering", tampering_of(*(F.col(c) for c in ("format", "width", "height", "software", "noise_score", "ela_score", "unreadable"))))


COMPARISON = "comparison string, changed long, percent double, x long, y long, x2 long, y2 long"


def compared_contents(pairs: DataFrame, keep: list[str], content: str = "content", other: str = "prior_content") -> DataFrame:
    """How the pixels of one file differ from those of another: comparison (IDENTICAL, CHANGED, DIMENSIONS_CHANGED or UNAVAILABLE),
    changed pixels, their percentage and box, and ``error``, why a file could not be read."""

    def step(frame: pd.DataFrame) -> pd.DataFrame:
        out = []
        found = images.decoded(_bytes(data) for pair in zip(frame[content], frame[other], strict=True) for data in pair)
        for own, before in zip(found, found, strict=True):
            why = next((x for x in (own, before) if isinstance(x, images.Unreadable)), None)
            if why is not None:
                out.append((*(None,) * 7, str(why)))
                continue
            a, b = own[1], before[1]
            if a.shape != b.shape:
                out.append(("DIMENSIONS_CHANGED", *(None,) * 7))
                continue
            y, x = np.nonzero((a != b).any(2))
            box = (int(x.min()), int(y.min()), int(x.max()) + 1, int(y.max()) + 1) if len(x) else (None,) * 4
            out.append(("CHANGED" if len(x) else "IDENTICAL", len(x), round(100.0 * len(x) / a[:, :, 0].size, 4), *box, None))
        return pd.DataFrame(out, columns=[c.split()[0] for c in COMPARISON.split(", ")] + ["unreadable"], index=frame.index, dtype=object)

    rows = _with_error(isolated(pairs, step, COMPARISON + ", unreadable string", [content, other], keep))
    return rows.withColumn("comparison", F.coalesce("comparison", F.lit("UNAVAILABLE")))


def compared_with_prior(records: DataFrame, files: DataFrame, order: list[str], period: Column | None = None) -> DataFrame:
    """record_id, prior_id and the comparison of the pixels of each record with those of the record that it does not match.

    records: record_id, status, document_hash, identity_type, identity_key and what orders them. files: record_id and content. Prior
    records are looked for without contents; only those of records that differ from their prior one are fetched, by joins that leave
    files where they are if they are bucketed by record_id (sources.store).
    """
    narrow = records.select(*dict.fromkeys(["record_id", "status", "document_hash", "identity_type", "identity_key", *order]))
    rows = integrity.with_prior(narrow, order, period)
    differs = integrity.classification(F.col("document_hash"), F.col("prior.document_hash")) == "MISMATCH"
    pairs = rows.where(differs).select("record_id", F.col("prior.record_id").alias("prior_id"))
    # contents that a step makes are taken for as many bytes as its input has; the hint keeps them from being broadcast
    own = pairs.join(files.select("record_id", "content").hint("merge"), "record_id", "left")
    prior = files.select(F.col("record_id").alias("prior_id"), F.col("content").alias("prior_content")).hint("merge")
    return compared_contents(own.join(prior, "prior_id", "left"), ["record_id", "prior_id"])


def pixel_reasons(reasons: Column, comparison: Column, percent: Column, box: list[Column]) -> Column:
    """Reasons of a change with what the pixels tell, if they do."""
    where = F.format_string("%.4f %% of the pixels changed, from (%d, %d) to (%d, %d)", percent, *box)
    told = F.when(comparison == "CHANGED", where).when(comparison == "DIMENSIONS_CHANGED", "The image has another size").when(comparison == "IDENTICAL", "All pixels are the same")
    return F.array_compact(F.concat(reasons, F.array(told)))
