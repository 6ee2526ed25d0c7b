"""From read documents to screenings and records: parsing, validation, tampering, stamps, risk and integrity in one plan.

Every step is a projection on the document's row; the only shuffles are those that look for prior records.
A step that gives nothing (no lines, no readable image, an unknown type) gives its degraded result instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from idsieve.operators import imaging, integrity, layout, parsers, screening, validation

RESULT = ["document_id", "document_type", "identity_number", "mrz_verification", "mrz_confidence", "validation_status", "validation_score", "expiry_status", "tampering", "tampering_confidence", "stamp_status", "stored_score", "risk_level", "reasons"]
KINDS = ("PASSPORT", "VISA", "AADHAAR")
NUMBER = {"PASSPORT": "passport_number", "VISA": "passport_number", "AADHAAR": "aadhaar_number"}


def validated(docs: DataFrame, as_of: Column) -> DataFrame:
    """The rows with kind (the type in capitals; UNKNOWN without one), v (validation), mrz_status, unread (whether a field that must be
    there was not read) and identity_number, which take the place of columns so named.

    Each row is parsed as what it is: the parsers of other types get nulls for it, and the source is read once.
    """
    source = docs.select(F.struct(*(f"`{c}`" for c in docs.columns)).alias("source"))
    kind = F.upper(F.coalesce(F.nullif(F.col("source.document_type"), F.lit("")), F.lit("UNKNOWN")))
    rows = source.withColumn("kind", kind)
    parse = {"PASSPORT": parsers.parse_passports, "VISA": parsers.parse_visas, "AADHAAR": lambda rows: parsers.parse_residents(rows, F.to_date(as_of))}
    used = [c for c in ("text", "line1", "line2", "identity_text", "ocr_error") if c in docs.columns]
    for name in KINDS:
        own = rows.withColumns({c: F.when(F.col("kind") == name, F.col(f"source.{c}")) for c in used})
        done = parse[name](own)
        if name == "PASSPORT":
            done = done.withColumn("lines", F.col("mrz"))  # its rules want them again
        found = {f"identity_{name}": F.col("identity"), f"mrz_{name}": F.when(F.col("kind") == name, F.col("mrz.status")) if "mrz" in done.columns else F.lit(None).cast("string")}
        rows = done.withColumns(found).drop(*used, "identity", "mrz")
    by_kind = lambda f: F.coalesce(*(F.when(F.col("kind") == name, f(name)) for name in KINDS))
    identity = {name: F.col(f"identity_{name}") for name in KINDS}
    v = validation.routed(F.col("kind"), validation.validate_passport(identity["PASSPORT"], F.col("lines"), as_of), validation.validate_visa(identity["VISA"], as_of), validation.validate_resident(identity["AADHAAR"], as_of))
    unread = F.coalesce(by_kind(lambda name: validation.missing_fields({f: identity[name][f] for f in validation.REQUIRED[name]}, name) != ""), F.lit(False))
    made = {"kind": F.col("kind"), "v": v, "mrz_status": F.coalesce("mrz_PASSPORT", "mrz_VISA"), "unread": unread, "identity_number": by_kind(lambda name: identity[name][NUMBER[name]])}
    return rows.select(*(F.col(f"source.{c}").alias(c) for c in docs.columns if c not in made), *(c.alias(n) for n, c in made.items()))


def screened(docs: DataFrame, as_of: Column, words: DataFrame | None = None) -> DataFrame:
    """A screening (columns RESULT) for each document; with ``words`` also confidence, tokens_detected and tokens_requiring_review.

    docs: document_id, document_type, text, line1, line2, ela and noise (scores), software, jpeg, and stamps (gate results of
    the regions of its image). Columns that may be there: ocr_error (why recognition failed) and image_error (why the image could not be
    decoded); the stages that need those then give their degraded results. words: doc_id and confidence.
    """
    rows = validated(docs, as_of)
    kind = F.col("kind")
    failed = F.col("image_error") if "image_error" in docs.columns else F.lit(None).cast("string")
    found = imaging.tampering(F.coalesce("ela", F.lit(0.0)), F.coalesce("noise", F.lit(0.0)), imaging.editing_software(F.col("software")), F.coalesce("jpeg", F.lit(False)))
    none = F.struct(F.lit(False).alias("detected"), F.lit(0.0).alias("confidence"), F.array(F.concat(F.lit("The image could not be examined: "), failed)).alias("indicators"))
    stamps = imaging.stamp_status(F.coalesce("stamps", F.array().cast("array<string>")), kind)
    rows = rows.withColumns({"tampering": F.when(failed.isNotNull(), none).otherwise(found), "stamp_status": F.when(failed.isNotNull() & kind.isin(imaging.STAMPED), "INSUFFICIENT_EVIDENCE").otherwise(stamps)})
    rows = rows.withColumns({"risk": screening.risk(F.col("v.status"), F.col("tampering.detected"), F.col("unread")), "mrz_verification": screening.mrz_verdict(kind, F.col("mrz_status"))})
    out = rows.select(
        "document_id",
        "document_type",
        "identity_number",
        "mrz_verification",
        F.when(F.col("mrz_verification") == "MATCH", 1.0).otherwise(0.0).alias("mrz_confidence"),
        F.col("v.status").alias("validation_status"),
        F.col("v.validation_score").alias("validation_score"),
        F.col("v.expiry_status").alias("expiry_status"),
        F.col("tampering.detected").alias("tampering"),
        F.col("tampering.confidence").alias("tampering_confidence"),
        "stamp_status",
        F.col("risk.score").alias("stored_score"),
        F.col("risk.level").alias("risk_level"),
        F.col("risk.reasons").alias("reasons"),
    )
    if words is None:
        return out
    metrics = layout.word_metrics(words).withColumnRenamed("doc_id", "document_id")
    return out.join(metrics.hint("merge"), "document_id", "left").na.fill(0, ["tokens_detected", "tokens_requiring_review"])


def recorded(screenings: DataFrame, order: list[str]) -> DataFrame:
    """Screenings as records: prior, integrity_status and record_score, which a mismatch with the prior record escalates.

    The score stored with the screening stays the one before. screenings: the columns of a screening, record_id, status and
    document_hash.
    """
    key = F.coalesce("identity_number", F.lit(""))
    rows = screenings.withColumn("identity_type", F.when(key != "", F.upper("document_type"))).withColumn("identity_key", F.when(key != "", F.upper(key)))
    rows = integrity.with_prior(rows, order)
    rows = rows.withColumn("integrity_status", integrity.classification(F.col("document_hash"), F.col("prior.document_hash")))
    return rows.withColumn("record_score", integrity.escalated(F.col("integrity_status"), F.col("stored_score"))).drop("identity_type", "identity_key")
