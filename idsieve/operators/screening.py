"""Risk of a screening from its stages, history and key figures over screenings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from idsieve.functions import display
from idsieve.functions.columns import unused

FACE_TOLERANCE = 0.6


def mrz_verdict(kind: Column, status: Column) -> Column:
    """What the machine-readable lines say. status: of a passport's parsed lines, or of a visa's pair, null where there is none.

    Lines of a passport that are not valid are given up for its visible text, so they count as not there; a visa's pair is told by its
    form alone and may be wrong. Other documents have no lines.
    """
    return F.when((kind == "PASSPORT") & (status == "VALID"), "MATCH").when((kind == "VISA") & status.isNotNull(), F.when(status == "VALID", "MATCH").otherwise("MISMATCH")).otherwise("NOT_PRESENT")


def risk(validation_status: Column, tampering: Column, parse_errors: Column) -> Column:
    """Struct of score, level and reasons: 90 for an invalid document, 75 for signs of tampering, 25 for fields not read, else 10."""
    invalid, tampered, unread = (F.coalesce(x, F.lit(False)) for x in (validation_status == "INVALID", tampering, parse_errors))
    score = F.when(invalid, 90).when(tampered, 75).when(unread, 25).otherwise(10).cast("double")
    reasons = F.array_compact(F.array(F.when(invalid, "The document does not meet the rules of its type"), F.when(tampered, "Possible tampering detected"), F.when(unread & ~invalid & ~tampered, "Some fields could not be read")))
    return F.struct(score.alias("score"), display.level_of(score).alias("level"), reasons.alias("reasons"))


def l2_distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v))


def face_match(a: Column, b: Column, tolerance: float = FACE_TOLERANCE) -> Column:
    """Struct of status, distance and confidence of two face vectors; REVIEW if either is missing."""
    d = l2_distance(a.cast("array<double>"), b.cast("array<double>"))
    missing = a.isNull() | b.isNull()
    return F.struct(
        F.when(missing, "REVIEW").when(d <= tolerance, "MATCH").otherwise("MISMATCH").alias("status"), F.when(~missing, d).alias("distance"), F.when(missing, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - d))).alias("confidence")
    )


def face_status(similarity: Column) -> Column:
    """Of a similarity in percent: 85 and up is a match, 70 and up for a review."""
    return F.when(similarity >= 85, "MATCH").when(similarity >= 70, "REVIEW").otherwise("MISMATCH")


def history(screenings: DataFrame, documents: DataFrame) -> DataFrame:
    """Screenings with their documents (if there), decision first to last; newest first, ties by id."""
    rows = screenings.join(documents, "document_id", "left")
    return rows.withColumn("decision", display.decision_of_level(F.col("risk_level"))).orderBy(F.col("created_at").desc(), F.col("screening_id").desc())


def search(rows: DataFrame, query: str | None, columns: list[str], **equal: str | None) -> DataFrame:
    """Rows with the query in any of the columns, as plain text without regard to case, and the given values; ALL or None: any."""
    if query:
        hit = F.lit(False)
        for c in columns:
            hit = hit | F.coalesce(F.lower(F.col(c).cast("string")).contains(query.lower()), F.lit(False))
        rows = rows.where(hit)
    for c, v in equal.items():
        if v and v.upper() != "ALL":
            rows = rows.where(F.upper(c) == v.upper())
    return rows


def with_total(rows: DataFrame) -> DataFrame:
    """The rows with ``total``, how many they are. Only the count of each part meets in one task."""
    return rows.withColumn("total", rows.agg(F.count("*")).scalar())


def key_figures(rows: DataFrame, baseline: int = 0) -> DataFrame:
    """One row of counts by decision; a baseline is added to the total alone."""
    c = F.col("decision")
    return rows.agg((F.count("*") + F.lit(baseline)).alias("total"), F.count_if(c == "clear").alias("clear"), F.count_if(c == "review").alias("review"), F.count_if(c == "high_risk").alias("high_risk"))


def shares(rows: DataFrame, column: str, digits: int = 1) -> DataFrame:
    """Rows and percentage of the total, for each value. Only the counts meet in one task."""
    counts = rows.groupBy(column).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(F.lit(1)))
    return counts.withColumn("share", F.bround(100.0 * F.col("n") / F.greatest(total, F.lit(1)), digits))


def timeline(rows: DataFrame, ts: str, column: str) -> DataFrame:
    return rows.groupBy(F.to_date(ts).alias("day"), column).agg(F.count("*").alias("n"))


def top_values(rows: DataFrame, column: str, k: int) -> DataFrame:
    """The k most frequent values; ties by value."""
    return rows.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(k)


def findings(rows: DataFrame) -> DataFrame:
    """A row for each reason, numbered from 1: screening_id, code and text."""
    return rows.select("screening_id", F.posexplode("reasons").alias("at", "description")).select("screening_id", F.concat(F.lit("RISK-"), (F.col("at") + 1).cast("string")).alias("code"), "description")


def field_rows(rows: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Unpivot: a row for each field, with a default for those not read and the source that the name tells."""
    long = rows.select(key, *(F.col(f).cast("string").alias(f) for f in fields)).unpivot(key, fields, "field", "value")
    found = F.coalesce(F.col("value"), F.lit("")) != ""
    return long.select(key, "field", F.when(found, F.col("value")).otherwise("Not detected").alias("value"), F.when(found, "present").otherwise("missing").alias("status"), F.when(F.col("field").contains("mrz"), "MRZ").otherwise("OCR").alias("source"))


def audit_counts(rows: DataFrame, key: str) -> DataFrame:
    """Counts by a column: records, registered, pending, flagged, and unknown where nothing tells whether a record is flagged.

    rows: status and flagged (true, false or null).
    """
    registered = F.col("status").isin("CONFIRMED", "REUSED", "PENDING")
    return rows.groupBy(key).agg(F.count("*").alias("records"), F.count_if(registered).alias("registered"), F.count_if(F.col("status") == "PENDING").alias("pending"), F.count_if("flagged").alias("flagged"), F.count_if(F.col("flagged").isNull()).alias("unknown"))


def pass_rates(rows: DataFrame, key: str) -> DataFrame:
    """Average processing_seconds, and the percentage of rows passed (1 decimal), by a column."""
    return rows.groupBy(key).agg(F.avg("processing_seconds").alias("seconds"), F.bround(100.0 * F.count_if("passed") / F.count("*"), 1).alias("pass_rate"))


def step_rows(rows: DataFrame, key: str, steps: list[str]) -> DataFrame:
    """A row for each step of each screening: done before the current one, active or failed at it, waiting after it.

    rows: current (number of the step from 0; one behind the last means that all are done) and failed.
    """
    n = F.col("n")
    status = F.when((n == F.col("current")) & F.col("failed"), "failed").when(n < F.col("current"), "done").when(n == F.col("current"), "active").otherwise("waiting")
    return rows.select(key, "current", "failed", F.posexplode(F.array(*map(F.lit, steps))).alias("n", "step")).select(key, "step", status.alias("status"))


def missing_names(rows: DataFrame, key: str) -> DataFrame:
    """Fields present, and the names of those missing, joined in order of name."""
    gone = F.array_sort(F.collect_list(F.when(F.col("status") == "missing", F.col("field"))))
    return rows.groupBy(key).agg(F.count_if(F.col("status") == "present").alias("present"), F.array_join(gone, ", ").alias("missing"))


def overlay(base: DataFrame, detail: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """The base rows with the detail's values where it has any."""
    own = dict(zip(columns, unused(base, *(f"own_{c}" for c in columns)), strict=True))
    rows = base.join(detail.select(key, *(F.col(c).alias(n) for c, n in own.items())), key, "left")
    return rows.select(*(F.coalesce(own[c], c).alias(c) if c in own else F.col(c) for c in base.columns))


def evaluation_summary(rows: DataFrame) -> DataFrame:
    """Nine counts over evaluation rows: document_type, status, risk_level, tampering_detected."""
    s, k, t = F.col("status"), F.col("risk_level"), F.col("document_type")
    return rows.agg(
        F.count("*").alias("total"),
        F.count_if(s == "COMPLETED").alias("completed"),
        F.count_if(s == "FAILED").alias("failed"),
        F.count_if(k == "LOW").alias("low"),
        F.count_if(k == "MEDIUM").alias("medium"),
        F.count_if(k == "HIGH").alias("high"),
        F.count_if(F.col("tampering_detected")).alias("tampering"),
        F.count_if(t == "AADHAAR").alias("aadhaar"),
        F.count_if(t == "PASSPORT").alias("passport"),
    )
