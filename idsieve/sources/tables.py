"""Where documents, records and results come from and go to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from idsieve.functions import identifiers
from idsieve.functions.columns import unused

EXTENSIONS = ["png", "jpg", "jpeg", "pdf"]
MAX_BYTES = 15 * 1024 * 1024
# The columns of an evaluation row, in the order of its files.
EVALUATION = ["filename", "document_type", "document_id", "screening_id", "status", "risk_score", "risk_level", "validation_status", "validation_score", "mrz_verification", "tampering_detected", "tampering_confidence", "stamp_status", "blockchain_status", "record_hash", "processing_seconds", "error"]


def spread(rows: DataFrame) -> DataFrame:
    """The rows dealt out evenly to as many tasks as a shuffle has, at least four for each core.

    Spark cuts input by bytes, so a narrow table is read by a few tasks, however much work its rows are. The number is given, so
    adaptive execution does not join the small parts again.
    """
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, "\\.([A-Za-z0-9]+)$", 1))


def allowed(path: Column, length: Column | None = None) -> Column:
    ok = extension(path).isin(EXTENSIONS)
    return ok & (length <= MAX_BYTES) if length is not None else ok


def read_images(spark: SparkSession, folder: str) -> DataFrame:
    """Files of a folder and those below it, with their content; other kinds and too large ones are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.where(allowed(F.col("path"), F.col("length")))


def registered(files: DataFrame, document_type: str) -> DataFrame:
    """A document row for each file. Ids follow from path and time, so the same upload has the same one."""
    name = F.regexp_extract("path", "([^/]+)$", 1)
    return files.select(
        identifiers.short_id("DOC-", F.col("path"), F.col("modificationTime")).alias("document_id"), F.lit(document_type.upper()).alias("document_type"), name.alias("filename"), F.col("path").alias("file_path"), F.sha2("content", 256).alias("document_hash"), F.col("modificationTime").alias("uploaded_at")
    )


def dataset(files: DataFrame, expected: int) -> DataFrame:
    """Files in order of their names without regard to case; fails if they are not as many as expected."""
    found = files.agg(F.count("*")).scalar()  # one number, not the files
    checked = files.where(F.assert_true(found == expected, F.concat(F.lit(f"expected {expected} files, found "), found.cast("string"))).isNull())
    return checked.orderBy(F.lower(F.regexp_extract("path", "([^/]+)$", 1)), "path")


def upserted(old: DataFrame, new: DataFrame, key: str, version: str) -> DataFrame:
    """One row of each key: the one with the highest version; of equal ones the new."""
    came, n = unused(old, "came", "n")
    both = old.withColumn(came, F.lit(0)).unionByName(new.withColumn(came, F.lit(1)), allowMissingColumns=True)
    order = Window.partitionBy(key).orderBy(F.col(version).desc_nulls_last(), F.col(came).desc())
    return both.withColumn(n, F.row_number().over(order)).where(F.col(n) == 1).drop(n, came)


def evaluation_rows(rows: DataFrame) -> DataFrame:
    """The columns of an evaluation file in their order; those not there are null, and a row without a status has failed."""
    have = set(rows.columns)
    out = rows.select(*(F.col(c) if c in have else F.lit(None).cast("string").alias(c) for c in EVALUATION))
    return out.withColumn("status", F.coalesce("status", F.lit("FAILED")))


def write_evaluation(rows: DataFrame, folder: str) -> None:
    out = evaluation_rows(rows)
    out.write.option("header", "true").csv(f"{folder}/csv")
    out.write.json(f"{folder}/json")
