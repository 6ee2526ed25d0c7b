"""Tables whose rows are looked up, joined and replaced by a key: bucketed versions behind a view.

A version is a table bucketed and sorted by its key, and the view of the table's name says which version counts. Replacing the view is
one step of the catalog, so readers see all of an upsert or nothing, and a version that was not finished is seen by nobody.
Joins of two such tables on the key need no exchange; a lookup reads one bucket, and of that the row groups whose
statistics and Bloom filter allow the key. Contents of files are kept so, too: small files lie side by side in large ones.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from idsieve.functions.columns import unused

BUCKETS = 64
ROW_GROUP_BYTES = 32 << 20


def versions(spark: SparkSession, name: str) -> list[str]:
    """The tables that hold versions, finished ones only, oldest first."""
    found = [t.name for t in spark.catalog.listTables() if t.name.startswith(f"{name}__v") and not t.isTemporary]
    return sorted(found, key=lambda t: int(t.removeprefix(f"{name}__v").split("_")[0]))


def write_version(rows: DataFrame, name: str, key: str, buckets: int = BUCKETS, row_group_bytes: int = ROW_GROUP_BYTES, dealt: bool = False) -> str:
    """Write the rows as a further version of a table and make it the one that counts; its name.

    ``dealt``: the rows already come in as many partitions by the key, so that each task writes one bucket.
    """
    spark = rows.sparkSession
    last = versions(spark, name)
    number = int(last[-1].removeprefix(f"{name}__v").split("_")[0]) + 1 if last else 1
    version = f"{name}__v{number}_{uuid.uuid4().hex[:8]}"  # what an interrupted write has left never stands in the way
    own = rows if dealt else rows.repartition(buckets, key)
    (
        own.sortWithinPartitions(key)
        .write.bucketBy(buckets, key)
        .sortBy(key)
        .option("compression", "zstd")
        .option("parquet.block.size", row_group_bytes)
        .option(f"parquet.bloom.filter.enabled#{key}", "true")
        .saveAsTable(version)
    )
    spark.sql(f"CREATE OR REPLACE VIEW `{name}` AS SELECT * FROM `{version}`")
    return version


def read(spark: SparkSession, name: str, schema: str | None = None) -> DataFrame:
    """The current version; with ``schema``, also the columns of a later schema that it lacks, as nulls."""
    rows = spark.table(name)
    wanted = [] if schema is None else spark.createDataFrame([], schema).schema.fields
    return rows.select("*", *(F.lit(None).cast(f.dataType).alias(f.name) for f in wanted if f.name not in rows.columns))


def newest_of_each(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    (n,) = unused(rows, "n")
    return rows.withColumn(n, F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col(n) == 1).drop(n)


def merged(old: DataFrame, new: DataFrame, key: str, version: str) -> DataFrame:
    """One row of each key: the one with the highest version, of equal ones the new. ``old`` has a row of each key, as versions have.

    Only the new rows are moved if the old ones are bucketed by the key. Columns that one side lacks are null; rows without a key stay.
    """
    for c in [c for c in new.columns if c not in old.columns]:
        old = old.withColumn(c, F.lit(None).cast(new.schema[c].dataType))
    for c in [c for c in old.columns if c not in new.columns]:
        new = new.withColumn(c, F.lit(None).cast(old.schema[c].dataType))
    new = newest_of_each(new.select(*(f"`{c}`" for c in old.columns)), key, [F.col(version).desc_nulls_last(), F.sha2(F.to_json(F.struct("*")), 256)])
    there, came, there_key, came_key = unused(old, "there", "came", "there_key", "came_key")
    left = old.select(F.col(key).alias(there_key), F.struct("*").alias(there))
    right = new.select(F.col(key).alias(came_key), F.struct("*").alias(came))
    both = left.join(right, F.col(there_key) == F.col(came_key), "full")
    stays = F.col(came).isNull() | (F.col(there).isNotNull() & F.coalesce(F.col(f"{there}.{version}") > F.col(f"{came}.{version}"), F.col(f"{came}.{version}").isNull() & F.col(f"{there}.{version}").isNotNull()))
    row = F.when(stays, F.col(there)).otherwise(F.col(came))
    return both.select(row.alias(there)).select(f"{there}.*")


def upsert(spark: SparkSession, name: str, new: DataFrame, key: str, version: str, buckets: int = BUCKETS) -> str:
    """Write a version with the new rows in it, and drop all but the last two; readers of the one before go on undisturbed."""
    made = write_version(merged(spark.table(name), new, key, version), name, key, buckets)
    for old in versions(spark, name)[:-2]:
        spark.sql(f"DROP TABLE IF EXISTS `{old}`")
    return made


def lookup(spark: SparkSession, name: str, key: str, values: list) -> DataFrame:
    """The rows of some keys; other buckets, and row groups that can't have them, are not read."""
    return spark.table(name).where(F.col(key).isin(values))


def store_files(files: DataFrame, name: str, buckets: int = BUCKETS, row_group_bytes: int = ROW_GROUP_BYTES) -> str:
    """Keep the contents of files (document_id, content and whatever else) for lookups by document."""
    return write_version(files, name, "document_id", buckets, row_group_bytes)
