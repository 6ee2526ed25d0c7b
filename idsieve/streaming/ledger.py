"""The ledger as a stream: partial states of each trigger are appended to a table, and a view folds them.

A partial state is a row of maxima by id and hash, so states combine in any order and a trigger that is written twice
changes nothing. The stream itself keeps no state and needs no Python rows.

Each trigger has a folder of its own, ``batch=N``. From time to time ``compact`` folds them to a snapshot, ``upto=N``, which keeps of each id
only what a later event may still turn to: reading takes the last finished snapshot and the triggers after it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from idsieve.operators.integrity import combined_partials, ledger_partials, ledger_state

PARTIALS = "id string, document_hash string, stored long, recorder string, verified long, revoked long"


def write_ledger(events: DataFrame, owner: str, path: str, checkpoint: str) -> StreamingQuery:
    """Start a query that appends the partial states of each trigger of a stream of events below ``path``, once for what is there."""

    def put(batch: DataFrame, number: int) -> None:
        ledger_partials(batch, owner).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return events.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def snapshot(partials: DataFrame) -> DataFrame:
    """Partial states with the same ledger_state, now and together with whatever further ones, but only those that matter.

    What was before the last store of an id never counts again, so of an id its last stored hash stays, and hashes verified or
    revocations seen after that store: they may come before a store that is still to be read.
    """
    last = F.max("stored").over(Window.partitionBy("id"))
    rows = combined_partials(partials).withColumn("last", last)
    later = lambda c: F.when(F.col("last").isNull() | (F.col(c) > F.col("last")), F.col(c))
    kept = rows.where(F.col("last").isNull() | (F.col("stored") == F.col("last")) | (F.col("verified") > F.col("last")) | (F.col("revoked") > F.col("last")))
    own = F.col("stored") == F.col("last")
    return kept.select("id", "document_hash", F.when(own, F.col("stored")).alias("stored"), F.when(own, F.col("recorder")).alias("recorder"), later("verified").alias("verified"), later("revoked").alias("revoked"))


def _folders(spark: SparkSession, path: str, kind: str) -> list[int]:
    """Numbers of the finished folders ``kind=N``; one for each trigger or snapshot since the last compaction."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not fs.exists(root):
        return []
    found = [s.getPath() for s in fs.listStatus(root) if s.getPath().getName().startswith(f"{kind}=")]
    return sorted(int(p.getName().split("=")[1]) for p in found if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def ledger_parts(spark: SparkSession, path: str) -> tuple[DataFrame, int | None, list[int]]:
    """(partial states that together are the ledger, number of the snapshot among them, numbers of the triggers after it)."""
    covered = max(_folders(spark, path, "upto"), default=None)
    later = [n for n in _folders(spark, path, "batch") if covered is None or n > covered]
    folders = ([] if covered is None else [f"{path}/upto={covered}"]) + [f"{path}/batch={n}" for n in later]
    return spark.read.schema(PARTIALS).parquet(*folders) if folders else spark.createDataFrame([], PARTIALS), covered, later


def compact(spark: SparkSession, path: str) -> int | None:
    """Fold all finished triggers to a snapshot; the number of the last one that it covers, None if there is nothing to fold.

    A snapshot counts from the moment that it is finished, so a compaction that is killed changes nothing and may be run again. Folders
    that the snapshot before covered go then; those that this one covers stay for readers that have begun, until the next.
    """
    parts, before, later = ledger_parts(spark, path)
    if not later:
        return before
    snapshot(parts).write.mode("overwrite").parquet(f"{path}/upto={later[-1]}")
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    for kind, past in (("batch", lambda n: before is not None and n <= before), ("upto", lambda n: before is not None and n < before)):
        for n in _folders(spark, path, kind):
            if past(n):
                fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{kind}={n}"), True)
    return later[-1]


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    return ledger_state(ledger_parts(spark, path)[0])


def windowed_counts(events: DataFrame, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Events by window and action; rows later than the watermark are left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "action").agg(F.count("*").alias("n"))
