"""Bucketed versions: upserts that count whole or not at all, joins without an exchange, lookups of one bucket."""

import pytest
from pyspark.sql import functions as F

from idsieve.operators import screening
from idsieve.sources import store


@pytest.fixture
def named(spark):
    names = []

    def make(name):
        names.append(name)
        return name

    yield make
    for name in names:
        spark.sql(f"DROP VIEW IF EXISTS {name}")
        for version in store.versions(spark, name):
            spark.sql(f"DROP TABLE IF EXISTS {version}")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_upserts(spark, named):
    name = named("people")
    store.write_version(spark.createDataFrame([(1, "a", 1), (2, "b", 1), (3, "c", 5), (None, "n", 1)], "id long, name string, v int"), name, "id", buckets=4)
    new = spark.createDataFrame([(2, "B", 2, True), (2, "old", 1, None), (3, "late", 4, True), (4, "d", None, False), (1, "same", 1, None)], "id long, name string, v int, extra boolean")
    store.upsert(spark, name, new, "id", "v", buckets=4)
    assert rows_of(store.read(spark, name)) == sorted([(1, "same", 1, None), (2, "B", 2, True), (3, "c", 5, None), (4, "d", None, False), (None, "n", 1, None)], key=str)
    assert store.read(spark, name, "id long, later date").columns == ["id", "name", "v", "extra", "later"]
    # one that fails halfway leaves the table as it was
    before, held = rows_of(store.read(spark, name)), store.versions(spark, name)
    broken = new.withColumn("name", F.when(F.col("id") == 4, F.raise_error(F.lit("no"))).otherwise(F.col("name")).cast("string"))
    with pytest.raises(Exception, match="no"):
        store.upsert(spark, name, broken, "id", "v", buckets=4)
    assert rows_of(store.read(spark, name)) == before and store.versions(spark, name) == held
    for n in range(3):
        store.upsert(spark, name, spark.createDataFrame([(9, f"x{n}", n)], "id long, name string, v int"), "id", "v", buckets=4)
    assert len(store.versions(spark, name)) == 2 and (9, "x2", 2, None) in rows_of(store.read(spark, name))


def test_joins_without_exchange(spark, named):
    """The history of screenings and their documents, both by document."""
    a, b = named("screened_docs"), named("their_docs")
    store.write_version(spark.range(500).selectExpr("id AS document_id", "id AS screening_id", "'LOW' AS risk_level", "current_timestamp() AS created_at"), a, "document_id", buckets=8)
    store.write_version(spark.range(0, 500, 2).selectExpr("id AS document_id", "'f' AS filename"), b, "document_id", buckets=8)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = store.read(spark, a).join(store.read(spark, b), "document_id", "left")
        assert "Exchange" not in plan(joined) and joined.count() == 500
        counted = screening.history(store.read(spark, a), store.read(spark, b))
        assert plan(counted).count("Exchange") == 1  # the order of the result
        upserted = store.merged(store.read(spark, a), spark.range(5).selectExpr("id AS document_id", "7L AS screening_id"), "document_id", "screening_id")
        assert plan(upserted).count("Exchange hashpartitioning") == 1 and upserted.count() == 500  # of the new rows
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_lookup_of_a_file_reads_one_row_group(spark, named):
    name = named("file_contents")
    files = spark.range(4000).selectExpr("id AS document_id", "unhex(sha2(cast(id AS string), 512)) AS content").select("document_id", F.concat(*["content"] * 16).alias("content"))
    store.store_files(files, name, buckets=4, row_group_bytes=100_000)
    for wanted in (17, 2718):
        found = store.lookup(spark, name, "document_id", [wanted])
        assert bytes(found.first().content) == bytes(files.where(F.col("document_id") == wanted).first().content)
        found = store.lookup(spark, name, "document_id", [wanted]).select("content")
        found.collect()
        scan = found._jdf.queryExecution().executedPlan()
        metrics = {}

        def walk(node):
            kids = node.children()
            if "FileSourceScan" in node.getClass().getSimpleName():
                it = node.metrics().iterator()
                while it.hasNext():
                    entry = it.next()
                    metrics[entry._1()] = entry._2().value()
            for n in range(kids.size()):
                walk(kids.apply(n))

        walk(scan)
        assert 1 <= metrics["numOutputRows"] < 400, metrics  # of a thousand in the bucket's file and four in all
    assert store.lookup(spark, name, "document_id", [99999]).count() == 0
