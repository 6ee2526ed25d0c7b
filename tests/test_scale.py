"""Plans that stay within their limits on larger tables: no corpus is broadcast, and rows with much work are dealt to many tasks."""

import pytest

from idsieve.plans import catalog


def broadcasts(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("BroadcastExchange")


def test_words_of_pages_are_not_broadcast(spark, small_dir):
    assert broadcasts(catalog.QUERIES["labelled_values"](spark, small_dir)) == 1  # the table of labels


@pytest.mark.parametrize("name", ["machine_line_pairs", "machine_regions", "pooled_line_pairs", "pixels_against_prior"])
def test_exploded_rows_and_contents_are_not_broadcast(spark, small_dir, name):
    assert broadcasts(catalog.QUERIES[name](spark, small_dir)) == 0


@pytest.mark.parametrize("name", ["resident_cards_parsed", "resident_cards_validated", "pages_of_files", "files_examined", "passports_validated"])
def test_narrow_tables_are_dealt_to_all_cores(spark, small_dir, name):
    assert catalog.QUERIES[name](spark, small_dir).rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism


def test_a_visas_text_is_cut_into_lines_once(spark, small_dir):
    spark.conf.set("spark.sql.debug.maxToStringFields", 100000)
    try:
        plan = catalog.QUERIES["visas_parsed_and_validated"](spark, small_dir)._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.debug.maxToStringFields")
    assert plan.count("split(") <= 8 and plan.count("regexp_extract_all(") <= 8


def test_errors_of_a_validation_are_looked_for_once(spark, small_dir):
    spark.conf.set("spark.sql.debug.maxToStringFields", 100000)
    try:
        plan = catalog.QUERIES["visas_parsed_and_validated"](spark, small_dir)._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.debug.maxToStringFields")
    assert plan.count("A nationality has 2 to 40 letters") == 1


def test_lines_are_not_made_again_to_see_whether_they_have_words(spark, small_dir):
    spark.conf.set("spark.sql.debug.maxToStringFields", 100000)
    try:
        plan = catalog.QUERIES["pairs_from_words"](spark, small_dir)._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.debug.maxToStringFields")
    filters = [line for line in plan.splitlines() if "Filter " in line]
    assert filters and max(map(len, filters)) < 1000
