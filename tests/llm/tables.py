"""Small input tables."""

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, digest string, part string, score string"


def write(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).repartition(3).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return str(folder)


def documents(spark, folder, rows, name="documents"):
    """Rows of (doc_id, text), with the other columns and some whose names operators use for themselves."""
    full = [(i, t, "en", "src0", None if t is None else len(t), "x", "y", "z") for i, t in rows]
    return write(spark, folder, name, full, DOCUMENTS)
