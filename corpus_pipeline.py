"""Cleaning of a corpus: toxicity, near-duplicates, benchmark passages, personal data, tokens.

Every stage keeps all columns of its input, whatever their names, and takes an empty table to an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from idsieve.llm import decontaminate, ngram_join, pieces, scratch, surrogates, toxicity

TOXIC_FROM = 0.5  # score from which a document goes


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores below TOXIC_FROM.

    A null or empty text is one without words, which stays. Repeated rows stay or go together.
    """
    (score,) = scratch.unused(docs, "toxicity")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"))
    return toxicity.scored(docs, model, score).where(F.col(score) < TOXIC_FROM).drop(score)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of texts that are linked by 5-gram similarity: the least doc_id, nulls first.

    Texts without words all stay, but of rows with equal doc_id and text one does.
    """
    return ngram_join.one_of_each_class(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark. Null and empty texts have none; repeated rows stay or go together."""
    return decontaminate.without_benchmark(docs, _table(spark, sf_dir, "benchmark"))


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with surrogates in their texts under the session's key, and n_chars counted anew.

    A null text stays null, with null n_chars; equal texts stay equal.
    """
    (count,) = scratch.unused(docs, "n_entities")
    rows = surrogates.pseudonymised(docs, surrogates.session_key(spark), count).drop(count)
    return rows.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else rows


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with ``ids`` and ``n_tokens``, which take the place of columns so named; decoding gives the text back.

    A null or empty text has no ids; equal texts have equal ones.
    """
    import public_tokenizers

    model = public_tokenizers.path("piece_bpe_32k.model")
    return pieces.encoded(docs, model).withColumn("n_tokens", F.size("ids").cast("long"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("ngram_join", drop_near_duplicates),
    ("decontamination", drop_benchmark),
    ("surrogates", replace_personal_data),
    ("sentencepiece", tokenise),
]

#: Classifier, joins on fingerprints and tokenisation are beyond SQL; the stages have brute-force tests.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each written and read again."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
