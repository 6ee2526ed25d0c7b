"""The stages of the pipeline, each on what the one before kept."""

import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from idsieve.llm import pieces, scratch
from tests.llm import test_decontaminate, test_ngram_join
from tests.llm.test_media_licence_toxicity import corpus
from tests.llm.tables import documents, write


def test_stages(spark, tmp_path):
    docs, labels = corpus(900)
    passage = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen"
    rows = [(i, t + f" number {i}") for i, t in docs]
    rows += [(2000, "some words before it " + passage.upper() + " and after"), (2001, "mail me at jane.doe@corp.example.com or 189.251.249.1"), (2002, None), (2003, "")]
    rows += [(3000 + i, t) for i, t in test_ngram_join.near_copies(25)]
    write(spark, tmp_path, "labels", labels, "doc_id long, quality int, toxic int")
    write(spark, tmp_path, "benchmark", [(1, passage)], "item_id long, text string")
    folder = documents(spark, tmp_path, rows)
    now, seen = spark.read.parquet(f"{folder}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        now = scratch.saved(stage(spark, now, folder), "test-pipeline")
        seen.append((name, now.columns, {r.doc_id: r.text for r in now.collect()}))
    names, columns, kept = zip(*seen, strict=True)
    assert list(names) == ["toxicity", "ngram_join", "decontamination", "surrogates", "sentencepiece"]
    assert all(c == spark.read.parquet(f"{folder}/documents.parquet").columns for c in columns[:-1]) and columns[-1] == [*columns[0], "ids", "n_tokens"]
    toxic = {i for i, _, t in labels if t}
    gone = {i for i, _ in rows} - set(kept[0])
    assert len(gone & toxic) > 0.95 * len(toxic) and len(gone - toxic) < 0.02 * len(rows) and not gone & {2000, 2001, 2002, 2003}
    first = [(i, t) for i, t in rows if i in kept[0]]
    classes = {(c, i if size == 1 else None) for i, c, _, size in test_ngram_join.expected(first)}
    assert len(kept[1]) == len(classes) and set(kept[1]) <= set(kept[0])
    leaks = {i for i, *_ in test_decontaminate.expected([(i, t) for i, t in kept[1].items()], [(1, passage)])}
    assert leaks == {2000} and set(kept[2]) == set(kept[1]) - leaks
    assert set(kept[3]) == set(kept[2]) and not re.search(r"jane|corp|189\.251", kept[3][2001]) and kept[3][2002] is None
    assert all(kept[3][i] == kept[2][i] for i in kept[2] if i != 2001)
    import public_tokenizers

    back = pieces.decoded(now.drop("text"), public_tokenizers.path("piece_bpe_32k.model"))
    assert {r.doc_id: r.text for r in back.collect()} == {i: t or "" for i, t in kept[3].items()}


def test_run_of_the_smallest_tables(spark, small_dir):
    out = corpus_pipeline.run(spark, small_dir)
    assert 0 < out.count() < spark.read.parquet(f"{small_dir}/documents.parquet").count()
    assert out.where("n_tokens = 0 AND n_chars > 0").isEmpty()


NAMES = ["toxicity", "key", "text_key", "keep_id", "bad_id", "node", "hits", "row", "n_entities", "ids", "n_tokens", "class_key"]


def test_odd_rows_and_clashing_names_in_every_stage(spark, tmp_path):
    """Null and empty texts, repeated rows, rows without id, long texts, and columns of names that operators use."""
    write(spark, tmp_path, "labels", [(1, None, None), (3, 1, 0)], "doc_id long, quality int, toxic int")
    write(spark, tmp_path, "benchmark", [(1, "a passage of a benchmark that is long enough to count here"), (2, None), (None, "x")], "item_id long, text string")
    rows = [(1, None), (1, None), (2, ""), (3, "fine words " * 20000), (None, "no id here at all but words"), (None, "no id here at all but words"), (4, "call +1 (767) 555-5699 now"), (4, "call +1 (767) 555-5699 now"), (None, None)]
    folder = documents(spark, tmp_path, rows)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for c in NAMES:
        docs = docs.withColumn(c, F.lit("x"))
    want = {"toxicity": 9, "ngram_join": 6, "decontamination": 9, "surrogates": 9, "sentencepiece": 9}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        made = {"ids", "n_tokens"} if name == "sentencepiece" else set()
        assert set(out.columns) == set(docs.columns) and (made or out.columns == docs.columns)
        found = out.collect()
        assert len(found) == want[name], name
        assert {r[c] for r in found for c in NAMES if c not in made} == {"x"}
        assert stage(spark, docs.limit(0), folder).collect() == []


def test_scratch_needs_a_shared_folder_on_a_cluster():
    class Conf(dict):
        def set(self, key, value):
            self[key] = value

    class Session:
        conf = Conf({"spark.master": "spark://host:7077"})

    with pytest.raises(ValueError):
        scratch.root(Session)
    Session.conf["spark.checkpoint.dir"] = "hdfs://x/y/"
    assert scratch.root(Session).startswith("hdfs://x/y/")
