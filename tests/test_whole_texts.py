"""Queries over all texts, with accents, spaced letters and nulls, against plain Python."""

import re

import pytest

from idsieve.plans import catalog

TEXTS = [
    None,
    "",
    " \n",
    "| Nom : É L I S E |\n~ F E M A L E ~\r\n»» née x y «\n2 3 4 5 A B",
    "caféa b c a b\x0bdéjà 1 2 3é 4 5 6",
    "été a b c d\n_a b c_\n- Straße 1 2 3 -",
    ": Año  de  nacimiento",
    "#| Date of birth 1 JAN 1990",
    "Prénom: the NAMEÉ",
    "ÉNAME",
    "Le nom the NAME est là",
    "plain name",
    "á" * 41 + " NAME",
]
CONVERSATIONS = [(n // 4, n // 2 % 2, "user" if n % 2 else "assistant", t) for n, t in enumerate([*TEXTS, *reversed(TEXTS)])]
LABELS = r"\b(?:NAME|ADDRESS|VID|GENDER|SEX)\b|\b(?:DATE|YEAR)\s*OF\s*BIRTH\b|\b[DY]\.?\s*O\.?\s*B\.?\b"


def write(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).repartition(3).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return str(folder)


def lines(text):
    out = []
    for line in re.split("\r\n|[\n\x0b\x0c\r\x85\u2028\u2029]", text or ""):
        line = re.sub(r"\s+", " ", line.strip(" "))
        line = re.sub(r"\s*[|_\-~»«]+$", "", re.sub(r"^[|_\-~»«]+\s*", "", line))
        for one in ("[A-Za-z]", "[0-9]"):
            line = re.sub(rf"(?:\b{one}\b[ \t]){{2,}}\b{one}\b", lambda m: re.sub(r"[ \t]", "", m[0]), line)
        if line.strip(" "):
            out.append(line.strip(" "))
    return out


def value(text):
    return re.sub(r"\s+", " ", re.sub(r"^[:\-.|#]+\s*", "", (text or "").strip(" "))).strip(" ")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    to = tmp_path_factory.mktemp("whole")
    write(spark, to, "documents", list(enumerate(TEXTS)), "doc_id long, text string")
    return write(spark, to, "conversations", CONVERSATIONS, "conv_id long, turn long, role string, text string")


def run(spark, folder, name):
    return sorted(map(tuple, catalog.QUERIES[name](spark, folder).collect()), key=str)


def test_lines(spark, folder):
    assert run(spark, folder, "text_lines") == sorted(((n, lines(t)) for n, t in enumerate(TEXTS)), key=str)


def test_labels_and_values(spark, folder):
    label = lambda t: None if t is None else len(t) <= 40 and bool(re.search(LABELS, t, re.IGNORECASE))
    assert run(spark, folder, "labels_and_values") == sorted(((c, n, role, label(t), value(t)) for c, n, role, t in CONVERSATIONS), key=str)


def test_richest_readings(spark, folder):
    pages = {}
    for conv, turn, role, t in CONVERSATIONS:
        pages.setdefault((conv, turn), []).append((role, t))
    best = {}
    for (conv, turn), own in sorted(pages.items()):
        rank = lambda x: (-sum(k in x[1].upper() for k in ("NAME", "THE")), -sum(c.isalnum() for c in x[1]), x)
        text = min((x for x in own if x[1] is not None), key=rank, default=(None, None))[1]
        if text and text.strip(" "):
            best.setdefault(conv, []).append(text)
    assert run(spark, folder, "richest_readings") == sorted(((c, "\n\n".join(t)) for c, t in best.items()), key=str)


@pytest.mark.parametrize(("name", "table"), [("text_lines", "documents"), ("labels_and_values", "conversations")])
def test_no_row_is_left_out(spark, small_dir, name, table):
    assert catalog.QUERIES[name](spark, small_dir).count() == spark.read.parquet(f"{small_dir}/{table}.parquet").count()


def test_lines_of_the_corpus(spark, small_dir):
    rows = {r.doc_id: lines(r.text) for r in spark.read.parquet(f"{small_dir}/documents.parquet").collect()}
    assert dict(run(spark, small_dir, "text_lines")) == rows
