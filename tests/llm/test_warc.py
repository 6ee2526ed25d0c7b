"""Derivatives against the same SQL in DuckDB, and records through files."""

import gzip
import time

import duckdb
from pyspark.sql import functions as F

from idsieve.llm import warc
from tests.llm.tables import write

PAGES = "page_id long, url string, html string, block string, title string"
ODD = [
    (1, "http://a/1", "<html lang=\"de\"><head><title>A &amp; B\n c</title><script>var x='</p>';</script></head><body><p>One<br>two&nbsp;three</p><!-- no <p>text</p> --><div>&lt;b&gt; &#65;&#x1F600; &#99999999; &amp;lt;</div><a href=\"/x\">l</a><a class=q href=\"y\">m</a></body></html>"),
    (1, "http://a/1", "<p>same id"),
    (2, None, None),
    (3, "", ""),
    (None, "http://b", "plain < text > & no tags"),
    (5, "http://c", "<style>p{}</style>" + "word " * 20000 + "<p>end"),
    (5, "http://c", "<p>twice"),
    (5, "http://c", "<p>twice"),
]


ODD += [
    (6, "http://d", "<HTML class=x lang='fr'><title>A &copy; &eacute;&mdash;B</title><a href='/x'>one</a> <a href=/y title=\"x>y\">two</a> <a class=k data-href=no>three</a><p title=it's>four</p> &amp;copy; &unknown; &copy &CounterClockwiseContourIntegral;"),
    (7, "http://e", "seen <!-- never closed <p>gone</p>"),
    (8, "http://f", "seen <script>never closed <p>gone"),
    (9, "http://g", "<p a=b c=\"d>e\" f='g>h'>text</p><br /><hr/>more <title>late"),
]


def table(spark, folder, rows):
    return write(spark, folder, "pages", [(*r, "b", "t") for r in rows], PAGES)


def test_odd_pages_like_sql(spark, tmp_path):
    folder = table(spark, tmp_path, ODD)
    have = warc.op2_warc(spark, folder)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{folder}/pages.parquet/*.parquet'")
    want = con.execute(warc.OP2_SQL)
    columns = [d[0] for d in want.description]
    assert sorted(have.columns) == sorted(columns)
    assert sorted(map(tuple, have.select(*columns).collect()), key=str) == sorted(want.fetchall(), key=str)


def test_text_of_a_page(spark, tmp_path):
    records = warc.derivatives(warc.responses_from_pages(spark.read.parquet(table(spark, tmp_path, ODD) + "/pages.parquet")))
    block = records.where("page_id = 1 AND type = 'conversion' AND block LIKE '%three%'").first().block
    assert block == "One\ntwo three\n<b> A\U0001f600 &#99999999; &lt;\nlm"


def test_empty_table(spark, tmp_path):
    assert warc.op2_warc(spark, table(spark, tmp_path, [])).collect() == []


def test_records_through_files(spark, tmp_path):
    pages = spark.read.parquet(table(spark, tmp_path, ODD[:2]) + "/pages.parquet")
    responses = warc.responses_from_pages(pages).drop("page_id")
    warc.write_warc(responses.unionByName(warc.derivatives(responses).drop("title", "n_links"), allowMissingColumns=True), str(tmp_path / "out"))
    back = warc.read_warc(spark, str(tmp_path / "out"))
    assert back.count() == 6
    again = warc.derivatives(back.where("type = 'response'"))
    want = {(r.record_id, r.refers_to, bytes(r.block).decode()) for r in back.where("type != 'response'").collect()}
    assert {(r.record_id, r.refers_to, r.block) for r in again.collect()} == want
    meta = next(b for _, _, b in want if "title: A" in b)
    assert "source-header: Content-Type: text/html; charset=utf-8\r\n" in meta and "source-payload-digest: sha256:" in meta and "outlink: /x\r\n" in meta


def record(block, *fields, length=None):
    head = ["WARC/1.1", *fields, f"Content-Length: {len(block) if length is None else length}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def response(n, http, body):
    return record(http.encode() + b"\r\n\r\n" + body, "WARC-Type: response", f"WARC-Record-ID: <urn:{n}>", "WARC-Target-URI: http://a/\u00e9", "X-Other: one", "X-Other: two", "X-Folded: a", " b")


INNER = b"<p>x</p>\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc"
HTTP = "HTTP/1.1 200 OK\r\nSet-Cookie: a=1\r\nSet-Cookie: b=2\r\nX-Long: one\r\n\t two\r\nContent-Type: text/html; charset={}"


def test_blocks_are_as_long_as_they_say(spark, tmp_path):
    """A record in a body, bytes that are no text, records in and across gzip members, and folded and repeated fields."""
    utf8, latin, binary = response(1, HTTP.format("utf-8"), INNER), response(2, HTTP.format("ISO-8859-1"), b"caf\xe9 <b>x</b>"), response(3, "HTTP/1.0 200 OK\nA: b".replace("\n", "\r\n"), bytes(range(256)))
    whole = utf8 + latin + binary
    folder = tmp_path / "files"
    folder.mkdir()
    (folder / "a.warc").write_bytes(whole)
    (folder / "b.warc.gz").write_bytes(b"".join(map(gzip.compress, (utf8, latin, binary))))
    (folder / "c.warc.gz").write_bytes(gzip.compress(whole[:100]) + gzip.compress(whole[100:777]) + gzip.compress(whole[777:]))
    rows = warc.read_warc(spark, str(folder)).collect()
    assert len(rows) == 9 and {r.error for r in rows} == {None} and {r.target_uri for r in rows} == {"http://a/\u00e9"}
    blocks = {r.record_id: bytes(r.block) for r in rows}
    assert blocks["<urn:1>"].endswith(INNER) and blocks["<urn:3>"].endswith(bytes(range(256)))
    names = [(h.name, h.value) for h in rows[0].headers]
    assert ("X-Other", "one") in names and ("X-Other", "two") in names and ("X-Folded", "a b") in names
    made = {(r.refers_to, r.type): r.block for r in warc.derivatives(warc.read_warc(spark, str(folder / "a.warc"))).collect()}
    assert made["<urn:1>", "conversion"].startswith("x\n") and made["<urn:2>", "conversion"] == "café x" and "\ufffd" in made["<urn:3>", "conversion"]
    lines = made["<urn:1>", "metadata"].split("\r\n")
    assert [x for x in lines if x.startswith("source-header: ")] == ["source-header: " + x for x in ("HTTP/1.1 200 OK", "Set-Cookie: a=1", "Set-Cookie: b=2", "X-Long: one two", "Content-Type: text/html; charset=utf-8")]


def test_damaged_files(spark, tmp_path):
    good = response(1, "HTTP/1.1 200 OK", b"fine")
    files = {"cut": good + response(2, "HTTP/1.1 200 OK", b"0123456789")[:-8], "other": good + b"no record\n", "length": record(b"x", "WARC-Type: response", length="much"), "empty": b"", "gz": gzip.compress(good * 50)[:-20]}
    for name, raw in files.items():
        (tmp_path / f"{name}.warc").write_bytes(raw)
    got = {n: [r.error for r in warc.read_warc(spark, f"{tmp_path}/{n}.warc").collect()] for n in files}
    assert got["cut"] == [None, "breaks off"] and got["other"] == [None, "no record begins here"] and got["length"] == ["no length"] and got["empty"] == []
    assert got["gz"][-1] == "breaks off"


def test_compressed_files_and_clashing_names(spark, tmp_path):
    responses = warc.responses_from_pages(spark.read.parquet(table(spark, tmp_path, ODD) + "/pages.parquet"))
    warc.write_warc(warc.derivatives(responses), str(tmp_path / "out"), compressed=True)
    assert warc.read_warc(spark, str(tmp_path / "out")).where("error IS NULL").count() == 2 * len(ODD)
    more = responses.select("*", *(F.lit("x").alias(c) for c in ("head", "body", "source_id", "record", "links", "title")))
    made = warc.derivatives(more)
    assert {(r.head, r.body, r.source_id, r.record, r.links) for r in made.collect()} == {("x",) * 5}
    columns = ["page_id", "type", "record_id", "title", "block"]
    assert sorted(map(tuple, made.select(columns).collect()), key=str) == sorted(map(tuple, warc.derivatives(responses).select(columns).collect()), key=str)


def test_all_forms_of_attributes_and_characters(spark, tmp_path):
    records = warc.derivatives(warc.responses_from_pages(spark.read.parquet(table(spark, tmp_path, ODD) + "/pages.parquet").where("page_id BETWEEN 6 AND 9")))
    text = {r.target_uri: r.block for r in records.where("type = 'conversion'").collect()}
    assert text["http://d"] == "one two three\nfour\n&copy; &unknown; &copy ∳"
    assert text["http://e"] == text["http://f"] == "seen" and text["http://g"] == "text\nmore"
    first = records.where("type = 'metadata' AND target_uri = 'http://d'").first()
    assert first.title == "A © é—B" and first.n_links == 2 and "outlink: /x\r\noutlink: /y\r\n" in first.block and "language: fr\r\n" in first.block


def test_pages_full_of_openings_take_linear_time(spark, tmp_path):
    parts = ["<!--", "<script>", "<script ", "<title>", "<title", "<a ", "<a href=", '<a href="', "<p ", "<p x='", "<html ", "&amp", "&#1", "<", "="]
    rows = [(n, "u", part * (1_000_000 // len(part))) for n, part in enumerate(parts)] + [(99, "u", "&lt;" * 250_000)]
    began = time.time()
    assert warc.op2_warc(spark, table(spark, tmp_path, rows)).count() == 2 * len(rows)
    spent = time.time() - began
    assert spent < 60, spent


def test_blanks_are_collapsed_in_one_pass(spark):
    """Runs with an end of line become one, others a blank; hidden elements are looked for where a < stands."""
    import random
    import re

    r = random.Random(4)
    texts = ["", " ", "a\tb", "a \r\n\n \x0bb  c\f", "$1 \\ $2", *("".join(r.choice(" \t\r\f\x0b\n\nab $\\") for _ in range(25)) for _ in range(300))]
    rows = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "n int, t string").selectExpr("n", f"{warc.tidy('t')} AS x").collect()
    want = [re.sub("[ \t\r\f\x0b\n]+", lambda m: "\n" if "\n" in m[0] else " ", t).strip("\n ") for t in texts]
    assert [x.x for x in sorted(rows)] == want
    assert warc._UNSEEN.count("<!--") == 0 and warc._UNSEEN.startswith("(?is)<(?:!--")
