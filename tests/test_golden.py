"""Known cases of the expressions and operators."""

import datetime
import functools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from idsieve.functions import dates, display, identifiers, mrz, text
from idsieve.operators import imaging, integrity, layout, outcome, parsers, screening, validation
from idsieve.sources import tables
from idsieve.streaming import ledger

LINE1 = "P<UTOERIKSSON<<ANNA<MARIA<<<<<<<<<<<<<<<<<<<"
LINE2 = "AB12345671UTO8504124F3201141<<<<<<<<<<<<<<04"
def as_of():
    return F.lit("2024-06-15 10:00:00").cast("timestamp")


def values(spark, *columns):
    return list(spark.range(1).select(*(c.alias(f"c{n}") for n, c in enumerate(columns))).first())


def test_check_digits(spark):
    assert values(spark, *(mrz.check_digit(F.lit(x)) for x in ("AB1234567", "850412", "320114", "<" * 14))) == ["1", "4", "1", "0"]


def test_line2(spark):
    broken = [LINE2[:at] + ("0" if LINE2[at] != "0" else "1") + LINE2[at + 1 :] for at in (9, 19, 27, 42, 43)]
    assert values(spark, mrz.valid_td3(F.lit(LINE2)), *(mrz.valid_td3(F.lit(b)) for b in broken)) == [True] + [False] * 5
    f = values(spark, mrz.passport_fields(F.lit(LINE1), F.lit(LINE2)))[0]
    assert (f.surname, f.given_names, f.gender, f.date_of_birth, f.expiry_date) == ("ERIKSSON", "ANNA MARIA", "Female", "12/04/1985", "14/01/2032")


def test_corrections(spark):
    wrong = LINE2[:3] + "Z" + LINE2[4:]
    nation = LINE2[:12] + "0" + LINE2[13:]
    assert values(spark, mrz.correct_td3(F.lit(wrong)), mrz.correct_td3(F.lit(nation)), mrz.correct_td3(F.lit("short"))) == [LINE2, LINE2, "SHORT"]


def test_mrz_dates(spark):
    assert values(spark, *(mrz.date_of(F.lit(x)) for x in ("490101", "500101", "991332", "9901"))) == ["01/01/2049", "01/01/1950", None, None]


def test_structure_errors(spark):
    cases = [(None, LINE2), (LINE1[:-1], LINE2), (LINE1, LINE2.replace("U", "-")), ("V" + LINE1[1:], LINE2), (LINE1.replace("<<", "<A"), LINE2), (LINE1, LINE2[:20] + "X" + LINE2[21:]), (LINE1, LINE2)]
    got = values(spark, *(mrz.error_of(F.lit(a).cast("string"), F.lit(b)) for a, b in cases))
    parts = ["two lines", "line 1 has", "no such line has: -", "begins with P", "parts surname", "the sex", None]
    assert all((g is None) if p is None else p in g for g, p in zip(got, parts, strict=True))


@pytest.mark.parametrize(("n", "ok"), [("234567890124", True), ("234567890123", False), ("999941057058", True), ("12a", False)])
def test_verhoeff(spark, n, ok):
    assert values(spark, identifiers.verhoeff_valid(F.lit(n))) == [ok]


def test_verhoeff_finds_single_digit_errors(spark):
    good = "234567890124"
    bad = [good[:i] + str((int(good[i]) + d) % 10) + good[i + 1 :] for i in range(12) for d in (1, 5)]
    rows = spark.createDataFrame([(b,) for b in bad], "n string")
    assert rows.where(identifiers.verhoeff_valid(F.col("n"))).count() == 0


def test_twelve_digits(spark):
    n = values(spark, identifiers.resident_number(F.lit("1234 5678 9012 3456 and 2345 6789 0124")))[0]
    assert tuple(n) == ("2345 6789 0124", True)


def test_text(spark):
    assert values(spark, text.collapse_spacing(F.lit("F E M A L E")), text.collapse_spacing(F.lit("A B cat")), text.collapse_spacing(F.lit("2 3 4 5"))) == ["FEMALE", "A B cat", "2345"]
    assert values(spark, text.garbled(F.lit("~~##!!a")), text.garbled(F.lit("12, Main-Road"))) == [True, False]


def test_address_stops(spark):
    card = "S/O Mohan\nx\nHouse 1\n## ~~ !!\nPune 411001\nafter"
    rows = spark.createDataFrame([(card,), ("Address: A\nB\nVID 1\nC",), ("nothing",)], "t string")
    assert [r[0] for r in rows.select(text.address(text.lines(F.col("t")))).collect()] == ["S/O Mohan, x, House 1, Pune 411001", "A, B", None]


def test_dates(spark):
    day = F.lit("2024-01-01").cast("date")
    assert values(spark, dates.spelt(F.lit("31OCT2025")), dates.spelt(F.lit("OCT 3 2025")), dates.spelt(F.lit("30 FEB 2025")), dates.any_format(F.lit("5/6/24"), day), dates.any_format(F.lit("5/6/25"), day)) == ["31/10/2025", "03/10/2025", None, "05/06/2024", "05/06/1925"]


def test_expiring_today_is_expired(spark):
    assert values(spark, validation.expiry_status(F.lit("15/06/2024"), as_of()), validation.expiry_status(F.lit("16/06/2024"), as_of()), validation.expiry_status(F.lit("x"), as_of())) == ["EXPIRED", "ACTIVE", "UNKNOWN"]


def test_passport_validation(spark):
    rows = spark.createDataFrame([(LINE1, LINE2, ""), (LINE1, LINE2[:43] + "9", "Passport No: K1234567"), (None, None, "Nationality: IND")], "line1 string, line2 string, text string")
    out = parsers.parse_passports(rows).select("mrz.status", validation.validate_passport(F.col("identity"), F.col("mrz"), as_of()).alias("v"), "identity.passport_number").collect()
    assert [r.status for r in out] == ["VALID", "INVALID", "NOT_FOUND"]
    assert [r.v.status for r in out] == ["VALID", "INVALID", "INVALID"] and out[0].v.validation_score == 100
    assert out[1].passport_number == "K1234567"


def test_risk(spark):
    cases = [("INVALID", False, False), ("VALID", True, False), ("VALID", False, True), ("VALID", False, False), (None, None, None)]
    got = values(spark, *(screening.risk(F.lit(a).cast("string"), F.lit(b).cast("boolean"), F.lit(c).cast("boolean")) for a, b, c in cases))
    assert [(g.score, g.level) for g in got] == [(90, "HIGH"), (75, "HIGH"), (25, "MEDIUM"), (10, "LOW"), (10, "LOW")]
    assert values(spark, *(display.decision_of_level(F.lit(x).cast("string")) for x in ("LOW", "HIGH", None))) == ["clear", "high_risk", "review"]


def test_score_rounding(spark):
    checks = lambda n, m: {str(i): F.lit(i < n) for i in range(m)}
    assert values(spark, validation.score(checks(6, 7)), validation.score(checks(5, 6))) == [86, 83]


def test_verdicts(spark):
    s = lambda x: F.lit(x).cast("string")
    got = values(spark, *(integrity.verdict(s(a), s(b), s(c), F.lit(d)) for a, b, c, d in (("a", "a", "a", True), ("b", "a", "a", True), ("a", "a", None, False))))
    assert [(g.status, g.chain_match) for g in got] == [("VERIFIED", True), ("FAILED", False), ("FAILED", False)]


def test_face(spark):
    v = lambda x: F.array(F.lit(float(x)), F.lit(0.0))
    got = values(spark, screening.face_match(v(0), v(0.5)), screening.face_match(v(0), v(1.4)), screening.face_match(F.lit(None).cast("array<double>"), v(1)))
    assert [(g.status, g.confidence) for g in got] == [("MATCH", 0.5), ("MISMATCH", 0.0), ("REVIEW", 0.0)]


def test_rows_are_anchored_to_their_first_word(spark):
    assert values(spark, layout.cluster_labels(F.array(*(F.lit(float(x)) for x in (1, 5, 14, 16, 29, 60))))) == [[0, 0, 0, 1, 1, 2]]


def test_stamp_gate(spark):
    gate = lambda *a: imaging.stamp_gate(*(F.lit(x) for x in a))
    assert values(spark, gate(2.0, 0.08, 0.05, "ADEQUATE"), gate(1.2, 0.2, 0.3, "ADEQUATE"), gate(5.0, 0.2, 0.3, "ADEQUATE")) == ["UNCERTAIN", "STAMP_DETECTED", "NO_STAMP_DETECTED"]


def drawn(stamps=1, height=700, width=1000):
    image = np.full((height, width, 3), 245, np.uint8)
    y, x = np.mgrid[:height, :width]
    for n in range(stamps):
        r = np.hypot(y - 200 - 300 * (n // 2), x - 250 - 450 * (n % 2))
        image[(np.abs(r - 90) < 5) | ((np.abs(r - 55) < 4))] = (170, 30, 40)
    return image


def test_drawn_stamps(spark):
    noise = np.random.default_rng(1).integers(-12, 12, (700, 1000, 1))
    pages = {"none": drawn(0), "one": drawn(1), "three": drawn(3)}
    rows = [(k, bytes(np.clip(v + noise, 0, 255).astype(np.uint8).tobytes()), *v.shape) for k, v in pages.items()]
    df = spark.createDataFrame(rows, "doc_id string, pixels binary, height int, width int, channels int")
    found = {r.doc_id: r for r in imaging.stamp_regions(imaging.ink_candidates(df)).collect()}
    assert {k: [x.region_id for x in r.regions] for k, r in found.items()} == {"none": [], "one": ["STAMP-01"], "three": ["STAMP-01", "STAMP-02", "STAMP-03"]}
    assert {k: r.status for k, r in found.items()} == {"none": "NO_STAMP_DETECTED", "one": "STAMP_DETECTED", "three": "STAMP_DETECTED"}


def test_components_are_joined_in_eight_directions():
    mask = np.array([[1, 0, 0, 1, 1], [0, 1, 0, 0, 0], [0, 0, 1, 0, 1], [0, 1, 0, 0, 1]], bool)
    assert sorted(imaging.regions(mask).tolist()) == [[0, 0, 3, 4, 4], [3, 0, 5, 1, 2], [4, 2, 5, 4, 2]]


def test_noise_of_a_pasted_block(spark):
    image = np.full((64, 64, 1), 128, np.uint8)
    image[16:32, 16:32, 0] = np.random.default_rng(2).integers(0, 255, (16, 16))
    rows = [("a", image.tobytes(), 64, 64, 1), ("none", None, 64, 64, 1), ("short", b"abc", 64, 64, 1), ("sizes", image.tobytes(), None, None, None)]
    df = spark.createDataFrame(rows, "doc_id string, pixels binary, height int, width int, channels int")
    got = {r.doc_id: r for r in imaging.block_statistics(df).collect()}
    variances = imaging.block_variances(image[:, :, 0].astype(float))
    assert variances.shape == (4, 4) and np.isclose(got["a"].noise_max, image[16:32, 16:32].var())
    assert [got[k].noise_max for k in ("none", "short", "sizes")] == [None] * 3
    other = df.select("doc_id", *(F.col(c).alias(f"other_{c}") for c in ("pixels", "height", "width", "channels")))
    assert {r.doc_id: r.status for r in imaging.compared(df.join(other, "doc_id")).collect()} == {"a": "IDENTICAL", "none": "UNAVAILABLE", "short": "UNAVAILABLE", "sizes": "UNAVAILABLE"}


def test_dataset_size_is_asserted(spark):
    files = spark.createDataFrame([("/x/B.png",), ("/x/a.JPG",)], "path string")
    assert [r.path for r in tables.dataset(files, 2).collect()] == ["/x/a.JPG", "/x/B.png"]
    with pytest.raises(Exception, match="expected 3 files"):
        tables.dataset(files, 3).collect()


def test_images_through_files(spark, tmp_path):
    for n in ("a.png", "b.JPG", "c.txt"):
        (tmp_path / n).write_bytes(n.encode())
    rows = tables.registered(tables.read_images(spark, str(tmp_path)), "Passport").collect()
    assert sorted(r.filename for r in rows) == ["a.png", "b.JPG"] and all(r.document_id.startswith("DOC-") and len(r.document_id) == 12 and r.document_type == "PASSPORT" for r in rows)


def test_evaluation_files(spark, tmp_path):
    tables.write_evaluation(spark.createDataFrame([("x", None)], "filename string, status string"), str(tmp_path / "e"))
    back = spark.read.option("header", "true").csv(str(tmp_path / "e/csv"))
    assert back.columns == tables.EVALUATION and back.first().status == "FAILED"


EVENTS = [(1, "a", "o", "verify", "h1"), (2, "a", "o", "store", "h1"), (3, "a", "x", "verify", "h2"), (4, "a", "x", "revoke", ""), (5, "a", "o", "revoke", ""), (6, "a", "x", "verify", "h1"), (7, "b", "x", "store", "h9"), (8, "b", "x", "store", "h8"), (9, "b", "o", "revoke", ""), (10, "c", "o", "revoke", "")]
SCHEMA = "seq long, id string, actor string, action string, document_hash string"


def plain_ledger(events, owner):
    """State of each id after its events, one after the other."""
    state = {}
    for seq, i, actor, action, digest in sorted(events):
        if action == "store":
            state[i] = (digest, "REGISTERED", actor, seq)
        elif i in state and action == "verify" and digest == state[i][0]:
            state[i] = (digest, "VERIFIED", *state[i][2:])
        elif i in state and action == "revoke" and actor == owner:
            state[i] = (state[i][0], "REVOKED", *state[i][2:])
    return state


def test_ledger_fold(spark):
    got = {r.id: (r.document_hash, r.status) for r in integrity.ledger_fold(spark.createDataFrame(EVENTS, SCHEMA), "o").collect()}
    assert got == {"a": ("h1", "VERIFIED"), "b": ("h8", "REVOKED")}


def test_ledger_stream_agrees_with_the_fold(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    schema = spark.createDataFrame([], SCHEMA).schema
    for part in (EVENTS[:5], EVENTS[5:]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(source))
        ledger.write_ledger(spark.readStream.schema(schema).parquet(str(source)), "o", out, str(tmp_path / "cp")).awaitTermination()
    # partial states that come twice change nothing
    ledger.ledger_partials(spark.createDataFrame(EVENTS[5:], SCHEMA), "o").write.parquet(f"{out}/batch=9")
    got = {r.id: (r.document_hash, r.status, r.recorder, r.stored_at) for r in ledger.read_ledger(spark, out).collect()}
    assert got == {"a": ("h1", "VERIFIED", "o", 2), "b": ("h8", "REVOKED", "x", 8)}


def test_ledger_states_of_random_events(spark):
    r = random.Random(3)
    events = [(n, r.choice("abcdefgh"), r.choice("oxy"), r.choice(["store", "verify", "verify", "revoke"]), r.choice(["h1", "h2", "h3"])) for n in range(400)]
    want = plain_ledger(events, "o")
    fold = integrity.ledger_fold(spark.createDataFrame(events, SCHEMA), "o").collect()
    assert {x.id: (x.document_hash, x.status, x.recorder, x.stored_at) for x in fold} == want and sum(x.stores for x in fold) == sum(e[3] == "store" for e in events)
    parts = [ledger.ledger_partials(spark.createDataFrame(events[a : a + 90], SCHEMA), "o") for a in range(0, 400, 90)]
    got = {x.id: (x.document_hash, x.status, x.recorder, x.stored_at) for x in ledger.ledger_state(functools.reduce(lambda a, b: a.union(b), reversed(parts))).collect()}
    assert got == want and len(want) == 8


def test_windowed_counts_of_a_stream(spark, tmp_path):
    t = lambda h, m: datetime.datetime(2024, 1, 1, h, m)
    schema = "ts timestamp, action string"
    spark.createDataFrame([(t(1, 5), "store"), (t(1, 50), "store"), (t(1, 59), "verify"), (t(3, 0), "store")], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    query = ledger.windowed_counts(stream).writeStream.outputMode("append").format("memory").queryName("counts").trigger(availableNow=True).start()
    query.awaitTermination()
    got = sorted((r.w.start.hour, r.action, r.n) for r in spark.table("counts").collect())
    assert got == [(1, "store", 2), (1, "verify", 1)]  # the window at 3 is still open


def test_prior_needs_a_registered_record(spark):
    t = lambda n: datetime.datetime(2024, 1, n)
    rows = [(1, t(1), "FAILED", "h1", "p", "k"), (2, t(2), "CONFIRMED", "h1", "p", "k"), (3, t(3), "CONFIRMED", "h2", "p", "k"), (4, t(4), "FAILED", "h2", "p", "z"), (5, t(5), "FAILED", None, None, None)]
    df = spark.createDataFrame(rows, "record_id long, ts timestamp, status string, document_hash string, identity_type string, identity_key string")
    out = integrity.with_prior(df, ["ts", "record_id"]).select("record_id", F.col("prior.record_id").alias("p"), integrity.classification(F.col("document_hash"), F.col("prior.document_hash")).alias("c"))
    assert sorted((r.record_id, r.p, r.c) for r in out.collect()) == [(1, None, "NEW"), (2, None, "NEW"), (3, 2, "MISMATCH"), (4, 3, "UNCHANGED"), (5, None, "NEW")]


GOOD = "AB12345671UTO8504124F3201141<<<<<<<<<<<<<<04"


def test_verdicts_of_machine_readable_lines(spark):
    """Passports whose lines are wrong have none; a visa's pair may be wrong; a line found in a visa's text is no pair and gives the gender."""
    name = lambda c: (c + "UTOERIKSSON<<ANNA").ljust(44, "<")
    bad = GOOD[:9] + "9" + GOOD[10:]
    rows = [
        ("passport", "PASSPORT", "", name("P<"), GOOD),
        ("passport wrong", "PASSPORT", "Passport No: K1234567", name("P<"), bad),
        ("passport without", "passport", "", None, None),
        ("visa", "VISA", "", name("V<"), GOOD),
        ("visa wrong", "VISA", "", name("V<"), bad),
        ("visa text", "VISA", "VISA\n" + GOOD, None, None),
        ("visa text wrong", "VISA", "VISA\n" + bad, None, None),
        ("card", "AADHAAR", "", name("P<"), GOOD),
        ("none", None, "", name("P<"), GOOD),
        ("empty", "", None, None, None),
    ]
    docs = spark.createDataFrame([(*r, 0.9, 0.9, "GIMP", True, ["STAMP_DETECTED"], "x" if r[0] == "visa" else None, "a", "b") for r in rows], "document_id string, document_type string, text string, line1 string, line2 string, ela double, noise double, software string, jpeg boolean, stamps array<string>, image_error string, source string, kind string")
    got = {r.document_id: r for r in outcome.screened(docs, F.lit("2024-06-15").cast("timestamp")).collect()}
    want = {"passport": "MATCH", "passport wrong": "NOT_PRESENT", "passport without": "NOT_PRESENT", "visa": "MATCH", "visa wrong": "MISMATCH", "visa text": "NOT_PRESENT", "visa text wrong": "NOT_PRESENT", "card": "NOT_PRESENT", "none": "NOT_PRESENT", "empty": "NOT_PRESENT"}
    assert {k: r.mrz_verification for k, r in got.items()} == want
    assert got["passport"].validation_status == "VALID" and got["passport"].stored_score == 75 and got["none"].validation_score == 0
    assert (got["visa"].tampering, got["visa"].stamp_status, got["visa wrong"].stamp_status) == (False, "INSUFFICIENT_EVIDENCE", "STAMP_DETECTED")
    assert got["passport wrong"].identity_number == "K1234567" and got["visa text"].identity_number == "AB1234567" and got["visa text wrong"].identity_number is None
    visas = spark.createDataFrame(rows, "document_id string, document_type string, text string, line1 string, line2 string").where("document_type = 'VISA'")
    parsed = {r.document_id: r for r in parsers.parse_visas(visas).collect()}
    assert {k: r.identity.gender for k, r in parsed.items()} == {"visa": None, "visa wrong": None, "visa text": "F", "visa text wrong": None}
    assert {k: r.mrz and r.mrz.status for k, r in parsed.items()} == {"visa": "VALID", "visa wrong": "INVALID", "visa text": None, "visa text wrong": None}
    plan = outcome.screened(spark.read.parquet("/root/testdata/sf0.001/customer.parquet").selectExpr("c_custkey AS document_id", "c_name AS document_type", "c_name AS text", "c_name AS line1", "c_name AS line2", "0.5D AS ela", "0.5D AS noise", "c_name AS software", "true AS jpeg", "array(c_name) AS stamps"), F.lit("2024-06-15").cast("timestamp"))
    assert plan._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1


def test_types_are_routed(spark):
    v = lambda n: F.struct(F.lit(n).alias("status"), F.lit(1).alias("validation_score"), F.lit("x").alias("expiry_status"), F.array().cast("array<string>").alias("errors"), F.array().cast("array<string>").alias("warnings"), F.create_map().cast("map<string,boolean>").alias("checks"))
    rows = spark.createDataFrame([("visa",), ("Aadhaar",), ("PASSPORT",), ("",), (None,), ("other",)], "t string")
    got = [r.s for r in rows.select(validation.routed(F.col("t"), v("P"), v("V"), v("A"))["status"].alias("s")).collect()]
    assert got == ["V", "A", "P", "P", "P", "INVALID"]


def test_ledger_snapshots(spark, tmp_path):
    """Compacting after any trigger, or being killed at it, changes no state; snapshots have rows by ids, not by events."""
    r, out = random.Random(8), str(tmp_path / "ledger")
    events = [(n, r.choice("abcd"), r.choice("oxy"), r.choice(["store", "verify", "revoke"]), f"h{r.randrange(60)}") for n in range(600)]
    r.shuffle(events)  # triggers bring events out of order, too
    state = lambda rows: {x.id: (x.document_hash, x.status, x.recorder, x.stored_at) for x in rows.collect()}
    assert ledger.compact(spark, out) is None and state(ledger.read_ledger(spark, out)) == {}
    for n in range(6):
        ledger.ledger_partials(spark.createDataFrame(events[100 * n : 100 * n + 100], SCHEMA), "o").write.parquet(f"{out}/batch={n}")
        want = plain_ledger(events[: 100 * n + 100], "o")
        assert state(ledger.read_ledger(spark, out)) == want
        if n in (1, 2, 4):
            # a snapshot that was not finished
            spark.createDataFrame([("a", "bad", 999, "x", None, None)], ledger.PARTIALS).write.parquet(f"{out}/upto={n + 100}")
            (tmp_path / "ledger" / f"upto={n + 100}" / "_SUCCESS").unlink()
            assert state(ledger.read_ledger(spark, out)) == want
            assert ledger.compact(spark, out) == n and state(ledger.read_ledger(spark, out)) == want
    parts, covered, later = ledger.ledger_parts(spark, out)
    assert (covered, later) == (4, [5]) and not (tmp_path / "ledger" / "batch=2").exists() and (tmp_path / "ledger" / "batch=4").exists()
    assert spark.read.parquet(f"{out}/upto=4").count() < 60 < ledger.ledger_partials(spark.createDataFrame(events[:500], SCHEMA), "o").count()


def test_columns_of_the_caller_stay(spark):
    """Operators use no names that a caller's columns have."""
    t = datetime.datetime(2024, 1, 1)
    rows = [(1, t, "CONFIRMED", "h1", "p", "k", *"abcdefgh"), (2, t, "CONFIRMED", "h2", "p", "k", *"abcdefgh")]
    df = spark.createDataFrame(rows, "record_id long, ts timestamp, status string, document_hash string, identity_type string, identity_key string, by_hash string, by_identity string, n string, when string, last string, carried string, own_document_hash string, came string")
    for period in (None, F.to_date("ts")):
        out = integrity.with_prior(df, ["ts", "record_id"], period)
        assert out.columns == [*df.columns, "prior"] and [tuple(r)[:14] for r in out.orderBy("record_id").collect()] == rows
    assert [tuple(r) for r in integrity.latest(df, "identity_key", [F.col("record_id")]).collect()] == rows[:1]
    assert [tuple(r) for r in tables.upserted(df, df, "record_id", "ts").orderBy("record_id").collect()] == rows
    cards = spark.createDataFrame([("Name: Anna Maria", "x", "y", "z", "w")], "text string, lines string, date string, number string, born string")
    assert parsers.parse_residents(cards, F.lit("2024-06-15").cast("date")).columns == [*cards.columns, "identity"]
    visas = spark.createDataFrame([("", None, None, "x", "y", "z")], "text string, line1 string, line2 string, grid string, second string, machine string")
    assert parsers.parse_visas(visas).columns == [*visas.columns, "identity", "mrz"]
