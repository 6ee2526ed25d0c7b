"""History, filters, joins, counts, rankings and set operations over screenings and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from idsieve.functions import display, identifiers
from idsieve.operators import integrity, screening
from idsieve.plans.registry import query
from idsieve.sources import tables

LEVEL = "CASE o_orderstatus WHEN 'O' THEN 'LOW' WHEN 'F' THEN 'HIGH' WHEN 'P' THEN 'MEDIUM' END"
DECISION = "CASE o_orderstatus WHEN 'O' THEN 'clear' WHEN 'F' THEN 'high_risk' ELSE 'review' END"


def screenings(table):
    level = F.when(F.col("o_orderstatus") == "O", "LOW").when(F.col("o_orderstatus") == "F", "HIGH").when(F.col("o_orderstatus") == "P", "MEDIUM")
    return table("orders").select(F.col("o_orderkey").alias("screening_id"), F.col("o_custkey").alias("document_id"), F.bround(F.col("o_totalprice") % 100, 2).alias("risk_score"), level.alias("risk_level"), F.col("o_orderdate").alias("created_at"), F.col("o_orderpriority").alias("status"))


def documents(table):
    return table("customer").select(F.col("c_custkey").alias("document_id"), F.upper("c_mktsegment").alias("document_type"), F.col("c_name").alias("filename"))


@query(f"SELECT o_orderkey AS screening_id, o_custkey AS document_id, c_name AS filename, upper(c_mktsegment) AS document_type, {DECISION} AS decision, o_orderdate AS created_at FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def history_decisions(table):
    return screening.history(screenings(table), documents(table)).select("screening_id", "document_id", "filename", "document_type", "decision", "created_at")


@query(f"SELECT count(*) + 1284 AS total, count_if({DECISION} = 'clear') AS clear, count_if({DECISION} = 'review') AS review, count_if({DECISION} = 'high_risk') AS high_risk FROM orders")
def key_figures_with_baseline(table):
    return screening.key_figures(screenings(table).withColumn("decision", display.decision_of_level(F.col("risk_level"))), 1284)


@query("SELECT o_orderpriority AS status, count(*) AS n, round_even(100.0 * count(*) / sum(count(*)) OVER (), 1) AS share FROM orders GROUP BY 1")
def status_shares(table):
    return screening.shares(screenings(table), "status")


@query("SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE contains(lower(c_name), '00001') OR contains(lower(c_mktsegment), '00001') OR contains(lower(c_custkey::varchar), '00001')")
def search_any_column(table):
    return screening.search(table("customer"), "00001", ["c_name", "c_mktsegment", "c_custkey"]).select("c_custkey", "c_name", "c_mktsegment")


@query("SELECT c_custkey, count(*) OVER () AS total FROM customer WHERE contains(lower(c_name), '9') AND upper(c_mktsegment) = 'BUILDING'")
def filtered_with_total(table):
    rows = screening.search(table("customer"), "9", ["c_name"], c_mktsegment="building", c_nationkey="ALL")
    return screening.with_total(rows).select("c_custkey", "total")


@query("SELECT p_partkey FROM part WHERE contains(p_partkey::varchar || ' ' || p_name, 'a') AND p_brand = 'Brand#11' AND p_size > 10")
def audit_grid_filter(table):
    return table("part").where(F.concat_ws(" ", F.col("p_partkey").cast("string"), "p_name").contains("a") & (F.col("p_brand") == "Brand#11") & (F.col("p_size") > 10)).select("p_partkey")


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey = 7")
def point_lookup(table):
    return table("orders").where("o_orderkey = 7").limit(1).select("o_orderkey", "o_custkey", "o_totalprice")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('O', 'P')")
def registered_only(table):
    return table("orders").where(F.col("o_orderstatus").isin("O", "P")).select("o_orderkey")


@query(
    """WITH n AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '' WHEN c_custkey % 3 = 1 THEN c_name END AS full_name, CASE WHEN c_custkey % 4 = 0 THEN c_mktsegment ELSE '' END AS name,
    CASE WHEN c_custkey % 5 < 3 THEN 'G' || c_custkey ELSE '' END AS given, CASE WHEN c_custkey % 5 > 1 THEN 'S' || c_custkey END AS surname FROM customer)
    SELECT c_custkey, coalesce(nullif(full_name, ''), nullif(name, ''), nullif(concat_ws(' ', nullif(given, ''), nullif(surname, '')), '')) AS display_name FROM n"""
)
def display_names(table):
    k = F.col("c_custkey")
    rows = table("customer").select("c_custkey", F.when(k % 3 == 0, "").when(k % 3 == 1, F.col("c_name")).alias("f"), F.when(k % 4 == 0, F.col("c_mktsegment")).otherwise("").alias("n"), F.when(k % 5 < 3, F.concat(F.lit("G"), k.cast("string"))).otherwise("").alias("g"), F.when(k % 5 > 1, F.concat(F.lit("S"), k.cast("string"))).alias("s"))
    return rows.select("c_custkey", display.display_name(F.col("f"), F.col("n"), F.col("g"), F.col("s")).alias("display_name"))


@query("SELECT p_partkey, coalesce(nullif(CASE WHEN p_size % 2 = 0 THEN '' ELSE p_brand END, ''), 'Unknown') AS brand, coalesce(CASE WHEN p_size % 2 = 0 THEN '' END, 'Unknown') AS kept_empty FROM part")
def two_ways_of_defaulting(table):
    even = F.col("p_size") % 2 == 0
    return table("part").select("p_partkey", display.falsy(F.when(even, "").otherwise(F.col("p_brand")), F.lit("Unknown")).alias("brand"), F.coalesce(F.when(even, ""), F.lit("Unknown")).alias("kept_empty"))


@query("SELECT c_custkey, coalesce(CASE WHEN s_suppkey % 2 = 0 THEN s_name END, c_name) AS c_name, c_mktsegment FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey")
def detail_overlay(table):
    detail = table("supplier").select(F.col("s_suppkey").alias("c_custkey"), F.when(F.col("s_suppkey") % 2 == 0, F.col("s_name")).alias("c_name"))
    return screening.overlay(table("customer").select("c_custkey", "c_name", "c_mktsegment"), detail, "c_custkey", ["c_name"])


_FIELDS = "c_custkey, c_name AS full_name, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS nationality, CASE WHEN c_custkey % 3 = 0 THEN c_custkey::varchar ELSE '' END AS mrz_line"


def _fields(table):
    k = F.col("c_custkey")
    return table("customer").select("c_custkey", F.col("c_name").alias("full_name"), F.when(k % 2 == 0, F.col("c_mktsegment")).alias("nationality"), F.when(k % 3 == 0, k.cast("string")).otherwise("").alias("mrz_line"))


@query(
    f"""WITH f AS (SELECT {_FIELDS} FROM customer), u AS (SELECT c_custkey, 'full_name' AS field, full_name AS v FROM f UNION ALL SELECT c_custkey, 'nationality', nationality FROM f UNION ALL SELECT c_custkey, 'mrz_line', mrz_line FROM f)
    SELECT c_custkey, field, coalesce(nullif(v, ''), 'Not detected') AS value, CASE WHEN coalesce(v, '') = '' THEN 'missing' ELSE 'present' END AS status, CASE WHEN contains(field, 'mrz') THEN 'MRZ' ELSE 'OCR' END AS source FROM u"""
)
def extracted_fields(table):
    return screening.field_rows(_fields(table), "c_custkey", ["full_name", "nationality", "mrz_line"])


@query(f"WITH f AS (SELECT {_FIELDS} FROM customer) SELECT c_custkey, 1 + (nationality IS NOT NULL)::int + (mrz_line <> '')::int AS present, concat_ws(', ', CASE WHEN mrz_line = '' THEN 'mrz_line' END, CASE WHEN nationality IS NULL THEN 'nationality' END) AS missing FROM f")
def missing_fields(table):
    return screening.missing_names(screening.field_rows(_fields(table), "c_custkey", ["full_name", "nationality", "mrz_line"]), "c_custkey").withColumn("present", F.col("present").cast("int"))


@query("SELECT o_orderkey AS screening_id, 'RISK-' || n AS code, r AS description FROM (SELECT o_orderkey, unnest(list_filter([CASE WHEN o_orderstatus = 'F' THEN 'invalid' END, CASE WHEN o_totalprice > 200000 THEN 'high value' END], lambda x: x IS NOT NULL)) AS r, generate_subscripts(list_filter([CASE WHEN o_orderstatus = 'F' THEN 'invalid' END, CASE WHEN o_totalprice > 200000 THEN 'high value' END], lambda x: x IS NOT NULL), 1) AS n FROM orders)")
def numbered_findings(table):
    reasons = F.array_compact(F.array(F.when(F.col("o_orderstatus") == "F", "invalid"), F.when(F.col("o_totalprice") > 200000, "high value")))
    return screening.findings(table("orders").select(F.col("o_orderkey").alias("screening_id"), reasons.alias("reasons")))


@query("SELECT o_orderkey, c_name, l_extendedprice FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN (SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) = 1) ON l_orderkey = o_orderkey")
def screening_detail(table):
    first = integrity.latest(table("lineitem"), "l_orderkey", [F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")]).select("l_orderkey", "l_extendedprice")
    orders, customer = table("orders"), table("customer")
    return orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(first, F.col("l_orderkey") == F.col("o_orderkey"), "left").select("o_orderkey", "c_name", "l_extendedprice")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def documents_without_screening(table):
    return table("customer").join(table("orders").where("o_orderstatus = 'P'"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey")


@query("SELECT user_id, event_id, event_type, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_audit_record(table):
    return integrity.latest(table("events"), "user_id", [F.col("ts").desc(), F.col("event_id").desc()]).select("user_id", "event_id", "event_type", "ts")


@query("SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS position FROM events")
def audit_timeline(table):
    return integrity.numbered(table("events"), "user_id", ["ts", "event_id"]).select("user_id", "event_id", "event_type", "position")


@query("SELECT ts::date AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def daily_timeline(table):
    return screening.timeline(table("events"), "ts", "event_type")


@query("SELECT source, count(*) AS n FROM documents GROUP BY 1 ORDER BY n DESC, source LIMIT 5")
def top_five_findings(table):
    return screening.top_values(table("documents"), "source", 5)


@query("SELECT l_returnflag AS kind, count(*) AS records, count_if(l_linestatus IN ('F', 'O')) AS registered, count_if(l_linestatus = 'O') AS pending, count_if(l_discount > 0.05 AND l_tax >= 0.01) AS flagged, count_if(l_tax < 0.01) AS unknown FROM lineitem GROUP BY 1")
def audit_counts(table):
    rows = table("lineitem").select(F.col("l_returnflag").alias("kind"), F.when(F.col("l_linestatus") == "O", "PENDING").otherwise("CONFIRMED").alias("status"), F.when(F.col("l_tax") >= 0.01, F.col("l_discount") > 0.05).alias("flagged"))
    return screening.audit_counts(rows, "kind")


@query("SELECT o_orderpriority AS kind, round_even(avg(o_totalprice / 1000), 2) AS seconds, round_even(100.0 * count_if(o_orderstatus = 'O') / count(*), 1) AS pass_rate FROM orders GROUP BY 1")
def pass_rates(table):
    rows = table("orders").select(F.col("o_orderpriority").alias("kind"), (F.col("o_totalprice") / 1000).alias("processing_seconds"), (F.col("o_orderstatus") == "O").alias("passed"))
    return screening.pass_rates(rows, "kind").withColumn("seconds", F.bround("seconds", 2))


@query("SELECT o_orderkey, s.step, CASE WHEN o_orderkey % 7 = 6 AND s.n = o_orderkey % 6 THEN 'failed' WHEN s.n < o_orderkey % 6 THEN 'done' WHEN s.n = o_orderkey % 6 THEN 'active' ELSE 'waiting' END AS status FROM orders, (VALUES (0, 'upload'), (1, 'read'), (2, 'validate'), (3, 'compare'), (4, 'register')) s(n, step)")
def step_statuses(table):
    rows = table("orders").select("o_orderkey", (F.col("o_orderkey") % 6).alias("current"), (F.col("o_orderkey") % 7 == 6).alias("failed"))
    return screening.step_rows(rows, "o_orderkey", ["upload", "read", "validate", "compare", "register"])


@query("SELECT 'AUD-' || upper(substring(sha256(page_id::varchar), 1, 8)) AS audit_id, page_id::varchar AS screening_id, sha256(html) AS document_hash, NULL AS blockchain_tx, row_number() OVER (ORDER BY fetched DESC, page_id) AS position FROM (SELECT page_id, html, page_id % 50 AS fetched FROM pages) ORDER BY position LIMIT 20")
def newest_audit_records(table):
    """Audit records of files by the hash of their content, the newest twenty first."""
    rows = table("pages").select(F.col("page_id").cast("string").alias("screening_id"), F.encode("html", "UTF-8").alias("content"), (F.col("page_id") % 50).alias("timestamp"), "page_id")
    return integrity.newest(integrity.audit_records(rows), [F.col("timestamp").desc(), F.col("page_id")], 20).select("audit_id", "screening_id", "document_hash", "blockchain_tx", "position")


@query("SELECT count(*) AS total, count_if(quality = 1) AS completed, count_if(coalesce(quality, 0) = 0) AS failed, count_if(n_chars < 500) AS low, count_if(n_chars BETWEEN 500 AND 2000) AS medium, count_if(n_chars > 2000) AS high, count_if(toxic = 1) AS tampering, count_if(lang = 'en') AS aadhaar, count_if(lang = 'de') AS passport FROM documents LEFT JOIN labels USING (doc_id)")
def evaluation_summary(table):
    n = F.col("n_chars")
    rows = table("documents").join(table("labels"), "doc_id", "left").select(
        F.when(F.col("quality") == 1, "COMPLETED").otherwise("FAILED").alias("status"), F.when(n < 500, "LOW").when(n <= 2000, "MEDIUM").when(n > 2000, "HIGH").alias("risk_level"), (F.col("toxic") == 1).alias("tampering_detected"), F.when(F.col("lang") == "en", "AADHAAR").when(F.col("lang") == "de", "PASSPORT").alias("document_type")
    )
    return screening.evaluation_summary(rows)


@query("SELECT o_orderkey, o_orderstatus FROM orders ORDER BY (o_orderstatus = 'F') DESC, o_orderkey LIMIT 1")
def featured_record(table):
    return table("orders").orderBy((F.col("o_orderstatus") == "F").desc(), "o_orderkey").limit(1).select("o_orderkey", "o_orderstatus")


@query("SELECT s_suppkey, s_name, row_number() OVER (ORDER BY lower(s_name), s_suppkey) AS position FROM supplier ORDER BY position LIMIT 7")
def first_seven_by_name(table):
    return integrity.newest(table("supplier"), [F.lower("s_name"), F.col("s_suppkey")], 7).select("s_suppkey", "s_name", "position")


@query("SELECT c_custkey AS id, c_name AS name, 'AADHAAR' AS document_type FROM customer UNION ALL SELECT s_suppkey, s_name, 'PASSPORT' FROM supplier")
def two_lists_together(table):
    a = table("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.lit("AADHAAR").alias("document_type"))
    return a.unionByName(table("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.lit("PASSPORT").alias("document_type")))


@query(
    """WITH old AS (SELECT o_custkey AS id, o_orderkey AS version, o_totalprice AS v FROM orders WHERE o_orderstatus = 'O' QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1),
    new AS (SELECT o_custkey AS id, o_orderkey AS version, o_totalprice AS v FROM orders WHERE o_orderstatus = 'F') SELECT id, version, v FROM (SELECT *, 0 AS n FROM old UNION ALL SELECT *, 1 FROM new) QUALIFY row_number() OVER (PARTITION BY id ORDER BY version DESC, n DESC) = 1"""
)
def upserted_records(table):
    rows = table("orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("version"), F.col("o_totalprice").alias("v"), "o_orderstatus")
    old = integrity.latest(rows.where("o_orderstatus = 'O'"), "id", [F.col("version").desc()])
    return tables.upserted(old, rows.where("o_orderstatus = 'F'"), "id", "version").select("id", "version", "v")


@query("SELECT 'DOC-' || upper(substring(sha256(page_id::varchar || chr(10) || url), 1, 8)) AS document_id, lower(regexp_extract(url, '\\.([A-Za-z0-9]+)$', 1)) AS extension, lower(regexp_extract(url, '\\.([A-Za-z0-9]+)$', 1)) IN ('png', 'jpg', 'jpeg', 'pdf') AS allowed FROM pages")
def minted_ids(table):
    return table("pages").select(identifiers.short_id("DOC-", F.col("page_id"), F.col("url")).alias("document_id"), tables.extension(F.col("url")).alias("extension"), tables.allowed(F.col("url")).alias("allowed"))


@query("SELECT o_orderkey AS filename, NULL AS document_type, coalesce(CASE WHEN o_orderstatus = 'F' THEN 'COMPLETED' END, 'FAILED') AS status, round_even(o_totalprice % 100, 2) AS risk_score FROM orders")
def evaluation_rows(table):
    rows = table("orders").select(F.col("o_orderkey").alias("filename"), F.when(F.col("o_orderstatus") == "F", "COMPLETED").alias("status"), F.bround(F.col("o_totalprice") % 100, 2).alias("risk_score"))
    return tables.evaluation_rows(rows).select("filename", "document_type", "status", "risk_score")


@query("SELECT o_orderkey, strftime(o_orderdate, '%d %b %Y') AS day, printf('%.1f%%', (o_orderkey % 1000) / 1000 * 100) AS percent, substring(sha256(o_orderkey::varchar), 1, 6) || '...' || right(sha256(o_orderkey::varchar), 4) AS short_hash FROM orders")
def formatted_texts(table):
    return table("orders").select("o_orderkey", display.day(F.col("o_orderdate")).alias("day"), display.percent((F.col("o_orderkey") % 1000) / 1000).alias("percent"), display.short_hash(F.sha2(F.col("o_orderkey").cast("string"), 256)).alias("short_hash"))


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'Clear' WHEN 'F' THEN 'High risk' ELSE 'Unknown' END AS badge, CASE WHEN o_orderpriority = '1-URGENT' THEN 'AADHAAR' ELSE upper(o_orderpriority) END AS document_type FROM orders")
def badges_and_types(table):
    kind = F.when(F.col("o_orderpriority") == "1-URGENT", "National ID").otherwise(F.col("o_orderpriority"))
    return table("orders").select("o_orderkey", display.badge(F.col("o_orderstatus"), {"O": "Clear", "F": "High risk"}).alias("badge"), display.backend_type(kind).alias("document_type"))


@query(
    """WITH r AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN 90 WHEN l_discount > 0.08 THEN 75 WHEN l_tax > 0.06 THEN 25 ELSE 10 END::double AS score FROM lineitem)
    SELECT *, CASE WHEN score >= 75 THEN 'HIGH' WHEN score >= 25 THEN 'MEDIUM' ELSE 'LOW' END AS level, CASE WHEN score < 25 THEN 'clear' WHEN score >= 70 THEN 'high_risk' ELSE 'review' END AS decision, CASE WHEN score >= 70 THEN 'HIGH' WHEN score >= 30 THEN 'MEDIUM' ELSE 'LOW' END AS ui_level FROM r"""
)
def screening_risk(table):
    r = screening.risk(F.when(F.col("l_returnflag") == "R", "INVALID").otherwise("VALID"), F.col("l_discount") > 0.08, F.col("l_tax") > 0.06)
    rows = table("lineitem").select("l_orderkey", "l_linenumber", r.alias("r"))
    return rows.select("l_orderkey", "l_linenumber", "r.score", "r.level", display.decision_of_score(F.col("r.level"), F.col("r.score")).alias("decision"), display.ui_level_of(F.col("r.score")).alias("ui_level"))


@query(
    """WITH p AS (SELECT a.vec_id, list_distance(a.embedding::double[], b.embedding::double[]) AS d FROM embeddings a LEFT JOIN embeddings b ON b.vec_id = a.vec_id + 1)
    SELECT vec_id, CASE WHEN d IS NULL THEN 'REVIEW' WHEN d <= 0.6 THEN 'MATCH' ELSE 'MISMATCH' END AS status, round(CASE WHEN d IS NULL THEN 0 ELSE greatest(0, least(1, 1 - d)) END, 6) AS confidence FROM p"""
)
def face_pairs(table):
    a, b = table("embeddings").select("vec_id", "embedding"), table("embeddings").select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    rows = a.join(b, "vec_id", "left").select("vec_id", screening.face_match(F.col("embedding"), F.col("other")).alias("m"))
    return rows.select("vec_id", "m.status", F.round("m.confidence", 6).alias("confidence"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity * 2 >= 85 THEN 'MATCH' WHEN l_quantity * 2 >= 70 THEN 'REVIEW' ELSE 'MISMATCH' END AS status, false AS watchlist_match FROM lineitem")
def face_status_of_similarity(table):
    return table("lineitem").select("l_orderkey", "l_linenumber", screening.face_status(F.col("l_quantity") * 2).alias("status"), F.lit(False).alias("watchlist_match"))


@query("SELECT p_partkey, list_sort(list_distinct(list_filter(string_split(p_name || p_brand, ''), lambda c: NOT regexp_matches(c, '^[A-Z0-9<]$')))) AS illegal, list_sort(list_distinct(list_concat(['png', p_brand], ['png', 'pdf']))) AS options FROM part")
def character_sets(table):
    chars = F.filter(F.split(F.concat("p_name", "p_brand"), ""), lambda c: ~c.rlike("^[A-Z0-9<]$"))
    return table("part").select("p_partkey", F.array_sort(F.array_distinct(chars)).alias("illegal"), F.array_sort(F.array_union(F.array(F.lit("png"), "p_brand"), F.array(F.lit("png"), F.lit("pdf")))).alias("options"))
