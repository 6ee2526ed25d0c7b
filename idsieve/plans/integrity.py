"""Prior records, registration, verdicts and the ledger, with events as audit records and ledger events."""

from __future__ import annotations

from pyspark.sql import functions as F

from idsieve.operators import integrity
from idsieve.plans.registry import query

_RECORDS = """WITH r AS (SELECT event_id AS record_id, ts, CASE WHEN event_type IN ('signup', 'view', 'purchase') THEN CASE WHEN event_type = 'view' THEN 'REUSED' ELSE 'CONFIRMED' END ELSE 'FAILED' END AS status, 'h' || (event_id % 700) AS document_hash, user_id AS identity_key, event_type AS identity_type FROM events)"""


def records(table):
    e = F.col("event_type")
    status = F.when(e == "view", "REUSED").when(e.isin("signup", "purchase"), "CONFIRMED").otherwise("FAILED")
    return table("events").select(F.col("event_id").alias("record_id"), "ts", status.alias("status"), F.concat(F.lit("h"), (F.col("event_id") % 700).cast("string")).alias("document_hash"), F.col("user_id").alias("identity_key"), e.alias("identity_type"))


_PRIOR = f"""{_RECORDS}, p AS (SELECT *, last_value(CASE WHEN status <> 'FAILED' THEN {{'record_id': record_id, 'h': document_hash}} END IGNORE NULLS) OVER (PARTITION BY document_hash ORDER BY ts, record_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS a,
    last_value(CASE WHEN status <> 'FAILED' THEN {{'record_id': record_id, 'h': document_hash}} END IGNORE NULLS) OVER (PARTITION BY identity_type, identity_key ORDER BY ts, record_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM r),
    c AS (SELECT record_id, document_hash, coalesce(a, b).record_id AS prior_id, coalesce(a, b).h AS prior_hash FROM p), s AS (SELECT *, CASE WHEN prior_hash IS NULL THEN 'NEW' WHEN prior_hash = document_hash THEN 'UNCHANGED' ELSE 'MISMATCH' END AS integrity FROM c)"""


def classified(table):
    rows = integrity.with_prior(records(table), ["ts", "record_id"], F.to_date("ts"))
    return rows.withColumn("integrity", integrity.classification(F.col("document_hash"), F.col("prior.document_hash")))


@query(f"{_PRIOR} SELECT record_id, prior_id, integrity FROM s")
def prior_records(table):
    return classified(table).select("record_id", F.col("prior.record_id").alias("prior_id"), "integrity")


@query(
    f"""{_PRIOR} SELECT record_id, CASE WHEN integrity = 'MISMATCH' THEN greatest(10 + record_id % 90, 90) ELSE 10 + record_id % 90 END::double AS score,
    CASE WHEN integrity = 'MISMATCH' THEN 'MISMATCH' WHEN integrity = 'UNCHANGED' THEN 'REUSED' WHEN record_id % 11 = 0 THEN 'PENDING' WHEN record_id % 7 > 0 THEN 'CONFIRMED' ELSE 'FAILED' END AS blockchain_status,
    CASE WHEN integrity = 'MISMATCH' THEN 1 ELSE 0 END AS reasons FROM s"""
)
def registration_outcomes(table):
    k, s = F.col("record_id"), F.col("integrity")
    error = F.when(k % 11 == 0, "no node")
    reasons = integrity.change_reasons(s, {"content": (F.col("document_hash"), F.col("prior.document_hash"))})
    return classified(table).select("record_id", integrity.escalated(s, (10 + k % 90).cast("double")).alias("score"), integrity.registration(s, F.when(k % 7 > 0, 1).otherwise(0), error).alias("blockchain_status"), F.size(reasons).alias("reasons"))


@query("SELECT event_id, CASE WHEN event_type = 'view' THEN 'CONFIRMED' WHEN event_id % 5 = 0 THEN 'PENDING' WHEN event_id % 3 > 0 THEN 'CONFIRMED' ELSE 'FAILED' END AS status FROM events")
def retried_registrations(table):
    k = F.col("event_id")
    return table("events").select("event_id", integrity.retried(F.when(F.col("event_type") == "view", "CONFIRMED").otherwise("REUSED"), F.when(k % 3 > 0, 1).otherwise(0), F.when(k % 5 == 0, "down")).alias("status"))


@query(
    """WITH v AS (SELECT event_id, 'h' || event_id % 3 AS uploaded, 'h' || event_id % 2 AS stored, CASE WHEN event_id % 5 > 0 THEN 'h' || event_id % 2 END AS chain, event_id % 7 > 0 AS confirmed FROM events),
    m AS (SELECT event_id, uploaded = stored AS hash_match, coalesce(confirmed AND chain = uploaded, false) AS chain_match FROM v)
    SELECT event_id, hash_match, chain_match, CASE WHEN hash_match AND chain_match THEN 'VERIFIED' ELSE 'FAILED' END AS status, CASE WHEN NOT hash_match THEN 'Content hash differs from the stored record' WHEN NOT chain_match THEN 'Ledger does not confirm this hash' END AS reason FROM m"""
)
def upload_verdicts(table):
    k = F.col("event_id")
    h = lambda n: F.concat(F.lit("h"), (k % n).cast("string"))
    return table("events").select("event_id", integrity.verdict(h(3), h(2), F.when(k % 5 > 0, h(2)), k % 7 > 0).alias("v")).select("event_id", "v.*")


_LEDGER = """WITH e AS (SELECT event_id AS seq, user_id AS id, CASE WHEN event_id % 4 = 0 THEN 'owner' ELSE 'clerk' END AS actor, CASE event_type WHEN 'signup' THEN 'store' WHEN 'purchase' THEN 'store' WHEN 'view' THEN 'verify' WHEN 'click' THEN 'verify' ELSE 'revoke' END AS action, 'h' || (event_id % 2) AS document_hash FROM events),
    l AS (SELECT *, count_if(action = 'store') OVER (PARTITION BY id ORDER BY seq) AS life FROM e), f AS (SELECT *, first_value(document_hash) OVER (PARTITION BY id, life ORDER BY seq) AS stored FROM l WHERE life > 0),
    s AS (SELECT *, CASE WHEN action = 'store' THEN 'REGISTERED' WHEN action = 'verify' AND document_hash = stored THEN 'VERIFIED' WHEN action = 'revoke' AND actor = 'owner' THEN 'REVOKED' END AS state FROM f),
    fold AS (SELECT id, arg_max(stored, seq) AS document_hash, arg_max(state, seq) AS status, max(CASE WHEN action = 'store' THEN seq END) AS stored_at, max(life) AS stores FROM s WHERE state IS NOT NULL GROUP BY 1)"""


def ledger_events(table):
    e = F.col("event_type")
    action = F.when(e.isin("signup", "purchase"), "store").when(e.isin("view", "click"), "verify").otherwise("revoke")
    return table("events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("id"), F.when(F.col("event_id") % 4 == 0, "owner").otherwise("clerk").alias("actor"), action.alias("action"), F.concat(F.lit("h"), (F.col("event_id") % 2).cast("string")).alias("document_hash"))


@query(f"{_LEDGER} SELECT id, document_hash, status, stored_at, stores FROM fold")
def ledger_state(table):
    return integrity.ledger_fold(ledger_events(table), "owner").select("id", "document_hash", "status", "stored_at", "stores")


@query(f"""{_LEDGER} SELECT c_custkey AS record_id, status AS chain_status, c_custkey % 3 > 0 AS payload_ok, CASE WHEN c_custkey % 3 > 0 AND coalesce(status <> 'REVOKED' AND document_hash = 'h1', false) THEN 'VERIFIED' ELSE 'FAILED' END AS verification FROM customer LEFT JOIN fold ON id = c_custkey""")
def records_against_ledger(table):
    k = F.col("c_custkey")
    rows = table("customer").select(k.alias("record_id"), F.col("c_name").alias("result_payload"), F.when(k % 3 > 0, F.sha2("c_name", 256)).otherwise("other").alias("record_hash"), F.lit("h1").alias("document_hash"))
    return integrity.verified_records(rows, integrity.ledger_fold(ledger_events(table), "owner")).select("record_id", "chain_status", "payload_ok", "verification")
