"""Content integrity: prior records, outcomes of registration, verdicts, and the ledger as a fold over its events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from idsieve.functions import identifiers
from idsieve.functions.columns import unused

REGISTERED = ["CONFIRMED", "REUSED"]
ESCALATED_SCORE = 90.0


def prior_record(records: DataFrame, key: list[str], order: list[str], prefix: str = "prior", period: Column | None = None) -> DataFrame:
    """The latest earlier registered record with the same key, as a struct column. A null key has none.

    period: a value that never falls in the given order, such as the day. With it, records of one key are looked at period by
    period, and only the last one of each is carried on, so that a key which many records share is no single task.
    """
    some = F.lit(True)
    for k in key:
        some = some & F.col(k).isNotNull()
    known = F.when(F.col("status").isin(REGISTERED), F.struct("record_id", "document_hash"))
    # rows without a key have nothing in common, so they are dealt out by what orders them
    apart = [F.when(~some, F.xxhash64(*order)), *([period] if period is not None else [])]
    before = Window.partitionBy(*key, *apart).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = records.withColumn(prefix, F.when(some, F.last(known, ignorenulls=True).over(before)))
    if period is None:
        return rows
    when, last, carried, *own = unused(rows, "when", "last", "carried", *(f"own_{k}" for k in key))
    ends = records.where(some).groupBy(*(F.col(k).alias(n) for k, n in zip(key, own, strict=True)), period.alias(when)).agg(F.max_by(known, F.when(known.isNotNull(), F.struct(*order))).alias(last))
    earlier = Window.partitionBy(*own).orderBy(when).rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn(carried, F.last(last, ignorenulls=True).over(earlier)).where(F.col(carried).isNotNull()).drop(last)
    same = period == F.col(when)
    for k, n in zip(key, own, strict=True):
        same = same & (F.col(k) == F.col(n))
    return rows.join(ends, same, "left").withColumn(prefix, F.coalesce(prefix, carried)).drop(when, carried, *own)


def with_prior(records: DataFrame, order: list[str], period: Column | None = None) -> DataFrame:
    """``prior``, in place of a column so named: by exact content first, else by identity (identity_type, identity_key)."""
    by_hash, by_identity = unused(records, "by_hash", "by_identity")
    rows = prior_record(records, ["document_hash"], order, by_hash, period)
    rows = prior_record(rows, ["identity_type", "identity_key"], order, by_identity, period)
    return rows.withColumn("prior", F.coalesce(by_hash, by_identity)).drop(by_hash, by_identity)


def classification(document_hash: Column, prior_hash: Column) -> Column:
    return F.when(prior_hash.isNull(), "NEW").when(prior_hash == document_hash, "UNCHANGED").otherwise("MISMATCH")


def escalated(status: Column, score: Column) -> Column:
    """A mismatch counts as high risk, whatever the screening gave."""
    return F.when(status == "MISMATCH", F.greatest(score, F.lit(ESCALATED_SCORE))).otherwise(score)


def change_reasons(status: Column, fields: dict[str, tuple[Column, Column]]) -> Column:
    """What differs from the prior record; a general sentence if no field tells."""
    found = F.array_compact(F.array(*(F.when(~new.eqNullSafe(old), F.lit(f"{name} changed")) for name, (new, old) in fields.items())))
    return F.when(status == "MISMATCH", F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("Document content changed")))).otherwise(F.array().cast("array<string>"))


def registration(status: Column, receipt_status: Column, error: Column) -> Column:
    """MISMATCH stays, unchanged content is REUSED, a receipt of 1 CONFIRMED, any other FAILED; an error leaves it PENDING."""
    return F.when(status == "MISMATCH", "MISMATCH").when(status == "UNCHANGED", "REUSED").when(error.isNotNull(), "PENDING").when(receipt_status == 1, "CONFIRMED").otherwise("FAILED")


def verdict(uploaded: Column, stored: Column, chain: Column, confirmed: Column) -> Column:
    """Struct of hash_match, chain_match, status and reason. Only a hash that both sides confirm is VERIFIED."""
    same, on_chain = F.coalesce(uploaded == stored, F.lit(False)), F.coalesce(confirmed & (chain == uploaded), F.lit(False))
    reason = F.when(~same, "Content hash differs from the stored record").when(~on_chain, "Ledger does not confirm this hash")
    return F.struct(same.alias("hash_match"), on_chain.alias("chain_match"), F.when(same & on_chain, "VERIFIED").otherwise("FAILED").alias("status"), reason.alias("reason"))


def ledger_partials(events: DataFrame, owner: str) -> DataFrame:
    """By id and hash the last seq of a store (and its actor), of a verification, and of a revocation by the owner.

    events: seq, id, actor, action and document_hash.
    """
    seq = lambda condition: F.when(condition, F.col("seq"))
    stored = seq(F.col("action") == "store")
    return events.groupBy("id", "document_hash").agg(F.max(stored).alias("stored"), F.max_by("actor", stored).alias("recorder"), F.max(seq((F.col("action") == "verify") & F.col("document_hash").isNotNull())).alias("verified"), F.max(seq((F.col("action") == "revoke") & (F.col("actor") == owner))).alias("revoked"))


def combined_partials(partials: DataFrame) -> DataFrame:
    return partials.groupBy("id", "document_hash").agg(F.max("stored").alias("stored"), F.max_by("recorder", "stored").alias("recorder"), F.max("verified").alias("verified"), F.max("revoked").alias("revoked"))


def ledger_state(partials: DataFrame) -> DataFrame:
    """id, document_hash, status, recorder and stored_at of each id with a stored record, from all partial states.

    The last store begins the record anew; after it the owner's revocation or a verification of its own hash counts,
    whichever is later.
    """
    last = combined_partials(partials).groupBy("id").agg(F.max_by(F.struct("document_hash", "stored", "recorder", "verified"), "stored").alias("s"), F.max("revoked").alias("revoked")).where(F.col("s.stored").isNotNull())
    verified = F.when(F.col("s.verified") > F.col("s.stored"), F.struct(F.col("s.verified").alias("at"), F.lit("VERIFIED").alias("status")))
    revoked = F.when(F.col("revoked") > F.col("s.stored"), F.struct(F.col("revoked").alias("at"), F.lit("REVOKED").alias("status")))
    latest = F.greatest(F.struct(F.col("s.stored").alias("at"), F.lit("REGISTERED").alias("status")), verified, revoked)
    return last.select("id", "s.document_hash", latest["status"].alias("status"), "s.recorder", F.col("s.stored").alias("stored_at"))


def ledger_fold(events: DataFrame, owner: str) -> DataFrame:
    """The state of each id after its events (seq, id, actor, action, document_hash): hash, status, recorder, stored_at and stores.

    ``store`` overwrites whatever was there, ``verify`` sets VERIFIED where the hash is the stored one (after a
    revocation too), ``revoke`` counts from the owner only; the last two need a stored record. Maxima by id and hash tell it all, so
    events of one id are aggregated where they are and never put in order.
    """
    stores = events.groupBy(F.col("id").alias("own")).agg(F.count_if(F.col("action") == "store").alias("stores"))
    return ledger_state(ledger_partials(events, owner)).join(stores, F.col("id").eqNullSafe(F.col("own"))).drop("own")


def verified_records(records: DataFrame, ledger: DataFrame) -> DataFrame:
    """Each record with its payload hashed anew and held against its own hash and the ledger's."""
    joined = records.join(ledger.select(F.col("id").alias("record_id"), F.col("document_hash").alias("chain_hash"), F.col("status").alias("chain_status")), "record_id", "left")
    payload = F.sha2("result_payload", 256) == F.col("record_hash")
    confirmed = F.coalesce(F.col("chain_status") != "REVOKED", F.lit(False))
    out = joined.withColumn("payload_ok", F.coalesce(payload, F.lit(False))).withColumn("verdict", verdict(F.col("document_hash"), F.col("document_hash"), F.col("chain_hash"), confirmed))
    return out.withColumn("verification", F.when(F.col("payload_ok") & F.col("verdict.chain_match"), "VERIFIED").otherwise("FAILED"))


def retried(status: Column, receipt_status: Column, error: Column) -> Column:
    """A new attempt to register: a confirmed record stays, any other is registered again."""
    return F.when(status == "CONFIRMED", status).when(error.isNotNull(), "PENDING").when(receipt_status == 1, "CONFIRMED").otherwise("FAILED")


def audit_records(files: DataFrame) -> DataFrame:
    """The rows with audit_id, document_hash (of ``content``, which goes) and blockchain_tx, null until a ledger confirms.

    A file that is not there (null content) has no record.
    """
    rows = files.where(F.col("content").isNotNull()).withColumn("document_hash", F.sha2("content", 256)).drop("content")
    return rows.withColumn("audit_id", identifiers.short_id("AUD-", F.col("screening_id"))).withColumn("blockchain_tx", F.lit(None).cast("string"))


def newest(rows: DataFrame, order: list[Column], k: int) -> DataFrame:
    """The first k rows in an order, with their ``position`` from 1. Only k rows meet in one task."""
    top = rows.orderBy(*order).limit(k)
    return top.withColumn("position", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*order)).cast("long"))


def numbered(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The rows with their ``position`` from 1 among those of the same key."""
    return rows.withColumn("position", F.row_number().over(Window.partitionBy(key).orderBy(*order)).cast("long"))


def latest(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """One row of each key: the one that comes first in the order."""
    (n,) = unused(rows, "n")
    return rows.withColumn(n, F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col(n) == 1).drop(n)
