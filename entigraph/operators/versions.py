"""Record versions, idempotent replay and source registration, from arrivals in order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.identity import json_hash
from ..policy import SOURCE_PRIORITY
from ..sources.keyed import KeyedTable
from ..sources.tables import materialize

_KEY = ["tenant_id", "source", "external_id"]


def record_versions(arrivals: DataFrame) -> DataFrame:
    """Each arrival (tenant_id, source, external_id, entity_type, arrival_seq, raw) with its status and version.

    The first of a record is CREATED with version 1, equal payloads in a row are UNCHANGED, another one is UPDATED with
    the next version. A changed type is ENTITY_TYPE_CONFLICT and changes nothing. Rows with a ``hash`` need no payload.
    """
    own = json_hash(F.col("raw"))
    rows = arrivals.withColumn("hash", F.coalesce("hash", own) if "hash" in arrivals.columns else own)
    order = Window.partitionBy(*_KEY).orderBy("arrival_seq")
    rows = rows.withColumn("own_type", F.first("entity_type").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("conflict", F.col("entity_type") != F.col("own_type"))
    # The last valid payload before this one: conflicts do not count.
    before = F.last(F.when(~F.col("conflict"), F.col("hash")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("before", before)
    changed = ~F.col("conflict") & ~F.col("hash").eqNullSafe(F.col("before"))
    rows = rows.withColumn("version", F.sum(changed.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    status = F.when(F.col("conflict"), "ENTITY_TYPE_CONFLICT").when(F.col("before").isNull(), "CREATED").when(changed, "UPDATED").otherwise("UNCHANGED")
    return rows.select(*_KEY, "entity_type", "arrival_seq", "raw", "hash", status.alias("status"), "version")


def version_history(versions: DataFrame) -> DataFrame:
    """Immutable payloads by version."""
    return versions.where("status IN ('CREATED', 'UPDATED')").select(*_KEY, "version", "raw", "hash", "arrival_seq")


def current_records(versions: DataFrame) -> DataFrame:
    """Each record's newest payload and version."""
    newest = versions.where("status IN ('CREATED', 'UPDATED')").groupBy(*_KEY).agg(F.max_by(F.struct("entity_type", "raw", "hash", "version"), "version").alias("r"))
    return newest.select(*_KEY, "r.*")


def backfill_hash(records: DataFrame) -> DataFrame:
    """Records from before hashes were kept get theirs, at their current version."""
    return records.withColumn("hash", F.coalesce("hash", json_hash(F.col("raw"))))


def renormalize(records: DataFrame, policy_version: str) -> DataFrame:
    """Whether only the derived columns are to be refreshed: an older policy, whatever the payload's version."""
    return records.withColumn("refresh", ~F.col("normalization_version").eqNullSafe(F.lit(policy_version)))


def head_store(folder: str, **more: str) -> KeyedTable:
    """Records' newest versions, for ``versions_after``; ``more`` columns by name."""
    kinds = {**dict.fromkeys(_KEY, "string"), "entity_type": "string", "hash": "string", "version": "long", **more}
    return KeyedTable(folder, kinds, tuple(_KEY))


def versions_after(arrivals: DataFrame, heads: DataFrame) -> DataFrame:
    """``record_versions`` of a batch whose records stand as ``heads`` says: each one's entity_type, hash and version.

    Arrivals are numbered from 0 on, so that a record's head stands before them.
    """
    first = heads.select(*_KEY, "entity_type", F.lit(-1).cast("long").alias("arrival_seq"), F.lit(None).cast("string").alias("raw"), "hash")
    numbered = record_versions(arrivals.select(*_KEY, "entity_type", "arrival_seq", "raw", F.lit(None).cast("string").alias("hash")).unionByName(first)).where("arrival_seq >= 0")
    base = heads.select(*_KEY, (F.col("version") - 1).alias("base"))
    return numbered.join(base, _KEY, "left").withColumn("version", F.col("version") + F.coalesce("base", F.lit(0))).drop("base")


def idempotent_replay(requests: DataFrame) -> DataFrame:
    """Requests (tenant_id, key, operation, hash, seq): the first of a key runs, equal ones replay it, others conflict.

    A null key never replays: such requests, the common case, need no shuffle. The others meet their key's first one by a
    join, so a key of many requests is no single task's.
    """
    plain, keyed = requests.where("key IS NULL"), requests.where("key IS NOT NULL")
    first = keyed.groupBy("tenant_id", "key").agg(F.min_by(F.struct("operation", "hash", "seq"), "seq").alias("first"))
    names = ["tenant_id", "key", "operation", "hash", "seq"]
    done = plain.select(*names, F.lit("EXECUTED").alias("outcome"), F.col("seq").alias("answered_by"))
    return _replayed(keyed, first, F.col("seq") == F.col("first.seq")).unionByName(done)


def _replayed(requests: DataFrame, first: DataFrame, runs: Column) -> DataFrame:
    rows = requests.withColumnRenamed("tenant_id", "_tenant").join(first.withColumnRenamed("key", "_key"), F.col("_tenant").eqNullSafe(F.col("tenant_id")) & (F.col("key") == F.col("_key")))
    same = (F.col("operation") == F.col("first.operation")) & (F.col("hash") == F.col("first.hash"))
    outcome = F.when(runs, "EXECUTED").when(same, "REPLAYED").otherwise("IDEMPOTENCY_KEY_REUSED")
    return rows.select(F.col("_tenant").alias("tenant_id"), "key", "operation", "hash", "seq", outcome.alias("outcome"), F.col("first.seq").alias("answered_by"))


def answer_store(folder: str) -> KeyedTable:
    """First requests by idempotency key, with the answer that they got."""
    kinds = {"tenant_id": "string", "key": "string", "operation": "string", "hash": "string", "seq": "long", "answer": "string"}
    return KeyedTable(folder, kinds, ("tenant_id", "key"))


def replay_batch(requests: DataFrame, store: KeyedTable, batch: int, answers: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``idempotent_replay`` of a batch against all before it: replayed requests carry the stored answer.

    ``answers`` makes (tenant_id, seq, answer) of the requests that run; ``seq`` is distinct within a tenant. What
    happened in earlier batches is looked up for the batch's own keys only. Adds ``answer``: null for a reused key.
    """
    requests = materialize(requests.select("tenant_id", "key", "operation", "hash", "seq"), "requests")
    asked = requests.where("key IS NOT NULL")
    known = materialize(store.lookup(asked, batch), "answers")
    first = known.select("tenant_id", "key", F.struct("operation", "hash", "seq").alias("first"))
    new = asked.join(known.select("tenant_id", "key"), ["tenant_id", "key"], "left_anti").unionByName(requests.where("key IS NULL"))
    old = _replayed(asked, first, F.lit(False))
    found = materialize(idempotent_replay(new).unionByName(old), "replayed")
    made = materialize(answers(found.where("outcome = 'EXECUTED'").drop("outcome", "answered_by")).select("tenant_id", "seq", "answer"), "made")
    ran = found.where("outcome = 'EXECUTED'").join(made, ["tenant_id", "seq"], "left")
    store.append(ran.where("key IS NOT NULL"), batch)
    given = made.select("tenant_id", F.col("seq").alias("answered_by"), "answer").unionByName(known.select("tenant_id", F.col("seq").alias("answered_by"), "answer"))
    return found.join(given, ["tenant_id", "answered_by"], "left").withColumn("answer", F.when(F.col("outcome") != "IDEMPOTENCY_KEY_REUSED", F.col("answer"))).select(*found.columns, "answer")


def register_sources(requests: DataFrame, registry: DataFrame) -> DataFrame:
    """Registrations (tenant_id, name, type, priority) against the registry: CREATED, UNCHANGED or the conflict."""
    asked = requests.withColumn("priority", F.coalesce("priority", F.lit(SOURCE_PRIORITY)))
    known = registry.select("tenant_id", "name", F.col("type").alias("known_type"), F.col("priority").alias("known_priority"))
    status = (
        F.when(F.col("known_type").isNull(), "CREATED").when(F.col("type") != F.col("known_type"), "SOURCE_TYPE_CONFLICT")
        .when(F.col("priority") != F.col("known_priority"), "SOURCE_PRIORITY_CONFLICT").otherwise("UNCHANGED")
    )
    return asked.join(known, ["tenant_id", "name"], "left").select("tenant_id", "name", "type", "priority", status.alias("status"))


def check_sources(records: DataFrame, registry: DataFrame) -> DataFrame:
    """Records with SOURCE_NOT_FOUND where the tenant has no such source."""
    known = registry.select("tenant_id", F.col("name").alias("source"), F.lit(True).alias("found"))
    return records.join(known, ["tenant_id", "source"], "left").withColumn("error", F.when(F.col("found").isNull(), "SOURCE_NOT_FOUND")).drop("found")


def authorize(calls: DataFrame, keys: DataFrame, tenants: DataFrame) -> DataFrame:
    """Calls (key_hash, scope) with their tenant, or null, and whether the key has the scope.

    Revoked keys and inactive tenants are none.
    """
    live = keys.where("NOT revoked").join(tenants.where("status = 'ACTIVE'").select("tenant_id"), "tenant_id").select("key_hash", "tenant_id", "scopes")
    return calls.join(live, "key_hash", "left").select(*calls.columns, "tenant_id", F.coalesce(F.array_contains("scopes", F.col("scope")), F.lit(False)).alias("allowed"))
