"""Canonical entities: each field's winner among an entity's records, with its provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import collapse_whitespace, strip
from ..policy import SURVIVORSHIP

#: Field, kind, and where the raw and the normalized value stand.
PERSON_FIELDS = [
    ("name", "display", "name", "name"), ("email", "identifier", "email", "email"), ("phone", "identifier", "phone", "phone"),
    ("company", "display", "company", "company_full"), ("company_domain", "identifier", "company_domain", "domain"),
]
COMPANY_FIELDS = [
    ("name", "display", "name", "company_full"), ("domain", "identifier", "domain", "domain"), ("email", "identifier", "email", "email"),
    ("phone", "identifier", "phone", "phone"), ("registration_id", "registration", "registration_id", None),
]
ADDRESS_FIELDS = [
    ("address.line1", "display", "line1"), ("address.city", "display", "city"), ("address.region", "display", "region"),
    ("address.postal_code", "display", "postal_code"), ("address.country", "identifier", "country"),
]


def _fields(kind: str) -> list[tuple[str, str, Column, Column | None]]:
    n, raw = F.col("normalized"), F.col("data")
    own = PERSON_FIELDS if kind == "person" else COMPANY_FIELDS
    return [(f, k, raw[r], n[m] if m else None) for f, k, r, m in own] + [(f, k, raw["address"][p], n["address"][p]) for f, k, p in ADDRESS_FIELDS]


def _candidate(field: str, kind: str, raw: Column, normalized: Column | None) -> Column:
    """struct(field, value, raw_value, completeness), null where the record has no value.

    Identifiers show the normalized value, display fields the raw one, collapsed; registration ids need no normal form.
    """
    given = F.when(raw != "", raw)
    if kind == "registration":
        value, complete = strip(given), F.length(strip(given))
    else:
        known = F.when(normalized != "", normalized)
        shown = known if kind == "identifier" else strip(given) if field == "address.postal_code" else collapse_whitespace(given)
        value, complete = F.when(known.isNotNull() & given.isNotNull(), shown), F.lit(1) if kind == "identifier" else F.length(known)
    return F.when(value != "", F.struct(F.lit(field).alias("field"), value.alias("value"), given.alias("raw_value"), complete.alias("completeness")))


def field_candidates(members: DataFrame) -> DataFrame:
    """One row for each field value of each member record.

    ``members``: tenant_id, entity_id, entity_type, record_id, external_id, source, priority, observed_at, data,
    normalized.
    """
    of = lambda kind: F.filter(F.array(*[_candidate(*f) for f in _fields(kind)]), lambda x: x.isNotNull())
    rows = F.when(F.col("entity_type") == "person", of("person")).otherwise(of("company"))
    keep = ["tenant_id", "entity_id", "entity_type", "record_id", "external_id", "source", "priority", F.date_trunc("MILLISECOND", "observed_at").alias("observed_at")]
    return members.select(*keep, F.explode(rows).alias("c")).select("*", "c.*").drop("c")


def select_winners(candidates: DataFrame) -> DataFrame:
    """The winner of each field and the first criterion that sets it apart from the runner-up.

    Ranked by source priority, completeness, recency and record id. Only the two best of a field matter, so the others
    are cut before the shuffle.
    """
    field = Window.partitionBy("tenant_id", "entity_id", "field")
    order = field.orderBy("priority", F.desc("completeness"), F.desc("observed_at"), "record_id")
    best = candidates.withColumn("r", F.row_number().over(order)).where("r <= 2")
    nxt = F.lead(F.struct("priority", "completeness", "observed_at")).over(field.orderBy("r"))
    rule = (
        F.when(F.col("next").isNull(), "ONLY_CANDIDATE").when(F.col("priority") != F.col("next.priority"), "SOURCE_PRIORITY")
        .when(F.col("completeness") != F.col("next.completeness"), "COMPLETENESS").when(F.col("observed_at") != F.col("next.observed_at"), "RECENCY")
        .otherwise("STABLE_TIE_BREAK")
    )
    out = best.withColumn("next", nxt).where("r = 1").withColumn("selection_rule", rule)
    return out.drop("r", "next").withColumn("canonicalization_version", F.lit(SURVIVORSHIP))


def assemble(winners: DataFrame) -> DataFrame:
    """One row for each entity: the values as a struct with a nested address, and the provenance by field."""
    of = lambda f: F.max(F.when(F.col("field") == f, F.col("value")))
    plain = list(dict.fromkeys([f for f, *_ in PERSON_FIELDS] + [f for f, *_ in COMPANY_FIELDS]))
    parts = [(f, f.split(".")[1]) for f, *_ in ADDRESS_FIELDS]
    address = F.struct(*[of(f).alias(p) for f, p in parts])
    some = F.coalesce(*[of(f) for f, _ in parts])
    provenance = F.sort_array(F.collect_list(F.struct("field", "value", "raw_value", "record_id", "source", "external_id", "priority", "selection_rule", "completeness", "observed_at")))
    return winners.groupBy("tenant_id", "entity_id", "entity_type").agg(F.struct(*[of(f).alias(f) for f in plain], F.when(some.isNotNull(), address).alias("address")).alias("canonical"), provenance.alias("provenance"))


def canonical_entities(members: DataFrame) -> DataFrame:
    return assemble(select_winners(field_candidates(members)))


def changed_snapshots(entities: DataFrame, previous: DataFrame, forced: bool = False) -> DataFrame:
    """Entities to write, with the next version and the hash of what they hold.

    Equal data and provenance write nothing, unless the trigger is a structural one (``forced``).
    """
    now = entities.withColumn("hash", F.sha2(F.to_json(F.struct("canonical", "provenance")), 256))
    known = previous.select("tenant_id", "entity_id", F.col("hash").alias("known"), F.col("canonical_version").alias("known_version"))
    rows = now.join(known, ["tenant_id", "entity_id"], "left")
    if not forced:
        rows = rows.where(~F.col("hash").eqNullSafe(F.col("known")))
    return rows.withColumn("canonical_version", F.coalesce("known_version", F.lit(0)) + 1).drop("known", "known_version")


def write_snapshots(entities: DataFrame, provenance: DataFrame, history: DataFrame, changed: DataFrame) -> dict[str, DataFrame]:
    """The tables after the snapshots of ``changed_snapshots`` (with a ``snapshot_trigger``) are written.

    ``entities`` (tenant_id, entity_id, canonical, canonical_version) take the new data and version. ``provenance``, one
    row for each field, is replaced for a changed entity as a whole. ``history`` only grows.
    """
    key = ["tenant_id", "entity_id"]
    new = changed.select(*key, F.col("canonical").alias("new_canonical"), F.col("canonical_version").alias("new_version"))
    rows = entities.join(new, key, "left")
    written = F.col("new_version").isNotNull()
    kept = [c for c in entities.columns if c not in ("canonical", "canonical_version")]
    fields = changed.select(*key, F.explode("provenance").alias("p")).select(*key, "p.*")
    return {
        "entities": rows.select(*kept, F.when(written, F.col("new_canonical")).otherwise(F.col("canonical")).alias("canonical"), F.coalesce("new_version", "canonical_version").alias("canonical_version")),
        "provenance": provenance.join(changed.select(*key), key, "left_anti").unionByName(fields.select(provenance.columns)),
        "history": history.unionByName(changed.select(history.columns)),
    }


def trigger(operation: Column, human: Column, ingested: Column, decision: Column) -> Column:
    """What made a snapshot: a structural operation, a review, or an ingested record's status and decision."""
    return (
        F.when(operation == "MERGE", "MERGE").when(operation.isin("SPLIT", "UNMERGE"), "SPLIT")
        .when(human == "APPROVE", "REVIEW_APPROVED").when(human == "REJECT", "REVIEW_REJECTED")
        .when(ingested == "UNCHANGED", "LEGACY_BACKFILL").when(ingested == "UPDATED", "RECORD_UPDATED")
        .when(decision == "NO_MATCH", "ENTITY_CREATED").otherwise("RECORD_LINKED")
    )
