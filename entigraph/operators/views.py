"""Read views: entities, linked records, history, reviews and jobs, as nested rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.validation import stored_provenance
from ..policy import REVIEW
from .operations import approval_available


def membership(links: DataFrame, records: DataFrame, sources: DataFrame) -> DataFrame:
    """Member records with their source's priority, as survivorship takes them."""
    own = sources.select("tenant_id", F.col("name").alias("source"), "priority")
    return links.select("tenant_id", "record_id", "entity_id").join(records, ["tenant_id", "record_id"]).join(own, ["tenant_id", "source"])


def duplicate_membership(links: DataFrame) -> DataFrame:
    """Records with more than one link: an integrity error."""
    return links.groupBy("tenant_id", "record_id").agg(F.count("*").alias("links")).where("links > 1")


def record_counts(entities: DataFrame, links: DataFrame) -> DataFrame:
    """Entities with the number of their linked records, 0 included."""
    n = links.groupBy("tenant_id", "entity_id").agg(F.count("*").alias("record_count"))
    return entities.join(n, ["tenant_id", "entity_id"], "left").withColumn("record_count", F.coalesce("record_count", F.lit(0)).cast("long"))


def entity_view(entities: DataFrame, links: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Entity, record count, canonical data and provenance of the newest snapshot.

    An entity of version 0 shows its stored data, without a policy version or provenance.
    """
    newest = snapshots.groupBy("tenant_id", "entity_id").agg(F.max_by(F.struct("canonical", "provenance", "canonicalization_version"), "canonical_version").alias("s"))
    rows = record_counts(entities, links).join(newest, ["tenant_id", "entity_id"], "left")
    legacy = F.col("canonical_version") == 0
    return rows.select(*[c for c in rows.columns if c != "s"], F.col("s.canonical").alias("canonical"), F.when(~legacy, F.col("s.provenance")).alias("provenance"), F.when(~legacy, F.col("s.canonicalization_version")).alias("policy_version"))


def linked_record_view(members: DataFrame) -> DataFrame:
    """Nested rows of linked records; a record without a normalization version is an integrity error."""
    checked = F.when(F.col("normalization_version").isNull(), F.raise_error(F.lit("a linked record has no normalization version")).cast("string")).otherwise(F.col("normalization_version"))
    return members.select("tenant_id", "entity_id", F.struct("record_id", "external_id", "data", "normalized", checked.alias("normalization_version"), F.struct(F.col("source").alias("name"), "priority").alias("source")).alias("record"))


def _referring(rows: DataFrame, others: DataFrame, reference: str) -> DataFrame:
    """Left join by tenant and reference. Rows that refer to nothing stay out of it: as null keys they would all meet in one task."""
    keys = ["tenant_id", reference]
    found = rows.where(F.col(reference).isNotNull()).join(others, keys, "left")
    none = {f.name: F.lit(None).cast(f.dataType) for f in others.schema if f.name not in keys}
    return found.unionByName(rows.where(F.col(reference).isNull()).withColumns(none))


def history_view(snapshots: DataFrame, operations: DataFrame, decisions: DataFrame) -> DataFrame:
    """Snapshots with their operation or review decision, and ``missing`` where a reference leads nowhere.

    Source names and priorities in the provenance are those of the snapshot's time.
    """
    ops = operations.select("tenant_id", "operation_id", F.struct("type", "source_id", "target_id", "record_ids").alias("operation"))
    human = decisions.select("tenant_id", "decision_id", F.struct("decision", "case_id").alias("review"))
    rows = _referring(_referring(snapshots, ops, "operation_id"), human, "decision_id")
    missing = (F.col("operation_id").isNotNull() & F.col("operation").isNull()) | (F.col("decision_id").isNotNull() & F.col("review").isNull())
    return rows.withColumn("missing", missing)


def nested_provenance(winners: DataFrame) -> DataFrame:
    """Current provenance by field name, with the address nested; an unknown field is an error."""
    from .survivorship import ADDRESS_FIELDS, COMPANY_FIELDS, PERSON_FIELDS

    plain = list(dict.fromkeys([f for f, *_ in PERSON_FIELDS] + [f for f, *_ in COMPANY_FIELDS]))
    known = [*plain, *[f for f, *_ in ADDRESS_FIELDS]]
    entry = F.struct("record_id", "source", "priority", "selection_rule", "completeness", "observed_at", "canonicalization_version")
    of = lambda f: F.max(F.when(F.col("field") == f, entry))
    field = F.when(F.col("field").isin(known), F.col("field")).otherwise(F.raise_error(F.concat(F.lit("unknown field "), F.col("field"))).cast("string"))
    rows = winners.withColumn("field", field)
    return rows.groupBy("tenant_id", "entity_id").agg(*[of(f).alias(f) for f in plain], F.struct(*[of(f).alias(f.split(".")[1]) for f, *_ in ADDRESS_FIELDS]).alias("address"))


def history_provenance(snapshots: DataFrame) -> DataFrame:
    """Snapshots with ``provenance`` as a map from field paths (``address.city``) to each field's selection.

    A selection that breaks its own rules (see ``stored_provenance``) is an error, and so is one without a record or a
    source. Source names and priorities stay those of the snapshot's time.
    """
    names = {"record_id": "source_record_id", "source": "source_system_name", "external_id": "external_id", "priority": "source_priority", "raw_value": "raw_value", "value": "canonical_value",
             "selection_rule": "selection_rule", "completeness": "completeness_score", "observed_at": "observed_at"}

    def entry(p):
        broken = stored_provenance(p["selection_rule"], p["priority"], p["completeness"], p["observed_at"]).isNotNull() | p["record_id"].isNull() | p["source"].isNull()
        field = F.when(broken, F.raise_error(F.concat(F.lit("stored provenance is damaged: "), p["field"])).cast("string")).otherwise(p["field"])
        return F.struct(field.alias("key"), F.struct(*[p[k].alias(v) for k, v in names.items()]).alias("value"))

    return snapshots.withColumn("provenance", F.map_from_entries(F.transform("provenance", entry)))


def review_summary(cases: DataFrame) -> DataFrame:
    """Review cases as listed: ids, captured versions, and the confidence as a number."""
    return cases.select(
        F.col("case_id").alias("review_id"), "status", F.col("record_id").alias("source_record_id"), F.col("entity_id").alias("candidate_entity_id"),
        F.col("supporting_id").alias("candidate_record_id"), F.col("score").cast("double").alias("confidence"), "algorithm_version",
        F.col("captured_source_version").alias("source_record_version"), F.col("captured_candidate_version").alias("candidate_record_version"), "created_at",
    )


def review_decision_view(decisions: DataFrame) -> DataFrame:
    """Stored review decisions; one of another policy than the current is an error."""
    policy = F.when(F.col("policy_version") == REVIEW, F.col("policy_version")).otherwise(F.raise_error(F.lit("a stored review has an unsupported policy")).cast("string"))
    return decisions.select(
        F.col("decision_id").alias("review_decision_id"), F.col("case_id").alias("review_id"), "decision", "reason", "actor_id", "entity_id", "source_record_version",
        "candidate_record_version", "candidate_canonical_version", "canonical_version", policy.alias("policy_version"), "created_at",
    )


def operation_view(operations: DataFrame) -> DataFrame:
    return operations.select(F.col("operation_id").alias("id"), F.col("type").alias("operation"), F.col("source_id").alias("source_entity_id"), F.col("target_id").alias("target_entity_id"), "record_ids", F.col("reversed_id").alias("reversed_operation_id"))


def review_detail(graph: DataFrame, history: DataFrame) -> DataFrame:
    """Review cases with the payloads at the versions they captured (version 1 if none was) and whether approval is open.

    The evidence of a case without captured versions is shown as null.
    """
    of = lambda who, key: history.select("tenant_id", F.col("record_id").alias(key), F.col("version").alias(f"{who}_at"), F.col("raw").alias(f"{who}_raw"))
    rows = graph.withColumns({f"{w}_at": F.coalesce(f"captured_{w}_version", F.lit(1)) for w in ("source", "candidate")}).withColumn("approval_available", approval_available(graph))
    rows = rows.join(of("source", "record_id"), ["tenant_id", "record_id", "source_at"], "left").join(of("candidate", "supporting_id"), ["tenant_id", "supporting_id", "candidate_at"], "left")
    shown = {f"{w}_raw": F.when(F.col(f"captured_{w}_version").isNotNull(), F.col(f"{w}_raw")) for w in ("source", "candidate")}
    return rows.withColumns(shown).drop("source_at", "candidate_at")


def ingestion_view(versions: DataFrame, outcomes: DataFrame) -> DataFrame:
    """What an ingested record answers: its status and version, and the resolution."""
    return versions.join(outcomes, ["tenant_id", "record_id"], "left")


def source_view(sources: DataFrame) -> DataFrame:
    return sources.select(F.col("name"), F.col("type"), F.coalesce("priority", F.lit(100)).alias("priority"))


def job_view(items: DataFrame) -> DataFrame:
    """Jobs (tenant_id, job_id) with counters and their items in order, from items (position, state, result, error)."""
    done = F.col("state").isin("SUCCEEDED", "FAILED")
    rows = items.groupBy("tenant_id", "job_id").agg(
        F.count("*").alias("total"), F.count_if(done).alias("processed"), F.count_if(F.col("state") == "FAILED").alias("failed"),
        F.sort_array(F.collect_list(F.struct("position", "state", "result", "error"))).alias("items"),
    )
    status = F.when(F.col("processed") < F.col("total"), "PROCESSING").when(F.col("failed") > 0, "FAILED").otherwise("SUCCEEDED")
    error = F.when((F.col("processed") == F.col("total")) & (F.col("failed") > 0), "BATCH_RECORDS_FAILED")
    return rows.select("tenant_id", "job_id", status.alias("status"), "total", "processed", (F.col("processed") - F.col("failed")).alias("succeeded"), "failed", error.alias("error_code"), "items")
