"""Merge, split and reversal of entities, and review decisions: plans with the first failing guard's code.

Plans are checked set by set against one state. Requests that touch the same entity depend on each other's order:
``plans.ordered.apply_in_order`` takes those in turn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.identity import stable_id
from ..policy import MAX_OPERATION_RECORDS, MAX_VERSION


def _guards(*rules: tuple[Column, str]) -> Column:
    """The code of the first rule that is broken; a rule that is null counts as broken."""
    return F.coalesce(*[F.when(F.coalesce(broken, F.lit(True)), F.lit(code)) for broken, code in rules])


def entity_members(entities: DataFrame, links: DataFrame) -> DataFrame:
    """Entities (tenant_id, entity_id, entity_type, status, canonical_version, merged_into) with their sorted records.

    The number of records is exact, but no more of them are gathered than an operation may have, and one.
    """
    counted = links.groupBy("tenant_id", "entity_id").agg(F.count("*").alias("n"))
    # Only entities within the bound can take part, so only theirs are gathered.
    small = links.join(counted.where(F.col("n") <= MAX_OPERATION_RECORDS), ["tenant_id", "entity_id"], "left_semi")
    lists = small.groupBy("tenant_id", "entity_id").agg(F.sort_array(F.collect_list(F.lower("record_id"))).alias("members"))
    rows = entities.join(counted, ["tenant_id", "entity_id"], "left").join(lists, ["tenant_id", "entity_id"], "left")
    return rows.withColumns({"n": F.coalesce("n", F.lit(0)), "members": F.coalesce("members", F.array().cast("array<string>"))})


def _side(members: DataFrame, prefix: str) -> DataFrame:
    names = ["entity_id", "entity_type", "status", "canonical_version", "merged_into", "n", "members"]
    return members.select("tenant_id", *[F.col(c).alias(c if c == "entity_id" else f"{prefix}_{c}") for c in names]).withColumnRenamed("entity_id", f"{prefix}_id").withColumn(f"{prefix}_found", F.lit(True))


def _stale(version: Column, expected: Column) -> Column:
    return (version != expected) | (version >= MAX_VERSION)


def plan_merges(requests: DataFrame, members: DataFrame) -> DataFrame:
    """Requests (operation_id, tenant_id, source_id, target_id, source_version, target_version) with error and moves."""
    rows = requests.withColumns({c: F.lower(c) for c in ("source_id", "target_id")})
    rows = rows.join(_side(members, "source"), ["tenant_id", "source_id"], "left").join(_side(members, "target"), ["tenant_id", "target_id"], "left")
    error = _guards(
        (F.col("source_id") == F.col("target_id"), "INVALID_ENTITY_MERGE"),
        (F.col("source_found").isNull() | F.col("target_found").isNull(), "ENTITY_NOT_FOUND"),
        ((F.col("source_status") != "ACTIVE") | (F.col("target_status") != "ACTIVE"), "ENTITY_NOT_ACTIVE"),
        (F.col("source_entity_type") != F.col("target_entity_type"), "ENTITY_TYPE_CONFLICT"),
        (F.col("source_n") + F.col("target_n") > MAX_OPERATION_RECORDS, "ENTITY_OPERATION_LIMIT"),
        ((F.col("source_n") == 0) | (F.col("target_n") == 0), "INVALID_ENTITY_MERGE"),
        (_stale(F.col("source_canonical_version"), F.col("source_version")), "ENTITY_VERSION_CONFLICT"),
        (_stale(F.col("target_canonical_version"), F.col("target_version")), "ENTITY_VERSION_CONFLICT"),
    )
    return rows.select("operation_id", "tenant_id", "source_id", "target_id", error.alias("error"), F.when(error.isNull(), F.col("source_members")).alias("record_ids"))


def plan_splits(requests: DataFrame, members: DataFrame) -> DataFrame:
    """Requests (operation_id, tenant_id, source_id, entity_version, record_ids) with error, new entity and moves."""
    rows = requests.withColumn("source_id", F.lower("source_id")).join(_side(members, "source"), ["tenant_id", "source_id"], "left")
    ids = F.sort_array(F.transform("record_ids", F.lower))
    rows = rows.withColumn("ids", ids)
    error = _guards(
        (F.col("source_found").isNull(), "ENTITY_NOT_FOUND"),
        (F.col("source_status") != "ACTIVE", "ENTITY_NOT_ACTIVE"),
        (_stale(F.col("source_canonical_version"), F.col("entity_version")), "ENTITY_VERSION_CONFLICT"),
        (F.col("source_n") > MAX_OPERATION_RECORDS, "ENTITY_OPERATION_LIMIT"),
        (F.size(F.array_except("ids", "source_members")) > 0, "SOURCE_RECORD_NOT_FOUND"),
        ((F.size("ids") == 0) | (F.size(F.array_distinct("ids")) != F.size("ids")) | (F.size("ids") >= F.col("source_n")), "INVALID_ENTITY_SPLIT"),
    )
    new_id = stable_id(F.lit("split"), F.col("tenant_id"), F.col("operation_id"))
    return rows.select("operation_id", "tenant_id", "source_id", F.when(error.isNull(), new_id).alias("target_id"), error.alias("error"), F.when(error.isNull(), F.col("ids")).alias("record_ids"))


def plan_reversals(requests: DataFrame, members: DataFrame, operations: DataFrame) -> DataFrame:
    """Requests (operation_id, tenant_id, source_id, entity_version, merge_event_id): undo a merge into ``source_id``.

    ``operations`` is the log (operation_id, tenant_id, type, source_id, target_id, record_ids, reversed_id). The
    restored entity is the merge's source; it takes back the event's records.
    """
    merges = operations.where("type = 'MERGE'").select("tenant_id", F.col("operation_id").alias("merge_event_id"), F.col("source_id").alias("target_id"), F.col("target_id").alias("into"), F.sort_array(F.transform("record_ids", F.lower)).alias("ids"))
    undone = operations.where("reversed_id IS NOT NULL").select("tenant_id", F.col("reversed_id").alias("merge_event_id"), F.lit(True).alias("undone")).distinct()
    rows = requests.withColumn("source_id", F.lower("source_id")).join(merges, ["tenant_id", "merge_event_id"], "left").join(undone, ["tenant_id", "merge_event_id"], "left")
    rows = rows.join(_side(members, "source"), ["tenant_id", "source_id"], "left").join(_side(members, "target"), ["tenant_id", "target_id"], "left")
    error = _guards(
        (F.col("source_found").isNull(), "ENTITY_NOT_FOUND"),
        (F.col("source_status") != "ACTIVE", "ENTITY_NOT_ACTIVE"),
        (_stale(F.col("source_canonical_version"), F.col("entity_version")), "ENTITY_VERSION_CONFLICT"),
        (F.col("source_n") > MAX_OPERATION_RECORDS, "ENTITY_OPERATION_LIMIT"),
        (F.col("into").isNull() | (F.col("into") != F.col("source_id")), "MERGE_EVENT_NOT_FOUND"),
        (F.coalesce("undone", F.lit(False)), "MERGE_ALREADY_REVERSED"),
        (
            (F.col("target_status") != "MERGED") | (F.col("target_merged_into") != F.col("source_id")) | (F.col("target_n") > 0)
            | (F.size("ids") == 0) | (F.size(F.array_except("ids", "source_members")) > 0) | (F.size("ids") >= F.col("source_n")),
            "MERGE_REVERSAL_CONFLICT",
        ),
        (F.col("target_canonical_version") >= MAX_VERSION, "ENTITY_VERSION_CONFLICT"),
    )
    return rows.select("operation_id", "tenant_id", "source_id", "target_id", F.col("merge_event_id").alias("reversed_id"), error.alias("error"), F.when(error.isNull(), F.col("ids")).alias("record_ids"))


def apply_operations(entities: DataFrame, links: DataFrame, plans: DataFrame) -> dict[str, DataFrame]:
    """State after valid plans (type, source_id, target_id, record_ids, error) that touch different entities.

    A merge moves all links and marks its source; a split makes its target; a reversal makes the target active again.
    Two valid plans that touch one entity are an error, as each was checked without the other.
    """
    valid = plans.where("error IS NULL")
    moves = valid.select("tenant_id", F.explode("record_ids").alias("record_id"), F.col("target_id").alias("moved_to"))
    moved = links.withColumn("record_id", F.lower("record_id")).join(moves, ["tenant_id", "record_id"], "left")
    new_links = moved.withColumn("entity_id", F.coalesce("moved_to", "entity_id")).drop("moved_to")
    touched = valid.select("tenant_id", F.explode(F.array(
        F.struct(F.col("source_id").alias("entity_id"), F.when(F.col("type") == "MERGE", "MERGED").otherwise("ACTIVE").alias("new_status"), F.when(F.col("type") == "MERGE", F.col("target_id")).alias("new_into")),
        F.struct(F.col("target_id").alias("entity_id"), F.lit("ACTIVE").alias("new_status"), F.lit(None).cast("string").alias("new_into")),
    )).alias("t")).select("tenant_id", "t.*")
    once = F.when(F.count("*") > 1, F.raise_error(F.lit("two operations touch one entity; apply them in order")).cast("string")).otherwise(F.max("new_status"))
    touched = touched.groupBy("tenant_id", "entity_id").agg(once.alias("new_status"), F.max("new_into").alias("new_into"))
    kept = entities.join(touched, ["tenant_id", "entity_id"], "left")
    kept = kept.select(
        "tenant_id", "entity_id", "entity_type", F.coalesce("new_status", "status").alias("status"),
        (F.col("canonical_version") + F.col("new_status").isNotNull().cast("int")).alias("canonical_version"),
        F.when(F.col("new_status").isNotNull(), F.col("new_into")).otherwise(F.col("merged_into")).alias("merged_into"),
    )
    made = valid.where("type = 'SPLIT'").select("tenant_id", F.col("target_id").alias("entity_id"), F.col("source_id").alias("from_id"))
    made = made.join(entities.select("tenant_id", F.col("entity_id").alias("from_id"), "entity_type"), ["tenant_id", "from_id"])
    made = made.select("tenant_id", "entity_id", "entity_type", F.lit("ACTIVE").alias("status"), F.lit(1).alias("canonical_version"), F.lit(None).cast("string").alias("merged_into"))
    return {"links": new_links, "entities": kept.unionByName(made), "operations": valid}


def approval_available(c: DataFrame) -> Column:
    """Whether a review case, joined with its records and entities as ``review_graph`` does, can still be approved."""
    same = (F.col("source_version") == F.coalesce("captured_source_version", F.lit(1))) & (F.col("candidate_version") == F.coalesce("captured_candidate_version", F.lit(1)))
    ok = (
        (F.col("status") == "OPEN") & F.col("source_entity_id").isNull() & (F.col("entity_status") == "ACTIVE") & (F.col("source_type") == F.col("entity_type"))
        & (F.col("candidate_type") == F.col("source_type")) & (F.col("candidate_entity_id") == F.col("entity_id")) & same
    )
    return F.coalesce(ok, F.lit(False))


def review_graph(cases: DataFrame, records: DataFrame, links: DataFrame, entities: DataFrame) -> DataFrame:
    """Cases (tenant_id, case_id, record_id, supporting_id, entity_id, captured versions, status) with current state."""
    current = records.select("tenant_id", "record_id", "entity_type", "version")
    linked = links.select("tenant_id", "record_id", "entity_id")
    rows = cases.join(current.select("tenant_id", "record_id", F.col("entity_type").alias("source_type"), F.col("version").alias("source_version")), ["tenant_id", "record_id"], "left")
    rows = rows.join(current.select("tenant_id", F.col("record_id").alias("supporting_id"), F.col("entity_type").alias("candidate_type"), F.col("version").alias("candidate_version")), ["tenant_id", "supporting_id"], "left")
    rows = rows.join(linked.select("tenant_id", "record_id", F.col("entity_id").alias("source_entity_id")), ["tenant_id", "record_id"], "left")
    rows = rows.join(linked.select("tenant_id", F.col("record_id").alias("supporting_id"), F.col("entity_id").alias("candidate_entity_id")), ["tenant_id", "supporting_id"], "left")
    return rows.join(entities.select("tenant_id", "entity_id", "entity_type", F.col("status").alias("entity_status"), "canonical_version"), ["tenant_id", "entity_id"], "left")


def decide_reviews(decisions: DataFrame, graph: DataFrame) -> DataFrame:
    """Decisions (tenant_id, case_id, decision, expected_source_version, expected_candidate_version) with the error and,
    if there is none, the entity that the record is linked to: the candidate when approved, a new one when rejected."""
    rows = decisions.join(graph.withColumn("can_approve", approval_available(graph)).withColumn("found", F.lit(True)), ["tenant_id", "case_id"], "left")
    approve = F.col("decision") == "APPROVE"
    error = _guards(
        (F.col("found").isNull(), "REVIEW_NOT_FOUND"),
        (F.col("status") != "OPEN", "REVIEW_ALREADY_RESOLVED"),
        (F.col("source_entity_id").isNotNull(), "REVIEW_RECORD_ALREADY_LINKED"),
        (F.col("source_version") != F.col("expected_source_version"), "REVIEW_SOURCE_VERSION_CONFLICT"),
        (approve & ~F.col("can_approve"), "REVIEW_EVIDENCE_STALE"),
        (approve & _stale(F.col("canonical_version"), F.col("expected_candidate_version")), "ENTITY_VERSION_CONFLICT"),
    )
    new_id = stable_id(F.lit("review"), F.col("tenant_id"), F.col("case_id"))
    linked = F.when(error.isNull(), F.when(approve, F.col("entity_id")).otherwise(new_id))
    return rows.select("tenant_id", "case_id", "decision", "record_id", error.alias("error"), linked.alias("linked_entity_id"))
