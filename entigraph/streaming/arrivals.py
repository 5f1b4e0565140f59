"""A stream of record envelopes: routed, versioned, resolved batch by batch in arrival order, and consolidated.

A record is resolved when it first arrives, with the payload that it first has. Later payloads are versions: they change
what later batches compare with, never a link or a review. Within a batch, changes take effect after its resolutions.
Entities that a batch touches, by a new link or a changed record, get a new snapshot if it differs.

What later batches need lies in keyed tables below the state (``sources.keyed``): a batch reads the rows of its own keys,
so it does not cost more as the history grows. What they do not need are logs, a folder for each batch. A batch is done
when it is in the log ``commits``, which is written last.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.identity import stable_id
from ..functions.text import normalize_records
from ..operators import survivorship
from ..operators.key_index import index_rows, key_index, reached_population
from ..operators.resolution import apply_decisions, stored_outcomes
from ..operators.versions import head_store, versions_after
from ..plans.ordered import resolve_in_order
from ..policy import SOURCE_PRIORITY
from ..schemas import DATA, NORMALIZED
from ..sources.intake import accepted, rejected, route, stream_lines
from ..sources.keyed import KeyedTable
from ..sources.tables import materialize, typed_records

_KEY = ["tenant_id", "source", "external_id"]
_RECORD, _ENTITY = ["tenant_id", "record_id"], ["tenant_id", "entity_id"]
#: Logs of the state: a folder ``batch=n`` for each batch.
LOGS = ("rejected", "versions", "outcomes", "answers", "history", "commits")
COMPACT_EVERY = 20

read_arrivals = stream_lines


def tables(state: str) -> dict[str, KeyedTable]:
    """The state's keyed tables."""
    of = lambda name, keys, identity=(), **columns: KeyedTable(f"{state}/{name}", {**{k: "string" for k in (*keys, *identity)}, **columns}, tuple(keys), tuple(identity))
    text = dict.fromkeys
    return {
        "heads": head_store(f"{state}/heads", record_id="string", normalized=NORMALIZED),
        "links": of("links", _RECORD, **text(("entity_id", "decision", "human_decision"), "string")),
        "reviews": of("reviews", _RECORD, entity_id="string"),
        "keys": key_index(f"{state}/keys"),
        "members": of("members", _ENTITY, ["record_id"], **text(("entity_type", "external_id", "source"), "string"), priority="int", observed_at="timestamp", data=DATA, normalized=NORMALIZED),
        "snapshots": of("snapshots", _ENTITY, entity_type="string", canonical=_CANONICAL, provenance=_PROVENANCE, hash="string", canonical_version="int", snapshot_trigger="string"),
    }


_CANONICAL = "struct<" + ", ".join(f"{f}: string" for f in dict.fromkeys(f for f, *_ in survivorship.PERSON_FIELDS + survivorship.COMPANY_FIELDS)) + ", address: struct<" + ", ".join(f"{f.split('.')[1]}: string" for f, *_ in survivorship.ADDRESS_FIELDS) + ">>"
_PROVENANCE = "array<struct<field: string, value: string, raw_value: string, record_id: string, source: string, external_id: string, priority: int, selection_rule: string, completeness: int, observed_at: timestamp>>"


def committed(spark: SparkSession, state: str) -> int:
    """The batches below this one are whole; the state at that point is ``tables(state)[name].read(spark, before)``."""
    done = spark.read.schema("done boolean, batch long").parquet(f"{state}/commits").agg(F.max("batch")).first()[0]
    return -1 if done is None else done + 1


def resolver(state: str, wide: bool = True, registry: DataFrame | None = None, compact_every: int = COMPACT_EVERY) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that keeps the state below ``state``.

    A batch that runs again overwrites what it wrote and sees what it saw, so each record is resolved once. Records that
    are linked or in review answer with what is stored. Where a ``registry`` (tenant_id, name, priority) is given, records
    of other sources are rejected, and its priorities rank the sources; a record was observed when it arrived, by its
    number in milliseconds.
    """
    own = tables(state)

    def identified(rows: DataFrame) -> DataFrame:
        return rows.withColumn("record_id", stable_id(F.lit("record"), *[F.col(c) for c in _KEY]))

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        write = lambda df, table: df.write.mode("overwrite").parquet(f"{state}/{table}/batch={batch_id}")
        if batch_id and batch_id % compact_every == 0:
            for table in own.values():
                table.compact(spark, batch_id)
        routed = route(batch, registry)
        arrived = accepted(routed)
        heads = materialize(own["heads"].lookup(arrived, batch_id), "heads")
        numbered = materialize(identified(versions_after(arrived, heads)), "versions")

        # Of each record that changed: its first payload, if it is new, and its last.
        payloads = numbered.where("status IN ('CREATED', 'UPDATED')")
        last = payloads.groupBy(*_RECORD).agg(F.max("version").alias("last"))
        payloads = payloads.join(last, _RECORD).where("status = 'CREATED' OR version = last").withColumn("newest", F.col("version") == F.col("last"))
        payloads = materialize(normalize_records(typed_records(payloads), wide), "payloads")
        new = payloads.where("status = 'CREATED'").select("tenant_id", "entity_type", "record_id", "arrival_seq", "normalized")
        newest = payloads.where("newest")

        outcomes, _ = resolve_in_order(new, materialize(reached_population(new, own["keys"], before=batch_id), "reached"))
        outcomes = materialize(outcomes.drop("features", "contradictions"), "outcomes")
        made = apply_decisions(outcomes)
        links = materialize(made["links"].select(*_RECORD, "entity_id", "decision", F.lit(None).cast("string").alias("human_decision")), "links")
        asked = numbered.where("status NOT IN ('CREATED')").select(*_RECORD).distinct()
        stored = materialize(own["links"].lookup(asked, batch_id), "stored")
        answers = stored_outcomes(asked, stored, own["reviews"].lookup(asked, batch_id)).select(*_RECORD, "decision", F.col("entity_id").alias("linked_entity_id"))

        linked = links.unionByName(stored).select(*_RECORD, "entity_id")
        current = newest.join(linked, _RECORD).withColumn("status", F.lit("ACTIVE"))
        before = heads.join(current.select(*_RECORD), _RECORD, "left_semi")
        own["heads"].append(newest, batch_id)
        own["links"].append(links, batch_id)
        own["reviews"].append(made["reviews"], batch_id)
        own["keys"].append(index_rows(current, before), batch_id)
        consolidate(current, links, batch_id)

        write(rejected(routed), "rejected")
        write(numbered.drop("record_id"), "versions")
        write(outcomes, "outcomes")
        write(answers, "answers")
        write(spark.range(1).select(F.lit(True).alias("done")), "commits")

    def consolidate(current: DataFrame, links: DataFrame, batch_id: int) -> None:
        """Snapshots of the entities that the current records belong to, from all their members."""
        rows = current
        if registry is not None:
            rows = rows.join(registry.select("tenant_id", F.col("name").alias("source"), "priority"), ["tenant_id", "source"], "left")
        priority = F.coalesce("priority", F.lit(SOURCE_PRIORITY)) if registry is not None else F.lit(SOURCE_PRIORITY)
        rows = rows.withColumn("priority", priority.cast("int")).withColumn("observed_at", F.timestamp_millis("arrival_seq"))
        own["members"].append(rows, batch_id)
        touched = materialize(current.select(*_ENTITY, *_RECORD[1:]).join(links.select(*_RECORD, "decision"), _RECORD, "left").groupBy(*_ENTITY).agg(
            F.min(F.when(F.col("decision") == "NO_MATCH", 0).when(F.col("decision").isNotNull(), 1).otherwise(2)).alias("kind")), "touched")
        entities = survivorship.canonical_entities(own["members"].lookup(touched, batch_id + 1))
        changed = survivorship.changed_snapshots(entities, own["snapshots"].lookup(touched, batch_id))
        none = F.lit(None).cast("string")
        decision, ingested = F.when(F.col("kind") == 0, "NO_MATCH").when(F.col("kind") == 1, "AUTO_MATCH"), F.when(F.col("kind") == 2, "UPDATED")
        changed = materialize(changed.join(touched, _ENTITY).withColumn("snapshot_trigger", survivorship.trigger(none, none, ingested, decision)).drop("kind"), "changed")
        own["snapshots"].append(changed, batch_id)
        changed.write.mode("overwrite").parquet(f"{state}/history/batch={batch_id}")

    return run


def start(spark: SparkSession, folder: str, state: str, checkpoint: str, registry: DataFrame | None = None, files_per_batch: int = 100) -> StreamingQuery:
    """Resolve what is there and what arrives; Spark's checkpoint holds the stream's place."""
    stream = stream_lines(spark, folder, files_per_batch).writeStream.foreachBatch(resolver(state, registry=registry))
    return stream.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
