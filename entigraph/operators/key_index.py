"""A persisted index of block keys: a batch finds its candidates by reading its own keys' rows, not the population.

Each linked record has a row for each of its keys, with what a comparison needs, so nothing else is read. A changed record
or link replaces its rows; keys that a record no longer has are taken away.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..policy import max_candidates
from ..schemas import NORMALIZED
from ..sources.keyed import BUCKET_BITS, KeyedTable
from .blocking import block_keys

_KEY = ("tenant_id", "entity_type", "signal", "key")


def key_index(folder: str, bucket_bits: int = BUCKET_BITS) -> KeyedTable:
    columns = {**dict.fromkeys(_KEY, "string"), "record_id": "string", "entity_id": "string", "normalized": NORMALIZED}
    return KeyedTable(folder, columns, _KEY, ("record_id",), bucket_bits)


def keys_of(records: DataFrame, *columns: str) -> DataFrame:
    """(tenant_id, entity_type, signal, key) and these columns, for each key of the records."""
    rows = records.select("tenant_id", "entity_type", *columns, F.explode(block_keys(F.col("normalized"))).alias("k"))
    return rows.select("tenant_id", "entity_type", *columns, "k.signal", "k.key")


def index_rows(records: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """Rows to append for linked records (tenant_id, entity_type, record_id, entity_id, status, normalized).

    Records that are not ACTIVE lose their keys. ``before`` (tenant_id, entity_type, record_id, normalized) has what
    these records were before: keys that they have no more are taken away.
    """
    live = records.withColumn("live", F.col("status") == "ACTIVE")
    now = keys_of(live, "record_id", "entity_id", "live", "normalized")
    if before is None:
        return now
    same = ["tenant_id", "entity_type", "record_id", "signal", "key"]
    none = [F.lit(None).cast(t).alias(c) for c, t in (("entity_id", "string"), ("normalized", NORMALIZED))]
    gone = keys_of(before, "record_id").join(now.select(*same), same, "left_anti").select(*same, *none, F.lit(False).alias("live"))
    return now.unionByName(gone)


def reached_population(incoming: DataFrame, index: KeyedTable, cap: int | None = None, before: int | None = None) -> DataFrame:
    """The part of the population that the incoming records can use, as ``blocking`` takes it.

    Of each key the first entities up to the cap (one more shows an overflow, one makes up for the record itself) with
    two records each: candidates and their order are those of the whole population. ``incoming`` is read three times.
    """
    rows = index.lookup(keys_of(incoming), before)
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy(*_KEY, "entity_id").orderBy("record_id"))).where("nth <= 2")
    rows = rows.withColumn("place", F.dense_rank().over(Window.partitionBy(*_KEY).orderBy("entity_id"))).where(F.col("place") <= max_candidates(cap) + 2)
    return rows.groupBy("tenant_id", "entity_type", "record_id").agg(F.first("entity_id").alias("entity_id"), F.first("normalized").alias("normalized")).withColumn("status", F.lit("ACTIVE"))
