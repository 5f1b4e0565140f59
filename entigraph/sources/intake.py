"""What arrives, routed row by row: accepted records, and rejected ones with the reason, their place and what was sent."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.identity import keep_last_keys
from ..functions.text import strip, with_email
from ..functions.validation import record_reason
from ..operators.versions import check_sources
from ..schemas import ENVELOPE
from .tables import materialize, typed_records

#: Holds a line that is no JSON envelope, as it was sent.
MALFORMED = "_malformed"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Envelopes from JSON lines, with lines that are none (``_malformed``) and the file of each (``file``)."""
    return located(spark.read.schema(f"{ENVELOPE}, {MALFORMED} string").option("columnNameOfCorruptRecord", MALFORMED).json(path))


def stream_lines(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """``read_lines`` of files as they appear in ``folder``."""
    keep_last_keys(spark)
    reader = spark.readStream.schema(f"{ENVELOPE}, {MALFORMED} string").option("columnNameOfCorruptRecord", MALFORMED)
    return located(reader.option("maxFilesPerTrigger", files_per_batch).json(folder))


def located(rows: DataFrame) -> DataFrame:
    return rows.select("*", F.col("_metadata.file_path").alias("file"))


def route(envelopes: DataFrame, registry: DataFrame | None = None) -> DataFrame:
    """Every row with its ``reason``, null if it is accepted, and the typed ``data``; written once.

    Checked in this order: an envelope with tenant and number, the record itself, and, where a registry (tenant_id, name)
    is given, that the tenant has the source. A row is judged by itself: a bad one fails no other.
    """
    for c in (MALFORMED, "file"):
        if c not in envelopes.columns:
            envelopes = envelopes.withColumn(c, F.lit(None).cast("string"))
    # Written before the checks, which read the data many times.
    rows = materialize(with_email(typed_records(envelopes).drop("error"), F.col("data.email"), "_email"), "typed")
    broken = F.col(MALFORMED).isNotNull() | (F.coalesce(strip(F.col("tenant_id")), F.lit("")) == "") | F.coalesce(F.col("arrival_seq") < 0, F.lit(True)) | F.col("raw").isNull()
    own = record_reason(F.col("raw"), F.col("entity_type"), F.col("source"), F.col("external_id"), F.col("data"), F.col("_email"))
    rows = rows.withColumn("reason", F.when(broken | F.col("data").isNull(), "INVALID_REQUEST_BODY").otherwise(own)).drop("_email")
    if registry is not None:
        rows = check_sources(rows, registry).withColumn("reason", F.coalesce("reason", "error")).drop("error")
    return materialize(rows, "routed")


def accepted(routed: DataFrame) -> DataFrame:
    return routed.where("reason IS NULL").drop("reason", MALFORMED, "file")


def rejected(routed: DataFrame) -> DataFrame:
    """file, tenant_id, source, external_id, entity_type, arrival_seq, reason, and the bytes that were sent."""
    sent = F.coalesce(F.col(MALFORMED), F.col("raw"))
    return routed.where("reason IS NOT NULL").select("file", "tenant_id", "source", "external_id", "entity_type", "arrival_seq", "reason", F.encode(sent, "UTF-8").alias("sent"))
