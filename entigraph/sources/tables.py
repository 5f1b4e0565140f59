"""Readers and writers: Parquet tables, record envelopes in JSON, golden pairs, reports."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.identity import parsed_json
from ..schemas import ADDRESS_KEYS, COMPANY_KEYS, DATA, ENVELOPE, PERSON_KEYS


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where it is unset, one of our own, on a local session only."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage and survives lost executors."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Envelopes from JSON lines; ``raw`` is the record's own JSON text, as sent."""
    return typed_records(spark.read.schema(ENVELOPE).json(path))


def typed_records(envelopes: DataFrame) -> DataFrame:
    """With ``data`` read from ``raw``; a record whose data is no JSON object has null data and a reason.

    A value of another JSON type than the record format's counts as absent (validation refuses it).
    """
    value = F.when(F.col("raw").rlike(r"^\s*\{"), parsed_json(F.col("raw")))
    return envelopes.withColumns({"data": typed_data(value), "error": F.when(value.isNull(), "INVALID_REQUEST_BODY")})


def typed_data(value: Column) -> Column:
    """The record of a parsed JSON object: texts only where the JSON has texts, an address only where it has an object."""
    at = lambda path: F.try_variant_get(value, f"$.{path}", "variant")
    text = lambda path: F.when(F.schema_of_variant(at(path)) == "STRING", F.try_variant_get(value, f"$.{path}", "string"))
    address = F.when(F.schema_of_variant(at("address")).startswith("OBJECT"), F.struct(*[text(f"address.{k}").alias(k) for k in ADDRESS_KEYS]))
    plain = [k for k in dict.fromkeys([*PERSON_KEYS, *COMPANY_KEYS]) if k not in ("address", "attributes")]
    parts = {**{k: text(k) for k in plain}, "address": address, "attributes": F.to_json(at("attributes"))}
    order = ("name", "email", "phone", "company", "company_domain", "domain", "registration_id", "address", "attributes")
    return F.when(value.isNotNull(), F.struct(*[parts[k].alias(k) for k in order])).cast(DATA)


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    """Golden pairs of a JSON file {version, cases: [...]} as rows (id, entity_type, record_a, record_b, expected)."""
    cases = spark.read.option("multiLine", True).schema(
        f"version string, cases array<struct<id:string,entity_type:string,record_a:{DATA},record_b:{DATA},expected_decision:string,rationale:string>>"
    ).json(path)
    return cases.select(F.explode("cases").alias("c")).select("c.*")


def write_report(report: DataFrame, path: str) -> None:
    """One JSON object a row."""
    report.write.mode("overwrite").json(path)


def batch_items(records: DataFrame, job_id: str) -> DataFrame:
    """A submitted batch as positioned, queued items."""
    return records.select("tenant_id", F.lit(job_id).alias("job_id"), F.col("arrival_seq").alias("position"), *[c for c in records.columns if c not in ("tenant_id", "arrival_seq")], F.lit("QUEUED").alias("state"))
