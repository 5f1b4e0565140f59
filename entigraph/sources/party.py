"""A person and company relation derived from the order tables, for tables that have no such records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normalize_records
from ..schemas import DATA
from .tables import materialize

#: The same text serves Spark and DuckDB.
PARTY_SQL = """
SELECT 'crm' AS source, 10 AS priority, concat('c', CAST(c_custkey AS STRING)) AS external_id,
       'person' AS entity_type, c_name AS name,
       concat('user', CAST(c_custkey % 700 AS STRING), '@Example.com') AS email,
       CASE WHEN c_custkey % 4 <> 0 THEN concat('+2519', lpad(CAST(c_custkey % 1100 AS STRING), 8, '0')) END AS phone,
       CAST(NULL AS STRING) AS domain, CAST(NULL AS STRING) AS registration_id, lower(r_name) AS city, concat('N', chr(65 + n_nationkey)) AS country
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
UNION ALL
SELECT 'billing', 100, concat('b', CAST(c_custkey AS STRING)), 'person', upper(c_name),
       concat('user', CAST(c_custkey % 700 AS STRING), '@example.com'),
       concat('+251 9 ', lpad(CAST(c_custkey % 1100 AS STRING), 8, '0')),
       CAST(NULL AS STRING), CAST(NULL AS STRING), lower(r_name), concat('N', chr(65 + n_nationkey))
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE c_custkey % 5 = 0
UNION ALL
SELECT 'registry', 50, concat('s', CAST(s_suppkey AS STRING)), 'company',
       concat(s_name, CASE WHEN s_suppkey % 2 = 0 THEN ' Ltd.' ELSE ' LIMITED' END),
       CAST(NULL AS STRING), CAST(NULL AS STRING), concat('www.sup', CAST(s_suppkey % 40 AS STRING), '.example'),
       CASE WHEN s_suppkey % 3 <> 0 THEN concat(' Reg-', CAST(s_suppkey % 80 AS STRING), ' ') END, lower(r_name), concat('N', chr(65 + n_nationkey))
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
"""


def party(spark: SparkSession, folder: str) -> DataFrame:
    """The relation, from tables read for this call alone."""
    tables = {t: spark.read.parquet(f"{folder}/{t}.parquet") for t in ("customer", "supplier", "nation", "region")}
    text = PARTY_SQL
    for name in tables:
        text = text.replace(f"FROM {name} ", f"FROM {{{name}}} ").replace(f"JOIN {name} ", f"JOIN {{{name}}} ")
    return spark.sql(text, **tables)


def records(spark: SparkSession, folder: str) -> DataFrame:
    """The relation as records: tenant_id, record_id, source, priority, external_id, entity_type, data, normalized.

    All values are ASCII, so the normalizers stay in the JVM. The rows are written once: whatever reads them takes its
    columns from there, and nothing is normalized again.
    """
    p = party(spark, folder)
    null = F.lit(None).cast("string")
    address = F.struct(null.alias("line1"), null.alias("line2"), F.col("city").alias("city"), null.alias("region"), null.alias("postal_code"), F.col("country").alias("country"))
    parts = {"name": F.col("name"), "email": F.col("email"), "phone": F.col("phone"), "company": null, "company_domain": null, "domain": F.col("domain"), "registration_id": F.col("registration_id"), "address": address, "attributes": null}
    data = F.struct(*[c.alias(k) for k, c in parts.items()]).cast(DATA)
    rows = p.select(F.lit("t1").alias("tenant_id"), F.concat_ws(":", "source", "external_id").alias("record_id"), "source", "priority", "external_id", "entity_type", data.alias("data"))
    # Few rows to read, but dear ones to normalize: they are dealt to all cores.
    return materialize(normalize_records(rows.repartition(spark.sparkContext.defaultParallelism), wide=False), "records")


def population(rows: DataFrame) -> DataFrame:
    """Master records (crm and registry), each already linked to an entity of its own."""
    return rows.where("source IN ('crm', 'registry')").select("tenant_id", "entity_type", "record_id", F.concat(F.lit("e:"), "record_id").alias("entity_id"), F.lit("ACTIVE").alias("status"), "normalized")


def incoming(rows: DataFrame) -> DataFrame:
    """Records to resolve: billing, and the registry against itself."""
    return rows.where("source IN ('billing', 'registry')").select("tenant_id", "entity_type", "record_id", "normalized")
