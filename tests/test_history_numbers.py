"""Rows without a reference in the history's joins, and numbers whose digits need no trial."""

import random
import struct
from collections import Counter

from pyspark.sql import functions as F

from entigraph.functions.identity import canonical_json
from entigraph.functions.numbers import number_text
from entigraph.operators.views import history_view


def test_rows_without_a_reference_do_not_meet_in_one_task(spark):
    n = 2000
    snapshots = spark.range(n).select(F.lit("t").alias("tenant_id"), F.col("id").alias("entity_id"), F.col("id").alias("snapshot"), F.when(F.col("id") % 100 == 0, F.concat(F.lit("o"), (F.col("id") % 300).cast("string"))).alias("operation_id"), F.lit(None).cast("string").alias("decision_id"))
    ops = spark.createDataFrame([("t", f"o{i}", "MERGE", "a", "b", ["r"]) for i in (0, 7)], "tenant_id string, operation_id string, type string, source_id string, target_id string, record_ids array<string>")
    human = spark.createDataFrame([("t", f"d{i}", "APPROVE", "c") for i in (0, 7)], "tenant_id string, decision_id string, decision string, case_id string")
    options = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in options}
    try:
        for k, v in options.items():
            spark.conf.set(k, v)
        rows = history_view(snapshots, ops, human)
        found = rows.select("snapshot", "operation", "review", "missing", F.spark_partition_id().alias("part")).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    parts = Counter(r.part for r in found)
    assert sum(parts.values()) == n and max(parts.values()) < n / 2
    got = {r.snapshot: (r.operation.type if r.operation else None, r.missing) for r in found}
    assert got == {i: ("MERGE" if i % 300 == 0 else None, i % 100 == 0 and i % 300 != 0) for i in range(n)}


def test_numbers_of_few_digits_and_subnormal_ones(spark):
    draw = random.Random(1)
    few = [float(f"{draw.randrange(10**draw.randrange(1, 16))}e{draw.randrange(-300, 290)}") for _ in range(400)]
    tiny = [struct.unpack("<d", struct.pack("<Q", draw.randrange(1, 1 << draw.randrange(1, 53))))[0] for _ in range(200)]
    values = [x for x in few + tiny if x]
    rows = spark.createDataFrame(list(enumerate(values)), "i int, x double")
    got = [r.t for r in rows.select("i", number_text(F.col("x")).alias("t")).orderBy("i").collect()]
    digits = lambda t: t.split("e")[0].replace(".", "").strip("0")
    assert [float(t) for t in got] == values and [digits(t) for t in got] == [digits(repr(x)) for x in values]


def test_numbers_that_stay_as_they_are_written(spark):
    given = ["0", "-0", "0.0", "-0.5", "1.50", "12.25", "0.000001", "0.0000001", "0.00000012", "-3", "100.0", "123456789012.25", "0.1234567890123456", "9007199254740993", "1e2", "5E-9", "0.30000000000000004", "99999999999999.9", "999999999999999.9"]
    rows = spark.createDataFrame(list(enumerate(given)), "i int, t string")
    got = [r.j for r in rows.select("i", canonical_json(F.concat(F.lit('{"a":'), "t", F.lit(',"b":1.5}'))).alias("j")).orderBy("i").collect()]
    written = ["0", "0", "0", "-0.5", "1.5", "12.25", "0.000001", "1e-7", "1.2e-7", "-3", "100", "123456789012.25", "0.1234567890123456", "9007199254740992", "100", "5e-9", "0.30000000000000004", "99999999999999.9", "999999999999999.9"]
    assert got == [f'{{"a":{t},"b":1.5}}' for t in written]
