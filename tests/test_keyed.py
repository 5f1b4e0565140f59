"""Keyed tables, the block-key index, routed intake and replay across batches."""

import json
import random

import pytest
from pyspark.sql import functions as F

from entigraph.functions.text import normalize_records
from entigraph.operators import blocking, key_index, versions
from entigraph.operators.resolution import resolve
from entigraph.schemas import DATA
from entigraph.sources import intake
from entigraph.sources.keyed import KeyedTable
from entigraph.streaming import arrivals

KINDS = {"k": "string", "i": "long", "v": "string"}


def table(tmp_path, **options):
    return KeyedTable(f"file://{tmp_path}/t", KINDS, ("k",), ("i",), **options)


def rows(spark, *values):
    return spark.createDataFrame(values, "k string, i long, v string, live boolean, other string")


def got(df):
    return sorted(map(tuple, df.select("k", "i", "v").collect()), key=str)


def scanned(df):
    """(files, rows) that the plan's scan reads."""
    df.collect()
    leaf = df._jdf.queryExecution().executedPlan().collectLeaves().head()
    return leaf.metrics().apply("numFiles").value(), leaf.metrics().apply("numOutputRows").value()


def test_newest_rows_of_given_keys(spark, tmp_path):
    t = table(tmp_path)
    ask = lambda *keys: spark.createDataFrame([(k, 0) for k in keys], "k string, x int")
    assert got(t.lookup(ask("a"))) == [] and got(t.read(spark)) == [] and t.segments(spark) == []
    t.append(rows(spark, ("a", 1, "x", None, ""), ("a", 2, "y", True, ""), ("b", 1, None, True, ""), (None, None, "n", True, "")), 0)
    t.append(rows(spark, ("a", 1, "z", True, ""), ("a", 2, None, False, ""), ("c", 1, "c", True, "")), 1)
    assert got(t.lookup(ask("a", "a", "q"))) == [("a", 1, "z")] and got(t.lookup(ask("a"), before=1)) == [("a", 1, "x"), ("a", 2, "y")]
    assert got(t.lookup(ask(None, "b"))) == [("b", 1, None), (None, None, "n")]
    assert got(t.lookup(ask())) == []
    t.append(rows(spark, ("a", 1, "again", True, "")), 1)  # a batch that runs again
    assert got(t.read(spark)) == [("a", 1, "again"), ("a", 2, "y"), ("b", 1, None), (None, None, "n")]


def test_unfinished_and_covered_segments_do_not_count(spark, tmp_path):
    t = table(tmp_path)
    for n in range(4):
        t.append(rows(spark, ("a", n % 2, f"v{n}", True, ""), ("b", n, "b", n != 2, "")), n)
    (tmp_path / "t" / "segment=3-3" / "_SUCCESS").unlink()
    assert t.segments(spark) == [(0, 0), (1, 1), (2, 2)]
    want = [("a", 0, "v2"), ("a", 1, "v1"), ("b", 0, "b"), ("b", 1, "b")]
    assert got(t.read(spark)) == want
    t.compact(spark, before=3)
    assert t.segments(spark) == [(0, 2)] and got(t.read(spark)) == want and (tmp_path / "t" / "segment=1-1").exists()
    t.append(rows(spark, ("b", 0, None, False, "")), 3)
    t.clean(spark)
    assert not (tmp_path / "t" / "segment=1-1").exists() and got(t.read(spark)) == want[:2] + want[3:]
    assert got(t.lookup(rows(spark, ("a", 0, "", True, "")), before=3)) == want[:2]


def _records(spark, first, n, shared=None):
    r = random.Random(first)
    out = []
    for i in range(first, first + n):
        data = {"name": f"Person {shared if shared is not None else i} Name", "email": f"u{shared if shared is not None else i}@example.com", "address": {"city": "Addis", "country": "ET"}}
        if r.random() < 0.3:
            data["phone"] = f"+2519{i:08d}"
        out.append(("t", "person", f"r{i:06d}", json.dumps(data)))
    d = spark.createDataFrame(out, "tenant_id string, entity_type string, record_id string, raw string").withColumn("data", F.from_json("raw", DATA))
    return normalize_records(d, wide=False)


def test_a_small_batch_reads_its_own_keys(spark, tmp_path):
    """Ten records against 2,000 others: the folders of their keys' buckets at most, and few of the rows in them."""
    population = _records(spark, 0, 2010).withColumns({"entity_id": F.concat(F.lit("e"), "record_id"), "status": F.lit("ACTIVE")}).cache()
    index = key_index.key_index(f"file://{tmp_path}/keys", bucket_bits=8)
    index.append(key_index.index_rows(population), 0)
    batch = _records(spark, 0, 10).withColumn("record_id", F.concat(F.lit("new"), "record_id")).cache()
    keys = key_index.keys_of(batch).distinct().count()
    files, read = scanned(index.pruned(key_index.keys_of(batch)).select("record_id"))
    every = index.read(spark).count()
    assert every > 4000 and keys >= 20 and 0 < files <= keys and read < every * keys / 200
    reached = key_index.reached_population(batch, index)
    want = blocking.generate_candidates(batch, population).select("record_id", "entity_id", "matched_on", "supporting_ids", "truncated")
    found = blocking.generate_candidates(batch, reached).select(want.columns)
    assert reached.count() == 10 and sorted(map(str, found.collect())) == sorted(map(str, want.collect())) and want.count() == 10


def test_an_index_gives_what_the_population_gives(spark, tmp_path):
    """A hot key beyond the cap, records that changed their keys, and merged entities."""
    hot, others = _records(spark, 0, 40, shared=7), _records(spark, 100, 30)
    entity = F.concat(F.lit("e"), F.pmod(F.xxhash64("record_id"), F.lit(25)).cast("string"))
    old = hot.unionByName(others).withColumns({"entity_id": entity, "status": F.lit("ACTIVE")})
    index = key_index.key_index(f"file://{tmp_path}/keys")
    index.append(key_index.index_rows(old), 0)
    changed = _records(spark, 100, 15, shared=7).withColumns({"entity_id": F.lit("moved"), "status": F.when(F.col("record_id") < "r000105", "MERGED").otherwise("ACTIVE")})
    index.append(key_index.index_rows(changed, others.where("record_id < 'r000115'")), 1)
    now = old.join(changed.select("record_id"), "record_id", "left_anti").unionByName(changed.select(old.columns)).cache()
    batch = _records(spark, 0, 3, shared=7).unionByName(_records(spark, 110, 8)).cache()
    columns = ["record_id", "decision", "entity_id", "supporting_id", "candidate_count"]
    want = resolve(batch, now, 5).select(columns)
    assert sorted(map(str, resolve(batch, key_index.reached_population(batch, index, 5), 5).select(columns).collect())) == sorted(map(str, want.collect()))


LINES = [
    {"tenant_id": "t", "source": "crm", "external_id": "a", "entity_type": "person", "arrival_seq": 0, "raw": '{"name": "Ann"}'},
    {"tenant_id": "t", "source": "CRM", "external_id": "b", "entity_type": "person", "arrival_seq": 1, "raw": '{"name": "Ann"}'},
    {"tenant_id": "t", "source": "crm", "external_id": "c", "entity_type": "person", "arrival_seq": 2, "raw": '{"name": "Ann", "oops": 1}'},
    {"tenant_id": "t", "source": "other", "external_id": "d", "entity_type": "person", "arrival_seq": 3, "raw": '{"name": "Ann"}'},
    {"tenant_id": "t", "source": "crm", "external_id": "e", "entity_type": "person", "arrival_seq": 4, "raw": '{"name": "Ann"'},
    {"tenant_id": "t", "source": "crm", "external_id": "f", "entity_type": "person", "arrival_seq": 5, "raw": '{"name": "Ann", "email": "bad"}'},
    {"tenant_id": None, "source": "crm", "external_id": "g", "entity_type": "person", "arrival_seq": 6, "raw": '{"name": "Ann"}'},
    {"tenant_id": "t", "source": "crm", "external_id": "h", "entity_type": "person", "raw": '{"name": "Ann"}'},
]
REASONS = {"b": "INVALID_SOURCE", "c": "UNKNOWN_FIELD", "d": "SOURCE_NOT_FOUND", "e": "INVALID_REQUEST_BODY", "f": "INVALID_EMAIL", "g": "INVALID_REQUEST_BODY", "h": "INVALID_REQUEST_BODY", None: "INVALID_REQUEST_BODY"}


def _put(tmp_path, name, lines):
    (tmp_path / "in").mkdir(exist_ok=True)
    (tmp_path / "in" / name).write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines))


def _registry(spark):
    return spark.createDataFrame([("t", "crm", 10), ("u", "other", 5)], "tenant_id string, name string, priority int")


def test_every_row_is_accepted_or_rejected_with_its_reason(spark, tmp_path):
    _put(tmp_path, "1.json", [*LINES, '{"tenant_id": "t", "sour', "no json"])
    routed = intake.route(intake.read_lines(spark, str(tmp_path / "in")), _registry(spark))
    bad = intake.rejected(routed).collect()
    assert [r.external_id for r in intake.accepted(routed).collect()] == ["a"] and routed.count() == 10
    assert len(bad) == 9 and {r.external_id: r.reason for r in bad} == REASONS and all(r.file.endswith("1.json") for r in bad)
    assert {bytes(r.sent) for r in bad if r.external_id is None} == {b'{"tenant_id": "t", "sour', b"no json"}
    assert intake.accepted(intake.route(intake.read_lines(spark, str(tmp_path / "in")))).count() == 2  # no registry, no such check


def test_the_stream_rejects_and_consolidates(spark, tmp_path):
    go = lambda: arrivals.start(spark, str(tmp_path / "in"), str(tmp_path / "state"), str(tmp_path / "check"), _registry(spark)).awaitTermination()
    line = lambda x, seq, **data: {"tenant_id": "t", "source": "crm", "external_id": x, "entity_type": "person", "arrival_seq": seq, "raw": json.dumps(data)}
    _put(tmp_path, "1.json", [*LINES[1:], line("x", 10, name="Ann Lee", email="a@example.com"), line("y", 11, name="Ann  Lee", email="a@example.com", phone="+251911111111")])
    go()
    own = arrivals.tables(str(tmp_path / "state"))
    assert arrivals.committed(spark, str(tmp_path / "state")) == 1
    assert spark.read.parquet(str(tmp_path / "state" / "rejected")).count() == 7
    first = own["snapshots"].read(spark).collect()
    assert [(s.canonical.name, s.canonical.phone, s.canonical_version, s.snapshot_trigger) for s in first] == [("Ann Lee", "+251911111111", 1, "ENTITY_CREATED")]
    assert {p.field: (p.priority, p.selection_rule) for p in first[0].provenance} == {"name": (10, "RECENCY"), "email": (10, "RECENCY"), "phone": (10, "ONLY_CANDIDATE")}
    # A changed record of the entity, an equal one, and a record of another entity: two snapshots.
    _put(tmp_path, "2.json", [line("x", 20, name="Ann Leigh", email="a@example.com"), line("y", 21, name="Ann  Lee", email="a@example.com", phone="+251911111111"), line("z", 22, name="Bob", email="b@example.com")])
    go()
    history = spark.read.parquet(str(tmp_path / "state" / "history")).collect()
    assert sorted((h.batch, h.canonical.name, h.canonical_version, h.snapshot_trigger) for h in history) == [(0, "Ann Lee", 1, "ENTITY_CREATED"), (1, "Ann Leigh", 2, "RECORD_UPDATED"), (1, "Bob", 1, "ENTITY_CREATED")]
    assert {(h.version, h.normalized.name) for h in own["heads"].read(spark).collect()} == {(2, "ann leigh"), (1, "ann lee"), (1, "bob")}
    assert {r.decision for r in spark.read.parquet(str(tmp_path / "state" / "answers")).collect()} == {"NO_MATCH", "AUTO_MATCH"}


@pytest.mark.parametrize("seed", [1, 2])
def test_replay_over_batches(spark, tmp_path, seed):
    """Batches one after another say what one batch of all says, with the answer that the first request of a key got."""
    r = random.Random(seed)
    asked = [(r.choice(["t", "u"]), r.choice([None, "k1", "k2", "k3", "k4"]), r.choice(["INGEST", "MERGE"]), r.choice("ab"), n) for n in range(60)]
    d = spark.createDataFrame(asked, "tenant_id string, key string, operation string, hash string, seq long")
    store = versions.answer_store(f"file://{tmp_path}/answers-{seed}")
    answer = lambda x: x.withColumn("answer", F.concat("hash", F.col("seq").cast("string")))
    found = []
    for n in range(3):
        batch = d.where(f"seq >= {20 * n} AND seq < {20 * (n + 1)}")
        rows = versions.replay_batch(batch, store, n, answer)
        found += rows.collect()
        assert sorted(map(str, rows.drop("answer").collect())) == sorted(map(str, versions.replay_batch(batch, store, n, answer).drop("answer").collect()))
    want = versions.idempotent_replay(d).collect()
    assert sorted(map(str, [x[:7] for x in found])) == sorted(map(str, [tuple(x) for x in want]))
    hashes = {n: h for *_, h, n in asked}
    assert all(x.answer == (None if x.outcome == "IDEMPOTENCY_KEY_REUSED" else f"{hashes[x.answered_by]}{x.answered_by}") for x in found)
    assert {x.outcome for x in found} == {"EXECUTED", "REPLAYED", "IDEMPOTENCY_KEY_REUSED"}
