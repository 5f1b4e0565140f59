"""Versions, survivorship, operations, cursors, reads and the stream."""

import json
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from entigraph.functions.text import normalize_records
from entigraph.functions.validation import first_reason, has_identity, record_reason, split_reason
from entigraph.operators import jobs, operations, paging, survivorship, versions, views
from entigraph.plans.ordered import apply_in_order
from entigraph import policy
from entigraph.schemas import DATA
from entigraph.sources import tables
from entigraph.sources.tables import typed_records
from entigraph.streaming import arrivals


def test_versions(spark):
    rows = [(0, "person", '{"a": 1, "b": 2}'), (1, "person", '{"b": 2, "a": 1}'), (2, "company", '{"a": 9}'), (3, "person", '{"a": 2}'), (4, "person", '{"a": 1, "b": 2}')]
    d = spark.createDataFrame([("t", "crm", "x", k, n, r) for n, k, r in rows], "tenant_id string, source string, external_id string, entity_type string, arrival_seq long, raw string")
    got = versions.record_versions(d).orderBy("arrival_seq").collect()
    assert [(g.status, g.version) for g in got] == [("CREATED", 1), ("UNCHANGED", 1), ("ENTITY_TYPE_CONFLICT", 1), ("UPDATED", 2), ("UPDATED", 3)]
    assert versions.current_records(versions.record_versions(d)).first().version == 3


def _member(spark, rows):
    d = spark.createDataFrame(rows, "entity_type string, record_id string, priority int, observed_at timestamp, raw string")
    d = d.select(F.lit("t").alias("tenant_id"), F.lit("e").alias("entity_id"), "entity_type", "record_id", F.col("record_id").alias("external_id"), F.lit("s").alias("source"), "priority", "observed_at", F.from_json("raw", DATA).alias("data"))
    return normalize_records(d)


def test_survivorship(spark):
    t = datetime(2026, 9, 9, 10)
    rows = [
        ("person", "r1", 100, t, json.dumps({"name": "Low Authority", "email": "A@Example.com", "phone": "bad"})),
        ("person", "r2", 10, t, json.dumps({"name": "  Abdulkerim   Hassen  ", "address": {"city": "Addis", "postal_code": " 1000 ", "line2": "x"}})),
        ("person", "r3", 10, datetime(2026, 9, 9, 10, 0, 0, 400), json.dumps({"address": {"city": "addis"}})),
    ]
    got = {g.field: g for g in survivorship.select_winners(survivorship.field_candidates(_member(spark, rows))).collect()}
    assert set(got) == {"name", "email", "address.city", "address.postal_code"}
    assert (got["name"].value, got["name"].raw_value, got["name"].selection_rule, got["name"].completeness) == ("Abdulkerim Hassen", "  Abdulkerim   Hassen  ", "SOURCE_PRIORITY", 17)
    assert (got["email"].value, got["email"].selection_rule) == ("A@example.com", "ONLY_CANDIDATE")
    assert (got["address.city"].record_id, got["address.city"].selection_rule) == ("r2", "STABLE_TIE_BREAK")  # microseconds do not count
    assert got["address.postal_code"].value == "1000"
    e = survivorship.canonical_entities(_member(spark, rows)).first()
    assert e.canonical.name == "Abdulkerim Hassen" and e.canonical.address.city == "Addis" and e.canonical.address.line1 is None


def test_snapshots_without_change_are_not_written(spark):
    rows = [("company", "r1", 1, datetime(2026, 1, 1), json.dumps({"name": "Acme Ltd", "registration_id": " ET-1 "}))]
    e = survivorship.canonical_entities(_member(spark, rows))
    assert e.first().canonical.registration_id == "ET-1"
    none = spark.createDataFrame([], "tenant_id string, entity_id string, hash string, canonical_version int")
    first = survivorship.changed_snapshots(e, none)
    assert first.first().canonical_version == 1
    assert survivorship.changed_snapshots(e, first).count() == 0
    assert survivorship.changed_snapshots(e, first, forced=True).first().canonical_version == 2


def _state(spark):
    entities = spark.createDataFrame([("t", "a", "person", "ACTIVE", 1, None), ("t", "b", "person", "ACTIVE", 2, None), ("t", "c", "company", "ACTIVE", 1, None), ("t", "m", "person", "MERGED", 3, "b")], "tenant_id string, entity_id string, entity_type string, status string, canonical_version int, merged_into string")
    links = spark.createDataFrame([("t", "r1", "a"), ("t", "r2", "a"), ("t", "r3", "b"), ("t", "r4", "b"), ("t", "r5", "c")], "tenant_id string, record_id string, entity_id string")
    return entities, links, operations.entity_members(entities, links)


def test_merges_in_guard_order(spark):
    entities, links, members = _state(spark)
    asked = [("1", "a", "b", 1, 2), ("2", "a", "a", 1, 1), ("3", "m", "b", 0, 2), ("4", "a", "c", 0, 0), ("5", "a", "b", 9, 2), ("6", "a", "zz", 1, 1)]
    d = spark.createDataFrame([(i, "t", s, t, x, y) for i, s, t, x, y in asked], "operation_id string, tenant_id string, source_id string, target_id string, source_version int, target_version int")
    got = {g.operation_id: (g.error, g.record_ids) for g in operations.plan_merges(d, members).collect()}
    assert got == {"1": (None, ["r1", "r2"]), "2": ("INVALID_ENTITY_MERGE", None), "3": ("ENTITY_NOT_ACTIVE", None), "4": ("ENTITY_TYPE_CONFLICT", None), "5": ("ENTITY_VERSION_CONFLICT", None), "6": ("ENTITY_NOT_FOUND", None)}
    plan = operations.plan_merges(d.where("operation_id = '1'"), members).withColumn("type", F.lit("MERGE"))
    after = operations.apply_operations(entities, links, plan)
    state = {r.entity_id: (r.status, r.merged_into, r.canonical_version) for r in after["entities"].collect()}
    assert state["a"] == ("MERGED", "b", 2) and state["b"] == ("ACTIVE", None, 3)
    counts = {r.entity_id: r.record_count for r in views.record_counts(after["entities"], after["links"]).collect()}
    assert counts == {"a": 0, "b": 4, "c": 1, "m": 0}


def test_splits_and_reversals(spark):
    entities, links, members = _state(spark)
    d = spark.createDataFrame([("1", "t", "a", 1, ["R1"]), ("2", "t", "a", 1, ["r1", "r2"]), ("3", "t", "a", 1, ["r9"]), ("4", "t", "a", 0, ["r1"])], "operation_id string, tenant_id string, source_id string, entity_version int, record_ids array<string>")
    got = {g.operation_id: (g.error, g.record_ids) for g in operations.plan_splits(d, members).collect()}
    assert got == {"1": (None, ["r1"]), "2": ("INVALID_ENTITY_SPLIT", None), "3": ("SOURCE_RECORD_NOT_FOUND", None), "4": ("ENTITY_VERSION_CONFLICT", None)}
    log = spark.createDataFrame([("t", "op1", "MERGE", "m", "b", ["r3"], None), ("t", "op2", "MERGE", "m", "b", ["r9"], None), ("t", "op3", "MERGE", "m", "b", ["r3"], None), ("t", "op4", "UNMERGE", "b", "m", ["r3"], "op3")], "tenant_id string, operation_id string, type string, source_id string, target_id string, record_ids array<string>, reversed_id string")
    d = spark.createDataFrame([(f"u{k}", "t", "b", 2, f"op{k}") for k in (1, 2, 3, 7)], "operation_id string, tenant_id string, source_id string, entity_version int, merge_event_id string")
    got = {g.operation_id: g.error for g in operations.plan_reversals(d, members, log).collect()}
    assert got == {"u1": None, "u2": "MERGE_REVERSAL_CONFLICT", "u3": "MERGE_ALREADY_REVERSED", "u7": "MERGE_EVENT_NOT_FOUND"}


def test_operations_in_order(spark):
    entities, links, members = _state(spark)
    schema = "tenant_id string, operation_id string, seq long, type string, source_id string, target_id string, source_version int, target_version int, record_ids array<string>, merge_event_id string"
    log = spark.createDataFrame([], "operation_id string, tenant_id string, type string, source_id string, target_id string, record_ids array<string>, reversed_id string")
    # a into b, back out of it, b into a, and a split of what that makes; one request that comes too late.
    asked = [("1", "MERGE", "a", "b", 1, 2, None, None), ("2", "UNMERGE", "b", None, 3, None, None, "1"), ("3", "MERGE", "b", "a", 4, 3, None, None), ("4", "SPLIT", "a", None, 4, None, ["r3"], None), ("5", "MERGE", "b", "a", 4, 3, None, None)]
    d = spark.createDataFrame([("t", i, k, *x) for k, (i, *x) in enumerate(asked)], schema)
    after = apply_in_order(entities, links, d, log)
    assert {r.operation_id: r.error for r in after["plans"].collect()} == {"1": None, "2": None, "3": None, "4": None, "5": "ENTITY_NOT_ACTIVE"}
    state = {r.entity_id: (r.status, r.merged_into, r.canonical_version) for r in after["entities"].collect()}
    assert len(state) == after["entities"].count() == 5 and state["b"] == ("MERGED", "a", 5) and state["a"] == ("ACTIVE", None, 5) and state["m"] == ("MERGED", "b", 3)
    owner = {r.record_id: r.entity_id for r in after["links"].collect()}
    assert owner["r1"] == owner["r2"] == owner["r4"] == "a" and owner["r3"] not in ("a", "b") and owner["r5"] == "c"
    both = operations.plan_merges(spark.createDataFrame([("x", "t", "a", "b", 1, 2), ("y", "t", "b", "a", 2, 1)], "operation_id string, tenant_id string, source_id string, target_id string, source_version int, target_version int"), members)
    with pytest.raises(Exception, match="in order"):
        operations.apply_operations(entities, links, both.withColumn("type", F.lit("MERGE")))["entities"].collect()


def test_reviews(spark):
    entities, links, _ = _state(spark)
    records = spark.createDataFrame([("t", f"r{k}", "company" if k == 5 else "person", 1) for k in range(1, 9)], "tenant_id string, record_id string, entity_type string, version int")
    cases = spark.createDataFrame([("t", "k1", "r6", "r1", "a", 1, None, "OPEN"), ("t", "k2", "r3", "r1", "a", 1, 1, "OPEN"), ("t", "k3", "r7", "r1", "b", 1, 1, "OPEN"), ("t", "k4", "r8", "r1", "a", 1, 1, "RESOLVED")], "tenant_id string, case_id string, record_id string, supporting_id string, entity_id string, captured_source_version int, captured_candidate_version int, status string")
    graph = operations.review_graph(cases, records, links, entities)
    asked = spark.createDataFrame([("t", "k1", "APPROVE", 1, 1), ("t", "k2", "APPROVE", 1, 1), ("t", "k3", "APPROVE", 1, 2), ("t", "k4", "REJECT", 1, 1), ("t", "k9", "REJECT", 1, 1)], "tenant_id string, case_id string, decision string, expected_source_version int, expected_candidate_version int")
    got = {g.case_id: (g.error, g.linked_entity_id) for g in operations.decide_reviews(asked, graph).collect()}
    assert got == {"k1": (None, "a"), "k2": ("REVIEW_RECORD_ALREADY_LINKED", None), "k3": ("REVIEW_EVIDENCE_STALE", None), "k4": ("REVIEW_ALREADY_RESOLVED", None), "k9": ("REVIEW_NOT_FOUND", None)}


def test_cursors():
    at, own = datetime(2026, 1, 2, 3, 4, 5, 678000, timezone.utc), "123e4567-e89b-42d3-a456-426614174000"
    assert paging.decode_record_cursor(paging.encode_record_cursor(at, own)) == (at, own)
    assert paging.decode_history_cursor(paging.encode_history_cursor(7)) == 7
    assert paging.decode_review_cursor(paging.encode_review_cursor(at, own, "OPEN"), "OPEN") == (at, own)
    for bad in ("", "!!", "e30", paging.encode_history_cursor(1) + "A", "x" * 3000):
        with pytest.raises(paging.InvalidCursor):
            paging.decode_record_cursor(bad)
    with pytest.raises(paging.InvalidCursor):
        paging.decode_review_cursor(paging.encode_review_cursor(at, own, "OPEN"), "RESOLVED")


def test_validation(spark):
    rows = [("person", "crm", "x", '{"name": " "}'), ("person", "CRM", "x", '{"name": "A"}'), ("company", "crm", " ", '{"domain": "a.example"}'), ("company", "crm", "y", '{"domain": "a.example", "oops": 1}'), ("person", "crm", "y", '{"email": "bad"}'), ("company", "crm", "y", '{"registration_id": "1"}'), ("person", "crm", "y", "[1]")]
    d = typed_records(spark.createDataFrame([("t", s, e, k, i, r) for i, (k, s, e, r) in enumerate(rows)], "tenant_id string, source string, external_id string, entity_type string, arrival_seq long, raw string"))
    got = [r[0] for r in d.select(record_reason(d.raw, d.entity_type, d.source, d.external_id, d.data).alias("e"), "arrival_seq").orderBy("arrival_seq").collect()]
    assert got == ["IDENTITY_REQUIRED", "INVALID_SOURCE", "INVALID_EXTERNAL_ID", "UNKNOWN_FIELD", "INVALID_EMAIL", None, "INVALID_REQUEST_BODY"]
    one = "123e4567-e89b-42d3-a456-426614174000"
    s = spark.createDataFrame([([one], None, True, False), (None, one, False, True), ([one], one, True, True), (None, None, False, False), ([one, one.upper()], None, True, False)], "ids array<string>, event string, a boolean, b boolean")
    got = [r[0] for r in s.select(split_reason(s.ids, s.event, s.a, s.b, F.lit(1), F.lit("why"))).collect()]
    assert got == [None, None, "EXACTLY_ONE_SELECTION", "EXACTLY_ONE_SELECTION", "INVALID_ID"]
    assert first_reason((F.lit(True), "x")) is not None and has_identity is not None


def test_wrong_types_count_as_absent(spark):
    raw = ['{"name": 5, "email": {"a": 1}, "phone": true, "domain": "A.example", "address": [1]}', '{"name": "Ann", "address": {"city": "Addis", "country": 7, "line1": null}, "attributes": {"b": [1]}}', "[]", "{bad"]
    d = typed_records(spark.createDataFrame([(k, r) for k, r in enumerate(raw)], "k long, raw string"))
    got = {r.k: (r.data, r.error) for r in d.collect()}
    assert got[0][0].asDict(True) == {**dict.fromkeys(got[0][0].__fields__), "domain": "A.example"} and got[0][1] is None
    assert (got[1][0].name, got[1][0].address.city, got[1][0].address.country, got[1][0].attributes) == ("Ann", "Addis", None, '{"b":[1]}')
    assert got[2] == got[3] == (None, "INVALID_REQUEST_BODY")
    reason = d.select("k", record_reason(d.raw, F.lit("company"), F.lit("crm"), F.lit("x"), d.data).alias("e")).where("k < 2").orderBy("k").collect()
    assert [r.e for r in reason] == ["INVALID_FIELD_TYPE", "INVALID_FIELD_TYPE"]


def test_files_of_records_pairs_and_reports(spark, tmp_path):
    lines = [json.dumps({"tenant_id": "t", "source": "crm", "external_id": "x", "entity_type": "person", "arrival_seq": 4, "raw": json.dumps({"name": "Ann"})})]
    (tmp_path / "records.json").write_text("\n".join(lines))
    records = tables.read_records(spark, str(tmp_path / "records.json"))
    assert records.first().data.name == "Ann"
    item = tables.batch_items(records, "job").first()
    assert (item.job_id, item.position, item.state, item.external_id) == ("job", 4, "QUEUED", "x")
    pair = {"id": "a", "entity_type": "person", "record_a": {"name": "A"}, "record_b": {"name": "B"}, "expected_decision": "REVIEW", "rationale": "why"}
    (tmp_path / "golden.json").write_text(json.dumps({"version": "1", "cases": [pair]}, indent=1))
    golden = tables.read_golden(spark, str(tmp_path / "golden.json")).first()
    assert (golden.id, golden.record_a.name, golden.record_b.name, golden.expected_decision) == ("a", "A", "B", "REVIEW")
    tables.write_report(spark.createDataFrame([("a", 1)], "id string, n int"), str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report")).first().n == 1


def test_limits():
    assert policy.max_candidates() == 100 and policy.page_limit() == 25 and policy.max_candidates(1000) == 1000
    for limit, bad in ((policy.max_candidates, 0), (policy.max_candidates, 1001), (policy.page_limit, 0), (policy.page_limit, 101)):
        with pytest.raises(ValueError):
            limit(bad)


def test_damaged_rows_are_errors(spark):
    winner = "array<struct<field:string,value:string,raw_value:string,record_id:string,source:string,external_id:string,priority:int,selection_rule:string,completeness:int,observed_at:timestamp>>"
    good = ("name", "Ann", "Ann", "r", "crm", "x", 1, "RECENCY", 3, datetime(2026, 1, 1))
    d = spark.createDataFrame([("t", "e", [good])], f"tenant_id string, entity_id string, provenance {winner}")
    assert views.history_provenance(d).first().provenance["name"].canonical_value == "Ann"
    bad = spark.createDataFrame([("t", "e", [(*good[:7], "LUCK", *good[8:])])], d.schema)
    with pytest.raises(Exception, match="damaged"):
        views.history_provenance(bad).collect()
    names = "decision_id case_id decision reason actor_id entity_id source_record_version candidate_record_version candidate_canonical_version canonical_version policy_version created_at"
    stored = spark.createDataFrame([("1",) * 10 + ("review-v0", "now")], ", ".join(f"{c} string" for c in names.split()))
    with pytest.raises(Exception, match="unsupported policy"):
        views.review_decision_view(stored).collect()


def test_stream(spark, tmp_path):
    def put(name, rows):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / name).write_text("\n".join(json.dumps({"tenant_id": "t", "source": "crm", "external_id": x, "entity_type": "person", "arrival_seq": k, "raw": json.dumps({"name": n, "email": e})}) for k, x, n, e in rows))

    def go():
        arrivals.start(spark, str(tmp_path / "in"), str(tmp_path / "state"), str(tmp_path / "checkpoint")).awaitTermination()

    put("1.json", [(0, "x", "Ann Lee", "a@example.com"), (1, "y", "Ann Lee", "a@example.com"), (2, "q", "Ann Leh", None)])
    go()
    put("2.json", [(3, "z", "ANN LEE", "a@EXAMPLE.com"), (4, "x", "Changed", "c@example.com"), (5, "y", "Ann Lee", "a@example.com"), (6, "x", "Changed again", "c@example.com")])
    go()
    put("3.json", [(7, "w", "Changed again", "c@example.com"), (8, "x", "Changed again", "c@example.com")])
    go()
    read = lambda t: spark.read.parquet(str(tmp_path / "state" / t))
    links = read("links")
    assert links.count() == 5 and links.select("entity_id").distinct().count() == 2
    got = {(r.external_id, r.arrival_seq): (r.status, r.version) for r in read("versions").collect()}
    assert got[("x", 4)] == ("UPDATED", 2) and got[("x", 6)] == ("UPDATED", 3) and got[("x", 8)] == ("UNCHANGED", 3) and got[("y", 5)] == ("UNCHANGED", 1) and got[("w", 7)] == ("CREATED", 1)
    assert read("answers").where("batch = 1").count() == 2 and read("outcomes").count() == 5


def test_jobs(spark):
    """Claims, attempts up to the third, repeated and unknown names, and attempts that were overtaken."""
    at = lambda second: f"2030-01-01 00:00:{second:02}"
    given = [("t", "a", "QUEUED", 0, 1), ("t", "b", "RETRYING", 3, 2), ("t", "c", "RUNNING", 2, 30), ("t", "d", "SUCCEEDED", 1, 0), ("u", "a", "FAILED", 3, 0)]
    rows = spark.createDataFrame([(*g[:4], None, at(g[4])) for g in given], "tenant_id string, job_id string, status string, attempts int, error_code string, at string")
    rows = rows.select("*", F.col("at").cast("timestamp").alias("dispatch_after")).drop("at")
    now = F.lit(at(10)).cast("timestamp")
    claimed = jobs.claim_jobs(rows, now, 1)
    assert [(r.tenant_id, r.job_id) for r in claimed.where("claimed").collect()] == [("t", "a")]
    assert {r.job_id for r in jobs.claim_jobs(claimed.drop("claimed"), now).where("claimed").collect()} == {"b"}
    assert claimed.where("job_id = 'a' AND tenant_id = 't'").first().dispatch_after.second == 15 and claimed.count() == 5

    named = lambda *names: spark.createDataFrame([*names, names[0], ("t", "none", 1)], "tenant_id string, job_id string, number int")
    show = lambda df: {(r.tenant_id, r.job_id): (r.status, r.attempts, r.error_code) for r in df.collect()}
    started = jobs.start_attempts(rows, named(*[(t, j, 0) for t, j, *_ in given]))
    assert show(started) == {("t", "a"): ("RUNNING", 1, None), ("t", "b"): ("FAILED", 3, "BATCH_RETRIES_EXHAUSTED"), ("t", "c"): ("RUNNING", 3, None), ("t", "d"): ("SUCCEEDED", 1, None), ("u", "a"): ("FAILED", 3, None)}
    broken = show(jobs.break_attempts(started, named(("t", "a", 1), ("t", "c", 3), ("t", "d", 1))))
    assert broken["t", "a"] == ("RETRYING", 1, None) and broken["t", "c"] == ("FAILED", 3, "BATCH_RETRIES_EXHAUSTED") and broken["t", "d"] == ("SUCCEEDED", 1, None)
    assert show(jobs.break_attempts(started, named(("t", "a", 2)))) == show(started)
    lost = show(jobs.fail_deliveries(rows, named(("t", "a", 0), ("t", "d", 0))))
    assert lost["t", "a"] == ("FAILED", 0, "BATCH_DELIVERY_FAILED") and lost["t", "d"] == ("SUCCEEDED", 1, None)
    assert jobs.claim_jobs(rows.limit(0), now).count() == 0 and show(jobs.start_attempts(rows.limit(0), named(("t", "a", 0)))) == {}
