"""Normalizers, comparators, and the golden pairs: pair by pair, and as arrivals through the whole pipeline."""

import json
import math
import random
import struct

import pytest
from pyspark.sql import functions as F

from entigraph.functions import similarity as S
from entigraph.functions import text as T
from entigraph.functions.identity import canonical_json
from entigraph.functions.numbers import number_text
from entigraph.operators import matching, quality, resolution
from entigraph.operators.blocking import collapse_candidates
from entigraph.plans import ordered
from entigraph.plans.ordered import resolve_in_order
from entigraph.schemas import DATA

from .golden import CASES


def values(spark, function, inputs, schema="v string"):
    rows = spark.createDataFrame([(i, *x) for i, x in enumerate(inputs)], f"i int, {schema}")
    return [r[0] for r in rows.select(function(rows).alias("o"), "i").orderBy("i").collect()]


def test_text_and_names(spark):
    given = [None, "", "   ", " ", "  ＡＢＤＵＬ\tJosé  李  ", "a\u0085b", "a﻿b", "x　 y"]
    assert values(spark, lambda d: T.normalize_text(d.v), [(v,) for v in given]) == [None, None, None, None, "ABDUL José 李", "a\u0085b", "a b", "x y"]
    assert values(spark, lambda d: T.normalize_name(d.v), [("  Ｏ’ＮＥＩＬ\tJosé  李  ",)]) == ["o’neil josé 李"]
    assert values(spark, lambda d: T.collapse_whitespace(d.v), [(" Ａ  b ",)]) == ["Ａ b"]


GOOD_DOMAINS = [("HTTPS://WWW.Example.COM/", "example.com"), ("www.example.com.", "example.com"), ("münich.example", "xn--mnich-kva.example"), ("http://a-b.co", "a-b.co"),
                ("https://x.com?", "x.com"), ("https://x.com#", "x.com"), ("https://x.com/?#", "x.com"), ("ex%61mple.com", "example.com")]
BAD_DOMAINS = ["ftp://example.com", "https://example.com/path", "https://user@example.com", "https://example.com:443", "https://example.com?query=1", "https://example.com#fragment", "example.com?", "example.com#", "ex%2Fample.com",
               "example.com:443", "127.0.0.1", "localhost", "*.example.com", "example..com", None, "", "   ", "-a.example.com", "x" * 64 + ".com"]


def test_domains(spark):
    got = values(spark, lambda d: T.normalize_domain(d.v), [(v,) for v, _ in GOOD_DOMAINS] + [(v,) for v in BAD_DOMAINS])
    assert got == [x for _, x in GOOD_DOMAINS] + [None] * len(BAD_DOMAINS)


def test_emails(spark):
    bad = ["missing-at.example.com", ".user@example.com", "user.@example.com", "a..b@example.com", "a@b@example.com", "user()@example.com", "user,@example.com", "üser@example.com", "user@localhost", None, "", "  ", "a`b@example.com", "x" * 65 + "@example.com"]
    got = values(spark, lambda d: T.normalize_email(d.v), [(" User.Name+sales@EXAMPLE.COM ",), ("a@www.x.com",)] + [(v,) for v in bad])
    assert got == ["User.Name+sales@example.com", "a@x.com"] + [None] * len(bad)


def test_phones(spark):
    given = [("0911 223 344", "et"), ("+251 911 223 344", None), ("0911 223 344", None), ("123", "ET"), ("", "ET"), ("0911 223 344", "ZZ"), ("+34910000001", None), ("+12025550101", None), ("call me", "ET")]
    assert values(spark, lambda d: T.normalize_phone(d.v, d.c), given, "v string, c string") == ["+251911223344"] * 2 + [None] * 4 + ["+34910000001", "+12025550101", None]


def test_company_names(spark):
    given = ["Acme  Trading, PLC", "ACME Ltd.", "Limited", "foo,ltd", "A Co Inc", None, "Company Company"]
    got = values(spark, lambda d: T.normalize_company_name(d.v), [(v,) for v in given])
    assert [None if g is None else tuple(g) for g in got] == [
        ("acme trading, plc", "acme trading", "plc"), ("acme ltd.", "acme", "ltd"), ("limited", "limited", None), ("foo,ltd", "foo,ltd", None), ("a co inc", "a co", "inc"), None, ("company company", "company", "company"),
    ]


def test_similarities(spark):
    pairs = [("cafe", "café"), ("abc", "abc"), ("", "x"), (None, "x"), ("martha", "marhta"), ("dwayne", "duane"), ("abc", "xyz"), ("small widget", "old plate"), ("a b c", "c a d"), ("a b", "a b")]
    rows = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string")
    got = rows.select("i", S.edit_similarity(rows.a, rows.b).alias("e"), S.jaro_winkler_similarity(rows.a, rows.b).alias("j"), S.token_similarity(rows.a, rows.b).alias("t")).orderBy("i").collect()
    assert got[0].e == 0.75 and got[1].e == got[1].j == got[1].t == 1 and got[2].e is got[2].j is got[2].t is None and got[3].j is None
    assert got[4].j == pytest.approx(0.961111111111) and got[5].j == pytest.approx(0.84) and got[6].j == 0 and got[7].j == pytest.approx(0.583333333333, abs=1e-9)
    assert got[8].t == 0.5 and got[9].t == 1


def test_rounding_and_decisions(spark):
    rows = spark.createDataFrame([(0.00145, False), (0.919999, False), (0.92, False), (0.72, False), (0.719999, False), (0.99, True), (0.5, True)], "x double, b boolean")
    got = rows.select(matching.round_for_persistence(F.col("x")).alias("r"), matching.decide(F.col("x"), F.col("b")).alias("d")).collect()
    assert str(got[0].r) == "0.0014" and [g.d for g in got] == ["NO_MATCH", "REVIEW", "AUTO_MATCH", "REVIEW", "NO_MATCH", "REVIEW", "NO_MATCH"]


def test_canonical_json(spark):
    got = values(spark, lambda d: canonical_json(d.v), [('{"b": 1.0, "a": [2, {"d": null, "c": "x"}]}',), ("{bad",), (None,)])
    assert got == ['{"a":[2,{"c":"x","d":null}],"b":1}', None, None]
    numbers = '{"a":1e2,"b":100.0,"c":-0.0,"d":9007199254740993,"e":1E-7,"f":0.000001,"g":1e21,"h":0.1000,"i":[1e23,2.50]}'
    texts = r'{"k":"1e2 \" 1.50","l":"\u001f\u000b\n\\\\","m":1.0,"n\"2.0":true}'
    repeated = '{"n":"a","n":"b","m":{"x":1,"x":2}}'
    got = values(spark, lambda d: canonical_json(d.v), [(numbers,), (texts,), (repeated,), ('{"a":1e400}',), ('{"a":"Infinity","b":1e2}',), ("-1.50",), ("{}",)])
    assert got == [
        '{"a":100,"b":100,"c":0,"d":9007199254740992,"e":1e-7,"f":0.000001,"g":1e+21,"h":0.1,"i":[1e+23,2.5]}',
        r'{"k":"1e2 \" 1.50","l":"\u001f\u000b\n\\\\","m":1,"n\"2.0":true}', '{"m":{"x":2},"n":"b"}', None, '{"a":"Infinity","b":100}', "-1.5", "{}",
    ]


def test_shortest_numbers(spark):
    """Powers of two and ten, subnormal and random doubles against Python's own shortest form."""
    r = random.Random(5)
    some = [2.0**k for k in range(-1074, 1024, 3)] + [float(f"1e{k}") for k in range(-323, 309, 2)] + [r.getrandbits(r.randint(1, 63)) * s for s in (5e-324, 1.0) for _ in range(500)]
    some += [x for x in (struct.unpack("d", r.randbytes(8))[0] for _ in range(3000)) if math.isfinite(x)]
    got = spark.createDataFrame([(float(x),) for x in some], "x double").select("x", number_text(F.col("x")).alias("t")).collect()
    assert all(float(g.t) == g.x for g in got)
    figures = lambda t: t.lstrip("-").lower().partition("e")[0].replace(".", "").strip("0")
    assert [figures(g.t) for g in got] == [figures(repr(g.x)) for g in got]


def _golden(spark):
    rows = []
    for i, (case, kind, a, b, *_) in enumerate(CASES):
        for k, data in enumerate((a, b)):
            rows.append((case, kind, f"{case}/{'ab'[k]}", 2 * i + k, json.dumps(data)))
    d = spark.createDataFrame(rows, "tenant_id string, entity_type string, record_id string, arrival_seq long, raw string")
    return T.normalize_records(d.withColumn("data", F.from_json("raw", DATA)))


def test_golden_pairs(spark):
    r = _golden(spark)
    a = r.where("record_id LIKE '%/a'").select("tenant_id", "entity_type", F.col("normalized").alias("left"))
    b = r.where("record_id LIKE '%/b'").select("tenant_id", F.col("normalized").alias("right"))
    got = {x.tenant_id: x for x in matching.score_pairs(a.join(b, "tenant_id")).collect()}
    assert {c[0]: got[c[0]].decision for c in CASES} == {c[0]: c[4] for c in CASES}
    scores = [1.0, 0.963888888889, 0.737222222222, 0.7, 1.0, 1.0, 0.5, 0.753775853776]
    assert [got[c[0]].score for c in CASES] == pytest.approx(scores, abs=2e-12)
    conflict = got["company-registration-conflict-review"]
    assert [x.code for x in conflict.contradictions] == ["REGISTRATION_ID_CONFLICT"] and conflict.blocked
    assert [x.code for x in got["person-shared-name-no-match"].contradictions] == ["EMAIL_CONFLICT", "PHONE_CONFLICT"]


def test_golden_pipeline(spark):
    r = _golden(spark)
    empty = r.select("tenant_id", "entity_type", "record_id", F.lit("").alias("entity_id"), F.lit("").alias("status"), "normalized").limit(0)
    outcomes, _ = resolve_in_order(r, empty)
    second = {x.tenant_id: x for x in outcomes.where("record_id LIKE '%/b'").collect()}
    assert {c[0]: (second[c[0]].decision, second[c[0]].candidate_count) for c in CASES} == {c[0]: (c[5], c[6]) for c in CASES}
    observed = spark.createDataFrame([(c[0], c[7], second[c[0]].decision, second[c[0]].candidate_count) for c in CASES], "id string, same_identity boolean, decision string, candidate_count long")
    rates = quality.quality_rates(observed).first()
    assert (rates.precision, rates.recall, rates.false_positive_rate, rates.review_rate, rates.auto_resolution_rate, rates.positive_candidate_recall) == (1.0, 0.6, 0.0, 0.25, 0.75, 0.8)
    table = {x.same_identity: (x.AUTO_MATCH, x.REVIEW, x.NO_MATCH) for x in quality.confusion(observed).collect()}
    assert table == {True: (3, 1, 1), False: (0, 1, 2)}


def test_candidates_are_capped_in_order(spark):
    rows = [("t", "person", "r", 0, "EXACT_EMAIL", f"e{k}", f"s{k}", k) for k in (1, 2, 3)] + [("t", "person", "r", 1, "EXACT_PHONE", e, s, k) for k, (e, s) in enumerate([("e0", "s9"), ("e1", "s1")], 1)]
    passes = spark.createDataFrame(rows, "tenant_id string, entity_type string, record_id string, rank int, signal string, entity_id string, supporting_id string, place int")
    got = collapse_candidates(passes, 2).orderBy("place").collect()
    assert [(g.entity_id, g.matched_on, g.supporting_ids, g.truncated) for g in got] == [("e1", ["EXACT_EMAIL", "EXACT_PHONE"], ["s1"], True), ("e2", ["EXACT_EMAIL"], ["s2"], True)]


def test_waiting_records_meet_each_other(spark):
    data = [(0, "a@example.com", "Ann Lee"), (1, "a@EXAMPLE.com", "Ann Lee"), (2, "b@example.com", "Bo"), (3, "a@example.com", "ANN LEE")]
    d = spark.createDataFrame([("t", "person", f"r{i}", i, json.dumps({"name": n, "email": e})) for i, e, n in data], "tenant_id string, entity_type string, record_id string, arrival_seq long, raw string")
    r = T.normalize_records(d.withColumn("data", F.from_json("raw", DATA)))
    empty = r.select("tenant_id", "entity_type", "record_id", F.lit("").alias("entity_id"), F.lit("").alias("status"), "normalized").limit(0)
    outcomes, after = resolve_in_order(r, empty)
    got = {x.record_id: (x.decision, x.linked_entity_id) for x in outcomes.collect()}
    assert [got[f"r{i}"][0] for i in range(4)] == ["NO_MATCH", "AUTO_MATCH", "NO_MATCH", "AUTO_MATCH"]
    assert got["r0"][1] == got["r1"][1] == got["r3"][1] != got["r2"][1] and after.count() == 4


def _arrivals(spark, rows):
    """Normalized arrivals of (tenant, record id, sequence, data) rows."""
    d = spark.createDataFrame([(t, "person", r, i, json.dumps(x)) for t, r, i, x in rows], "tenant_id string, entity_type string, record_id string, arrival_seq long, raw string")
    return T.normalize_records(d.withColumn("data", F.from_json("raw", DATA))).select("tenant_id", "entity_type", "record_id", "arrival_seq", "normalized")


def _nobody(rows):
    return rows.select("tenant_id", "entity_type", "record_id", F.lit("").alias("entity_id"), F.lit("").alias("status"), "normalized").limit(0)


def test_blocks_equal_one_after_another(spark):
    """Random chains with a cap that bites: blocks of three and of any size end as a record at a time does."""
    r, n, tenants = random.Random(1), 8, 16
    names, mails, phones = ["Ann Lee", "Ann Leigh", "Bo Li"], ["a@example.com", "b@example.com", None], ["+14155550100", "+14155550101", None]
    places = [{"city": "Ulm", "country": "DE"}, None]
    data = lambda: {k: v for k, v in (("name", r.choice(names)), ("email", r.choice(mails)), ("phone", r.choice(phones)), ("address", r.choice(places))) if v}
    rows = [(f"t{t}", f"r{r.randrange(10**6):06}-{i}", i, data()) for t in range(tenants) for i in range(n)]
    d = _arrivals(spark, rows).cache()
    known, want = _nobody(d), {}
    for i in range(n):
        step = d.where(F.col("arrival_seq") == i)
        found = resolution.resolve(step.drop("arrival_seq"), known, 2)
        linked = resolution.apply_decisions(found)["links"].select("tenant_id", "record_id", "entity_id")
        own = found.select("tenant_id", "record_id", "decision", "supporting_id", "candidate_count", F.round("confidence", 9).alias("score")).join(linked, ["tenant_id", "record_id"], "left").collect()
        want.update({(x.tenant_id, x.record_id): tuple(x[2:]) for x in own})
        entities = spark.createDataFrame([(x.tenant_id, x.record_id, x.entity_id) for x in own if x.entity_id], "tenant_id string, record_id string, entity_id string")
        new = step.join(entities, ["tenant_id", "record_id"]).withColumn("status", F.lit("ACTIVE")).select(*known.columns)
        known = spark.createDataFrame(known.unionByName(new).collect(), known.schema)
    assert {w[0] for w in want.values()} == {"AUTO_MATCH", "REVIEW", "NO_MATCH"}
    for size in (3, ordered.BLOCK):
        outcomes, after = resolve_in_order(d, _nobody(d), 2, size=size)
        rows = outcomes.select("tenant_id", "record_id", "decision", "supporting_id", "candidate_count", F.round("confidence", 9), "linked_entity_id").collect()
        assert {(x[0], x[1]): tuple(x[2:]) for x in rows} == want and len(rows) == len(want)
        assert after.count() == sum(w[-1] is not None for w in want.values())


def test_a_key_of_many_arrivals_takes_few_rounds(spark, monkeypatch):
    """An address that 700 arrivals share is done in two blocks; the number of rounds is not that of the arrivals."""
    rows = [("t", f"r{i:04}", i, {"name": "Ann Lee", "email": "a@example.com"}) for i in range(700)] + [("t", "z", 0, {"name": "Bo", "email": "b@example.com"})]
    blocks, rounds = [], []
    decide, choose = ordered._decide_block, ordered.choose_outcome
    monkeypatch.setattr(ordered, "_decide_block", lambda block, *more: blocks.append(block.count()) or decide(block, *more))
    monkeypatch.setattr(ordered, "choose_outcome", lambda best: rounds.append(1) or choose(best))
    d = _arrivals(spark, rows)
    outcomes, _ = resolve_in_order(d, _nobody(d))
    got = {x.decision: (x.n, x.entities) for x in outcomes.groupBy("decision").agg(F.count("*").alias("n"), F.countDistinct("linked_entity_id").alias("entities")).collect()}
    assert got == {"NO_MATCH": (2, 2), "AUTO_MATCH": (699, 1)}
    assert blocks == [513, 188] and len(rounds) <= 8
