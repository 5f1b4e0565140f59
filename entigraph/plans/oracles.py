"""DuckDB SQL for the registered queries, written from the semantics, not from the plans."""

from __future__ import annotations

import re

from ..policy import LEGAL_SUFFIXES
from ..sources.party import PARTY_SQL

_SUFFIX = f"'^(.*[^, ])[, ]* ({'|'.join(sorted(LEGAL_SUFFIXES, key=len, reverse=True))})\\.?$'"

_N = f"""
p AS ({PARTY_SQL}),
n AS (
  SELECT 't1' AS tenant_id, source || ':' || external_id AS record_id, source, priority, external_id, entity_type, name AS raw_name, email AS raw_email, domain AS raw_domain,
         city AS raw_city, country AS raw_country, registration_id AS raw_registration,
         lower(regexp_replace(trim(name), '\\s+', ' ', 'g')) AS name,
         split_part(email, '@', 1) || '@' || lower(split_part(email, '@', 2)) AS email,
         regexp_replace(lower(domain), '^www\\.', '') AS domain, lower(city) AS city, upper(country) AS country,
         regexp_replace(phone, '[^0-9+]', '', 'g') AS phone, lower(trim(registration_id)) AS registration
  FROM p),
b AS (SELECT *, CASE WHEN entity_type = 'company' THEN coalesce(nullif(regexp_extract(name, {_SUFFIX}, 1), ''), name) END AS base FROM n)"""

_KEYS = """
i AS (SELECT * FROM b WHERE source IN ('billing', 'registry')),
m AS (SELECT *, 'e:' || record_id AS entity_id FROM b WHERE source IN ('crm', 'registry')),
met AS (
  SELECT i.record_id, i.entity_type, 0 AS rank, 'EXACT_EMAIL' AS signal, m.entity_id, m.record_id AS supporting FROM i JOIN m ON i.email = m.email AND i.entity_type = m.entity_type AND i.record_id <> m.record_id
  UNION ALL
  SELECT i.record_id, i.entity_type, 1, 'EXACT_PHONE', m.entity_id, m.record_id FROM i JOIN m ON i.phone = m.phone AND i.entity_type = m.entity_type AND i.record_id <> m.record_id
  UNION ALL
  SELECT i.record_id, i.entity_type, 2, 'COMPANY_DOMAIN', m.entity_id, m.record_id FROM i JOIN m ON i.domain = m.domain AND i.entity_type = m.entity_type AND i.record_id <> m.record_id
  UNION ALL
  SELECT i.record_id, i.entity_type, 3, 'NAME_LOCATION', m.entity_id, m.record_id FROM i JOIN m ON substr(i.name, 1, 64) = substr(m.name, 1, 64) AND i.city = m.city AND i.country = m.country AND i.entity_type = m.entity_type AND i.record_id <> m.record_id),
firsts AS (SELECT record_id, entity_type, rank, signal, entity_id, min(supporting) AS supporting_id FROM met GROUP BY ALL)"""

_PAIRS = """
placed AS (SELECT *, row_number() OVER (PARTITION BY record_id, signal ORDER BY entity_id) AS place FROM firsts),
ents AS (SELECT record_id, entity_id, min(rank) AS r FROM placed WHERE place <= 100 GROUP BY ALL),
kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY r, entity_id) AS k FROM ents) WHERE k <= 100),
pairs AS (SELECT DISTINCT f.record_id, f.entity_type, f.entity_id, f.supporting_id FROM placed f JOIN kept USING (record_id, entity_id) WHERE f.place <= 100),
x AS (
  SELECT q.*, l.email = r.email AS email_exact, l.domain = r.domain AS domain_exact, l.country = r.country AS country_exact,
         l.phone = r.phone AS phone_exact, CASE WHEN q.entity_type = 'company' THEN l.registration = r.registration END AS registration_exact,
         CASE WHEN q.entity_type = 'person' THEN l.name ELSE l.base END AS a, CASE WHEN q.entity_type = 'person' THEN r.name ELSE r.base END AS b,
         l.base AS la, r.base AS ra, l.city || ' ' || l.country AS lad, r.city || ' ' || r.country AS rad
  FROM pairs q JOIN b l ON q.record_id = l.record_id JOIN b r ON q.supporting_id = r.record_id),
f AS (
  SELECT *, CASE WHEN a = b THEN 1.0 ELSE 1 - levenshtein(a, b)::DOUBLE / greatest(length(a), length(b)) END AS name_edit,
         len(list_intersect(string_split(la, ' '), string_split(ra, ' ')))::DOUBLE / len(list_distinct(list_concat(string_split(la, ' '), string_split(ra, ' ')))) AS company_token,
         len(list_intersect(string_split(lad, ' '), string_split(rad, ' ')))::DOUBLE / len(list_distinct(list_concat(string_split(lad, ' '), string_split(rad, ' ')))) AS address_token
  FROM x)"""



def _jaro(pairs: str) -> str:
    """CTE jw (a, b, jw): Jaro-Winkler of the distinct pairs of differing texts, one character of ``a`` after another."""
    return f"""
jp AS (SELECT DISTINCT a, b FROM {pairs} WHERE a <> b),
jr AS (
  SELECT a, b, 0 AS i, 0::BIGINT AS taken, '' AS lefts FROM jp
  UNION ALL
  SELECT a, b, i + 1, CASE WHEN j IS NULL THEN taken ELSE taken | (1::BIGINT << CAST(j AS INTEGER)) END, CASE WHEN j IS NULL THEN lefts ELSE lefts || substr(a, i + 1, 1) END
  FROM (SELECT *, list_filter(range(greatest(0, i - reach), least(length(b), i + reach + 1)), lambda k: substr(b, CAST(k AS INTEGER) + 1, 1) = substr(a, i + 1, 1) AND (taken >> CAST(k AS INTEGER)) & 1 = 0)[1] AS j
        FROM (SELECT *, greatest(0, greatest(length(a), length(b)) // 2 - 1) AS reach FROM jr WHERE i < length(a)))),
jm AS (
  SELECT a, b, lefts, length(lefts) AS m,
         array_to_string(list_transform(list_filter(range(length(b)), lambda k: (taken >> CAST(k AS INTEGER)) & 1 = 1), lambda k: substr(b, CAST(k AS INTEGER) + 1, 1)), '') AS rights
  FROM jr WHERE i = length(a)),
js AS (
  SELECT a, b, CASE WHEN m = 0 THEN 0.0::DOUBLE ELSE (m::DOUBLE / length(a) + m::DOUBLE / length(b) + (m - len(list_filter(range(1, m + 1), lambda k: substr(lefts, k, 1) <> substr(rights, k, 1)))::DOUBLE / 2) / m) / 3 END AS jaro,
         len(list_filter(range(1, 5), lambda k: length(a) >= k AND length(b) >= k AND substr(a, 1, k) = substr(b, 1, k))) AS prefix
  FROM jm),
jw AS (SELECT a, b, CASE WHEN jaro >= 0.7 THEN least(1.0::DOUBLE, jaro + prefix * 0.1::DOUBLE * (1 - jaro)) ELSE jaro END AS jw FROM js)"""


def _scores(jaro: bool) -> str:
    """CTE d: the pairs with signals, scores and decisions, with Jaro-Winkler or without it."""
    jw = "CASE WHEN f.a = f.b THEN 1.0::DOUBLE ELSE jw.jw END" if jaro else "NULL::DOUBLE"
    join = " LEFT JOIN jw ON f.a = jw.a AND f.b = jw.b" if jaro else ""
    return (_jaro("f") + "," if jaro else "") + f"""
s AS (
  SELECT f.*, {jw} AS name_jw, CASE WHEN email_exact THEN 1.0::DOUBLE END AS s_email, CASE WHEN phone_exact THEN 1.0::DOUBLE END AS s_phone,
         greatest(name_edit, {jw}, CASE WHEN entity_type = 'company' THEN company_token END) AS s_name,
         CASE WHEN domain_exact THEN 1.0::DOUBLE END AS s_company,
         greatest(address_token, CASE WHEN country_exact THEN 1.0::DOUBLE END) AS s_location,
         (CASE WHEN email_exact = false THEN 1 ELSE 0 END + CASE WHEN phone_exact = false THEN 1 ELSE 0 END + CASE WHEN domain_exact = false THEN 1 ELSE 0 END + CASE WHEN country_exact = false THEN 1 ELSE 0 END) AS warnings,
         coalesce(registration_exact = false, false) AS blocked
  FROM f{join}),
w AS (
  SELECT *, floor((0.0::DOUBLE + CASE WHEN s_email IS NOT NULL THEN 0.4::DOUBLE ELSE 0 END + CASE WHEN s_phone IS NOT NULL THEN 0.25::DOUBLE ELSE 0 END + CASE WHEN s_name IS NOT NULL THEN 0.2::DOUBLE ELSE 0 END
         + CASE WHEN s_company IS NOT NULL THEN 0.1::DOUBLE ELSE 0 END + CASE WHEN s_location IS NOT NULL THEN 0.05::DOUBLE ELSE 0 END) * 1e12 + 0.5) / 1e12 AS active_weight FROM s),
c AS (
  SELECT *, coalesce(floor(0.4::DOUBLE * s_email / active_weight * 1e12 + 0.5) / 1e12, 0) + coalesce(floor(0.25::DOUBLE * s_phone / active_weight * 1e12 + 0.5) / 1e12, 0)
         + coalesce(floor(0.2::DOUBLE * s_name / active_weight * 1e12 + 0.5) / 1e12, 0)
         + coalesce(floor(0.1::DOUBLE * s_company / active_weight * 1e12 + 0.5) / 1e12, 0) + coalesce(floor(0.05::DOUBLE * s_location / active_weight * 1e12 + 0.5) / 1e12, 0) AS total FROM w),
z AS (SELECT *, floor(least(greatest(total, 0), 1) * 1e12 + 0.5) / 1e12 AS base_score, floor(least(0.15::DOUBLE * warnings, 1) * 1e12 + 0.5) / 1e12 AS penalty FROM c),
t AS (SELECT *, floor(least(greatest(base_score - penalty, 0), 1) * 1e12 + 0.5) / 1e12 AS score FROM z),
d AS (SELECT *, CASE WHEN score >= 0.92 AND NOT blocked THEN 'AUTO_MATCH' WHEN score >= 0.72 THEN 'REVIEW' ELSE 'NO_MATCH' END AS decision FROM t)"""


_SCORES, _JARO_SCORES = _scores(False), _scores(True)

_OUTCOME = """
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY record_id, entity_id ORDER BY score DESC, supporting_id) AS rb FROM d) WHERE rb = 1),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY CASE decision WHEN 'AUTO_MATCH' THEN 0 WHEN 'REVIEW' THEN 1 ELSE 2 END, score DESC, entity_id, supporting_id) AS ro,
         count(*) FILTER (decision = 'AUTO_MATCH') OVER (PARTITION BY record_id) AS autos, count(*) OVER (PARTITION BY record_id) AS candidates FROM best),
o AS (
  SELECT i.record_id, i.entity_type, CASE WHEN autos > 1 THEN 'REVIEW' ELSE coalesce(decision, 'NO_MATCH') END AS decision, r.entity_id, r.supporting_id, coalesce(score, 0) AS confidence,
         coalesce(candidates, 0) AS candidate_count
  FROM i LEFT JOIN (SELECT * FROM ranked WHERE ro = 1) r ON i.record_id = r.record_id)"""

_ROUND = "CAST(floor({0} * 10000.0::DOUBLE + 0.5) / 10000.0::DOUBLE AS DECIMAL(5,4))"


def _r(x: str) -> str:
    return _ROUND.format(x)


def _with(*parts: str, select: str) -> str:
    return "WITH RECURSIVE " + ",".join(parts) + "\n" + select


def _block(signal: str) -> str:
    return _with(_N, _KEYS, select=f"SELECT record_id, entity_id, supporting_id FROM firsts WHERE signal = '{signal}'")


def _features(kind: str) -> str:
    return _with(_N, _KEYS, _PAIRS, select=f"""
SELECT record_id, supporting_id, email_exact, phone_exact, registration_exact, {_r('name_edit')} AS name_edit, {_r('company_token')} AS company_token, domain_exact, {_r('address_token')} AS address_token, country_exact,
       concat_ws(',', CASE WHEN email_exact = false THEN 'EMAIL_CONFLICT' END, CASE WHEN phone_exact = false THEN 'PHONE_CONFLICT' END, CASE WHEN domain_exact = false THEN 'COMPANY_DOMAIN_CONFLICT' END, CASE WHEN country_exact = false THEN 'COUNTRY_CONFLICT' END,
       CASE WHEN registration_exact = false THEN 'REGISTRATION_ID_CONFLICT' END) AS contradictions
FROM f WHERE entity_type = '{kind}'""")


_NEXT_PART = "pp AS (SELECT p_partkey, p_name AS a, lead(p_name) OVER w AS b, p_brand AS x, lead(p_brand) OVER w AS y, lead(p_partkey) OVER w AS o FROM part WINDOW w AS (PARTITION BY p_size ORDER BY p_partkey))"

def _winners(tag: str = "", where: str = "true") -> str:
    """CTE win (and mem, cand, rk) of the records that ``where`` takes; ``tag`` is added to the names."""
    sql = """
mem AS (SELECT *, coalesce(email, domain) AS entity_id, ((length(external_id) * 7 + ascii(right(external_id, 1))) % 5) AS day FROM b WHERE @where),
cand AS (
  SELECT entity_id, record_id, priority, day, 'name' AS field, trim(regexp_replace(raw_name, '\\s+', ' ', 'g')) AS value, length(name) AS completeness FROM mem
  UNION ALL SELECT entity_id, record_id, priority, day, 'email', email, 1 FROM mem WHERE email IS NOT NULL
  UNION ALL SELECT entity_id, record_id, priority, day, 'phone', phone, 1 FROM mem WHERE phone IS NOT NULL
  UNION ALL SELECT entity_id, record_id, priority, day, 'registration_id', trim(raw_registration), length(trim(raw_registration)) FROM mem WHERE raw_registration IS NOT NULL
  UNION ALL SELECT entity_id, record_id, priority, day, 'domain', domain, 1 FROM mem WHERE entity_type = 'company'
  UNION ALL SELECT entity_id, record_id, priority, day, 'address.city', raw_city, length(city) FROM mem
  UNION ALL SELECT entity_id, record_id, priority, day, 'address.country', country, 1 FROM mem),
rk AS (
  SELECT *, row_number() OVER w AS r, lead(priority) OVER w AS p2, lead(completeness) OVER w AS c2, lead(day) OVER w AS d2
  FROM cand WINDOW w AS (PARTITION BY entity_id, field ORDER BY priority, completeness DESC, day DESC, record_id)),
win AS (
  SELECT *, CASE WHEN p2 IS NULL THEN 'ONLY_CANDIDATE' WHEN priority <> p2 THEN 'SOURCE_PRIORITY' WHEN completeness <> c2 THEN 'COMPLETENESS' WHEN day <> d2 THEN 'RECENCY' ELSE 'STABLE_TIE_BREAK' END AS selection_rule
  FROM rk WHERE r = 1)"""
    for name in ("mem", "cand", "rk", "win"):
        sql = re.sub(rf"\b{name}\b", name + tag, sql)
    return sql.replace("@where", where)


_MEMBERS = f"{_N},{_winners()}"

_ENTITIES = """
c AS (
  SELECT c_custkey AS k, CASE WHEN c_custkey % 11 = 0 THEN 'company' ELSE 'person' END AS kind, c_custkey % 7 = 0 AS merged, c_custkey % 5 AS v FROM customer),
lk AS (SELECT o_orderkey AS rec, o_custkey AS k FROM orders WHERE o_custkey % 7 <> 0),
cnt AS (SELECT k, count(*) AS n, min(rec) AS low FROM lk GROUP BY k),
st AS (SELECT c.*, coalesce(cnt.n, 0) AS n, cnt.low FROM c LEFT JOIN cnt USING (k))"""

_MERGES = """
ask AS (SELECT k AS source, k + CASE WHEN k % 13 = 0 THEN 0 ELSE 1 END AS target, v AS sv, (k + 1) % 5 + CASE WHEN k % 17 = 0 THEN 1 ELSE 0 END AS tv FROM st),
mg AS (
  SELECT ask.source, ask.target, s.n AS moves,
         CASE WHEN ask.source = ask.target THEN 'INVALID_ENTITY_MERGE' WHEN t.k IS NULL THEN 'ENTITY_NOT_FOUND' WHEN s.merged OR t.merged THEN 'ENTITY_NOT_ACTIVE'
              WHEN s.kind <> t.kind THEN 'ENTITY_TYPE_CONFLICT' WHEN s.n + t.n > 1000 THEN 'ENTITY_OPERATION_LIMIT' WHEN s.n = 0 OR t.n = 0 THEN 'INVALID_ENTITY_MERGE'
              WHEN s.v <> ask.sv THEN 'ENTITY_VERSION_CONFLICT' WHEN t.v <> ask.tv THEN 'ENTITY_VERSION_CONFLICT' END AS error
  FROM ask JOIN st s ON s.k = ask.source LEFT JOIN st t ON t.k = ask.target)"""

ORACLES: dict[str, str] = {
    "norm_name": "WITH p AS (" + PARTY_SQL + ") SELECT source, external_id, lower(regexp_replace(trim(name), '\\s+', ' ', 'g')) AS name FROM p",
    "norm_email": "WITH p AS (" + PARTY_SQL + ") SELECT source, external_id, split_part(email, '@', 1) || '@' || lower(split_part(email, '@', 2)) AS email FROM p",
    "norm_domain_pages": "SELECT page_id, regexp_replace(lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)), '^www\\.', '') AS domain FROM pages",
    "norm_domain_strict": "SELECT page_id, nullif(regexp_replace(regexp_extract(lower(url), '^https?://([^/?#:@]+)/?$', 1), '^www\\.', ''), '') AS domain FROM pages",
    "norm_phone": """
SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN '+2519' || lpad(CAST((c_custkey * 7919) % 100000000 AS VARCHAR), 8, '0')
                                     WHEN 1 THEN '+2549' || lpad(CAST((c_custkey * 7919) % 100000000 AS VARCHAR), 8, '0') END AS phone FROM customer""",
    "company_suffix": f"WITH {_N} SELECT external_id, name AS full_name, base, nullif(regexp_extract(name, {_SUFFIX}, 2), '') AS legal_suffix FROM b WHERE entity_type = 'company'",
    "address_struct": f"WITH {_N} SELECT record_id, city, country, CAST(NULL AS VARCHAR) AS line1 FROM b",
    "name_prefix": "SELECT doc_id, substr(text, 1, 64) AS prefix, CAST(length(text) AS BIGINT) AS length FROM documents",
    "display_form": "SELECT doc_id, md5(trim(regexp_replace(text, '[\\t\\n\\x0B\\f\\r \\x{00a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{feff}]+', ' ', 'g'))) AS shown_md5, trim(text) <> '' AS present FROM documents",
    "identity_required": f"WITH {_N} SELECT record_id, CASE WHEN length(external_id) % 2 <> 0 OR coalesce(email, CASE WHEN entity_type = 'company' THEN domain END) IS NULL THEN 'IDENTITY_REQUIRED' END AS reason FROM b",
    "source_slug_valid": """
SELECT doc_id, CASE WHEN NOT regexp_full_match(CASE WHEN doc_id % 7 = 0 THEN upper(source) ELSE source END, '[a-z][a-z0-9_-]*') THEN 'INVALID_NAME'
                    WHEN doc_id % 1200 > 1000 THEN 'INVALID_PRIORITY' END AS reason FROM documents""",
    "record_validation": f"""WITH {_N}, k AS (SELECT record_id, CAST(substr(external_id, 2) AS BIGINT) AS n FROM b)
SELECT record_id, CASE WHEN n % 90 = 0 THEN 'IDENTITY_REQUIRED' WHEN n % 90 = 9 THEN 'INVALID_REQUEST_BODY' ELSE CASE n % 9 WHEN 1 THEN 'INVALID_SOURCE' WHEN 2 THEN 'INVALID_EXTERNAL_ID'
       WHEN 3 THEN 'INVALID_ENTITY_TYPE' WHEN 4 THEN 'UNKNOWN_FIELD' WHEN 5 THEN 'INVALID_FIELD_TYPE' WHEN 6 THEN 'FIELD_TOO_LONG' WHEN 7 THEN 'INVALID_EMAIL' WHEN 8 THEN 'INVALID_ADDRESS' END END AS reason FROM k""",
    "idempotency_key_valid": "SELECT event_id, event_id % 5 <> 0 AS valid FROM events",
    "canonical_numbers": """
SELECT l_orderkey, l_linenumber, '{"d":' || CASE WHEN d = 0 THEN '0' WHEN d = 10 THEN '1e-8' ELSE d || 'e-9' END || ',"n":"1.50","p":'
       || rtrim(rtrim(CAST(CAST(l_extendedprice AS DECIMAL(18, 2)) AS VARCHAR), '0'), '.') || ',"q":' || CAST(l_quantity AS BIGINT) || '}' AS payload
FROM (SELECT *, CAST(round(l_discount * 100) AS BIGINT) AS d FROM lineitem)""",
    "canonical_json": "SELECT event_id, sha256('{\"a\":' || event_id || ',\"e\":\"' || event_type || '\",\"u\":' || user_id || '}') AS hash FROM events",
    "block_email": _block("EXACT_EMAIL"),
    "block_phone": _block("EXACT_PHONE"),
    "block_domain": _block("COMPANY_DOMAIN"),
    "block_name_location": _block("NAME_LOCATION"),
    "block_union_cap": _with(_N, _KEYS, select="""
, placed AS (SELECT *, row_number() OVER (PARTITION BY record_id, signal ORDER BY entity_id) AS place FROM firsts),
over_ AS (SELECT record_id, max(place) > 2 AS over FROM placed GROUP BY record_id),
ents AS (
  SELECT record_id, entity_id, min(rank) AS r, string_agg(signal, ',' ORDER BY rank) AS matched_on, list_distinct(list(supporting_id ORDER BY rank)) AS s, min(supporting_id) AS s1
  FROM placed WHERE place <= 2 GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY r, entity_id) AS k, count(*) OVER (PARTITION BY record_id) AS n FROM ents)
SELECT record_id, entity_id, matched_on, CASE WHEN len(s) = 1 THEN s1 ELSE array_to_string(s, ',') END AS supporting_ids, (over OR n > 2) AS truncated FROM k JOIN over_ USING (record_id) WHERE k <= 2""").replace("\n\n,", ",").replace("GROUP BY ALL)\n\n, placed", "GROUP BY ALL), placed"),
    "pair_exact": f"WITH {_NEXT_PART} SELECT p_partkey, CASE WHEN p_partkey % 5 <> 0 THEN x = y END AS same_brand FROM pp WHERE o IS NOT NULL",
    "pair_edit": f"WITH {_NEXT_PART} SELECT p_partkey, {_r('CASE WHEN a = b THEN 1.0 ELSE 1 - levenshtein(a, b)::DOUBLE / greatest(length(a), length(b)) END')} AS edit FROM pp WHERE o IS NOT NULL",
    "pair_token": f"""WITH {_NEXT_PART} SELECT p_partkey, {_r("len(list_intersect(string_split(a, ' '), string_split(b, ' ')))::DOUBLE / len(list_distinct(list_concat(string_split(a, ' '), string_split(b, ' '))))")} AS tokens FROM pp WHERE o IS NOT NULL""",
    "features_person": _features("person"),
    "features_company": _features("company"),
    "score_pairs": _with(_N, _KEYS, _PAIRS, _SCORES, select=f"SELECT record_id, supporting_id, {_r('active_weight')} AS active_weight, {_r('base_score')} AS base_score, {_r('penalty')} AS penalty, {_r('score')} AS score, decision FROM d"),
    "decide_outcome": _with(_N, _KEYS, _PAIRS, _SCORES, _OUTCOME, select=f"""
SELECT record_id, decision, CASE WHEN decision <> 'NO_MATCH' THEN entity_id END AS entity_id, CASE WHEN decision <> 'NO_MATCH' THEN supporting_id END AS supporting_id, {_r('confidence')} AS confidence, candidate_count FROM o"""),
    "score_pairs_jaro_winkler": _with(_N, _KEYS, _PAIRS, _JARO_SCORES, select=f"""
SELECT record_id, supporting_id, {_r('name_edit')} AS name_edit, {_r('name_jw')} AS name_jaro_winkler, {_r('s_name')} AS name, {_r('base_score')} AS base_score, {_r('score')} AS score, decision FROM d"""),
    "resolve_records": _with(_N, _KEYS, _PAIRS, _JARO_SCORES, _OUTCOME, select=f"""
SELECT record_id, decision, CASE WHEN decision <> 'NO_MATCH' THEN entity_id END AS entity_id, {_r('confidence')} AS confidence, candidate_count FROM o"""),
    "pair_jaro_winkler": f"WITH RECURSIVE {_NEXT_PART},{_jaro('pp')} SELECT p_partkey, {_r('CASE WHEN pp.a = pp.b THEN 1.0::DOUBLE ELSE jw END')} AS jaro_winkler FROM pp LEFT JOIN jw ON pp.a = jw.a AND pp.b = jw.b WHERE o IS NOT NULL",
    "decision_counts": _with(_N, _KEYS, _PAIRS, _JARO_SCORES, _OUTCOME, select="SELECT entity_type, decision, count(*) AS records FROM o GROUP BY ALL"),
    "record_versions": """
WITH a AS (SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events),
s AS (SELECT *, CASE WHEN before IS NULL THEN 'CREATED' WHEN before = event_type THEN 'UNCHANGED' ELSE 'UPDATED' END AS status FROM a)
SELECT CAST(user_id AS VARCHAR) AS external_id, event_id AS arrival_seq, status,
       count(*) FILTER (status <> 'UNCHANGED') OVER (PARTITION BY user_id ORDER BY event_id) AS version FROM s""",
    "record_type_conflicts": """
WITH a AS (SELECT user_id, event_id, event_type, event_id % 50 = 0 AS company FROM events),
f AS (SELECT *, first(company) OVER (PARTITION BY user_id ORDER BY event_id) AS own FROM a),
g AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM f WHERE company = own),
v AS (SELECT user_id, count(*) FILTER (before IS DISTINCT FROM event_type) AS version FROM g GROUP BY user_id),
n AS (SELECT user_id, count(*) FILTER (company <> own) AS conflicts FROM f GROUP BY user_id)
SELECT CAST(user_id AS VARCHAR) AS external_id, conflicts, version FROM n JOIN v USING (user_id)""",
    "current_records": """
WITH a AS (SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events),
v AS (SELECT * FROM a WHERE before IS DISTINCT FROM event_type)
SELECT CAST(user_id AS VARCHAR) AS external_id, '{"type":"' || max_by(event_type, event_id) || '"}' AS raw, count(*) AS version FROM v GROUP BY user_id""",
    "idempotent_replay": """
WITH a AS (SELECT user_id, event_id, event_type, first(event_type) OVER w AS t, first(event_id) OVER w AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT 'k-' || user_id AS key, event_id AS seq, CASE WHEN event_id = f THEN 'EXECUTED' WHEN event_type = t THEN 'REPLAYED' ELSE 'IDEMPOTENCY_KEY_REUSED' END AS outcome, f AS answered_by FROM a""",
    "register_sources": """
SELECT source AS name, CASE WHEN source NOT IN ('src0', 'src1', 'src2', 'src3', 'src4', 'src5') THEN 'CREATED' WHEN doc_id % 9 = 0 THEN 'SOURCE_TYPE_CONFLICT'
                            WHEN doc_id % 4 = 0 THEN 'SOURCE_PRIORITY_CONFLICT' ELSE 'UNCHANGED' END AS status, count(*) AS requests
FROM documents GROUP BY ALL""",
    "source_not_found": f"WITH {_N} SELECT record_id, CASE WHEN source = 'billing' THEN 'SOURCE_NOT_FOUND' END AS error FROM b",
    "survivorship_winners": f"WITH {_MEMBERS} SELECT entity_id, field, value, record_id, selection_rule, CAST(completeness AS BIGINT) AS completeness FROM win",
    "canonical_struct": f"""WITH {_MEMBERS} SELECT entity_id, max(CASE WHEN field = 'name' THEN value END) AS name, max(CASE WHEN field = 'email' THEN value END) AS email,
       max(CASE WHEN field = 'domain' THEN value END) AS domain, max(CASE WHEN field = 'address.city' THEN value END) AS city, count(*) AS n_fields FROM win GROUP BY entity_id""",
    "noop_snapshots": """
WITH a AS (SELECT o_custkey, o_orderkey, o_orderstatus, lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before FROM orders)
SELECT o_custkey, o_orderkey, o_orderstatus, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INTEGER) AS canonical_version FROM a WHERE before IS DISTINCT FROM o_orderstatus""",
    "snapshot_writes": f"""WITH {_N},{_winners("1", "source <> 'billing'")},{_winners("2")},
w AS (SELECT entity_id, field, value, record_id, selection_rule, completeness, priority, day FROM win2),
x AS (SELECT DISTINCT entity_id FROM (SELECT * FROM w EXCEPT SELECT entity_id, field, value, record_id, selection_rule, completeness, priority, day FROM win1)),
o AS (SELECT DISTINCT entity_id FROM win1),
nf AS (SELECT entity_id, count(*) AS n_fields FROM win2 GROUP BY entity_id)
SELECT nf.entity_id, CAST(CASE WHEN o.entity_id IS NOT NULL AND x.entity_id IS NOT NULL THEN 2 ELSE 1 END AS BIGINT) AS canonical_version, n_fields,
       CAST(CASE WHEN o.entity_id IS NOT NULL AND x.entity_id IS NOT NULL THEN 2 ELSE 1 END AS BIGINT) AS n_history
FROM nf LEFT JOIN x USING (entity_id) LEFT JOIN o USING (entity_id)""",
    "history_provenance": f"""WITH {_MEMBERS} SELECT entity_id, max(CASE WHEN field = 'name' THEN record_id END) AS name_from, max(CASE WHEN field = 'address.city' THEN value END) AS city,
       max(CASE WHEN field = 'phone' THEN split_part(record_id, ':', 1) END) AS phone_source, count(*) AS n_fields FROM win GROUP BY entity_id""",
    "norm_wide": """
SELECT c_custkey, 'josé ' || lower(c_name) AS name, 'User' || c_custkey || '@xn--mnich-kva.example' AS email, 'xn--mnich-kva.sup' || c_custkey || '.example' AS domain,
       'et-' || c_custkey AS registration_id, 'ET' AS country FROM customer""",
    "operation_requests": """
WITH k AS (SELECT o_orderkey AS k FROM orders)
SELECT k AS o_orderkey,
       CASE WHEN k % 4 = 0 THEN 'INVALID_ID' WHEN k % 5 = 0 OR k % 7 = 0 THEN 'INVALID_VERSION' WHEN k % 11 = 0 THEN 'INVALID_REASON' END AS merge,
       CASE WHEN k % 8 = 1 THEN 'EXACTLY_ONE_SELECTION' WHEN k % 8 = 0 THEN 'INVALID_ID' WHEN k % 3 = 0 THEN 'INVALID_ID' WHEN k % 5 = 0 THEN 'INVALID_VERSION' WHEN k % 11 = 0 THEN 'INVALID_REASON' END AS split,
       CASE WHEN k % 13 = 0 THEN 'INVALID_DECISION' WHEN k % 11 = 0 THEN 'INVALID_REASON' WHEN k % 5 < 2 OR k % 7 = 0 THEN 'INVALID_VERSION' END AS review FROM k""",
    "batch_sizes": "SELECT user_id % 113 AS job_id, count(*) AS n, CASE WHEN count(*) > 100 THEN 'INVALID_BATCH_SIZE' END AS reason FROM events GROUP BY ALL",
    "stored_rows": """
SELECT event_id, CASE WHEN event_id % 6 = 0 OR event_id % 7 = 0 OR event_id % 5 = 0 THEN 'OPERATION_INTEGRITY' END AS operation,
       CASE WHEN event_id % 4 = 0 OR event_id % 1100 > 1000 OR event_id % 9 = 0 OR ts IS NULL THEN 'PROVENANCE_INTEGRITY' END AS provenance, event_id % 8 = 0 AS damaged FROM events""",
    "missing_sources": "SELECT unnest(['billing', 'registry']) AS source",
    "bearer_keys": "SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'k' || s_suppkey END AS key FROM supplier",
    "member_records": f"WITH {_N} SELECT email AS entity_id, record_id, source, CAST(priority AS INTEGER) AS priority, phone FROM b WHERE source <> 'registry'",
    "entity_views": """
WITH n AS (SELECT o_custkey AS k, count(*) AS n, max_by(o_orderstatus, o_orderkey) AS s, max_by(o_orderpriority, o_orderkey) AS p FROM orders GROUP BY o_custkey)
SELECT c_custkey AS entity_id, coalesce(n, 0) AS record_count, s AS canonical, CASE WHEN c_custkey % 3 > 0 THEN p END AS provenance,
       CASE WHEN c_custkey % 3 > 0 AND n > 0 THEN 'canonicalization-v1' END AS policy_version FROM customer LEFT JOIN n ON k = c_custkey""",
    "operation_views": "SELECT o_orderkey AS id, 'SPLIT' AS operation, o_custkey AS source_entity_id, o_custkey + 1 AS target_entity_id, CAST(1 AS BIGINT) AS records, CAST(NULL AS BIGINT) AS reversed_operation_id FROM orders",
    "source_views": "SELECT source AS name, 'crawl' AS type, CAST(CASE WHEN min(doc_id) % 2 = 0 THEN 7 ELSE 100 END AS INTEGER) AS priority FROM documents GROUP BY source",
    "ingestion_views": """
WITH a AS (SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events),
s AS (SELECT *, CASE WHEN before IS NULL THEN 'CREATED' WHEN before = event_type THEN 'UNCHANGED' ELSE 'UPDATED' END AS status FROM a),
d AS (SELECT user_id FROM s WHERE status = 'CREATED' AND event_id % 2 = 0)
SELECT CAST(s.user_id AS VARCHAR) AS record_id, event_id AS arrival_seq, status, count(*) FILTER (status <> 'UNCHANGED') OVER (PARTITION BY s.user_id ORDER BY event_id) AS version,
       CASE WHEN d.user_id IS NOT NULL THEN 'NO_MATCH' END AS decision FROM s LEFT JOIN d ON s.user_id = d.user_id""",
    "stored_answers": """
SELECT o_orderkey AS record_id, CASE WHEN o_orderkey % 3 = 0 THEN CASE WHEN o_orderkey % 6 <> 0 AND o_orderkey % 9 = 0 THEN 'NO_MATCH' ELSE 'AUTO_MATCH' END WHEN o_orderkey % 5 = 0 THEN 'REVIEW' END AS decision,
       CASE WHEN o_orderkey % 3 = 0 OR o_orderkey % 5 = 0 THEN o_custkey END AS entity_id, CASE WHEN o_orderkey % 3 = 0 THEN 'LINK' WHEN o_orderkey % 5 = 0 THEN 'REVIEW' ELSE 'NONE' END AS found_in FROM orders""",
    "record_refresh": """
SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'known' ELSE sha256('{"a":' || event_id || ',"b":"' || event_type || '"}') END AS hash, event_id % 4 <> 1 AS refresh FROM events""",
    "kept_evidence": _with(_N, _KEYS, _PAIRS, _SCORES, select=f"""
SELECT record_id, supporting_id, {_r('score')} AS score, decision, CAST(warnings + CASE WHEN blocked THEN 1 ELSE 0 END AS BIGINT) AS n_contradictions, 'features-v1' AS feature_version, 'rules-0.1.0' AS algorithm_version FROM d"""),
    "missing_supporting": _with(_N, _KEYS, _PAIRS, select="SELECT DISTINCT supporting_id AS record_id FROM pairs WHERE entity_type = 'company' AND length(supporting_id) % 3 = 0"),
    "review_details": """
WITH o AS (SELECT o_orderkey AS k, o_custkey AS c FROM orders), h AS (SELECT k, k % 2 + 1 AS version FROM o)
SELECT CAST(o.k AS VARCHAR) AS review_id, CAST(o.k AS VARCHAR) AS source_record_id, CAST(o.k + 1 AS VARCHAR) AS candidate_record_id, CAST(CAST((o.k % 100) / 100.0 AS DECIMAL(5,4)) AS DOUBLE) AS confidence,
       CASE WHEN o.k % 4 = 0 THEN 1 END AS source_record_version, CASE WHEN o.k % 3 > 0 THEN 2 END AS candidate_record_version,
       CASE WHEN o.k % 4 = 0 AND h.version = 1 THEN 'p' || o.k END AS source_raw, CASE WHEN o.k % 3 > 0 AND n.version = 2 THEN 'p' || n.k END AS candidate_raw,
       coalesce(o.c % 7 <> 0 AND n.k IS NOT NULL AND l.c = o.c AND cu.c_custkey IS NOT NULL AND h.version = 1 AND n.version = CASE WHEN o.k % 3 > 0 THEN 2 ELSE 1 END, false) AS approval_available
FROM o JOIN h ON h.k = o.k LEFT JOIN h n ON n.k = o.k + 1 LEFT JOIN o l ON l.k = o.k + 1 LEFT JOIN customer cu ON cu.c_custkey = o.c WHERE o.k % 2 = 0""",
    "review_decisions": "SELECT o_orderkey AS review_decision_id, CASE WHEN o_orderkey % 2 = 0 THEN 'APPROVE' ELSE 'REJECT' END AS decision, o_custkey AS entity_id, 'review-v1' AS policy_version FROM orders",
    "review_eligibility": f"""WITH {_ENTITIES},
o AS (SELECT o_orderkey AS k, o_custkey AS c FROM orders),
u AS (SELECT k, c FROM o WHERE c % 7 <> 0 AND k % 4 IN (2, 3) UNION ALL SELECT k + 1, c FROM o WHERE k % 4 = 0),
g AS (
  SELECT o.k, o.c, k % 12 = 0 AS resolved, CASE WHEN c % 11 = 0 THEN 'company' ELSE 'person' END AS kind, k % 3 + 1 AS sv, k % 3 + 1 + CASE WHEN k % 40 = 0 THEN 1 ELSE 0 END AS asked_sv,
         CASE WHEN k % 2 = 0 THEN k % 3 + 1 ELSE 1 END AS captured_sv, (k + 1) % 3 + 1 AS captured_cv, k % 8 < 6 AS approve FROM o),
j AS (
  SELECT g.*, own.c AS linked, n.k IS NOT NULL AS candidate, CASE WHEN n.c % 11 = 0 THEN 'company' ELSE 'person' END AS candidate_kind, (n.k % 3) + 1 AS cv, lc.c AS candidate_entity, st.kind AS entity_kind, st.merged, st.v, st.k IS NOT NULL AS entity
  FROM g LEFT JOIN u own ON own.k = g.k LEFT JOIN o n ON n.k = g.k + 1 LEFT JOIN u lc ON lc.k = g.k + 1 LEFT JOIN st ON st.k = g.c),
e AS (
  SELECT *, CASE WHEN resolved THEN 'REVIEW_ALREADY_RESOLVED' WHEN linked IS NOT NULL THEN 'REVIEW_RECORD_ALREADY_LINKED' WHEN sv <> asked_sv THEN 'REVIEW_SOURCE_VERSION_CONFLICT'
                 WHEN approve AND NOT coalesce(entity AND NOT merged AND kind = entity_kind AND candidate AND candidate_kind = kind AND candidate_entity = c AND sv = captured_sv AND cv = captured_cv, false) THEN 'REVIEW_EVIDENCE_STALE'
                 WHEN approve AND v <> c % 5 THEN 'ENTITY_VERSION_CONFLICT' END AS error FROM j)
SELECT CAST(k AS VARCHAR) AS case_id, CASE WHEN approve THEN 'APPROVE' ELSE 'REJECT' END AS decision, error, error IS NULL AS linked FROM e""",
    "snapshot_trigger": """
SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'MERGE' WHEN event_id % 4 = 1 THEN 'SPLIT' WHEN event_id % 3 = 0 THEN 'REVIEW_APPROVED' WHEN event_id % 5 = 0 THEN 'LEGACY_BACKFILL'
                      WHEN event_id % 5 = 1 THEN 'RECORD_UPDATED' WHEN event_id % 2 = 0 THEN 'ENTITY_CREATED' ELSE 'RECORD_LINKED' END AS snapshot_trigger FROM events""",
    "entity_record_count": "SELECT c_custkey AS entity_id, count(o_orderkey) AS record_count FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey",
    "keyset_page": """
WITH o AS (SELECT date_trunc('day', o_orderdate) AS at, o_orderkey AS id FROM orders), m AS (SELECT * FROM o WHERE id = (SELECT max(id) FROM o WHERE id % 97 = 0))
SELECT CAST(epoch(o.at) AS BIGINT) AS created_s, o.id FROM o, m WHERE (o.at, o.id) < (m.at, m.id) ORDER BY o.at DESC, o.id DESC LIMIT 26""",
    "job_counters": """
WITH i AS (SELECT conv_id AS job_id, CASE WHEN length(text) % 7 = 0 THEN 'FAILED' WHEN length(text) % 11 = 0 THEN 'QUEUED' ELSE 'SUCCEEDED' END AS state FROM conversations),
j AS (SELECT job_id, count(*) AS total, count(*) FILTER (state <> 'QUEUED') AS processed, count(*) FILTER (state = 'FAILED') AS failed FROM i GROUP BY job_id)
SELECT job_id, CASE WHEN processed < total THEN 'PROCESSING' WHEN failed > 0 THEN 'FAILED' ELSE 'SUCCEEDED' END AS status, total, processed, processed - failed AS succeeded, failed,
       CASE WHEN processed = total AND failed > 0 THEN 'BATCH_RECORDS_FAILED' END AS error_code FROM j""",
    "api_key_scopes": """
SELECT c_custkey AS call, CASE WHEN s.s_suppkey % 6 <> 0 AND s.s_nationkey % 4 <> 0 THEN CAST(s.s_nationkey AS VARCHAR) END AS tenant_id,
       coalesce(s.s_suppkey % 6 <> 0 AND s.s_nationkey % 4 <> 0 AND s.s_suppkey % 2 = 1, false) AS allowed
FROM customer LEFT JOIN supplier s ON s.s_suppkey = c_custkey % 120""",
    "quality_confusion": """
SELECT quality = 1 AS same_identity, count(*) FILTER (doc_id % 3 = 0) AS "AUTO_MATCH", count(*) FILTER (doc_id % 3 = 1) AS "REVIEW", count(*) FILTER (doc_id % 3 = 2) AS "NO_MATCH" FROM labels GROUP BY ALL""",
    "quality_rates": f"""
WITH x AS (SELECT quality = 1 AS same, doc_id % 3 AS d, doc_id % 2 AS c FROM labels),
y AS (SELECT count(*) AS n, count(*) FILTER (same AND d = 0) AS tp, count(*) FILTER (NOT same AND d = 0) AS fp, count(*) FILTER (same AND d = 2) AS fn, count(*) FILTER (same AND d = 1) AS dp,
             count(*) FILTER (same) AS p, count(*) FILTER (NOT same) AS q, count(*) FILTER (d = 1) AS r, count(*) FILTER (same AND c > 0) AS found FROM x)
SELECT n AS evaluated_pairs, fp AS false_positives, fn AS false_negatives, dp AS deferred_positives, {_r('(tp::DOUBLE / nullif(tp + fp, 0))')} AS precision, {_r('(tp::DOUBLE / nullif(p, 0))')} AS recall,
       {_r('(fp::DOUBLE / nullif(q, 0))')} AS false_positive_rate, {_r('(r::DOUBLE / nullif(n, 0))')} AS review_rate, {_r('((n - r)::DOUBLE / nullif(n, 0))')} AS auto_resolution_rate,
       {_r('(found::DOUBLE / nullif(p, 0))')} AS positive_candidate_recall FROM y""",
    "merge_plan": f"WITH {_ENTITIES},{_MERGES} SELECT CAST(source AS VARCHAR) AS operation_id, CAST(target AS VARCHAR) AS target_id, error, CASE WHEN error IS NULL THEN moves END AS moves FROM mg",
    "split_plan": f"""WITH {_ENTITIES},
e AS (SELECT *, CASE WHEN merged THEN 'ENTITY_NOT_ACTIVE' WHEN n > 1000 THEN 'ENTITY_OPERATION_LIMIT' WHEN k % 9 = 0 THEN 'SOURCE_RECORD_NOT_FOUND' WHEN k % 10 = 0 OR n <= 1 THEN 'INVALID_ENTITY_SPLIT' END AS error FROM st WHERE n > 0)
SELECT CAST(k AS VARCHAR) AS operation_id, error, CASE WHEN error IS NULL THEN CAST(low AS VARCHAR) END AS record_ids FROM e""",
    "unmerge_plan": f"""WITH {_ENTITIES},
e AS (
  SELECT m.k AS target, m.k + 1 AS source,
         CASE WHEN s.k IS NULL THEN 'ENTITY_NOT_FOUND' WHEN s.merged THEN 'ENTITY_NOT_ACTIVE' WHEN s.n > 1000 THEN 'ENTITY_OPERATION_LIMIT' WHEN m.k % 3 = 0 THEN 'MERGE_ALREADY_REVERSED'
              WHEN m.k % 4 = 0 OR s.n <= 1 THEN 'MERGE_REVERSAL_CONFLICT' END AS error
  FROM st m LEFT JOIN st s ON s.k = m.k + 1 WHERE m.merged)
SELECT 'm' || target AS operation_id, CAST(source AS VARCHAR) AS source_id, CAST(target AS VARCHAR) AS target_id, error FROM e""",
    "applied_merges": f"""WITH {_ENTITIES},
ok AS (
  SELECT s.k AS source, t.k AS target, s.n FROM st s JOIN st t ON t.k = s.k + 1
  WHERE s.k % 30 = 1 AND NOT s.merged AND NOT t.merged AND s.kind = t.kind AND s.n > 0 AND t.n > 0 AND s.n + t.n <= 1000)
SELECT CAST(st.k AS VARCHAR) AS entity_id, CASE WHEN st.merged OR a.source IS NOT NULL THEN 'MERGED' ELSE 'ACTIVE' END AS status,
       CASE WHEN a.source IS NOT NULL THEN CAST(a.target AS VARCHAR) WHEN st.merged THEN CAST(st.k + 1 AS VARCHAR) END AS merged_into,
       CAST(st.v + CASE WHEN a.source IS NOT NULL OR b.source IS NOT NULL THEN 1 ELSE 0 END AS INTEGER) AS canonical_version,
       CASE WHEN a.source IS NOT NULL THEN 0 ELSE st.n + coalesce(b.n, 0) END AS record_count
FROM st LEFT JOIN ok a ON a.source = st.k LEFT JOIN ok b ON b.target = st.k""",
    "applied_chains": f"""WITH RECURSIVE {_ENTITIES},
r AS (
  SELECT k, n, v, false AS before FROM st WHERE k % 7 = 1 OR k = (SELECT min(k) FROM st)
  UNION ALL
  SELECT t.k, CAST(t.n + CASE WHEN x.ok THEN x.n ELSE 0 END AS BIGINT), t.v + CASE WHEN x.ok THEN 1 ELSE 0 END, x.ok
  FROM (SELECT r.*, s.kind = t.kind AND r.n > 0 AND t.n > 0 AND r.n + t.n <= 1000 AND r.v = r.k % 5 + CASE WHEN r.k % 7 > 1 THEN 1 ELSE 0 END AS ok
        FROM r JOIN st s ON s.k = r.k JOIN st t ON t.k = r.k + 1 WHERE r.k % 7 BETWEEN 1 AND 5) x JOIN st t ON t.k = x.k + 1),
a AS (SELECT st.*, coalesce(r.n, st.n) AS n_now, coalesce(r.v, st.v) AS v_now, coalesce(nx.before, false) AS gone FROM st LEFT JOIN r ON r.k = st.k AND st.k % 7 <> 0 LEFT JOIN r nx ON nx.k = st.k + 1 AND st.k % 7 BETWEEN 1 AND 5)
SELECT CAST(k AS VARCHAR) AS entity_id, CASE WHEN merged OR gone THEN 'MERGED' ELSE 'ACTIVE' END AS status, CASE WHEN merged OR gone THEN CAST(k + 1 AS VARCHAR) END AS merged_into,
       CAST(v_now + CASE WHEN gone THEN 1 ELSE 0 END AS INTEGER) AS canonical_version, CASE WHEN gone THEN 0 ELSE n_now END AS record_count FROM a""",
    "applied_decisions": _with(_N, _KEYS, _PAIRS, _JARO_SCORES, _OUTCOME, select="""
SELECT 'links' AS table_name, count(*) FILTER (decision <> 'REVIEW') AS new_rows FROM o UNION ALL SELECT 'entities', count(*) FILTER (decision = 'NO_MATCH') FROM o
UNION ALL SELECT 'reviews', count(*) FILTER (decision = 'REVIEW') FROM o"""),
    "provenance_view": f"""WITH {_MEMBERS} SELECT entity_id, max(CASE WHEN field = 'name' THEN record_id END) AS name_from, max(CASE WHEN field = 'email' THEN record_id END) AS email_from,
       max(CASE WHEN field = 'address.city' THEN record_id END) AS city_from, max(CASE WHEN field = 'address.city' THEN selection_rule END) AS city_rule FROM win GROUP BY entity_id""",
    "entity_history": "SELECT o_custkey AS entity_id, o_orderkey AS snapshot, CASE WHEN o_orderkey % 20 = 0 THEN 'MERGE' END AS operation, o_orderkey % 20 = 10 AS missing FROM orders",
    "review_page": "SELECT CAST(o_orderkey AS VARCHAR) AS case_id FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderdate DESC, CAST(o_orderkey AS VARCHAR) DESC LIMIT 26",
    "claimed_jobs": """
SELECT job_id, rank BETWEEN 1 AND 25 AS claimed_first, rank BETWEEN 26 AND 50 AS claimed_second,
       strftime(CASE WHEN rank BETWEEN 1 AND 50 THEN TIMESTAMP '2100-01-01 00:00:05' ELSE CAST(o_orderdate AS TIMESTAMP) END, '%Y-%m-%d %H:%M:%S') AS dispatch_after
FROM (SELECT o_orderkey AS job_id, o_orderdate, CASE WHEN o_orderstatus IN ('O', 'P') THEN row_number() OVER (PARTITION BY o_orderstatus IN ('O', 'P') ORDER BY o_orderdate, o_orderkey) ELSE 0 END AS rank FROM orders)""",
    "job_attempts": """
WITH j AS (SELECT o_orderkey AS k, o_orderstatus AS s, CASE o_orderstatus WHEN 'P' THEN o_orderkey % 3 + 1 WHEN 'O' THEN 0 ELSE 1 END AS a FROM orders),
b AS (SELECT k, CASE WHEN s NOT IN ('O', 'P') THEN 'SUCCEEDED' WHEN a >= 3 THEN 'FAILED' WHEN k % 5 <> 0 THEN 'RUNNING' WHEN a = 2 THEN 'FAILED' ELSE 'RETRYING' END AS t,
             CASE WHEN s IN ('O', 'P') AND a < 3 THEN a + 1 ELSE a END AS n FROM j)
SELECT k AS job_id, CASE WHEN t IN ('RUNNING', 'RETRYING') AND k % 7 = 0 THEN 'FAILED' ELSE t END AS status, CAST(n AS INTEGER) AS attempts,
       CASE WHEN t = 'FAILED' THEN 'BATCH_RETRIES_EXHAUSTED' WHEN t IN ('RUNNING', 'RETRYING') AND k % 7 = 0 THEN 'BATCH_DELIVERY_FAILED' END AS error_code FROM b""",
    "due_jobs": "SELECT o_orderkey AS job_id FROM orders WHERE o_orderstatus IN ('O', 'P') ORDER BY o_orderdate, o_orderkey LIMIT 25",
    "duplicate_membership": "SELECT o_custkey AS record_id, count(*) AS links FROM orders GROUP BY o_custkey HAVING count(*) > 1",
    "quality_guard": """
SELECT doc_id % 300 AS id, 'DUPLICATE_CASE' AS reason FROM labels GROUP BY ALL HAVING count(*) > 1 UNION ALL SELECT doc_id % 300, 'INVALID_CANDIDATE_COUNT' FROM labels WHERE doc_id % 50 = 0""",
}

# The same results by persisted or batch-by-batch ways.
ORACLES["block_index_union"] = ORACLES["block_union_cap"]
ORACLES["versions_by_batch"] = ORACLES["record_versions"]
ORACLES["routed_records"] = f"SELECT record_id, coalesce(reason, CASE WHEN record_id LIKE 'billing:%' THEN 'SOURCE_NOT_FOUND' END) AS reason FROM ({ORACLES['record_validation']})"
ORACLES["replay_by_batch"] = """
WITH r AS (SELECT CASE WHEN event_id % 3 > 0 THEN 'k-' || user_id END AS key, event_id, event_type, user_id FROM events),
a AS (SELECT *, first(event_type) OVER w AS t, first(event_id) OVER w AS f FROM r WHERE key IS NOT NULL WINDOW w AS (PARTITION BY key ORDER BY event_id)
      UNION ALL SELECT *, event_type, event_id FROM r WHERE key IS NULL)
SELECT key, event_id AS seq, CASE WHEN event_id = f THEN 'EXECUTED' WHEN event_type = t THEN 'REPLAYED' ELSE 'IDEMPOTENCY_KEY_REUSED' END AS outcome, f AS answered_by,
       CASE WHEN event_type = t THEN substr(sha256(t), 1, 8) || ':' || f END AS answer FROM a"""
