"""Registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Times of the captures and list events below, which the tables lack: seconds from the start of 2024, by fixed rules.
YEAR, DAY = 1704067200, 86400


def _dated_lists(pages: DataFrame) -> DataFrame:
    """Dated list events over the hosts of the pages, chosen and timed by the digits of their MD5, and two bad domains."""
    from pyspark.sql import functions as F

    from .url_filters import url_host

    hosts = pages.select(url_host(F.col("url")).alias("host")).where("host <> ''").groupBy("host").agg(F.md5("host").alias("m"))
    digit = lambda i: F.instr(F.lit("0123456789abcdef"), F.substring("m", i, 1)) - 1
    event = lambda name, policy, pattern, action, day, when: F.when(
        when, F.struct(F.lit(name).alias("list_name"), F.lit(policy).alias("policy"), pattern.alias("pattern"), F.lit(action).alias("action"), (F.lit(YEAR) + day * DAY).cast("long").alias("at"))
    )
    host, since = F.col("host"), 20 * digit(3)
    events = F.array(
        event("hosts", "block", host, "add", since, digit(1) < 4),
        event("hosts", "block", host, "remove", since + 60, digit(1) < 2),
        event("hosts", "block", host, "add", since + 120, digit(1) < 1),
        event("trusted", "allow", host, "add", 100 + 10 * digit(4), digit(2) < 2),
        event("folders", "block", F.concat(host, F.lit("/en/")), "add", F.lit(50), digit(4) == 15),
        event("folders", "block", F.concat(host, F.lit("/en/")), "remove", F.lit(200), digit(4) == 15),
        # A host is the same in any case, a directory is not.
        event("shouted", "block", F.upper(host), "add", F.lit(30), digit(2) == 7),
        event("shouted", "block", F.initcap(host), "remove", F.lit(250), digit(2) == 7),
        event("folders", "block", F.concat(F.upper(host), F.lit("/en/")), "add", F.lit(20), digit(4) == 13),
        event("folders", "block", F.concat(host, F.lit("/EN/")), "add", F.lit(0), digit(4) == 14),
    )
    fixed = pages.sparkSession.sql(
        f"SELECT 'domains' AS list_name, 'block' AS policy, pattern, 'add' AS action, CAST({YEAR} AS BIGINT) AS at FROM VALUES ('spam-farm.example.org'), ('cheap-pills.example.com') AS t(pattern)"
    )
    return hosts.select(F.explode(F.filter(events, lambda e: e.isNotNull())).alias("e")).select("e.*").unionByName(fixed)


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .url_filters import filter_urls

    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    fetched = F.lit(YEAR) + F.pmod(F.col("page_id") * 7919, F.lit(366)) * DAY + F.pmod("page_id", F.lit(DAY))
    return filter_urls(pages.withColumn("fetched_at", fetched.cast("long")), _dated_lists(pages))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(_table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality_rules

    return quality_rules(_table(spark, sf_dir, "documents"))


def op3_repeat_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict by the two limits alone, each stated apart."""
    from pyspark.sql import functions as F

    from .quality import LONGEST_REPEAT, MOST_COVERED, quality_rules

    found = quality_rules(_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_words", "n_repeat_words", "longest_repeat", (F.col("n_repeat_words") > MOST_COVERED * F.col("n_words")).alias("covered_too_far"),
        (F.col("longest_repeat") > LONGEST_REPEAT).alias("repeat_too_long"), "base_failed", "kept",
    )


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_files import token_files

    return token_files(_table(spark, sf_dir, "documents"))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_duplicates import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"), width=3, percent=85)


def op6_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .secrets import scan_secrets

    found = scan_secrets(_table(spark, sf_dir, "documents"))
    secrets = F.filter("findings", lambda f: f["secret"])
    return found.select(
        "doc_id", F.size("findings").cast("long").alias("n_candidates"), F.size(secrets).cast("long").alias("n_secrets"),
        F.transform(secrets, lambda f: f["begin"]).alias("begins"), F.sha2(F.array_join(F.transform(secrets, lambda f: f["candidate"]), ","), 256).alias("secrets_sha256"),
        F.sha2("redacted", 256).alias("redacted_sha256"),
    )


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .toxicity import score_toxicity

    found = score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return found.select("doc_id", "held_out", "score", "predicted", F.size("spans").cast("long").alias("n_spans"))


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontamination import contamination_digest, decontaminate

    return contamination_digest(decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")))


def op8_near_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The proximity matches alone."""
    from .decontamination import contamination_digest, decontaminate

    found = contamination_digest(decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")))
    return found.select("doc_id", "n_words", "n_near_items")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import warc_round_trip

    return warc_round_trip(_table(spark, sf_dir, "pages"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language import identify

    return identify(_table(spark, sf_dir, "documents"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .divergence import divergence_audit

    return divergence_audit(_table(spark, sf_dir, "documents"))


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .byte_bpe import encode_and_decode

    found = encode_and_decode(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .clustering import centroid_clusters

    return centroid_clusters(_table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filters": op1_url_filters,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_quality_rules": op3_quality_rules,
    "op3_repeat_limits": op3_repeat_limits,
    "op4_token_files": op4_token_files,
    "op5_near_duplicates": op5_near_duplicates,
    "op6_secret_scans": op6_secret_scans,
    "op7_toxicity": op7_toxicity,
    "op8_benchmark_decontamination": op8_benchmark_decontamination,
    "op8_near_items": op8_near_items,
    "op9_warc": op9_warc,
    "op10_language_id": op10_language_id,
    "op11_source_divergence": op11_source_divergence,
    "op12_byte_bpe": op12_byte_bpe,
    "op13_centroid_clusters": op13_centroid_clusters,
}

#: DuckDB SQL for those that SQL can express.
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Of items (q) and documents (d) with their words (w): the items whose three rarest words of the corpus stand within 26
#: words of the rarest one.
_NEAR = """
qw AS (SELECT DISTINCT item_id, unnest(w) AS word FROM q),
dw AS (SELECT * FROM (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS i FROM d) WHERE word IN (SELECT word FROM qw)),
nw AS (SELECT word, count(*) AS n FROM dw GROUP BY word),
rw AS (SELECT item_id, qw.word, row_number() OVER (PARTITION BY item_id ORDER BY n, qw.word) AS rare FROM qw JOIN nw ON qw.word = nw.word),
iw AS (SELECT item_id, least(count(*), 3) AS wanted FROM qw GROUP BY item_id),
lw AS (SELECT rw.* FROM rw JOIN (SELECT item_id FROM rw GROUP BY item_id HAVING count(*) >= (SELECT wanted FROM iw WHERE iw.item_id = rw.item_id)) o ON rw.item_id = o.item_id WHERE rare <= 3),
aw AS (SELECT item_id, doc_id, i FROM lw JOIN dw ON lw.word = dw.word WHERE rare = 1),
ow AS (SELECT item_id, doc_id, rare, i AS j FROM lw JOIN dw ON lw.word = dw.word WHERE rare > 1),
mw AS (SELECT aw.item_id, aw.doc_id, aw.i, count(DISTINCT rare) AS met FROM aw LEFT JOIN ow ON aw.item_id = ow.item_id AND aw.doc_id = ow.doc_id AND abs(aw.i - ow.j) < 26 GROUP BY ALL),
near AS (SELECT doc_id, count(DISTINCT mw.item_id) AS n_near_items FROM mw JOIN iw ON mw.item_id = iw.item_id WHERE met >= wanted - 1 GROUP BY doc_id)"""

#: Rounds of clustering: m0 has the first centroids (k, i, c by component), e1 to e4 each vector's nearest, m1 to m3 the moved.
_NEAREST = """
f{0} AS (SELECT r, k, sum((x.x - m.c) * (x.x - m.c)) AS d FROM x JOIN m{1} m ON x.i = m.i GROUP BY r, k),
e{0} AS (SELECT r, arg_min(k, (d, k)) AS k, min(d) AS d FROM f{0} GROUP BY r)"""
_MOVED = """
s{0} AS (SELECT e.k, x.i, CAST(sum(x.x) AS BIGINT) AS s, count(*) AS n FROM x JOIN e{0} e ON x.r = e.r GROUP BY e.k, x.i),
m{0} AS (SELECT m.k, m.i, CASE WHEN n IS NULL THEN m.c ELSE (s - ((s % n) + n) % n) // n END AS c FROM m{1} m LEFT JOIN s{0} s ON m.k = s.k AND m.i = s.i)"""

ORACLES: dict[str, str] = {
    "op11_source_divergence": r"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS r,
                  regexp_extract_all(LOWERED, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT lang, source, r, unnest(w) AS term FROM d),
k AS (SELECT lang, term, count(*) AS total FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
v AS (SELECT lang, count(*) AS v, sum(total) AS lang_n FROM k GROUP BY lang),
c AS (SELECT t.lang, t.source, t.term, count(*) AS n FROM t JOIN k ON t.lang = k.lang AND t.term = k.term GROUP BY ALL),
n AS (SELECT lang, source, sum(n) AS n FROM c GROUP BY lang, source),
g AS (SELECT d.lang, d.source, coalesce(max(n.n), 0) AS n FROM d LEFT JOIN n ON d.lang = n.lang AND d.source = n.source GROUP BY d.lang, d.source),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 5)) // (g.n + 5 * v.v) AS p,
             1 + (CAST(1000000000 AS HUGEINT) * (k.total + 5)) // (v.lang_n + 5 * v.v) AS q
      FROM g JOIN k ON g.lang = k.lang JOIN v ON g.lang = v.lang LEFT JOIN c ON g.lang = c.lang AND g.source = c.source AND k.term = c.term),
f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS f FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
u AS (SELECT g.lang, g.source, 'pair' AS part, h.source AS item, coalesce(f.f, 0) AS value
      FROM g JOIN g h ON g.lang = h.lang AND g.source <> h.source LEFT JOIN f ON g.lang = f.lang AND g.source = f.source AND h.source = f.item
      UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER w AS INTEGER) AS rank
FROM u WINDOW w AS (PARTITION BY lang, source, part ORDER BY value DESC, item) QUALIFY part = 'pair' OR row_number() OVER w <= 50
""".replace("LOWERED", _LOWER),
    "op13_centroid_clusters": f"""
WITH v AS (SELECT row_number() OVER () AS r, vec_id, embedding AS e FROM embeddings
           WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
x AS (SELECT r, unnest(range(64)) AS i, unnest(list_transform(e, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT))) AS x FROM v),
o AS (SELECT r, row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS k FROM v QUALIFY k < 16),
m0 AS (SELECT o.k, x.i, x.x AS c FROM o JOIN x ON o.r = x.r),{",".join(_NEAREST.format(i, i - 1) + ("," + _MOVED.format(i, i - 1) if i < 4 else "") for i in (1, 2, 3, 4))},
h AS (SELECT k, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM m3 GROUP BY k),
t AS (SELECT k, CAST(sum(d) AS BIGINT) AS cluster_inertia FROM e4 GROUP BY k)
SELECT v.vec_id, CAST(e4.k AS INTEGER) AS cluster, CAST(e4.d AS BIGINT) AS distance, t.cluster_inertia, (SELECT CAST(sum(d) AS BIGINT) FROM e4) AS inertia, h.centroid_sha256
FROM v JOIN e4 ON v.r = e4.r JOIN t ON e4.k = t.k JOIN h ON e4.k = h.k
""",
    "op3_quality_rules": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS i FROM d),
g AS (SELECT doc_id, i, word, word || ' ' || lead(word, 1) OVER o || ' ' || lead(word, 2) OVER o || ' ' || lead(word, 3) OVER o || ' ' || lead(word, 4) OVER o AS five
      FROM p WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT *, CASE WHEN five IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, five) > 1 THEN 1 ELSE 0 END AS twice FROM g),
c AS (SELECT doc_id, word, i, max(twice) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS covered FROM r),
n AS (SELECT doc_id, sum(covered) AS k FROM c GROUP BY doc_id),
l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d),
u AS (SELECT doc_id, count(*) - count(DISTINCT line) AS dups FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
b AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(dups, 0) AS n_dup_lines, CAST(coalesce(k, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN u ON d.doc_id = u.doc_id),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM b),
e AS (SELECT x.doc_id, x.i, y.i - x.i AS apart FROM g x JOIN g y ON x.doc_id = y.doc_id AND x.five = y.five AND x.i < y.i),
k AS (SELECT doc_id, apart, i - row_number() OVER (PARTITION BY doc_id, apart ORDER BY i) AS run FROM e),
l5 AS (SELECT doc_id, max(n) + 4 AS longest FROM (SELECT doc_id, count(*) AS n FROM k GROUP BY doc_id, apart, run) GROUP BY doc_id)
SELECT f.*, NOT base_failed AND n_repeat_words <= 0.10 * n_words AND coalesce(longest, 0) <= 50 AS kept, coalesce(longest, 0) AS longest_repeat
FROM f LEFT JOIN l5 ON f.doc_id = l5.doc_id
""",
    "op5_near_duplicates": rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
                                               WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT i.a, i.b FROM i JOIN n x ON x.doc_id = i.a JOIN n y ON y.doc_id = i.b WHERE 100 * k >= 85 * (x.n + y.n - k)),
r AS (SELECT doc_id, doc_id AS root FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON r.doc_id = e.a),
m AS (SELECT doc_id, min(root) AS component_id FROM r GROUP BY doc_id)
SELECT m.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, m.doc_id = component_id AS kept FROM m LEFT JOIN n ON m.doc_id = n.doc_id
""",
    "op8_benchmark_decontamination": rf"""
WITH q AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
b AS (SELECT DISTINCT item_id, least(13, len(w)) AS s, unnest(list_transform(range(1, greatest(len(w) - 11, 2)), lambda i: array_to_string(w[i:i + 12], ' '))) AS g FROM q WHERE len(w) > 0),
d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
z AS (SELECT DISTINCT s FROM b),
p AS (SELECT doc_id, s, unnest(list_transform(range(1, len(w) - s + 2), lambda i: array_to_string(w[i:i + s - 1], ' '))) AS g, unnest(range(1, len(w) - s + 2)) AS i FROM d, z WHERE len(w) >= s),
h AS (SELECT p.doc_id, p.i, p.s, b.item_id FROM p JOIN b ON p.s = b.s AND p.g = b.g),
k AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + s)) AS j FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM h) GROUP BY doc_id),
{_NEAR}
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated, coalesce(n_near_items, 0) AS n_near_items
FROM d LEFT JOIN k ON d.doc_id = k.doc_id LEFT JOIN t ON d.doc_id = t.doc_id LEFT JOIN near ON d.doc_id = near.doc_id
""",
    "op8_near_items": rf"""
WITH q AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
{_NEAR}
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_near_items, 0) AS n_near_items FROM d LEFT JOIN near ON d.doc_id = near.doc_id
""",
    "op1_url_filters": """
WITH u AS (
  SELECT page_id, row_number() OVER () AS r, url,
         regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://(?:[^/?#]*@)?([^/?#:@]+)', 1)), '\\.+$', '') AS host,
         regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]+(/[^?#]*)', 1) AS path,
         1704067200 + ((page_id * 7919) % 366) * 86400 + page_id % 86400 AS fetched_at
  FROM pages),
h AS (SELECT DISTINCT host, md5(host) AS m FROM u WHERE host <> ''),
g AS (SELECT host, instr('0123456789abcdef', m[1]) - 1 AS d1, instr('0123456789abcdef', m[2]) - 1 AS d2,
             instr('0123456789abcdef', m[3]) - 1 AS d3, instr('0123456789abcdef', m[4]) - 1 AS d4 FROM h),
i AS (
  SELECT 'hosts' AS list_name, false AS allow, host AS pattern, 20 * d3 AS since,
         CASE WHEN d1 < 2 THEN 20 * d3 + 60 END AS until FROM g WHERE d1 < 4
  UNION ALL SELECT 'hosts', false, host, 20 * d3 + 120, NULL FROM g WHERE d1 < 1
  UNION ALL SELECT 'trusted', true, host, 100 + 10 * d4, NULL FROM g WHERE d2 < 2
  UNION ALL SELECT 'folders', false, host || '/en/', 50, 200 FROM g WHERE d4 = 15
  UNION ALL SELECT 'shouted', false, host, 30, 250 FROM g WHERE d2 = 7
  UNION ALL SELECT 'folders', false, host || '/en/', 20, NULL FROM g WHERE d4 = 13
  UNION ALL SELECT 'folders', false, host || '/EN/', 0, NULL FROM g WHERE d4 = 14
  UNION ALL SELECT 'domains', false, unnest(['spam-farm.example.org', 'cheap-pills.example.com']), 0, NULL),
k AS (
  SELECT r, unnest(list_distinct(list_concat(
           list_transform(range(1, greatest(len(string_split(host, '.')), 2)), lambda j: array_to_string(string_split(host, '.')[j:], '.')),
           CASE WHEN len(string_split(path, '/')) > 2 THEN [host || '/' || string_split(path, '/')[2] || '/'] ELSE [] END))) AS pattern
  FROM u WHERE host <> ''),
e AS (
  SELECT u.r, i.pattern, i.list_name, i.allow,
         row_number() OVER (PARTITION BY u.r ORDER BY length(i.pattern) DESC, i.allow DESC, i.list_name DESC, i.pattern DESC) AS n
  FROM u JOIN k ON u.r = k.r JOIN i ON k.pattern = i.pattern
  WHERE u.fetched_at >= 1704067200 + i.since * 86400 AND (i.until IS NULL OR u.fetched_at < 1704067200 + i.until * 86400)),
c AS (SELECT r, count(*) AS n_entries FROM e GROUP BY r)
SELECT u.page_id, coalesce(u.host, '') AS host, CAST(u.fetched_at AS BIGINT) AS fetched_at, CAST(coalesce(c.n_entries, 0) AS BIGINT) AS n_entries,
       coalesce(NOT e.allow, false) AS blocked, e.list_name, e.pattern
FROM u LEFT JOIN c ON u.r = c.r LEFT JOIN e ON u.r = e.r AND e.n = 1
""",
    "op9_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, octet_length(encode(body)) AS n, sha1(body) AS digest FROM p),
r AS (SELECT digest, max(page_id) AS response FROM d WHERE n >= 1000 GROUP BY digest)
SELECT d.page_id, CAST(d.n AS BIGINT) AS payload_bytes, d.digest AS payload_digest,
       CASE WHEN d.n >= 1000 AND d.page_id <> r.response THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN d.n >= 1000 AND d.page_id <> r.response THEN r.response END AS refers_to
FROM d LEFT JOIN r ON d.digest = r.digest AND d.n >= 1000
""",
}
