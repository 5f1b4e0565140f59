"""URL filters with dated lists: list events become validity intervals, captures meet those active when fetched.

Everything is DataFrame functions: intervals by a window over each listed pattern's events, then an as-of join on
pattern and time bucket. Patterns are a host or a parent domain (``example.com``), or a host with leading directories
(``www.example.com/en/``); of a capture's active entries the longest pattern decides, and at equal length an allowing
list goes before a blocking one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._store import materialize

#: Seconds of a time bucket: intervals and captures meet within buckets, which also splits up very common hosts.
BUCKET = 30 * 86400
#: Dated entries that are broadcast at most; more are joined by shuffle.
BROADCAST_ENTRIES = 100_000
#: Lots of a key's captures where entries are not broadcast.
LOTS = 8

_URL = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#]*@)?([^/?#:@]+)(?::[0-9]*)?(/[^?#]*)?"


def url_host(url: Column) -> Column:
    """Lower-cased host without trailing dots; empty if there is none."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, _URL, 1)), r"\.+$", "")


def url_patterns(url: Column, depth: int) -> Column:
    """All patterns that can match the URL: its host, parent domains of two labels or more, directories to ``depth``."""
    host = url_host(url)
    labels = F.split(host, r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    parts = F.split(F.regexp_extract(url, _URL, 2), "/")
    deep = F.least(F.size(parts) - 2, F.lit(depth))
    folders = F.when(deep > 0, F.transform(F.sequence(F.lit(1), F.greatest(deep, F.lit(1))), lambda i: F.concat(host, F.lit("/"), F.array_join(F.slice(parts, 2, i), "/"), F.lit("/")))).otherwise(F.array().cast("array<string>"))
    return F.when(F.coalesce(host, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(parents, folders)))


def validity_intervals(events: DataFrame) -> DataFrame:
    """Intervals [since, until) from dated events (list_name, policy, pattern, action, at).

    ``add`` opens an entry at ``at`` and ``remove`` closes it; ``until`` is null while it is open. Of several events of
    an entry at one time, a removal counts last. An addition of an active entry goes on with it. Events with a null
    list, pattern or time are ignored. A pattern's host is lower-cased; its directories keep their case, as URLs do.
    """
    given = events.where("list_name IS NOT NULL AND pattern IS NOT NULL AND at IS NOT NULL AND action IN ('add', 'remove')")
    host = F.substring_index("pattern", "/", 1)
    given = given.withColumn("pattern", F.concat(F.lower(host), F.substring(F.col("pattern"), F.length(host) + 1, F.length("pattern"))))
    # One event a list, pattern and time, before anything is ordered.
    given = given.groupBy("list_name", "policy", "pattern", "at").agg(F.max("action").alias("action"))
    order = Window.partitionBy("list_name", "policy", "pattern").orderBy("at")
    turns = given.withColumn("before", F.lag("action").over(order)).where(~F.col("action").eqNullSafe(F.col("before")))
    turns = turns.withColumn("until", F.lead("at").over(order))
    return turns.where("action = 'add'").select("list_name", "policy", "pattern", F.col("at").alias("since"), "until")


def filter_urls(captures: DataFrame, events: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Judge every capture (page_id, url, fetched_at in seconds) by the list entries active at its time.

    A capture with a null or unparseable URL, or without a time, meets no entry and is not blocked. Every row is judged
    apart, repeated ones too; no captures give no rows, no events block nothing. Other columns of ``captures`` are not
    carried.

    Returns page_id, host, fetched_at, n_entries (active ones), blocked, list_name and pattern (of the deciding entry).
    """
    entries = materialize(validity_intervals(events), "intervals")
    depth = entries.agg(F.max(F.length("pattern") - F.length(F.replace(F.col("pattern"), F.lit("/"))))).first()[0] or 0
    span = captures.agg(F.min("fetched_at"), F.max("fetched_at")).first()
    low, high = (span[0] or 0, span[1] or 0)
    number = lambda t: F.floor(t / F.lit(bucket)).cast("long")
    first, last = F.greatest("since", F.lit(low)), F.least(F.coalesce(F.col("until") - 1, F.lit(high)), F.lit(high))
    dated = materialize(entries.where(first <= last).withColumn("bucket", F.explode(F.sequence(number(first), number(last)))), "dated")
    # Counted small, the entries go to every task, and a very common host needs no key; else both sides are shuffled, and
    # the captures of a hot key go to several lots, each of which gets the key's entries.
    lots = 1 if dated.count() <= BROADCAST_ENTRIES else LOTS
    dated = F.broadcast(dated) if lots == 1 else dated.withColumn("lot", F.explode(F.array(*[F.lit(i) for i in range(lots)])))

    # The row's number tells repeated rows apart; it is made before the first exchange, from the scan's order alone.
    rows = captures.select(F.monotonically_increasing_id().alias("row"), "page_id", url_host(F.col("url")).alias("host"), "fetched_at", url_patterns(F.col("url"), depth).alias("patterns"))
    asked = rows.select("row", "page_id", "host", "fetched_at", number(F.col("fetched_at")).alias("bucket"), F.explode_outer("patterns").alias("pattern"))
    active = (F.col("fetched_at") >= F.col("since")) & (F.col("until").isNull() | (F.col("fetched_at") < F.col("until")))
    a, d = asked.alias("a"), dated.alias("d")
    meets = (F.col("a.pattern") == F.col("d.pattern")) & (F.col("a.bucket") == F.col("d.bucket")) & active
    met = a.join(d, meets if lots == 1 else meets & (F.pmod(F.xxhash64("a.row"), F.lit(lots)) == F.col("d.lot")), "left")
    entry = F.when(F.col("d.pattern").isNotNull(), F.struct(F.length("d.pattern").alias("size"), (F.col("policy") == "allow").alias("allow"), F.col("list_name"), F.col("d.pattern").alias("pattern")))
    judged = met.groupBy("row").agg(
        F.first("page_id").alias("page_id"), F.first("host").alias("host"), F.first("fetched_at").alias("fetched_at"),
        F.count("d.pattern").alias("n_entries"), F.max(entry).alias("top"),
    )
    return judged.select(
        "page_id", F.coalesce("host", F.lit("")).alias("host"), "fetched_at", "n_entries",
        F.coalesce(~F.col("top.allow"), F.lit(False)).alias("blocked"), F.col("top.list_name").alias("list_name"), F.col("top.pattern").alias("pattern"),
    )
