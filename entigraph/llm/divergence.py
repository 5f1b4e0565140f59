"""How far the sources of a language differ in their terms: an inverted index of posting lists, each pair of sources
corrected from the value that it would have if neither used any term.

With p a source's smoothed share of a term and z its share of a term that it never uses, a pair (i, j) has the value of
sum |p_i - p_j| over all V kept terms. It starts at V * |z_i - z_j|, and only terms that either uses change it:

* a term that i uses adds |p_i - z_j| - |z_i - z_j|. As p_i >= z_i, that is (p_i - z_i) + (z_i - z_j) - |z_i - z_j|, two sums
  for each source, and 2 * (z_j - p_i) where p_i < z_j, by the source's distinct shares;
* a term that both use adds |p_i - p_j| - |p_i - z_j| - |z_i - p_j| + |z_i - z_j|, from its posting list.

So the work on a term is that of its own postings, not of all sources. All arithmetic is on integers.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._batches import map_arrow, ragged, slices
from ._store import materialize

LEAST_DOCS = 30
TOP_TERMS = 50
PRIOR = 5
SCALE = 10**9
#: Text bytes counted at once in a task, and pairs of sources with sums that a task holds.
GATHERED_BYTES = 6 << 20
HELD_PAIRS = 1 << 18
#: Sources of a language are paired in so many lots.
LOTS = 16

_LETTERS = {*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)}
# By byte: A-Z lower-cased, what stands between terms a blank; bytes of longer UTF-8 characters stay.
_TERMS = bytes(b | 0x20 if b < 0x5B and b in _LETTERS else b if b in _LETTERS else 0x20 for b in range(256))


def _gathered(batches: Iterable[pa.RecordBatch], limit: int) -> Iterator[pa.Table]:
    """Rows of several batches together, up to about ``limit`` bytes of text, or one row that is longer."""
    held, size = [], 0
    for part in slices(batches, "text", limit):
        own = part.column("text").nbytes
        if held and size + own > limit:
            yield pa.Table.from_batches(held).combine_chunks()
            held, size = [], 0
        held.append(part)
        size += own
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _plain(column: pa.ChunkedArray) -> pa.Array:
    """The column in one piece that starts at its buffers' start, nulls as empty texts."""
    return pa.concat_arrays([*pc.fill_null(column, "").chunks, pa.array([""], column.type)])[:-1]


def _codes(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    found = column.dictionary_encode()
    return found.indices.to_numpy(zero_copy_only=False).astype(np.int64), found.dictionary


def _long_text(raw: bytes, limit: int) -> Counter:
    """Terms of one text, cut and counted piece by piece; only its distinct terms are held."""
    found: Counter = Counter()
    at = 0
    while at < len(raw):
        end = raw.find(b" ", at + limit)
        end = len(raw) if end < 0 else end
        found.update(raw[at:end].split())
        at = end
    return found


def _rows(langs, sources, terms, n, docs) -> pa.RecordBatch:
    columns = [langs, sources, terms, pa.array(n, pa.int64()), pa.array(docs, pa.int64())]
    return pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])


def _count(rows: pa.Table, limit: int) -> pa.RecordBatch:
    """Occurrences and documents by language, source and term."""
    text = _plain(rows.column("text"))
    size = text.buffers()[2].size if text.buffers()[2] else 0
    raw = (text.buffers()[2].to_pybytes() if size else b"").translate(_TERMS)
    if len(text) == 1 and size > limit:
        found = _long_text(raw, limit)
        one = lambda name: pa.array([rows.column(name)[0].as_py() or ""] * len(found), pa.string())
        return _rows(one("lang"), one("source"), pa.array(list(found), pa.binary()).cast(pa.string()), list(found.values()), [1] * len(found))
    words = pc.ascii_split_whitespace(pa.StringArray.from_buffers(len(text), text.buffers()[1], pa.py_buffer(raw)))
    doc = np.repeat(np.arange(len(text)), np.diff(words.offsets.to_numpy()))
    code, terms = _codes(words.flatten())
    real = np.asarray(pc.binary_length(terms))[code] > 0 if len(terms) else np.zeros(0, dtype=bool)
    width = max(len(terms), 1)
    pairs, n = np.unique(doc[real] * width + code[real], return_counts=True)  # (document, term)
    lang, langs = _codes(_plain(rows.column("lang")))
    source, sources = _codes(_plain(rows.column("source")))
    group = lang * len(sources) + source
    own, at = np.unique(group[pairs // width] * width + pairs % width, return_inverse=True)  # (group, term)
    total = np.zeros(len(own), dtype=np.int64)
    np.add.at(total, at, n)
    group, term = np.divmod(own, width)
    return _rows(langs.take(pa.array(group // len(sources))), sources.take(pa.array(group % len(sources))), terms.take(pa.array(term)), total, np.bincount(at, minlength=len(own)))


def term_counts(docs: DataFrame, gathered_bytes: int = GATHERED_BYTES) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents with it). Counted within tasks before the shuffle."""

    def run(batches):
        for rows in _gathered(batches, gathered_bytes):
            yield _count(rows, gathered_bytes)

    found = map_arrow(docs.select("text", "lang", "source"), run, "lang string, source string, term string, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def term_index(counts: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """Posting lists of the terms in at least ``least_docs`` documents of a language: lang, term, total, postings
    (source, n). A list has at most one posting for each source of the language."""
    lists = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.collect_list(F.struct("source", "n")).alias("postings"))
    return lists.where(F.col("docs") >= least_docs).drop("docs")


def _share(count: Column, n: Column, v: Column, prior: int, scale: int) -> Column:
    """1 + floor(scale * (count + prior) / (n + prior * v)), exactly."""
    wide = lambda c: c.cast("decimal(20,0)")
    top = F.lit(scale).cast("decimal(11,0)") * (wide(count) + F.lit(prior))
    return F.lit(1) + F.call_function("div", top, wide(n) + F.lit(prior) * wide(v))


def _shared_terms(postings: DataFrame) -> DataFrame:
    """What terms that both use add, for each pair of sources: lang, source, item (source < item), value."""

    def run(batches):
        known: dict[tuple[str, str], int] = {}
        names: list[tuple[str, str]] = []
        sums: dict[int, int] = {}

        def held() -> pa.RecordBatch:
            rows = []
            for key, value in sums.items():
                (lang, a), (_, b) = names[key >> 32], names[key & 0xFFFFFFFF]
                rows.append((lang, min(a, b), max(a, b), value))
            sums.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.string(), pa.string(), pa.int64()))], names=["lang", "source", "item", "value"])

        for b in batches:
            lists = b.column("postings")
            count = np.asarray(pc.list_value_length(lists))
            flat = lists.flatten()
            lang, langs = _codes(b.column("lang"))
            source, sources = _codes(flat.field("source"))
            # Numbers of the task for the (language, source) pairs of this batch.
            key, at = np.unique(np.repeat(lang, count) * len(sources) + source, return_inverse=True)
            own = np.empty(len(key), dtype=np.int64)
            for i, (x, y) in enumerate(zip(langs.take(pa.array(key // len(sources))).to_pylist(), sources.take(pa.array(key % len(sources))).to_pylist())):
                if (x, y) not in known:
                    known[x, y] = len(names)
                    names.append((x, y))
                own[i] = known[x, y]
            who, p, z = own[at], flat.field("p").to_numpy(), flat.field("z").to_numpy()
            left = np.repeat(count, count) - ragged(count)  # entries of the list from this one on
            for step in range(1, int(count.max(initial=0))):
                i = np.flatnonzero(left > step)
                j = i + step
                value = np.abs(p[i] - p[j]) - np.abs(p[i] - z[j]) - np.abs(z[i] - p[j]) + np.abs(z[i] - z[j])
                i, j = i[value != 0], j[value != 0]
                pair, at = np.unique(np.minimum(who[i], who[j]) << 32 | np.maximum(who[i], who[j]), return_inverse=True)
                total = np.zeros(len(pair), dtype=np.int64)
                np.add.at(total, at, value[value != 0])
                for k, v in zip(pair.tolist(), total.tolist()):
                    sums[k] = sums.get(k, 0) + v
                if len(sums) > HELD_PAIRS:
                    yield held()
        if sums:
            yield held()

    found = map_arrow(postings, run, "lang string, source string, item string, value long")
    return found.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def _lots(left: DataFrame, right: DataFrame) -> DataFrame:
    """Each row of ``left`` with the rows of ``right`` of its language and another source (columns other_*), dealt out
    by lots so that one language is no single task's."""
    right = right.select(*[F.col(c).alias(c if c == "lang" else f"other_{c}") for c in right.columns])
    right = right.withColumn("lot", F.explode(F.array(*[F.lit(i) for i in range(LOTS)])))
    left = left.withColumn("lot", F.pmod(F.xxhash64("source"), F.lit(LOTS)).cast("int"))
    return left.join(right, ["lang", "lot"]).where(F.col("source") != F.col("other_source"))


def divergence_audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top_terms: int = TOP_TERMS, prior: int = PRIOR, scale: int = SCALE) -> DataFrame:
    """For each (language, source): the other sources of its language by how far their terms differ, and the terms that
    it uses most beyond its language.

    Null texts, languages and sources are empty strings. A document is a row: rows with one id, or none, count apart. A
    group without terms has its rows of part ``pair``; in a language without kept terms all their values are 0. Equal
    values are ranked by the item's UTF-8. A source alone in its language has no pair. No documents: no rows. Further
    columns are not read. The result has a row for each pair of a language's sources.

    Returns lang, source, part (``pair`` or ``term``), item, value, rank.
    """
    docs = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("text", "lang", "source")])
    index = materialize(term_index(term_counts(docs), least_docs), "term-index")
    entries = index.select("lang", "term", "total", F.inline("postings"))
    langs = index.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("lang_n"))
    used = entries.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    groups = docs.select("lang", "source").distinct().join(langs, "lang", "left").join(used, ["lang", "source"], "left").fillna(0, ["v", "lang_n", "n"])
    zero = F.when(F.col("v") > 0, _share(F.lit(0), F.col("n"), F.col("v"), prior, scale)).otherwise(F.lit(0))
    groups = materialize(groups.select("lang", "source", "v", "lang_n", F.col("n").alias("group_n"), zero.alias("z")), "groups")

    shares = entries.join(groups, ["lang", "source"]).select(
        "lang", "source", "term", "z", _share(F.col("n"), F.col("group_n"), F.col("v"), prior, scale).alias("p"), _share(F.col("total"), F.col("lang_n"), F.col("v"), prior, scale).alias("q")
    )
    rank = lambda item: F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), item))
    ahead = shares.where("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    terms = ahead.withColumn("rank", rank("item")).where(F.col("rank") <= top_terms)

    steps = materialize(shares.groupBy("lang", "source", "z", "p").count(), "shares")
    alone = steps.groupBy("lang", "source").agg(F.sum("count").alias("own_terms"), F.sum(F.col("count") * (F.col("p") - F.col("z"))).alias("above"))
    sides = groups.join(alone, ["lang", "source"], "left").fillna(0, ["own_terms", "above"]).select("lang", "source", "v", "z", "own_terms", "above")
    c, other = F.col, lambda x: F.col(f"other_{x}")
    apart = F.abs(c("z") - other("z"))
    lift = lambda x, y, x_terms: x_terms * (x - y - apart)
    start = c("v") * apart + c("above") + other("above") + lift(c("z"), other("z"), c("own_terms")) + lift(other("z"), c("z"), other("own_terms"))
    pair = ["lang", "source", c("other_source").alias("item")]
    base = _lots(sides, sides).select(*pair, start.alias("value"))
    low = _lots(steps, groups.select("lang", "source", "z")).where(other("z") > c("p")).select(*pair, (2 * c("count") * (other("z") - c("p"))).alias("value"))
    both = _shared_terms(shares.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "p", "z")).alias("postings")))
    turned = lambda d: d.unionByName(d.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    values = base.unionByName(turned(low)).unionByName(turned(both)).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = values.withColumn("rank", rank("item"))

    out = lambda d, part: d.select("lang", "source", F.lit(part).alias("part"), "item", F.col("value").cast("long"), F.col("rank").cast("int"))
    return out(pairs, "pair").unionByName(out(terms, "term"))
