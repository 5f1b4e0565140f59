"""Benchmark decontamination over a distributed positional inverted index.

The index is partitioned by document: a row holds the positions of one word in one slice of the corpus, for all words,
whatever the test items. A search takes the postings of the items' words alone and goes slice by slice: a phrase is found by intersecting the position lists of its words, each shifted by the
word's offset, from the rarest word on; proximity by the nearest positions of an item's rarest words, which are chosen
once, by their counts in the whole corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._batches import LARGE_CHUNK_BYTES, map_arrow, ragged, slices
from ._store import materialize

#: Words in a window of an item.
WINDOW = 13
#: Proximity: so many of an item's rarest words stand within so many words.
NEAR_TERMS = 3
NEAR_WORDS = 2 * WINDOW
#: Characters of test items that are held and broadcast at once; more items go in several blocks, one after another.
BLOCK_CHARS = 8 << 20
#: Candidate starts looked at together in a slice.
CANDIDATES = 1 << 20

#: Bytes other than ASCII letters, digits and those of non-ASCII characters part words; A-Z count as a-z.
_WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256)
)


def words(text: str | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased; null has none."""
    return (text or "").encode().translate(_WORD_BYTES).split()


@dataclass
class Phrases:
    """A block of test items: its words, its distinct windows, and the items of each window."""

    terms: list[bytes]
    window: np.ndarray  # term numbers from 1, 0 beyond a short window's end
    size: np.ndarray
    owner_at: np.ndarray
    owner: np.ndarray  # item numbers by window
    items: list[int | None]
    item_terms: list[np.ndarray]
    near: np.ndarray | None = None  # each item's rarest terms, 0 beyond the last; all 0 for none


def phrases(rows: list[tuple[int | None, str | None]], window: int = WINDOW) -> Phrases:
    terms: dict[bytes, int] = {}
    windows: dict[tuple[int, ...], set[int]] = {}
    items: list[int | None] = []
    item_terms: list[np.ndarray] = []
    for item_id, text in rows:
        ids = [terms.setdefault(w, len(terms) + 1) for w in words(text)]
        if not ids:
            continue
        for i in range(max(1, len(ids) - window + 1)):
            windows.setdefault(tuple(ids[i : i + window]), set()).add(len(items))
        items.append(item_id)
        item_terms.append(np.unique(ids))
    table = np.zeros((len(windows), window), dtype=np.int64)
    size = np.zeros(len(windows), dtype=np.int64)
    for i, w in enumerate(windows):
        table[i, : len(w)], size[i] = w, len(w)
    owners = [sorted(x) for x in windows.values()]
    return Phrases(
        list(terms), table, size, np.cumsum([0, *map(len, owners)]), np.array([x for o in owners for x in o], dtype=np.int64), items, item_terms
    )


_INDEX = "slice long, term string, n int, gaps binary, nth int, doc_id long, hash long, n_words int"


def positional_index(docs: DataFrame) -> DataFrame:
    """The index of all words of all whole texts, in rows of two kinds for each slice of the corpus.

    Positions count words over the slice, with one place left free after each document so that no phrase runs on into
    the next. A posting row has the slice's number, a word, how often it occurs, and the gaps between its positions
    (little-endian unsigned 32-bit, from the first). A document row has no word, but the document's number in the slice,
    its id, its text's hash and its count of words.
    """

    def run(batches):
        task, made = TaskContext.get().partitionId(), 0
        for part in slices(batches, "text", LARGE_CHUNK_BYTES):
            texts = pa.array([(t or "").encode().translate(_WORD_BYTES).strip() for t in part.column("text").to_pylist()], pa.large_binary()).cast(pa.large_string())
            cut = pc.ascii_split_whitespace(texts)
            flat, at = cut.flatten(), np.asarray(cut.offsets)
            there = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
            n_words = np.diff(np.concatenate([[0], np.cumsum(there)])[at])
            coded = flat.filter(pa.array(there)).dictionary_encode()
            ids = coded.indices.to_numpy()
            order = np.argsort(ids, kind="stable")
            counts = np.bincount(ids, minlength=len(coded.dictionary))
            position = (np.arange(len(ids)) + np.repeat(np.arange(len(n_words)), n_words))[order]
            gaps = np.diff(position, prepend=0)
            firsts = np.cumsum(counts) - counts
            gaps[firsts] = position[firsts]
            ends = np.concatenate([[0], np.cumsum(counts)]) * 4
            postings = pa.BinaryArray.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(gaps.astype("<u4"))])
            own, none = part.num_rows, lambda n, kind: pa.nulls(n, kind)
            columns = [
                pa.array(np.full(len(counts) + own, task << 32 | made)),
                pa.concat_arrays([coded.dictionary.cast(pa.string()), none(own, pa.string())]),
                pa.concat_arrays([pa.array(counts, pa.int32()), none(own, pa.int32())]),
                pa.concat_arrays([postings, none(own, pa.binary())]),
                pa.concat_arrays([none(len(counts), pa.int32()), pa.array(np.arange(own), pa.int32())]),
                pa.concat_arrays([none(len(counts), pa.int64()), part.column("doc_id")]),
                pa.concat_arrays([none(len(counts), pa.int64()), part.column("hash")]),
                pa.concat_arrays([none(len(counts), pa.int32()), pa.array(n_words, pa.int32())]),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["slice", "term", "n", "gaps", "nth", "doc_id", "hash", "n_words"])
            made += 1

    return map_arrow(docs.select("doc_id", F.xxhash64("text").alias("hash"), "text"), run, _INDEX)


class Slice:
    """The postings of a block's terms in one slice: (term number, gaps) rows, the terms from 1 on."""

    def __init__(self, number: np.ndarray, gaps: list[bytes], length: int, terms: int):
        self.length = length
        many = np.array([len(g) // 4 for g in gaps], dtype=np.int64)
        total = np.cumsum(np.frombuffer(b"".join(gaps), dtype="<u4"), dtype=np.int64)
        position = total - np.repeat(np.concatenate([[0], total])[np.cumsum(many) - many], many)
        self.key = np.sort(np.repeat(number.astype(np.int64), many) * length + position)
        self.bounds = np.searchsorted(self.key, np.arange(terms + 2) * length)
        self.often = np.diff(self.bounds)

    def positions(self, term: int) -> np.ndarray:
        return self.key[self.bounds[term] : self.bounds[term + 1]] - term * self.length

    def has(self, terms: np.ndarray, positions: np.ndarray) -> np.ndarray:
        """Whether each term stands at its position."""
        want = terms * self.length + positions
        at = np.searchsorted(self.key, want)
        at[at == len(self.key)] = 0
        return (self.key[at] == want) & (positions >= 0) & (positions < self.length) if len(self.key) else np.zeros(len(want), dtype=bool)

    def within(self, terms: np.ndarray, positions: np.ndarray, reach: int, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Whether each term stands less than ``reach`` words from its position, within ``begin`` <= place < ``end``."""
        if not len(self.key):
            return np.zeros(len(positions), dtype=bool)
        want, first = terms * self.length + positions, terms * self.length
        at = np.searchsorted(self.key, want)
        right, left = self.key[at.clip(0, len(self.key) - 1)], self.key[(at - 1).clip(0)]
        near = lambda x: (np.abs(x - want) < reach) & (x >= first + begin) & (x < first + end)
        return near(left) | near(right)


def find_windows(index: Slice, block: Phrases) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(window, start) of every occurrence in the slice, in groups of a bounded size."""
    if not len(block.window) or not len(index.key):
        return
    often = np.where(block.window > 0, index.often[block.window], np.iinfo(np.int64).max)
    rarity = np.argsort(often, axis=1, kind="stable")
    rarest = np.take_along_axis(often, rarity[:, :1], axis=1)[:, 0]
    live = np.flatnonzero(rarest > 0)
    group = np.cumsum(rarest[live]) // CANDIDATES
    for g in np.unique(group):
        own = live[group == g]
        many = rarest[own]
        offset = rarity[own, 0]
        first = index.bounds[block.window[own, offset]]
        row = np.repeat(own, many)
        posting = index.key[np.repeat(first, many) + ragged(many)] % index.length
        start = posting - np.repeat(offset, many)
        keep = start >= 0
        row, start = row[keep], start[keep]
        for k in range(1, block.window.shape[1]):
            if not len(row):
                break
            offset = rarity[row, k]
            term = block.window[row, offset]
            keep = (term == 0) | index.has(term, start + offset)
            row, start = row[keep], start[keep]
        yield row, start


def postings_of(index: DataFrame, block: Phrases) -> DataFrame:
    """The postings (slice, number, n, gaps) of the block's terms, numbered from 1 on."""
    terms = index.sparkSession.createDataFrame([(t.decode(), i) for i, t in enumerate(block.terms, 1)], "term string, number int")
    # As many rows as a block of bounded size has words.
    return index.where("term IS NOT NULL").join(F.broadcast(terms), "term").select("slice", "number", "n", "gaps")


def corpus_counts(postings: DataFrame) -> dict[int, int]:
    """How often each of these terms occurs in the whole corpus; at most as many rows as there are terms."""
    return {r["number"]: r["total"] for r in postings.groupBy("number").agg(F.sum("n").alias("total")).collect()}


def rarest_terms(block: Phrases, counts: dict[int, int], terms: int) -> np.ndarray:
    """Each item's ``terms`` words that are the rarest in the corpus, of those that occur in it; ties by the word.

    An item with fewer such words than that, though it has more words, could only match by common ones: it has none.
    """
    many = np.array([counts.get(i, 0) for i in range(len(block.terms) + 1)], dtype=np.int64)
    table = np.zeros((len(block.items), terms), dtype=np.int64)
    for i, own in enumerate(block.item_terms):
        rare = sorted((x for x in own.tolist() if many[x]), key=lambda x: (many[x], block.terms[x - 1]))[:terms]
        if len(rare) == min(terms, len(own)):
            table[i, : len(rare)] = rare
    return table


def find_near(index: Slice, block: Phrases, doc_at: np.ndarray, n_words: np.ndarray, reach: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(item, document) wherever the item's other rarest words stand within ``reach`` words of the rarest one."""
    rare = block.near
    live = np.flatnonzero((rare[:, 0] > 0) & ((rare == 0) | (index.often[rare] > 0)).all(axis=1))
    many = index.often[rare[live, 0]]
    group = np.cumsum(many) // CANDIDATES
    for g in np.unique(group):
        own, often = live[group == g], many[group == g]
        item = np.repeat(own, often)
        at = index.key[np.repeat(index.bounds[rare[own, 0]], often) + ragged(often)] % index.length
        doc = np.searchsorted(doc_at, at, side="right") - 1
        for k in range(1, rare.shape[1]):
            term = rare[item, k]
            keep = (term == 0) | index.within(term, at, reach, doc_at[doc], doc_at[doc] + n_words[doc])
            item, at, doc = item[keep], at[keep], doc[keep]
        yield item, doc


_HITS = "slice long, nth int, spans array<struct<begin:int,end:int>>, item_ids array<long>, near_item_ids array<long>"


def search(postings: DataFrame, documents: DataFrame, block: Phrases, near_words: int = NEAR_WORDS) -> DataFrame:
    """Documents with occurrences of the block's windows, or of its items' rarest words near each other.

    ``postings`` are those of the block's terms, ``documents`` the index's rows (slice, nth, n_words); both come together
    by slices, which are of bounded size.

    Returns slice, nth, spans (of the document's words in windows, apart and ascending), item_ids, near_item_ids.
    """
    shared = postings.sparkSession.sparkContext.broadcast(block)
    kinds = pa.schema([("slice", pa.int64()), ("nth", pa.int32()), ("spans", pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))), ("item_ids", pa.list_(pa.int64())), ("near_item_ids", pa.list_(pa.int64()))])

    def run(own: pa.Table, docs: pa.Table) -> pa.Table:
        if not own.num_rows:
            return kinds.empty_table()
        block, docs = shared.value, docs.sort_by("nth")
        n_words = docs.column("n_words").to_numpy().astype(np.int64)
        doc_at = np.cumsum(n_words + 1) - n_words - 1
        index = Slice(own.column("number").to_numpy(), own.column("gaps").to_pylist(), int(n_words.sum()) + len(n_words), len(block.terms))
        edge = np.zeros(index.length + 1, dtype=np.int64)
        met, near = [], []
        for w, start in find_windows(index, block):
            np.add.at(edge, start, 1)
            np.add.at(edge, start + block.size[w], -1)
            pairs = np.unique(np.stack([np.searchsorted(doc_at, start, side="right") - 1, w]), axis=1)
            many = np.diff(block.owner_at)[pairs[1]]
            met.append(np.stack([np.repeat(pairs[0], many), block.owner[np.repeat(block.owner_at[pairs[1]], many) + ragged(many)]]))
        for item, doc in find_near(index, block, doc_at, n_words, near_words):
            near.append(np.unique(np.stack([doc, item]), axis=1))
        covered = np.diff(np.concatenate([[0], np.cumsum(edge[:-1]) > 0, [0]]).astype(np.int8))
        begin, end = np.flatnonzero(covered == 1), np.flatnonzero(covered == -1)
        at_doc = np.searchsorted(doc_at, begin, side="right") - 1
        found: dict[int, tuple[list, set, set]] = {}
        for d, a, z in zip(at_doc.tolist(), (begin - doc_at[at_doc]).tolist(), (end - doc_at[at_doc]).tolist()):
            found.setdefault(d, ([], set(), set()))[0].append({"begin": a, "end": z})
        for k, pairs in ((1, met), (2, near)):
            for part in pairs:
                for d, i in part.T.tolist():
                    found.setdefault(d, ([], set(), set()))[k].add(block.items[i])
        numbers = sorted(found)
        number = own.column("slice")[0].as_py()
        rows = [{"slice": number, "nth": d, "spans": found[d][0], "item_ids": sorted(found[d][1] - {None}), "near_item_ids": sorted(found[d][2] - {None})} for d in numbers]
        return pa.Table.from_pylist(rows, kinds)

    return postings.groupBy("slice").cogroup(documents.select("slice", "nth", "n_words").groupBy("slice")).applyInArrow(run, _HITS)


def _merged(hits: DataFrame) -> DataFrame:
    """One row for each document of several blocks' hits: its spans counted once, and all its items."""
    spans = F.array_sort(F.flatten(F.collect_list("spans")))
    rows = hits.groupBy("slice", "nth").agg(spans.alias("spans"), *[F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in ("item_ids", "near_item_ids")])
    # Spans by their beginnings: each adds what lies beyond all earlier ones.
    state = F.struct(F.lit(0).alias("n"), F.lit(0).alias("last"))
    step = lambda s, x: F.struct((s["n"] + F.greatest(x["end"] - F.greatest(x["begin"], s["last"]), F.lit(0))).alias("n"), F.greatest(s["last"], x["end"]).alias("last"))
    return rows.select("slice", "nth", F.aggregate("spans", state, step)["n"].cast("long").alias("n_hit"), "item_ids", "near_item_ids")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, near_terms: int = NEAR_TERMS, near_words: int = NEAR_WORDS, hit_share: int = 20) -> DataFrame:
    """Mark the words of every document that lie in an occurrence of an item's window of ``window`` words.

    A document is contaminated when 1 of ``hit_share`` of its words or more is hit. The items are the query set: they
    are read in blocks of bounded size, one of which is broadcast and searched in every slice of the index, and its hits
    written, before the next. An item of fewer words is one window; an item without words, or with a null text, has
    none; an item with a null id hits words but is not listed. A null or empty document has no words. Rows that share an
    id are judged apart. Empty tables give no rows, or no hits. Further columns are not carried.

    Proximity asks for the ``near_terms`` words of an item that are the rarest in the whole corpus, within ``near_words``
    words of the rarest one and in one document, so that it does not depend on how the rows are dealt out.

    Returns doc_id, n_words, n_hit, n_items, item_ids (ascending), contaminated, near_item_ids (proximity matches).
    """
    return _judged(docs, benchmark, window, near_terms, near_words, hit_share).drop("hash")


def keep_clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, hit_share: int = 20) -> DataFrame:
    """Rows of ``docs`` that ``decontaminate`` does not find contaminated, each judged by its own text; all columns stay."""
    name = "_hash_of_the_text_"
    found = materialize(_judged(docs, benchmark, window, NEAR_TERMS, NEAR_WORDS, hit_share).where("contaminated").select("doc_id", "hash").distinct(), "contaminated").alias("c")
    d = docs.withColumn(name, F.xxhash64("text")).alias("d")
    return d.join(found, F.col("d.doc_id").eqNullSafe(F.col("c.doc_id")) & (F.col(f"d.{name}") == F.col("c.hash")), "left_anti").select(docs.columns)


def _judged(docs: DataFrame, benchmark: DataFrame, window: int, near_terms: int, near_words: int, hit_share: int) -> DataFrame:
    index = materialize(positional_index(docs), "postings")
    documents = index.where("term IS NULL").select("slice", "nth", "doc_id", "hash", F.col("n_words").cast("long").alias("n_words"))
    chars = benchmark.agg(F.sum(F.length("text"))).first()[0] or 0
    count = -(-chars // BLOCK_CHARS) or 1
    lot = F.pmod(F.xxhash64("item_id", "text"), F.lit(count))
    hits = None
    for k in range(count):
        block = phrases([tuple(r) for r in benchmark.where(F.col("text").isNotNull() & (lot == k)).select("item_id", "text").collect()], window)
        own = materialize(postings_of(index, block), "block-postings")
        block.near = rarest_terms(block, corpus_counts(own), near_terms)
        found = materialize(search(own, documents, block, near_words), "hits")
        hits = found if hits is None else hits.unionByName(found)

    none = F.array().cast("array<long>")
    found = documents.join(_merged(hits), ["slice", "nth"], "left").select(
        "doc_id", "hash", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("item_ids", none).alias("item_ids"), F.coalesce("near_item_ids", none).alias("near_item_ids")
    )
    return found.select(
        "doc_id", "hash", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), "item_ids",
        ((F.col("n_hit") > 0) & (hit_share * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"), "near_item_ids",
    )


def contamination_digest(found: DataFrame) -> DataFrame:
    """With the items as a SHA-256 of their ids, sorted as strings and joined by commas."""
    ids = F.array_join(F.array_sort(F.transform("item_ids", lambda x: x.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(ids, 256).alias("items_sha256"), "contaminated", F.size("near_item_ids").cast("long").alias("n_near_items"))
