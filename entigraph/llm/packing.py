"""Best-fit packing of documents into fixed-size sequences, large items matched first.

Only lengths matter to a packing, and there are at most ``capacity`` of them. So the plan is made from the histogram of
lengths (a table of at most ``capacity`` rows, whatever the corpus), over groups of equal sequences, and the pieces then
look up their places by their rank among pieces of their length.
"""

from __future__ import annotations

import bisect
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._batches import LARGE_CHUNK_BYTES, map_arrow, slices
from ._store import materialize
from ._tokens import MEMO_BYTES, default_path, encoder

CAPACITY = 1024
END_ID = 2
#: Rows of the table of lots' first ranks (one for each length and task) that are broadcast at most.
BROADCAST_ROWS = 200_000

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, lot int, nth long"


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole if it fits, else full pieces, of which the first takes the rest."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def tokenize_pieces(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, memo_bytes: int = MEMO_BYTES, chunk_bytes: int = LARGE_CHUNK_BYTES) -> DataFrame:
    """Pieces of all documents, with a lot (the task that cut them) and a number among the lot's pieces of that length."""
    path = tokenizer_path or default_path()

    def run(batches):
        encode = encoder(path, memo_bytes).encode
        lot = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, dtype=np.int64)
        for part in slices(batches, "text", chunk_bytes):
            texts = [x or "" for x in part.column("text").to_pylist()]
            out: list[tuple] = []
            end = np.array([end_id], dtype="<u4").tobytes()
            for doc_id, ids in zip(part.column("doc_id").to_pylist(), encode(texts)):
                ids += end
                for k, (start, n) in enumerate(cut(len(ids) // 4, capacity)):
                    out.append((doc_id, k, start, n, zlib.crc32(ids[4 * start : 4 * (start + n)]), lot, int(seen[n])))
                    seen[n] += 1
            cols = list(zip(*out))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(cols, kinds)], names=[x.split()[0] for x in _PIECES.split(", ")])

    return map_arrow(docs.select("doc_id", "text"), run, _PIECES)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """Groups of equal sequences, as (how many, [(length, times), ...]).

    1. Pieces above a third of the capacity are at most two to a sequence: from the longest down, each goes with the
       longest partner that still fits beside it.
    2. Smaller pieces, from the longest down, fill the narrowest gap that holds them; new sequences open when none does.
    """
    left = {n: k for n, k in histogram.items() if k > 0}
    groups: list[list] = []  # [how many, gap, contents]

    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        n = large[-1]
        at = bisect.bisect_right(large, capacity - n) - 1
        if at < 0:
            groups.append([left[n], capacity - n, [(n, 1)]])
            large.pop()
            continue
        m = large[at]
        if m == n:
            pairs, odd = divmod(left[n], 2)
            if pairs:
                groups.append([pairs, capacity - 2 * n, [(n, 2)]])
            large.pop()
            if odd:
                rest = bisect.bisect_right(large, capacity - n) - 1
                if rest >= 0:
                    m = large[rest]
                    groups.append([1, capacity - n - m, [(n, 1), (m, 1)]])
                    left[m] -= 1
                    if not left[m]:
                        large.pop(rest)
                else:
                    groups.append([1, capacity - n, [(n, 1)]])
            continue
        pairs = min(left[n], left[m])
        groups.append([pairs, capacity - n - m, [(n, 1), (m, 1)]])
        for x in (n, m):
            left[x] -= pairs
            if not left[x]:
                large.remove(x)

    done = [g for g in groups if not g[1]]
    gaps = sorted(((g[1], i) for i, g in enumerate(groups) if g[1]))
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        count = left[n]
        while count:
            at = bisect.bisect_left(gaps, (n, -1))
            if at == len(gaps):  # no gap holds it: open sequences, filled with as many of this length as fit
                fit = min(capacity // n, count)
                new = count // fit
                groups.append([new, capacity - fit * n, [(n, fit)]])
                count -= new * fit
                gap = capacity - fit * n
                if gap:
                    bisect.insort(gaps, (gap, len(groups) - 1))
                else:
                    done.append(groups[-1])
                continue
            gap, i = gaps[at]
            fit = min(gap // n, count)
            take = min(groups[i][0], count // fit)
            filled = [take, gap - fit * n, [*groups[i][2], (n, fit)]]
            count -= take * fit
            if take == groups[i][0]:
                gaps.pop(at)
            else:
                groups[i][0] -= take
            groups.append(filled)
            if filled[1]:
                bisect.insort(gaps, (filled[1], len(groups) - 1))
            else:
                done.append(filled)
    return [(g[0], g[2]) for g in done] + [(groups[i][0], groups[i][2]) for _, i in gaps]


def places(groups: list[tuple[int, list[tuple[int, int]]]]) -> dict[int, np.ndarray]:
    """For each length: rows (first rank, times, first sequence, offset), ascending by rank."""
    taken: dict[int, int] = {}
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    sequence = 0
    for many, contents in groups:
        offset = 0
        for n, times in contents:
            rank = taken.get(n, 0)
            rows.setdefault(n, []).append((rank, times, sequence, offset))
            taken[n] = rank + many * times
            offset += n * times
        sequence += many
    return {n: np.array(r, dtype=np.int64) for n, r in rows.items()}


def pack(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, memo_bytes: int = MEMO_BYTES, chunk_bytes: int = LARGE_CHUNK_BYTES) -> DataFrame:
    """Pack every document into sequences of at most ``capacity`` tokens.

    A null text is an empty one (just the end id). Documents that share an id are packed apart, each with its own
    pieces; a null id stays null. No documents: no rows. Further columns are not carried. ``memo_bytes`` bounds what a
    worker remembers of the tokenizer's answers, ``chunk_bytes`` the text that it encodes at once; they change no result.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset.
    """
    pieces = materialize(tokenize_pieces(docs, tokenizer_path, capacity, end_id, memo_bytes, chunk_bytes), "pieces")
    lots = materialize(pieces.groupBy("length", "lot").count(), "lots")
    # At most one row for each length up to the capacity: bounded whatever the corpus.
    histogram = {int(r[0]): int(r[1]) for r in lots.groupBy("length").agg(F.sum("count")).collect()}
    place = places(plan(histogram, capacity))

    before = Window.partitionBy("length").orderBy("lot").rowsBetween(Window.unboundedPreceding, -1)
    firsts = lots.select("length", "lot", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    # The table grows with the tasks: beyond its bound, the pieces' narrow rows are shuffled instead.
    firsts = F.broadcast(firsts) if lots.count() <= BROADCAST_ROWS else firsts.hint("shuffle_merge")
    ranked = pieces.join(firsts, ["length", "lot"]).withColumn("rank", F.col("first") + F.col("nth"))

    names = ["doc_id", "piece", "start", "length", "ids_crc32", "rank"]

    def run(batches):
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            sequence, offset = np.empty(len(rank), dtype=np.int64), np.empty(len(rank), dtype=np.int64)
            for n in np.unique(length):
                own, rows = np.flatnonzero(length == n), place[int(n)]
                row = rows[np.searchsorted(rows[:, 0], rank[own], side="right") - 1]
                turn, within = np.divmod(rank[own] - row[:, 0], row[:, 1])
                sequence[own], offset[own] = row[:, 2] + turn, row[:, 3] + within * n
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names[:5]), pa.array(sequence), pa.array(offset)], names=[*names[:5], "sequence_id", "offset"])

    return ranked.select(names).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
