"""Repetition rules over suffix arrays of words.

The suffixes of a slice of texts are sorted together by prefix doubling, each text apart from the others. Neighbours in
that order give the longest common prefixes; where one has ``span`` words or more, a repeated substring begins. The
union of the maximal repeats' spans is what a text repeats.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._batches import map_arrow, slices

#: Words of the shortest repeated substring that counts.
SPAN = 5
#: Base rules: fewest words, and most repeated words in percent.
LEAST_WORDS = 10
MOST_REPEATED = 20
#: The method's limits, tighter than the base rule: the share of the words that repeats cover, and the words of the
#: longest repeat.
MOST_COVERED = 0.10
LONGEST_REPEAT = 50

SYMBOLS = "#*$%&|<>"

_BLANKS = dict.fromkeys([0x20, *range(0x09, 0x0E)])


def suffix_repeats(ids: np.ndarray, owner: np.ndarray, span: int = SPAN) -> np.ndarray:
    """For each position, how many words from there on occur at another place of the same text, too; 0 if under ``span``.

    ``ids`` are the words' numbers, ``owner`` the texts' numbers, ascending. A suffix is sorted on only while it shares
    its prefix with another one, so the work follows the repeats.
    """
    n = len(ids)
    longest = np.zeros(n, dtype=np.int64)
    if n < 2:
        return longest
    ends = np.searchsorted(owner, owner, side="right")
    key = owner.astype(np.int64) * (int(ids.max()) + 1) + ids
    order = np.argsort(key, kind="stable")
    starts = np.concatenate([[True], key[order][1:] != key[order][:-1]])
    # A suffix's rank is the place of the first one with its prefix, from 1; 0 is past the text's end. The ranks of each
    # doubling are kept: as many as the longest repeat's length has binary digits.
    rank = np.empty(n, dtype=np.int32 if n < 1 << 31 else np.int64)
    rank[order] = np.maximum.accumulate(np.where(starts, np.arange(n), 0)) + 1
    live = order[~(starts & np.append(starts[1:], True))]
    levels, length = [rank], 1
    while len(live):
        follow = live + length
        after = np.where(follow < ends[live], rank[np.minimum(follow, n - 1)], 0)
        turn = np.lexsort((after, rank[live]))
        live, a, b = live[turn], rank[live[turn]], after[turn]
        group = np.concatenate([[True], a[1:] != a[:-1]])
        starts = group | np.concatenate([[True], b[1:] != b[:-1]])
        place = np.arange(len(live))
        rank = rank.copy()
        rank[live] = a + np.maximum.accumulate(np.where(starts, place, 0)) - np.maximum.accumulate(np.where(group, place, 0))
        live = live[~(starts & np.append(starts[1:], True))]
        levels.append(rank)
        length *= 2

    order = np.argsort(rank, kind="stable")
    one, two = order[:-1], order[1:]
    level = min(len(levels) - 1, max(0, span.bit_length() - 1))
    near = levels[level][one] == levels[level][two]
    first, second = one[near], two[near]
    i, j, common = first.copy(), second.copy(), np.zeros(len(first), dtype=np.int64)
    for k in range(len(levels) - 1, -1, -1):
        inside = (i < ends[first]) & (j < ends[second])
        same = inside & (levels[k][np.minimum(i, n - 1)] == levels[k][np.minimum(j, n - 1)])
        step = same.astype(np.int64) << k
        i, j, common = i + step, j + step, common + step
    np.maximum.at(longest, first, common)
    np.maximum.at(longest, second, common)
    longest[longest < span] = 0
    return longest


def text_rules(texts: list[str | None], span: int = SPAN) -> dict[str, np.ndarray]:
    """Counts of each text: words, their code points, symbols, repeated lines, repeated words, the longest repeat."""
    cut = [(t or "").encode().split() for t in texts]
    n_words = np.array([len(w) for w in cut], dtype=np.int64)
    numbers: dict[bytes, int] = {}
    ids = np.array([numbers.setdefault(w, len(numbers)) for w in chain.from_iterable(cut)], dtype=np.int64)
    repeat = suffix_repeats(ids, np.repeat(np.arange(len(texts)), n_words), span)
    at = np.concatenate([[0], np.cumsum(n_words)])
    edge = np.zeros(len(ids) + 1, dtype=np.int64)
    begin = np.flatnonzero(repeat)
    np.add.at(edge, begin, 1)
    np.add.at(edge, begin + repeat[begin], -1)
    covered = np.concatenate([[0], np.cumsum(np.cumsum(edge[:-1]) > 0)])
    lines = []
    for t in texts:
        own = [x for x in (t or "").split("\n") if x.encode().split()]
        lines.append(len(own) - len(set(own)))
    return {
        "n_words": n_words,
        "word_chars": np.array([len((t or "").translate(_BLANKS)) for t in texts], dtype=np.int64),
        "n_symbols": np.array([sum(map((t or "").count, SYMBOLS)) for t in texts], dtype=np.int64),
        "n_dup_lines": np.array(lines, dtype=np.int64),
        "n_repeat_words": covered[at[1:]] - covered[at[:-1]],
        "longest_repeat": np.array([repeat[a:b].max(initial=0) for a, b in zip(at[:-1], at[1:])], dtype=np.int64),
    }


_NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "longest_repeat"]


def quality_rules(docs: DataFrame, most_covered: float = MOST_COVERED, longest_repeat: int = LONGEST_REPEAT, span: int = SPAN) -> DataFrame:
    """Judge every whole text by its repeated substrings.

    Words are ``[^\\x20\\x09-\\x0D]+``. ``n_repeat_words`` counts the words in substrings of ``span`` words or more that
    occur twice or more in the text, the first occurrence included; ``longest_repeat`` has the words of the longest of
    them, 0 for none. A text fails the base rules with under ten words or over a fifth of them repeated; otherwise it is
    kept if repeats cover no more than ``most_covered`` of its words and the longest has at most ``longest_repeat``
    words. A null or empty text has no words and fails. Null and repeated ids stay as they are, each row judged apart;
    no rows give no rows. Further columns are not carried.

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, longest_repeat.
    """

    def run(batches):
        for part in slices(batches, "text"):
            found = text_rules(part.column("text").to_pylist(), span)
            n, repeated = found["n_words"], found["n_repeat_words"]
            failed = (n < LEAST_WORDS) | (100 * repeated > MOST_REPEATED * n)
            kept = ~failed & (repeated <= most_covered * n) & (found["longest_repeat"] <= longest_repeat)
            columns = [part.column("doc_id"), *(pa.array(found[c]) for c in _NAMES[:5]), pa.array(failed), pa.array(kept), pa.array(found["longest_repeat"])]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *_NAMES[:5], "base_failed", "kept", "longest_repeat"])

    schema = "doc_id long, " + ", ".join(f"{c} long" for c in _NAMES[:5]) + ", base_failed boolean, kept boolean, longest_repeat long"
    return map_arrow(docs.select("doc_id", "text"), run, schema)
