"""Toxic spans by a linear-chain conditional random field over the words of each sentence.

Words are tagged toxic or not. Tags of training words come from labelled documents: in a toxic document, a word is toxic
when it, or how it begins, is far commoner among toxic documents than among the others. The field's forward-backward
marginals give the toxic spans; a logistic regression of a document's marginals gives its score.
"""

from __future__ import annotations

import re
import sys
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hyperminhash
from ._batches import map_arrow, slices
from ._sample import bounded_texts

#: Bounds of the training sample: labelled documents of either kind, bytes of a text (longer ones teach nothing), and
#: bytes of either kind.
TRAIN_DOCS = 1500
TRAIN_TEXT_BYTES = 64 << 10
TRAIN_BYTES = 12 << 20
#: Odds of a word's beginning among toxic documents (as a logarithm) and documents with it, for it to be tagged.
LEAST_ODDS, LEAST_DOCS = 3.0, 4
THRESHOLD = 0.3
FOLDS, HELD_OUT = 4, 2
#: Letters of the beginnings of a word that are features, next to the word itself.
BEGINNINGS = (4, 5, 6)
WEIGHTS = 1 << 18
ROUNDS, RIDGE = 30, 1e-3
#: Words of a chain that are gone through one after another; a longer chain is put together from such blocks.
BLOCK_WORDS = 256
#: Steps between words whose chances are held at once as their expected counts are added up.
PAIRS_AT_ONCE = 1 << 18
#: Bytes of remembered words of a worker, and what an entry takes besides its key; at more, all are forgotten.
MEMO_BYTES, ENTRY_BYTES = 32 << 20, 112

_EDGE = "\"'()[]{}<>.,;:!?*#$%&|…“”‘’«»-_"
_STOP = re.compile(r"[.!?]+[\"')\]]*\Z")


def features(word: str) -> list[str]:
    core = word.strip(_EDGE) or word
    return ["=" + core, *(f"^{core[:k]}" for k in BEGINNINGS if len(core) > k)]


def _slots(word: str) -> list[int]:
    return [xxhash.xxh64_intdigest(f) % WEIGHTS for f in features(word)]


class Words:
    """Numbers words and keeps their slots of weights and whether they end a sentence."""

    def __init__(self) -> None:
        self.number: dict[str, int] = {}

    def sentences(self, texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray, list[int]]:
        """Word numbers, whether each word ends a chain, and the words of each text."""
        number, ids, size = self.number, [], []
        for t in texts:
            words = (t or "").lower().split()
            size.append(len(words))
            ids.extend([number.setdefault(w, len(number)) for w in words])
        ids = np.array(ids, dtype=np.int64)
        stop = np.array([w[-1] in ".!?" or _STOP.search(w) is not None for w in number], dtype=bool)
        end = stop[ids] if len(ids) else np.zeros(0, dtype=bool)
        last = np.cumsum(np.array(size, dtype=np.int64)) - 1
        end[last[np.array(size, dtype=np.int64) > 0]] = True
        return ids, end, size


def chains(end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First words and lengths of the chains, the longest chain first."""
    ends = np.flatnonzero(end)
    first = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else np.zeros(0, dtype=np.int64)
    size = ends - first + 1
    order = np.argsort(-size, kind="stable")
    return first[order], size[order]


def _sum_to_one(x: np.ndarray) -> np.ndarray:
    return x / x.sum(axis=tuple(range(1, x.ndim)), keepdims=True)


def _edges(begin: np.ndarray, size: np.ndarray, opens: np.ndarray, grow: np.ndarray, hop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For blocks of chains, in the words' order: what comes in from the words before each, and from those behind it.

    A block's words are one 2x2 matrix, the product of theirs; vectors go from block to block by these.
    """
    n = len(begin)
    first = np.flatnonzero(opens)  # of each chain's blocks
    turn = np.arange(n) - np.repeat(first, np.diff(np.append(first, n)))
    many = np.repeat(np.diff(np.append(first, n)), np.diff(np.append(first, n)))
    enter, leave = np.ones((n, 2)), np.ones((n, 2))
    some = np.flatnonzero(many > 1)
    if not len(some):
        return enter, leave
    some = some[np.argsort(-size[some], kind="stable")]
    product = np.broadcast_to(np.eye(2), (n, 2, 2)).copy()
    for t in range(int(size[some[0]])):
        live = some[: np.searchsorted(-size[some], -t, side="left")]
        at = begin[live] + t
        own = product[live]
        # A chain's first word has no step before it.
        own = np.where((opens[live] & (t == 0))[:, None, None], own, own @ hop)
        own[:, :, 1] *= grow[at][:, None]
        product[live] = _sum_to_one(own)
    for k in range(1, int(turn.max()) + 1):
        at = np.flatnonzero(turn == k)
        enter[at] = _sum_to_one(np.einsum("ij,ijk->ik", enter[at - 1], product[at - 1]))
    for k in range(int(turn.max()) - 1, -1, -1):
        at = np.flatnonzero((turn == k) & (many > k + 1))
        leave[at] = _sum_to_one(np.einsum("ijk,ik->ij", product[at + 1], leave[at + 1]))
    inside = ~opens
    enter[inside] = enter[inside] @ hop
    return enter, leave


def marginals(emission: np.ndarray, end: np.ndarray, step: np.ndarray, block: int = BLOCK_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Chance of the toxic tag at each word, and the expected counts of the four steps between tags.

    ``emission`` is the toxic tag's score (the other's is 0); ``step[a, b]`` that of tag b after tag a. All blocks of all
    chains go forward and backward together, word by word; shorter ones drop out as they end. ``block`` changes no result.
    """
    n = len(emission)
    begin = np.concatenate([[0], np.flatnonzero(end)[:-1] + 1]).astype(np.int64) if n else np.zeros(0, dtype=np.int64)
    place = np.arange(n) - np.repeat(begin, np.diff(np.append(begin, n)))
    cut = end | (place % block == block - 1)
    first, size = chains(cut)
    grow, hop = np.exp(np.clip(emission, -30, 30)), np.exp(step)
    order = np.argsort(first, kind="stable")
    enter, leave = np.empty((len(first), 2)), np.empty((len(first), 2))
    if n:
        enter[order], leave[order] = _edges(first[order], size[order], place[first[order]] == 0, grow, hop)
    ahead, behind = np.empty((n, 2)), np.ones((n, 2))
    live = np.searchsorted(-size, -np.arange(1, (size[0] if len(size) else 0) + 1), side="right")
    for t, k in enumerate(live):
        at = first[:k] + t
        if t:
            prev = ahead[at - 1]
            x = prev[:, :1] * hop[0] + prev[:, 1:] * hop[1]
        else:
            x = enter.copy()
        x[:, 1] *= grow[at]
        ahead[at] = x / x.sum(axis=1, keepdims=True)
    behind[first + size - 1] = leave
    for t in range(len(live) - 2, -1, -1):
        at = first[: live[t + 1]] + t
        x = behind[at + 1].copy()
        x[:, 1] *= grow[at + 1]
        y = x[:, :1] * hop[:, 0] + x[:, 1:] * hop[:, 1]
        behind[at] = y / y.sum(axis=1, keepdims=True)
    both = ahead * behind
    toxic = both[:, 1] / both.sum(axis=1) if n else np.zeros(0)
    inner, steps = np.flatnonzero(~end), np.zeros((2, 2))
    for part in np.array_split(inner, len(inner) // PAIRS_AT_ONCE + 1):
        pair = ahead[part][:, :, None] * hop[None] * behind[part + 1][:, None, :]
        pair[:, :, 1] *= grow[part + 1][:, None]
        steps += _sum_to_one(pair).sum(axis=0)
    return toxic, steps


def _summary(toxic: np.ndarray, size: list[int]) -> np.ndarray:
    """Of each text: the marginals' sum (as a logarithm), largest value and mean."""
    at = np.concatenate([[0], np.cumsum(np.array(size, dtype=np.int64))])
    total = np.concatenate([[0.0], np.cumsum(toxic)])
    total = np.maximum(total[at[1:]] - total[at[:-1]], 0)
    top = np.array([toxic[a:b].max(initial=0) for a, b in zip(at[:-1], at[1:])])
    return np.stack([np.log1p(total), top, total / np.maximum(size, 1)], axis=1)


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    step: np.ndarray
    logistic: np.ndarray
    memo: dict[str, float] = field(default_factory=dict)
    held: int = 0

    def __getstate__(self) -> dict:
        own = np.flatnonzero(self.weights)
        return {**self.__dict__, "weights": (own, self.weights[own]), "memo": {}, "held": 0}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        own, value = state["weights"]
        self.weights = np.zeros(WEIGHTS)
        self.weights[own] = value

    def emission(self, word: str) -> float:
        value = self.memo.get(word)
        if value is None:
            value = self.memo[word] = self.bias + float(sum(self.weights[s] for s in _slots(word)))
            self.held += sys.getsizeof(word) + ENTRY_BYTES
        return value

    def tag(self, texts: list[str | None]) -> tuple[np.ndarray, list[int]]:
        if self.held > MEMO_BYTES:
            self.memo, self.held = {}, 0
        words = Words()
        ids, end, size = words.sentences(texts)
        score = np.array([self.emission(w) for w in words.number])
        toxic, _ = marginals(score[ids] if len(ids) else np.zeros(0), end, self.step)
        return toxic, size

    def scores(self, toxic: np.ndarray, size: list[int]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(_summary(toxic, size) @ self.logistic[1:] + self.logistic[0], -30, 30)))


def spans(text: str, toxic: np.ndarray) -> list[tuple[int, int, float]]:
    """(from, to, mean chance) of the runs of words that are likelier toxic than not, in characters of the text."""
    out: list[list] = []
    previous = -2
    for i, m in enumerate(re.finditer(r"\S+", text)):
        if i < len(toxic) and toxic[i] > 0.5:
            if previous == i - 1:
                out[-1][1] = m.end()
                out[-1][2].append(toxic[i])
            else:
                out.append([m.start(), m.end(), [toxic[i]]])
            previous = i
    return [(a, b, float(np.mean(p))) for a, b, p in out]


def _apart(rows: list[tuple[str | None, int, float]]) -> list[tuple[str | None, int, float]]:
    """Rows without near copies of an earlier one: copies would make chance words look telling."""
    sets = hyperminhash.shingle_sets([t for t, _, _ in rows], 5)
    seen, out = set(), []
    for row, keys in zip(rows, hyperminhash.candidate_keys(sets, hyperminhash.registers(sets), 80)):
        own = set(keys.tolist())
        if not own & seen:
            seen |= own
            out.append(row)
    return out


def tag_words(rows: list[tuple[str | None, int, float]], least_odds: float = LEAST_ODDS, least_docs: int = LEAST_DOCS) -> set[str]:
    """Features of words that count as toxic in toxic documents."""
    count, docs = (Counter(), Counter()), [0, 0]
    for text, toxic, _ in _apart(rows):
        count[toxic].update({f for w in set((text or "").lower().split()) for f in features(w)})
        docs[toxic] += 1
    clean = lambda f: (count[0][f] + 0.5) / (docs[0] + 1)
    return {f for f, n in count[1].items() if n >= least_docs and np.log((n + 0.5) / (docs[1] + 1) / clean(f)) >= least_odds}


def fit_field(ids: np.ndarray, end: np.ndarray, tags: np.ndarray, slots: list[list[int]], rounds: int = ROUNDS, ridge: float = RIDGE) -> tuple[np.ndarray, float, np.ndarray]:
    """Weights of features, bias and steps of the field, by scaled gradients of its likelihood (RMSprop)."""
    word = np.repeat(np.arange(len(slots)), [len(s) for s in slots])
    slot = np.array([x for s in slots for x in s], dtype=np.int64)
    weights, bias, step = np.zeros(WEIGHTS), -4.0, np.zeros((2, 2))
    inner = np.flatnonzero(~end)
    seen = np.zeros((2, 2))
    np.add.at(seen, (tags[inner], tags[inner + 1]), 1)
    often = np.bincount(slot, np.bincount(ids, minlength=len(slots))[word], WEIGHTS)
    rate = 4 / (1 + np.sqrt(often))
    speed = np.zeros(WEIGHTS)
    for k in range(rounds):
        emission = bias + np.bincount(word, weights[slot], len(slots))
        toxic, pairs = marginals(emission[ids], end, step)
        off = np.bincount(ids, tags - toxic, len(slots))
        slope = np.bincount(slot, off[word], WEIGHTS) - ridge * weights
        speed = 0.9 * speed + 0.1 * (slope * rate) ** 2
        weights += 0.5 * slope * rate / (np.sqrt(speed / (1 - 0.9 ** (k + 1))) + 0.1)
        bias += float(np.clip(off.sum() / (1 + tags.sum()), -0.3, 0.3))
        move = (seen - pairs) / (1 + seen.sum()) * 5
        step += np.clip(move - move[0, 0], -0.3, 0.3)
    weights[often == 0] = 0
    return weights, bias, step


def fit(rows: list[tuple[str | None, int, float]]) -> Model:
    """Fit to (text, toxic, weight) rows; the weight undoes the sampling of either kind."""
    telling = tag_words(rows)
    words = Words()
    ids, end, size = words.sentences(t for t, _, _ in rows)
    likely = np.array([any(f in telling for f in features(w)) for w in words.number], dtype=bool)
    toxic_doc = np.repeat(np.array([y for _, y, _ in rows], dtype=bool), size)
    tags = (likely[ids] & toxic_doc).astype(np.int64) if len(ids) else np.zeros(0, dtype=np.int64)
    weights, bias, step = fit_field(ids, end, tags, [_slots(w) for w in words.number])
    model = Model(weights, bias, step, np.array([-5.0, 0, 0, 0]))
    if not rows or len({y for _, y, _ in rows}) < 2:
        return model
    toxic, size = model.tag([t for t, _, _ in rows])
    x = np.column_stack([np.ones(len(rows)), _summary(toxic, size)])
    y, w = np.array([y for _, y, _ in rows], dtype=float), np.array([w for _, _, w in rows])
    b = np.zeros(4)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        slope = x.T @ (w * (y - p)) - 0.1 * np.array([0, *b[1:]])
        curve = (x * (w * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + 0.1 * np.eye(4)
        b = b + np.clip(np.linalg.solve(curve, slope), -2, 2)
    model.logistic = b
    return model


def held_out(folds: int = FOLDS, fold: int = HELD_OUT):
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = TRAIN_DOCS) -> list[tuple[str | None, int, float]]:
    """About ``sample`` labelled documents of either kind, chosen by a hash of their id, outside the held-out fold.

    A document with several labels counts as toxic if one says so; labels without an id or a value are ignored, and so
    are null texts and long ones. Rows that are equal in id and text count once. A row's weight undoes the sampling.
    """
    own = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out()).groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    many = {r[0]: r[1] for r in own.groupBy("toxic").count().collect()}
    if not many:
        return []
    lot = F.pmod(F.xxhash64("doc_id", F.lit("toxicity")), F.lit(1_000_000)) / 1_000_000
    rates = F.create_map(*[F.lit(x) for kind, n in many.items() for x in (kind, min(1.0, sample / n))])
    # Bounded by about twice the sample.
    chosen = own.where(lot < rates[F.col("toxic")])
    rows = bounded_texts(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"), "toxic", TRAIN_TEXT_BYTES, TRAIN_BYTES).collect()
    taken = Counter(r["toxic"] for r in rows)
    return [(r["text"], r["toxic"], many[r["toxic"]] / taken[r["toxic"]]) for r in sorted(rows, key=lambda r: (r["doc_id"], r["text"]))]


def score_toxicity(docs: DataFrame, labels: DataFrame | None = None, model: Model | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Score every whole text; fits to ``labels`` outside the held-out fold if no model is given.

    A null or empty text has no words and gets the score of none. Without labels of both kinds, every score is the
    same low one. Null ids are kept and never held out; rows that share an id are judged apart; no rows give no rows.
    Further columns are not carried.

    Returns doc_id, held_out, score, predicted (1 from the threshold on), spans (begin, stop, chance).
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model or fit(training_rows(docs, labels)))

    def run(batches):
        own = shared.value
        for part in slices(batches, "text"):
            texts = part.column("text").to_pylist()
            toxic, size = own.tag(texts)
            score = own.scores(toxic, size)
            at = np.concatenate([[0], np.cumsum(np.array(size, dtype=np.int64))])
            hot = np.array([toxic[a:b].max(initial=0) > 0.5 for a, b in zip(at[:-1], at[1:])], dtype=bool)
            found = [[dict(zip(("begin", "stop", "chance"), s)) for s in spans(t, toxic[a:b])] if h else [] for t, a, b, h in zip(texts, at[:-1], at[1:], hot)]
            kind = pa.list_(pa.struct([("begin", pa.int32()), ("stop", pa.int32()), ("chance", pa.float64())]))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("held_out"), pa.array(score), pa.array((score >= threshold).astype(np.int32)), pa.array(found, kind)],
                names=["doc_id", "held_out", "score", "predicted", "spans"],
            )

    schema = "doc_id long, held_out boolean, score double, predicted int, spans array<struct<begin:int,stop:int,chance:double>>"
    return map_arrow(docs.select("doc_id", "text", held_out().alias("held_out")), run, schema)
