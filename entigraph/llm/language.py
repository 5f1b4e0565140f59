"""Language identification by a blended-spectrum string kernel with Nystroem landmarks and kernel ridge regression.

The kernel of two texts counts the byte n-grams (n = 1 to 3) present in both, over those that occur in enough landmark
texts, divided by the root of both texts' own counts. Landmarks are training texts. A kernel value is a product of
presence vectors, so the landmarks, the Nystroem root and the ridge weights multiply into one matrix of n-grams by
languages once they are fitted: all scoring is by batched products of a presence matrix with it. Landmarks, n-grams
and languages are bounded in number, and so is the model that is broadcast (63 MB at most, 1 MB for ten languages).
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._batches import map_arrow, slices
from ._sample import bounded_texts

#: Bounds of the training sample: texts of each language and in all, bytes of a text (longer ones teach nothing), and
#: bytes in all.
TRAIN_TEXTS = 300
TRAIN_TEXTS_IN_ALL = 3000
TRAIN_TEXT_BYTES = 64 << 10
TRAIN_BYTES = 24 << 20
#: Landmarks of each language, among the training texts, and in all where there are many languages (one each at least).
LANDMARKS, LANDMARKS_IN_ALL = 24, 480
#: Languages that are learned: those of the most labelled texts.
LANGUAGES = 480
#: N-grams that are features: those of the most landmarks.
MOST_FEATURES = 1 << 15
#: Landmarks that an n-gram must occur in to be a feature.
LEAST_MARKS = 2
RIDGE = 1e-2
UNKNOWN = "und"
FOLDS, HELD_OUT = 5, 0
#: Entries of a presence matrix that are made at once.
PRESENCE_ENTRIES = 8 << 20

_SEPARATOR = b"\x00"
#: Symbols of n-grams: 0 parts texts, then the letters a-z, a blank for other ASCII, and the bytes beyond ASCII.
_SYMBOLS = 28 + 128
_SYMBOL = bytes(0 if b == 0 else b - 0x80 + 28 if b >= 0x80 else b - 0x61 + 1 if 0x61 <= b <= 0x7A else b - 0x41 + 1 if 0x41 <= b <= 0x5A else 27 for b in range(256))


def _bytes(text: str | None) -> bytes:
    return (text or "").lower().encode().replace(_SEPARATOR, b" ").translate(_SYMBOL)


def _codes(raw: np.ndarray) -> list[np.ndarray]:
    """Numbers of the 1-, 2- and 3-grams that begin at each symbol; those with a separator are 0."""
    a = raw.astype(np.int32)
    two = np.where((a[:-1] > 0) & (a[1:] > 0), a[:-1] * _SYMBOLS + a[1:], 0)
    three = np.where((two[:-1] > 0) & (a[2:] > 0), two[:-1] * _SYMBOLS + a[2:], 0) if len(a) > 2 else np.zeros(0, dtype=np.int32)
    return [a, two, three]


@dataclass
class Model:
    languages: list[str]
    features: list[np.ndarray]  # numbers of the kept 1-, 2- and 3-grams, ascending
    matrix: np.ndarray  # n-grams by languages

    def __post_init__(self) -> None:
        self._tables = None

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_tables": None}

    @property
    def width(self) -> int:
        return sum(map(len, self.features))

    def tables(self) -> list[np.ndarray]:
        """Column of each n-gram by its number, -1 for the others; made once in a worker."""
        if self._tables is None:
            self._tables, first = [], 0
            for n, own in enumerate(self.features, 1):
                table = np.full(_SYMBOLS**n, -1, dtype=np.int16 if self.width < 1 << 15 else np.int32)
                table[own] = np.arange(first, first + len(own))
                first += len(own)
                self._tables.append(table)
        return self._tables

    def presence(self, texts: list[str | None]) -> np.ndarray:
        parts = [_bytes(t) for t in texts]
        raw = np.frombuffer(_SEPARATOR.join(parts), dtype=np.uint8)
        out = np.zeros((len(texts), self.width), dtype=np.float32)
        owner = np.repeat(np.arange(len(texts), dtype=np.int64), [len(p) + 1 for p in parts])[: len(raw)] * self.width
        flat = out.reshape(-1)
        for codes, table in zip(_codes(raw), self.tables()):
            column = table[codes]
            keep = column >= 0
            flat[owner[: len(column)][keep] + column[keep]] = 1
        return out

    def products(self, texts: list[str | None], matrix: np.ndarray) -> np.ndarray:
        """Presence vectors of the texts, divided by the roots of their counts, times ``matrix``."""
        out, step = np.zeros((len(texts), matrix.shape[1]), dtype=np.float32), max(1, PRESENCE_ENTRIES // max(self.width, 1))
        for at in range(0, len(texts), step):
            found = self.presence(texts[at : at + step])
            size = np.sqrt(np.maximum(found.sum(axis=1), 1))
            out[at : at + step] = (found @ matrix) / size[:, None]
        return out

    def decide(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text: the halved distance of the best regression value from -1, in 0 to 1."""
        value = self.products(texts, self.matrix)
        best = value.argmax(axis=1)
        score = np.clip((value[np.arange(len(best)), best] + 1) / 2, 0, 1).astype(np.float64)
        known = np.array([any(map(str.isalpha, t or "")) for t in texts], dtype=bool)
        return [self.languages[i] if k else UNKNOWN for i, k in zip(best.tolist(), known.tolist())], np.where(known, score, 0.0)


def _features(found: list[np.ndarray], least: int, most: int) -> list[np.ndarray]:
    """The n-grams of one text or more that are kept, ascending: of the most texts first, ties by a hash of the number."""
    value, count = zip(*(np.unique(n, return_counts=True) for n in found))
    length = np.repeat([1, 2, 3], list(map(len, value)))
    value, count = np.concatenate(value), np.concatenate(count)
    keep = np.flatnonzero((count >= least) & (value > 0))
    mixed = (value[keep].astype(np.uint64) * np.uint64(4) + length[keep].astype(np.uint64)) * np.uint64(2654435761) % np.uint64(1 << 32)
    keep = keep[np.lexsort((mixed, -count[keep]))[:most]]
    return [np.sort(value[keep[length[keep] == n]]) for n in (1, 2, 3)]


def fit(rows: list[tuple[str, str]], landmarks: int = LANDMARKS, least_marks: int = LEAST_MARKS, ridge: float = RIDGE, most: int = MOST_FEATURES) -> Model:
    """Fit to (text, language) rows, in the order given."""
    languages = sorted({y for _, y in rows})
    if not languages:
        return Model([UNKNOWN], [np.zeros(0, dtype=np.int64)] * 3, np.zeros((0, 1), dtype=np.float32))
    own: dict[str, list[str]] = {y: [] for y in languages}
    each = min(landmarks, max(1, LANDMARKS_IN_ALL // len(languages)))
    for t, y in rows:
        if len(own[y]) < each:
            own[y].append(t)
    chosen = [t for y in languages for t in own[y]]
    grams = zip(*([np.unique(c) for c in _codes(np.frombuffer(_bytes(t), dtype=np.uint8))] for t in chosen))
    model = Model(languages, _features([np.concatenate(x) for x in grams], min(least_marks, len(chosen)), most), None)

    marks = model.presence(chosen)
    marks = (marks / np.sqrt(np.maximum(marks.sum(axis=1), 1))[:, None]).T.copy()
    among = model.products(chosen, marks).astype(np.float64)
    value, vector = np.linalg.eigh((among + among.T) / 2)
    kept = value > 1e-6 * value.max()
    if not kept.any():  # no n-gram tells anything
        model.matrix = np.zeros((model.width, len(languages)), dtype=np.float32)
        return model
    root = vector[:, kept] / np.sqrt(value[kept])
    mapped, target = np.zeros((root.shape[1],) * 2), np.zeros((root.shape[1], len(languages)))
    of = Counter(lang for _, lang in rows)
    for at in range(0, len(rows), 256):
        part = rows[at : at + 256]
        z = model.products([t for t, _ in part], marks) @ root
        y = np.array([[1.0 if name == lang else -1.0 for name in languages] for _, lang in part])
        weight = np.array([1 / of[lang] for _, lang in part])
        mapped += (z * weight[:, None]).T @ z
        target += (z * weight[:, None]).T @ y
    weights = root @ np.linalg.solve(mapped + ridge * np.trace(mapped) / len(mapped) * np.eye(len(mapped)), target)
    model.matrix = (marks.astype(np.float64) @ weights).astype(np.float32)
    return model


def training_rows(docs: DataFrame, texts: int = TRAIN_TEXTS, in_all: int = TRAIN_TEXTS_IN_ALL) -> list[tuple[str, str]]:
    """About ``texts`` labelled texts of each language, ``in_all`` at most, outside the held-out fold.

    They are chosen by a hash of id and text among those of bounded length; rows that are equal in both and in their
    language count once.
    """
    labelled = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    labelled = labelled.where(F.octet_length("text") <= TRAIN_TEXT_BYTES)
    many = {r[0]: r[1] for r in labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()}
    if not many:
        return []
    each = min(texts, in_all / len(many))
    rates = F.create_map(*[F.lit(x) for lang, n in many.items() for x in (lang, min(1.0, each / n))])
    lot = F.pmod(F.xxhash64("doc_id", "text", F.lit("language")), F.lit(1_000_000)) / 1_000_000
    rows = bounded_texts(labelled.where(lot < rates[F.col("lang")]), "lang", TRAIN_TEXT_BYTES, TRAIN_BYTES // len(many)).collect()
    return [(r["text"], r["lang"]) for r in sorted(rows, key=lambda r: (r["doc_id"], r["text"], r["lang"]))]


def held_out(folds: int = FOLDS, fold: int = HELD_OUT):
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(False))


def train(docs: DataFrame, texts: int = TRAIN_TEXTS, landmarks: int = LANDMARKS) -> Model:
    return fit(training_rows(docs, texts), landmarks)


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """Language of every whole text.

    Trains on ``docs`` itself (without its held-out fold) when no model is given. A text that is null or has no letter
    (``str.isalpha``) is ``und`` with score 0. With nothing labelled, every text is ``und``. A null id is kept and never held out; rows
    that share an id are judged apart; no rows give no rows. Further columns are not carried.

    Returns doc_id, held_out, lang_pred, score.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model or train(docs))

    def run(batches):
        for part in slices(batches, "text"):
            lang, score = shared.value.decide(part.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held"), pa.array(lang, pa.string()), pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])

    return map_arrow(docs.select("doc_id", held_out().alias("held"), "text"), run, "doc_id long, held_out boolean, lang_pred string, score double")


def keep_languages(docs: DataFrame, model: Model | None = None, languages: list[str] | None = None, least_score: float = 0.0) -> DataFrame:
    """Rows whose language is known, among ``languages`` if given, and scored ``least_score`` or more; all columns stay.

    Null texts and those without a letter go; with nothing labelled, all do. Every row is judged apart by its text
    alone, whatever its id, null or repeated; no rows give no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model or train(docs))
    wanted = None if languages is None else set(languages)

    def run(batches):
        for part in slices(batches, "text"):
            lang, score = shared.value.decide(part.column("text").to_pylist())
            yield part.filter(pa.array([y != UNKNOWN and (wanted is None or y in wanted) and s >= least_score for y, s in zip(lang, score.tolist())], pa.bool_()))

    return map_arrow(docs, run, docs.schema)
