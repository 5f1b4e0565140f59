"""Token ids of whole texts by the ``tokenizers`` library, with ids of repeated segments remembered.

A byte-level BPE cuts a text by a pattern and never merges across a cut. Between a character that is no white space and
a following blank there always is one, so a text's ids are those of its segments cut there, joined. A slice of texts is
cut, and its distinct segments are found and looked up by Arrow; those that are not remembered go to the library: single
words to its model, others to its whole encoder.
"""

from __future__ import annotations

import json
import os
import re
import sys
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of remembered segments and their ids in a worker.
MEMO_BYTES = 64 << 20
#: Longer segments are not remembered.
MEMO_CHARS = 128

_CUT = "\x00"
_CAREFUL = re.compile(r"(?<=\S)(?= )")
# A word of letters of the Latin blocks, with one mark behind it or none: one or two cuts of the pattern.
_WORD = re.compile(r"( ?[A-Za-zªµºÀ-ÖØ-öø-ſ]+)([.,!?:;]?)\Z")


def _alphabet() -> dict[int, str]:
    """Byte alphabet of byte-level vocabularies: printable bytes stand for themselves, the others follow from 256 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in printable]
    return {b: chr(256 + i) for i, b in enumerate(rest)}


ALPHABET = _alphabet()


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def check_vocabulary(described: dict) -> None:
    """Fail on a vocabulary for which the ids of a text may not be those of its segments."""
    cutter = described.get("pre_tokenizer") or {}
    added = [t["content"] for t in described.get("added_tokens") or []]
    if (
        described.get("normalizer") is not None
        or (cutter.get("type"), cutter.get("add_prefix_space"), cutter.get("use_regex", True)) != ("ByteLevel", False, True)
        or described["model"].get("type") != "BPE"
        or any(re.search(r"\s", t) for t in added)
    ):
        raise ValueError("not a byte-level BPE vocabulary with the usual word pattern")


class Memo:
    """Bytes by segment, as Arrow arrays within a bound of bytes; those that were met least lately go first."""

    def __init__(self, limit: int):
        self.limit, self.turn = limit, 0
        self.keys, self.values = pa.array([], pa.large_string()), pa.array([], pa.large_binary())
        self.met = np.zeros(0, dtype=np.int64)

    def find(self, segments: pa.Array) -> pa.Array:
        """The place of each segment, null where it is not remembered."""
        at = pc.index_in(segments, value_set=self.keys)
        self.turn += 1
        self.met[at.drop_null().to_numpy()] = self.turn
        return at

    def add(self, segments: pa.Array, values: pa.Array) -> None:
        short = pc.less_equal(pc.utf8_length(segments), MEMO_CHARS)
        self.keys = pa.concat_arrays([self.keys, segments.filter(short)])
        self.values = pa.concat_arrays([self.values, values.filter(short)])
        self.met = np.concatenate([self.met, np.full(len(self.keys) - len(self.met), self.turn)])
        if self.keys.nbytes + self.values.nbytes + self.met.nbytes > self.limit:
            size = np.diff(_offsets(self.keys)) + np.diff(_offsets(self.values)) + 24
            order = np.argsort(-self.met, kind="stable")
            kept = pa.array(np.sort(order[np.cumsum(size[order]) <= self.limit // 2]))
            self.keys, self.values, self.met = self.keys.take(kept), self.values.take(kept), self.met[kept.to_numpy()]


def _offsets(column: pa.Array) -> np.ndarray:
    return np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, dtype=np.int64)


def _marked(text: str) -> str:
    """The text with marks where it is cut: before blanks, and around single line ends."""
    plain = text.replace("\n", " ")
    if plain.isprintable() and "  " not in plain:
        return text.replace("\n", "\x00\n\x00").replace(" ", "\x00 ")
    # Runs of white space, or other kinds of it; a text's own marks are left to the library.
    return text if _CUT in text else _CAREFUL.sub(_CUT, text)


class Segments:
    """Ids of texts by those of their segments, which a subclass gives (little-endian unsigned 32-bit)."""

    def __init__(self, memo_bytes: int = MEMO_BYTES):
        assert sys.byteorder == "little" and array("I").itemsize == 4
        self.memo = Memo(memo_bytes)

    def _segment(self, segment: str) -> bytes:
        raise NotImplementedError

    def _ids(self, segments: pa.Array) -> pa.Array:
        """Ids of distinct segments."""
        at = self.memo.find(segments)
        unknown = at.is_null()
        new = segments.filter(unknown)
        made = pa.array(map(self._segment, new.to_pylist()), pa.large_binary())
        # Known values first, then the new ones, in the segments' order.
        place = np.cumsum(unknown.to_numpy(zero_copy_only=False)) - 1 + len(self.memo.keys)
        at = pc.coalesce(at.cast(pa.int64()), pa.array(place))
        out = pa.concat_arrays([self.memo.values, made]).take(at)
        self.memo.add(new, made)
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        odd = {i: t for i, t in enumerate(texts) if _CUT in t}
        marked = pa.array(["" if i in odd else _marked(t) for i, t in enumerate(texts)], pa.large_string())
        cut = pc.split_pattern(marked, _CUT)
        coded = cut.flatten().dictionary_encode()
        ids = self._ids(coded.dictionary).take(coded.indices)
        ends = _offsets(ids)[np.asarray(cut.offsets)].tolist()
        raw = memoryview(ids.buffers()[2] or b"")
        return [self._segment(odd[i]) if i in odd else bytes(raw[a:b]) for i, (a, b) in enumerate(zip(ends, ends[1:]))]


class Encoder(Segments):
    """Encodes texts to little-endian unsigned 32-bit ids, without special tokens added."""

    def __init__(self, path: str, memo_bytes: int = MEMO_BYTES):
        super().__init__(memo_bytes)
        # A task has one core; the library would start a thread for each of the machine's.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            check_vocabulary(json.load(f))
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model

    def _word(self, word: str) -> bytes:
        """Ids of one cut of the pattern, straight from the library's BPE model, in its byte alphabet."""
        shown = word.replace(" ", ALPHABET[0x20]) if word.isascii() else word.encode().decode("latin-1").translate(ALPHABET)
        return array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()

    def _segment(self, segment: str) -> bytes:
        word = _WORD.match(segment)
        if word is None:
            return array("I", self.tokenizer.encode(segment, add_special_tokens=False).ids).tobytes()
        return self._word(word[1]) + (self._word(word[2]) if word[2] else b"")


_encoders: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, memo_bytes: int = MEMO_BYTES) -> Encoder:
    """The worker's encoder of this vocabulary file, kept between tasks."""
    if (path, memo_bytes) not in _encoders:
        _encoders[path, memo_bytes] = Encoder(path, memo_bytes)
    return _encoders[path, memo_bytes]
