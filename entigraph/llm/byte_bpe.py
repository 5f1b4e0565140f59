"""Byte-level BPE by a sentencepiece model that is written straight from a vocabulary of ranks.

Each byte has a printable character, so every token is a string of such characters: the model's piece, with the negative
rank as its score, and no normalization. The library then merges the adjacent pair of lowest rank first, as the rank
file means it. A pre-token that is itself in the vocabulary is that token. Decoding maps pieces back to bytes.
"""

from __future__ import annotations

import base64
import struct
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from ._batches import map_arrow, slices
from ._tokens import ALPHABET, MEMO_BYTES, Segments

#: Fixed values of the format: kinds of pieces, and BPE as the kind of model.
NORMAL, UNKNOWN, BPE = 1, 2, 2
#: No byte's character, so no token's piece.
UNKNOWN_PIECE = "⁇"

_BYTES = {shown: byte for byte, shown in ALPHABET.items()}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens and their ranks from lines of base64 and a number; fails if a byte has no token of its own."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
    if len(set(ranks.values())) < len(ranks) or any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError("ranks repeat, or a byte has no token")
    return ranks


def shown(token: bytes) -> str:
    """The token in its bytes' characters."""
    return token.decode("latin-1").translate(ALPHABET)


def _number(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _field(key: int, value: int | float | bytes) -> bytes:
    if isinstance(value, bytes):
        return _number(key << 3 | 2) + _number(len(value)) + value
    return _number(key << 3 | 5) + struct.pack("<f", value) if isinstance(value, float) else _number(key << 3) + _number(value)


def serialise(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece model of the tokens, in the order of their ranks, and one unknown piece behind them."""
    if max(ranks.values()) >= 1 << 24:
        raise ValueError("scores hold ranks below 2**24 exactly")
    pieces = [_field(1, shown(t).encode()) + _field(2, -float(r)) + _field(3, NORMAL) for t, r in sorted(ranks.items(), key=lambda x: x[1])]
    pieces.append(_field(1, UNKNOWN_PIECE.encode()) + _field(2, 0.0) + _field(3, UNKNOWN))
    trainer = _field(3, BPE) + _field(4, len(pieces)) + _field(40, len(ranks)) + _field(45, UNKNOWN_PIECE.encode())
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(_field(1, p) for p in pieces) + _field(2, trainer) + _field(3, normalizer)


def newer_characters(kind: str) -> str:
    """Characters of a class (``\\p{L}``, say) for ``regex`` that are not of that class for ``tiktoken``, or the other way
    round, as a set's ranges: the libraries know different versions of Unicode."""
    import tiktoken

    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    plain = tiktoken.Encoding("bytes", pat_str=kind, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
    differ = sorted(map(ord, set(plain.decode(plain.encode_ordinary(every))) ^ set(regex.findall(kind, every))))
    ends = [i for i, c in enumerate(differ) if i + 1 == len(differ) or differ[i + 1] != c + 1]
    return "".join(f"\\U{differ[a]:08x}-\\U{differ[b]:08x}" for a, b in zip([0, *(i + 1 for i in ends[:-1])], ends))


def patterns(pattern: str) -> tuple[str, str]:
    """The pattern with the classes that ``tiktoken`` means, and a set of the characters that make a difference."""
    differ = {kind: newer_characters(kind) for kind in (r"\p{L}", r"\p{N}")}
    for kind, ranges in differ.items():
        if ranges:  # within a set (of V1), and by itself
            pattern = pattern.replace(kind, f"[{kind}~~[{ranges}]]")
    every = "".join(differ.values())
    return pattern, f"[{every}]" if every else ""


class PieceEncoder(Segments):
    """Ids of texts by a vocabulary of ranks, without special tokens."""

    def __init__(self, path: str, pattern: str, exact: str, differ: str, memo_bytes: int = MEMO_BYTES):
        import sentencepiece

        super().__init__(memo_bytes)
        self.ranks = read_ranks(path)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise(self.ranks))
        self.order = sorted(self.ranks.values())  # rank by the model's id
        self.cut = regex.compile(pattern).findall
        self.exact = regex.compile(exact, regex.V1).findall
        self.differ = regex.compile(differ).search if differ else lambda text: None
        piece = self.model.id_to_piece
        self.tokens = {r: bytes(_BYTES.get(c, ord(c)) for c in piece(i)) for i, r in enumerate(self.order)}

    def _word(self, word: str) -> bytes:
        raw = word.encode()
        rank = self.ranks.get(raw)
        if rank is not None:
            return array("I", [rank]).tobytes()
        return array("I", [self.order[i] for i in self.model.encode(shown(raw), num_threads=1)]).tobytes()

    def _segment(self, segment: str) -> bytes:
        cut = self.exact if not segment.isascii() and self.differ(segment) else self.cut
        return b"".join(map(self._word, cut(segment)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


_encoders: dict[tuple, PieceEncoder] = {}


def encoder(*key) -> PieceEncoder:
    """The worker's encoder of this vocabulary file and these patterns, kept between tasks."""
    if key not in _encoders:
        _encoders[key] = PieceEncoder(*key)
    return _encoders[key]


def encode_and_decode(docs: DataFrame, ranks_path: str | None = None, memo_bytes: int = MEMO_BYTES) -> DataFrame:
    """Encode every whole text by the ranks, each match of the usual word pattern apart, and decode the ids again.

    A null text is an empty one (no ids). Rows that share a document id are encoded apart; null ids stay null. No
    documents: no rows. Further columns are not carried.

    Returns doc_id, n_tokens, ids (little-endian unsigned 32-bit), decoded (bytes).
    """
    import public_tokenizers

    key = (ranks_path or default_path(), public_tokenizers.PATTERN, *patterns(public_tokenizers.PATTERN), memo_bytes)

    def run(batches):
        own = encoder(*key)
        for part in slices(batches, "text"):
            ids = own.encode([x or "" for x in part.column("text").to_pylist()])
            n = pa.array([len(x) // 4 for x in ids], pa.int64())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), n, pa.array(ids, pa.binary()), pa.array(map(own.decode, ids), pa.binary())], names=["doc_id", "n_tokens", "ids", "decoded"])

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id long, n_tokens long, ids binary, decoded binary")
