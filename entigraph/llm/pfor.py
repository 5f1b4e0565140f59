"""Patched frame-of-reference blocks of unsigned 32-bit integers, encoded and decoded by whole arrays.

A file is, little-endian: the magic, block size (u4), values (u8), blocks (u8), documents (u8); per document its id
(i8), whether the id is set (u1) and its count of values (u8); the byte at which each block starts, from the first
(u8); then the blocks. A block is its minimum (u4), bit width (u1), a zero (u1) and its count of outliers (u2), then
the differences from the minimum in ``width`` low bits each, the outliers' places (u1) and their high parts (u4).
"""

from __future__ import annotations

import struct

import numpy as np

MAGIC = b"PFORTOK1"
BLOCK = 256
#: Share of a block's values that its width must hold; the rest are outliers.
PERCENTILE = 0.9

_HEAD = struct.Struct("<8sIQQQ")
_AT_ONCE = 1024
#: 32 values of ``width`` bits fill ``width`` whole words.
_GROUP = 32


def _bits(x: np.ndarray) -> np.ndarray:
    return np.frexp(x.astype(np.float64))[1].astype(np.uint8)


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """The low ``width`` bits of rows of 32-bit values, joined from the lowest on, as rows of bytes."""
    groups = np.ascontiguousarray(values.reshape(-1, _GROUP).T) & np.uint32((1 << width) - 1)
    words = np.zeros((width, groups.shape[1]), dtype="<u4")
    for k in range(_GROUP):
        word, shift = divmod(k * width, 32)
        words[word] |= groups[k] << np.uint32(shift)
        if shift + width > 32:
            words[word + 1] |= groups[k] >> np.uint32(32 - shift)
    return np.ascontiguousarray(words.T).view(np.uint8).reshape(len(values), -1)


def _unpack(raw: np.ndarray, width: int) -> np.ndarray:
    """The values of rows of bytes that ``_pack`` made."""
    words = np.ascontiguousarray(np.ascontiguousarray(raw).view("<u4").reshape(-1, width).T)
    groups = np.empty((_GROUP, words.shape[1]), dtype="<u4")
    for k in range(_GROUP):
        word, shift = divmod(k * width, 32)
        groups[k] = words[word] >> np.uint32(shift)
        if shift + width > 32:
            groups[k] |= words[word + 1] << np.uint32(32 - shift)
    groups &= np.uint32((1 << width) - 1)
    return np.ascontiguousarray(groups.T).reshape(len(raw), -1)


def encode(values: np.ndarray, percentile: float = PERCENTILE) -> tuple[np.ndarray, bytes]:
    """Block starts and the blocks of these values. The last block is filled up with its last value."""
    n = len(values)
    if not n:
        return np.zeros(0, dtype="<u8"), b""
    blocks = -(-n // BLOCK)
    padded = np.empty(blocks * BLOCK, dtype="<u4")
    padded[:n] = values
    padded[n:] = values[-1]
    padded = padded.reshape(blocks, BLOCK)
    low = padded.min(axis=1)
    diff = padded - low[:, None]
    nth = int(percentile * (BLOCK - 1))
    width = _bits(np.partition(diff, nth, axis=1)[:, nth])
    outlier = (diff >> np.minimum(width, 31).astype(np.uint32)[:, None] > 0) & (width < 32)[:, None]
    many = outlier.sum(axis=1)
    packed = BLOCK // 8 * width.astype(np.int64)
    size = 8 + packed + 5 * many
    start = np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64)
    out = np.zeros(int(size.sum()), dtype=np.uint8)

    head = np.zeros(blocks, dtype=[("min", "<u4"), ("width", "u1"), ("zero", "u1"), ("many", "<u2")])
    head["min"], head["width"], head["many"] = low, width, many
    out[start[:, None] + np.arange(8)] = head.view(np.uint8).reshape(blocks, 8)
    for w in np.unique(width):
        if not w:
            continue
        own = np.flatnonzero(width == w)
        for at in range(0, len(own), _AT_ONCE):
            part = own[at : at + _AT_ONCE]
            raw = _pack(diff[part], int(w))
            out[(start[part] + 8)[:, None] + np.arange(raw.shape[1])] = raw
    block, place = np.nonzero(outlier)
    if len(block):
        nth = np.arange(len(block)) - np.repeat(np.cumsum(many) - many, many)
        at = (start + 8 + packed)[block]
        out[at + nth] = place
        high = (diff[block, place] >> width[block].astype(np.uint32)).astype("<u4")
        out[(at + many[block] + 4 * nth)[:, None] + np.arange(4)] = high.view(np.uint8).reshape(-1, 4)
    return start.astype("<u8"), out.tobytes()


def decode(starts: np.ndarray, data: bytes | memoryview, n: int) -> np.ndarray:
    """The first ``n`` values of the blocks at these starts."""
    blocks = len(starts)
    out = np.zeros((blocks, BLOCK), dtype="<u4")
    if not blocks:
        return out.reshape(-1)
    raw, start = np.frombuffer(data, dtype=np.uint8), np.asarray(starts).astype(np.int64)
    head = raw[start[:, None] + np.arange(8)].reshape(-1).view([("min", "<u4"), ("width", "u1"), ("zero", "u1"), ("many", "<u2")])
    width, many = head["width"], head["many"].astype(np.int64)
    for w in np.unique(width):
        if not w:
            continue
        own = np.flatnonzero(width == w)
        for at in range(0, len(own), _AT_ONCE):
            part = own[at : at + _AT_ONCE]
            packed = raw[(start[part] + 8)[:, None] + np.arange(BLOCK // 8 * int(w))]
            out[part] = _unpack(packed, int(w))
    total = int(many.sum())
    if total:
        block = np.repeat(np.arange(blocks), many)
        nth = np.arange(total) - np.repeat(np.cumsum(many) - many, many)
        at = (start + 8 + BLOCK // 8 * width.astype(np.int64))[block]
        place = raw[at + nth]
        high = raw[(at + many[block] + 4 * nth)[:, None] + np.arange(4)].reshape(-1).view("<u4")
        out[block, place] |= high << width[block].astype(np.uint32)
    out += head["min"][:, None]
    return out.reshape(-1)[:n]


def pack_file(doc_ids: list[int | None], counts: list[int], values: np.ndarray) -> bytes:
    starts, data = encode(values)
    ids = np.array([x or 0 for x in doc_ids], dtype="<i8")
    there = np.array([x is not None for x in doc_ids], dtype="u1")
    head = _HEAD.pack(MAGIC, BLOCK, len(values), len(starts), len(doc_ids))
    return b"".join([head, ids.tobytes(), there.tobytes(), np.array(counts, dtype="<u8").tobytes(), starts.tobytes(), data])


def unpack_file(raw: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Document ids, their counts of values, and all values."""
    magic, block, n, blocks, docs = _HEAD.unpack_from(raw)
    if magic != MAGIC or block != BLOCK:
        raise ValueError("not a token file")
    at = _HEAD.size
    ids = np.frombuffer(raw, dtype="<i8", count=docs, offset=at)
    there = np.frombuffer(raw, dtype="u1", count=docs, offset=at + 8 * docs)
    counts = np.frombuffer(raw, dtype="<u8", count=docs, offset=at + 9 * docs).astype(np.int64)
    at += 17 * docs
    starts = np.frombuffer(raw, dtype="<u8", count=blocks, offset=at)
    values = decode(starts, memoryview(raw)[at + 8 * blocks :], n)
    return [int(i) if t else None for i, t in zip(ids, there)], counts, values


def read_values(raw: bytes, first: int, n: int) -> np.ndarray:
    """``n`` values from the ``first`` on, by the index: only the blocks that hold them are decoded."""
    _, _, total, blocks, docs = _HEAD.unpack_from(raw)
    at = _HEAD.size + 17 * docs
    starts = np.frombuffer(raw, dtype="<u8", count=blocks, offset=at)
    a, b = first // BLOCK, min(-(-min(first + n, total) // BLOCK), blocks)
    values = decode(starts[a:b], memoryview(raw)[at + 8 * blocks :], min(total, b * BLOCK) - a * BLOCK)
    return values[first - a * BLOCK :][:n]
