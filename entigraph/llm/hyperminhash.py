"""HyperMinHash sketches of shingle sets, by whole arrays.

A set's hashes fall into ``REGISTERS`` buckets by their highest bits. A register keeps its bucket's least remainder as
a count of leading zeros and the ``MANTISSA`` bits after the first one, 16 bits in all.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import xxhash

REGISTERS = 128
MANTISSA = 10
EMPTY = 0xFFFF
#: Chance that a pair exactly at the limit shares no band of registers, at most.
BAND_MISS = 1e-6
#: Sets of at most so many shingles also meet by shared prefixes, which is exact.
SMALL = 64

_REST = 64 - REGISTERS.bit_length() + 1
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A published 64-bit finalizer (SplitMix64)."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[str | None], width: int) -> list[np.ndarray]:
    """Ascending distinct 64-bit hashes of each text's ``width``-word shingles; A-Z count as a-z.

    With fewer words, the whole sequence is one shingle; without words the set is empty.
    """
    cut = [(t or "").encode().lower().split() for t in texts]
    numbers: dict[bytes, int] = {}
    ids = np.array([numbers.setdefault(w, len(numbers)) for w in chain.from_iterable(cut)], dtype=np.int64)
    if not len(ids):
        return [np.zeros(0, dtype=np.uint64) for _ in texts]
    word = np.array([xxhash.xxh64_intdigest(w) for w in numbers], dtype=np.uint64)[ids]
    rolled = np.zeros(max(len(word) - width + 1, 0), dtype=np.uint64)
    weight = mix(np.arange(1, width + 1, dtype=np.uint64) * _ODD[0]) | np.uint64(1)
    for k in range(width):
        rolled += word[k : k + len(rolled)] * weight[k]
    rolled = mix(rolled)
    out, at = [], 0
    for words in cut:
        n = len(words)
        if n >= width:
            out.append(np.unique(rolled[at : at + n - width + 1]))
        elif n:
            out.append(mix((word[at : at + n] * weight[:n]).sum(dtype=np.uint64, keepdims=True) + _ODD[n % 3]))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
        at += n
    return out


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """Registers of each set (one row a set), ``EMPTY`` where a bucket has no hash."""
    edge = np.arange(REGISTERS, dtype=np.uint64) << np.uint64(_REST)
    least = np.zeros((len(sets), REGISTERS), dtype=np.uint64)
    there = np.zeros((len(sets), REGISTERS), dtype=bool)
    for i, s in enumerate(sets):
        if len(s):
            at = np.minimum(np.searchsorted(s, edge), len(s) - 1)
            least[i] = s[at]
            there[i] = (s[at] >= edge) & (s[at] - edge < np.uint64(1 << _REST))
    rest = least & np.uint64((1 << _REST) - 1)
    # Exact bit lengths: of the high and the low half.
    high = (rest >> np.uint64(32)).astype(np.float64)
    length = np.where(high > 0, np.frexp(high)[1] + 32, np.frexp((rest & np.uint64(0xFFFFFFFF)).astype(np.float64))[1]).astype(np.int64)
    zeros = _REST - length
    fraction = np.where(length > MANTISSA, rest >> np.maximum(length - 1 - MANTISSA, 0).astype(np.uint64), rest << np.maximum(MANTISSA + 1 - length, 0).astype(np.uint64))
    value = zeros.astype(np.uint64) << np.uint64(MANTISSA) | fraction & np.uint64((1 << MANTISSA) - 1)
    return np.where(there, value, EMPTY).astype(np.uint16)


def _donors() -> np.ndarray:
    """For each register, the others in a fixed pseudo-random order: an empty one borrows from the first that is not."""
    n = np.arange(REGISTERS, dtype=np.uint64)
    score = mix(n[:, None] * _ODD[1] + n[None, :] * _ODD[2])
    return np.argsort(score, axis=1)


_DONORS = _donors()


def filled(regs: np.ndarray) -> np.ndarray:
    out, empty = regs.copy(), regs == EMPTY
    for k in range(REGISTERS):
        need = empty & (out == EMPTY)
        if not need.any():
            break
        donor = regs[:, _DONORS[:, k]]
        out = np.where(need, donor, out)
    return out


def band_rows(percent: int) -> int:
    """Registers of a band: as many as leave a pair at the limit a chance of ``BAND_MISS`` or less to share none.

    At 0.85, 25 bands of 5 registers miss (1 - 0.85 ** 5) ** 25 = 4e-7 of such pairs; at 0.80, 32 bands of 4, 5e-8.
    """
    fits = [r for r in range(1, 9) if (1 - (percent / 100) ** r) ** (REGISTERS // r) <= BAND_MISS]
    return max(fits, default=1)


def band_keys(regs: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key for each band of ``rows`` registers of each set, distinct between bands."""
    bands = REGISTERS // rows
    used = filled(regs)[:, : bands * rows].reshape(len(regs), bands, rows).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * _ODD[0], used.shape[:2]).copy()
    for k in range(rows):
        key = mix(key * _ODD[1] + used[:, :, k])
    return key


def prefix_keys(s: np.ndarray, percent: int) -> np.ndarray:
    """Keys of which two sets share one if their similarity is ``percent`` hundredths or more: the first few hashes."""
    n = len(s)
    return mix(s[: n - -(-n * percent // 100) + 1] * _ODD[2])


def candidate_keys(sets: list[np.ndarray], regs: np.ndarray, percent: int) -> list[np.ndarray]:
    """Keys by which similar sets meet: all by bands, the small ones and their largest partners by prefixes, too."""
    bands = band_keys(regs, band_rows(percent))
    reach = SMALL * 100 // percent
    none = np.zeros(0, dtype=np.uint64)
    return [none if not len(s) else np.concatenate([bands[i], prefix_keys(s, percent)]) if len(s) <= reach else bands[i] for i, s in enumerate(sets)]


def slack(percent: int) -> float:
    """How far below the limit an estimate of a pair at the limit may lie: 4.8 standard deviations of a share of registers."""
    p = percent / 100
    return 4.8 * (p * (1 - p) / REGISTERS) ** 0.5


def estimate(one: np.ndarray, two: np.ndarray, n_one: np.ndarray, n_two: np.ndarray) -> np.ndarray:
    """Jaccard estimates of rows of registers, with expected chance collisions taken off.

    Registers that both lack say nothing. Two different least values agree by chance in their leading zeros and in their
    mantissa; for buckets with a and b hashes that is about ab / (a + b) ** 2 * 1.5 / 2 ** MANTISSA, summed over the
    binary orders of magnitude.
    """
    both = (one != EMPTY) | (two != EMPTY)
    same = ((one == two) & both).sum(axis=-1)
    seen = np.maximum(both.sum(axis=-1), 1)
    a, b = np.maximum(n_one, 1), np.maximum(n_two, 1)
    chance = np.minimum(1.5 * 2.0 * a * b / (a + b) ** 2 / 2**MANTISSA, 0.5)
    return np.clip((same / seen - chance) / (1 - chance), 0, 1)
