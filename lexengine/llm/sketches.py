"""Shingle sets and HyperMinHash registers of whole texts."""

from __future__ import annotations

import numpy as np
import xxhash

SHINGLE = 5
BANDS = 32
ROWS = 4
REGISTERS = BANDS * ROWS
MANTISSA_BITS = 10
#: Rows of a text's shingle hashes that are hashed at once; bounds memory for very long texts.
CHUNK = 4_096
MAX_CACHED_WORDS = 400_000
_M64 = (1 << 64) - 1


def _constants(n: int, seed: int) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(i.to_bytes(4, "big"), seed) | 1 for i in range(n)], np.uint64)


_FACTORS = _constants(REGISTERS, 1)
_SHIFTS = _constants(REGISTERS, 2)
_POWERS = _constants(SHINGLE, 3)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_words: dict[bytes, int] = {}


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MIX
    return h ^ (h >> np.uint64(29))


def word_ids(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words; hashes of words seen before are kept, up to a bound."""
    if len(_words) > MAX_CACHED_WORDS:
        _words.clear()
    get, digest, out = _words.get, xxhash.xxh3_64_intdigest, []
    for w in words:
        h = get(w)
        if h is None:
            h = _words[w] = digest(w)
        out.append(h)
    return np.array(out, np.uint64)


def shingle_set(data: bytes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's 5-word shingles, A-Z lower-cased; with fewer words, of all of them as one."""
    words = data.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < SHINGLE:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), len(words))], np.uint64)
    ids = word_ids(words)
    n = len(ids) - SHINGLE + 1
    h = np.zeros(n, np.uint64)
    for i in range(SHINGLE):
        h += _mix(ids[i : i + n] * _POWERS[i])
    return np.unique(_mix(h))


def set_digest(hashes: np.ndarray) -> bytes:
    """128 bits that stand for the whole set."""
    return xxhash.xxh3_128_digest(hashes.astype("<u8").tobytes())


def bands(hashes: np.ndarray) -> np.ndarray:
    """HyperMinHash registers, four to a 64-bit band.

    Register j holds the least value of hash function j over the set, compressed to 16 bits: the number of
    its leading zeros (6 bits) and the 10 bits after the first one.
    """
    least = np.full(REGISTERS, _M64, np.uint64)
    for at in range(0, len(hashes), CHUNK):
        part = hashes[at : at + CHUNK, None] * _FACTORS[None, :] + _SHIFTS[None, :]
        np.minimum(least, part.min(axis=0), out=least)
    high = np.floor(np.log2(np.maximum(least, 1).astype(np.float64))).astype(np.int64)
    # float rounding can lift a value to the next power of two
    high = np.where((least >> np.minimum(high, 63).astype(np.uint64)) == 0, high - 1, np.minimum(high, 63))
    zeros = (63 - high).astype(np.uint64)
    rest = np.where(high >= MANTISSA_BITS, least >> np.maximum(high - MANTISSA_BITS, 0).astype(np.uint64), least << np.maximum(MANTISSA_BITS - high, 0).astype(np.uint64))
    register = (zeros << np.uint64(MANTISSA_BITS)) | (rest & np.uint64((1 << MANTISSA_BITS) - 1))
    return register.astype("<u2").view("<i8")


def collision_rate(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Chance that two unequal least values compress to one register: about 2^-10 * ln 2 * P(same exponent), for sets of n and m."""
    ratio = np.minimum(n, m) / np.maximum(np.maximum(n, m), 1)
    return np.log(2) * 0.5 * 2.0**-MANTISSA_BITS * (0.5 + 0.5 * ratio)


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard similarity of pairs of sets from their bands (rows of 32 int64), corrected for collisions."""
    equal = (np.ascontiguousarray(a).view("<u2") == np.ascontiguousarray(b).view("<u2")).mean(axis=1)
    c = collision_rate(n, m)
    return np.maximum(0.0, (equal - c) / (1 - c))
