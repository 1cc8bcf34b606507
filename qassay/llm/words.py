"""Words of UTF-8 texts as 64-bit hashes, whole batches at a time.

A word is a run of bytes matching [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F] after A-Z became a-z: ASCII letters and digits and every non-ASCII
character. The hash of a word is a polynomial over random byte codes modulo 2**64, taken from prefix sums, then mixed with the length.
"""

from __future__ import annotations

import numpy as np

_SEGMENT = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.zeros(256, dtype=bool)
_IS_WORD[48:58] = _IS_WORD[97:123] = _IS_WORD[128:] = True
_CODES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_CODES[~_IS_WORD] = 0
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit values over all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, _SEGMENT + 1)
        tables = [np.full(size, b, dtype=np.uint64) for b in (_BASE, _INVERSE)]
        for t in tables:
            t[0] = 1
            np.cumprod(t, out=t)
        _powers[:] = tables
    return _powers[0], _powers[1]


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of every word of raw. Work memory is bound by a segment of 1 MiB, or by the longest word."""
    data = _LOWER[np.frombuffer(raw, dtype=np.uint8)]
    hashes, firsts, at = [], [], 0
    while at < len(data):
        end = min(len(data), at + _SEGMENT)
        while end < len(data):
            breaks = np.flatnonzero(~_IS_WORD[data[max(at, end - 4096) : end]])
            if len(breaks):
                end = max(at, end - 4096) + int(breaks[-1]) + 1
                break
            ahead = np.flatnonzero(~_IS_WORD[data[end : end + _SEGMENT]])
            end = end + int(ahead[0]) + 1 if len(ahead) else min(len(data), end + _SEGMENT)
            if len(ahead):
                break
        part = data[at:end]
        inside = np.zeros(len(part) + 2, dtype=np.int8)
        inside[1:-1] = _IS_WORD[part]
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        starts, ends = edges[0::2], edges[1::2]
        power, inverse = _power_tables(len(part))
        sums = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum(_CODES[part] * power[: len(part)], out=sums[1:])
        hashes.append(mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * _BASE))
        firsts.append(starts + at)
        at = end
    if not hashes:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    return np.concatenate(hashes), np.concatenate(firsts)


def batch_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts one after the other, and len(texts) + 1 offsets into them."""
    hashes, firsts = word_hashes(b"\0".join(texts))
    ends = np.cumsum([len(t) + 1 for t in texts])
    return hashes, np.concatenate([[0], np.searchsorted(firsts, ends)]).astype(np.int64)


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k consecutive words."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        out *= np.uint64(0xD6E8FEB86659FD93)
        out += words[j : j + n]
    return mix(out + np.uint64(k))
