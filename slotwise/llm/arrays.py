"""Numpy helpers that run inside Spark tasks: word and byte symbols, window hashes, window minimizers.

All hashes are fixed functions of content, so a task that is run again gives the same rows.
"""

from __future__ import annotations

import numpy as np
import xxhash

CACHE = 100_000          # words a task remembers; the cache is emptied beyond it, which changes no value
LONG = 64                # bytes or characters of a word beyond which it is not remembered, so that a cache has a bounded size
BLOCK = 1 << 19          # positions handled at once, so that a very long text needs bounded memory
BASE = 0x9E3779B97F4A7C15
MASK = (1 << 64) - 1


def remember(cache: dict, word, value):
    """Value of a word, stored in the task's cache unless the word is long."""
    if len(word) <= LONG:
        if len(cache) >= CACHE:
            cache.clear()
        cache[word] = value
    return value


class WordHashes(dict):
    """word bytes -> signed 64-bit hash, computed when first met."""

    def __missing__(self, word):
        h = xxhash.xxh64_intdigest(word)
        return remember(self, word, h - (1 << 64) if h >> 63 else h)


def words(text: str | None) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+` as UTF-8; none for a null text. bytes.split cuts at exactly these bytes."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def hashed(tokens: list[bytes], cache: WordHashes) -> np.ndarray:
    return np.fromiter(map(cache.__getitem__, tokens), dtype=np.int64, count=len(tokens)).view(np.uint64)


BYTE_CODES = np.array([xxhash.xxh64_intdigest(bytes([b]), seed=7) for b in range(256)], dtype=np.uint64)


def _powers(n: int, step: int) -> np.ndarray:
    out = np.full(n, step, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class Powers:
    """Powers of the hash base and of its inverse, grown on demand up to one block."""

    def __init__(self):
        self.up, self.down = _powers(1024, BASE), _powers(1024, pow(BASE, -1, 1 << 64))

    def upto(self, n: int):
        if n > len(self.up):
            size = 1 << (n - 1).bit_length()
            self.up, self.down = _powers(size, BASE), _powers(size, pow(BASE, -1, 1 << 64))
        return self.up[:n], self.down[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of a 64-bit hash."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def prefix(x: np.ndarray, powers: Powers) -> np.ndarray:
    """Prefix sums of x[i] * base^i, one longer than x."""
    up, _ = powers.upto(len(x) + 1)
    p = np.empty(len(x) + 1, dtype=np.uint64)
    p[0] = 0
    np.cumsum(x * up[:-1], out=p[1:])
    return p


def span_hash(p: np.ndarray, start: np.ndarray, end: np.ndarray, powers: Powers) -> np.ndarray:
    """Hash of x[start:end] that depends on content only."""
    _, down = powers.upto(len(p))
    return mix((p[end] - p[start]) * down[start] + (end - start).astype(np.uint64))


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    s = 1
    while 2 * s <= w:
        x = np.minimum(x[:-s], x[s:])
        s *= 2
    return np.minimum(x[:len(x) - (w - s)], x[w - s:]) if s < w else x


def window_anchors(x: np.ndarray, length: int, k: int, powers: Powers):
    """Anchors of all windows of `length` symbols: arrays (first, last, anchor place, anchor hash, cell hash).

    The anchor of a window is its k-gram with the smallest hash, the leftmost of equal ones. Windows first..last of
    one text have the same anchor; their cell is x[first : last + length]. Equal windows have equal anchor hashes, at
    the same distance from their start.
    """
    n = len(x)
    w = length - k + 1
    none = np.empty(0, dtype=np.int64)
    if n < length:
        return none, none, none, none, none
    out = []
    for lo in range(0, n - length + 1, BLOCK):
        part = x[lo:lo + BLOCK + length - 1]
        p = prefix(part, powers)
        at = np.arange(len(part) - k + 1)
        grams = mix((p[k:] - p[:-k]) * powers.upto(len(p))[1][:len(at)])
        key = (grams & np.uint64(MASK ^ 0xFFFFF)) | at.astype(np.uint64)
        low = sliding_min(key, w) & np.uint64(0xFFFFF)
        cut = np.flatnonzero(low[1:] != low[:-1]) + 1
        first = np.concatenate(([0], cut))
        last = np.concatenate((cut - 1, [len(low) - 1]))
        anchor = low[first].astype(np.int64)
        out.append((first + lo, last + lo, anchor + lo, grams[anchor].view(np.int64), span_hash(p, first, last + length, powers).view(np.int64)))
    return tuple(np.concatenate(c) for c in zip(*out))


COEF3 = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)
