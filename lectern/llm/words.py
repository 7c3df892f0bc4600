"""Words of a block of texts as 64-bit hashes in one array."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import xxhash

from lectern.llm.common import MEMOS

#: Words remembered by one Python worker before it starts afresh (about 60 MB).
MEMO_WORDS = 300_000


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_HASHES = _Hashes()
MEMOS[__name__] = _HASHES.clear


def split(text: bytes) -> list[bytes]:
    """Runs of bytes other than space and the five ASCII line and tab controls."""
    return text.split()


def split_lower(text: bytes) -> list[bytes]:
    """The same after A-Z have become a-z."""
    return text.lower().split()


def word_hashes(texts: list[bytes], cut: Callable[[bytes], list[bytes]] = split) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, one text after another, and the number of words of each text."""
    if len(_HASHES) > MEMO_WORDS:
        _HASHES.clear()
    look = _HASHES.__getitem__
    out, counts = [], []
    for t in texts:
        words = cut(t)
        counts.append(len(words))
        out.append(np.fromiter(map(look, words), np.uint64, len(words)))
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), np.array(counts, np.int64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


#: Odd base of the polynomial hash, and its powers modulo 2^64.
_BASE = 0x9E3779B97F4A7C15


def window_checks(h: np.ndarray, size: int) -> np.ndarray:
    """16 more bits of every window: the top of a second Rabin-Karp hash, modulo 2^32 with a base of its own, of other bits of the words."""
    x = mix(h ^ np.uint64(0xD6E8FEB86659FD93)).astype(np.uint32)
    if len(x) < size:
        return np.zeros(0, np.uint16)
    n, out = len(x) - size + 1, np.zeros(max(0, len(x) - size + 1), np.uint32)
    for i in range(size):
        out *= np.uint32(0x915F77F5)
        out += x[i : i + n]
    out ^= out >> np.uint32(15)
    out *= np.uint32(0x2C1B3C6D)
    return (out >> np.uint32(16)).astype(np.uint16)


def window_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """Rabin-Karp hash modulo 2^64 of every ``size`` consecutive words, by doubling; scrambled at the end."""
    if len(h) < size:
        return np.zeros(0, np.uint64)
    whole, done, part, width = None, 0, h, 1
    while True:
        if size & width:
            n = len(h) - done - width + 1
            if whole is None:
                whole = part[:n].copy()
            else:
                whole = whole[:n] * np.uint64(pow(_BASE, width, 1 << 64)) + part[done : done + n]
            done += width
        if done == size:
            return mix(whole)
        part = part[:-width] * np.uint64(pow(_BASE, width, 1 << 64)) + part[width:]
        width *= 2
