"""Words and word shingles of a text as 64-bit hashes."""

from __future__ import annotations

import numpy as np
import xxhash

from plansmith.llm.workers import forgets

CACHED_WORDS = 400_000
_WORDS: dict[bytes, int] = {}
forgets(_WORDS.clear)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def words(text: str) -> list[bytes]:
    """[^\\x20\\x09-\\x0D]+ as UTF-8: bytes.split() knows just these six blanks."""
    return text.encode().split()


def word_hashes(found: list[bytes]) -> np.ndarray:
    known = _WORDS
    try:
        return np.fromiter(map(known.__getitem__, found), np.uint64, len(found))
    except KeyError:
        new = {w: xxhash.xxh3_64_intdigest(w) for w in set(found) if w not in known}
        out = np.fromiter((known[w] if w in known else new[w] for w in found), np.uint64, len(found))
        if len(known) + len(new) > CACHED_WORDS:
            known.clear()
        known.update((w, h) for w, h in new.items() if len(w) <= 64)
        return out


def windows(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash for every run of n words (of all, when there are fewer; none for no words)."""
    n = min(n, len(hashes))
    if not n:
        return hashes[:0]
    out = np.full(len(hashes) - n + 1, n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(n):
            out = out * _STEP + hashes[i : len(hashes) - n + 1 + i]
            out ^= out >> np.uint64(29)
    return mix64(out)


def shingle_set(text: str | None, n: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles, A-Z lower-cased."""
    return np.unique(windows(word_hashes(words(text or "") if not text else text.encode().lower().split()), n))
