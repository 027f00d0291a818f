"""Word-shingle sets as 64-bit hashes, and their MinHash signatures."""

from __future__ import annotations

import functools
import hashlib
from itertools import chain

import numpy as np
import xxhash

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_MEMO_WORDS = 500_000


class _WordHashes(dict):
    """Hash of each word, remembered."""

    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_memo = _WordHashes()


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def shingle_sets(texts: list[bytes | None], words: int = 5) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's shingles of `words` words.

    A-Z are lower-cased; words are runs of bytes other than ASCII white space. A text with fewer words has
    its whole sequence as the only shingle; a text without words has none.
    """
    if len(_memo) > _MEMO_WORDS:
        _memo.clear()
    found = [t.lower().split() if t else [] for t in texts]
    sizes = [len(w) for w in found]
    h = np.fromiter(map(_memo.__getitem__, chain.from_iterable(found)), np.uint64, sum(sizes))
    n_runs = max(0, len(h) - words + 1)
    runs = np.full(n_runs, words, np.uint64)
    for j in range(words):
        runs = _mix((runs ^ h[j : j + n_runs]) * _A + _B)
    out, at = [], 0
    for n in sizes:
        if n >= words:
            out.append(np.unique(runs[at : at + n - words + 1]))
        else:
            whole = np.full(min(n, 1), n, np.uint64)
            for j in range(n):
                whole = _mix((whole ^ h[at + j]) * _A + _B)
            out.append(whole)
        at += n
    return out


def set_digest(hashes: np.ndarray) -> bytes:
    """128 bits that tell sets apart; the empty set's are empty."""
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest() if len(hashes) else b""


@functools.cache
def _permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    return rng.integers(0, 1 << 32, n, np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, n, np.uint32)


def signature(hashes: np.ndarray, n: int) -> np.ndarray:
    """The n minima of a set under n fixed pseudo-random orders; all ones for the empty set."""
    a, b = _permutations(n)
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    best = np.full(n, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(x), 256):  # so that a block stays in cache
        np.minimum(best, (x[k : k + 256, None] * a + b).min(axis=0), out=best)
    return best


def jaccard_linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union, on full sets."""
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    common = int((a[np.minimum(np.searchsorted(a, b), len(a) - 1)] == b).sum())
    return 100 * common >= percent * (len(a) + len(b) - common)
