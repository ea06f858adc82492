"""Word shingles of whole texts as 64-bit hashes, by numpy over the UTF-8 bytes.

Words are runs of bytes other than space and \\t \\n \\v \\f \\r, with A-Z lower-cased. A
shingle of ``k`` words is hashed over the bytes of its words joined by single spaces with a
polynomial modulo 2**64 (prefix sums, so any k costs the same) and a mixer. Links that the hashes
find are confirmed on the shingles themselves (``truly_linked``).
"""

from __future__ import annotations

import hashlib

import numpy as np

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_BASE = 0x9E3779B97F4A7C15
_INV = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.Generator(np.random.PCG64(20)).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_pows: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _powers(kind: str, n: int) -> np.ndarray:
    have = _pows[kind]
    if len(have) < n:
        base = _BASE if kind == "up" else _INV
        while len(have) < n:
            have = np.concatenate([have, have * np.uint64(pow(base, len(have), 1 << 64))])
        _pows[kind] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_set(text: str | None, k: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; with fewer words, of the whole sequence.

    Null, empty and blank texts have the empty set.
    """
    if not text:
        return np.empty(0, np.uint64)
    words = text.encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    joined = np.frombuffer(b" ".join(words), np.uint8)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.zeros(len(words), np.int64)
    np.cumsum(lengths[:-1] + 1, out=starts[1:])
    ends = starts + lengths
    k = min(k, len(words))
    starts, ends = starts[: len(words) - k + 1], ends[k - 1 :]
    sums = np.zeros(len(joined) + 1, np.uint64)
    np.cumsum(_BYTE[joined] * _powers("up", len(joined)), out=sums[1:])
    h = (sums[ends] - sums[starts]) * _powers("down", len(joined))[starts]
    return np.unique(mix(h + (ends - starts).astype(np.uint64) * np.uint64(_INV)))


def fingerprint(s: np.ndarray) -> bytes | None:
    """16 bytes that stand for a whole set; None for the empty set."""
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None


def linked(a: np.ndarray, b: np.ndarray, percent: int = 85) -> bool:
    """Whether 100 * intersection >= percent * union, in whole numbers."""
    both = np.intersect1d(a, b, assume_unique=True).size
    return 100 * both >= percent * (a.size + b.size - both)


def true_shingles(text: str, k: int = 5) -> set[bytes]:
    """The k-word shingles themselves, words joined by single spaces; with fewer words, the whole sequence."""
    words = text.encode("utf-8", "surrogatepass").translate(LOWER).split()
    k = min(k, len(words))
    return {b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)} if words else set()


def truly_linked(a: str, b: str, k: int = 5, percent: int = 85) -> bool:
    """Whether 100 * intersection >= percent * union of the shingles themselves, whatever their hashes."""
    x, y = true_shingles(a, k), true_shingles(b, k)
    both = len(x & y)
    return bool(x) and bool(y) and 100 * both >= percent * (len(x) + len(y) - both)
