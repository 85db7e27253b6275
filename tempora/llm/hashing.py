"""Vectorised 64-bit hashes of the words of a text and of word sequences, for use inside tasks."""

from __future__ import annotations

import numpy as np

from .common import fold_ascii

#: Odd multiplier of the rolling polynomial, its inverse modulo 2**64, and two odd mixers.
_R = 0x9E3779B97F4A7C15
_R_INV = pow(_R, -1, 1 << 64)
_A, _B = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xC2B2AE3D27D4EB4F)
_BYTES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)
#: Texts are hashed in pieces of about this many bytes, cut at white space, to bound memory.
PIECE = 1 << 20
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser that spreads all 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 2 * len(_powers[0]), 1 << 16)
        for i, base in enumerate((_R, _R_INV)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[i] = np.multiply.accumulate(p)
    return _powers[0], _powers[1]


def _piece_words(b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, start and end of the words of a byte array in which blanks separate words."""
    if not len(b):
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    edge = np.flatnonzero(np.diff((b != 32).view(np.int8), prepend=0, append=0))
    start, end = edge[::2], edge[1::2]
    power, inverse = _power_tables(len(b))
    total = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(_BYTES[b] * power[: len(b)], out=total[1:])
    h = (total[end] - total[start]) * inverse[start]
    return mix(h + (end - start).astype(np.uint64) * _A), start, end


def word_spans(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start byte and end byte of every white-space separated word, A to Z lower-cased."""
    folded, parts, at = fold_ascii(text), [], 0
    while at < len(folded) or not parts:
        cut = len(folded) if len(folded) - at <= PIECE else folded.find(b" ", at + PIECE)
        cut = len(folded) if cut < 0 else cut
        h, s, e = _piece_words(np.frombuffer(folded, np.uint8, cut - at, at))
        parts.append((h, s + at, e + at))
        at = max(cut, at + 1)
    return tuple(np.concatenate(x) if len(parts) > 1 else x[0] for x in zip(*parts, strict=True))


def shingle_set(text: bytes | None, n: int) -> np.ndarray:
    """Sorted distinct hashes of the ``n``-word shingles; of fewer words, the whole sequence is one."""
    words = word_spans(text)[0] if text else np.empty(0, np.uint64)
    if not len(words):
        return words
    n = min(n, len(words))
    h = np.full(len(words) - n + 1, np.uint64(n))
    for i in range(n):
        h = mix(h * _A + words[i : len(words) - n + 1 + i] * _B)
    return np.unique(h.view(np.int64)).view(np.uint64)
