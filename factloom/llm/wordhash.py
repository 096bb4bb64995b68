"""Hashes of the words and word runs of a whole text, in numpy over its bytes."""

from __future__ import annotations

import numpy as np

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_rng = np.random.default_rng(7_001)
_VALUE = _rng.integers(1, 2**63, 256, dtype=_U) * _U(2) + _U(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Bytes hashed at once; longer texts are cut between words.
SEGMENT = 1 << 19
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = max(1 << 14, 1 << (n - 1).bit_length())
        inverse = pow(_BASE, -1, 1 << 64)
        for name, base in (("up", _BASE), ("down", inverse)):
            steps = np.full(size, base, _U)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"], _POWERS["down"]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def _segment(raw: np.ndarray) -> np.ndarray:
    space = _SPACE[raw]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).view(np.int8)))
    start, end = edge[0::2], edge[1::2]
    if not len(start):
        return np.empty(0, _U)
    up, down = _powers(len(raw) + 1)
    total = np.zeros(len(raw) + 1, _U)
    np.cumsum(_VALUE[raw] * up[: len(raw)], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(_U))


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash for each word between the six ASCII separators, in order."""
    raw = np.frombuffer(text, np.uint8)
    if len(raw) <= SEGMENT:
        return _segment(raw)
    parts, at = [], 0
    while at < len(raw):
        to = min(len(raw), at + SEGMENT)
        while to < len(raw):
            back = np.flatnonzero(_SPACE[raw[at:to]])
            if len(back):
                to = at + int(back[-1]) + 1
                break
            to = min(len(raw), to + SEGMENT)  # a word longer than a segment
        parts.append(_segment(raw[at:to]))
        at = to
    return np.concatenate(parts)


def runs(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` words, in order."""
    out = words[: max(0, len(words) - n + 1)].copy()
    for k in range(1, n):
        out = mix(out) + words[k : len(words) - n + 1 + k]
    return mix(out)


def shingles(text: str | None, n: int) -> np.ndarray:
    """Ascending hashes of the distinct runs of ``n`` words, A-Z lower-cased; a shorter text is one run."""
    words = word_hashes((text or "").encode("utf-8", "surrogatepass").lower())  # bytes: only A-Z change
    if not len(words):
        return words
    if len(words) < n:
        return runs(words, len(words)) ^ _U(n)
    return np.unique(runs(words, n))
