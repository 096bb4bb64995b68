"""A bidirectional FM-index over a delimited vocabulary, searched for many patterns at once in numpy.

The text is ``#word#word#...#``. A pattern's interval of suffix ranks is kept in the index of the text and in that of the
mirrored text, so it can grow to the left and to the right.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

END, DELIMITER, FIRST = 0, 1, 2
#: Cells of the padded matrix of one chunk of patterns.
CHUNK_CELLS = 1 << 17


def suffix_array(codes: np.ndarray) -> np.ndarray:
    """Ranks by doubling; the last code is the least and occurs once."""
    rank, n, k = codes.astype(np.int64), len(codes), 1
    while True:
        after = np.zeros(n, np.int64)
        after[: max(0, n - k)] = rank[k:] + 1
        key = rank * (n + 2) + after
        order = np.argsort(key, kind="stable")
        new = np.empty(n, np.int64)
        new[order] = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
        if new[order[-1]] == n - 1:
            return order
        rank, k = new, k * 2


class Direction:
    """Counts of smaller symbols in prefixes of the Burrows-Wheeler transform: one table serves ranks and neighbours."""

    def __init__(self, codes: np.ndarray, symbols: int) -> None:
        self.suffixes = suffix_array(codes)
        transform = codes[self.suffixes - 1]
        hot = np.zeros((len(codes) + 1, symbols + 1), np.int32)
        hot[np.arange(1, len(codes) + 1), transform + 1] = 1
        np.cumsum(hot, axis=0, out=hot)
        np.cumsum(hot, axis=1, out=hot)
        self.less = hot  # less[i, c]: symbols below c among the first i
        self.starts = hot[-1].astype(np.int64)

    def extend(self, at: np.ndarray, other: np.ndarray, size: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The intervals, here and in the other direction, after one more symbol at this end."""
        low, low1 = self.less[at, c], self.less[at, c + 1]
        high, high1 = self.less[at + size, c], self.less[at + size, c + 1]
        return self.starts[c] + (low1 - low), other + (high - low), (high1 - high) - (low1 - low)

    def branches(self, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(state, letter) for each letter that follows at this end."""
        counts = np.diff(self.less[at + size, FIRST:] - self.less[at, FIRST:], axis=1)
        state, letter = np.nonzero(counts)
        return state, letter + FIRST


class VocabularyIndex:
    def __init__(self, words: Sequence[str]) -> None:
        self.words = words
        points = np.frombuffer(("\x00" + "\x00".join(words) + "\x00").encode("utf-32-le"), np.uint32)
        self.alphabet = np.unique(points)  # the delimiter is the least
        codes = np.searchsorted(self.alphabet, points) + DELIMITER
        symbols = len(self.alphabet) + DELIMITER
        self.left = Direction(np.append(codes, END), symbols)
        self.right = Direction(np.append(codes[::-1], END), symbols)
        self.number = np.append(np.cumsum(codes == DELIMITER) - 1, -1)  # of the word that a delimiter begins

    def encoded(self, patterns: Sequence[str], width: int) -> np.ndarray:
        """A row for each pattern, padded with the delimiter; letters that no word has are -1."""
        points = np.frombuffer("".join(p.ljust(width, "\x00") for p in patterns).encode("utf-32-le"), np.uint32)
        place = np.searchsorted(self.alphabet, points)
        known = self.alphabet[np.minimum(place, len(self.alphabet) - 1)] == points
        return np.where(known, place + DELIMITER, -1).reshape(len(patterns), width)

    def one_error(self, patterns: Sequence[str], exact: Sequence[int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(pattern, word) pairs in which the word begins with the pattern's first ``exact`` letters, and the rest of both
        differs by one inserted, deleted or replaced letter. Each pair comes once."""
        lengths = np.array([len(p) for p in patterns], np.int64)
        order = np.argsort(lengths, kind="stable")
        at = 0
        while at < len(order):
            to = at + 1
            while to < len(order) and (to + 1 - at) * (lengths[order[to]] + 1) <= CHUNK_CELLS:
                to += 1
            chosen = order[at:to]
            q, word = self._chunk([patterns[i] for i in chosen], lengths[chosen], np.array([exact[i] for i in chosen], np.int64))
            yield chosen[q], word
            at = to

    def _chunk(self, patterns: list[str], n: np.ndarray, exact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        code, whole = self.encoded(patterns, int(n.max()) + 1), len(self.number)
        # First half, leftwards from its last letter, then the delimiter before it.
        q = np.arange(len(patterns))
        a, b, size = np.zeros(len(q), np.int64), np.zeros(len(q), np.int64), np.full(len(q), whole, np.int64)
        done = []
        for step in range(int(exact.max()) + 1):
            here = exact[q] - 1 - step
            c = np.where(here >= 0, code[q, np.maximum(here, 0)], DELIMITER)
            alive = c >= 0
            q, a, b, size, here, c = (x[alive] for x in (q, a, b, size, here, c))
            a, b, size = self.left.extend(a, b, size, c)
            ready = (here < 0) & (size > 0)
            done.append((q[ready], b[ready], a[ready], size[ready]))
            more = (here >= 0) & (size > 0)
            q, a, b, size = (x[more] for x in (q, a, b, size))
        # Second half, rightwards: exact states and states with the one error, all at the same place.
        exactly = tuple(np.concatenate(x) for x in zip(*done, strict=True))
        erred = tuple(x[:0] for x in exactly)
        found: list[tuple[np.ndarray, ...]] = []
        for step in range(int((n - exact).max()) + 1):
            q, a, b, size = exactly
            at = exact[q] + step
            last = at == n[q]
            own = np.where(last, DELIMITER, code[q, np.minimum(at, n[q])])
            state, letter = self.right.branches(a, size)
            other = letter != own[state]
            state, letter = state[other], letter[other]
            grown = (q[state], *self.right.extend(a[state], b[state], size[state], letter))
            inserted, replaced = grown, tuple(x[~last[state]] for x in grown)
            skipped = tuple(x[~last] for x in exactly)
            now = tuple(np.concatenate(x) for x in zip(erred, inserted, strict=True))
            now, ended = self._exact(now, code, n, exact, step)
            found.append(ended)
            erred = tuple(np.concatenate(x) for x in zip(now, replaced, skipped, strict=True))
            exactly, _ = self._exact(exactly, code, n, exact, step)
        q, word = (np.concatenate(x) for x in zip(*[(e[0], self.number[self.left.suffixes[e[2]]]) for e in found], strict=True))
        pair = np.unique(q * len(self.words) + word)
        return pair // len(self.words), pair % len(self.words)

    def _exact(self, states: tuple[np.ndarray, ...], code: np.ndarray, n: np.ndarray, exact: np.ndarray, step: int) -> tuple[tuple[np.ndarray, ...], tuple[np.ndarray, ...]]:
        """One more symbol as the pattern has it: (states that go on, states that met the delimiter at the pattern's end)."""
        q, a, b, size = states
        at = exact[q] + step
        c = np.where(at < n[q], code[q, np.minimum(at, n[q])], DELIMITER)
        alive = c >= 0
        q, a, b, size, c, at = (x[alive] for x in (q, a, b, size, c, at))
        a, b, size = self.right.extend(a, b, size, c)
        on, over = (size > 0) & (at < n[q]), (size > 0) & (at == n[q])
        return tuple(x[on] for x in (q, a, b, size)), tuple(x[over] for x in (q, a, b, size))
