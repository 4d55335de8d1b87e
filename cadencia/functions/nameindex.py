"""The best names for a name by max(token set ratio, partial ratio), without scoring all of them.

An inverted index holds, for each name of a block, its letters and its pairs of neighbouring letters, repeats counted. From how many of both a name shares with
the query follows how long their common subsequence can be at most, and so a bound of either ratio from above; shared whole
words, with their lengths, add what the token set ratio can gain from them. Names are scored by falling bound, in growing portions, until the k-th best score
beats every bound that is left: nothing that belongs to the best k is missed.

Partial ratios of a portion are computed for all windows at once, with the common subsequence in the bits of 64-bit words; texts
of more than 63 characters go through Python integers.

Where only names above a score count, the common subsequence of the query with each whole name, in the bits of a word for each name, tells which can reach it.
"""

from __future__ import annotations

from collections import Counter
from functools import cached_property

import numpy as np

from cadencia.functions import similarity as sm

_WORD_BITS = 63
#: Names of up to so many letters are met a letter at a time; so many letters' bits are held at once.
_LONG, _LETTERS = 64, 256
_WINDOWS = 400_000
_ONE = np.uint64(1)


def _features(text: str) -> list[tuple]:
    """Letters and neighbouring pairs, the n-th time that each occurs."""
    return [(f, i) for f, n in (Counter(text) + Counter(a + b for a, b in zip(text, text[1:], strict=False))).items() for i in range(n)]


def _head(text: str) -> str:
    return (text.split() or [""])[0]


def _joined(text: str) -> str:
    return " ".join(sorted(set(text.split())))


class NameIndex:
    def __init__(self, names: list[str]) -> None:
        self.names = sorted(set(names))
        self.size = np.array([len(x) for x in self.names], np.int64)
        self.first = np.cumsum(self.size) - self.size
        self.letters: dict[str, int] = {}
        self.flat = np.array([self.letters.setdefault(c, len(self.letters) + 1) for x in self.names for c in x] + [0], np.int64)
        self.set_size = np.array([len(_joined(x)) for x in self.names], np.float64)
        self.spaces = np.array([max(len(set(x.split())) - 1, 0) for x in self.names], np.float64)
        self.head = np.array([len(_head(x)) for x in self.names], np.int64)
        self._bits: dict[str, np.ndarray] = {}
        self._least: dict[tuple, np.ndarray] = {}

    @cached_property
    def postings(self) -> dict[tuple, np.ndarray]:
        made: dict[tuple, list[int]] = {}
        for i, x in enumerate(self.names):
            for f in _features(x):
                made.setdefault(f, []).append(i)
        return {f: np.array(p, np.int32) for f, p in made.items()}

    @cached_property
    def words(self) -> dict[str, np.ndarray]:
        made: dict[str, list[int]] = {}
        for i, x in enumerate(self.names):
            for w in set(x.split()):
                made.setdefault(w, []).append(i)
        return {w: np.array(p, np.int32) for w, p in made.items()}

    @cached_property
    def _places(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """By letters: (where those of each letter begin, their names, their places in the names), without names that a word cannot hold; the type of the word."""
        short = self.size <= _LONG
        owner = np.repeat(np.arange(len(self.names)), self.size)
        at = np.arange(len(owner)) - self.first[owner]
        some = np.flatnonzero(short[owner])
        some = some[np.argsort(self.flat[some], kind="stable")]
        begin = np.searchsorted(self.flat[some], np.arange(len(self.letters) + 2))
        word = np.uint32 if self.size[short].max(initial=0) <= 32 else np.uint64
        return begin, owner[some], at[some], word

    def _letter_bits(self, letter: str) -> np.ndarray:
        """For each name the places of the letter, as bits."""
        if letter not in self._bits:
            begin, owner, at, word = self._places
            a, b = begin[self.letters[letter]], begin[self.letters[letter] + 1]
            out = np.zeros(len(self.names), word)
            np.bitwise_or.at(out, owner[a:b], word(1) << at[a:b].astype(word))
            if len(self._bits) >= _LETTERS:
                self._bits.clear()
            self._bits[letter] = out
        return self._bits[letter]

    def common(self, query: str) -> np.ndarray:
        """The length of the longest common subsequence with each name, all names a letter of the query at a time; for names that a word cannot hold, no less."""
        word = self._places[3]
        row, hit = np.full(len(self.names), ~word(0)), np.empty(len(self.names), word)
        for c in query:
            if c in self.letters:
                np.bitwise_and(row, self._letter_bits(c), out=hit)
                rest = row - hit
                row += hit
                row |= rest
        full = np.where(self.size >= 8 * row.itemsize, ~word(0), (word(1) << np.minimum(self.size, 8 * row.itemsize - 1).astype(word)) - word(1))
        return np.where(self.size <= _LONG, np.bitwise_count(~row & full), np.minimum(self.size, len(query)))

    def _shared(self, lists: list[np.ndarray], weights: list[float] | None = None) -> np.ndarray:
        n = len(self.names)
        if not lists:
            return np.zeros(n)
        every = np.concatenate(lists)
        return np.bincount(every, None if weights is None else np.repeat(weights, [len(x) for x in lists]), n).astype(float)

    def bounds(self, query: str) -> tuple[np.ndarray, np.ndarray]:
        """(of the partial ratio, of the token set ratio): no name's ratio is larger."""
        own = _features(query)
        letters = self._shared([self.postings[f] for f in own if len(f[0]) == 1 and f in self.postings])
        pairs = self._shared([self.postings[f] for f in own if len(f[0]) == 2 and f in self.postings])
        # a common subsequence of length L with a window of length w falls into 1 + m + w - 2L runs at most, which keep all but one of their pairs each
        m = np.minimum(self.size, len(query))
        most = np.minimum(np.minimum(m, letters), (pairs + 1 + m) / 2)
        partial = np.where(m > 0, 200.0 * most / np.maximum(m + most, 1), 100.0 * (self.size == len(query)))
        words = set(query.split())
        held = [w for w in words if w in self.words]
        shared = self._shared([self.words[w] for w in held], [len(w) + 1.0 for w in held]) - 1
        la, lb, gaps = float(len(_joined(query))), self.set_size, np.minimum(len(words) - 1.0, self.spaces)
        most = np.minimum(np.minimum(letters, np.minimum(la, lb)), (pairs + 1 + 2 * gaps + la + lb) / 3)
        both = np.maximum(shared, 0)
        token = np.maximum(200.0 * most / np.maximum(la + lb, 1), np.maximum(200.0 * both / np.maximum(both + la, 1), 200.0 * both / np.maximum(both + lb, 1)))
        token = np.where((both > 0) & ((both >= la) | (both >= lb)), 100.0, token)
        return partial, np.where((la > 0) & (lb > 0), token, 0.0)

    def _masks(self, query: str) -> np.ndarray:
        out = np.zeros(len(self.letters) + 1, np.uint64)
        for i, c in enumerate(query):
            if c in self.letters:
                out[self.letters[c]] |= _ONE << np.uint64(i)
        return out

    def _in_names(self, query: str, rows: np.ndarray) -> np.ndarray:
        """Partial ratios of the query, the shorter one, with windows of the names."""
        m, size = len(query), self.size[rows]
        masks, full = self._masks(query), np.uint64((1 << m) - 1)
        owner = np.repeat(np.arange(len(rows)), size)
        lead = np.cumsum(size) - size
        start = np.arange(len(owner)) - lead[owner]
        left = size[owner] - start
        at = self.first[rows][owner] + start
        row = np.full(len(owner), full)
        best = np.zeros(len(rows))
        for t in range(m):
            hit = row & masks[self.flat[np.where(t < left, at + t, -1)]]
            row = (row + hit) | (row - hit)
            # the first window cut short is the name's beginning hanging over
            best = np.maximum(best, 200.0 * np.bitwise_count(~row[lead] & full) / (m + np.minimum(t + 1, size)))
        return np.maximum(best, np.maximum.reduceat(200.0 * np.bitwise_count(~row & full) / (m + np.minimum(m, left)), lead))

    def _in_query(self, query: str, rows: np.ndarray) -> np.ndarray:
        """Partial ratios of the names, the shorter ones, with windows of the query."""
        n, size = len(query), self.size[rows]
        masks = self._masks(query)
        each = n + size - 1
        owner = np.repeat(np.arange(len(rows)), each)
        lead = np.cumsum(each) - each
        place = np.arange(len(owner)) - lead[owner] - size[owner] + 1
        begin = np.maximum(place, 0)
        width = np.minimum(place + size[owner], n) - begin
        full = (_ONE << width.astype(np.uint64)) - _ONE
        begin = begin.astype(np.uint64)
        first, left, row = self.first[rows][owner], size[owner], full.copy()
        for t in range(int(size.max())):
            hit = row & (masks[self.flat[np.where(t < left, first + t, -1)]] >> begin) & full
            row = (row + hit) | (row - hit)
        return np.maximum.reduceat(200.0 * np.bitwise_count(~row & full) / (left + width), lead)

    def partial(self, query: str, rows: np.ndarray) -> np.ndarray:
        out = np.zeros(len(rows))
        n, size = len(query), self.size[rows]
        slow = (n == 0) | (size == 0) | (n > _WORD_BITS)
        for i in np.flatnonzero(slow):
            out[i] = sm.partial_ratio(query, self.names[rows[i]])
        for way, on in ((self._in_names, ~slow & (size >= n)), (self._in_query, ~slow & (size <= n))):
            some = np.flatnonzero(on)
            cuts = np.flatnonzero(np.diff(np.cumsum(size[some] + n) // _WINDOWS)) + 1
            for part in np.split(some, cuts):
                if len(part):
                    out[part] = np.maximum(out[part], way(query, rows[part]))
        return out

    def reaching(self, query: str, k: int, least: float, head: float, may) -> tuple[list[tuple[float, str]], bool]:
        """The k best (score, name) of those that score `least` or more, without a score for most others; whether a name may(query, name) is among the
        others whose first words have a ratio of `head` or more.

        A window's common subsequence, and that of the first words, are no longer than that of both whole names, and so are the token sets' of single words.
        """
        n, first = len(query), _head(query)
        one = " " not in query
        if (n, len(first)) not in self._least:
            if len(self._least) >= _LETTERS:
                self._least.clear()
            partial = np.minimum(n, self.size) * least / (200 - least)
            token = np.where(self.spaces == 0, (n + self.size) * least / 200, np.inf)
            self._least[n, len(first)] = np.minimum(partial, np.minimum(token, (len(first) + self.head) * head / 200)) - 1e-6
        reach = self.common(query) >= self._least[n, len(first)]
        if not one or self.spaces.any():
            reach |= self.bounds(query)[1] + 1e-9 >= least
        rows = np.flatnonzero(reach)
        if not len(rows):
            return [], False
        score = self.partial(query, rows)
        score = np.maximum(score, [sm.token_set_ratio(query, self.names[r]) for r in rows])
        others = (self.names[r] for r in rows[score < least])
        more = any(sm.ratio(first, _head(x)) >= head - 1e-6 and may(query, x) for x in others)
        best = sorted((-s, int(r)) for s, r in zip(score.tolist(), rows.tolist(), strict=True) if s >= least)[:k]
        return [(-s, self.names[r]) for s, r in best], more

    def top(self, query: str, k: int) -> list[tuple[float, str]]:
        """The k best (score, name): by falling score, then by name."""
        partial_bound, token_bound = self.bounds(query)
        bound = np.maximum(partial_bound, token_bound) + 1e-9
        order = np.argsort(-bound, kind="stable")
        best: list[tuple[float, int]] = []
        at, portion = 0, 4 * k
        while at < len(order):
            if len(best) == k:
                least = -best[-1][0]
                stop = int(np.searchsorted(-bound[order], -least, "right"))
                if at >= stop:
                    break
                rows = order[at : min(at + portion, stop)]
            else:
                rows = order[at : at + portion]
            score = self.partial(query, rows)
            for i in np.flatnonzero(token_bound[rows] + 1e-9 > score):
                score[i] = max(score[i], sm.token_set_ratio(query, self.names[rows[i]]))
            best = sorted(best + [(-s, int(r)) for s, r in zip(score.tolist(), rows.tolist(), strict=True)])[:k]
            at, portion = at + len(rows), min(2 * portion, 4_096)
        return [(-s, self.names[r]) for s, r in best]
