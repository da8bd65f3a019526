"""A bidirectional FM index over word ids in numpy, for phrases of a bounded number of words.

The text is an array of ids, 0 is a break that no phrase crosses. Both the text and its reverse have a
Burrows-Wheeler transform whose suffixes are sorted by their first ``depth - 1`` words, which is as deep as any
interval that is extended. An interval holds the rows of one phrase; extending a set of disjoint intervals by all
words that stand before (or after) them is one sort of the transform's symbols inside them. The interval in the
other direction follows from the counts of smaller symbols, so phrases grow on either side.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np


@dataclass
class Intervals:
    """Phrases: their rows in the index of the text, in that of the reversed text, and their counts."""

    low: np.ndarray
    reverse_low: np.ndarray
    n: np.ndarray

    def __getitem__(self, which) -> Intervals:
        return Intervals(self.low[which], self.reverse_low[which], self.n[which])


def _sorted(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The keys (0 or more) in order, and their places; equal keys by place."""
    bits = max(1, len(key).bit_length())
    if int(key.max(initial=0)) >> (63 - bits):
        order = np.argsort(key, kind="stable")
        return key[order], order
    both = np.sort((key << bits) | np.arange(len(key)))  # sorting values is much faster than sorting places
    return both >> bits, both & ((1 << bits) - 1)


class Side:
    """The transform of one direction, its suffixes sorted by their first ``depth`` words."""

    def __init__(self, ids: np.ndarray, top: int, depth: int):
        key, width = ids.astype(np.int64), 1
        while width < depth:  # ranks of twice as many words
            value, order = _sorted(key)
            rank = np.empty(len(ids), dtype=np.int64)
            rank[order] = np.cumsum(np.diff(value, prepend=value[0]) > 0) if len(ids) else 0
            key = rank * len(ids) + np.roll(rank, -width)
            width *= 2
        order = _sorted(key)[1]
        self.bwt = ids[order - 1]
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(ids, minlength=top))])

    @cached_property
    def follow(self) -> np.ndarray:
        """Row of the suffix that begins one word earlier."""
        row = np.empty(len(self.bwt), dtype=np.int64)
        row[_sorted(self.bwt.astype(np.int64))[1]] = np.arange(len(row))
        return row

    def extend(self, low: np.ndarray, n: np.ndarray, top: int) -> tuple[np.ndarray, ...]:
        """(interval, word, a first row, count, symbols below the word) of all one-word extensions."""
        which = np.repeat(np.arange(len(low)), n)
        row = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(len(which))
        key, at = _sorted(which * top + self.bwt[row])
        first = np.flatnonzero(np.diff(key, prepend=-1))
        count = np.diff(np.append(first, len(key)))
        which, word = key[first] // top, key[first] % top
        below = first - first[np.searchsorted(which, which)]
        inside = word > 0
        return which[inside], word[inside], row[at[first[inside]]], count[inside], below[inside]


class FMIndex:
    """Index of ``ids`` (0 is a break) for phrases of up to ``depth`` words."""

    def __init__(self, ids: np.ndarray, depth: int = 3):
        ids = np.concatenate([ids, [0]])
        ids = ids[(ids > 0) | np.append(ids[1:] > 0, True)].astype(np.int32)
        self.top = int(ids.max(initial=0)) + 1
        self.text = Side(ids, self.top, depth - 1)
        self.reverse = Side(ids[::-1], self.top, depth - 1)

    def words(self) -> Intervals:
        """The intervals of the words 1, 2, ... (some may be empty)."""
        low = self.text.starts[1 : self.top]
        return Intervals(low, low, np.diff(self.text.starts[1 : self.top + 1]))

    def extend_left(self, phrases: Intervals, further: bool = True) -> tuple[np.ndarray, np.ndarray, Intervals]:
        """(phrase, word before it, the longer phrases); without ``further`` these are not extended to the left again."""
        which, word, row, n, below = self.text.extend(phrases.low, phrases.n, self.top)
        low = self.text.follow[row] if further else np.full(len(row), -1)
        return which, word, Intervals(low, phrases.reverse_low[which] + below, n)

    def extend_right(self, phrases: Intervals, further: bool = True) -> tuple[np.ndarray, np.ndarray, Intervals]:
        """(phrase, word after it, the longer phrases); without ``further`` these are not extended to the right again."""
        which, word, row, n, below = self.reverse.extend(phrases.reverse_low, phrases.n, self.top)
        low = self.reverse.follow[row] if further else np.full(len(row), -1)
        return which, word, Intervals(phrases.low[which] + below, low, n)
