"""Longest common substrings of a text with many others, by a suffix array of these."""

from __future__ import annotations

from array import array
from bisect import bisect_left

import numpy as np


class SubstringIndex:
    """Texts in the order of preference. Their suffixes are sorted once; a text asked is then looked up place by place, and no pair of texts is compared as a whole."""

    def __init__(self, texts: list[str]):
        joined = "\0".join(texts) + "\0"
        self.text = joined.encode("utf-32-le") if not joined.isascii() else joined.encode()
        self.wide = 1 if joined.isascii() else 4
        points = np.frombuffer(self.text, np.uint8 if self.wide == 1 else np.uint32).astype(np.int64)
        starts = np.cumsum([0, *(len(t) + 1 for t in texts)])
        order = self._sorted(points)
        self.preferred = (np.searchsorted(starts, order, "right") - 1).astype(np.int32)
        self.places = array("i", order.astype(np.intc).tobytes())
        self.probes = 0

    @staticmethod
    def _sorted(points: np.ndarray) -> np.ndarray:
        """The suffix array by doubling; equal suffixes up to a separator may stand in any order."""
        n = len(points)
        rank = np.unique(points, return_inverse=True)[1].astype(np.int64)
        ends = np.flatnonzero(points == 0)
        left = ends[np.searchsorted(ends, np.arange(n))] - np.arange(n)  # characters up to the separator
        step = 1
        while step <= left.max() and rank.max() < n - 1:
            after = np.zeros(n, np.int64)
            inside = np.flatnonzero(left >= step)
            after[inside] = rank[inside + step] + 1
            rank = np.unique(rank * (n + 1) + after, return_inverse=True)[1].astype(np.int64)
            step *= 2
        return np.argsort(rank, kind="stable")

    def _slice(self, at: int, size: int) -> bytes:
        return self.text[at * self.wide : (at + size) * self.wide]

    def _bound(self, piece: bytes, size: int, after: bool, low: int = 0) -> int:
        """How many suffixes stand before those that begin with a piece, or before what follows them."""
        wide, text = self.wide, self.text
        self.probes += 1
        if wide == 1:
            if after:
                return bisect_left(self.places, True, low, key=lambda p: text[p : p + size] > piece)
            return bisect_left(self.places, piece, low, key=lambda p: text[p : p + size])
        order = lambda b: np.frombuffer(b, np.uint32).tolist()
        wanted = order(piece)
        if after:
            return bisect_left(self.places, True, low, key=lambda p: order(text[4 * p : 4 * (p + size)]) > wanted)
        return bisect_left(self.places, wanted, low, key=lambda p: order(text[4 * p : 4 * (p + size)]))

    def best(self, asked: str) -> tuple[int, int]:
        """(size, number) of the longest substring of `asked` in any text, and of the most preferred text that has one of that size; 0 and the first text where none has a character."""
        raw = asked.encode() if self.wide == 1 and asked.isascii() else asked.encode("utf-32-le")
        if self.wide == 1 and not asked.isascii():  # characters that no text has part it
            parts = "".join(c if c.isascii() else "\0" for c in asked)
            raw = parts.encode()
        size, number = 0, 0
        n = len(raw) // self.wide
        for i in range(n):
            want = max(size, 1)
            piece = raw[i * self.wide : (i + want) * self.wide]
            if len(piece) < want * self.wide or (b"\0" in piece if self.wide == 1 else 0 in np.frombuffer(piece, np.uint32)):
                continue
            first = self._bound(piece, want, False)
            if first == len(self.places) or self._slice(self.places[first], want) != piece:
                continue
            longest = want
            while i + longest < n:  # as far as some text goes on
                piece = raw[i * self.wide : (i + longest + 1) * self.wide]
                if piece[-self.wide :] == b"\0" * self.wide:
                    break
                at = self._bound(piece, longest + 1, False, first)
                if at == len(self.places) or self._slice(self.places[at], longest + 1) != piece:
                    break
                first, longest = at, longest + 1
            piece = raw[i * self.wide : (i + longest) * self.wide]
            own = int(self.preferred[first : self._bound(piece, longest, True, first)].min())
            if longest > size:
                size, number = longest, own
            else:
                number = min(number, own)
        return size, number
