"""Cutting texts where no token can span the cut, and the codes of their chunks.

Whole columns are handled as bytes in NumPy arrays: a rule marks the cuts, and each distinct chunk is
encoded once a worker. Chunks of at most 16 bytes are looked up by these bytes themselves (two words of
8) in an open-addressed table, longer ones in a dict; both are bounded and emptied when they are full.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64
GROUP_CHARS = 1_000_000
GROUP_BYTES = 1 << 21

# Classes of bytes in UTF-8 texts. UNSURE stands for characters that some engine may take for white space, and for all that isn't classified.
_UNSURE, _LETTER, _DIGIT, _SIGN, _QUOTE, _SPACE, _FEED = range(7)
_CLASS = np.full(256, _UNSURE, np.uint8)
_CLASS[33:127] = _SIGN
_CLASS[48:58] = _DIGIT
_CLASS[65:91] = _CLASS[97:123] = _LETTER
_CLASS[39], _CLASS[32], _CLASS[10] = _QUOTE, _SPACE, _FEED
#: Lead bytes of blocks that hold letters only (but for U+00D7 and U+00F7), by the number of bytes that follow.
_LETTER_LEADS = {1: [*range(0xC3, 0xCB), 0xD0, 0xD1], 2: [*range(0xE5, 0xE9)]}
_LEADS = np.zeros(256, np.uint8)
for _n, _bytes in _LETTER_LEADS.items():
    _LEADS[_bytes] = _n
_SEEN = np.isin(np.arange(7), [_LETTER, _DIGIT, _SIGN, _QUOTE])
#: Where one class follows another, a token of the usual byte-level pattern ends: letters, digits and signs don't mix, and an apostrophe after a letter or digit begins one.
_TURN = np.zeros((8, 8), bool)
for _a in (_LETTER, _DIGIT, _SIGN):
    for _b in (_LETTER, _DIGIT, _SIGN):
        _TURN[_a, _b] = _a != _b
_TURN[[_LETTER, _DIGIT], _QUOTE] = True
_TURN = _TURN.ravel()


def byte_level_cuts(data: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Whether a chunk begins at each byte: where the classes turn, before a lone space and around a lone line feed. last: places of the texts' last bytes."""
    kind = _CLASS[data]
    if (data >= 0x80).any():
        for n in _LETTER_LEADS:
            at = np.flatnonzero(_LEADS[data] == n)
            if n == 1:
                at = at[(data[at] != 0xC3) | ((data[at + 1] != 0x97) & (data[at + 1] != 0xB7))]
            for k in range(n + 1):
                kind[at + k] = _LETTER
    seen = _SEEN[kind]
    after = np.zeros(len(data), bool)
    after[:-1] = seen[1:]
    after[last] = False
    cuts = np.zeros(len(data), bool)
    cuts[1:] = _TURN[kind[:-1] << np.uint8(3) | kind[1:]]
    lone = after & (kind >= _SPACE)
    lone[1:] &= seen[:-1]
    cuts |= lone
    feeds = np.flatnonzero(lone & (kind == _FEED))
    cuts[feeds + 1] = True
    return cuts


class PairCuts:
    """For a vocabulary without a pattern: a chunk begins between two characters that no piece holds side by side, judged by the bytes that meet."""

    def __init__(self, pieces: list[bytes]):
        self.whole = np.zeros(1 << 16, bool)
        for p in pieces:
            for a, b in zip(p, p[1:], strict=False):
                if b & 0xC0 != 0x80:
                    self.whole[a << 8 | b] = True
        inner = np.arange(256) & 0xC0 == 0x80
        self.begins = ~self.whole.reshape(256, 256)
        self.begins[:, inner] = False
        self.begins = self.begins.ravel()

    def __call__(self, data: np.ndarray, last: np.ndarray) -> np.ndarray:
        cuts = np.zeros(len(data), bool)
        cuts[1:] = self.begins[data[:-1].astype(np.uint16) << np.uint16(8) | data[1:]]
        return cuts

    def apart(self, byte: int) -> bool:
        """Whether no piece holds this byte beside another one."""
        return not (self.whole.reshape(256, 256)[byte].any() or self.whole.reshape(256, 256)[:, byte].any())


class KeyTable:
    """Numbers from 0 on of pairs of 64-bit words, in the order of insertion; open addressing, at most half full. The pair (0, 0) isn't allowed."""

    def __init__(self, bits: int):
        self.shift, self.limit = _U(64 - bits), 1 << (bits - 1)
        self.keys, self.numbers = np.zeros((1 << bits, 2), _U), np.full(1 << bits, -1, np.int32)
        self.size = 0

    def clear(self) -> None:
        self.keys[:], self.numbers[:], self.size = 0, -1, 0

    def _slots(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        h = (a ^ (b * _U(0x9E3779B97F4A7C15))) * _U(0xBF58476D1CE4E5B9)
        h ^= h >> _U(29)
        return ((h * _U(0x94D049BB133111EB)) >> self.shift).astype(np.int64)

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The pairs' numbers, -1 where unknown."""
        at = self._slots(a, b)
        out = self.numbers[at]
        kept = self.keys[at]
        open_ = np.flatnonzero(((kept[:, 0] != a) | (kept[:, 1] != b)) & (out >= 0))
        at = at[open_]
        while len(open_):
            at = (at + 1) & (len(self.numbers) - 1)
            kept, found = self.keys[at], self.numbers[at]
            out[open_] = found
            more = ((kept[:, 0] != a[open_]) | (kept[:, 1] != b[open_])) & (found >= 0)
            open_, at = open_[more], at[more]
        return out

    def insert(self, a: np.ndarray, b: np.ndarray, numbers: np.ndarray) -> None:
        """Distinct pairs that aren't in the table."""
        if self.size + len(a) > self.limit:
            raise ValueError("the table is full")
        at, left = self._slots(a, b), np.arange(len(a))
        while len(left):
            free = self.numbers[at] < 0
            self.numbers[at[free]] = numbers[left[free]]  # of several at one slot the last stays
            won = free & (self.numbers[at] == numbers[left])
            self.keys[at[won], 0], self.keys[at[won], 1] = a[left[won]], b[left[won]]
            left, at = left[~won], (at[~won] + 1) & (len(self.numbers) - 1)
        self.size += len(a)


_KEEP = np.array([(1 << 8 * n) - 1 for n in range(9)], _U)
SHORT = 16
#: Bytes of long chunks, and codes, that a worker keeps.
LONG_BYTES, POOL = 1 << 25, 1 << 24
SLICE = 1 << 18


class ChunkCodes:
    """The codes of texts from those of their chunks. encode: chunks -> (codes of all, number of each)."""

    def __init__(self, cuts: Callable[[np.ndarray, np.ndarray], np.ndarray], encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], bits: int = 22):
        self.cuts, self.encode = cuts, encode
        self.short = KeyTable(bits)
        self.slice = min(SLICE, self.short.limit)
        self._empty()

    def _empty(self) -> None:
        self.short.clear()
        self.long: dict[bytes, int] = {}
        self.long_bytes, self.n, self.used = 0, 0, 0
        self.first, self.count, self.pool = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32), np.zeros(1 << 18, np.uint32)

    def _add(self, codes: np.ndarray, counts: np.ndarray) -> int:
        """Appends the codes of new chunks; the number of the first."""
        n, used, first = self.n + len(counts), self.used + len(codes), self.n
        for name, need in (("first", n), ("count", n), ("pool", used)):
            held = getattr(self, name)
            if need > len(held):
                setattr(self, name, np.concatenate([held, np.zeros(max(need - len(held), len(held)), held.dtype)]))
        self.pool[self.used : used] = codes
        self.count[first:n] = counts
        self.first[first:n] = self.used + np.cumsum(counts) - counts
        self.n, self.used = n, used
        return first

    def _numbers(self, raw: bytes, words: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The numbers of chunks; new ones are encoded."""
        a = words[starts] & _KEEP[np.minimum(sizes, 8)]
        b = words[starts + 8] & _KEEP[np.clip(sizes - 8, 0, 8)]
        long_ = np.flatnonzero(sizes > SHORT)
        if raw.find(b"\0", 0, len(raw) - SHORT) >= 0:  # a zero byte reads like the end
            ends = starts + sizes
            zeros = np.r_[0, np.cumsum(np.frombuffer(raw, np.uint8) == 0)]
            long_ = np.flatnonzero((sizes > SHORT) | (zeros[ends] > zeros[starts]))
        is_short = np.ones(len(starts), bool)
        is_short[long_] = False
        keys = [raw[s : s + n] for s, n in zip(starts[long_].tolist(), sizes[long_].tolist(), strict=True)]
        out = self.short.find(a, b)
        out[long_] = [self.long.get(k, -1) for k in keys]
        if (out < 0).any():
            if self.short.size + len(starts) > self.short.limit or self.long_bytes > LONG_BYTES or self.used > POOL:
                self._empty()
                out[:] = -1
            new = np.flatnonzero((out < 0) & is_short)
            if len(new):
                new = new[np.lexsort((b[new], a[new]))]
                new = new[np.r_[True, (a[new[1:]] != a[new[:-1]]) | (b[new[1:]] != b[new[:-1]])]]
            fresh = list(dict.fromkeys(k for k in keys if k not in self.long))
            chunks = [raw[s : s + n].decode() for s, n in zip(starts[new].tolist(), sizes[new].tolist(), strict=True)] + [k.decode() for k in fresh]
            at = self._add(*self.encode(chunks))
            self.short.insert(a[new], b[new], np.arange(at, at + len(new), dtype=np.int32))
            for i, k in enumerate(fresh, at + len(new)):
                self.long[k] = i
                self.long_bytes += len(k)
            lost = np.flatnonzero((out < 0) & is_short)
            out[lost] = self.short.find(a[lost], b[lost])
            out[long_] = [self.long[k] for k in keys]
        return out

    def encoded(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For groups of neighbouring texts, in order: the codes of all and where each text's begin (one more number: the end). A null is an empty text."""
        for data, at in byte_groups(texts):
            n_bytes, raw = len(data), data.tobytes() + b"\0" * SHORT
            cuts = self.cuts(data, at[1:][at[1:] > at[:-1]] - 1) if n_bytes else np.zeros(0, bool)
            cuts[at[at < n_bytes]] = True
            starts = np.flatnonzero(cuts)
            sizes = np.diff(np.r_[starts, n_bytes])
            words = np.ndarray((n_bytes + 9,), "<u8", raw, strides=(1,))
            found, counts = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
            for i in range(0, len(starts), self.slice):
                numbers = self._numbers(raw, words, starts[i : i + self.slice], sizes[i : i + self.slice])
                n = self.count[numbers].astype(np.int64)
                found.append(self.pool[np.repeat(self.first[numbers] - (np.cumsum(n) - n), n) + np.arange(n.sum())])
                counts.append(n)
            ends = np.r_[0, np.cumsum(np.concatenate(counts))]
            yield np.concatenate(found), ends[np.searchsorted(starts, at)]


def byte_groups(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bytes, offsets) of neighbouring texts up to GROUP_BYTES together; a longer text alone."""
    if texts.null_count:
        texts = texts.fill_null("")
    if not len(texts):
        return
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64 if pa.types.is_large_string(texts.type) else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(at, at[i] + GROUP_BYTES, "right")) - 1)
        yield data[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


def grouped(texts: list[str]) -> Iterator[list[str]]:
    """Neighbouring texts up to GROUP_CHARS together; a longer text alone."""
    group, size = [], 0
    for t in texts:
        if group and size + len(t) > GROUP_CHARS:
            yield group
            group, size = [], 0
        group.append(t)
        size += len(t)
    if group:
        yield group
