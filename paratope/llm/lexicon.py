"""A minimal acyclic transducer: sorted words with their ids, in an automaton that shares prefixes and suffixes.

Each transition carries a number; the numbers along a word's path add up to its place in order, which
points at its ids. States lie in one comb of slots (a state's transition by byte b is in slot base + b, if
that slot is the state's own), so many words are followed at once, a byte of each at a time. The whole is
one file of plain arrays that workers map into memory and share.
"""

from __future__ import annotations

import struct

import numpy as np

MAGIC = b"lexicon1"
_FIELDS = ("base", "last", "owner", "target", "skipped", "first", "pool")


def minimal_states(words: list[bytes]) -> list[tuple[bool, bytes, tuple[int, ...]]]:
    """(final, labels, targets) of the states of the smallest automaton of sorted distinct words; targets come before their states, the start is the last."""
    known: dict[tuple, int] = {}
    path: list[tuple[bytearray, list[int]]] = [(bytearray(), [])]
    final = [False]
    before = b""

    def close(depth: int) -> None:
        while len(path) > depth + 1:
            labels, targets = path.pop()
            state = (final.pop(), bytes(labels), tuple(targets))
            path[-1][1].append(known.setdefault(state, len(known)))

    for word in words:
        if word <= before and (before or final[0]):
            raise ValueError("words must be sorted and distinct")
        same = 0
        while same < len(before) and same < len(word) and before[same] == word[same]:
            same += 1
        close(same)
        for b in word[same:]:
            path[-1][0].append(b)
            path.append((bytearray(), []))
            final.append(False)
        final[-1] = True
        before = word
    close(0)
    return [*known, (final[0], bytes(path[0][0]), tuple(path[0][1]))]


def _comb(states: list[tuple[bool, bytes, tuple[int, ...]]]) -> tuple[np.ndarray, np.ndarray]:
    """(base of each state, owner of each slot): no two transitions share a slot, and no base but a state's own finds it there."""
    total = sum(len(s[1]) for s in states)
    base = np.full(len(states), 256, np.int64)
    used = np.zeros(512 + 2 * total, bool)
    used[:256] = True  # so that no base is negative
    by_size = sorted(range(len(states)), key=lambda i: -len(states[i][1]))
    low = [256] * 257  # by number of labels: where the last such state was put
    for i in by_size:
        labels = np.frombuffer(states[i][1], np.uint8).astype(np.int64)
        if len(labels) < 2:
            break
        start = low[len(labels)] - int(labels[0])
        while True:
            bases = np.arange(start, start + 512)
            while bases[-1] + 256 > len(used):
                used = np.concatenate([used, np.zeros(len(used), bool)])
            free = np.flatnonzero(~used[bases[:, None] + labels].any(1))
            if len(free):
                break
            start += 512
        base[i] = bases[free[0]]
        used[base[i] + labels] = True
        low[len(labels)] = max(256, int(base[i] + labels[0]))
    single = [i for i in by_size if len(states[i][1]) == 1]
    free = np.flatnonzero(~used)
    while len(free) < len(single):
        used = np.concatenate([used, np.zeros(len(used), bool)])
        free = np.flatnonzero(~used)
    for i, slot in zip(single, free.tolist(), strict=False):
        base[i] = slot - states[i][1][0]
    owner = np.full(int(base.max()) + 257, -1, np.int32)
    for i, (_, labels, _) in enumerate(states):
        for b in labels:
            owner[base[i] + b] = i
    return base, owner


def compile_lexicon(words: list[bytes], ids: list[list[int]]) -> bytes:
    """The file of sorted distinct words and their ids."""
    states = minimal_states(words)
    counts = []  # of words that end below each state
    for final, _, targets in states:
        counts.append(final + sum(counts[t] for t in targets))
    base, owner = _comb(states)
    target, skipped = np.zeros(len(owner), np.int32), np.zeros(len(owner), np.int32)
    for i, (final, labels, targets) in enumerate(states):
        n = int(final)
        for b, t in zip(labels, targets, strict=True):
            target[base[i] + b], skipped[base[i] + b] = t, n
            n += counts[t]
    arrays = {
        "base": base.astype(np.int32), "last": np.array([s[0] for s in states], np.int32), "owner": owner, "target": target, "skipped": skipped,
        "first": np.cumsum([0, *map(len, ids)]).astype(np.int32), "pool": np.array([x for row in ids for x in row], np.int32),
    }
    sizes = [len(arrays[f]) for f in _FIELDS]
    return MAGIC + struct.pack(f"<{len(sizes)}q", *sizes) + b"".join(arrays[f].tobytes() for f in _FIELDS)


class Lexicon:
    def __init__(self, path: str):
        n = len(_FIELDS)
        with open(path, "rb") as f:
            head = f.read(len(MAGIC) + 8 * n)
        if head[: len(MAGIC)] != MAGIC:
            raise ValueError(f"{path} isn't a lexicon")
        sizes = struct.unpack(f"<{n}q", head[len(MAGIC) :])
        at = len(head)
        for name, size in zip(_FIELDS, sizes, strict=True):
            setattr(self, name, np.memmap(path, np.int32, "r", at, (size,)) if size else np.zeros(0, np.int32))
            at += 4 * size
        self.start = len(self.base) - 1

    def find(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The places of the words data[start : start + size] (size > 0) in order; -1 of those that the lexicon hasn't."""
        out = np.full(len(starts), -1, np.int64)
        base, owner, target, skipped, last = self.base, self.owner, self.target, self.skipped, self.last
        live, at = np.arange(len(starts)), starts.astype(np.int64)
        left = sizes.astype(np.int64)
        state, place = np.full(len(starts), self.start, np.int32), np.zeros(len(starts), np.int32)
        while len(live):
            slot = base[state] + data[at]
            on = np.flatnonzero(owner[slot] == state)
            slot, live, left = slot[on], live[on], left[on] - 1
            state, place, at = target[slot], place[on] + skipped[slot], at[on] + 1
            ended = left == 0
            done = np.flatnonzero(ended)
            if len(done):
                hit = done[last[state[done]] == 1]
                out[live[hit]] = place[hit]
                on = np.flatnonzero(~ended)
                live, left, state, place, at = live[on], left[on], state[on], place[on], at[on]
        return out
