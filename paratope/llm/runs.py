"""Runs: stretches of words that repeat with a period, at least twice.

Only words inside a window of LEAST / 2 words that comes again in the same stretch can lie in a run; the
rest is cut away first (see `stretches`). What remains of neighbouring texts is one sequence with separators,
and its runs come from the tandem repeats of it, as Gusfield and Stoye find them:

1. Blocks of the Lempel-Ziv decomposition, and common extensions around their borders, give tandem repeats
   that cover the leftmost occurrence of each kind.
2. Each is put at its place in the suffix tree, and walks along suffix links complete the vocabulary: from a
   repeat to its rotation by one word, as long as that occurs and isn't known.
3. A place of the tree holds all occurrences as leaves below it. Neighbouring ones of equal period merge to runs.

Tandem repeats whose half is a repetition itself are left out at step 1: they belong to a run of a smaller period.
The tree is that of a suffix array, sorted by doubling; the names of doubling also answer which stretches are equal.

Cases: null and empty texts have no words and no runs; texts are whole, of any length; repeated rows are
answered each; an empty table gives an empty result; only `key` columns are carried, whatever the others are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paratope.llm.chunks import byte_groups
from paratope.llm.common import WORD, let, ship

#: Words of the shortest run.
LEAST = 12
_U = np.uint64
_KEEP = np.array([(1 << 8 * n) - 1 for n in range(9)], _U)
_PAD = 16


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(31))) * _U(0xBF58476D1CE4E5B9)
    return h ^ (h >> _U(29))


def numbered(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Equal numbers for equal triples of 64-bit words and for no others, below their count."""
    if not len(a):
        return np.zeros(0, np.int64)
    h = _mix(_mix(_mix(a) + b) * _U(0x9E3779B97F4A7C15) + c)
    order = np.argsort(h, kind="stable")
    turns = lambda x: x[order[1:]] != x[order[:-1]]
    new = turns(a) | turns(b) | turns(c)
    if (new & ~turns(h)).any():  # unequal triples of one hash
        order = np.lexsort((c, b, a))
        new = turns(a) | turns(b) | turns(c)
    out = np.empty(len(a), np.int64)
    out[order] = np.cumsum(np.r_[False, new])
    return out


def words_of(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Where words begin and end in the bytes of texts, equal numbers for equal words, and how many words stand before each text."""
    inside = (data != 32) & ((data < 9) | (data > 13))
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cuts = at[(at > 0) & (at < len(data))]
    first[cuts] = inside[cuts]
    last[cuts - 1] = inside[cuts - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    sizes = ends - starts
    raw = data.tobytes() + b"\0" * _PAD
    words = np.ndarray((len(data) + 9,), "<u8", raw, strides=(1,))
    a = words[starts] & _KEEP[np.minimum(sizes, 8)]
    b = words[starts + 8] & _KEEP[np.clip(sizes - 8, 0, 8)]
    seen: dict[bytes, int] = {}
    for i in np.flatnonzero(sizes > _PAD).tolist():
        a[i], b[i] = seen.setdefault(raw[starts[i] : ends[i]], len(seen)), 0
    return starts, ends, numbered(a, b, sizes.astype(_U)), np.searchsorted(starts, at)


def stretches(words: np.ndarray, owner: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, end) of stretches that hold all runs of at least `least` words.

    A run of period q is a block of length - q words that comes again q words later, and these two cover it. A
    block has least / 2 words or more, so each word of a run lies in a window of that many that comes twice, and
    between the two all words lie in the run. So words without such a window, within their text first and then
    within what is left of it around them, lie in no run. A hash that two windows share leaves too much, never too little.
    """
    size = (least + 1) // 2
    n = len(words)
    left, group = np.arange(n), owner
    while len(left):
        m = len(left)
        begins = np.r_[True, (group[1:] != group[:-1])]
        number = np.cumsum(begins)
        if m < size:
            left = left[:0]
            break
        h = np.zeros(m - size + 1, _U)
        for i in range(size):
            h = _mix(h * _U(0x9E3779B97F4A7C15) + words[left[i : m - size + 1 + i]].astype(_U))
        h = _mix(h + number[: m - size + 1].astype(_U) * _U(0xD6E8FEB86659FD93))
        fits = number[: m - size + 1] == number[size - 1 :]
        places = np.flatnonzero(fits)
        order = places[np.argsort(h[places])]
        same = h[order[1:]] == h[order[:-1]]
        twice = order[np.r_[False, same] | np.r_[same, False]]
        change = np.zeros(m + 1, np.int64)
        np.add.at(change, twice, 1)
        np.add.at(change, twice + size, -1)
        covered = np.cumsum(change)[:m] > 0
        if covered.all():
            break
        # neighbours stay together only where nothing between them is lost
        kept = np.flatnonzero(covered)
        parts = np.cumsum(np.r_[True, (kept[1:] != kept[:-1] + 1) | (number[kept[1:]] != number[kept[:-1]])]) if len(kept) else kept
        left, group = left[kept], parts
    if not len(left):
        return left, left
    edges = np.r_[True, group[1:] != group[:-1]]
    return left[edges], left[np.r_[edges[1:], True]] + 1


class Doubled:
    """Names of all stretches of 1, 2, 4, ... words of a sequence: equal ones have equal names, in their order. Its first and its last word must be in it once only."""

    def __init__(self, words: np.ndarray):
        n = self.n = len(words)
        self.names = [np.unique(words, return_inverse=True)[1].astype(np.int32)]
        while (name := self.names[-1]).max() < n - 1:
            step = 1 << (len(self.names) - 1)
            after = np.zeros(n, np.int64)
            after[: n - step] = name[step:].astype(np.int64) + 1
            self.names.append(np.unique(name * np.int64(n + 1) + after, return_inverse=True)[1].astype(np.int32))
        self.rank = self.names[-1]
        self.order = np.empty(n, np.int32)
        self.order[self.rank] = np.arange(n, dtype=np.int32)

    def ahead(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words from i on equal those from j on (i != j)."""
        out = np.zeros(len(i), np.int64)
        for k in range(len(self.names) - 1, -1, -1):
            name = self.names[k]
            out += (name[i + out] == name[j + out]).astype(np.int64) << k
        return out

    def behind(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words up to i equal those up to j (i != j)."""
        out = np.zeros(len(i), np.int64)
        for k in range(len(self.names) - 1, -1, -1):
            name, a, b = self.names[k], i - out - (1 << k) + 1, j - out - (1 << k) + 1
            fits = (a >= 0) & (b >= 0)
            out += (fits & (name[np.maximum(a, 0)] == name[np.maximum(b, 0)])).astype(np.int64) << k
        return out

    def equal(self, i: np.ndarray, j: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether `size` words from i and from j are equal; size > 0."""
        level = np.minimum(np.frexp(size.astype(np.float64))[1] - 1, len(self.names) - 1)
        out = np.zeros(len(i), bool)
        for k in np.unique(level).tolist():
            at = np.flatnonzero(level == k)
            name, end = self.names[k], size[at] - (1 << k)
            out[at] = (name[i[at]] == name[j[at]]) & (name[i[at] + end] == name[j[at] + end]) & (end <= 1 << k)
        return out


def blocks(doubled: Doubled, common: np.ndarray) -> np.ndarray:
    """Where the blocks of the Lempel-Ziv decomposition begin: each is the longest stretch that also begins earlier, or one word. common: of neighbours in order."""
    n = doubled.n
    rank = doubled.rank.tolist()
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    lcp = [*common.tolist(), 0]
    longest = [0] * n
    for i in range(n - 1, -1, -1):  # the neighbours still linked begin earlier
        r = rank[i]
        a, b, up, down = before[r], after[r], lcp[r], lcp[after[r]]
        longest[i] = max(up, down)
        if a >= 0:
            after[a] = b
        if b < n:
            before[b] = a
        lcp[b] = min(up, down)
    starts, i = [], 0
    while i < n:
        starts.append(i)
        i += longest[i] or 1
    return np.array(starts)


def _counted(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For counts: whose each is, and its number from 1 on."""
    whose = np.repeat(np.arange(len(n)), n)
    return whose, np.arange(len(whose)) - np.repeat(np.cumsum(n) - n, n) + 1


def leftmost_repeats(doubled: Doubled, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(begin, half) of tandem repeats that cover the leftmost occurrence of each kind with a primitive half."""
    n, ends = doubled.n, np.r_[starts[1:], doubled.n]
    sizes = ends - starts
    found = []
    # around a block's end: the second half begins in it
    b, k = _counted(np.where(ends < n, sizes, 0))
    right = ends[b]
    q = right - k
    on = q > 0
    right, q, k = right[on], q[on], k[on]
    f = doubled.ahead(right, q)
    g = doubled.behind(right - 1, q - 1)
    ok = (f + g >= k) & (f > 0)
    found.append((np.maximum(q - g, q - k + 1)[ok], k[ok]))
    # around its begin
    b, k = _counted(sizes + np.r_[sizes[1:], 0])
    left = starts[b]
    q = left + k
    on = (left > 0) & (q < n)
    b, left, q, k = b[on], left[on], q[on], k[on]
    f = doubled.ahead(left, q)
    g = doubled.behind(left - 1, q - 1)
    begin = np.maximum(left - g, left - k + 1)
    ok = (f + g >= k) & (f > 0) & (g > 0) & (begin + k <= ends[b])
    found.append((begin[ok], k[ok]))
    begin, half = (np.concatenate(x) for x in zip(*found, strict=True))
    if not len(begin):
        return begin, half
    key = np.unique(half * np.int64(n) + begin)
    half, begin = key // n, key % n
    return tuple(x[_primitive(doubled, begin, half)] for x in (begin, half))


def _primitive(doubled: Doubled, begin: np.ndarray, half: np.ndarray) -> np.ndarray:
    """Whether the half of a tandem repeat isn't a repetition itself: for no prime p that divides it has it the period half / p."""
    out = np.ones(len(half), bool)
    rest = half.copy()
    p = 2
    while (rest > 1).any():
        if p * p > rest.max():
            primes = rest
        else:
            primes = np.where(rest % p == 0, p, np.where(p * p > rest, rest, 1))
        at = np.flatnonzero(primes > 1)
        step = half[at] // primes[at]
        out[at] &= ~doubled.equal(begin[at], begin[at] + step, half[at] - step)
        while (again := (rest % primes == 0) & (primes > 1)).any():
            rest = np.where(again, rest // primes, rest)
        p += 1
    return out


class SuffixTree:
    """Nodes: leaves by their rank, then inner nodes. depth in words, parent, and the leaves lo to hi - 1 below each."""

    def __init__(self, doubled: Doubled, words: np.ndarray, common: np.ndarray):
        n = doubled.n
        self.words = words
        depth, parent, lo, hi = [0] * n, [0] * n, list(range(n)), list(range(1, n + 1))
        depth[:] = (n - doubled.order).tolist()
        depth.append(0)
        parent.append(n)
        lo.append(0)
        hi.append(n)
        stack = [n]  # the path of inner nodes down to the last leaf
        for r, c in enumerate([*common[1:].tolist(), 0]):
            below = r
            while depth[stack[-1]] > c:
                node = stack.pop()
                parent[below], hi[node] = node, r + 1
                below = node
            if depth[stack[-1]] < c:
                node = len(depth)
                depth.append(c)
                parent.append(0)
                lo.append(lo[below])
                hi.append(0)
                stack.append(node)
            parent[below] = stack[-1]
        self.root, self.depth, self.parent, self.lo, self.hi = n, *(np.array(x, np.int64) for x in (depth, parent, lo, hi))
        self.rank, self.first = doubled.rank, doubled.order[self.lo].astype(np.int64)
        self.ups = [self.parent]
        while (self.ups[-1] != self.root).any():
            self.ups.append(self.ups[-1][self.ups[-1]])
        inner = np.arange(n, len(depth))
        link = np.full(len(depth), self.root)
        deep = inner[self.depth[inner] > 0]
        link[deep] = self.place(self.first[deep] + 1, self.depth[deep] - 1)
        self.link = link

    def place(self, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The highest node whose path begins with the `size` words from begin on."""
        node = self.rank[begin].astype(np.int64)
        for up in reversed(self.ups):
            above = up[node]
            node = np.where(self.depth[above] >= size, above, node)
        return node

    def rotations(self, nodes: np.ndarray, halves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All (node, half) of the vocabulary that walks from these reach."""
        words, first, depth, parent, link = (x.tolist() for x in (self.words, self.first, self.depth, self.parent, self.link))
        many = int(self.words.max()) + 1
        below = np.flatnonzero(np.arange(len(depth)) != self.root)
        next_word = self.words[self.first[below] + self.depth[self.parent[below]]]
        child = dict(zip((self.parent[below] * many + next_word).tolist(), below.tolist(), strict=True))
        n, known = len(depth), set()
        for node, half in zip(nodes.tolist(), halves.tolist(), strict=True):
            size = 2 * half
            while (key := half * n + node) not in known:
                known.add(key)
                i = first[node]
                at = link[parent[node]]
                while depth[at] < size - 1:  # down to where the repeat without its first word ends
                    at = child[at * many + words[i + 1 + depth[at]]]
                if depth[at] > size - 1:
                    if words[first[at] + size - 1] != words[i]:
                        break
                else:
                    at = child.get(at * many + words[i])
                    if at is None:
                        break
                node = at
        keys = np.fromiter(known, np.int64, len(known))
        return keys % n, keys // n


def runs_of(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs of a sequence of numbers >= 0 whose first and last word are in it once only."""
    doubled = Doubled(words)
    words = doubled.names[0].astype(np.int64)
    order = doubled.order.astype(np.int64)
    common = np.r_[0, doubled.ahead(order[:-1], order[1:])]
    begin, half = leftmost_repeats(doubled, blocks(doubled, common))
    if not len(begin):
        return begin, begin, begin
    tree = SuffixTree(doubled, words, common)
    node, half = tree.rotations(tree.place(begin, 2 * half), half)
    of, k = _counted(tree.hi[node] - tree.lo[node])
    spot = np.sort(half[of] * doubled.n + order[tree.lo[node][of] + k - 1])
    edge = np.flatnonzero(np.r_[True, spot[1:] != spot[:-1] + 1])
    last = np.r_[edge[1:], len(spot)] - 1
    period, start = spot[edge] // doubled.n, spot[edge] % doubled.n
    return start, spot[last] - spot[edge] + 2 * period, period


def find_runs(words: np.ndarray, owner: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period), by start and period, of the runs of at least `least` words; owner numbers the text of each word, in order."""
    first, end = stretches(words, owner, least)
    if not len(first):
        return first, first, first
    sizes = end - first
    # a separator before each stretch and one at the end
    whose, k = _counted(sizes)
    top = int(words.max()) + 1
    joined = np.empty(int(sizes.sum()) + len(sizes) + 1, np.int64)
    shift = np.cumsum(sizes + 1) - sizes - 1  # of the separators
    joined[shift] = top + np.arange(len(sizes))
    joined[-1] = top + len(sizes)
    joined[shift[whose] + k] = words[first[whose] + k - 1]
    start, length, period = runs_of(joined)
    on = length >= np.maximum(least, 2 * period)
    start, length, period = start[on], length[on], period[on]
    part = np.searchsorted(shift, start, "right") - 1
    start = first[part] + start - shift[part] - 1
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def collapsed_bytes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, kept: np.ndarray, before: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The kept words of each text joined by single spaces: bytes of all, and where each text's begin."""
    words = np.flatnonzero(kept)
    change = np.zeros(len(data) + 1, np.int8)
    change[starts[words]] += 1
    change[ends[words]] -= 1
    mask = np.cumsum(change[:-1], dtype=np.int8) > 0
    text = np.searchsorted(before, words, "right") - 1
    inner = words[:-1][text[1:] == text[:-1]]  # another kept word of the text follows, so white space does
    out = data.copy()
    mask[ends[inner]] = True
    out[ends[inner]] = 32
    return out[mask], np.r_[0, np.cumsum(mask)][at]


OUTPUTS = {
    "n_words": "long", "n_runs": "long", "start": "long", "length": "long", "period": "long", "exponent_milli": "long",
    "runs": "array<struct<start:bigint,length:bigint,period:bigint>>", "runs_sha256": "string", "collapsed": "string", "collapsed_sha256": "string",
}


def _answers(data: np.ndarray, at: np.ndarray, outputs: tuple[str, ...], least: int) -> list[pa.Array]:
    starts, ends, words, before = words_of(data, at)
    n_texts, n = len(at) - 1, len(starts)
    owner = np.repeat(np.arange(n_texts), np.diff(before))
    start, length, period = find_runs(words, owner, least)
    text = owner[start] if len(start) else start
    own = start - before[text]
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, start + period, 1)
    np.add.at(change, start + length, -1)
    kept = np.cumsum(change)[:n] == 0
    best = np.lexsort((period, own, -length, text))
    head = best[np.r_[True, text[best][1:] != text[best][:-1]]] if len(best) else best
    has = np.zeros(n_texts, bool)
    has[text[head]] = True

    def of_best(values: np.ndarray) -> pa.Array:
        out = np.zeros(n_texts, np.int64)
        out[text[head]] = values[head]
        return pa.array(out, mask=~has)

    sha = lambda b: hashlib.sha256(b).hexdigest()
    edges = np.searchsorted(text, np.arange(n_texts + 1))

    def listed() -> Iterator[bytes]:
        lines = [b"%d,%d,%d\n" % r for r in zip(own.tolist(), length.tolist(), period.tolist(), strict=True)]
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            yield b"".join(lines[a:b])

    def collapsed() -> Iterator[bytes]:
        out, cuts = collapsed_bytes(data, starts, ends, kept, before, at)
        raw = out.tobytes()
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            yield raw[a:b]

    structs = lambda: pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (own, length, period)], ["start", "length", "period"])
    made = {
        "n_words": lambda: pa.array(np.diff(before).astype(np.int64)),
        "n_runs": lambda: pa.array(np.diff(edges).astype(np.int64)),
        "start": lambda: of_best(own),
        "length": lambda: of_best(length),
        "period": lambda: of_best(period),
        "exponent_milli": lambda: of_best(1000 * length // np.maximum(period, 1)),
        "runs": lambda: pa.ListArray.from_arrays(pa.array(edges, pa.int32()), structs()),
        "runs_sha256": lambda: pa.array([sha(b) for b in listed()], pa.string()),
        "collapsed": lambda: pa.array([b.decode() for b in collapsed()], pa.string()),
        "collapsed_sha256": lambda: pa.array([sha(b) for b in collapsed()], pa.string()),
    }
    return [made[o]() for o in outputs]


def repeat_runs(documents: DataFrame, keys: tuple[str, ...] = ("doc_id",), outputs: tuple[str, ...] = ("n_runs", "runs", "collapsed"), least: int = LEAST) -> DataFrame:
    """The key columns and the wanted OUTPUTS of each row's text. start to exponent_milli are those of the longest run; collapsed keeps the first period of each run."""
    ship(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for data, at in byte_groups(batch.column(len(keys))):
                n = len(at) - 1
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(done, n) for i in range(len(keys))), *_answers(data, at, outputs, least)], names=[*keys, *outputs])
                done += n

    chosen = documents.select(*keys, F.col("text").cast("string").alias("text"))
    fields = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1]] + [f"{o} {OUTPUTS[o]}" for o in outputs])
    return chosen.mapInArrow(run, fields)


def planted(text: Column, doc_id: Column) -> Column:
    """The text of every tenth document, by a checksum of its id, made periodic from some word on; other texts as they are, and those without an id."""
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10)

    def periodic(words: Column) -> Column:
        n = F.size(words)
        a = F.pmod(g, n)
        p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))
        # a and p are taken once, not for each word
        spread = let(F.struct(a.cast("int").alias("a"), p.cast("int").alias("p")), lambda v: F.transform(words, lambda w, i: F.when(i < v["a"], w).otherwise(F.get(words, v["a"] + F.pmod(i - v["a"], v["p"])))))
        return F.when(n > 0, F.array_join(spread, " "))

    words = F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))
    return F.when(F.pmod(h, F.lit(10)) == 0, F.coalesce(let(words, periodic), text)).otherwise(text)
