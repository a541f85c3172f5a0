"""Near-duplicate documents: MinHash bands, odd sketches and exact confirmation.

1. One pass over the texts gives each document's set of distinct five-word shingles (64-bit hashes), its
   size and a 128-bit hash of the set, MinHash samples folded into band keys of ROWS samples each, and an
   odd sketch: a parity bitmap in which each of the first BANDS * ROWS samples flips one bit.
2. Documents with equal sets form a class; one representative goes on.
3. Representatives that share a band key form a bucket. Each member is paired with the bucket's hub
   (the least id under one of HUBS orders), never with all others.
4. The XOR population count of two odd sketches estimates their similarity; pairs far below the threshold
   go. The others are confirmed on full sets, which are computed again for documents in pairs only.
5. Buckets that still hold members of several components are done in full: small ones by pairs of members
   of different components, large ones in blocks of BLOCK members, where a task confirms a block against
   another and puts out a spanning forest of the links, at most 2 * BLOCK rows. Blocks are cut in the
   order of components, and two blocks of one and the same component aren't compared.
6. Components by alternating large and small stars, each round a table in the shared folder.

The threshold is a parameter, `percent`: LEVEL (85) for op1_near_dedup, STAGE_LEVEL (80) for dropping documents.
The bands follow from it, 30 at 85 and 45 at 80, so that a pair at the threshold escapes all of them with
probability (1 - 0.85^5)^30 or (1 - 0.8^5)^45, 2e-8 both, and the sketch with less.

Cases: null texts and texts without words have the empty set and are linked with nothing; fewer than five
words are one shingle; a row without doc_id is linked with nothing, has no component and is kept; rows that
repeat a doc_id are each judged by their own text; an empty table gives an empty result; extra columns are
ignored; texts are whole, of any length.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paratope.llm.chunks import grouped
from paratope.llm.common import finished, materialize, ship, worker_cache, written

WORDS = 5
#: Links need LEVEL[0] * intersection >= LEVEL[1] * union.
LEVEL = (100, 85)
#: The percentage at which the pipeline's stage and other callers of drop_near_duplicates link documents.
STAGE_LEVEL = 80
BANDS, ROWS = 30, 5
#: The probability, at most, that a pair at the threshold shares no band key.
ESCAPE = 2.5e-8
SKETCH_BITS = 512
#: Pairs whose estimated similarity is below the threshold by so many standard deviations of the estimate aren't confirmed.
DEVIATIONS = 7
HUBS = 4
SMALL_BUCKET = 32
BLOCK = 400
SLICE = 1 << 20

_U = np.uint64
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.int64).astype(_U) * _U(2) + _U(1)
_SPACES = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE_LOWER = _BYTE[_LOWER]
_BASE = _U(0x9E3779B97F4A7C15)
_INVERSE = _U(pow(int(_BASE), -1, 2**64))
_PLACE = _rng.integers(1, 2**63, WORDS, dtype=np.int64).astype(_U) * _U(2) + _U(1)
_COUNT, _KEY1, _KEY2 = (_U(int(x)) for x in _rng.integers(1, 2**63, 3))
_HUB_ORDERS = [int(x) for x in _rng.integers(0, 2**62, HUBS)]


def bands_for(percent: int) -> int:
    """The bands that a pair at the threshold escapes with probability ESCAPE at most."""
    return math.ceil(math.log(ESCAPE) / math.log1p(-((percent / 100) ** ROWS)))


@cache
def _band(i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Multipliers and addends of a band's samples, and the weights that fold them into its key."""
    rng = np.random.default_rng([20240229, i])
    multipliers = rng.integers(0, 2**31, ROWS, dtype=np.int64).astype(np.uint32) * np.uint32(2) + np.uint32(1)
    return multipliers, rng.integers(0, 2**32, ROWS, dtype=np.int64).astype(np.uint32), rng.integers(1, 2**63, ROWS, dtype=np.int64).astype(_U) * _U(2) + _U(1)


def most_flips(percent: int) -> int:
    """Odd sketches of a pair at the threshold differ in more bits with negligible probability: DEVIATIONS of the estimate 1 + bits / (4 k) * ln(1 - 2 x / bits)."""
    k, level = BANDS * ROWS, percent / 100
    flips = 2 * k * (1 - level)  # expected; some fall on one bit
    same = math.exp(-4 * flips / SKETCH_BITS)
    noise = math.sqrt(max(0.0, SKETCH_BITS / 4 * (1 - same) - flips * same)) / (2 * k * math.sqrt(same))
    least = max(0.0, level - DEVIATIONS * math.hypot(math.sqrt(level * (1 - level) / k), noise))
    return int(SKETCH_BITS / 2 * (1 - math.exp((least - 1) * 4 * k / SKETCH_BITS)))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(n: int, base: np.uint64) -> np.ndarray:
    out = np.full(n, base, _U)
    out[:1] = 1
    return np.cumprod(out, dtype=_U)


class _Words:
    """Hashes of the words of byte strings, slice by slice."""

    up = _powers(SLICE, _BASE)
    down = _powers(SLICE, _INVERSE)

    @classmethod
    def hashes(cls, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(hash, start) of each word of data, A-Z in lower case."""
        found, at = [], 0
        while at < len(data):
            end = min(len(data), at + SLICE)
            if end < len(data):
                gaps = np.flatnonzero(_SPACES[data[at:end]])
                while not len(gaps) and end < len(data):
                    end = min(len(data), end + SLICE)
                    gaps = np.flatnonzero(_SPACES[data[at:end]])
                end = at + int(gaps[-1]) + 1 if len(gaps) and end < len(data) else end
            found.append(cls._slice(data[at:end], at))
            at = end
        if not found:
            return np.zeros(0, _U), np.zeros(0, np.int64)
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])

    @classmethod
    def _slice(cls, data: np.ndarray, offset: int) -> tuple[np.ndarray, np.ndarray]:
        if len(data) > len(cls.up):
            up, down = _powers(len(data), _BASE), _powers(len(data), _INVERSE)
        else:
            up, down = cls.up, cls.down
        in_word = np.zeros(len(data) + 2, np.int8)
        in_word[1:-1] = ~_SPACES[data]
        edge = np.diff(in_word)
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        sums = np.zeros(len(data) + 1, _U)
        np.cumsum(_BYTE_LOWER[data] * up[: len(data)], out=sums[1:])
        return _mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(_U) * _COUNT), starts + offset


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    words, starts = _Words.hashes(data)
    first = np.searchsorted(starts, np.r_[0, np.cumsum(sizes)])
    n = max(0, len(words) - WORDS + 1)
    windows = np.zeros(n, _U)
    for j in range(WORDS):
        windows += words[j : j + n] * _PLACE[j]
    windows = _mix(windows + np.array([WORDS], _U) * _KEY1)
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= WORDS:
            s = np.sort(windows[a : b - WORDS + 1])
            out.append(s[np.r_[True, s[1:] != s[:-1]]])
        elif b > a:
            total = (words[a:b] * _PLACE[: b - a]).sum(keepdims=True, dtype=_U) + np.array([b - a], _U) * _KEY1
            out.append(_mix(total))
        else:
            out.append(np.zeros(0, _U))
    return out


def signatures(sets: list[np.ndarray], bands: int = BANDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(2, n) set hashes, (bands, n) band keys and (words, n) odd sketches of sets that aren't empty."""
    flat = np.concatenate(sets)
    at = np.cumsum([0, *(len(s) for s in sets[:-1])])
    both = np.stack([np.add.reduceat(_mix(flat ^ _KEY1), at), np.add.reduceat(_mix(flat ^ _KEY2), at)])
    small = (flat >> _U(32)).astype(np.uint32)
    keys = np.zeros((bands, len(sets)), _U)
    bits = np.zeros((len(sets), SKETCH_BITS), np.uint8)
    row = np.arange(len(sets))
    for i in range(max(bands, BANDS) * ROWS):
        multipliers, addends, weights = _band(i // ROWS)
        least = np.minimum.reduceat(small * multipliers[i % ROWS] + addends[i % ROWS], at).astype(_U)
        if i < bands * ROWS:
            keys[i // ROWS] += _mix(least + _U(1)) * weights[i % ROWS]
        if i < BANDS * ROWS:
            bits[row, (_mix(least + _U(i << 32)) % _U(SKETCH_BITS)).astype(np.int64)] ^= 1
    keys = _mix(keys + np.arange(bands, dtype=_U)[:, None] * _BASE)
    sketch = np.packbits(bits, axis=1).view(np.int64)
    return both, keys, np.ascontiguousarray(sketch.T)


SKETCH = [f"s{i}" for i in range(SKETCH_BITS // 64)]


def _signer(n_bands: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("near")
        for batch in batches:
            ids, texts, at = batch.column(0), [t or "" for t in batch.column(1).to_pylist()], 0
            for group in grouped(texts):
                sets = shingle_sets([t.encode() for t in group])
                full = [i for i, s in enumerate(sets) if len(s)]
                n = len(group)
                h, keys, sketch = np.zeros((2, n), np.int64), np.zeros((n_bands, n), np.int64), np.zeros((len(SKETCH), n), np.int64)
                if full:
                    a, b, c = signatures([sets[i] for i in full], n_bands)
                    h[:, full], keys[:, full], sketch[:, full] = a.view(np.int64), b.view(np.int64), c
                bands = pa.ListArray.from_arrays(pa.array(np.arange(0, n * n_bands + 1, n_bands), pa.int32()), pa.array(np.ascontiguousarray(keys.T).ravel()))
                sizes = pa.array(np.array([len(s) for s in sets], np.int64))
                yield pa.RecordBatch.from_arrays([ids.slice(at, n), sizes, pa.array(h[0]), pa.array(h[1]), bands, *(pa.array(s) for s in sketch)], names=["id", "n", "h1", "h2", "bands", *SKETCH])
                at += n

    return run


def sign(documents: DataFrame, n_bands: int = BANDS) -> DataFrame:
    fields = "id long, n long, h1 long, h2 long, bands array<long>, " + ", ".join(f"{s} long" for s in SKETCH)
    return documents.select(F.col("doc_id").cast("long").alias("id"), "text").mapInArrow(_signer(n_bands), fields)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    worker_cache("near")
    for batch in batches:
        ids, texts, at = batch.column(0), [t or "" for t in batch.column(1).to_pylist()], 0
        for group in grouped(texts):
            sets = shingle_sets([t.encode() for t in group])
            offsets = np.cumsum([0, *map(len, sets)])
            values = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(sets).view(np.int64)))
            yield pa.RecordBatch.from_arrays([ids.slice(at, len(group)), values], names=["id", "shingles"])
            at += len(group)


def similar_enough(a: str, b: str, percent: int) -> Column:
    """The pair's sizes and odd sketches allow a link."""
    flips = sum((F.bit_count(F.col(f"{a}.{s}").bitwiseXOR(F.col(f"{b}.{s}"))) for s in SKETCH[1:]), F.bit_count(F.col(f"{a}.{SKETCH[0]}").bitwiseXOR(F.col(f"{b}.{SKETCH[0]}"))))
    low, high = F.least(f"{a}.n", f"{b}.n"), F.greatest(f"{a}.n", f"{b}.n")
    return (100 * low >= percent * high) & (flips <= most_flips(percent))


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    x, y = sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), sets.select(F.col("id").alias("b"), F.col("shingles").alias("y"))
    both = F.size(F.array_intersect("x", "y")).cast("long")
    union = F.size("x") + F.size("y") - both
    return pairs.join(x, "a").join(y, "b").filter(100 * both >= percent * union).select("a", "b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(id, root): the least id of each linked id's component, by alternating stars until nothing changes."""
    mark = written()
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    edges, before = materialize(edges, "near-edges"), None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        edges = finished(small, "near-edges", mark)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("root"))
        before = now


def _block_links(table: pa.Table, percent: int = LEVEL[1]) -> pa.Table:
    """Within a pair of blocks: a spanning forest of the confirmed links between different components."""
    ids = table.column("id").to_numpy()
    side = table.column("side").to_numpy()
    roots = {r: i for i, r in enumerate(dict.fromkeys(table.column("root").to_pylist()))}
    label = np.array([roots[r] for r in table.column("root").to_pylist()])
    sets = [np.asarray(s.values) for s in table.column("shingles").combine_chunks()] if table.num_rows else []
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    parent = list(range(len(roots)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    order = np.unique(np.concatenate(sets), return_inverse=True)[1] if n else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(n), sizes)
    by_value = np.argsort(order, kind="stable")
    cuts = np.r_[0, np.cumsum(np.bincount(order))] if n else np.zeros(1, np.int64)
    at = np.r_[0, np.cumsum(sizes)]
    found_a, found_b = [], []
    for i in range(n):
        values = order[at[i] : at[i + 1]]
        holders = owner[by_value[_ranges(cuts[values], cuts[values + 1])]]
        common = np.bincount(holders, minlength=n)
        near = np.flatnonzero(100 * common >= percent * (sizes + sizes[i] - common))
        for j in near[near > i]:
            a, b = find(label[i]), find(label[j])
            if a != b and (side[i] != side[j] or side[i] == 2):
                parent[a] = b
                found_a.append(int(ids[i]))
                found_b.append(int(ids[j]))
    return pa.table({"a": pa.array(found_a, pa.int64()), "b": pa.array(found_b, pa.int64())})


def _ranges(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    lengths = ends - starts
    return np.repeat(starts - np.r_[0, np.cumsum(lengths)[:-1]], lengths) + np.arange(lengths.sum())


def _blocks(members: DataFrame) -> DataFrame:
    """members(key, id, root) with `block`: BLOCK neighbours of a bucket in the order of components. Ranges of (key, root, id) are numbered each on its own and then moved on by the counts before them, so that a large bucket spreads over many tasks."""
    ranged = materialize(members.repartitionByRange("key", "root", "id").withColumn("part", F.spark_partition_id()), "near-ranges")
    inner = F.row_number().over(Window.partitionBy("key", "part").orderBy("root", "id")) - 1
    before = F.sum("n").over(Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # a row a range
    starts = ranged.groupBy("key", "part").agg(F.count(F.lit(1)).alias("n")).select("key", "part", F.coalesce(before, F.lit(0)).alias("start"))
    placed = ranged.withColumn("inner", inner).join(starts, ["key", "part"])
    return placed.withColumn("block", F.floor((F.col("start") + F.col("inner")) / BLOCK).cast("int")).drop("part", "inner", "start")


def _left_over(members: DataFrame, nodes: DataFrame, found: DataFrame, tried: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between components that share a bucket: (a, b)."""
    named = members.join(found, "id", "left").select("key", "id", F.coalesce("root", "id").alias("root"))
    mixed = named.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("size")).filter("lo <> hi AND size > 2").select("key", "size")
    open_ = materialize(named.join(mixed, "key"), "near-open")
    if open_.isEmpty():
        return open_.select(F.col("id").alias("a"), F.col("id").alias("b"))
    few = open_.filter(F.col("size") <= SMALL_BUCKET)
    pairs = few.alias("p").join(few.alias("q"), (F.col("p.key") == F.col("q.key")) & (F.col("p.id") < F.col("q.id")) & (F.col("p.root") != F.col("q.root"))).select(F.col("p.id").alias("a"), F.col("q.id").alias("b")).distinct()
    likely = pairs.join(tried, ["a", "b"], "left_anti").join(nodes.withColumnRenamed("id", "a").alias("p"), "a").join(nodes.withColumnRenamed("id", "b").alias("q"), "b").filter(similar_enough("p", "q", percent)).select("a", "b")
    links = confirmed(likely, sets, percent)

    many = open_.filter(F.col("size") > SMALL_BUCKET)
    cut = materialize(_blocks(many), "near-blocks")
    if cut.isEmpty():
        return links
    spans = cut.groupBy("key", "block").agg(F.min("root").alias("lo"), F.max("root").alias("hi"))
    p, q = spans.alias("p"), spans.alias("q")
    apart = p.join(q, (F.col("p.key") == F.col("q.key")) & (F.col("p.block") <= F.col("q.block")) & ~((F.col("p.lo") == F.col("q.hi")) & (F.col("p.hi") == F.col("q.lo")) & (F.col("p.lo") == F.col("p.hi"))))
    tasks = apart.select(F.col("p.key").alias("key"), F.col("p.block").alias("i"), F.col("q.block").alias("j"))
    sides = tasks.select("key", "i", "j", F.explode(F.when(F.col("i") == F.col("j"), F.array(F.struct(F.col("i").alias("block"), F.lit(2).alias("side")))).otherwise(F.array(F.struct(F.col("i").alias("block"), F.lit(0).alias("side")), F.struct(F.col("j").alias("block"), F.lit(1).alias("side"))))).alias("s"))
    dealt = sides.select("key", "i", "j", "s.block", "s.side").join(cut.select("key", "block", "id", "root"), ["key", "block"]).join(sets, "id")
    return links.unionByName(dealt.select("key", "i", "j", "side", "id", "root", "shingles").groupBy("key", "i", "j").applyInArrow(lambda part: _block_links(part, percent), "a long, b long"))


def near_duplicates(documents: DataFrame, percent: int = LEVEL[1]) -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id, kept. Documents of a similarity of `percent` hundredths or more are linked."""
    ship(documents.sparkSession)
    mark = written()
    signed = materialize(sign(documents, bands_for(percent)), "near-signed")
    full = signed.filter("n > 0 AND id IS NOT NULL")
    classes = materialize(full.groupBy("h1", "h2", "n").agg(F.min("id").alias("rep")), "near-classes")
    reps = full.join(classes.withColumnRenamed("rep", "id"), ["h1", "h2", "n", "id"]).dropDuplicates(["id", "h1", "h2"])
    reps = materialize(reps.select("id", "n", "bands", *SKETCH), "near-reps")
    nodes = reps.select("id", "n", *SKETCH)

    keyed = reps.select("id", F.posexplode("bands").alias("band", "key"))
    order = F.element_at(F.array(*map(F.lit, _HUB_ORDERS)), (F.col("band") % HUBS + 1).cast("int"))  # XOR by a constant permutes the ids and is its own inverse
    hubs = keyed.groupBy("key").agg(F.min(F.col("id").bitwiseXOR(order)).alias("least"), F.first(order).alias("order"), F.count(F.lit(1)).alias("size")).filter("size > 1")
    hubs = hubs.select("key", F.col("least").bitwiseXOR(F.col("order")).alias("hub"))
    members = materialize(keyed.select("id", "key").join(hubs, "key"), "near-members")
    pairs = members.filter("id <> hub").select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct()
    likely = pairs.join(nodes.withColumnRenamed("id", "a").alias("p"), "a").join(nodes.withColumnRenamed("id", "b").alias("q"), "b").filter(similar_enough("p", "q", percent)).select("a", "b")
    tried = materialize(likely, "near-pairs")

    wanted = members.select("id").distinct()
    texts = documents.select(F.col("doc_id").cast("long").alias("id"), "text").join(wanted.hint("shuffle_hash"), "id", "left_semi")
    sets = materialize(texts.mapInArrow(_sets, "id long, shingles array<long>"), "near-sets", "lz4")

    links = materialize(confirmed(tried, sets, percent), "near-links")
    found = components(links)
    more = materialize(_left_over(members.select("key", "id"), nodes, found, tried, sets, percent), "near-more")
    if not more.isEmpty():
        found = components(links.unionByName(more))
    rows = signed.select("id", "n", "h1", "h2").join(classes, ["h1", "h2", "n"], "left")
    rooted = rows.join(found.select(F.col("id").alias("rep"), "root"), "rep", "left")
    component = F.when(F.col("n") > 0, F.coalesce("root", "rep", "id")).otherwise(F.col("id"))
    final = rooted.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), component).alias("component_id"))
    return finished(final.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))), "near-result", mark)


def drop_near_duplicates(documents: DataFrame, percent: int = STAGE_LEVEL) -> DataFrame:
    """The documents that near_duplicates keeps, with all their columns; rows that share a doc_id stay or go together, and stay if one of them is kept."""
    gone = near_duplicates(documents, percent).filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("_gone")).agg(F.bool_or("kept").alias("_stays")).filter("NOT _stays")
    d = documents.alias("d")
    return d.join(gone.hint("shuffle_hash").alias("g"), F.col("d.doc_id").cast("long") == F.col("g._gone"), "left_anti").select("d.*")


ORACLE = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), sh AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + {WORDS - 1}), ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {WORDS - 1}, 1) + 1)) AS i FROM w WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL
), link AS (
  SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE {LEVEL[0]} * c >= {LEVEL[1]} * (x.n + y.n - c)
), reach(a, b) AS (
  SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a
), comp AS (
  SELECT d.doc_id, least(d.doc_id, coalesce(min(r.b), d.doc_id)) AS component_id FROM documents d LEFT JOIN reach r ON r.a = d.doc_id GROUP BY d.doc_id
)
SELECT c.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, c.doc_id = c.component_id AS kept FROM comp c LEFT JOIN n USING (doc_id)
"""
