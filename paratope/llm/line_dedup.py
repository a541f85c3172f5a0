"""Line deduplication across documents.

Lines' key hashes (128 bits) are range-partitioned by hash, document and position, so that one very
common line spreads over many partitions, and sorted within them. Each partition streams its runs of
equal hashes: a run that ends inside the partition is decided there; a run at an edge may go on in the
next partition, so its lines are left open and a summary of a few numbers is put out. The summaries, two
at most a partition, decide the open lines. What comes out is one compressed keep bitmap for each
document that loses lines; texts never move with the keys, and applying the bitmaps is a join of its own.

Cases: null and empty texts are one empty line; keys shorter than `min_chars` code points are kept; rows
that repeat a doc_id count as one document for a key, and their positions are those of their own text; a
null doc_id is a document, smaller than any other; an empty table gives an empty result; extra columns
are ignored. Texts are whole, of any length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paratope.llm.common import finished, let, lower_ascii, materialize, ship, written

MIN_CHARS = 20
MIN_DOCS = 3

DROP, OPEN, SUMMARY = 0, 1, 2
#: Lines of one run that a task holds before it leaves them to the summaries.
HOLD = 1_000_000
_FLAGS = "kind byte, h1 long, h2 long, has_doc boolean, doc long, th long, pos int, docs array<struct<has:boolean,doc:long>>"
_DOCS = pa.list_(pa.struct([("has", pa.bool_()), ("doc", pa.int64())]))


def line_key(line: Column) -> Column:
    """The line without space at its ends, A-Z in lower case."""
    return lower_ascii(F.btrim(line, F.lit(" \t\n\x0b\f\r")))


def line_hashes(documents: DataFrame, min_chars: int) -> DataFrame:
    """(h1, h2, has_doc, doc, th, pos) of each line whose key is long enough; th tells rows of one doc_id apart."""
    hashed = lambda k, i: F.when(F.char_length(k) >= min_chars, F.struct(F.xxhash64(k).alias("h1"), F.xxhash64(F.lit(17), k).alias("h2"), i.alias("pos")))
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda line, i: let(line_key(line), lambda k: hashed(k, i)))
    cut = documents.select("doc_id", F.xxhash64("text").alias("th"), F.explode(F.filter(lines, lambda x: x.isNotNull())).alias("l"))
    return cut.select("l.h1", "l.h2", F.col("doc_id").isNotNull().alias("has_doc"), F.coalesce(F.col("doc_id"), F.lit(0)).cast("long").alias("doc"), "th", "l.pos")


def _flags(kind: int, h1, h2, has, doc, th, pos, docs=None) -> pa.RecordBatch:
    n = len(doc)
    cols = [pa.array(np.full(n, kind, np.int8)), *(pa.array(np.asarray(x), t) for x, t in ((h1, pa.int64()), (h2, pa.int64()), (has, pa.bool_()), (doc, pa.int64()), (th, pa.int64()), (pos, pa.int32()))), pa.array(docs or [None] * n, _DOCS)]
    return pa.RecordBatch.from_arrays(cols, names=["kind", "h1", "h2", "has_doc", "doc", "th", "pos", "docs"])


class _Run:
    """One run of equal hashes that may go on: its first documents, its last one, and its lines so far."""

    def __init__(self, h: tuple[int, int], edge: bool, min_docs: int):
        self.h, self.edge, self.min_docs = h, edge, min_docs
        self.docs: list[tuple[bool, int]] = []
        self.held: list[tuple] = []
        self.n_held, self.last = 0, (False, 0)

    def add(self, has, doc, th, pos) -> Iterator[pa.RecordBatch]:
        for i in np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (has[1:] != has[:-1])])[: self.min_docs]:
            d = (bool(has[i]), int(doc[i]))
            if len(self.docs) < self.min_docs and d not in self.docs:
                self.docs.append(d)
        self.held.append((has, doc, th, pos))
        self.last = (bool(has[-1]), int(doc[-1]))
        self.n_held += len(doc)
        if self.n_held > HOLD:
            self.edge = True
            yield from self.put(OPEN)

    def put(self, kind: int) -> Iterator[pa.RecordBatch]:
        for has, doc, th, pos in self.held:
            m = np.ones(len(doc), bool) if kind == OPEN else (doc != self.last[1]) | (has != self.last[0])
            if n := int(m.sum()):
                yield _flags(kind, np.full(n, self.h[0]), np.full(n, self.h[1]), has[m], doc[m], th[m], pos[m])
        self.held, self.n_held = [], 0

    def close(self) -> Iterator[pa.RecordBatch]:
        if self.edge:
            docs = [{"has": a, "doc": b} for a, b in self.docs]
            yield _flags(SUMMARY, [self.h[0]], [self.h[1]], [self.last[0]], [self.last[1]], [0], [0], [docs])
            yield from self.put(OPEN)
        elif len(self.docs) >= self.min_docs:
            yield from self.put(DROP)


def _inner_runs(runs, cuts, ends, h1, h2, has, doc, th, pos, min_docs: int) -> Iterator[pa.RecordBatch]:
    """Runs that begin and end in one batch, all at once: every line goes but the last document's, where documents are enough."""
    fresh = np.r_[1, ((doc[1:] != doc[:-1]) | (has[1:] != has[:-1])).astype(np.int64)]
    fresh[cuts] = 1
    chosen = runs[np.add.reduceat(fresh, cuts)[runs] >= min_docs]
    if not len(chosen):
        return
    lengths = ends[chosen] - cuts[chosen]
    rows = np.repeat(cuts[chosen] - np.r_[0, np.cumsum(lengths)[:-1]], lengths) + np.arange(lengths.sum())
    last = np.repeat(ends[chosen] - 1, lengths)
    rows = rows[(doc[rows] != doc[last]) | (has[rows] != has[last])]
    if len(rows):
        yield _flags(DROP, h1[rows], h2[rows], has[rows], doc[rows], th[rows], pos[rows])


def _stream_runs(min_docs: int):
    """For mapInArrow over sorted (h1, h2, has_doc, doc, th, pos): lines that go, and open lines and summaries of the runs at the partition's edges."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current: _Run | None = None
        for batch in batches:
            h1, h2, has, doc, th, pos = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(6))
            if not len(h1):
                continue
            cuts = np.flatnonzero(np.r_[True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])])
            ends = np.r_[cuts[1:], len(h1)]
            part = lambda i: (x[cuts[i] : ends[i]] for x in (has, doc, th, pos))  # noqa: B023, E731
            head = 0
            if current is None or current.h != (int(h1[0]), int(h2[0])):
                edge = current is None
                if current is not None:
                    yield from current.close()
                current = _Run((int(h1[0]), int(h2[0])), edge, min_docs)
            yield from current.add(*part(0))
            head = 1
            if head < len(cuts):
                yield from current.close()
                yield from _inner_runs(np.arange(head, len(cuts) - 1), cuts, ends, h1, h2, has, doc, th, pos, min_docs)
                a = cuts[-1]
                current = _Run((int(h1[a]), int(h2[a])), False, min_docs)
                yield from current.add(*part(-1))
        if current is not None:
            current.edge = True
            yield from current.close()

    return stream


def _pack(positions: list[int], n_lines: int) -> bytes:
    keep = np.ones(-n_lines // 8 * -8, np.uint8)
    keep[np.asarray(positions, np.int64)] = 0
    return zlib.compress(np.packbits(keep, bitorder="little").tobytes(), 6)


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        packed = [_pack(p, max(p) + 1) for p in b.column("drops").to_pylist()]
        yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(4)), pa.array(packed, pa.binary())], names=["has_doc", "doc", "th", "n_dropped", "keep"])


def dropped_lines(documents: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(has_doc, doc, th, pos) of every line that goes."""
    ship(documents.sparkSession)
    mark = written()
    order = ["h1", "h2", "has_doc", "doc", "th", "pos"]
    hashes = materialize(line_hashes(documents, min_chars).select(*order), "line-hashes", "lz4")  # the ranges' bounds are sampled from it, not from the texts
    ranged = hashes.repartitionByRange(*order).sortWithinPartitions(*order)
    flags = finished(ranged.mapInArrow(_stream_runs(min_docs), _FLAGS), "line-flags", mark)
    n_docs = F.size(F.array_distinct(F.flatten(F.collect_list("docs"))))
    decided = flags.filter(F.col("kind") == SUMMARY).groupBy("h1", "h2").agg(F.max(F.struct("has_doc", "doc")).alias("largest"), n_docs.alias("n")).filter(F.col("n") >= min_docs)
    at_edge = F.broadcast(decided.select("h1", "h2", "largest"))  # two rows for each partition of the line hashes, and one for each HOLD lines
    opened = flags.filter(F.col("kind") == OPEN).join(at_edge, ["h1", "h2"]).filter(F.struct("has_doc", "doc") != F.col("largest"))
    cols = ["has_doc", "doc", "th", "pos"]
    return flags.filter(F.col("kind") == DROP).select(*cols).unionByName(opened.select(*cols))


def keep_bitmaps(documents: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """One row for each text that loses lines: has_doc, doc, th, n_dropped and `keep`, a zlib-compressed bitmap in which bit i is 0 if line i goes; lines beyond its end stay."""
    drops = dropped_lines(documents, min_chars, min_docs)
    grouped = drops.groupBy("has_doc", "doc", "th").agg(F.collect_set("pos").alias("drops"))
    return grouped.select("has_doc", "doc", "th", F.size("drops").cast("long").alias("n_dropped"), "drops").mapInArrow(_bitmaps, "has_doc boolean, doc long, th long, n_dropped long, keep binary")


def _cut(text: pa.Array, keep: pa.Array) -> pa.Array:
    """The text's kept lines; null where there is no bitmap."""
    out = []
    for t, k in zip(text.to_pylist(), keep.to_pylist(), strict=True):
        if k is None:
            out.append(None)
            continue
        gone = set(np.flatnonzero(np.unpackbits(np.frombuffer(zlib.decompress(k), np.uint8), bitorder="little") == 0).tolist())
        lines = (t or "").split("\n")
        out.append("\n".join(line for j, line in enumerate(lines) if j not in gone))
    return pa.array(out, pa.string())


def apply_bitmaps(documents: DataFrame, bitmaps: DataFrame, counts: bool = True) -> DataFrame:
    """documents with `text` cut to its kept lines; a null text is then an empty one. counts: _n_lines and _n_dropped are added, in place of columns of these names."""
    ship(documents.sparkSession)
    rows = documents.select(F.struct(*(F.col(f"`{c}`") for c in documents.columns)).alias("row"))
    d = rows.select("row", F.coalesce(F.col("row.doc_id"), F.lit(0)).cast("long").alias("doc"), F.col("row.doc_id").isNotNull().alias("has_doc"), F.xxhash64("row.text").alias("th"))
    joined = d.join(bitmaps.hint("shuffle_hash"), ["has_doc", "doc", "th"], "left")  # the small side is hashed, so texts needn't be sorted
    filled = F.coalesce(F.col("row.text"), F.lit(""))
    text = F.coalesce(F.arrow_udf(_cut, "string")(F.when(F.col("keep").isNotNull(), F.col("row.text")), F.col("keep")), filled).alias("text")
    own = [text if c == "text" else F.col(f"row.`{c}`") for c in documents.columns if not (counts and c in ("_n_lines", "_n_dropped"))]
    if counts:
        own += [(F.regexp_count(filled, F.lit("\n")).cast("long") + 1).alias("_n_lines"), F.coalesce("n_dropped", F.lit(0)).cast("long").alias("_n_dropped")]
    return joined.select(*own)


def dedup_lines(documents: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, counts: bool = True) -> DataFrame:
    mark = written()
    return apply_bitmaps(documents, finished(keep_bitmaps(documents, min_chars, min_docs), "line-bitmaps", mark), counts)


ORACLE = f"""
WITH l AS (
  SELECT doc_id, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)
), hot AS (
  SELECT key, max(doc_id) AS holder FROM l WHERE length(key) >= {MIN_CHARS} GROUP BY key HAVING count(DISTINCT doc_id) >= {MIN_DOCS}
), m AS (
  SELECT l.*, hot.key IS NOT NULL AND l.doc_id <> holder AS gone FROM l LEFT JOIN hot USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
