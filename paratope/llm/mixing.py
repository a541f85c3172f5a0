"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

Each source's target is its weight's share of all words, capped at max_epochs times the source, the
excess reshared by weight. Blocks of `block_words` words go to the sources by highest quotients
target / (2k - 1); each source's blocks go to groups of its shards in the same way, and each group's to its
shards, by their sizes, so that at most `group_shards` shards are ranked together; the last block of a shard
may be a part of one, so that small sources reach their targets too. Inside a shard the documents stand in a
seeded order, their words laid end to end and cut into blocks. A quota takes all blocks as often as it can,
and for the rest the first blocks of a seeded permutation. Only ids, sources and sizes leave the scan; a hot
source has many shards.

Cases: null text has size 0; null source is a source of its own, ordered last; rows that repeat a
doc_id each count; rows without doc_id are dealt by their texts; a source without words has target 0; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paratope.llm.common import WORD, finished, materialize, written

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
BLOCK_WORDS = 16
SHARD_DOCS = 4096
GROUP_SHARDS = 4096
SEED = "mix-1"
#: Primes, one of which is a shard's stride from block to block; no shard has so many blocks.
STRIDES = (374761393, 668265263, 2246822519, 2654435761, 3266489917)


def _seeded(*parts: Column | str) -> Column:
    """32 bits of an MD5 as a long."""
    text = F.concat_ws(":", *(F.coalesce(p.cast("string"), F.lit("\\N")) if isinstance(p, Column) else F.lit(p) for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def water_fill(sources: DataFrame, weights: tuple[int, ...], max_epochs: int) -> DataFrame:
    """Adds rank, weight, total and target to one row a source (source, source_size)."""
    ranked = sources.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    ranked = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.col("rank") - 1) % len(weights) + 1).cast("int")).cast("long"))
    by_ratio = Window.orderBy("ratio", "rank")
    everything = Window.partitionBy()
    cap = F.col("source_size") * max_epochs
    filled = (
        ranked.withColumn("ratio", cap / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(everything))
        .withColumn("capped", F.coalesce(F.sum(cap).over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("open_weight", F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", (F.col("total") - F.col("capped")) / F.col("open_weight"))
    )
    first = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "rank", "level"))).over(everything)
    return filled.withColumn("target", F.least(F.col("weight") * first["level"], cap.cast("double"))).select("source", "source_size", "n_docs", "rank", "weight", "total", "target")


def apportion(parties: DataFrame, group: list[str], order: str, votes: str, seats: str, most: str, n_parties: Column) -> DataFrame:
    """Sainte-Laguë: adds `quota`, the party's share of its group's `seats`, never above `most`.

    Seats that every solution gives are taken from the rounded share; only the seats near the last
    quotient are listed and ranked, a number of rows linear in the parties.
    """
    share = F.col(votes) * F.col(seats) / F.col("_all")
    w_group = Window.partitionBy(*group)
    sized = parties.withColumn("_all", F.sum(votes).over(w_group))
    sized = sized.withColumn("_s0", F.when(F.col("_all") > 0, F.floor(share + 0.5)).otherwise(0).cast("long"))
    sized = sized.withColumn("_m", 2 + F.when(F.col(seats) > 0, F.ceil(1.5 * F.col("_s0") * n_parties / F.col(seats))).otherwise(0).cast("long"))
    sized = sized.withColumn("_base", F.greatest(F.lit(0), F.least(F.col(most), F.col("_s0") - F.col("_m"))).cast("long"))
    sized = sized.withColumn("_left", F.col(seats) - F.sum("_base").over(w_group))
    upto = F.least(F.col(most), F.col("_s0") + F.col("_m"))
    listed = sized.withColumn("_k", F.explode(F.when((F.col(votes) > 0) & (upto > F.col("_base")), F.sequence(F.col("_base") + 1, upto)).otherwise(F.array().cast("array<bigint>"))))
    quotient = F.col(votes) / (2 * F.col("_k") - 1)
    won = listed.withColumn("_rn", F.row_number().over(Window.partitionBy(*group).orderBy(quotient.desc(), F.col(order), F.col("_k")))).filter(F.col("_rn") <= F.col("_left"))
    keys = [*group, order] if order not in group else group
    counts = won.groupBy(*keys).agg(F.count(F.lit(1)).alias("_won"))
    joined = sized.alias("a").join(counts.alias("b"), [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys], "left")
    return joined.select("a.*", (F.col("a._base") + F.coalesce(F.col("b._won"), F.lit(0))).alias("quota")).drop("_all", "_s0", "_m", "_base", "_left")


def mix_sources(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, block_words: int = BLOCK_WORDS, shard_docs: int = SHARD_DOCS, group_shards: int = GROUP_SHARDS, seed: str = SEED, row: Column | None = None) -> DataFrame:
    """One row a document: doc_id, source, size, source_size, target, shard, taken, copies (what whole documents take of the shard's quota), `key`, the id's text or what stands for it, and `row`, a value of documents to carry along."""
    mark = written()
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    sized = materialize(documents.select("doc_id", "source", size.alias("size"), document_key().alias("key"), (F.lit(0) if row is None else row).alias("row")), "mix-sizes")
    sources = water_fill(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs")), weights, max_epochs)
    sources = sources.withColumn("seats", F.floor(F.col("total") / block_words + 0.5).cast("long")).withColumn("most", F.ceil(F.col("source_size") * max_epochs / block_words).cast("long")).withColumn("one", F.lit(1))
    n_sources = F.count(F.lit(1)).over(Window.partitionBy("one"))
    sources = sources.withColumn("n_sources", n_sources)
    quotas = apportion(sources, ["one"], "rank", "target", "seats", "most", F.col("n_sources")).withColumn("n_shards", F.ceil(F.col("n_docs") / shard_docs).cast("long"))
    quotas = materialize(quotas.select("source", "source_size", "target", "quota", "n_shards"), "mix-quotas")

    placed = sized.alias("d").join(quotas.alias("q"), F.col("d.source").eqNullSafe(F.col("q.source"))).select("d.*", "source_size", "target", "quota", "n_shards")
    placed = placed.withColumn("shard", _seeded("shard", seed, F.col("key")) % F.col("n_shards"))
    shards = placed.groupBy("source", "shard").agg(F.sum("size").alias("shard_size"), F.first("quota").alias("source_quota"), F.first("n_shards").alias("n_shards"))
    n_groups = F.ceil(F.col("n_shards") / group_shards).cast("long")
    shards = materialize(shards.withColumn("n_groups", n_groups).withColumn("grp", F.col("shard") % F.col("n_groups")).withColumn("most", F.ceil(F.col("shard_size") * max_epochs / block_words).cast("long")), "mix-shards")
    groups = shards.groupBy("source", "grp").agg(F.sum("shard_size").alias("group_size"), F.sum("most").alias("most"), F.first("source_quota").alias("source_quota"), F.first("n_groups").alias("n_groups"), F.count(F.lit(1)).alias("in_group"))
    groups = apportion(groups, ["source"], "grp", "group_size", "source_quota", "most", F.col("n_groups")).select("source", "grp", F.col("quota").alias("group_quota"), "in_group")
    shards = shards.alias("s").join(groups.alias("g"), F.col("s.source").eqNullSafe(F.col("g.source")) & (F.col("s.grp") == F.col("g.grp"))).select("s.*", "group_quota", "in_group")
    shards = apportion(shards, ["source", "grp"], "shard", "shard_size", "group_quota", "most", F.col("in_group"))
    draw = lambda label: _seeded(label, seed, F.col("source"), F.col("shard"))
    blocks = F.floor(F.col("shard_size") / block_words).cast("long")
    stride = F.element_at(F.array(*(F.lit(p).cast("long") for p in STRIDES)), (draw("stride") % len(STRIDES) + 1).cast("int"))
    shards = shards.select(
        "source", "shard", "shard_size", F.least(F.col("quota") * block_words, F.col("shard_size") * max_epochs).alias("take"), blocks.alias("blocks"),
        (draw("start") % F.greatest(blocks, F.lit(1))).alias("start"), F.when(blocks % stride == 0, 1).otherwise(stride % F.greatest(blocks, F.lit(1))).alias("stride"),
    )

    line = Window.partitionBy("source", "shard").orderBy("order", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    laid = placed.withColumn("order", F.md5(F.concat_ws(":", F.lit("order"), F.lit(seed), "key")))
    laid = laid.withColumn("off", F.coalesce(F.sum("size").over(line), F.lit(0)))
    both = laid.alias("d").join(shards.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")) & (F.col("d.shard") == F.col("s.shard"))).select("d.*", "shard_size", "take", "blocks", "start", "stride")
    return finished(both.select("doc_id", "source", "size", "source_size", "target", "shard", taken_words(block_words).alias("taken"), whole_copies().alias("copies"), "key", "row"), "mix-result", mark)


def document_key() -> Column:
    """The text of doc_id; rows without one are told apart by their texts."""
    return F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("\\N"), F.md5(F.coalesce("text", F.lit("")))))


def taken_words(block_words: int) -> Column:
    """All words as often as the shard's quota takes them whole, and the document's part of the blocks drawn for the rest: block b is number (start + b * stride) mod blocks; the words after the last whole block come last."""
    z, off, end = F.greatest(F.col("shard_size"), F.lit(1)), F.col("off"), F.col("off") + F.col("size")
    rest = F.col("take") % z

    def of_block(total: Column, b: Column) -> Column:
        number = F.when(b < F.col("blocks"), (F.col("start") + b * F.col("stride")) % F.greatest(F.col("blocks"), F.lit(1))).otherwise(F.col("blocks"))
        length = F.greatest(F.lit(0), F.least(F.lit(block_words), rest - number * block_words))
        first = b * block_words
        return total + F.greatest(F.lit(0), F.least(end, first + length) - F.greatest(off, first))

    met = F.sequence(F.floor(off / block_words).cast("long"), F.floor((end - 1) / block_words).cast("long"))
    drawn = F.when((F.col("size") > 0) & (rest > 0), F.aggregate(met, F.lit(0).cast("long"), of_block)).otherwise(0)
    return (F.floor(F.col("take") / z).cast("long") * F.col("size") + drawn).cast("long")


def whole_copies() -> Column:
    """The quota in whole documents: all as often as it takes the shard whole, and for the rest those whose middle stands, in the seeded order, before its end. A shard misses its quota by half a document at most."""
    z = F.greatest(F.col("shard_size"), F.lit(1))
    more = (F.col("size") > 0) & (2 * F.col("off") + F.col("size") < 2 * (F.col("take") % z))
    return (F.floor(F.col("take") / z) + more.cast("int")).cast("int")


def row_mark(documents: DataFrame) -> Column:
    """A hash of a row; columns of maps, which have none, aside."""
    return F.xxhash64(*(F.col(f"`{f.name}`") for f in documents.schema.fields if "map<" not in f.dataType.simpleString()))


def mixed_documents(documents: DataFrame, **options) -> DataFrame:
    """The mix itself, in whole documents: every row as often as it has copies.

    Rows are told apart by all their columns. Equal rows share the copies of all of them: each comes as often as
    that gives whole copies, and what is left over is dealt once for all.
    """
    mark = written()
    mixed = mix_sources(documents, row=row_mark(documents), **options).filter("size > 0")
    copies = mixed.groupBy("key", "row").agg(F.sum("copies").alias("_all"), F.count(F.lit(1)).alias("_rows")).filter("_all > 0")
    copies = finished(copies.select("key", "row", F.floor(F.col("_all") / F.col("_rows")).cast("int").alias("_copies"), (F.col("_all") % F.col("_rows")).cast("int").alias("_over")), "mix-copies", mark)
    rows = documents.select(document_key().alias("key"), row_mark(documents).alias("mark"), F.struct(*(F.col(f"`{c}`") for c in documents.columns)).alias("row"))
    same = (F.col("d.key") == F.col("c.key")) & (F.col("d.mark") == F.col("c.row"))
    joined = rows.alias("d").join(copies.hint("shuffle_hash").alias("c"), same).select("d.row", "d.mark", "c.key", "_copies", "_over")
    repeated = joined.filter("_copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    over = copies.filter("_over > 0")
    if not over.isEmpty():
        left = rows.alias("d").join(over.alias("c"), same).select("d.row", "d.mark", "c.key", "_over").dropDuplicates(["key", "mark"])
        repeated = repeated.unionByName(left.select("row", F.explode(F.sequence(F.lit(1), F.col("_over")))))
    return repeated.select("row.*")


#: DuckDB's statement of op7's contract; `target` and `taken` are computed by the same formulas.
ORACLE = f"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size, coalesce(doc_id::VARCHAR, '\\N' || md5(coalesce(text, ''))) AS key FROM documents
), src AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS n_docs FROM sized GROUP BY source
), ranked AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rk FROM src
), weighted AS (
  SELECT *, CAST([5, 2, 1][(rk - 1) % 3 + 1] AS BIGINT) AS weight, CAST(sum(source_size) OVER () AS BIGINT) AS total FROM ranked
), levels AS (
  SELECT *, (source_size * {MAX_EPOCHS})::DOUBLE / weight AS ratio FROM weighted
), levels2 AS (
  SELECT *, (total - coalesce(sum(source_size * {MAX_EPOCHS}) OVER (ORDER BY ratio, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
    / (sum(weight) OVER (ORDER BY ratio, rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level FROM levels
), lev AS (
  SELECT level FROM levels2 WHERE level <= ratio ORDER BY ratio, rk LIMIT 1
), targets AS (
  SELECT w.*, least(weight * (SELECT level FROM lev), (source_size * {MAX_EPOCHS})::DOUBLE) AS target,
    CAST(floor(total / {BLOCK_WORDS} + 0.5) AS BIGINT) AS seats, CAST(ceil(source_size * {MAX_EPOCHS} / {BLOCK_WORDS}) AS BIGINT) AS most
  FROM weighted w
), quotients AS (
  SELECT rk, target / (2 * k - 1) AS q, k FROM targets, unnest(range(1, most + 1)) AS u(k) WHERE target > 0
), won AS (
  SELECT rk, count(*) AS quota FROM (
    SELECT rk, row_number() OVER (ORDER BY q DESC, rk, k) AS rn FROM quotients
  ) WHERE rn <= (SELECT max(seats) FROM targets) GROUP BY rk
), src_quota AS (
  SELECT t.*, coalesce(quota, 0) AS quota, CAST(ceil(n_docs / {SHARD_DOCS}) AS BIGINT) AS n_shards FROM targets t LEFT JOIN won USING (rk)
), placed AS (
  SELECT d.doc_id, d.source, d.size, s.rk, s.source_size, s.target, s.quota, s.n_shards,
    CAST('0x' || substr(md5('shard:{SEED}:' || d.key), 1, 8) AS BIGINT) % s.n_shards AS shard,
    md5('order:{SEED}:' || d.key) AS ord
  FROM sized d JOIN src_quota s ON d.source IS NOT DISTINCT FROM s.source
), shards AS (
  SELECT rk, any_value(source) AS source, shard, any_value(shard % CAST(ceil(n_shards / {GROUP_SHARDS}) AS BIGINT)) AS grp, CAST(sum(size) AS BIGINT) AS shard_size, any_value(quota) AS source_quota,
    CAST(ceil(sum(size) * {MAX_EPOCHS} / {BLOCK_WORDS}) AS BIGINT) AS most
  FROM placed GROUP BY rk, shard
), groups AS (
  SELECT rk, grp, CAST(sum(shard_size) AS BIGINT) AS group_size, CAST(sum(most) AS BIGINT) AS most, any_value(source_quota) AS source_quota FROM shards GROUP BY rk, grp
), group_won AS (
  SELECT rk, grp, count(*) AS group_quota FROM (
    SELECT rk, grp, source_quota, row_number() OVER (PARTITION BY rk ORDER BY group_size::DOUBLE / (2 * k - 1) DESC, grp, k) AS rn FROM groups, unnest(range(1, most + 1)) AS u(k) WHERE group_size > 0
  ) WHERE rn <= source_quota GROUP BY rk, grp
), shard_q AS (
  SELECT rk, grp, shard, group_quota, shard_size::DOUBLE / (2 * k - 1) AS q, k FROM shards JOIN group_won USING (rk, grp), unnest(range(1, most + 1)) AS u(k) WHERE shard_size > 0
), shard_won AS (
  SELECT rk, shard, count(*) AS quota FROM (
    SELECT rk, shard, group_quota, row_number() OVER (PARTITION BY rk, grp ORDER BY q DESC, shard, k) AS rn FROM shard_q
  ) WHERE rn <= group_quota GROUP BY rk, shard
), cut AS (
  SELECT s.rk, s.shard, greatest(s.shard_size, 1) AS z, least(coalesce(w.quota, 0) * {BLOCK_WORDS}, s.shard_size * {MAX_EPOCHS}) AS take, s.shard_size // {BLOCK_WORDS} AS blocks,
    CAST('0x' || substr(md5('start:{SEED}:' || coalesce(s.source, '\\N') || ':' || s.shard::VARCHAR), 1, 8) AS BIGINT) % greatest(s.shard_size // {BLOCK_WORDS}, 1) AS start,
    {list(STRIDES)}[CAST('0x' || substr(md5('stride:{SEED}:' || coalesce(s.source, '\\N') || ':' || s.shard::VARCHAR), 1, 8) AS BIGINT) % {len(STRIDES)} + 1] AS prime
  FROM shards s LEFT JOIN shard_won w ON s.rk = w.rk AND s.shard = w.shard
), laid AS (
  SELECT p.*, r.z, r.take, r.start, r.take % r.z AS rest, r.blocks, CASE WHEN r.blocks % r.prime = 0 THEN 1 ELSE r.prime % greatest(r.blocks, 1) END AS stride,
    CAST(coalesce(sum(p.size) OVER (PARTITION BY p.rk, p.shard ORDER BY p.ord, p.doc_id, p.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS off
  FROM placed p JOIN cut r ON p.rk = r.rk AND p.shard = r.shard
), met AS (
  SELECT *, list_transform(CASE WHEN size > 0 AND rest > 0 THEN range(off // {BLOCK_WORDS}, (off + size - 1) // {BLOCK_WORDS} + 1) ELSE [] END,
    lambda b: greatest(0, least(off + size, b * {BLOCK_WORDS} + greatest(0, least({BLOCK_WORDS}, rest - {BLOCK_WORDS} * (CASE WHEN b < blocks THEN (start + b * stride) % greatest(blocks, 1) ELSE blocks END)))) - greatest(off, b * {BLOCK_WORDS}))) AS parts
  FROM laid
)
SELECT doc_id, size, source_size, target, CAST((take // z) * size + coalesce(list_sum(parts), 0) AS BIGINT) AS taken
FROM met
"""
