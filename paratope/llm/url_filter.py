"""URL filters: rules by host and path, then a ratio of character language models.

URLs that a rule decides are the examples: those allowed train one variable-order Markov model, those
blocked another (Witten-Bell interpolation of orders 0 to 3 over a fixed alphabet of 40 symbols).
The verdict of any other URL is the length-normalised log-likelihood difference against a threshold,
calibrated for balanced accuracy on a fold of the decided URLs that the models haven't seen.

The gram table has at most 40^4 rows whatever the input, so it may be broadcast. Log ratios are whole
micro-nats, so sums don't depend on their order.

Cases: null urls and urls without "://" have empty host and path and are scored on what they hold;
repeated rows each get their verdict; without examples of both kinds every open URL is allowed; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paratope.llm.common import let, lower_ascii, materialize

#: (verdict, host, path) of the production rules.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
ORDER = 3
#: Letters, one digit sign, ten marks, one for all other characters, start and end.
ALPHABET = 40
FOLDS = 5
BUCKET = 10_000
MOST = 1000


def host_of(url: Column) -> Column:
    return lower_ascii(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def matched_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits host and path, as struct(rule, verdict); null where none does."""
    found = None
    for verdict, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        value = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        found = F.when(fits, value) if found is None else found.when(fits, value)
    return found


def symbols(url: Column) -> Column:
    """The URL after its scheme in the models' alphabet."""
    body = F.coalesce(F.when(F.instr(url, "://") > 0, _rest(url)).otherwise(url), F.lit(""))
    return F.regexp_replace(F.regexp_replace(lower_ascii(body), "[0-9]", "0"), r"[^a-z0\-._/?=&%#:]", "*")


def _grams(norm: Column) -> Column:
    padded = F.split(F.concat(F.lit("^" * ORDER), norm, F.lit("$")), "")  # single characters are found by place, so a long URL takes no longer a character
    return let(padded, lambda s: F.transform(F.sequence(F.lit(0), F.size(s) - ORDER - 1), lambda i: F.concat(*(F.get(s, i + j) for j in range(ORDER + 1)))))


def gram_scores(counts: DataFrame) -> DataFrame:
    """From (gram, n_a, n_r) of all grams: (gram, llr), the log ratio of the two models in micro-nats."""
    scored = counts.select("gram", F.lit(1.0 / ALPHABET).alias("p_a"), F.lit(1.0 / ALPHABET).alias("p_r"))
    for k in range(ORDER + 1):
        chars = counts.groupBy(F.substring("gram", ORDER + 1 - k, k + 1).alias("seen")).agg(F.sum("n_a").alias("n_a"), F.sum("n_r").alias("n_r"))
        contexts = chars.groupBy(F.col("seen").substr(F.lit(1), F.lit(k)).alias("ctx")).agg(
            F.sum("n_a").alias("all_a"), F.sum("n_r").alias("all_r"), F.count_if(F.col("n_a") > 0).alias("t_a"), F.count_if(F.col("n_r") > 0).alias("t_r")
        )
        scored = scored.withColumns({"seen": F.substring("gram", ORDER + 1 - k, k + 1), "ctx": F.substring("gram", ORDER + 1 - k, k)})
        scored = scored.join(chars, "seen").join(contexts, "ctx")
        for m in "ar":
            better = (F.col(f"n_{m}") + F.col(f"t_{m}") * F.col(f"p_{m}")) / F.nullif(F.col(f"all_{m}") + F.col(f"t_{m}"), F.lit(0))
            scored = scored.withColumn(f"p_{m}", F.when(F.col(f"all_{m}") > 0, better).otherwise(F.col(f"p_{m}")))
        scored = scored.select("gram", "p_a", "p_r")
    return scored.select("gram", F.round(F.log(F.col("p_a") / F.col("p_r")) * 1e6).cast("long").alias("llr"))


def calibrate(scored: DataFrame) -> DataFrame:
    """From (bucket, good, bad) of held-out examples: one row `cut`, the lowest bucket that is allowed, half-way between two that were seen; null without examples of both kinds."""
    upward = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = scored.groupBy("bucket").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    everything = Window.partitionBy()
    half = F.floor((F.coalesce(F.lag("bucket").over(Window.orderBy("bucket")), F.col("bucket")) + F.col("bucket")) / 2).cast("long")
    rated = sums.withColumns({"middle": half, "lost": F.coalesce(F.sum("good").over(upward), F.lit(0)), "caught": F.coalesce(F.sum("bad").over(upward), F.lit(0)), "all_good": F.sum("good").over(everything), "all_bad": F.sum("bad").over(everything)})
    gain = F.col("caught") * F.col("all_good") - F.col("lost") * F.col("all_bad")
    return rated.filter("all_good > 0 AND all_bad > 0").agg(F.max(F.struct(gain.alias("gain"), (-F.abs("middle")).alias("near"), F.col("middle")))["middle"].alias("cut"))


def judge_urls(pages: DataFrame, rules=RULES) -> DataFrame:
    """One row a page: page_id, host, path, rule, verdict, bucket (null where a rule decided)."""
    parsed = pages.select("page_id", "url").select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), symbols(F.col("url")).alias("norm"))
    parsed = parsed.withColumns({"host": F.coalesce("host", F.lit("")), "path": F.coalesce("path", F.lit(""))})
    ruled = parsed.withColumn("m", matched_rule(F.col("host"), F.col("path"), rules))

    held_out = F.conv(F.substring(F.md5("norm"), 1, 8), 16, 10).cast("long") % FOLDS == 0
    urls = ruled.groupBy("norm").agg(
        F.count_if(F.col("m.verdict") == "allow").alias("good"), F.count_if(F.col("m.verdict") == "block").alias("bad"), F.count_if(F.col("m").isNull()).alias("open")
    ).withColumn("held_out", held_out)
    urls = materialize(urls, "url-distinct")
    trains = lambda c: F.sum(F.when(F.col("held_out"), 0).otherwise(F.col(c)))
    counts = urls.select("held_out", "good", "bad", F.explode(_grams(F.col("norm"))).alias("gram")).groupBy("gram").agg(trains("good").alias("n_a"), trains("bad").alias("n_r"))
    counts = materialize(counts, "url-grams")
    table = F.broadcast(materialize(gram_scores(counts), "url-model"))  # at most 40^4 rows

    wanted = urls.filter("open > 0 OR held_out").select("norm", F.explode(_grams(F.col("norm"))).alias("gram"))
    scores = wanted.join(table, "gram").groupBy("norm").agg(F.sum("llr").alias("total"), F.count(F.lit(1)).alias("n"))
    bucket = F.greatest(F.lit(-MOST), F.least(F.lit(MOST), F.floor(F.col("total") / (F.col("n") * float(BUCKET))))).cast("long")
    scores = materialize(scores.select("norm", bucket.alias("bucket")), "url-scores")
    cut = calibrate(urls.filter("held_out AND good + bad > 0").join(scores, "norm").select("bucket", "good", "bad"))

    open_scores = scores.crossJoin(F.broadcast(cut))  # cut is one row
    joined = ruled.join(open_scores, "norm", "left")
    method = F.when(F.col("cut").isNull() | (F.col("bucket") >= F.col("cut")), "allow").otherwise("block")
    return joined.select("page_id", "host", "path", F.col("m.rule").alias("rule"), F.coalesce(F.col("m.verdict"), method).alias("verdict"), F.when(F.col("m").isNull(), F.col("bucket")).alias("bucket"))


def _oracle() -> str:
    cases = lambda what: "CASE " + " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{what(v, h, p)}'" for v, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2]))) + " END"
    orders = [f"s0 AS (SELECT gram, 1.0::DOUBLE / {ALPHABET} AS p_a, 1.0::DOUBLE / {ALPHABET} AS p_r FROM counts)"]
    for k in range(ORDER + 1):
        orders += [
            f"c{k} AS (SELECT right(gram, {k + 1}) AS seen, sum(n_a) AS n_a, sum(n_r) AS n_r FROM counts GROUP BY 1)",
            f"x{k} AS (SELECT left(seen, {k}) AS ctx, sum(n_a) AS all_a, sum(n_r) AS all_r, count(*) FILTER (n_a > 0) AS t_a, count(*) FILTER (n_r > 0) AS t_r FROM c{k} GROUP BY 1)",
            f"s{k + 1} AS (SELECT gram, "
            + ", ".join(f"CASE WHEN all_{m} > 0 THEN (n_{m} + t_{m} * p_{m}) / (all_{m} + t_{m}) ELSE p_{m} END AS p_{m}" for m in "ar")
            + f" FROM s{k} JOIN c{k} ON right(gram, {k + 1}) = seen JOIN x{k} ON left(right(gram, {k + 1}), {k}) = ctx)",
        ]
    return f"""
WITH r AS (
  SELECT page_id, coalesce(url, '') AS url, instr(coalesce(url, ''), '://') AS pos FROM pages
), h AS (
  SELECT *, CASE WHEN pos > 0 THEN substr(url, pos + 3) ELSE '' END AS rest FROM r
), p AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
    regexp_replace(regexp_replace(translate(CASE WHEN pos > 0 THEN rest ELSE url END, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9]', '0', 'g'), '[^a-z0\\-._/?=&%#:]', '*', 'g') AS norm
  FROM h
), ruled AS (
  SELECT *, {cases(lambda v, h, p: h + p)} AS rule, {cases(lambda v, h, p: v)} AS ruling FROM p
), urls AS (
  SELECT norm, count(*) FILTER (ruling = 'allow') AS good, count(*) FILTER (ruling = 'block') AS bad, count(*) FILTER (ruling IS NULL) AS open,
    CAST('0x' || substr(md5(norm), 1, 8) AS BIGINT) % {FOLDS} = 0 AS held_out
  FROM ruled GROUP BY norm
), grams AS (
  SELECT norm, good, bad, held_out, substr(s, i, {ORDER + 1}) AS gram
  FROM (SELECT *, '{"^" * ORDER}' || norm || '$' AS s, unnest(range(1, length(norm) + 2)) AS i FROM urls)
), counts AS (
  SELECT gram, sum(CASE WHEN held_out THEN 0 ELSE good END) AS n_a, sum(CASE WHEN held_out THEN 0 ELSE bad END) AS n_r FROM grams GROUP BY gram
), {", ".join(orders)}, llr AS (
  SELECT gram, CAST(round(ln(p_a / p_r) * 1e6) AS BIGINT) AS llr FROM s{ORDER + 1}
), scores AS (
  SELECT norm, greatest(-{MOST}, least({MOST}, floor(sum(llr) / (count(*) * {BUCKET}.0::DOUBLE)))) AS bucket FROM grams JOIN llr USING (gram) GROUP BY norm
), cal AS (
  SELECT bucket, sum(good) AS good, sum(bad) AS bad FROM urls JOIN scores USING (norm) WHERE held_out AND good + bad > 0 GROUP BY bucket
), rated AS (
  SELECT CAST(floor((coalesce(lag(bucket) OVER (ORDER BY bucket), bucket) + bucket) / 2.0) AS BIGINT) AS middle, coalesce(sum(good) OVER w, 0) AS lost, coalesce(sum(bad) OVER w, 0) AS caught, sum(good) OVER () AS all_good, sum(bad) OVER () AS all_bad
  FROM cal WINDOW w AS (ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), cut AS (
  SELECT middle AS cut FROM rated WHERE all_good > 0 AND all_bad > 0 ORDER BY caught * all_good - lost * all_bad DESC, abs(middle), middle DESC LIMIT 1
)
SELECT page_id, host, path, rule, coalesce(ruling, CASE WHEN (SELECT cut FROM cut) IS NULL OR bucket >= (SELECT cut FROM cut) THEN 'allow' ELSE 'block' END) AS verdict
FROM ruled JOIN scores USING (norm)
"""


ORACLE = _oracle()
