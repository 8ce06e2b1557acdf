"""Mixing sources to target weights along a time-varying curriculum.

Targets: sources in code point order, null last, weigh 5, 2, 1, 5, ...; they share `share` times all words in proportion
to weight, and no target passes `most` times its source's words; what is above is shared out again by weight. That is
the water level L with sum(min(most * size, L * weight)) = share * sum(size), found by a window over the sources.

Within a source, documents stand in the order of a hash. The source's demand runs through that order again and again
until its target is met: all get `passes` whole passes, and those at the front one more; the document at the end of the
demand gives just the words that are wanting.

Time: source i has a weight schedule v(t) = 1 + a (2t - 1) over training time 0 <= t <= 1, with slope a between -0.5 and
0.5 by its rank. Its integral D(t) = a t^2 + (1 - a) t is the share of its target that is used up by t. Copy k of a
document begins after k passes over the source and the words before the document; inverting D at that share of the
target gives the copy's training position, so a source is met from 0 to 1 however often it is passed over.

Running sums are taken in two steps (per hash bucket of a source, then inside each bucket), so no source's rows ever
have to meet in one task. A row's place in its source follows the hash of its id and text.

Defined results: null text has no words; documents without words are never taken; a null source is a source, the last;
rows with null or equal ids are told apart by their texts; rows equal in both share their order's ties, so which of them
is cut short is arbitrary but their set of results is not; a very long text is one document and may be cut short; an
empty table gives an empty result; further columns are kept whatever their names, except for those named like a result
(size, source_size, target, taken, passes, extra, position, last_position), which are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftwell.llm.common import cut, empty_if_null, read

WEIGHTS = (5.0, 2.0, 1.0)


def word_count(text: str) -> Column:
    return F.regexp_count(empty_if_null(text), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def source_targets(sizes: DataFrame, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size) -> with weight, target and slope. One row per source, so its windows are small."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("nth", F.row_number().over(order)).withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.pmod(F.col("nth") - 1, F.lit(len(WEIGHTS))) + 1).cast("int")))
    level = Window.orderBy((F.col("source_size") / F.col("weight")).asc(), "nth")
    all_rows = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    steps = (
        ranked.withColumn("capped", F.coalesce(F.sum(F.lit(most) * F.col("source_size")).over(level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(level.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("rate", (F.lit(share) * F.sum("source_size").over(all_rows) - F.col("capped")) / F.col("open"))
        .withColumn("fits", F.col("rate") * F.col("weight") <= F.lit(most) * F.col("source_size"))
    )
    slope = F.when(F.col("n") > 1, F.lit(-0.5) + (F.col("nth") - 1) / (F.col("n") - 1)).otherwise(F.lit(0.0))
    return (
        steps.withColumn("rate", F.min(F.when(F.col("fits"), F.struct(F.col("source_size") / F.col("weight"), F.col("nth"), F.col("rate").alias("level")))).over(all_rows)["level"])
        .withColumn("n", F.count("*").over(all_rows))
        .select("source", "source_size", "weight", F.least(F.lit(most) * F.col("source_size"), F.col("rate") * F.col("weight")).alias("target"), slope.alias("slope"))
    )


RESULTS = ("size", "source_size", "target", "taken", "passes", "extra", "position", "last_position")


def time_of(used: Column, slope: Column) -> Column:
    """The time t at which the share `used` of a target is used up: the inverse of D."""
    return F.least(F.when(F.abs(slope) < 1e-9, used).otherwise((F.sqrt((1 - slope) * (1 - slope) + 4 * slope * used) - (1 - slope)) / (2 * slope)), F.lit(1.0))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", share: float = 1.5, most: float = 2.0, keep: list[str] | None = None, whole: bool = False) -> DataFrame:
    """The rows of docs (or their columns `keep`) with the RESULTS.

    taken = passes * size + extra words. position and last_position are those of the first and the last copy, null for
    documents not taken. With whole, there is a row for every copy instead, each at its own position, and the last copy
    is taken whole if over half of it is wanted, or not at all.
    """
    kept = docs.columns if keep is None else keep
    inner = {c: f"_in_{i}" for i, c in enumerate(kept)}
    order = F.md5(F.concat_ws(":", F.coalesce(F.col(doc_id).cast("string"), F.lit("")), empty_if_null(text)).cast("binary"))
    key = F.coalesce(F.concat(F.lit("s"), F.col(source)), F.lit("n"))
    sized = docs.select(*[F.col(f"`{c}`").alias(inner[c]) for c in kept], key.alias("_source"), order.alias("_order"), word_count(text).alias("_size")).withColumn("_bucket", F.substring("_order", 1, 3))
    counts = cut(sized.groupBy("_source", "_bucket").agg(F.sum("_size").alias("_bucket_size")))
    totals = counts.groupBy("_source").agg(F.sum("_bucket_size").alias("source_size")).select(F.when(F.col("_source") != "n", F.expr("substring(_source, 2)")).alias("source"), "source_size")
    targets = source_targets(totals, share, most).withColumn("_source", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))).drop("source")
    buckets = (
        counts.withColumn("_before", F.coalesce(F.sum("_bucket_size").over(Window.partitionBy("_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .join(targets, "_source")
        .select("_source", "_bucket", "_before", "source_size", "target", "slope")
    )
    within = Window.partitionBy("_source", "_bucket").orderBy("_order", "_size").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("_inside", F.coalesce(F.sum("_size").over(within), F.lit(0))).join(buckets, ["_source", "_bucket"]).withColumn("_before", F.col("_before") + F.col("_inside"))
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = F.round(F.col("target") - F.col("passes") * F.col("source_size")).cast("long")
    extra = F.greatest(F.lit(0), F.least(F.col("_size"), rest - F.col("_before"))).cast("long")
    mixed = placed.withColumn("passes", passes).withColumn("extra", extra).withColumn("taken", (F.col("passes") * F.col("_size") + F.col("extra")).cast("long"))
    copies = (F.when(F.col("taken") > 0, F.col("passes")).otherwise(F.lit(0)) + ((2 * F.col("extra") > F.col("_size")) if whole else (F.col("extra") > 0)).cast("long")).cast("int")
    at = lambda k: time_of((F.col("_before") + k * F.col("source_size")) / F.greatest(F.col("target"), F.lit(1.0)), F.col("slope"))
    if whole:
        each = F.explode(F.when(copies > 0, F.sequence(F.lit(0), copies - 1)).otherwise(F.array().cast("array<int>")))
        mixed = mixed.withColumn("_copy", each).withColumn("position", at(F.col("_copy"))).withColumn("last_position", F.col("position")).withColumn("taken", F.col("_size"))
    else:
        mixed = mixed.withColumn("position", F.when(copies > 0, at(F.lit(0)))).withColumn("last_position", F.when(copies > 0, at(copies - 1)))
    return mixed.select(*[F.col(inner[c]).alias(c) for c in kept if c not in RESULTS], F.col("_size").alias("size"), *RESULTS[1:])


def in_training_order(mixed: DataFrame, spread: str = "doc_id") -> DataFrame:
    """Range-sorted by training position. Documents not taken come first, dealt over ranges of their own by a hash of `spread`."""
    keys = [F.col("position").asc_nulls_first(), F.xxhash64(F.col(spread), F.col("size"))]
    return mixed.repartitionByRange(*keys).sortWithinPartitions(F.col("position").asc_nulls_first())


def op4_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = cut(mix(read(spark, sf_dir, "documents"), keep=["doc_id"]))
    return in_training_order(mixed).select("doc_id", "size", "source_size", "target", "taken", "position", "last_position")


#: The same rules over whole sources at once.
OP4_SQL = """
WITH s AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')) AS o FROM documents),
src AS (SELECT source, CAST(sum(size) AS BIGINT) AS ss FROM s GROUP BY source),
w AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS nth, count(*) OVER () AS n, sum(ss) OVER () AS total FROM src),
v AS (SELECT *, CAST(CASE (nth - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS DOUBLE) AS weight FROM w),
st AS (SELECT *, (CAST(1.5 AS DOUBLE) * CAST(total AS DOUBLE) - coalesce(sum(CAST(2 AS DOUBLE) * ss) OVER (ORDER BY ss / weight, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(weight) OVER (ORDER BY ss / weight, nth ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rate FROM v),
lv AS (SELECT arg_min(rate, row(ss / weight, nth)) AS level FROM st WHERE rate * weight <= CAST(2 AS DOUBLE) * ss),
t AS (SELECT source, ss, least(CAST(2 AS DOUBLE) * ss, level * weight) AS target, CASE WHEN n > 1 THEN CAST(-0.5 AS DOUBLE) + (nth - 1) / CAST(n - 1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS a FROM st, lv),
d AS (SELECT s.doc_id, s.size, t.ss, t.target, t.a, CAST(coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY o, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM s JOIN t ON s.source IS NOT DISTINCT FROM t.source),
p AS (SELECT *, CASE WHEN ss > 0 THEN CAST(floor(target / ss) AS BIGINT) ELSE 0 END AS passes FROM d),
e AS (SELECT *, greatest(0, least(size, CAST(round(target - passes * ss) AS BIGINT) - before)) AS extra FROM p),
c AS (SELECT *, passes * size + extra AS taken, CASE WHEN passes * size + extra > 0 THEN passes + CAST(extra > 0 AS BIGINT) END AS copies FROM e),
u AS (SELECT *, before / greatest(target, CAST(1 AS DOUBLE)) AS u, (before + (copies - 1) * ss) / greatest(target, CAST(1 AS DOUBLE)) AS v FROM c)
SELECT doc_id, size, ss AS source_size, target, taken,
  CASE WHEN copies > 0 THEN least(CASE WHEN abs(a) < 1e-9 THEN u ELSE (sqrt((1 - a) * (1 - a) + 4 * a * u) - (1 - a)) / (2 * a) END, CAST(1 AS DOUBLE)) END AS position,
  CASE WHEN copies > 0 THEN least(CASE WHEN abs(a) < 1e-9 THEN v ELSE (sqrt((1 - a) * (1 - a) + 4 * a * v) - (1 - a)) / (2 * a) END, CAST(1 AS DOUBLE)) END AS last_position
FROM u
"""
