"""Mixing sources to target weights by capped water-filling, in DataFrame operations only.

A source's target is min(cap, level * weight), where cap is max_epochs times the
source's size and the level is such that the targets add up to share times all
sizes. Raising the level until the budget is spent is what clamping a source at
its cap and sharing the excess among the others, again and again, ends at. With
sources in order of cap/weight the capped ones come first, so the level is the
largest of (budget - caps before) / (weights from here on), one pass of running
sums over one row per source.

Repetitions: a source with target t and size s takes every document floor(t/s)
times, and some once more until t is reached. Which ones is seeded: documents
are ordered by md5(seed:doc_id), and those before a cut go once more. The cut
comes from sums over 65,536 hash buckets, narrowed down in two steps of 256, and
then from the documents of one bucket only, so no task sees all of a hot source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, materialize

WORD = r"[^\x20\x09-\x0D]+"
BUCKET_DIGITS = 4


def word_count(text: Column) -> Column:
    """Words of a text; a null text has none."""
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))), F.lit(0)).cast("long")


def _order_key(doc_id: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))))


def sized(docs: DataFrame, seed: int) -> DataFrame:
    """(doc_id, source, size, h): what the mix has to know of each document."""
    return docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), _order_key(F.col("doc_id"), seed).alias("h"))


def water_fill(sizes: DataFrame, share: float, max_epochs: float, weight_cycle: tuple[float, ...]) -> DataFrame:
    """(source, source_size) to (source, source_size, target); one row per source throughout.

    Sources by code point, null last, weigh weight_cycle, repeating.
    """
    ranked = sizes.select("source", "source_size", (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1).alias("rank"))
    weights = F.array(*[F.lit(float(w)) for w in weight_cycle])
    caps = ranked.select(
        "source",
        "source_size",
        F.element_at(weights, (F.col("rank") % len(weight_cycle) + 1).cast("int")).alias("weight"),
        (F.col("source_size") * F.lit(float(max_epochs))).alias("cap"),
        (F.sum("source_size").over(Window.partitionBy()) * F.lit(float(share))).alias("budget"),
    )
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    onwards = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    levels = caps.withColumn("level", (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(onwards))
    return levels.withColumn("top", F.max("level").over(Window.partitionBy())).select("source", "source_size", F.least(F.col("cap"), F.col("top") * F.col("weight")).alias("target"))


def mix_plan(narrow: DataFrame, share: float = 1.5, max_epochs: float = 2.0, weight_cycle: tuple[float, ...] = (5, 2, 1)) -> DataFrame:
    """One row per source: source, source_size, target, whole (repetitions of every document), cut.

    Documents whose h is below cut get one more repetition. narrow is read twice
    and should be a stored table, as sized() materialized.
    """
    bucket = F.substring("h", 1, BUCKET_DIGITS)
    sums = materialize(narrow.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("words")), "mix-buckets")
    targets = water_fill(sums.groupBy("source").agg(F.sum("words").alias("source_size")), share, max_epochs, weight_cycle)
    targets = targets.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    targets = materialize(targets.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")), "mix-targets")

    t = targets.select(F.col("source").alias("t_source"), "rest")
    # The cut's bucket by two digits, then by four among those that start alike: 256 rows a source each time.
    coarse = F.substring("bucket", 1, BUCKET_DIGITS // 2)
    top = sums.join(t, F.col("source").eqNullSafe(F.col("t_source"))).groupBy("source", coarse.alias("bucket"), "rest").agg(F.sum("words").alias("words"))
    top = materialize(_reaching(top.withColumn("base", F.lit(0))), "mix-top").select(F.col("source").alias("t_source"), F.col("bucket").alias("t_bucket"), "base", "rest")
    edge = _reaching(sums.join(top, F.col("source").eqNullSafe(F.col("t_source")) & (coarse == F.col("t_bucket"))).select("source", "bucket", "words", "base", "rest"))
    edge = edge.select(F.col("source").alias("e_source"), F.col("bucket").alias("e_bucket"), "base", "rest")
    inside = narrow.withColumn("bucket", bucket).join(edge, F.col("source").eqNullSafe(F.col("e_source")) & (F.col("bucket") == F.col("e_bucket")))
    # Equal keys (repeated ids) share one decision, so that the cut can stand between keys.
    keys = inside.groupBy("source", "h").agg(F.sum("size").alias("size"), F.first("base").alias("base"), F.first("rest").alias("rest"))
    before = F.col("base") + F.sum("size").over(Window.partitionBy("source").orderBy("h")) - F.col("size")
    cuts = (
        keys.withColumn("stays_out", 2 * before + F.col("size") >= 2 * F.col("rest"))
        .groupBy("source")
        .agg(F.min(F.when(F.col("stays_out"), F.col("h"))).alias("first_out"), F.max(F.substring("h", 1, BUCKET_DIGITS)).alias("bucket"))
        .select(F.col("source").alias("c_source"), F.coalesce("first_out", F.concat("bucket", F.lit("g"))).alias("cut"))
    )
    plan = targets.join(cuts, F.col("source").eqNullSafe(F.col("c_source")), "left")
    return materialize(plan.select("source", "source_size", "target", "whole", F.coalesce("cut", F.lit("")).alias("cut")), "mix-plan")


def _reaching(rows: DataFrame) -> DataFrame:
    """(source, bucket, base, rest): per source the first bucket in which base and the running sum of words reach rest; base is then what came before it."""
    upto = F.col("base") + F.sum("words").over(Window.partitionBy("source").orderBy("bucket"))
    reached = rows.withColumn("upto", upto).filter(F.col("upto") >= F.col("rest"))
    return reached.groupBy("source").agg(F.min(F.struct("bucket", (F.col("upto") - F.col("words")).alias("base"), "rest")).alias("e")).select("source", "e.*")


def _repeats(h: Column) -> Column:
    return F.col("whole") + F.when(h < F.col("cut"), 1).otherwise(0)


def taken(docs: DataFrame, seed: int = 7, **options) -> DataFrame:
    """(doc_id, size, source_size, target, repeats, taken), one row per document.

    A null text has size 0; a null source is a source of its own; an empty table
    gives an empty result; repeated ids of one source share the decision about
    the fractional repetition. Reruns agree.
    """
    narrow = materialize(sized(docs, seed), "mix-sizes")
    plan = mix_plan(narrow, **options).withColumnRenamed("source", "p_source")
    return narrow.join(plan, F.col("source").eqNullSafe(F.col("p_source"))).select("doc_id", "size", "source_size", "target", _repeats(F.col("h")).alias("repeats"), (F.col("size") * _repeats(F.col("h"))).alias("taken"))


def mix(docs: DataFrame, seed: int = 7, **options) -> DataFrame:
    """The mixed documents themselves, with the columns of docs: each document as often as the mix takes it.

    That is the whole repetitions of its source, and one more below the source's
    cut; null and empty texts, of size 0, follow the same rule. Rows that repeat an
    id of a source share the decision; a null source is a source; an empty table
    gives an empty result.
    """
    narrow = materialize(sized(docs, seed), "mix-sizes")
    p_source, h, again = (fresh(docs, x) for x in ("_mix_source", "_mix_h", "_mix_again"))
    plan = mix_plan(narrow, **options).select(F.col("source").alias(p_source), "whole", "cut")
    keyed = docs.withColumn(h, _order_key(F.col("doc_id"), seed))
    plan = plan.select(p_source, F.struct("whole", "cut").alias(again))
    repeats = F.col(again)["whole"] + F.when(F.col(h) < F.col(again)["cut"], 1).otherwise(0)
    joined = keyed.join(plan, docs["source"].eqNullSafe(plan[p_source]))
    return joined.withColumn(again, F.explode(F.array_repeat(F.lit(1), repeats.cast("int")))).select(*[F.col(f"`{c}`") for c in docs.columns])


#: DuckDB SQL for op10: running sums over whole sources, and the level by the same closed form.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5('7:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS h
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3) + 1]::DOUBLE AS weight,
             2.0::DOUBLE * source_size AS cap, 1.5::DOUBLE * sum(source_size) OVER () AS budget FROM s),
l AS (SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT source, source_size, least(cap, max(level) OVER () * weight) AS target FROM l),
r AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t),
k AS (SELECT source, h, sum(size) AS ksize FROM d GROUP BY source, h),
c AS (SELECT source, h, ksize, sum(ksize) OVER (PARTITION BY source ORDER BY h) - ksize AS before FROM k)
SELECT d.doc_id, d.size, r.source_size, r.target,
       CAST(r.whole + CASE WHEN 2 * c.before + c.ksize < 2 * (r.target - r.whole * r.source_size) THEN 1 ELSE 0 END AS BIGINT) AS repeats,
       CAST(d.size * (r.whole + CASE WHEN 2 * c.before + c.ksize < 2 * (r.target - r.whole * r.source_size) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source
       JOIN c ON d.source IS NOT DISTINCT FROM c.source AND d.h = c.h
"""
