"""Counts, sums, percentiles and progress figures, each in one pass."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATES = ("pending", "running", "completed", "failed")
QUANTILES = (0.5, 0.9, 0.99)
#: The sketch errs by at most one in so many ranks; a quantile is looked for this many times as far.
ACCURACY, SLACK = 10_000, 3


def novel_statistics(chapters: DataFrame) -> DataFrame:
    return chapters.groupBy("novel_id").agg(
        F.count(F.lit(1)).alias("total_chapters"),
        F.count_if("is_published").alias("published_chapters"),
        F.coalesce(F.sum("word_count"), F.lit(0)).cast("long").alias("total_words"),
        F.max("updated_at").alias("last_updated"),
    )


def state_counts(tasks: DataFrame, *by: str) -> DataFrame:
    """A column for each state and ``total``; states nobody has count 0."""
    return tasks.groupBy(*by).agg(
        *[F.count_if(F.col("status") == s).alias(s) for s in STATES], F.count(F.lit(1)).alias("total")
    )


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    """A share in hundredths, rounded half to even; 0 where there is no whole."""
    return F.when(whole > 0, F.bround(part * 100.0 / whole, digits)).otherwise(F.lit(0.0))


def queue_progress(counts: DataFrame) -> DataFrame:
    """Finished work counts failed tasks too; the system page counts completed ones only."""
    done = F.col("completed") + F.col("failed")
    return counts.withColumn("queue_percent", percent(done, F.col("total"))).withColumn(
        "system_percent", percent(F.col("completed"), F.greatest("total", F.lit(1)))
    )


def top_groups(rows: DataFrame, key: str, size: int) -> DataFrame:
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.asc(key)).limit(size)


def next_order(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The place after the last of each group."""
    return rows.groupBy(key).agg((F.coalesce(F.max(order), F.lit(0)) + 1).alias("next_order"))


def nearest_rank(rows: DataFrame, value: str, by: Sequence[str] = (), quantiles: Sequence[float] = QUANTILES) -> DataFrame:
    """Least, mean, greatest value and the quantiles ``sorted[int(n * q)]`` of each group.

    A sketch of known error first tells two values around each quantile. Of each group, only the
    distinct values between those two are then put in order, after one row that counts all lower
    ones, so what is sorted for a group is a fixed small share of it. Null values are left out. Should
    a sketch be off by more than its bound, the job fails rather than tell a wrong rank.
    """
    from pyspark.sql import Window

    there = rows.where(F.col(value).isNotNull())
    edges = [min(max(q + side * SLACK / ACCURACY, 0.0), 1.0) for q in quantiles for side in (-1, 1)]
    spans = there.groupBy(*by).agg(
        F.count(F.lit(1)).alias("requests"),
        F.round(F.avg(value), 4).alias("mean_value"),
        F.min(value).alias("min_value"),
        F.max(value).alias("max_value"),
        F.percentile_approx(value, edges, ACCURACY).alias("edges"),
    )
    spans = spans.withColumnsRenamed({c: f"__{c}" for c in by})
    same_group = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by] or F.lit(True)
    counted = there.groupBy(*by, value).agg(F.count(F.lit(1)).alias("n")).join(spans, same_group)
    around = [
        F.struct(F.lit(k).alias("k"), F.col("edges")[2 * k].alias("low"), F.col("edges")[2 * k + 1].alias("high"), F.least(F.floor(F.col("requests") * F.lit(q)), F.col("requests") - 1).alias("rank"))
        for k, q in enumerate(quantiles)
    ]
    figures = ("requests", "mean_value", "min_value", "max_value")
    near = counted.withColumn("at", F.explode(F.array(*around))).where(F.col(value) <= F.col("at.high"))
    kept = near.groupBy(*by, "at.k", F.when(F.col(value) >= F.col("at.low"), F.col(value)).alias("__value")).agg(
        F.sum("n").alias("n"), F.first("at.rank").alias("rank"), *[F.first(c).alias(c) for c in figures]
    )
    order = Window.partitionBy(*by, "k").orderBy(F.asc_nulls_first("__value")).rowsBetween(Window.unboundedPreceding, 0)
    ranked = kept.withColumn("upto", F.sum("n").over(order))
    # The rank must lie behind what is counted below, and before the last value that is kept: else the sketch erred by more than it may.
    reached = F.col("upto") > F.col("rank")
    made = ranked.groupBy(*by).agg(
        *[F.first(c).alias(c) for c in figures],
        *[F.min(F.when((F.col("k") == k) & reached, F.col("__value"))).alias(f"p{round(q * 100)}") for k, q in enumerate(quantiles)],
        F.max(F.when(F.col("__value").isNull(), reached)).alias("__astray"),
    )
    wrong = F.coalesce(F.col("__astray"), F.lit(False))
    for q in quantiles:
        wrong = wrong | F.col(f"p{round(q * 100)}").isNull()
    sure = [F.when(wrong, F.raise_error(F.lit("a sketch of ranks is off by more than its bound; raise ACCURACY or SLACK"))).otherwise(F.col(c)).alias(c) for c in (f"p{round(q * 100)}" for q in quantiles)]
    return made.select(*by, *figures, *sure)


def quality_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Empty texts, short ones, and those without a label, in one scan."""
    joined = docs.join(labels, "doc_id", "left")
    return joined.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("text").isNull() | (F.col("text") == "")).alias("empty_texts"),
        F.count_if(F.length("text") < 200).alias("short_texts"),
        F.count_if(F.col("quality").isNull()).alias("unlabelled"),
        F.count_if(F.col("quality") == 0).alias("low_quality"),
    )
