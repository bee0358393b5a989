"""Window operators: latest, top-k, neighbours, islands, deltas, resampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: the volume of chapters before the first named one.
FIRST_VOLUME = "正文"


def first_per_key(rows: DataFrame, key: str | Sequence[str], order: Sequence[Column], size: int = 1, rank: str | None = None) -> DataFrame:
    """The first ``size`` rows of each key in a total order; Spark limits groups before the shuffle."""
    keys = [key] if isinstance(key, str) else list(key)
    numbered = rows.withColumn("__rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    kept = numbered.where(F.col("__rank") <= size)
    return kept.withColumnRenamed("__rank", rank) if rank else kept.drop("__rank")


def latest_chapter(chapters: DataFrame) -> DataFrame:
    return first_per_key(chapters, "novel_id", [F.desc("sort_order"), F.desc("id")])


def with_neighbours(chapters: DataFrame) -> DataFrame:
    """The chapters of the next lower and next higher place; those of the same place do not count.

    Both frames only grow, the second in turned order, so a novel takes time in proportion to its chapters.
    """
    before = Window.partitionBy("novel_id").orderBy("sort_order").rangeBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("novel_id").orderBy(F.desc("sort_order")).rangeBetween(Window.unboundedPreceding, -1)
    here = F.struct("sort_order", "id")
    return chapters.withColumn("prev_id", F.max(here).over(before)["id"]).withColumn("next_id", F.min(here).over(after)["id"])


def volumes(chapters: DataFrame, order: Sequence[str] = ("sort_order", "id")) -> DataFrame:
    """Runs of chapters of one volume: a blank volume takes the last named one before it.

    Novels of a single run have no volumes to show and give no row.
    """
    window = Window.partitionBy("novel_id").orderBy(*order)
    named = F.nullif(F.trim("volume"), F.lit(""))
    filled = F.coalesce(F.last(named, True).over(window.rowsBetween(Window.unboundedPreceding, 0)), F.lit(FIRST_VOLUME))
    runs = (
        chapters.withColumn("volume", filled)
        .withColumn("starts", F.coalesce(F.lag("volume").over(window) != F.col("volume"), F.lit(True)).cast("int"))
        .withColumn("island", F.sum("starts").over(window.rowsBetween(Window.unboundedPreceding, 0)))
    )
    grouped = runs.groupBy("novel_id", "island").agg(
        F.first("volume").alias("volume"),
        F.count(F.lit(1)).alias("chapters"),
        F.min("sort_order").alias("first_order"),
        F.max("sort_order").alias("last_order"),
    )
    several = F.count(F.lit(1)).over(Window.partitionBy("novel_id"))
    return grouped.withColumn("runs", several).where(F.col("runs") > 1).drop("runs")


def speed(snapshots: DataFrame, done: str, left: str, time: str, *by: str) -> DataFrame:
    """Work done since the snapshot before, per minute, and the minutes that the rest would take."""
    window = Window.partitionBy(*by).orderBy(time)
    minutes = (F.unix_timestamp(time) - F.unix_timestamp(F.lag(time).over(window))) / 60
    rate = F.when(minutes > 0, (F.col(done) - F.lag(done).over(window)) / minutes)
    return snapshots.withColumn("per_minute", F.bround(rate, 4)).withColumn(
        "eta_minutes", F.when(F.col("per_minute") > 0, F.bround(F.col(left) / F.col("per_minute"), 1))
    )


def restart_decision(cycles: DataFrame, time: str, *by: str) -> DataFrame:
    """Restart where work is pending, nothing runs, and neither fewer wait nor more are done than before."""
    window = Window.partitionBy(*by).orderBy(time)
    progress = (F.col("pending") < F.lag("pending").over(window)) | (F.col("completed") > F.lag("completed").over(window))
    return cycles.withColumn("progressed", F.coalesce(progress, F.lit(False))).withColumn(
        "restart", (F.col("pending") > 0) & ~F.col("progressed") & F.lag("pending").over(window).isNotNull()
    )


def sampled_progress(rows: DataFrame, order: Sequence[str], *by: str) -> DataFrame:
    """The first three rows of each group, and each twentieth of it."""
    numbered = rows.withColumn("current", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).withColumn(
        "total", F.count(F.lit(1)).over(Window.partitionBy(*by))
    )
    step = F.greatest(F.lit(1), F.floor(F.col("total") / 20))
    return numbered.where((F.col("current") <= 3) | (F.pmod(F.col("current"), step) == 0))


def before_known(items: DataFrame, known: Column, position: str, *by: str) -> DataFrame:
    """Items before the first known one of their group; all of them if none is known."""
    first = F.min(F.when(known, F.col(position))).over(Window.partitionBy(*by))
    return items.withColumn("__cut", first).where(F.col("__cut").isNull() | (F.col(position) < F.col("__cut"))).drop("__cut")


def fill_down(rows: DataFrame, value: str, order: str, *by: str) -> DataFrame:
    """Each row gets the last value at or before it, as rows under a header do."""
    window = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(value, F.last(value, True).over(window))


def watchdog(cycles: DataFrame, time: str, *by: str) -> DataFrame:
    """Adds ``progressed``, ``restart`` and its ``reason`` to cycles of ``alive``, ``stuck``, ``pending``, ``running`` and ``completed``.

    A dead runner is started again, as is one with stuck tasks; a live one only if work waits, nothing runs, and neither
    fewer wait nor more are done than in the cycle before (none is before the first).
    """
    window = Window.partitionBy(*by).orderBy(time)
    moved = (F.col("pending") < F.lag("pending").over(window)) | (F.col("completed") > F.lag("completed").over(window))
    told = cycles.withColumn("progressed", F.coalesce(moved, F.lit(False)))
    idle = (F.col("pending") > 0) & (F.col("running") == 0) & ~F.col("progressed")
    reason = F.when(~F.col("alive"), "dead").when(F.col("stuck") > 0, "stuck").when(idle, "idle")
    return told.withColumn("reason", reason).withColumn("restart", F.col("reason").isNotNull())
