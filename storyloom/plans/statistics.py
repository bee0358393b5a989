"""Statistics, monitors and reports (AGG, WIN05-09, CMP09-11, CMP14-15)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numbers
from ..operators import listing, stats, windows
from ..registry import query
from ..sources import catalog as c

V = c.with_views


@query(V("""
SELECT novel_id, count(*) AS total_chapters, count(*) FILTER (is_published) AS published_chapters,
       CAST(coalesce(sum(word_count), 0) AS BIGINT) AS total_words, max(updated_at) AS last_updated
FROM chapter GROUP BY novel_id""", c.CHAPTER_SQL))  # fmt: skip
def novel_statistics(spark: SparkSession, d: str) -> DataFrame:
    return stats.novel_statistics(c.chapters(spark, d))


_COUNTS = ", ".join(f"count(*) FILTER (status = '{s}') AS {s}" for s in stats.STATES) + ", count(*) AS total"


@query(V(f"SELECT strftime(created_at, '%Y-%m-%d') AS day, {_COUNTS} FROM task GROUP BY 1", c.TASK_SQL))
def status_pivot(spark: SparkSession, d: str) -> DataFrame:
    return stats.state_counts(c.tasks(spark, d).withColumn("day", F.date_format("created_at", "yyyy-MM-dd")), "day")


@query(V(f"""
SELECT *, round_even((completed + failed) * 100.0::DOUBLE / total, 1) AS queue_percent, round_even(completed * 100.0::DOUBLE / greatest(total, 1), 1) AS system_percent
FROM (SELECT {_COUNTS} FROM task)""", c.TASK_SQL))  # fmt: skip
def queue_progress(spark: SparkSession, d: str) -> DataFrame:
    return stats.queue_progress(stats.state_counts(c.tasks(spark, d)))


@query(V("""
SELECT (SELECT count(*) FROM orders) AS novels, (SELECT count(*) FROM lineitem) AS chapters,
       (SELECT CAST(coalesce(sum(word_count), 0) AS BIGINT) FROM chapter) AS words,
       (SELECT count(*) FROM task) AS tasks, (SELECT round_even(count(*) FILTER (status = 'completed') * 100.0::DOUBLE / greatest(count(*), 1), 1) FROM task) AS progress
""", c.CHAPTER_SQL, c.TASK_SQL))  # fmt: skip
def system_stats(spark: SparkSession, d: str) -> DataFrame:
    """Three one-row aggregates side by side."""
    chapters = c.chapters(spark, d).agg(F.count(F.lit(1)).alias("chapters"), F.coalesce(F.sum("word_count"), F.lit(0)).cast("long").alias("words"))
    novels = c.table(spark, d, "orders").agg(F.count(F.lit(1)).alias("novels"))
    tasks = stats.queue_progress(stats.state_counts(c.tasks(spark, d))).select(F.col("total").alias("tasks"), F.col("system_percent").alias("progress"))
    keyed = [x.withColumn("__one", F.lit(1)) for x in (novels, chapters, tasks)]
    return keyed[0].join(keyed[1], "__one").join(keyed[2], "__one").drop("__one")


@query("""
SELECT count(*) AS total, count(*) FILTER (text IS NULL OR text = '') AS empty_texts, count(*) FILTER (length(text) < 200) AS short_texts,
       count(*) FILTER (quality IS NULL) AS unlabelled, count(*) FILTER (quality = 0) AS low_quality
FROM documents LEFT JOIN labels USING (doc_id)""")
def quality_counts(spark: SparkSession, d: str) -> DataFrame:
    return stats.quality_counts(c.table(spark, d, "documents").select("doc_id", "text"), c.table(spark, d, "labels").select("doc_id", "quality"))


@query("SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, l_suppkey LIMIT 50")
def top50_groups(spark: SparkSession, d: str) -> DataFrame:
    return stats.top_groups(c.table(spark, d, "lineitem"), "l_suppkey", 50)


@query(V("\nSELECT novel_id, coalesce(max(sort_order), 0) + 1 AS next_order FROM chapter GROUP BY 1", c.CHAPTER_SQL))
def next_sort_order(spark: SparkSession, d: str) -> DataFrame:
    return stats.next_order(c.chapters(spark, d), "novel_id", "sort_order")


@query("""
SELECT event_type, count(*) AS requests, round(avg(value), 4) AS mean_value, min(value) AS min_value, max(value) AS max_value,
       list_sort(list(value))[CAST(least(floor(count(*) * 0.5::DOUBLE), count(*) - 1) AS BIGINT) + 1] AS p50,
       list_sort(list(value))[CAST(least(floor(count(*) * 0.9::DOUBLE), count(*) - 1) AS BIGINT) + 1] AS p90,
       list_sort(list(value))[CAST(least(floor(count(*) * 0.99::DOUBLE), count(*) - 1) AS BIGINT) + 1] AS p99
FROM events GROUP BY 1""")  # fmt: skip
def latency_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return stats.nearest_rank(c.table(spark, d, "events").select("event_type", "value"), "value", ["event_type"])


@query("""
SELECT user_id % 10 AS page_type, count(*) FILTER (event_type <> 'error') AS served, count(*) FILTER (event_type = 'error') AS errors,
       round(avg(value) FILTER (event_type <> 'error'), 4) AS mean_ms,
       round_even(count(*) FILTER (event_type = 'error') * 100.0::DOUBLE / count(*), 1) AS error_percent
FROM events GROUP BY 1""")
def traffic_by_page(spark: SparkSession, d: str) -> DataFrame:
    error = F.col("event_type") == "error"
    return (
        c.table(spark, d, "events")
        .groupBy((F.col("user_id") % 10).alias("page_type"))
        .agg(
            F.count_if(~error).alias("served"),
            F.count_if(error).alias("errors"),
            F.round(F.avg(F.when(~error, F.col("value"))), 4).alias("mean_ms"),
            stats.percent(F.count_if(error), F.count(F.lit(1))).alias("error_percent"),
        )
    )


_DAYS = f"""days AS (
  SELECT date_trunc('day', created_at) AS day, {_COUNTS} FROM task GROUP BY 1),
snapshots AS (
  SELECT day, CAST(sum(completed + failed) OVER w AS BIGINT) AS done, CAST(sum(pending) OVER w AS BIGINT) AS pending, CAST(sum(completed) OVER w AS BIGINT) AS completed
  FROM days WINDOW w AS (ORDER BY day ROWS UNBOUNDED PRECEDING))"""


def _snapshots(spark: SparkSession, d: str) -> DataFrame:
    """The queue at the end of each day: days are few, so the running sums run over a small aggregate."""
    from pyspark.sql import Window

    days = stats.state_counts(c.tasks(spark, d).withColumn("day", F.date_trunc("day", "created_at")), "day")
    upto = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return days.select(
        "day", F.sum(F.col("completed") + F.col("failed")).over(upto).alias("done"), F.sum("pending").over(upto).alias("pending"),
        F.sum("completed").over(upto).alias("completed"),
    )


@query(V("""
SELECT day, done, pending, completed, per_minute, CASE WHEN per_minute > 0 THEN round_even(pending / per_minute, 1) END AS eta_minutes FROM (
  SELECT *, round_even((done - lag(done) OVER (ORDER BY day)) / (date_diff('second', lag(day) OVER (ORDER BY day), day) / 60.0::DOUBLE), 4) AS per_minute
  FROM snapshots)""", c.TASK_SQL, _DAYS))  # fmt: skip
def snapshot_speed_eta(spark: SparkSession, d: str) -> DataFrame:
    return windows.speed(_snapshots(spark, d), "done", "pending", "day")


@query(V("""
SELECT day, done, pending, completed, progressed, pending > 0 AND NOT progressed AND was IS NOT NULL AS restart FROM (
  SELECT *, coalesce(pending < lag(pending) OVER (ORDER BY day) OR completed > lag(completed) OVER (ORDER BY day), false) AS progressed,
         lag(pending) OVER (ORDER BY day) AS was FROM snapshots)""", c.TASK_SQL, _DAYS))  # fmt: skip
def watchdog_decisions(spark: SparkSession, d: str) -> DataFrame:
    return windows.restart_decision(_snapshots(spark, d), "day")


@query(V("""
SELECT novel_id, id, current, total FROM (
  SELECT novel_id, id, row_number() OVER (PARTITION BY novel_id ORDER BY created_at, id) AS current, count(*) OVER (PARTITION BY novel_id) AS total FROM task)
WHERE current <= 3 OR current % greatest(1, CAST(floor(total / 20) AS BIGINT)) = 0""", c.TASK_SQL))  # fmt: skip
def progress_samples(spark: SparkSession, d: str) -> DataFrame:
    return windows.sampled_progress(c.tasks(spark, d), ["created_at", "id"], "novel_id").select("novel_id", "id", "current", "total")


@query(V("""
, latest AS (SELECT max(ts) AS now FROM events)
SELECT count(*) FILTER (status = 'running') AS running, count(*) FILTER (status = 'running' AND created_at < now - INTERVAL 600 SECOND) AS stuck
FROM task, latest""", c.TASK_SQL))  # fmt: skip
def queue_status(spark: SparkSession, d: str) -> DataFrame:
    now = c.table(spark, d, "events").agg(F.max("ts").alias("now"))
    running = F.col("status") == "running"
    stuck = running & (F.col("created_at") < F.col("now") - F.make_dt_interval(secs=F.lit(600)))
    return c.beside(c.tasks(spark, d), now).agg(F.count_if(running).alias("running"), F.count_if(stuck).alias("stuck"))


@query("""
SELECT doc_id FROM documents WHERE contains(text, 'idiot') OR contains(text, 'Licensed') OR contains(text, 'Copyright')""")
def keyword_hits(spark: SparkSession, d: str) -> DataFrame:
    """One pass over the texts for all words, and no cap on the hits."""
    docs = c.table(spark, d, "documents").select("doc_id", "text")
    return docs.where(listing.contains_any(("idiot", "Licensed", "Copyright"), "text")).select("doc_id")


@query("""
SELECT n_nationkey AS id, n_nationkey * 30000000 / 86400.0::DOUBLE AS needed, CAST(round(540 + n_nationkey / 100.0 * 1200) AS INT) AS width FROM nation""")
def capacity_projection(spark: SparkSession, d: str) -> DataFrame:
    sites = c.table(spark, d, "nation").select(F.col("n_nationkey").alias("id"))
    return sites.select("id", numbers.needed_rate(F.col("id"), F.lit(30_000_000)).alias("needed"), numbers.page_size_estimate(F.col("id")).alias("width"))


@query("""
SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS price, count(DISTINCT o_custkey) AS authors FROM orders GROUP BY 1""")
def novels_by_status(spark: SparkSession, d: str) -> DataFrame:
    return c.table(spark, d, "orders").groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("price"), F.countDistinct("o_custkey").alias("authors")
    )


@query("""
SELECT hits, total, CASE WHEN total > 0 THEN round_even(hits * 100.0::DOUBLE / total, 1) ELSE 0.0 END AS hit_percent FROM (
  SELECT count(*) FILTER (event_type = 'view') AS hits, count(*) AS total FROM events)""")
def cache_hit_rate(spark: SparkSession, d: str) -> DataFrame:
    counted = c.table(spark, d, "events").agg(F.count_if(F.col("event_type") == "view").alias("hits"), F.count(F.lit(1)).alias("total"))
    return counted.withColumn("hit_percent", stats.percent(F.col("hits"), F.col("total")))
