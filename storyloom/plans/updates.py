"""Writes, leases and crawl merges (SNK, CMP08, CMP12)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import merge
from ..registry import query
from ..sources import catalog as c

V = c.with_views


@query(V("""
SELECT id, novel_id, CASE WHEN word_count > 40 THEN sort_order + 100 ELSE sort_order END AS sort_order FROM chapter""", c.CHAPTER_SQL))
def reorder_case_update(spark: SparkSession, d: str) -> DataFrame:
    rows = c.chapters(spark, d)
    orders = rows.where(F.col("word_count") > 40).select("id", (F.col("sort_order") + 100).alias("sort_order")).distinct()
    return merge.reorder(rows, orders).select("id", "novel_id", "sort_order")


@query("""
WITH old AS (SELECT p_partkey AS id, CASE WHEN p_size % 3 = 0 THEN '' WHEN p_size % 3 = 1 THEN p_name END AS title FROM part WHERE p_partkey % 4 <> 0),
new AS (SELECT p_partkey AS id, p_brand AS title FROM part WHERE p_partkey % 2 = 0)
SELECT coalesce(old.id, new.id) AS id, coalesce(nullif(old.title, ''), new.title, old.title) AS title FROM old FULL JOIN new ON old.id = new.id""")  # fmt: skip
def upsert_fill(spark: SparkSession, d: str) -> DataFrame:
    parts = c.table(spark, d, "part").withColumn("id", F.col("p_partkey"))
    title = F.when(F.col("p_size") % 3 == 0, F.lit("")).when(F.col("p_size") % 3 == 1, F.col("p_name"))
    old = parts.where(F.col("id") % 4 != 0).select("id", title.alias("title"))
    new = parts.where(F.col("id") % 2 == 0).select("id", F.col("p_brand").alias("title"))
    return merge.fill_missing(old, new, "id", ["title"])


@query("""
SELECT p_partkey AS id, p_name AS title FROM part WHERE p_partkey % 4 <> 0
UNION ALL SELECT p_partkey, p_brand FROM part WHERE p_partkey % 4 = 0""")
def insert_if_absent(spark: SparkSession, d: str) -> DataFrame:
    parts = c.table(spark, d, "part").withColumn("id", F.col("p_partkey"))
    old = parts.where(F.col("id") % 4 != 0).select("id", F.col("p_name").alias("title"))
    return merge.insert_absent(old, parts.where(F.col("id") % 2 == 0).select("id", F.col("p_brand").alias("title")), "id")


@query(V("""
, latest AS (SELECT max(ts) AS now FROM events)
SELECT id, CASE WHEN status = 'running' AND created_at < now - INTERVAL 600 SECOND THEN 'pending' ELSE status END AS status,
       status = 'running' AND created_at < now - INTERVAL 600 SECOND AS was_stuck
FROM task, latest""", c.TASK_SQL))  # fmt: skip
def reset_stuck(spark: SparkSession, d: str) -> DataFrame:
    now = c.table(spark, d, "events").agg(F.max("ts").alias("now"))
    return merge.reset_stuck(c.beside(c.tasks(spark, d), now), F.col("now")).select("id", "status", "was_stuck")


@query("""
SELECT user_id AS id, free AS taken, CASE WHEN free THEN 'runner' ELSE owner END AS owner FROM (
  SELECT *, owner IS NULL OR owner = '' OR locked_at IS NULL OR epoch(TIMESTAMP '2024-01-20') - floor(epoch(locked_at)) > 864000 AS free FROM (
    SELECT user_id, max(ts) AS locked_at, CASE WHEN user_id % 3 <> 0 THEN CASE WHEN user_id % 5 = 0 THEN '' ELSE 'other' END END AS owner
    FROM events GROUP BY user_id))""")
def lease_upsert(spark: SparkSession, d: str) -> DataFrame:
    held = F.when(F.col("id") % 3 != 0, F.when(F.col("id") % 5 == 0, F.lit("")).otherwise(F.lit("other")))
    locks = c.table(spark, d, "events").groupBy(F.col("user_id").alias("id")).agg(F.max("ts").alias("locked_at"))
    locks = locks.withColumn("owner", held).withColumn("ttl", F.lit(864_000))
    return merge.lease(locks, "runner", F.lit("2024-01-20").cast("timestamp")).select("id", "taken", "owner")


@query(V("""
SELECT id, novel_id FROM task t WHERE status = 'running' OR NOT (t.id % 3 = 0)""", c.TASK_SQL))  # fmt: skip
def delete_but_running(spark: SparkSession, d: str) -> DataFrame:
    rows = c.tasks(spark, d)
    return merge.delete(rows, rows.where(F.col("id") % 3 == 0), "id", keep=F.col("status") == "running").select("id", "novel_id")


@query(V("\nSELECT id, 'running' AS status FROM task WHERE status = 'pending' ORDER BY created_at, id LIMIT 8", c.TASK_SQL))
def claim_batch(spark: SparkSession, d: str) -> DataFrame:
    return merge.claim(c.tasks(spark, d), 8).select("id", "status")


@query(("""
SELECT o_orderkey AS id, 'Order ' || o_orderkey AS title, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS total_chapters FROM orders"""))
def recount_chapters(spark: SparkSession, d: str) -> DataFrame:
    """A counter that went wrong is counted again from the chapters."""
    wrong = c.novels(spark, d, counted=False, authored=False).withColumn("total_chapters", F.lit(-1))
    return merge.recount(wrong, c.chapters(spark, d)).select("id", "title", "total_chapters")


@query(V("""
, top AS (SELECT novel_id, max(sort_order) AS n FROM chapter GROUP BY 1),
new AS (SELECT conv_id AS novel_id, turn, left(text, 30) AS title, text FROM conversations WHERE regexp_matches(trim(left(text, 30)), '[a-zA-Z]{3,}'))
SELECT new.novel_id, new.title, coalesce(n, 0) + row_number() OVER (PARTITION BY new.novel_id ORDER BY turn) AS sort_order,
       CAST(len(regexp_extract_all(text, '[a-zA-Z]+')) AS INT) AS word_count
FROM new LEFT JOIN top ON top.novel_id = new.novel_id""", c.CHAPTER_SQL))  # fmt: skip
def batch_insert(spark: SparkSession, d: str) -> DataFrame:
    new = c.table(spark, d, "conversations").select(
        F.col("conv_id").alias("novel_id"), F.col("turn").alias("position"), F.left("text", F.lit(30)).alias("title"), F.col("text").alias("content")
    )
    return merge.append_chapters(c.chapters(spark, d), new).select("novel_id", "title", "sort_order", "word_count")
