"""Lookups, set operations and changes of single rows (SRC04, FLT07-13, JON13/15, SET, SNK03-07, SNK16)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import listing, merge, stats
from ..registry import query
from ..sources import catalog as c
from ..sources import files

V = c.with_views


@query(V("""
SELECT id, domain, offset_val FROM site WHERE domain = lower(split_part((SELECT max(n_name) FROM nation) || '.Example.com:8080', ':', 1)) AND is_active
""", c.SITE_SQL))  # fmt: skip
def site_by_host(spark: SparkSession, d: str) -> DataFrame:
    """The site of a request: its host without the port, if the site is active."""
    asked = c.table(spark, d, "nation").agg(F.concat(F.max("n_name"), F.lit(".Example.com:8080")).alias("host"))
    asked = asked.select(F.lower(F.split_part("host", F.lit(":"), F.lit(1))).alias("domain"))
    return c.sites(spark, d).where("is_active").join(F.broadcast(asked), "domain").select("id", "domain", "offset_val")


@query(V("""
SELECT id, title FROM novel WHERE starts_with(title, 'Order 1') OR starts_with(title, 'Chapter-')""", c.NOVEL_SQL))
def placeholder_titles(spark: SparkSession, d: str) -> DataFrame:
    title = F.col("title")
    return c.novels(spark, d, counted=False, authored=False).where(title.startswith("Order 1") | title.startswith("Chapter-")).select("id", "title")


@query("""
SELECT source, count(*) AS n FROM documents WHERE text IS NULL OR length(text) < 400 GROUP BY source ORDER BY n DESC, source LIMIT 20""")
def short_text_groups(spark: SparkSession, d: str) -> DataFrame:
    """Groups with texts to repair, the largest first."""
    docs = c.table(spark, d, "documents").where(F.col("text").isNull() | (F.length("text") < 400))
    return stats.top_groups(docs, "source", 20)


@query(V("""
, latest AS (SELECT max(ts) AS now FROM events),
oldest AS (SELECT * FROM task WHERE status = 'running' ORDER BY created_at, id LIMIT 5)
SELECT id, CAST(floor(epoch(now)) - floor(epoch(created_at)) AS BIGINT) AS seconds FROM oldest, latest
WHERE floor(epoch(now)) - floor(epoch(created_at)) > 600""", c.TASK_SQL))  # fmt: skip
def slow_running(spark: SparkSession, d: str) -> DataFrame:
    """Of the five tasks that run longest, those over the threshold."""
    now = c.table(spark, d, "events").agg(F.max("ts").alias("now"))
    oldest = c.tasks(spark, d).where(F.col("status") == "running").orderBy("created_at", "id").limit(5)
    seconds = F.unix_timestamp("now") - F.unix_timestamp("created_at")
    return c.beside(oldest, now).select("id", seconds.alias("seconds")).where(F.col("seconds") > 600)


@query("""
SELECT n_nationkey AS id, CASE WHEN n_nationkey % 3 = 0 THEN n_name WHEN n_nationkey % 3 = 1 THEN '第' || n_nationkey || '章' ELSE n_name || '!' END AS title,
       n_nationkey % 3 = 1 AS corrected FROM nation""")
def title_corrections(spark: SparkSession, d: str) -> DataFrame:
    """Titles found again by address replace those kept, where they hold CJK and differ."""
    nations = c.table(spark, d, "nation").withColumn("id", F.col("n_nationkey"))
    kind = F.col("id") % 3
    kept = nations.select("id", F.when(kind == 2, F.concat("n_name", F.lit("!"))).otherwise(F.col("n_name")).alias("title"))
    found = nations.select("id", F.when(kind == 1, F.concat(F.lit("第"), F.col("id").cast("string"), F.lit("章"))).otherwise(F.col("n_name")).alias("title"))
    return merge.correct_titles(kept, found, "id")


@query("""
WITH entries AS (
  SELECT 'k' || n_nationkey AS key, CASE WHEN n_nationkey % 2 = 0 THEN 'en' ELSE 'zh' END AS language, n_name AS value FROM nation WHERE n_nationkey % 5 <> 0
  UNION ALL SELECT 'k' || n_nationkey, 'zh', lower(n_name) FROM nation WHERE n_nationkey % 4 = 0)
SELECT k.key, coalesce(own.value, base.value, k.key) AS text FROM (SELECT 'k' || n_nationkey AS key FROM nation) k
LEFT JOIN (SELECT * FROM entries WHERE language = 'en') own ON own.key = k.key
LEFT JOIN (SELECT * FROM entries WHERE language = 'zh') base ON base.key = k.key""")
def dictionary_lookup(spark: SparkSession, d: str) -> DataFrame:
    """A key's text in a language, else in the base language, else the key."""
    nations = c.table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), "n_name", F.concat(F.lit("k"), F.col("n_nationkey").cast("string")).alias("key"))
    language = F.when(F.col("id") % 2 == 0, "en").otherwise("zh")
    entries = nations.where(F.col("id") % 5 != 0).select("key", language.alias("language"), F.col("n_name").alias("value"))
    entries = entries.unionAll(nations.where(F.col("id") % 4 == 0).select("key", F.lit("zh"), F.lower("n_name")))
    return files.translations(entries, "en", nations.select("key"))


@query("""
SELECT c_custkey AS id, 'both' AS side FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)
UNION ALL SELECT c_custkey, 'left' FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)""")
def set_sides(spark: SparkSession, d: str) -> DataFrame:
    """Intersection and difference of two sets of keys, as one union."""
    left = c.table(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    right = c.table(spark, d, "orders").select(F.col("o_custkey").alias("id"))
    both = left.join(right, "id", "left_semi").withColumn("side", F.lit("both"))
    return both.unionAll(left.join(right, "id", "left_anti").withColumn("side", F.lit("left")))


@query("""
SELECT p_partkey AS id, CASE WHEN p_partkey % 6 = 0 THEN p_brand ELSE p_name END AS title, p_type AS author FROM part""")
def update_set_fields(spark: SparkSession, d: str) -> DataFrame:
    """A partial update: what the change leaves null stays."""
    rows = c.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_type").alias("author"), "p_brand")
    changes = rows.where(F.col("id") % 2 == 0).select("id", F.when(F.col("id") % 3 == 0, F.col("p_brand")).alias("title"), F.lit(None).cast("string").alias("author"))
    return merge.update_ignoring_null(rows.drop("p_brand"), changes, "id", ["title", "author"])


@query("""
SELECT p_partkey AS id, CASE WHEN p_partkey % 4 = 0 THEN p_name || ' one more' ELSE p_name END AS content,
       CAST(CASE WHEN p_partkey % 4 = 0 THEN len(regexp_extract_all(p_name || ' one more', '[a-zA-Z]+')) ELSE -1 END AS INT) AS word_count FROM part""")
def update_content(spark: SparkSession, d: str) -> DataFrame:
    """Words are counted again where the text has changed, and only there."""
    rows = c.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("content"), F.lit(-1).alias("word_count"))
    more = F.when(F.col("id") % 4 == 0, F.concat("content", F.lit(" one more"))).otherwise(F.col("content"))
    return merge.update_content(rows, rows.where(F.col("id") % 2 == 0).select("id", more.alias("content")), "id")


@query("""
SELECT s_suppkey AS id, CASE WHEN s_suppkey % 3 <> 0 THEN 'https://example.com/' || s_suppkey END AS url FROM supplier""")
def script_links_dropped(spark: SparkSession, d: str) -> DataFrame:
    sid = F.col("s_suppkey").cast("string")
    url = F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("javascript:open("), sid, F.lit(")"))).otherwise(F.concat(F.lit("https://example.com/"), sid))
    return merge.drop_script_links(c.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), url.alias("url")), "url")


@query(V("""
SELECT id, novel_id FROM chapter WHERE novel_id NOT IN (SELECT id FROM novel WHERE status = 'completed')""", c.CHAPTER_SQL, c.NOVEL_SQL))
def cascade_delete(spark: SparkSession, d: str) -> DataFrame:
    """Chapters that are left once the completed novels and all of theirs are gone."""
    gone = c.novels(spark, d, counted=False, authored=False).where(F.col("status") == "completed").select(F.col("id").alias("novel_id"))
    return merge.delete(c.chapters(spark, d), gone, "novel_id").select("id", "novel_id")


@query(V("""
SELECT count(*) FILTER (title IS NULL OR title = '') AS without_title, count(*) FILTER (author IS NULL OR author = '') AS without_author,
       count(*) FILTER (total_chapters = 0) AS without_chapters, greatest(1, count(*)) AS total FROM novel""", c.NOVEL_SQL))  # fmt: skip
def missing_fields(spark: SparkSession, d: str) -> DataFrame:
    """How many novels lack what; the total is at least 1, so that shares can be formed."""
    return c.novels(spark, d).agg(
        F.count_if(listing.missing("title")).alias("without_title"),
        F.count_if(listing.missing("author")).alias("without_author"),
        F.count_if(F.col("total_chapters") == 0).alias("without_chapters"),
        F.greatest(F.lit(1), F.count(F.lit(1))).alias("total"),
    )


@query("""
SELECT conv_id, turn, line, row_number() OVER (PARTITION BY conv_id, turn ORDER BY pos) - 1 AS idx FROM (
  SELECT conv_id, turn, unnest(range(len(string_split(text, '. ')))) AS pos, trim(unnest(string_split(text, '. '))) AS line FROM conversations)
WHERE line <> ''""")
def pasted_lines(spark: SparkSession, d: str) -> DataFrame:
    """Parts of a pasted text, trimmed, without the empty ones, numbered anew."""
    parts = F.filter(F.transform(F.split("text", r"\. "), F.trim), lambda x: x != "")
    rows = c.table(spark, d, "conversations").select("conv_id", "turn", F.posexplode(parts).alias("idx", "line"))
    return rows.select("conv_id", "turn", "line", F.col("idx").cast("long").alias("idx"))


@query("""
SELECT p_partkey AS id, regexp_matches(t, '[一-鿿]') AS translatable FROM (
  SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_name WHEN p_partkey % 3 = 1 THEN '12 345' ELSE '第' || p_partkey || '章' END AS t FROM part)""")
def needs_translation(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("p_partkey")
    shown = F.when(key % 3 == 0, F.col("p_name")).when(key % 3 == 1, F.lit("12 345")).otherwise(F.concat(F.lit("第"), key.cast("string"), F.lit("章")))
    return c.table(spark, d, "part").select(key.alias("id"), text.translatable(shown).alias("translatable"))
