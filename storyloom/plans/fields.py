"""Transforms of single fields: rules, magnitudes, labels, JSON, addresses (STR10-20, STR26-36, JSN, DAT, MTH, STM03)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import numbers, text
from ..registry import query
from ..sources import catalog as c


@query("""
SELECT p_partkey AS id, CASE WHEN starts_with(p_brand, 'Brand') THEN substr(p_brand, 6) ELSE p_brand END AS no_prefix,
       CASE WHEN ends_with(p_type, 'D') THEN left(p_type, length(p_type) - 1) ELSE p_type END AS no_suffix,
       CASE WHEN regexp_matches(p_brand, '([0-9])[0-9]*$') THEN regexp_extract(p_brand, '([0-9])[0-9]*$', 1) ELSE p_brand END AS captured,
       lower(p_type) AS low FROM part""")
def rule_transforms(spark: SparkSession, d: str) -> DataFrame:
    """A rule's transforms; a pattern that does not match leaves the value as it is."""
    brand, kind = F.col("p_brand"), F.col("p_type")
    return c.table(spark, d, "part").select(
        F.col("p_partkey").alias("id"),
        text.apply_transform(brand, "prefix", "Brand").alias("no_prefix"),
        text.apply_transform(kind, "suffix", "D").alias("no_suffix"),
        text.apply_transform(brand, "regex", "([0-9])[0-9]*$").alias("captured"),
        text.apply_transform(kind, "lower").alias("low"),
    )


@query("""
SELECT p_partkey AS id, CASE WHEN n >= 10000 THEN printf('%.1f', n / 10000.0::DOUBLE) || '万' ELSE format('{:,}', n) END AS shown,
       CASE WHEN p_partkey % 2 = 0 THEN p_size * 10000 + 5000 ELSE p_size END AS parsed
FROM (SELECT *, p_partkey * 1234 + 7 AS n FROM part)""")
def magnitudes(spark: SparkSession, d: str) -> DataFrame:
    """Counts in ten thousands, written and read."""
    key, size = F.col("p_partkey"), F.col("p_size").cast("string")
    written = F.when(key % 2 == 0, F.concat(size, F.lit(".5 万字"))).otherwise(F.concat(size, F.lit("字")))
    return c.table(spark, d, "part").select(
        key.alias("id"), numbers.format_magnitude(key * 1234 + 7).alias("shown"), numbers.parse_magnitude(written).alias("parsed")
    )


@query("""
SELECT event_id, CAST(to_json({'task': user_id, 'type': event_type}) AS VARCHAR) AS payload,
       coalesce(CAST(json_extract(props, '$.page.enabled') AS BOOLEAN), true) AS enabled, coalesce(CAST(json_extract(props, '$.k') AS BIGINT), 0) > 50 AS large
FROM events""")
def json_fields(spark: SparkSession, d: str) -> DataFrame:
    """Payloads written as JSON, and settings read from it with defaults."""
    payload = F.to_json(F.struct(F.col("user_id").alias("task"), F.col("event_type").alias("type")))
    enabled = F.coalesce(F.get_json_object("props", "$.page.enabled").cast("boolean"), F.lit(True))
    large = F.coalesce(F.get_json_object("props", "$.k").cast("long"), F.lit(0)) > 50
    return c.table(spark, d, "events").select("event_id", payload.alias("payload"), enabled.alias("enabled"), large.alias("large"))


@query("""
SELECT p_partkey AS id, 'https://example.com/list_' || p_partkey || '_{page}.html' AS template,
       'https://example.com/list_' || p_partkey || '_3.html' AS third FROM part""")
def page_templates(spark: SparkSession, d: str) -> DataFrame:
    """The page number within an address, found and set."""
    url = F.concat(F.lit("https://example.com/list_"), F.col("p_partkey").cast("string"), F.lit("_1.html"))
    template = text.page_template(url)
    return c.table(spark, d, "part").select(F.col("p_partkey").alias("id"), template.alias("template"), text.fill(template, {"page": F.lit(3)}).alias("third"))


@query("""
SELECT page_id, CASE WHEN length(t) BETWEEN 2 AND 80 THEN t END AS title FROM (
  SELECT page_id, coalesce(nullif(trim(regexp_extract(html, '(?is)<meta[^>]*og:title[^>]*content="([^"]*)"', 1)), ''),
         nullif(trim(regexp_extract(html, '(?is)<title>(.*?)</title>', 1)), ''), nullif(trim(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1)), '')) AS t FROM pages)""")
def title_cascade(spark: SparkSession, d: str) -> DataFrame:
    """The first of a page's places for a title that has one, if its length is a title's."""
    patterns = ('(?is)<meta[^>]*og:title[^>]*content="([^"]*)"', "(?is)<title>(.*?)</title>", "(?is)<h1[^>]*>(.*?)</h1>")
    found = F.coalesce(*[F.nullif(F.trim(F.regexp_extract("html", p, 1)), F.lit("")) for p in patterns])
    titles = c.table(spark, d, "pages").select("page_id", found.alias("title"))
    return titles.withColumn("title", F.when(F.length("title").between(2, 80), F.col("title")))


@query("""
SELECT page_id, list_filter(regexp_extract_all(html, '(?i)<img[^>]*\\bsrc="([^"]+)"', 1), lambda x: NOT contains(x, 'loading.gif'))[1] AS cover FROM pages""")
def cover_urls(spark: SparkSession, d: str) -> DataFrame:
    """The first picture of a page that is no stand-in."""
    found = F.filter(F.regexp_extract_all("html", F.lit(r'(?i)<img[^>]*\bsrc="([^"]+)"'), F.lit(1)), lambda x: ~x.contains("loading.gif"))
    return c.table(spark, d, "pages").select("page_id", F.get(found, F.lit(0)).alias("cover"))


@query("""
SELECT n_nationkey AS id, CASE WHEN n_nationkey % 2 = 0 THEN n_name || ' - Someone' WHEN n_nationkey % 3 = 0 THEN n_name ELSE 'Someone' END AS anchor FROM nation""")
def anchor_texts(spark: SparkSession, d: str) -> DataFrame:
    """Filled anchors: separators that a missing value leaves dangling go."""
    key = F.col("n_nationkey")
    title = F.when((key % 2 == 0) | (key % 3 == 0), F.col("n_name"))
    author = F.when((key % 2 == 0) | (key % 3 != 0), F.lit("Someone"))
    made = text.anchor(F.lit("{title} - {author}{other}"), {"title": title, "author": author})
    return c.table(spark, d, "nation").select(key.alias("id"), made.alias("anchor"))


@query("""
SELECT user_id AS task_id, sum(greatest(0, CAST(floor(gap / 15) AS BIGINT)))::BIGINT AS heartbeats FROM (
  SELECT user_id, floor(epoch(ts)) - floor(epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) AS gap FROM events) WHERE gap IS NOT NULL GROUP BY 1""")
def heartbeats(spark: SparkSession, d: str) -> DataFrame:
    """How many heartbeats fill the silences of each task, one for every fifteen seconds."""
    before = F.lag("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    gaps = c.table(spark, d, "events").select(F.col("user_id").alias("task_id"), (F.unix_timestamp("ts") - F.unix_timestamp(before)).alias("gap"))
    return gaps.where(F.col("gap").isNotNull()).groupBy("task_id").agg(F.sum(F.greatest(F.lit(0), F.floor(F.col("gap") / 15))).alias("heartbeats"))


@query("""
SELECT event_id, CASE WHEN split_part(path, '/', 2) = 'book' THEN split_part(path, '/', 3) ELSE '' END AS book_id, split_part(who, '·', 1) AS author FROM (
  SELECT event_id, '/book/' || user_id || '/' || event_id AS path, event_type || '·' || user_id AS who FROM events)""")
def split_fields(spark: SparkSession, d: str) -> DataFrame:
    """A book's number from an address, and the first part of a dotted text."""
    user, event = F.col("user_id").cast("string"), F.col("event_id").cast("string")
    path = F.concat(F.lit("/book/"), user, F.lit("/"), event)
    author = F.try_element_at(F.split(F.concat("event_type", F.lit("·"), user), "·"), F.lit(1))
    return c.table(spark, d, "events").select("event_id", F.regexp_extract(path, r"/book/(\d+)", 1).alias("book_id"), author.alias("author"))
