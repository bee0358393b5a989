"""Flags, addresses, labels, links, harvests, files and other operators in full (FLT09, FLT11, FLT21, SET04, STR34, STR36, MTH02, MTH04, DAT06, WIN09, JON14, CMP04, CMP10, CMP15, UDF01, HTM08, HTM10, SRC06-12)."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import numbers, text
from ..operators import harvest, links, listing, windows
from ..registry import query
from ..sources import catalog as c
from ..sources import files
from ..streaming import ordered
from .compositions import _say

V = c.with_views
SITE = "https://books.example.com"


@query("""
SELECT l_orderkey AS novel_id, count(*) AS empty, max(l_linenumber) AS last FROM lineitem
WHERE l_linenumber % 3 = 0 AND l_quantity % 2 = 0 AND l_suppkey % 4 <> 0 GROUP BY l_orderkey""")
def empty_chapters(spark: SparkSession, d: str) -> DataFrame:
    """Chapters to fetch again: without text, without a file, and with an address; counted by novel."""
    rows = c.table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("novel_id"), F.col("l_linenumber").alias("sort_order"), F.when(F.col("l_linenumber") % 3 != 0, "text").alias("content"),
        F.when(F.col("l_quantity") % 2 != 0, "file").alias("content_file"), F.when(F.col("l_suppkey") % 4 != 0, "url").alias("source_url"),
    )
    return rows.where(listing.empty_chapter()).groupBy("novel_id").agg(F.count(F.lit(1)).alias("empty"), F.max("sort_order").alias("last"))


_CONFIG = """CASE n_nationkey % 6 WHEN 0 THEN NULL WHEN 1 THEN '{}' WHEN 2 THEN '{"home": {}}' WHEN 3 THEN '{"home": {"hot": {}}}'
  WHEN 4 THEN '{"home": {"hot": {"enabled": false}}}' ELSE '{"home": {"hot": {"count": 5}, "latest": {"enabled": false}}}' END"""


@query(f"""
SELECT n_nationkey AS id, coalesce(CAST(json_extract({_CONFIG}, '$.home.hot.enabled') AS BOOLEAN), true) AS hot,
       coalesce(CAST(json_extract({_CONFIG}, '$.home.latest.enabled') AS BOOLEAN), true) AS latest FROM nation""")
def module_flags(spark: SparkSession, d: str) -> DataFrame:
    """Which parts of its home page a site shows: all that it does not turn off."""
    config = F.expr(_CONFIG)
    return c.table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), text.module_enabled(config, "home", "hot").alias("hot"), text.module_enabled(config, "home", "latest").alias("latest"))


@query("""
SELECT event_id, CASE WHEN event_id % 3 = 0 AND event_id % 5 > 0 THEN '10.1.' || (user_id % 200) || '.7' WHEN event_id % 3 = 0 THEN '127.0.0.1' ELSE '9.9.9.' || (user_id % 200) END AS client,
       'h' || user_id || '.example.com' AS host, CASE WHEN event_id % 2 = 0 THEN 8080 ELSE 80 END AS port FROM events""")
def client_addresses(spark: SparkSession, d: str) -> DataFrame:
    """Whose a request is: the first address that a trusted proxy forwards, else the caller's own; and the host it asks."""
    k, user = F.col("event_id"), F.col("user_id").cast("string")
    peer = F.when(k % 3 == 0, "127.0.0.1").otherwise(_say("9.9.9.", F.col("user_id") % 200))
    forwarded = F.when(k % 5 > 0, _say(" 10.1.", F.col("user_id") % 200, ".7 , 8.8.8.8, 127.0.0.1")).otherwise("")
    host = F.concat(F.lit("H"), user, F.lit(".example.com"), F.when(k % 2 == 0, ":8080").otherwise(""))
    name, port = text.host_and_port(host)
    return c.table(spark, d, "events").select("event_id", text.client_address(peer, forwarded).alias("client"), name.alias("host"), port.alias("port"))


@query("""
WITH spans AS (SELECT count(*) AS n, (epoch_ms(max(ts)) - epoch_ms(min(ts))) / 1000.0::DOUBLE AS seconds FROM events)
SELECT n_nationkey AS sites, round_even(n_nationkey * 3000000 / 86400.0::DOUBLE, 6) AS needed, round_even(n / seconds, 9) AS achieved,
       CASE WHEN n_nationkey > 0 THEN round_even(n / seconds / (n_nationkey * 3000000 / 86400.0::DOUBLE) * 100, 6) ELSE 0.0 END AS coverage FROM nation, spans""")
def load_coverage(spark: SparkSession, d: str) -> DataFrame:
    """The share of a wanted load that was reached, in percent, for so many sites."""
    at = F.unix_millis(F.col("ts").cast("timestamp"))
    reached = c.table(spark, d, "events").agg((F.count(F.lit(1)) / ((F.max(at) - F.min(at)) / 1000)).alias("achieved"))
    rows = c.beside(c.table(spark, d, "nation").select(F.col("n_nationkey").alias("sites")), reached)
    needed = numbers.needed_rate(F.col("sites"), F.lit(3_000_000))
    return rows.select("sites", F.bround(needed, 6).alias("needed"), F.bround("achieved", 9).alias("achieved"), F.bround(numbers.coverage(F.col("achieved"), needed), 6).alias("coverage"))


@query("""
SELECT event_id, CASE WHEN m < 120 THEN CAST(CAST(round_even(m, 0) AS INT) AS VARCHAR) || 'min' ELSE printf('%.1f', round_even(m / 60, 1)) || 'h' END AS eta,
       CAST(power(2, event_id % 5 + 1) + 1.5 * (event_id % 10) / 10.0::DOUBLE AS DOUBLE) AS backoff, greatest(0.0, CASE WHEN value < 2 THEN 2 - value + (event_id % 10) / 10.0::DOUBLE * 3 ELSE 0 END) AS wait
FROM (SELECT *, value * 3.0::DOUBLE AS m FROM events)""")
def waits_and_labels(spark: SparkSession, d: str) -> DataFrame:
    """Time left in words, the wait before another try, and that before the next call of a host (2 to 5 seconds apart)."""
    jitter = (F.col("event_id") % 10) / F.lit(10.0)
    return c.table(spark, d, "events").select(
        "event_id", numbers.eta_label(F.col("value") * 3).alias("eta"), numbers.backoff(F.col("event_id") % 5 + 1, jitter).alias("backoff"), numbers.throttle_wait(F.col("value"), jitter, 2.0, 5.0).alias("wait")
    )


@query(V("""
, numbered AS (
  SELECT novel_id, id, row_number() OVER (PARTITION BY novel_id ORDER BY created_at, id) AS current, count(*) OVER (PARTITION BY novel_id) AS total,
         (epoch_us(created_at) - epoch_us(min(created_at) OVER (PARTITION BY novel_id))) / 1000000.0::DOUBLE AS elapsed FROM task),
rates AS (SELECT *, CASE WHEN elapsed > 0 THEN current * 3600 / elapsed ELSE 0.0 END AS speed FROM numbered WHERE current <= 3 OR current % greatest(1, total // 20) = 0)
SELECT novel_id, id, current, total, round_even(speed, 6) AS speed, CASE WHEN speed > 0 THEN round_even((total - current) / speed, 6) ELSE 0.0 END AS eta FROM rates""", c.TASK_SQL))  # fmt: skip
def progress_told(spark: SparkSession, d: str) -> DataFrame:
    """Progress as it is told: the first three and each twentieth, with the speed an hour so far and the hours left."""
    at = F.unix_micros(F.col("created_at").cast("timestamp"))
    rows = c.tasks(spark, d).withColumn("elapsed", (at - F.min(at).over(Window.partitionBy("novel_id"))) / 1_000_000)
    told = windows.sampled_progress(rows, ["created_at", "id"], "novel_id")
    speed = F.when(F.col("elapsed") > 0, F.col("current") * 3600 / F.col("elapsed")).otherwise(0.0)
    eta = F.when(speed > 0, (F.col("total") - F.col("current")) / speed).otherwise(0.0)
    return told.select("novel_id", "id", "current", "total", F.bround(speed, 6).alias("speed"), F.bround(eta, 6).alias("eta"))


@query("""
WITH days AS (
  SELECT date_trunc('day', ts) AS day, count(*) FILTER (event_type = 'signup') AS pending, count(*) FILTER (event_type = 'view' AND event_id % 9 = 0) AS running,
         count(*) FILTER (event_type = 'purchase') AS completed, count(*) FILTER (event_type = 'error' AND event_id % 50 = 0) AS stuck, min(event_id) % 4 > 0 AS alive FROM events GROUP BY 1),
seen AS (SELECT *, coalesce(pending < lag(pending) OVER w OR completed > lag(completed) OVER w, false) AS progressed FROM days WINDOW w AS (ORDER BY day))
SELECT day, alive, stuck, progressed, NOT alive OR stuck > 0 OR (pending > 0 AND running = 0 AND NOT progressed) AS restart,
       CASE WHEN NOT alive THEN 'dead' WHEN stuck > 0 THEN 'stuck' WHEN pending > 0 AND running = 0 AND NOT progressed THEN 'idle' END AS reason FROM seen""")
def watchdog_cycles(spark: SparkSession, d: str) -> DataFrame:
    """What a watchdog does in each cycle, and why: the runner is dead, tasks are stuck, or nothing moves."""
    kind, k = F.col("event_type"), F.col("event_id")
    days = c.table(spark, d, "events").groupBy(F.date_trunc("day", "ts").alias("day")).agg(
        F.count_if(kind == "signup").alias("pending"), F.count_if((kind == "view") & (k % 9 == 0)).alias("running"), F.count_if(kind == "purchase").alias("completed"),
        F.count_if((kind == "error") & (k % 50 == 0)).alias("stuck"), (F.min("event_id") % 4 > 0).alias("alive"),
    )
    return windows.watchdog(days, "day").select("day", "alive", "stuck", "progressed", "restart", "reason")


@query(V("""
, latest AS (SELECT max(ts) AS now, arg_max(user_id, (ts, event_id)) AS holder, max(ts) FILTER (event_type = 'view') AS beat FROM events)
SELECT count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'running') AS running, count(*) FILTER (status = 'running' AND created_at < now - INTERVAL 600 SECOND) AS stuck,
       any_value(CAST(holder AS VARCHAR)) AS lease_owner, any_value(epoch(now) - epoch(beat) <= 300) AS lease_held FROM task, latest""", c.TASK_SQL))  # fmt: skip
def queue_with_lease(spark: SparkSession, d: str) -> DataFrame:
    """The queue's counts, tasks that are stuck, and who holds its lease, if it still does."""
    events = c.table(spark, d, "events")
    now = events.agg(
        F.max("ts").alias("now"), F.max(F.struct("ts", "event_id", F.col("user_id").cast("string").alias("u")))["u"].alias("holder"), F.max(F.when(F.col("event_type") == "view", F.col("ts"))).alias("beat")
    )
    state, old = F.col("status"), F.col("created_at") < F.col("now") - F.make_dt_interval(secs=F.lit(600))
    age = (F.unix_micros(F.col("now").cast("timestamp")) - F.unix_micros(F.col("beat").cast("timestamp"))) / 1e6
    return c.beside(c.tasks(spark, d), now).agg(
        F.count_if(state == "pending").alias("pending"), F.count_if(state == "running").alias("running"), F.count_if((state == "running") & old).alias("stuck"),
        F.any_value("holder").alias("lease_owner"), F.any_value(age <= 300).alias("lease_held"),
    )


@query(V("""
, shown AS (SELECT o_orderkey AS id, 'Order ' || o_orderkey AS title, md5(o_orderkey || ':7') AS dice FROM orders WHERE o_orderkey % 4 <> 0 ORDER BY dice LIMIT 6),
lasts AS (SELECT novel_id, id AS chapter FROM chapter QUALIFY row_number() OVER (PARTITION BY novel_id ORDER BY sort_order DESC, id DESC) = 1),
full_ AS (SELECT shown.*, coalesce(chapter, '-') AS chapter FROM shown LEFT JOIN lasts ON novel_id = shown.id)
SELECT o_orderkey AS reader_of, CAST(f.id AS BIGINT) AS id, title, chapter FROM orders, full_ f WHERE f.id <> o_orderkey
QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY dice) <= 5""", c.CHAPTER_SQL))  # fmt: skip
def recommended_books(spark: SparkSession, d: str) -> DataFrame:
    """Five books beside each novel's chapters: with a cover, never the novel itself, each with its latest chapter."""
    novels = c.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), _say("Order ", F.col("o_orderkey")).alias("title"), F.when(F.col("o_orderkey") % 4 != 0, "cover").alias("cover"))
    return listing.recommended(novels, c.chapters(spark, d), 5, seed=7).select("reader_of", "id", "title", "chapter")


@query(V("""
, more AS (
  SELECT *, CASE WHEN target_id % 5 = 0 THEN '7' WHEN target_id % 5 = 1 THEN '8' END AS source_novel_id, CASE WHEN target_id % 6 = 0 THEN 'https://else.example.com/' || target_id END AS target_url,
         CASE WHEN target_id % 7 = 0 THEN 'read {title}' END AS own FROM target),
inside AS (
  SELECT m.*, ring_name, max_links, row_number() OVER (PARTITION BY m.ring_id ORDER BY target_id) AS place FROM more m JOIN ring r ON r.ring_id = m.ring_id
  WHERE is_active AND (source_site_id IS NULL OR source_site_id = 3) AND (source_novel_id IS NULL OR source_novel_id = '7') AND list_contains(coalesce(on_pages, ['novel_detail', 'chapter_read']), 'novel_detail')),
made AS (
  SELECT i.ring_id, i.ring_name, i.place,
         coalesce(target_url, coalesce('http://' || s.domain, '') || CASE WHEN s.id % 2 = 0 THEN '/b-' || target_novel_id || '.html' ELSE '/novel/' || target_novel_id || '/' END) AS url,
         CASE WHEN own IS NOT NULL THEN 'read ' || coalesce(n.title, '未知书名') WHEN n.id IS NULL THEN '未知书名' ELSE n.title || ' - ' || coalesce(n.author, '') END AS anchor_text
  FROM inside i LEFT JOIN site s ON s.id = i.target_site_id LEFT JOIN novel n ON n.id = i.target_novel_id WHERE i.place <= i.max_links),
firsts AS (SELECT * FROM made QUALIFY row_number() OVER (PARTITION BY url ORDER BY ring_id, place) = 1)
SELECT ring_name, place, url, anchor_text FROM firsts ORDER BY ring_id, place LIMIT 50""", c.RING_SQL, c.TARGET_SQL, c.SITE_SQL, c.NOVEL_SQL))  # fmt: skip
def link_target_rules(spark: SparkSession, d: str) -> DataFrame:
    """Links with all that a target may set: the novel it is shown at, an address of its own, its own words, and its site's pattern."""
    k = F.col("target_id")
    targets = c.link_targets(spark, d).select(
        "*", F.when(k % 5 == 0, "7").when(k % 5 == 1, "8").alias("source_novel_id"), F.when(k % 6 == 0, _say("https://else.example.com/", k)).alias("target_url"), F.when(k % 7 == 0, "read {title}").alias("anchor_text")
    )
    sites = c.sites(spark, d).withColumn("novel_pattern", F.when(F.col("id") % 2 == 0, "/b-{id}.html"))
    return links.resolve(c.rings(spark, d), targets, sites, c.novels(spark, d, counted=False), 3, "novel_detail", 50, 7)


def _listing_pages(spark: SparkSession, d: str) -> DataFrame:
    """Four pages of a listing for each brand's part: by a rule, by addresses alone, empty, and one that nobody sees."""
    key = F.col("p_partkey")
    ruled = _say('<div class="row"><a href="/book/', key, '/">A ', key, '</a></div><div class="row"><a href="/book/', key, '/3.html">Chapter</a></div>')
    plain = _say('<div id="main"><a href="/book/', key, '/">again</a><a href="/book/', key + 1, '/">B</a><nav><a href="/book/9/">frame</a></nav><a href="/other">x</a></div>')
    bodies = F.array(ruled, F.when(key % 2 == 0, plain).otherwise(ruled), F.lit("<p>none</p>"), plain)
    rows = c.dealt(spark, d, "part", "p_partkey").select(key.alias("site"), F.posexplode(bodies).alias("n", "html"))
    return rows.select((F.col("site") * 10 + F.col("n")).alias("page_id"), "site", (F.col("n") + 1).alias("page"), _say(SITE, "/list").alias("url"), "html")


@query(f"""
WITH rows AS (
  SELECT p_partkey AS site, 1 AS page, 0 AS position, '{SITE}/book/' || p_partkey || '/' AS url, 'A ' || p_partkey AS title, 'novel' AS kind, true AS first FROM part
  UNION ALL SELECT p_partkey, 1, 1, '{SITE}/book/' || p_partkey || '/3.html', 'Chapter', 'chapter', true FROM part
  UNION ALL SELECT p_partkey, 2, 0, '{SITE}/book/' || p_partkey || '/', 'A ' || p_partkey, 'novel', false FROM part WHERE p_partkey % 2 = 1
  UNION ALL SELECT p_partkey, 2, 1, '{SITE}/book/' || p_partkey || '/3.html', 'Chapter', 'chapter', true FROM part WHERE p_partkey % 2 = 1
  UNION ALL SELECT p_partkey, 2, 0, '{SITE}/book/' || p_partkey || '/', 'again', 'novel', false FROM part WHERE p_partkey % 2 = 0
  UNION ALL SELECT p_partkey, 2, 1, '{SITE}/book/' || (p_partkey + 1) || '/', 'B', 'novel', true FROM part WHERE p_partkey % 2 = 0)
SELECT * FROM rows""")
def listing_harvest(spark: SparkSession, d: str) -> DataFrame:
    """Links over the pages of listings, up to the first empty one: novels once each, chapters all, none of the site's frame."""
    fields = {"title": {"selectors": ["a"]}, "url": {"selectors": ["a"], "attr": "href", "absolute": True}}
    return harvest.over_pages(_listing_pages(spark, d), ".row", fields)


@query("SELECT page_id, md5(regexp_replace(regexp_replace(html, '<br\\s*/?>', chr(10), 'gi'), '<[^>]+>', '', 'g')) AS lines, md5(regexp_replace(html, '<[^>]+>', '', 'g')) AS bare FROM pages UNION ALL SELECT -r_regionkey - 1, '', '' FROM region")
def page_filters(spark: SparkSession, d: str) -> DataFrame:
    """The filters of templates on whole pages; a null is an empty text."""
    pages = c.table(spark, d, "pages").select("page_id", "html").unionByName(c.table(spark, d, "region").select((-F.col("r_regionkey") - 1).cast("long").alias("page_id"), F.lit(None).cast("string").alias("html")))

    def digest(shown: Column) -> Column:
        return F.when(F.col("html").isNull(), F.coalesce(shown, F.lit(""))).otherwise(F.md5(shown))

    return pages.select("page_id", digest(text.breaks_to_lines(F.col("html"))).alias("lines"), digest(text.strip_tags(F.col("html"))).alias("bare"))


@query("""
SELECT CAST(conv_id AS VARCHAR) AS novel_id, conv_id || '-' || turn AS id, sha256(CASE WHEN turn % 3 = 0 AND text <> '' THEN text WHEN turn % 3 = 1 THEN 'column ' || turn ELSE '' END) AS content_sha, turn % 3 = 0 AND text <> '' AS has_file FROM conversations""")
def contents_resolved(spark: SparkSession, d: str) -> DataFrame:
    """A chapter's text from its file where it has one, else from its column, else none: files written, listed and read."""
    root = f"{ordered.shared_folder(spark)}/blobs-{uuid.uuid4().hex}"
    rows = c.table(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("novel_id"), F.concat_ws("-", "conv_id", "turn").alias("id"), "turn", "text")
    files.write_blobs(rows.where("turn % 3 = 0").select("novel_id", "id", F.col("text").alias("content")), root).write.format("noop").mode("overwrite").save()
    blobs = files.read_blobs(spark, root)
    shown = files.resolve_content(rows.select("novel_id", "id", F.when(F.col("turn") % 3 == 1, _say("column ", F.col("turn"))).alias("content")), blobs)
    return files.blobs_exist(shown, blobs.select("chapter_id")).select("novel_id", "id", F.sha2("content", 256).alias("content_sha"), "has_file")


@query("SELECT count(*) FILTER (turn % 3 = 0 AND text <> '') AS files FROM conversations")
def blobs_counted(spark: SparkSession, d: str) -> DataFrame:
    """How many files a write left, none of them read."""
    root = f"{ordered.shared_folder(spark)}/blobs-{uuid.uuid4().hex}"
    rows = c.table(spark, d, "conversations").where("turn % 3 = 0").select("conv_id", F.concat_ws("-", "conv_id", "turn").alias("id"), F.col("text").alias("content"))
    files.write_blobs(rows.withColumnRenamed("conv_id", "novel_id"), root).write.format("noop").mode("overwrite").save()
    return files.count_files(spark, root)


@query("""
SELECT 'site-' || n_nationkey AS source, n_name AS name, 'https://' || lower(n_name) AS base_url FROM nation WHERE n_nationkey % 2 = 0""")
def rules_listed(spark: SparkSession, d: str) -> DataFrame:
    """Rule files as they are listed; those of odd names are none."""
    root = f"{ordered.shared_folder(spark)}/rules-{uuid.uuid4().hex}"
    name = F.concat(F.when(F.col("n_nationkey") % 2 == 0, "site-").otherwise("site "), F.col("n_nationkey").cast("string"))
    rule = F.to_json(F.struct(F.col("n_name").alias("name"), F.concat(F.lit("https://"), F.lower("n_name")).alias("base_url")))
    rows = c.table(spark, d, "nation").select(name.alias("name"), rule.alias("rule")).collect()  # a rule file each, as many as there are sites
    for r in rows:
        place = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{r.name}.json")
        out = place.getFileSystem(spark._jsc.hadoopConfiguration()).create(place, True)
        out.write(bytearray(r.rule.encode()))
        out.close()
    return files.list_rules(spark, root).select("source", "name", "base_url")


@query("""
SELECT trim(event_type || ' ' || event_id) AS value FROM events WHERE ts >= (SELECT min(ts) FROM (SELECT ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 40))
ORDER BY ts DESC, event_id DESC LIMIT 40""")
def log_lines(spark: SparkSession, d: str) -> DataFrame:
    """The last lines of a log that was written and read back."""
    path = f"{ordered.shared_folder(spark)}/log-{uuid.uuid4().hex}"
    rows = c.table(spark, d, "events").select("ts", "event_id", F.concat(F.lit("  "), "event_type", F.lit(" "), F.col("event_id").cast("string"), F.lit(" ")).alias("value"))
    rows.orderBy("ts", "event_id").coalesce(1).select("value").write.text(path)
    return files.tail(files.read_log(spark, path), "line", 40).select("value")
