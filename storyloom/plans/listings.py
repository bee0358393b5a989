"""Listings, searches, home page, reader and links (FLT, SRT, JON, WIN, CMP01-07)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import links, listing, matching, stats, windows
from ..registry import query
from ..sources import catalog as c

V = c.with_views


@query(V("""
SELECT n.id, n.title, n.author, n.updated_at, l.id AS chapter_id, l.sort_order AS chapter_order
FROM novel n LEFT JOIN (
  SELECT *, row_number() OVER (PARTITION BY novel_id ORDER BY sort_order DESC, id DESC) AS rn FROM chapter) l
  ON l.novel_id = n.id AND rn = 1
ORDER BY n.updated_at DESC, n.id DESC LIMIT 25""", c.NOVEL_SQL, c.CHAPTER_SQL))  # fmt: skip
def home_latest(spark: SparkSession, d: str) -> DataFrame:
    """The 25 newest novels with their latest chapter, if they have one; the window runs on those novels' chapters only."""
    newest = c.novels(spark, d, counted=False).orderBy(F.desc("updated_at"), F.desc("id")).limit(25)
    chapters = c.chapters(spark, d).join(newest.select(F.col("id").alias("novel_id")), "novel_id", "left_semi")
    latest = windows.latest_chapter(chapters).select("novel_id", F.col("id").alias("chapter_id"), F.col("sort_order").alias("chapter_order"))
    return newest.join(latest, F.col("id") == F.col("novel_id"), "left").select("id", "title", "author", "updated_at", "chapter_id", "chapter_order")


@query(V("""
SELECT novel_id, id, sort_order, word_count FROM (
  SELECT *, row_number() OVER (PARTITION BY novel_id ORDER BY sort_order DESC, id DESC) AS rn FROM chapter) WHERE rn = 1""", c.CHAPTER_SQL))  # fmt: skip
def latest_chapter_per_novel(spark: SparkSession, d: str) -> DataFrame:
    return windows.latest_chapter(c.chapters(spark, d)).select("novel_id", "id", "sort_order", "word_count")


@query(V("""
SELECT id, title, author, status, total_chapters FROM novel
WHERE (title ILIKE '%1%' OR author ILIKE '%1%') AND status = 'completed'
  AND EXISTS (SELECT 1 FROM novel_category WHERE novel_id = novel.id AND category = (SELECT min(p_type) FROM part))
ORDER BY total_chapters DESC, id LIMIT 20 OFFSET 20""", c.NOVEL_SQL, c.BRIDGE_SQL))  # fmt: skip
def list_novels_page(spark: SparkSession, d: str) -> DataFrame:
    category = c.table(spark, d, "part").agg(F.min("p_type").alias("category"))
    found = listing.filtered(c.novels(spark, d), "1", "completed", c.novel_categories(spark, d), category)
    rows = listing.page_of(found, [listing.sort_key("total_chapters", "desc"), F.asc("id")], page=2)
    return rows.select("id", "title", "author", "status", "total_chapters")


@query(V("""
SELECT count(*) AS total, 1 AS page, 20 AS size, greatest(1, CAST(ceil(count(*) / 20.0) AS BIGINT)) AS pages
FROM novel WHERE status = 'ongoing'""", c.NOVEL_SQL))  # fmt: skip
def list_novels_envelope(spark: SparkSession, d: str) -> DataFrame:
    return listing.envelope(listing.filtered(c.novels(spark, d, counted=False, authored=False), status="ongoing"), 1, 20)


@query("""
SELECT p_partkey, p_name, p_brand, p_type FROM part
WHERE p_name ILIKE '%an%' OR p_brand ILIKE '%an%' OR p_type ILIKE '%an%'""")
def search_ilike(spark: SparkSession, d: str) -> DataFrame:
    parts = c.table(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    return listing.search_titles(parts, " an ", "p_name", "p_brand", "p_type")


@query("SELECT p_partkey, p_name FROM part WHERE false")
def search_too_short(spark: SparkSession, d: str) -> DataFrame:
    return listing.search_titles(c.table(spark, d, "part").select("p_partkey", "p_name"), "a", "p_name")


@query(V("""
SELECT id, title, status FROM novel n
WHERE EXISTS (SELECT 1 FROM novel_category b WHERE b.novel_id = n.id AND b.category IN (SELECT DISTINCT p_type FROM part ORDER BY p_type LIMIT 2))
""", c.NOVEL_SQL, c.BRIDGE_SQL))  # fmt: skip
def novels_in_categories(spark: SparkSession, d: str) -> DataFrame:
    wanted = c.table(spark, d, "part").select(F.col("p_type").alias("category")).distinct().orderBy("category").limit(2)
    inside = c.novel_categories(spark, d).join(F.broadcast(wanted), "category", "left_semi").select(F.col("novel_id").alias("id"))
    return c.novels(spark, d, counted=False, authored=False).join(inside, "id", "left_semi").select("id", "title", "status")


@query(V("""
SELECT category, id, title, rank FROM (
  SELECT b.category, n.id, n.title, row_number() OVER (PARTITION BY b.category ORDER BY n.updated_at DESC, n.id DESC) AS rank
  FROM novel n JOIN novel_category b ON b.novel_id = n.id) WHERE rank <= 5""", c.NOVEL_SQL, c.BRIDGE_SQL))  # fmt: skip
def top5_per_category(spark: SparkSession, d: str) -> DataFrame:
    joined = c.novels(spark, d, counted=False, authored=False).join(c.novel_categories(spark, d), F.col("id") == F.col("novel_id"))
    top = windows.first_per_key(joined, "category", [F.desc("updated_at"), F.desc("id")], 5, "rank")
    return top.select("category", "id", "title", "rank")


@query(V("""
SELECT category, string_agg(CAST(id AS VARCHAR), ',' ORDER BY rank) AS novel_ids, count(*) AS shown FROM (
  SELECT b.category, n.id, row_number() OVER (PARTITION BY b.category ORDER BY n.updated_at DESC, n.id DESC) AS rank
  FROM novel n JOIN novel_category b ON b.novel_id = n.id) WHERE rank <= 5 GROUP BY category""", c.NOVEL_SQL, c.BRIDGE_SQL))  # fmt: skip
def category_sections(spark: SparkSession, d: str) -> DataFrame:
    """Nested lists of at most five novels: the limit comes before the collection."""
    top = top5_per_category(spark, d)
    nested = top.groupBy("category").agg(F.array_sort(F.collect_list(F.struct("rank", "id"))).alias("novels"))
    ids = F.array_join(F.transform("novels", lambda n: n["id"].cast("string")), ",")
    return nested.select("category", ids.alias("novel_ids"), F.size("novels").cast("long").alias("shown"))


@query(V("""
SELECT id, title, total_chapters, row_number() OVER (ORDER BY total_chapters DESC, id) AS rank,
       row_number() OVER (ORDER BY total_chapters DESC, id) <= 5 AS featured
FROM novel ORDER BY total_chapters DESC, id LIMIT 15""", c.NOVEL_SQL))  # fmt: skip
def hot_ranking(spark: SparkSession, d: str) -> DataFrame:
    """The top-k comes first, so the rank runs over fifteen rows."""
    from pyspark.sql import Window

    top = links.hot_ranking(c.novels(spark, d, authored=False), 15)
    rank = F.row_number().over(Window.orderBy(F.desc("total_chapters"), F.asc("id")))
    return top.select("id", "title", "total_chapters", rank.alias("rank")).withColumn("featured", F.col("rank") <= 5)


@query(V("""
SELECT n.id, n.title FROM novel n, (SELECT offset_val FROM site WHERE domain = 'nation_3.example.com' AND is_active LIMIT 1) s
QUALIFY row_number() OVER (ORDER BY n.updated_at DESC, n.id DESC) BETWEEN max(s.offset_val) OVER () + 25 AND max(s.offset_val) OVER () + 48
""", c.NOVEL_SQL, c.SITE_SQL))  # fmt: skip
def site_home_page(spark: SparkSession, d: str) -> DataFrame:
    """The second page of a site, which its own offset shifts."""
    site = c.sites(spark, d).where((F.col("domain") == "nation_3.example.com") & F.col("is_active")).agg(F.coalesce(F.min("offset_val"), F.lit(0)).alias("shift"))
    order = [F.desc("updated_at"), F.desc("id")]
    return listing.shifted_page(c.novels(spark, d, counted=False, authored=False), order, 2, listing.SITE_PAGE_SIZE, site, "shift").select("id", "title")


@query(V("""
, placed AS (SELECT novel_id, id, sort_order, struct_pack(s := sort_order, i := id) AS here FROM chapter),
neighbours AS (
  SELECT *, max(here) OVER (PARTITION BY novel_id ORDER BY sort_order RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev,
         min(here) OVER (PARTITION BY novel_id ORDER BY sort_order RANGE BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next FROM placed)
SELECT novel_id, id, sort_order, prev.i AS prev_id, next.i AS next_id FROM neighbours""", c.CHAPTER_SQL))  # fmt: skip
def prev_next_chapter(spark: SparkSession, d: str) -> DataFrame:
    return windows.with_neighbours(c.chapters(spark, d)).select("novel_id", "id", "sort_order", "prev_id", "next_id")


@query(V("""
, filled AS (
  SELECT *, coalesce(last_value(nullif(trim(volume), '') IGNORE NULLS) OVER (PARTITION BY novel_id ORDER BY sort_order, id
         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '正文') AS vol FROM chapter),
marked AS (
  SELECT *, CASE WHEN lag(vol) OVER (PARTITION BY novel_id ORDER BY sort_order, id) = vol THEN 0 ELSE 1 END AS starts FROM filled),
runs AS (
  SELECT *, sum(starts) OVER (PARTITION BY novel_id ORDER BY sort_order, id ROWS UNBOUNDED PRECEDING) AS island FROM marked),
grouped AS (
  SELECT novel_id, CAST(island AS BIGINT) AS island, min(vol) AS volume, count(*) AS chapters, min(sort_order) AS first_order, max(sort_order) AS last_order
  FROM runs GROUP BY novel_id, island)
SELECT * FROM grouped QUALIFY count(*) OVER (PARTITION BY novel_id) > 1""", c.CHAPTER_SQL))  # fmt: skip
def volume_islands(spark: SparkSession, d: str) -> DataFrame:
    return windows.volumes(c.chapters(spark, d))


@query(V("""
SELECT id, sort_order, word_count FROM chapter WHERE novel_id = (SELECT min(l_orderkey) FROM lineitem)
ORDER BY sort_order DESC, id DESC LIMIT 15""", c.CHAPTER_SQL))  # fmt: skip
def novel_newest_chapters(spark: SparkSession, d: str) -> DataFrame:
    """A lookup by a key that a one-row aggregate gives: it is broadcast, and the plan is one."""
    novel = c.table(spark, d, "lineitem").agg(F.min("l_orderkey").alias("novel_id"))
    rows = c.chapters(spark, d).join(F.broadcast(novel), "novel_id", "left_semi")
    return listing.page_of(rows, [F.desc("sort_order"), F.desc("id")], 1, 15).select("id", "sort_order", "word_count")


@query()
def random_sample5(spark: SparkSession, d: str) -> DataFrame:
    novels = c.novels(spark, d, counted=False, authored=False).where((F.col("id") != 1) & ~listing.missing("title"))
    return listing.random_sample(novels, 5).select("id", "title")


@query(V("""
SELECT t.id, coalesce(n.title, '?') AS title, t.status FROM task t LEFT JOIN novel n ON n.id = t.novel_id
WHERE t.status = 'pending' ORDER BY t.created_at, t.id LIMIT 50""", c.TASK_SQL, c.NOVEL_SQL))  # fmt: skip
def task_titles(spark: SparkSession, d: str) -> DataFrame:
    oldest = c.tasks(spark, d).where(F.col("status") == "pending").orderBy("created_at", "id").limit(50)
    titles = c.novels(spark, d, counted=False, authored=False).select(F.col("id").alias("novel_id"), "title")
    return oldest.join(titles, "novel_id", "left").select("id", F.coalesce("title", F.lit("?")).alias("title"), "status")


@query(V("""
SELECT target_id, ring_id FROM target WHERE source_site_id IS NULL OR source_site_id = 3""", c.TARGET_SQL))  # fmt: skip
def targets_in_scope(spark: SparkSession, d: str) -> DataFrame:
    return c.link_targets(spark, d).where(listing.in_scope("source_site_id", 3)).select("target_id", "ring_id")


@query(V("\nSELECT target_id, ring_id FROM target WHERE source_site_id IS NULL", c.TARGET_SQL))
def targets_global(spark: SparkSession, d: str) -> DataFrame:
    return listing.scope_choice(c.link_targets(spark, d), "source_site_id", "global").select("target_id", "ring_id")


@query(V("""
, inside AS (
  SELECT r.*, t.target_id, t.target_site_id, t.target_novel_id, row_number() OVER (PARTITION BY r.ring_id ORDER BY t.target_id) AS place
  FROM ring r JOIN target t ON t.ring_id = r.ring_id
  WHERE t.is_active AND (t.source_site_id IS NULL OR t.source_site_id = 3)
    AND list_contains(coalesce(r.on_pages, ['novel_detail', 'chapter_read']), 'novel_detail')),
made AS (
  SELECT i.ring_id, i.ring_name, i.place, coalesce('http://' || s.domain, '') || '/novel/' || i.target_novel_id || '/' AS url,
         CASE WHEN n.id IS NULL THEN '未知书名' ELSE n.title || ' - ' || coalesce(n.author, '') END AS anchor_text
  FROM inside i LEFT JOIN site s ON s.id = i.target_site_id LEFT JOIN novel n ON n.id = i.target_novel_id WHERE i.place <= i.max_links),
firsts AS (SELECT * FROM made QUALIFY row_number() OVER (PARTITION BY url ORDER BY ring_id, place) = 1)
SELECT ring_name, place, url, anchor_text FROM firsts ORDER BY ring_id, place LIMIT 8
""", c.RING_SQL, c.TARGET_SQL, c.SITE_SQL, c.NOVEL_SQL))  # fmt: skip
def link_resolution(spark: SparkSession, d: str) -> DataFrame:
    return links.resolve(c.rings(spark, d), c.link_targets(spark, d), c.sites(spark, d), c.novels(spark, d, counted=False), 3, "novel_detail")


@query("""
SELECT p_partkey AS id, CASE WHEN score >= 3 THEN category END AS category, score FROM (
  SELECT p_partkey, category, score, row_number() OVER (PARTITION BY p_partkey ORDER BY score DESC, k) AS rn FROM (
    SELECT p_partkey, k, category,
           (CASE WHEN contains(p_type, category) THEN 10 ELSE 0 END) + (CASE WHEN contains(category, p_type) THEN 5 ELSE 0 END)
           + (CASE WHEN contains(p_type, 'AN') AND contains(category, 'AN') THEN 3 ELSE 0 END) AS score
    FROM part, (VALUES (0, 'STANDARD'), (1, 'PROMO'), (2, 'AN'), (3, 'ECONOMY')) v(k, category))) WHERE rn = 1""")  # fmt: skip
def category_argmax(spark: SparkSession, d: str) -> DataFrame:
    names = c.table(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_type")
    return matching.best_category(names, "p_type", ("STANDARD", "PROMO", "AN", "ECONOMY"), ("AN",)).select("id", "category", "score")


_CANDIDATES = """
WITH wanted AS (SELECT p_partkey AS id, p_name AS title, p_brand AS author FROM part),
found AS (SELECT p_partkey AS position, left(p_name, 8) AS found_title, p_brand AS found_author FROM part),
scored AS (
  SELECT id, position, CASE WHEN title = found_title THEN 50 WHEN contains(title, found_title) OR contains(found_title, title) THEN 30 ELSE 0 END
         + CASE WHEN author = found_author THEN 40 WHEN contains(author, found_author) OR contains(found_author, author) THEN 20 ELSE 0 END AS score
  FROM wanted, found)
SELECT id, position, score, row_number() OVER (PARTITION BY id ORDER BY score DESC, position) = 1 AS best FROM scored WHERE score >= 30
QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, position) <= 10"""


@query(_CANDIDATES)
def candidate_scoring(spark: SparkSession, d: str) -> DataFrame:
    """The first ten candidates of every title, and which of them is the best."""
    from pyspark.sql import Window

    parts = c.table(spark, d, "part")
    wanted = parts.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_brand").alias("author"))
    found = parts.select(F.col("p_partkey").alias("position"), F.left("p_name", F.lit(8)).alias("found_title"), F.col("p_brand").alias("found_author"))
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), F.asc("position")))
    return matching.best_matches(wanted, found, 10).select("id", "position", "score", (place == 1).alias("best"))


@query("""
WITH wanted AS (SELECT p_partkey AS id, p_name AS title, p_brand AS author FROM part),
found AS (SELECT p_partkey AS position, left(p_name, 8) AS found_title, p_brand AS found_author FROM part),
scored AS (
  SELECT id, position, CASE WHEN title = found_title THEN 50 WHEN contains(title, found_title) OR contains(found_title, title) THEN 30 ELSE 0 END
         + CASE WHEN author = found_author THEN 40 WHEN contains(author, found_author) OR contains(found_author, author) THEN 20 ELSE 0 END AS score
  FROM wanted, found)
SELECT id, position, score FROM scored WHERE score >= 30
QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, position) <= 3""")
def candidate_scoring_all(spark: SparkSession, d: str) -> DataFrame:
    """The three best candidates of every title."""
    parts = c.table(spark, d, "part")
    wanted = parts.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_brand").alias("author"))
    found = parts.select(F.col("p_partkey").alias("position"), F.left("p_name", F.lit(8)).alias("found_title"), F.col("p_brand").alias("found_author"))
    return matching.best_matches(wanted, found, 3).select("id", "position", "score")


@query(V("""
, catalog AS (SELECT id AS url, CAST(part_id AS VARCHAR) AS title, sort_order AS place, novel_id FROM chapter),
known AS (SELECT l.id AS url, CAST(l.part_id AS VARCHAR) AS title, l.sort_order AS place FROM chapter l WHERE l.updated_at < TIMESTAMP '1995-01-01')
SELECT url, title, place, novel_id FROM catalog a
WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.url = a.url)
  AND NOT EXISTS (SELECT 1 FROM known k WHERE k.title = a.title AND k.place = a.place)""", c.CHAPTER_SQL))  # fmt: skip
def incremental_antijoin(spark: SparkSession, d: str) -> DataFrame:
    rows = c.chapters(spark, d).select(F.col("id").alias("url"), F.col("part_id").cast("string").alias("title"), F.col("sort_order").alias("place"), "novel_id", "updated_at")
    known = rows.where(F.col("updated_at") < F.lit("1995-01-01").cast("timestamp"))
    return matching.unknown_items(rows, known).select("url", "title", "place", "novel_id")


@query("""
SELECT doc_id, lang FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1""")
def first_per_text(spark: SparkSession, d: str) -> DataFrame:
    """Keep-first by text: rows are dealt by the text's hash, so texts themselves are not sorted."""
    docs = c.table(spark, d, "documents").select("doc_id", "lang", F.sha2("text", 256).alias("text_hash"))
    return windows.first_per_key(docs, "text_hash", [F.asc("doc_id")]).select("doc_id", "lang")


@query("""
SELECT conv_id, turn, role, last_value(CASE WHEN role <> 'assistant' THEN role END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn) AS header
FROM conversations""")
def header_alignment(spark: SparkSession, d: str) -> DataFrame:
    rows = c.table(spark, d, "conversations").select("conv_id", "turn", "role").withColumn("header", F.when(F.col("role") != "assistant", F.col("role")))
    return windows.fill_down(rows, "header", "turn", "conv_id")


@query("""
SELECT conv_id, turn, role FROM conversations c
WHERE turn < coalesce((SELECT min(turn) FROM conversations k WHERE k.conv_id = c.conv_id AND k.role = 'assistant'), 999999999)""")
def before_last_known(spark: SparkSession, d: str) -> DataFrame:
    rows = c.table(spark, d, "conversations").select("conv_id", "turn", "role")
    return windows.before_known(rows, F.col("role") == "assistant", "turn", "conv_id")


@query("""
SELECT doc_id, lang, sha256(CASE WHEN hit THEN '[' || text || ']' ELSE text END) AS shown_sha, hit FROM (
  SELECT *, sha256(text) IN (SELECT sha256(text) FROM documents WHERE doc_id % 2 = 0 AND lang = 'de') AS hit FROM documents)""")  # fmt: skip
def translation_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Every text in one target language; the cache holds texts of that language alone."""
    docs = c.table(spark, d, "documents").select("doc_id", "lang", "text")
    cached = docs.where((F.col("doc_id") % 2 == 0) & (F.col("lang") == "de")).select(
        F.sha2("text", 256).alias("source_hash"), F.col("lang").alias("target_lang"), F.concat(F.lit("["), "text", F.lit("]")).alias("translated_text")
    ).dropDuplicates(["source_hash"])
    shown = matching.translated(docs, "text", cached, "de")
    return shown.select("doc_id", "lang", F.sha2("shown", 256).alias("shown_sha"), "hit")


@query("""
WITH cached AS (SELECT DISTINCT sha256(text) AS source_hash, lang, '[' || text || ']' AS translated_text FROM documents WHERE doc_id % 2 = 0)
SELECT doc_id, lang, sha256(coalesce(translated_text, text)) AS shown_sha, CAST(length(coalesce(translated_text, text)) AS INT) AS shown_length, translated_text IS NOT NULL AS hit
FROM (SELECT *, sha256(text) AS source_hash FROM documents) LEFT JOIN cached USING (source_hash, lang)""")  # fmt: skip
def translation_lookup_whole(spark: SparkSession, d: str) -> DataFrame:
    """Whole texts, each in its own language."""
    docs = c.table(spark, d, "documents").select("doc_id", "lang", "text")
    cached = docs.where(F.col("doc_id") % 2 == 0).select(
        F.sha2("text", 256).alias("source_hash"), F.col("lang").alias("target_lang"), F.concat(F.lit("["), "text", F.lit("]")).alias("translated_text")
    ).dropDuplicates(["source_hash", "target_lang"])
    shown = matching.translated(docs, "text", cached, F.col("lang"))
    return shown.select("doc_id", "lang", F.sha2("shown", 256).alias("shown_sha"), F.length("shown").alias("shown_length"), "hit")


@query(V("""
SELECT n.id, n.title, coalesce(min(b.category), '-') AS first_category, count(b.category) AS categories
FROM novel n LEFT JOIN novel_category b ON b.novel_id = n.id GROUP BY n.id, n.title""", c.NOVEL_SQL, c.BRIDGE_SQL))  # fmt: skip
def novels_with_categories(spark: SparkSession, d: str) -> DataFrame:
    """Nested categories of each novel, and the first one's name."""
    nested = c.novel_categories(spark, d).groupBy(F.col("novel_id").alias("id")).agg(F.array_sort(F.collect_set("category")).alias("names"))
    joined = c.novels(spark, d, counted=False, authored=False).join(nested, "id", "left")
    return joined.select(
        "id", "title", F.coalesce(F.try_element_at("names", F.lit(1)), F.lit("-")).alias("first_category"),
        F.coalesce(F.size("names"), F.lit(0)).cast("long").alias("categories"),
    )
