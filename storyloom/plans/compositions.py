"""Whole pages and whole crawls: what several operators give together (CMP, HTM09-19, SNK06/11/13, SRT08/15, STR17-30, FLT14, STM05).

Pages of novels, listings, catalogs and chapters are made from ``part``, so that what must come out of them is known.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import crawl, html, links, listing, merge, pagination, stats, windows
from ..registry import query
from ..sources import catalog as c
from ..streaming import progress

V = c.with_views
SITE = "https://books.example.com"
#: Chapters of each catalog page made here, in volumes of three.
CHAPTERS = 6
#: Words that tell that a novel is complete.
COMPLETE_WORDS = (
    "大结局", "完结", "本书完", "全文完", "全本完", "完本", "终章", "致谢", "后记", "(完)", "【完】", "[完]", "全书完", "大結局", "完結",
)
#: What a noise title holds, and what a title that was found again must not hold or be.
NOISE_MARKERS = (
    "出现错误", "错误页面", "404", "Error", "error", "页面不存在", "Not Found", "铅笔小说", "23qb", "笔趣阁", "小说大全",
    "全本小说网", "趣读小说", "提子小说网", "香书中文",
)
BAD_TITLE_MARKERS = ("出现错误", "错误页面", "404", "页面不存在", "Not Found", "找不到", "已删除", "已下架", "不存在")
BAD_TITLES = (
    "铅笔小说", "23qb", "23qb.net", "笔趣阁", "小说大全", "全本小说网", "趣读小说", "提子小说网", "香书中文", "铅笔小说-免费网络小说阅读网",
)


def _say(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _pages(spark: SparkSession, d: str, address: tuple, body: Column) -> DataFrame:
    return c.dealt(spark, d, "part", "p_partkey").select(F.col("p_partkey").alias("page_id"), _say(SITE, *address).alias("url"), body.alias("html"))


def _novel_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages of novels: with all metas, with headings only, and with some of both."""
    def meta(name: str, value: Column) -> Column:
        return _say(f'<meta property="{name}" content="', value, '"/>')

    words = _say('<span class="tag-link">fun</span><span class="tag-link">', F.col("p_size"), ".5 万字</span>")
    aux = _say('<div class="novel-info-aux"><a href="/book/lastupdate_1">', F.col("p_type"), '</a><a title="作者：', F.col("p_brand"), '">x</a></div>')
    whole = _say(
        "<html><head>", meta("og:novel:book_name", F.col("p_name")), meta("og:novel:author", F.col("p_brand")), meta("og:description", _say("All of&lt;br /&gt;", F.col("p_name"))),
        meta("og:image", _say("/covers/", F.col("p_partkey"), ".jpg")), meta("og:novel:status", F.lit("完结")), meta("og:novel:tags", F.col("p_type")), "</head><body>", words, "</body></html>",
    )
    bare = _say('<html><body><h1 class="page-title"> ', F.col("p_name"), " </h1>", aux, "</body></html>")
    mixed = _say("<html><head>", meta("og:title", F.col("p_name")), meta("description", F.col("p_type")), "</head><body>", aux, words, "</body></html>")
    return _pages(spark, d, ("/book/", F.col("p_partkey"), "/"), F.when(F.col("p_partkey") % 3 == 0, whole).when(F.col("p_partkey") % 3 == 1, bare).otherwise(mixed))


@query(f"""
SELECT p_partkey AS page_id, p_name AS title, p_brand AS author,
       CASE p_partkey % 3 WHEN 0 THEN 'All of ' || p_name WHEN 2 THEN p_type ELSE '' END AS description,
       CASE WHEN p_partkey % 3 = 0 THEN '{SITE}/covers/' || p_partkey || '.jpg' ELSE '' END AS cover_url,
       CASE WHEN p_partkey % 3 = 0 THEN 'completed' ELSE 'ongoing' END AS status, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_type END AS category_name,
       CASE WHEN p_partkey % 3 = 0 THEN p_type ELSE '' END AS tags, CASE WHEN p_partkey % 3 = 1 THEN 0 ELSE p_size * 10000 + 5000 END AS word_count,
       CAST(p_partkey AS VARCHAR) AS book_id FROM part""")
def novel_info(spark: SparkSession, d: str) -> DataFrame:
    return crawl.novel_info(_novel_pages(spark, d))


@query(f"""
SELECT p_partkey AS page_id, 0 AS position, p_name AS title, p_brand AS author, '{SITE}/book/' || p_partkey || '/' AS url, CAST(p_partkey AS VARCHAR) AS book_id,
       p_type || ' and more' AS description FROM part""")
def search_results(spark: SparkSession, d: str) -> DataFrame:
    """A result of three links and one of two, which is none."""
    first = _say('<div class="module-search-item"><a href="/x">c</a> . x . ', F.col("p_brand"), ' . <a href="/y">l</a> <a href="/book/', F.col("p_partkey"), '/">', F.col("p_name"), "</a> ", F.col("p_brand"), " . ", F.col("p_type"), " and more .</div>")
    other = F.lit('<div class="module-search-item"><a href="/book/9/">a</a> <a href="/book/9/">b</a></div>')
    return crawl.search_results(_pages(spark, d, ("/search.html?searchkey=", F.col("p_brand")), _say(first, other)))


@query(f"""
SELECT p_partkey AS page_id, n AS position, '{SITE}/book/' || p_partkey || n || '/' AS url, p_partkey || '' || n AS book_id, p_name || ' ' || n AS title,
       CASE WHEN n = 0 THEN p_brand ELSE '' END AS author, CASE WHEN n = 2 THEN '{SITE}/covers/' || p_partkey || '.jpg' ELSE '' END AS cover_url
FROM part, (VALUES (0), (2)) v(n)""")
def category_listing(spark: SparkSession, d: str) -> DataFrame:
    """Items of a category's page; the second has no link to a book."""
    def item(n: int, *inside: str | Column) -> Column:
        return _say('<div class="module-item"><a href="/', "book/" if n != 1 else "other/", F.col("p_partkey"), f'{n}/">x</a><b class="module-item-title">', F.col("p_name"), f" {n}</b>", *inside, "</div>")

    body = _say(item(0, '<i class="module-item-text">', F.col("p_brand"), "</i>"), item(1), item(2, '<img src="loading.gif" data-src="/covers/', F.col("p_partkey"), '.jpg">'))
    return crawl.category_listing(_pages(spark, d, ("/book/lastupdate_0_", F.col("p_size"), "_0.html"), body))


@query(f"""
SELECT p_partkey AS page_id, CASE p_partkey % 4 WHEN 0 THEN 'https://img.example.com/' || p_partkey || '.jpg' WHEN 1 THEN '{SITE}/late/' || p_partkey || '.jpg'
       WHEN 2 THEN '{SITE}/my_cover/' || p_partkey || '.jpg' END AS cover_url FROM part""")
def cover_cascade(spark: SparkSession, d: str) -> DataFrame:
    """``og:image``; a picture that loads late; a stand-in before a cover; and nothing but a stand-in."""
    stand_in = '<div class="module-item-pic"><img src="/static/loading.gif"></div>'
    body = (
        F.when(F.col("p_partkey") % 4 == 0, _say('<meta property="og:image" content="https://img.example.com/', F.col("p_partkey"), '.jpg">', stand_in))
        .when(F.col("p_partkey") % 4 == 1, _say('<div class="novel-cover"><img data-src="/late/', F.col("p_partkey"), '.jpg"></div>'))
        .when(F.col("p_partkey") % 4 == 2, _say(stand_in, '<img src="/my_cover/', F.col("p_partkey"), '.jpg">'))
        .otherwise(F.lit(stand_in))
    )
    return crawl.covers(_pages(spark, d, ("/book/", F.col("p_partkey"), "/"), body))


_ROW = {"title": {"selectors": ["a"]}, "url": {"selectors": ["a"], "attr": "href", "absolute": True}}
_CATALOG, _SEARCH = {"container": ".row", "fields": _ROW}, {"container": ".hit", "fields": _ROW}


@query(f"""
SELECT p_partkey AS page_id, 0 AS position, p_name AS title, '{SITE}/book/' || p_partkey || '.html' AS url, 'catalog' AS section FROM part WHERE p_partkey % 2 = 0
UNION ALL SELECT p_partkey, 0, 'hit ' || p_name, '{SITE}/hit/' || p_partkey, 'search' FROM part WHERE p_partkey % 2 = 1""")
def rule_harvest(spark: SparkSession, d: str) -> DataFrame:
    """A rule's catalog rows, the first of each address; where a page has none, its search rows."""
    row = _say('<p class="row"><a href="/book/', F.col("p_partkey"), '.html">', F.col("p_name"), "</a></p>")
    body = _say(F.when(F.col("p_partkey") % 2 == 0, _say(row, row)).otherwise(F.lit("")), '<p class="hit"><a href="/hit/', F.col("p_partkey"), '">hit ', F.col("p_name"), "</a></p>")
    return crawl.harvest_by_rule(_pages(spark, d, ("/list/", F.col("p_partkey")), body), _CATALOG, _SEARCH)


def _catalog_pages(spark: SparkSession, d: str) -> DataFrame:
    def row(k: int) -> Column:
        head = f'<h2 class="module-title type">V{k // 3 + 1}</h2>' if k % 3 == 0 else ""
        return _say(f'{head}<div class="module-row-info"><a class="module-row-text" href="/book/', F.col("p_partkey"), f'/{k + 1}.html">Chapter {k + 1} of ', F.col("p_name"), "</a></div>")

    return _pages(spark, d, ("/book/", F.col("p_partkey"), "/catalog"), _say(*[row(k) for k in range(CHAPTERS)]))


def _chapter_pages(spark: SparkSession, d: str) -> DataFrame:
    """Chapters with junk between their paragraphs; each fifth novel's are too short to be any."""
    rows = c.dealt(spark, d, "part", "p_partkey").select("p_partkey", "p_name", F.explode(F.sequence(F.lit(1), F.lit(CHAPTERS))).alias("k"))
    long = _say("<p>Paragraph ", F.col("k"), " tells of ", F.col("p_name"), " and of all that came of it in the end</p><p>no</p><p>Then it goes on for a while</p>")
    short = F.lit("<p>Not yet written</p>")
    body = _say('<div class="article-content"><script>track("</p>")</script><ins>buy this or that</ins>', F.when(F.col("p_partkey") % 5 == 0, short).otherwise(long), "</div>")
    return rows.select((F.col("p_partkey") * 100 + F.col("k")).alias("page_id"), _say(SITE, "/book/", F.col("p_partkey"), "/", F.col("k"), ".html").alias("url"), body.alias("html"))


_CONTENT = """CASE WHEN p_partkey % 5 = 0 THEN 'Not yet written'
       ELSE 'Paragraph ' || k || ' tells of ' || p_name || ' and of all that came of it in the end' || chr(10) || 'Then it goes on for a while' END"""
_ITEM = ".module-row-info a.module-row-text"


@query("""
SELECT p_partkey AS page_id, k - 1 AS position, CASE WHEN k <= 3 THEN 'V1' ELSE 'V2' END AS volume, 'Chapter ' || k || ' of ' || p_name AS title, k AS place
FROM part, (SELECT CAST(unnest(range(1, 7)) AS INT) AS k)""")
def catalog_chapters(spark: SparkSession, d: str) -> DataFrame:
    """A catalog's chapters under their volumes."""
    rows = crawl.catalogs(_catalog_pages(spark, d), "h2.type", _ITEM)
    # a header takes a position of its own
    return rows.select("page_id", (F.col("place") - 1).alias("position"), "volume", "title", "place")


@query(f"""
SELECT p_partkey AS page_id, 6 AS chapter_count, 'Chapter 1 of ' || p_name AS chapter_title, CAST(length({_CONTENT}) AS INT) AS content_length, length({_CONTENT}) >= 50 AS passed
FROM part, (SELECT 1 AS k)""")
def extraction_self_test(spark: SparkSession, d: str) -> DataFrame:
    """Whether a catalog can be read and its first chapter too."""
    found = crawl.catalogs(_catalog_pages(spark, d), "h2.type", _ITEM)
    return crawl.self_test(found, _chapter_pages(spark, d), ".article-content")


@query(f"""
SELECT '{SITE}/list/' || p_partkey AS url, p_partkey % 2 = 0 AS fetched, CASE WHEN p_partkey % 2 = 0 THEN 25 ELSE 0 END AS rows, CASE WHEN p_partkey % 2 = 0 THEN 20 ELSE 0 END AS shown FROM part""")
def rule_dry_run(spark: SparkSession, d: str) -> DataFrame:
    """A section tried on the addresses that its pattern gives; a half of these have no page."""
    body = _say(*[_say('<p class="row"><a href="/book/', F.col("p_partkey"), f'-{k}.html">', F.col("p_name"), "</a></p>") for k in range(25)])
    pages = _pages(spark, d, ("/list/", F.col("p_partkey")), body).where(F.col("page_id") % 2 == 0)
    wanted = c.table(spark, d, "part").select(crawl.section_url(SITE + "/list/{book_id}", book_id=F.col("p_partkey")).alias("url"))
    found = crawl.dry_run(wanted, pages, _CATALOG)
    return found.select("url", "fetched", F.col("rows").cast("int").alias("rows"), F.when(F.col("shown").isNotNull(), F.size("shown")).otherwise(0).alias("shown"))


@query(f"""
SELECT p_partkey AS novel_id, '{SITE}/book/' || p_partkey || '/' || k || '.html' AS url, 'Chapter ' || k || ' of ' || p_name AS title, k AS sort_order,
       CAST(len(regexp_extract_all({_CONTENT}, '[a-zA-Z]+')) AS INT) AS word_count, {_CONTENT} AS content
FROM part, (SELECT CAST(unnest(range(1, 7)) AS INT) AS k) WHERE p_partkey % 2 = 1 OR k > 2""")
def crawl_novels(spark: SparkSession, d: str) -> DataFrame:
    """A crawl as one plan: catalogs, minus what is known, with the texts of chapters, cleaned and numbered."""
    pages = _catalog_pages(spark, d)
    found = crawl.catalogs(pages, "h2.type", _ITEM).withColumn("novel_id", F.col("page_id"))
    known = c.table(spark, d, "part").where(F.col("p_partkey") % 2 == 0).select(
        F.col("p_partkey").alias("novel_id"), F.explode(F.sequence(F.lit(1), F.lit(2))).alias("sort_order"), F.col("p_name").alias("name")
    )
    # the first is known by its address, the second by its title and place
    first = F.col("sort_order") == 1
    known = known.select(
        "novel_id", "sort_order", F.when(first, _say(SITE, "/book/", F.col("novel_id"), "/1.html")).alias("url"),
        F.when(~first, _say("Chapter 2 of ", F.col("name"))).alias("title"),
    )
    return crawl.crawl(found, _chapter_pages(spark, d), known, ".article-content")


@query("""
SELECT page, links FROM (VALUES (1, 3), (2, 5)) v(page, links)""")
def pages_until_empty(spark: SparkSession, d: str) -> DataFrame:
    """Pages of a listing up to the first empty one."""
    counts = c.table(spark, d, "region").select((F.col("r_regionkey") + 1).cast("int").alias("page"))
    rows = counts.withColumn("links", F.element_at(F.array(*map(F.lit, (3, 5, 0, 4, 0))), F.col("page"))).withColumn("site", F.lit(1))
    return html.first_pages(rows, "page", "links", "site").select("page", "links")


@query(V("""
, page AS (SELECT 'page' AS section, row_number() OVER (ORDER BY updated_at DESC, id DESC) AS position, CAST(id AS VARCHAR) AS item, title FROM novel QUALIFY position <= 24),
categories AS (SELECT 'categories' AS section, row_number() OVER (ORDER BY category) AS position, category AS item, category AS title FROM (SELECT DISTINCT category FROM novel_category)),
sections AS (
  SELECT 'section ' || category AS section, row_number() OVER (PARTITION BY category ORDER BY updated_at DESC, id DESC) AS position, CAST(id AS VARCHAR) AS item, title
  FROM novel JOIN novel_category ON novel_id = id QUALIFY position <= 5),
ranking AS (SELECT 'ranking' AS section, row_number() OVER (ORDER BY total_chapters DESC, id) AS position, CAST(id AS VARCHAR) AS item, title FROM novel QUALIFY position <= 15),
lasts AS (SELECT novel_id, id AS chapter FROM chapter QUALIFY row_number() OVER (PARTITION BY novel_id ORDER BY sort_order DESC, id DESC) = 1),
latest AS (
  SELECT 'latest' AS section, row_number() OVER (ORDER BY updated_at DESC, id DESC) AS position, CAST(id AS VARCHAR) AS item, coalesce(chapter, '-') AS title
  FROM novel LEFT JOIN lasts ON novel_id = id QUALIFY position <= 25)
SELECT *, section = 'ranking' AND position <= 3 AS top FROM (
  SELECT * FROM page UNION ALL SELECT * FROM categories UNION ALL SELECT * FROM sections UNION ALL SELECT * FROM ranking UNION ALL SELECT * FROM latest)
""", c.NOVEL_SQL, c.BRIDGE_SQL, c.CHAPTER_SQL))  # fmt: skip
def home_page(spark: SparkSession, d: str) -> DataFrame:
    """All five parts of the home page, each cut before it is numbered."""
    newest = [F.desc("updated_at"), F.desc("id")]
    novels, bridge = c.novels(spark, d, counted=False, authored=False), c.novel_categories(spark, d)

    def numbered(rows: DataFrame, section: str, order: list[Column], item: str = "id", title: str = "title") -> DataFrame:
        place = F.row_number().over(Window.orderBy(*order)).cast("long")
        return rows.select(F.lit(section).alias("section"), place.alias("position"), F.col(item).cast("string").alias("item"), F.col(title).alias("title"))

    page = numbered(listing.page_of(novels, newest, 1, listing.SITE_PAGE_SIZE), "page", newest)
    names = bridge.select("category").distinct()
    categories = numbered(names, "categories", [F.asc("category")], "category", "category")
    tops = windows.first_per_key(novels.join(bridge, F.col("id") == F.col("novel_id")), "category", newest, 5, "position")
    sections = tops.select(_say("section ", F.col("category")).alias("section"), F.col("position").cast("long").alias("position"), F.col("id").cast("string").alias("item"), "title")
    hot = [F.desc("total_chapters"), F.asc("id")]
    ranking = numbered(links.hot_ranking(c.novels(spark, d, authored=False), 15), "ranking", hot)
    last = novels.orderBy(*newest).limit(25)
    own = c.chapters(spark, d).join(F.broadcast(last.select(F.col("id").alias("novel_id"))), "novel_id", "left_semi")
    chapter = windows.latest_chapter(own).select("novel_id", F.col("id").alias("chapter"))
    with_chapter = last.join(chapter, F.col("id") == F.col("novel_id"), "left").withColumn("chapter", F.coalesce("chapter", F.lit("-")))
    latest = numbered(with_chapter, "latest", newest, title="chapter")
    whole = page.unionAll(categories).unionAll(sections).unionAll(ranking).unionAll(latest)
    return whole.withColumn("top", (F.col("section") == "ranking") & (F.col("position") <= 3))


@query(V("""
, own AS (SELECT min(l_orderkey) AS key FROM lineitem)
SELECT 'novel' AS part, 1 AS position, CAST(id AS VARCHAR) AS item, title || ' - ' || coalesce(author, '') AS title FROM novel, own WHERE id = key
UNION ALL SELECT * FROM (SELECT 'chapter', row_number() OVER (ORDER BY sort_order DESC, id DESC) AS position, id, volume FROM chapter, own WHERE novel_id = key QUALIFY position <= 15)
UNION ALL SELECT 'category', row_number() OVER (ORDER BY category), category, category FROM novel_category, own WHERE novel_id = key
""", c.NOVEL_SQL, c.CHAPTER_SQL, c.BRIDGE_SQL))  # fmt: skip
def novel_detail(spark: SparkSession, d: str) -> DataFrame:
    """A novel, its fifteen newest chapters and its categories; its links are ``link_resolution``'s."""
    own = F.broadcast(c.table(spark, d, "lineitem").agg(F.min("l_orderkey").alias("novel_id")))
    novel = c.novels(spark, d, counted=False).join(own.withColumnRenamed("novel_id", "id"), "id", "left_semi").select(
        F.lit("novel").alias("part"), F.lit(1).cast("long").alias("position"), F.col("id").cast("string").alias("item"), F.concat_ws(" - ", "title", F.coalesce("author", F.lit(""))).alias("title")
    )
    newest = [F.desc("sort_order"), F.desc("id")]
    rows = listing.page_of(c.chapters(spark, d).join(own, "novel_id", "left_semi"), newest, 1, 15)
    chapters = rows.select(F.lit("chapter"), F.row_number().over(Window.orderBy(*newest)).cast("long"), "id", "volume")
    names = c.novel_categories(spark, d).join(own, "novel_id", "left_semi")
    categories = names.select(F.lit("category"), F.row_number().over(Window.orderBy("category")).cast("long"), "category", F.col("category").alias("c2"))
    return novel.unionAll(chapters).unionAll(categories)


@query()
def reader_chapter(spark: SparkSession, d: str) -> DataFrame:
    """Chapters with the ones around them, a page of their text by the site's own way of cutting, and five books at random."""
    rows = c.table(spark, d, "conversations").select(F.col("conv_id").alias("novel_id"), F.col("turn").alias("sort_order"), F.col("turn").alias("id"), "text")
    around = windows.with_neighbours(rows)
    by_size, by_number = pagination.paginate("text", "word_count", 300), pagination.paginate("text", "page_count", 2)
    pages = F.when(F.col("novel_id") % 3 == 0, by_size).when(F.col("novel_id") % 3 == 1, by_number).otherwise(F.array("text"))
    cut = around.withColumn("pages", pages)
    books = listing.random_sample(c.novels(spark, d, counted=False, authored=False).select(F.col("id").alias("book")), 5)
    shelf = books.agg(F.collect_list("book").alias("books"))
    return c.beside(cut, shelf).select(
        "novel_id", "sort_order", "prev_id", "next_id", F.size("pages").alias("n_pages"), pagination.page_at(F.col("pages"), F.lit(2)).alias("page_text"), "books"
    )


@query(V("""
, ranked AS (SELECT *, row_number() OVER (ORDER BY total_chapters DESC, id) AS place FROM novel QUALIFY place <= 8)
SELECT '' AS ring_name, place, '/novel/' || id AS url, title AS anchor_text FROM ranked""", c.NOVEL_SQL))  # fmt: skip
def link_fallback(spark: SparkSession, d: str) -> DataFrame:
    """Where no ring has an active target, the hot ranking is linked."""
    targets = c.link_targets(spark, d).withColumn("is_active", F.lit(False))
    return links.resolve_or_hot(c.rings(spark, d), targets, c.sites(spark, d), c.novels(spark, d), 3, "novel_detail")


@query(V("""
SELECT t.id, coalesce(n.title, '?') AS title, row_number() OVER (ORDER BY created_at, t.id) AS current, 8 AS batch,
       round_even(row_number() OVER (ORDER BY created_at, t.id) * 100.0::DOUBLE / 8, 1) AS percent
FROM (SELECT * FROM task WHERE status = 'pending' ORDER BY created_at, id LIMIT 8) t LEFT JOIN novel n ON n.id = t.novel_id""", c.TASK_SQL, c.NOVEL_SQL))  # fmt: skip
def queue_run(spark: SparkSession, d: str) -> DataFrame:
    """A batch of the queue as it is run: what is claimed, whose it is, and how far the batch then is."""
    claimed = merge.claim(c.tasks(spark, d), 8)
    titles = c.novels(spark, d, counted=False, authored=False).select(F.col("id").alias("novel_id"), "title")
    rows = titles.join(F.broadcast(claimed), "novel_id", "right")
    current = F.row_number().over(Window.orderBy("created_at", "id"))
    run = rows.select("id", F.coalesce("title", F.lit("?")).alias("title"), current.cast("long").alias("current"), F.lit(8).alias("batch"))
    return run.withColumn("percent", stats.percent(F.col("current"), F.col("batch")))


_KEYWORDS = " OR ".join(f"contains(title, '{w}') OR contains(content, '{w}')" for w in COMPLETE_WORDS)
_PLANTED = "CASE WHEN doc_id % 7 = 0 THEN '" + COMPLETE_WORDS[3] + "' ELSE source END AS title, CASE WHEN doc_id % 11 = 0 THEN text || '" + COMPLETE_WORDS[-1] + "' ELSE text END AS content"


@query(f"""
SELECT novel_id, count(*) AS chapters FROM (SELECT source AS novel_id, {_PLANTED} FROM documents) WHERE {_KEYWORDS} GROUP BY novel_id""")
def completed_by_keywords(spark: SparkSession, d: str) -> DataFrame:
    """Novels of which a chapter's title or text holds one of the fifteen words; all rows are looked at, in one pass."""
    title = F.when(F.col("doc_id") % 7 == 0, F.lit(COMPLETE_WORDS[3])).otherwise(F.col("source"))
    content = F.when(F.col("doc_id") % 11 == 0, F.concat("text", F.lit(COMPLETE_WORDS[-1]))).otherwise(F.col("text"))
    rows = c.table(spark, d, "documents").select(F.col("source").alias("novel_id"), title.alias("title"), content.alias("content"))
    return rows.where(listing.contains_any(COMPLETE_WORDS, "title", "content")).groupBy("novel_id").agg(F.count(F.lit(1)).alias("chapters"))


@query("""
WITH ends AS (SELECT user_id, min((ts, event_id)) AS finish FROM events WHERE event_type = 'purchase' GROUP BY user_id)
SELECT user_id AS task_id, count(*) AS drained, max(ts) AS done_at FROM events JOIN ends USING (user_id) WHERE (ts, event_id) > finish OR (ts, event_id) = finish GROUP BY user_id""")
def drained_events(spark: SparkSession, d: str) -> DataFrame:
    """Of each finished task, the events from its finish on, after which its stream is done."""
    rows = c.table(spark, d, "events").select(F.col("user_id").alias("task_id"), F.col("event_type").alias("type"), "ts", "event_id")
    return progress.drained(rows, "purchase")


@query("""
SELECT 'category' AS kind, p_type AS name, row_number() OVER (ORDER BY p_type) AS place FROM (SELECT DISTINCT p_type FROM part)
UNION ALL SELECT 'ring', r_name, row_number() OVER (ORDER BY r_regionkey DESC) FROM region
UNION ALL SELECT 'site', n_name, row_number() OVER (ORDER BY n_nationkey DESC) FROM nation""")
def menus_in_order(spark: SparkSession, d: str) -> DataFrame:
    """Categories by their order, rings and sites the newest first."""
    def placed(rows: DataFrame, kind: str, name: str, order: Column) -> DataFrame:
        return rows.select(F.lit(kind).alias("kind"), F.col(name).alias("name"), F.row_number().over(Window.orderBy(order)).cast("long").alias("place"))

    categories = placed(c.table(spark, d, "part").select("p_type").distinct(), "category", "p_type", F.asc("p_type"))
    rings = placed(c.rings(spark, d), "ring", "ring_name", F.desc("ring_id"))
    return categories.unionAll(rings).unionAll(placed(c.sites(spark, d), "site", "name", F.desc("id")))


@query(V("""
SELECT id, sort_order, word_count FROM chapter WHERE novel_id = (SELECT max(l_orderkey) FROM lineitem) ORDER BY sort_order, id LIMIT 50""", c.CHAPTER_SQL))  # fmt: skip
def novel_chapters(spark: SparkSession, d: str) -> DataFrame:
    """A page of fifty of a novel's chapters in their order."""
    own = F.broadcast(c.table(spark, d, "lineitem").agg(F.max("l_orderkey").alias("novel_id")))
    rows = c.chapters(spark, d).join(own, "novel_id", "left_semi")
    return listing.page_of(rows, [F.asc("sort_order"), F.asc("id")], 1, 50).select("id", "sort_order", "word_count")


@query("""
SELECT p_brand AS query, 'Found ' || count(*) || ' for "' || p_brand || '"' AS message FROM part GROUP BY p_brand""")
def search_messages(spark: SparkSession, d: str) -> DataFrame:
    counts = c.table(spark, d, "part").groupBy(F.col("p_brand").alias("query")).agg(F.count(F.lit(1)).alias("count"))
    return counts.select("query", text.fill(F.lit('Found {count} for "{query}"'), {"query": F.col("query"), "count": F.col("count")}).alias("message"))


@query("SELECT count(*) AS rows, count(*) AS distinct_ids, count(*) AS well_formed FROM supplier")
def new_ids(spark: SparkSession, d: str) -> DataFrame:
    """A random id for each row: as many different ones as rows, all of version 4."""
    ids = c.table(spark, d, "supplier").select(F.uuid().alias("id"))
    good = F.col("id").rlike("^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$")
    return ids.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("id").alias("distinct_ids"), F.count_if(good).alias("well_formed"))


@query("""
SELECT user_id AS task_id, arg_max(event_type, (ts, event_id)) AS status, arg_max(event_id, (ts, event_id)) AS worker FROM events GROUP BY 1
UNION ALL SELECT 100000 + r_regionkey, 'kept', r_regionkey FROM region""")
def session_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Sessions as their last message leaves them: known ones are replaced, new ones added."""
    messages = c.table(spark, d, "events").select(F.col("user_id").alias("task_id"), F.col("event_type").alias("status"), F.col("event_id").alias("worker"), "ts", "event_id")
    old = messages.select("task_id", F.lit("old").alias("status"), F.lit(0).cast("long").alias("worker")).distinct().where(F.col("task_id") % 2 == 0)
    others = c.table(spark, d, "region").select((F.lit(100_000) + F.col("r_regionkey")).cast("long"), F.lit("kept"), F.col("r_regionkey").cast("long"))
    return merge.upsert_last(old.unionAll(others), messages, "task_id", ["ts", "event_id"])


@query(V("""
SELECT id, 'gone' AS what FROM chapter WHERE novel_id = (SELECT min(l_orderkey) FROM lineitem) AND sort_order <= 2""", c.CHAPTER_SQL))  # fmt: skip
def delete_in_scope(spark: SparkSession, d: str) -> DataFrame:
    """What a delete by a list of ids removes: only chapters of the one novel, though the list names others too."""
    rows = c.chapters(spark, d)
    own = F.broadcast(c.table(spark, d, "lineitem").agg(F.min("l_orderkey").alias("novel_id")))
    listed = rows.where(F.col("sort_order") <= 2).select("id").distinct()
    scope = rows.join(own.withColumn("inside", F.lit(True)), "novel_id", "left")
    return merge.deleted(scope, listed, "id", F.col("inside")).select("id", F.lit("gone").alias("what"))


@query("""
SELECT user_id AS id, epoch(TIMESTAMP '2024-02-05') - floor(epoch(max(ts))) > 604800 AS swept FROM events WHERE user_id % 3 <> 0 GROUP BY user_id""")
def lease_sweep(spark: SparkSession, d: str) -> DataFrame:
    """Which held locks are over and are freed."""
    locks = c.table(spark, d, "events").where(F.col("user_id") % 3 != 0).groupBy(F.col("user_id").alias("id")).agg(F.max("ts").alias("locked_at"))
    swept = merge.sweep(locks.withColumn("owner", F.lit("other")).withColumn("ttl", F.lit(604_800)), F.lit("2024-02-05").cast("timestamp"))
    return swept.select("id", "swept")


@query("""
SELECT event_type AS status, user_id % 10 AS page_type, count(*) AS n, round(avg(value), 4) AS mean_ms, min(value) AS min_ms, max(value) AS max_ms FROM events GROUP BY 1, 2""")
def status_histogram(spark: SparkSession, d: str) -> DataFrame:
    """How often each outcome came on each kind of page, and how long it took."""
    rows = c.table(spark, d, "events").select(F.col("event_type").alias("status"), (F.col("user_id") % 10).alias("page_type"), "value")
    return rows.groupBy("status", "page_type").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 4).alias("mean_ms"), F.min("value").alias("min_ms"), F.max("value").alias("max_ms")
    )


_TITLED = "CASE p_partkey % 5 WHEN 0 THEN '404 ' || p_type WHEN 1 THEN 'a long title that speaks of the number 404' WHEN 2 THEN '笔趣阁' WHEN 3 THEN 'Book-' || p_partkey ELSE p_name END"


@query(f"""
SELECT id, title, ({" OR ".join(f"contains(title, '{m}')" for m in NOISE_MARKERS)}) AND length(title) < 20 AS noise,
       NOT ({" OR ".join(f"contains(lower(title), '{m.lower()}')" for m in BAD_TITLE_MARKERS)} OR title IN ({", ".join(f"'{t}'" for t in BAD_TITLES)})
            OR regexp_matches(title, '^(Book-|Chapter-)[0-9]+$')) AND length(title) BETWEEN 2 AND 80 AS usable
FROM (SELECT p_partkey AS id, {_TITLED} AS title FROM part)""")
def noise_titles(spark: SparkSession, d: str) -> DataFrame:
    """Titles that are an error's or a site's own, and those that a repair may take."""
    kind = F.col("p_partkey") % 5
    title = F.when(kind == 0, _say("404 ", F.col("p_type"))).when(kind == 1, F.lit("a long title that speaks of the number 404")).when(kind == 2, F.lit("笔趣阁")).when(kind == 3, _say("Book-", F.col("p_partkey"))).otherwise(F.col("p_name"))
    rows = c.table(spark, d, "part").select(F.col("p_partkey").alias("id"), title.alias("title"))
    bad = F.col("title").isin(*BAD_TITLES) | F.col("title").rlike(r"^(Book-|Chapter-)\d+$")
    for m in BAD_TITLE_MARKERS:
        bad = bad | F.lower("title").contains(m.lower())
    return rows.select("id", "title", crawl.noise_title(F.col("title"), NOISE_MARKERS).alias("noise"), (~bad & F.length("title").between(2, 80)).alias("usable"))
