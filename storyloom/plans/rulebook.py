"""Rules as rows: three sites that are read by rules of their own in one plan, and a crawl that a rule drives (HTM02-04, HTM18, CMP08).

Pages are made from ``part``, so that what must come out of each branch of a rule is known.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


from ..operators import crawl, rules
from ..registry import query
from ..sources import catalog as c
from .compositions import _say

SITE = "https://books.example.com"

#: Three rules: results with attributes, prefixes and patterns; results told by their texts; a novel's page.
RULES = {
    "0": {"base_url": SITE, "selectors": {"search": {"container": ".hit", "fields": {
        "title": {"selector": "a[title]", "attribute": "title", "fallback_selector": "h3 > a"},
        "author": {"selector": "p .by", "transform": "strip_prefix:by ", "fallback_selector": ".who", "fallback_transform": "strip_suffix: (pen name)"},
        "url": {"selector": "a[href*='/book/']", "attribute": "href", "transform": "absolute_url"},
        "book_id": {"selector": "a[href*='/book/']", "attribute": "href", "transform": "regex", "transform_pattern": "/book/(\\d+)"},
        "note": {"selector": ".never, .note", "fallback": "no note"},
    }}}},
    "1": {"base_url": SITE, "selectors": {"search": {"container": "ul.found > li", "fields": {
        "title": {"selector": "b"},
        "author": {"fallback": "text_split", "split_pattern": "/", "split_index": 1},
        "url": {"fallback": "from_url"},
        "book_id": {"fallback": "from_url", "transform": "regex", "transform_pattern": "key=[a-z]*"},
        "note": {"selector": "i.never", "fallback": "text_after_title"},
    }}}},
    "2": {"base_url": SITE, "cleaner": {"enabled": True}, "selectors": {"search": {"container": "body", "fields": {
        "_cleanup": ["script", ".ad"],
        "title": {"selector": "meta[property='og:title']", "attribute": "content", "fallback_selector": "h1"},
        "author": {"selector": "#info a[title]", "attribute": "title", "transform": "strip_prefix:作者："},
        "url": {"selector": "link[rel='canonical']", "attribute": "href", "fallback": "/none", "transform": "absolute_url"},
        "book_id": {"selector": ".state", "transform": "status_map"},
        "note": {"selector": "div.text"},
    }}}},
}


def rule_rows(spark: SparkSession, rulebook: dict[str, dict]) -> DataFrame:
    return spark.createDataFrame([(site, json.dumps(rule)) for site, rule in rulebook.items()], "site string, rule string")


def _result_pages(spark: SparkSession, d: str) -> DataFrame:
    """A page of its site's kind for each part; odd ones lack what selectors look for first."""
    key, name, brand = F.col("p_partkey"), F.col("p_name"), F.col("p_brand")
    odd = F.col("p_size") % 2 == 1
    hit = _say(
        '<div class="hit">', F.when(odd, _say("<h3><a>", name, "</a></h3>")).otherwise(_say('<a title="', name, '">cover</a>')), '<div><a href="/book/', key, '.html">go</a></div>',
        F.when(odd, _say('<span class="who"> ', brand, " (pen name)</span>")).otherwise(_say('<p><em><span class="by">by ', brand, "</span></em></p>")),
        F.when(odd, F.lit("")).otherwise(F.lit('<p class="small note">a &amp; b</p>')), "</div>",
    )
    told = _say('<ul class="found"><li><b>', name, "</b> / ", brand, " / ", F.col("p_type"), " .</li><ol><li><b>no</b></li></ol><li>", brand, "/", name, "</li></ul><li><b>no</b></li>")
    novel = _say(
        "<html><head><script>var a = '<h1>x</h1>';</script>", F.when(odd, F.lit("")).otherwise(_say('<meta property="og:title" content="', name, '">')),
        F.when(odd, F.lit("")).otherwise(F.lit('<link rel="canonical" href="../n/7.html">')), '</head><body><h1 class="page-title">', name, '</h1><div id="info"><a title="作者：', brand, '">x</a></div>',
        '<p class="state">', F.when(odd, F.lit("完结")).otherwise(F.lit("停更")), '</p><div class="text">It is <span class="ad">BUY <b>NOW</b></span>about ', name, "<script>no()</script> and more</div></body></html>",
    )
    site = (key % 3).cast("string")
    body = F.when(site == "0", F.concat(hit, hit)).when(site == "1", told).otherwise(novel)
    return c.dealt(spark, d, "part", "p_partkey").select(
        key.alias("page_id"), site.alias("site"), F.lit("search").alias("section"), _say(SITE, "/find?key=", F.lower(F.regexp_replace(brand, "[^A-Za-z]", ""))).alias("url"), body.alias("html")
    )


@query(f"""
WITH pages AS (SELECT *, p_size % 2 = 1 AS odd, '{SITE}/find?key=' || lower(regexp_replace(p_brand, '[^A-Za-z]', '', 'g')) AS url FROM part)
SELECT p_partkey AS page_id, '0' AS site, CAST(n AS INT) AS position, p_name AS title, p_brand AS author, '{SITE}/book/' || p_partkey || '.html' AS url, CAST(p_partkey AS VARCHAR) AS book_id,
       CASE WHEN odd THEN 'no note' ELSE 'a & b' END AS note
FROM pages, range(2) r(n) WHERE p_partkey % 3 = 0
UNION ALL SELECT p_partkey, '1', CAST(n AS INT), CASE n WHEN 0 THEN p_name ELSE '' END, CASE n WHEN 0 THEN p_brand ELSE p_name END, url, regexp_extract(url, 'key=[a-z]*'),
       CASE n WHEN 0 THEN '/ ' || p_brand || ' / ' || p_type ELSE p_brand || '/' || p_name END FROM pages, range(2) r(n) WHERE p_partkey % 3 = 1
UNION ALL SELECT p_partkey, '2', 0, p_name, p_brand, CASE WHEN odd THEN '{SITE}/none' ELSE '{SITE}/n/7.html' END, CASE WHEN odd THEN 'completed' ELSE '停更' END,
       'It is about ' || p_name || ' and more' FROM pages WHERE p_partkey % 3 = 2""")
def rules_of_three_sites(spark: SparkSession, d: str) -> DataFrame:
    """Pages of three sites, each read by its own rule: attributes, fallbacks of all kinds, transforms, removals, cleaning."""
    found = rules.apply(_result_pages(spark, d), rule_rows(spark, RULES))
    return found.select("page_id", "site", "position", *[F.col("fields")[f].alias(f) for f in ("title", "author", "url", "book_id", "note")])


#: A rule for a whole crawl: facts of a novel, its catalog, and its chapters.
CRAWL_RULE = {"base_url": SITE, "cleaner": {"enabled": True}, "selectors": {
    "novel_info": {"container": "", "fields": {"title": {"selector": "h1"}, "author": {"selector": ".by"}, "cover": {"selector": "img", "attribute": "src", "transform": "absolute_url"}}},
    "catalog": {"url": "{base_url}/book/{book_id}/catalog", "container": ".row", "fields": {"title": {"selector": "a"}, "url": {"selector": "a", "attribute": "href", "transform": "absolute_url"}}},
    "chapter": {"fields": {"content": {"selector": ".article", "cleanup": ["ins"]}, "title": {"selector": "h2"}}},
}}


def _crawl_pages(spark: SparkSession, d: str) -> DataFrame:
    """Of each part: a novel's page, a catalog of three rows and its chapters, as a fetcher would store them."""
    key, name = F.col("p_partkey"), F.col("p_name")

    def page(section: str, address: Column, body: Column) -> Column:
        return F.struct(F.lit(section).alias("section"), address.alias("url"), body.alias("html"))

    row = [_say('<p class="row"><a href="/book/', key, f'/{k}.html">Chapter {k} of ', name, "</a></p>") for k in (1, 2, 3)]
    chapters = [
        page("chapter", _say(SITE, "/book/", key, f"/{k}.html"), _say(f"<h2>Chapter {k}</h2><div class=article>Part {k} tells of <ins>ads and </ins>", name, " at great length</div>")) for k in (1, 2, 3)
    ]
    facts = page("novel_info", _say(SITE, "/book/", key, "/"), _say("<h1>", name, "</h1><i class=by>", F.col("p_brand"), '</i><img src="/c/', key, '.jpg">'))
    pages = F.array(facts, page("catalog", _say(SITE, "/book/", key, "/catalog"), _say(*row)), *chapters)
    rows = c.dealt(spark, d, "part", "p_partkey").where(key % 2 == 0).select(key, "p_name", "p_brand")
    return rows.select(key.alias("novel_id"), F.posexplode(pages).alias("n", "page")).select("novel_id", (F.col("novel_id") * 10 + F.col("n")).alias("page_id"), F.lit("s").alias("site"), "page.*")


@query(f"""
SELECT p_partkey AS novel_id, p_name AS novel, p_brand AS author, '{SITE}/c/' || p_partkey || '.jpg' AS cover, CAST(k AS INT) AS sort_order, 'Chapter ' || k || ' of ' || p_name AS title,
       CAST(len(regexp_extract_all('Part tells of at great length ' || p_name, '[a-zA-Z]+')) AS INT) AS word_count, 'Part ' || k || ' tells of ' || p_name || ' at great length' AS content
FROM part, range(1, 4) r(k) WHERE p_partkey % 2 = 0 AND NOT (p_partkey % 4 = 0 AND k = 1)""")
def crawl_by_rule(spark: SparkSession, d: str) -> DataFrame:
    """A crawl that one rule drives: facts fill what the table lacks, the catalog gives what is new, chapters are read and numbered."""
    pages = _crawl_pages(spark, d)
    found = rules.apply(pages.withColumn("page_url", F.col("url")), rule_rows(spark, {"s": CRAWL_RULE}), carry=["novel_id", "page_url"])
    # a fourth of the novels have their first chapter, and a title of their own already
    known = c.table(spark, d, "part").where(F.col("p_partkey") % 4 == 0).select(
        F.col("p_partkey").alias("novel_id"), _say(SITE, "/book/", F.col("p_partkey"), "/1.html").alias("url"), F.lit("Chapter 1").alias("title"), F.lit(1).alias("sort_order")
    )
    facts = c.table(spark, d, "part").select(F.col("p_partkey").alias("novel_id"), F.when(F.col("p_partkey") % 4 == 0, F.col("p_name")).alias("title"))
    return crawl.by_rule(found, facts, known).select("novel_id", "novel", "author", "cover", "sort_order", "title", "word_count", "content")
