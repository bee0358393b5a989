"""Pages as rows of nodes: depth, broken tags, selectors, removals, addresses; and rules as rows."""

import json
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from storyloom.functions import text
from storyloom.operators import html, rules

from test_operators import values

SCHEMA = "page_id int, url string, html string"


def test_deep_pages(spark):
    """100,000 tags that nothing closes, and as many end tags that close nothing."""
    deep = "<div>" * 100_000 + "<p class=x>in</p>" + "</b>" * 100_000
    pages = spark.createDataFrame([(1, None, deep), (2, None, "<p>a<p>b</div></p>c")], SCHEMA)
    assert html.nodes(pages).groupBy("page_id").agg(F.max("depth")).orderBy("page_id").collect()[0][1] == 100_001
    fields = {"in": {"selectors": ["div > div p.x"]}, "last": {"selectors": ["p + p", "p"], "nth": 1}}
    assert values(html.extract(pages, {"in": fields["in"]}), "page_id") == [(1, 0, "in"), (2, 0, None)]
    assert values(html.nodes(pages).where("page_id = 2").select("position", "parent", "upto", "tag"), "position") == [(0, -1, 2, ""), (1, 0, 1, "p"), (2, 0, 2, "p")]


PAGE = """<section id=top><div class="a b"><p lang=en>one</p><div><p>two</p></div></div></section>
<div class=b><p lang=de>three <i>3</i></p></div><p>four</p><a href="/x?y=1#z" rel="next to">go</a>"""
SELECTORS = {
    "p": ["one", "two", "three 3", "four"], "div > p": ["one", "two", "three 3"], ".a p": ["one", "two"], ".a > p": ["one"], "div div p": ["two"], ".a.b > div > p": ["two"], ".b > p": ["one", "three 3"],
    "#top .b p[lang]": ["one"], "p[lang=de], i": ["three 3", "3"], "[lang^='e']": ["one"], "[href*='?y=']": ["go"], "a[rel~=to]": ["go"], "a[href$='#z']": ["go"], "section > p": [], "*[lang] > i": ["3"], "p, p": ["one", "two", "three 3", "four"],
}


def test_selectors(spark):
    pages = spark.createDataFrame([(1, "", PAGE)], SCHEMA)
    steps, deepest = html.steps_table(spark, {s: s for s in SELECTORS})
    found = html.matches(html.nodes(pages), steps, deepest=deepest).join(html.page_texts(pages), "page_id")
    said = html.shown(html.raw_text(F.col("page_text"), F.col("text_from"), F.col("text_to")))
    rows = found.select("sel", "position", said.alias("text")).orderBy("position").collect()
    assert {s: [r.text for r in rows if r.sel == s] for s in SELECTORS} == SELECTORS
    with pytest.raises(ValueError, match="chain of 5"):
        html.steps_of("x", "a b c d e")


def test_bodies(spark):
    pages = spark.createDataFrame(
        [
            (1, "", "<article><p>long enough</p><p>no</p><ins>buy <p>this thing here</p></ins><div><p>nested, too <ins>x</ins>!</p></div></article><p>outside of it</p>"),
            (2, "", "<article><div>a block of some length</div><div>short</div><b><div>no child of the box at all</div></b></article>"),
            (3, "", "<article>bare <script>no</script>text</article>"), (4, "", "no box <p>hi</p>"), (5, "", None), (6, "", "<ins>only junk</ins>"),
        ],
        SCHEMA,
    )
    wanted = [(1, "long enough\n\nnested, too !"), (2, "a block of some length"), (3, "bare text"), (4, "no box hi"), (5, ""), (6, "")]
    assert values(html.body_text(pages, "article"), "page_id") == wanted


def test_catalogs_and_links(spark):
    page = "<h2>V1</h2><a href=1>one</a><h2><a href=in>V2</a></h2><a href=2>two</a><a>none</a><nav><a href=3>three</a></nav><a href=1 title=t></a>"
    pages = spark.createDataFrame([(1, "http://h/b/", page)], SCHEMA)
    rows = html.catalog_rows(pages, "h2", "a[href]").select("position", "volume", "title", "url")
    assert values(rows, "position") == [(1, "V1", "one", "http://h/b/1"), (3, "V2", "V2", "http://h/b/in"), (4, "V2", "two", "http://h/b/2"), (5, "V2", "three", "http://h/b/3"), (6, "V2", "", "http://h/b/1")]
    links = html.harvest_links(pages, "^http").select("position", "href", "title")
    assert values(links, "position") == [(0, "http://h/b/1", "one"), (1, "http://h/b/in", "V2"), (2, "http://h/b/2", "two")]


def test_addresses(spark):
    bases = ["http://h/a/b.html?q#f", "https://h", "http://h/", "http://h/a/", "http://h/a?x=/y/"]
    urls = ["c", "./c", "../c", "../../../c", "/c/../d", "/", "?p=1", "#x", "", "//o/x", "https://o/x", "mailto:a@b", "c/./d/", "c?x=../y", "..", "a/..", "."]
    rows = spark.createDataFrame([(b, u) for b in bases for u in urls], "b string, u string")
    for b, u, got in values(rows.select("b", "u", text.join_url(F.col("b"), F.col("u")))):
        assert got == urljoin(b, u), (b, u)


def test_rules_decide_by_row(spark):
    """Sites with other rules for the same section, a site without one, a section without one, and a null rule."""
    book = {
        "a": {"base_url": "http://a", "selectors": {"s": {"container": ".row", "fields": {"title": {"selector": "b"}, "rest": {"fallback": "text_after_title"}, "author": {"selector": "i"}}}}},
        "b": {"base_url": "http://b", "selectors": {"s": {"fields": {"author": {"selector": "i"}, "title": {"selector": "b", "transform": "regex", "transform_pattern": "no"}, "rest": {"fallback": "text_after_title", "transform": "strip_suffix:!"}}}}},
        "e": {"selectors": {"s": {"container": "BODY", "fields": {"title": {"selector": "b", "attribute": "title"}, "author": {"selector": "i"}, "rest": {"fallback": "text_after_title"}}}}},
    }
    ruled = spark.createDataFrame([(k, json.dumps(v)) for k, v in book.items()] + [("c", None)], "site string, rule string")
    page = "<div class=row><b>T</b><i>A</i> more .</div><div class=row>x</div>"
    rows = [(1, "a", "s", "u", page), (2, "b", "s", "u", "<p>x <b> T </b><i>A</i>B !</p>"), (3, "c", "s", "u", page), (4, "d", "s", "u", page), (5, "a", "other", "u", page), (6, "b", "s", "u", None), (7, "e", "s", "u", "<b title=T>TA rest.</b><i>A</i>")]
    pages = spark.createDataFrame(rows, "page_id int, site string, section string, url string, html string")
    found = {(r.page_id, r.position): r.fields for r in rules.apply(pages, ruled).collect()}
    assert found == {
        (1, 0): {"title": "T", "rest": "A more", "author": "A"}, (1, 1): {"title": "", "rest": "x", "author": ""},
        (2, 0): {"author": "A", "title": "T", "rest": "A B "}, (7, 0): {"title": "T", "author": "A", "rest": "rest. A"}, (6, 0): {"author": "", "title": "", "rest": ""},
    }
