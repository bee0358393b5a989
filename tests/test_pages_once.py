"""Each page is parsed once and shuffled once: what selectors find, with texts and cuts, and the plans of queries over pages."""

import pytest
from pyspark.sql import functions as F

from storyloom.operators import html
from storyloom.plans import QUERIES

from test_html import PAGE, SCHEMA, SELECTORS
from test_operators import values

SF_DIR = "/root/testdata/sf0.001"


def test_hits(spark):
    pages = spark.createDataFrame([(1, "", PAGE)], SCHEMA)
    found = html.hits(pages, "page_id", html.asks({s: s for s in SELECTORS}, SELECTORS)).select("sel", "position", html.shown(F.col("text")).alias("text"))
    rows = found.orderBy("position").collect()
    assert {s: [r.text for r in rows if r.sel == s] for s in SELECTORS} == SELECTORS


def test_cuts(spark):
    """Cuts in cuts, at both ends, and around a match; a page of its own where nothing is found."""
    page = "<ins>a</ins><div>b<ins>c<ins>d</ins></ins>e<ins><i>f</i></ins></div><i>g</i>"
    pages = spark.createDataFrame([(1, "", page), (2, "", "<ins>x</ins>y"), (3, "", None)], SCHEMA)
    asked = html.asks({"box": "div", "i": "i"}, ["box", "page"], "ins", "page", "box")
    found = html.hits(pages, "page_id", asked).select("page_id", "sel", html.shown(F.col("text")))
    assert sorted(values(found, "page_id"), key=str) == [(1, "box", "be"), (1, "i", None), (2, "page", "y"), (3, "page", "")]


def test_nested_rows(spark):
    """Rows in rows have the nearest match each, and an n-th past the last is none."""
    page = "<div class=r>one<a>1</a><div class=r><b>x</b></div></div><div class=r><a>2</a><a> </a><a>4</a></div>"
    pages = spark.createDataFrame([(1, "", page)], SCHEMA)
    fields = {"a": {"selectors": ["a"]}, "second": {"selectors": ["a"], "nth": 1}, "third": {"selectors": ["a"], "nth": 2}, "own": {"selectors": ["b", "&"]}}
    assert values(html.extract(pages, fields, ".r"), "position") == [(1, 0, "1", None, None, "x"), (1, 1, None, None, None, "x"), (1, 2, "2", None, "4", "2 4")]


def test_references(spark):
    """Only the references that are named, and only whole ones, are decoded; all of HTML's without it."""
    pages = spark.createDataFrame([(1, "", "<title>a &amp;lt; b &quot; c &amp</title>")], SCHEMA)
    fields = {"title": {"selectors": ["title"]}}
    assert values(html.extract(pages, fields, references=["lt", "gt", "amp"]), "page_id") == [(1, 0, "a &lt; b &quot; c &amp")]
    assert values(html.extract(pages, fields), "page_id") == [(1, 0, 'a &lt; b " c &')]


ONCE = {
    "html_fields": 1, "html_links": 1, "catalog_chapters": 1, "search_results": 1, "category_listing": 1, "novel_info": 1, "cover_cascade": 1, "rule_dry_run": 1, "rule_harvest": 1,
    "extraction_self_test": 2, "crawl_novels": 2, "listing_harvest": 2, "rules_of_three_sites": 1, "crawl_by_rule": 1,
}


@pytest.mark.parametrize("name", ONCE)
def test_parsed_once(spark, name):
    """Each kind of page is parsed once, and the plan is short enough for a small driver."""
    plan = QUERIES[name](spark, SF_DIR)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow run(") == ONCE[name]
    assert len(plan) < 120_000


def test_most_pages_have_none(spark):
    """A rule tried on pages of which some have no rows, more than are shown, or no page."""
    from storyloom.operators import crawl

    wanted = spark.createDataFrame([("a",), ("b",), ("c",), ("a",)], "url string")
    pages = spark.createDataFrame([(1, "a", "<p class=r>1</p><p class=r>2</p><p class=r>3</p>"), (2, "b", "<p>1</p>"), (3, "z", "")], SCHEMA)
    got = crawl.dry_run(wanted, pages, {"container": ".r", "fields": {"t": {"selectors": ["&"]}}}, shown=2)
    assert [(r.url, r.fetched, r.rows, r.shown and [(s.position, s.t) for s in r.shown]) for r in got.orderBy("url").collect()] == [("a", True, 3, [(0, "1"), (1, "2")]), ("b", True, 0, None), ("c", False, 0, None)]
