"""Pages, texts and known chapters are joined without a broadcast, whatever their files' size says, and give the same rows."""

import pytest
from pyspark.sql import functions as F

from storyloom.operators import crawl
from storyloom.plans import QUERIES

from test_html import SCHEMA

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["rule_dry_run", "crawl_novels", "extraction_self_test"])
def test_no_broadcast(spark, name):
    plan = QUERIES[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_only_rules_are_broadcast(spark):
    """A crawl by rules sends these to all tasks, three small tables, and nothing that grows with novels."""
    plan = QUERIES["crawl_by_rule"](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") == 3


def test_first_chapters_alone_are_read(spark):
    """Pages are met before they are parsed: of all chapters' pages, only those that a catalog begins with."""
    plan = QUERIES["extraction_self_test"](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("MapInArrow") < plan.index("SortMergeJoin")


def test_self_test_of_all_kinds(spark):
    """Two pages at an address, one without html, one without a key, one that nothing links, and a catalog without a page."""
    rows = [(1, 1, "a", "x"), (1, 2, "b", "y"), (2, 1, "c", "z"), (3, 1, "d", "x"), (4, 1, "gone", "w"), (5, 1, None, "v")]
    catalog = spark.createDataFrame(rows, "page_id long, place int, url string, title string")
    text = "long enough to be told apart from all that is too short to be"
    pages = spark.createDataFrame([(10, "a", f"<div class=c><p>{text}</p></div>"), (11, "a", "<div class=c>few</div>"), (12, "b", "<p>no</p>"), (13, "c", None), (None, "d", "some words"), (15, None, "x")], SCHEMA)
    got = crawl.self_test(catalog, pages, ".c").select("page_id", "chapter_count", "chapter_title", "content_length", "passed")
    long = len(text)
    assert sorted(map(tuple, got.collect())) == [(1, 2, "x", 3, False), (1, 2, "x", long, True), (2, 1, "z", 0, False), (3, 1, "x", 10, False), (4, 1, "w", 0, False), (5, 1, "v", 0, False)]


def test_pages_read_once(spark):
    """A dry run makes its pages once, not once more for the addresses that have none."""
    plan = QUERIES["rule_dry_run"](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 2


@pytest.mark.parametrize("container", ["p", None])
def test_pages_of_all_kinds(spark, container):
    """Two pages at one address, a page without html, one without a key, and no page, read by rows and as whole pages."""
    wanted = spark.createDataFrame([("a",), ("b",), ("c",), ("d",), (None,)], "url string")
    pages = spark.createDataFrame([(1, "a", "<p>1</p>"), (2, "a", "<p>2</p><p>3</p>"), (3, "b", None), (None, "d", "<p>4</p>"), (5, None, "<p>5</p>")], SCHEMA)
    fields = {"t": {"selectors": ["&" if container else "p"]}}
    got = crawl.dry_run(wanted, pages, {"container": container, "fields": fields}).select("url", "fetched", "rows", F.col("shown.t").alias("t")).collect()
    whole = [("a", True, 1, ["2"]), ("a", True, 1, ["1"])]
    ruled = [("a", True, 1, ["1"]), ("a", True, 2, ["2", "3"])]
    rest = [("b", True, 0, None), ("c", False, 0, None), ("d", True, 1, ["4"]), (None, False, 0, None)]
    assert sorted(map(tuple, got), key=str) == sorted([*(ruled if container else whole), *rest], key=str)
