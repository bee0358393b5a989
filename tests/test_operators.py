from datetime import datetime, timedelta

from pyspark.sql import functions as F

from storyloom.operators import html, links, listing, matching, merge, pagination, stats, windows
from storyloom.streaming import limits


def values(frame, *order):
    return [tuple(r) for r in (frame.orderBy(*order) if order else frame).collect()]


def test_volumes_fill_down_and_group(spark):
    rows = spark.createDataFrame([(1, i, i, v) for i, v in enumerate(["", "卷一", None, "卷二", "卷二", " "], 1)] + [(2, 1, 1, None)], "novel_id int, sort_order int, id int, volume string")
    found = windows.volumes(rows).select("volume", "chapters", "first_order", "last_order")
    assert values(found, "first_order") == [("正文", 1, 1, 1), ("卷一", 2, 2, 3), ("卷二", 3, 4, 6)]


def test_neighbours_skip_ties(spark):
    rows = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, 2, "c"), (1, 3, "d")], "novel_id int, sort_order int, id string")
    found = windows.with_neighbours(rows).select("id", "prev_id", "next_id")
    assert values(found, "id") == [("a", None, "b"), ("b", "a", "d"), ("c", "a", "d"), ("d", "c", None)]


def test_nearest_rank(spark):
    rows = spark.range(1, 11).select(F.col("id").cast("int").alias("v"), F.lit(1).alias("g"))
    assert values(stats.nearest_rank(rows, "v", ["g"]).select("requests", "p50", "p90", "p99")) == [(10, 6, 10, 10)]
    doubled = rows.unionAll(rows)
    assert values(stats.nearest_rank(doubled, "v", ["g"]).select("requests", "p50")) == [(20, 6)]
    empty = rows.where("v < 0")
    assert stats.nearest_rank(empty, "v", ["g"]).isEmpty()


def test_nearest_rank_of_many_values(spark):
    rows = spark.range(60_000).select(
        F.when(F.col("id") % 3 == 0, None).otherwise(F.col("id") % 2).alias("g"),
        F.when(F.col("id") % 7 == 0, F.lit(5.0)).otherwise(F.exp(F.pmod(F.hash("id"), F.lit(20_000)) / 1000.0)).alias("v"),
    ).unionAll(spark.sql("SELECT CAST(1 AS BIGINT), CAST(NULL AS DOUBLE)"))
    groups: dict = {}
    for g, v in rows.where("v IS NOT NULL").collect():
        groups.setdefault(g, []).append(v)
    quantiles = (0.0, 0.01, 0.5, 0.9, 0.99, 1.0)
    found = {r["g"]: r for r in stats.nearest_rank(rows, "v", ["g"], quantiles).collect()}
    assert found.keys() == groups.keys()
    for g, own in groups.items():
        own.sort()
        assert found[g]["requests"] == len(own) and found[g]["min_value"] == own[0] and found[g]["max_value"] == own[-1]
        for q in quantiles:
            assert found[g][f"p{round(q * 100)}"] == own[min(int(len(own) * q), len(own) - 1)]


def test_progress_counts_failures_only_in_the_queue(spark):
    rows = spark.createDataFrame([("pending",), ("running",), ("completed",), ("completed",), ("failed",)], "status string")
    row = stats.queue_progress(stats.state_counts(rows)).first()
    assert (row.queue_percent, row.system_percent) == (60.0, 40.0)


def test_envelope(spark):
    none = spark.range(0)
    assert listing.envelope(none, 1, 20).first().pages == 1
    assert listing.envelope(none, 1, 20, 0).first().pages == 0


def test_search_takes_wildcards_as_they_are(spark):
    rows = spark.createDataFrame([("50% off",), ("500 off",), (None,)], "t string")
    assert values(rows.where(listing.contains_text("50%", "t"))) == [("50% off",)]


def test_incremental(spark):
    known = spark.createDataFrame([("u1", "A", 1)], "url string, title string, place int")
    catalog = spark.createDataFrame([("u1", "A", 1), ("u2", "B", 2), ("u3", "A", 1)], "url string, title string, place int")
    assert values(matching.unknown_items(catalog, known).select("url")) == [("u2",)]


def test_match_score(spark):
    score = lambda a, b, c, d: spark.range(1).select(matching.match_score(*map(F.lit, (a, b, c, d)))).first()[0]
    assert [score("t", "a", "t", "a"), score("t", "a", "xtx", "b"), score("t", "a", "", "")] == [90, 30, 0]


def test_translations_are_looked_up_by_text_and_language(spark):
    long = "x" * 100
    rows = spark.createDataFrame([(1, long, "de"), (2, long, "fr"), (3, long, "es"), (4, "y", "de"), (5, None, None)], "id int, text string, lang string")
    cache = spark.createDataFrame([(long, "de", "D" * 90), (long, "fr", "F" * 90), ("z", "de", "Z")], "source string, target_lang string, translated_text string")
    cache = cache.withColumn("source_hash", F.sha2("source", 256))
    found = matching.translated(rows, "text", cache, F.col("lang")).select("id", "shown", "hit")
    assert values(found, "id") == [(1, "D" * 90, True), (2, "F" * 90, True), (3, long, False), (4, "y", False), (5, None, False)]
    assert values(matching.translated(rows, "text", cache, "fr").select("id", "hit"), "id") == [(1, True), (2, True), (3, True), (4, False), (5, False)]


def test_hot_and_null_keys_find_the_same(spark):
    rows = spark.range(4000).select("id", F.when(F.col("id") % 5 == 0, None).when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k"), F.lit("x").alias("l"))
    table = spark.range(0, 2000).select(F.col("id").alias("k"), F.lit("x").alias("l"), (F.col("id") * 2).alias("known"))
    found = matching.looked_up(rows, table, ["k", "l"], 16)
    assert values(found.select("id", "k", "known"), "id") == values(rows.join(table, ["k", "l"], "left").select("id", "k", "known"), "id")
    assert matching.looked_up(rows.where("id < 0"), table, ["k", "l"]).isEmpty()
    assert matching.looked_up(rows, table.where("k < 0"), ["k", "l"]).where("known IS NULL").count() == 4000


def test_best_matches_are_those_of_all_pairs(spark):
    import random

    rand = random.Random(5)
    titles, authors = ["", None, "ab", "abc", "b", "xabcx", "q" * 20, "q" * 25, "r", "a%b"], ["", None, "Ann", "An", "Bo", "Ann Bo", "Cy"]
    ours = [(k, rand.choice(titles), rand.choice(authors)) for k in range(60)]
    theirs = [(k, rand.choice(titles), rand.choice(authors)) for k in range(90)]

    def agree(a, b, whole, part):
        return 0 if not a or not b else whole if a == b else part if a in b or b in a else 0

    want = []
    for i, t, a in ours:
        scored = sorted((-(agree(t, u, 50, 30) + agree(a, b, 40, 20)), p) for p, u, b in theirs)
        want += [(i, p, -s) for s, p in scored[:3] if -s >= 30]
    wanted = spark.createDataFrame(ours, "id int, title string, author string")
    found = spark.createDataFrame(theirs, "position int, found_title string, found_author string")
    assert values(matching.best_matches(wanted, found, 3).select("id", "position", "score"), "id", "position") == sorted(want)


def test_batch_append(spark):
    old = spark.createDataFrame([("n", 7)], "novel_id string, sort_order int")
    new = spark.createDataFrame([("n", 1, "第1章", "正文"), ("n", 2, "12", ""), ("n", 3, "第2章", None)], "novel_id string, position int, title string, content string")
    assert values(merge.append_chapters(old, new).select("title", "sort_order", "word_count"), "sort_order") == [("第1章", 8, 2), ("第2章", 9, 0)]


def test_fill_missing(spark):
    old = spark.createDataFrame([(1, ""), (2, "x"), (3, None)], "id int, cover string")
    new = spark.createDataFrame([(1, "a"), (2, "b"), (4, "d")], "id int, cover string")
    assert values(merge.fill_missing(old, new, "id", ["cover"]), "id") == [(1, "a"), (2, "x"), (3, None), (4, "d")]


def test_lease(spark):
    now = datetime(2024, 1, 1, 12)
    rows = [(1, None, now), (2, "other", now - timedelta(seconds=60)), (3, "other", now - timedelta(seconds=300)), (4, "other", None)]
    found = merge.lease(spark.createDataFrame([(*r, 120) for r in rows], "id int, owner string, locked_at timestamp, ttl int"), "me", F.lit(now))
    assert values(found.select("id", "taken", "owner"), "id") == [(1, True, "me"), (2, False, "other"), (3, True, "me"), (4, True, "me")]


def test_rate_limit_forgets_refused_calls(spark):
    start = datetime(2024, 1, 1)
    rows = [("c", i, start + timedelta(seconds=t)) for i, t in enumerate((0, 10, 20, 61, 65))]
    found = limits.rate_limit(spark.createDataFrame(rows, "client string, n int, at timestamp"), "client", "at", "n", 2, 60)
    assert [r.allowed for r in found.orderBy("n").collect()] == [True, True, False, True, False]


def test_reuse(spark):
    start = datetime(2024, 1, 1)
    rows = [("a", 1, start), ("b", 2, start), ("a", 3, start + timedelta(seconds=5)), ("a", 4, start + timedelta(seconds=30))]
    found = limits.reuse(spark.createDataFrame(rows, "k string, n int, at timestamp"), "k", "at", "n", 10)
    assert values(found.select("n", "age", "fresh"), "n") == [(1, None, False), (2, None, False), (3, 5.0, True), (4, 25.0, False)]


def test_pages():
    assert pagination.pages_by_size("一二三四。五六七", 5) == ["一二三四。", "五六七"]
    assert pagination.pages_by_size("一二三四五六七八九十", 5) == ["一二三四五", "六七八九十"]
    assert pagination.pages_by_size(None, 5) == [""]
    assert pagination.pages_by_number("abcd\n\n", 1) == ["abcd\n\n"]
    assert "".join(pagination.pages_by_number("一二。三四五。六七", 3)) == "一二。三四五。六七"


def test_html(spark):
    page = """<div id=main><h2 class="module-title type">卷一</h2><a href="/book/1.html">一</a><p>x<p>y <b>z</p>
    <nav><a href="/book/9.html">no</a></nav><a href="/book/1.html">again</a><a href="/book/2.html">二</a></div><script>q</script>"""
    pages = spark.createDataFrame([(1, "https://h/", page), (2, None, None)], "page_id int, url string, html string")
    assert values(html.harvest_links(pages, r"/book/\d+").select("page_id", "href", "title")) == [(1, "https://h/book/1.html", "一"), (1, "https://h/book/2.html", "二")]
    fields = {"title": {"selectors": ["h3", "h2.type"]}, "id": {"selectors": ["a[href*='/book/']"], "attr": "href", "regex": r"(\d+)"}, "none": {"default": "-"}}
    assert values(html.extract(pages, fields), "page_id") == [(1, 0, "卷一", "1", "-"), (2, 0, None, None, "-")]
    rows = html.catalog_rows(pages, "h2", "div > a").select("volume", "title")
    assert values(rows)[0] == ("卷一", "一")
    assert [html.Flat().read("<p>a<p>b").tag, html.Flat().read("<p>a<p>b").start] == [["", "p", "p"], [0, 0, 2]]


def test_links(spark):
    rings = spark.createDataFrame([(1, "r1", 1, None, "{title} - {author}"), (2, "r2", 5, ["home"], "{title}")], "ring_id int, ring_name string, max_links int, on_pages array<string>, link_format string")
    targets = spark.createDataFrame([(1, 1, None, None, 7, True), (2, 1, None, None, 8, True), (3, 2, None, None, 9, True), (0, 1, 5, None, 9, True)], "target_id int, ring_id int, source_site_id int, target_site_id int, target_novel_id int, is_active boolean")
    sites = spark.createDataFrame([], "id int, domain string, name string")
    novels = spark.createDataFrame([(8, "t", "a")], "id int, title string, author string")
    assert values(links.resolve(rings, targets, sites, novels, 3, "novel_detail")) == [("r1", 1, "/novel/7/", "未知书名")]
