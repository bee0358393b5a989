"""Edges of operators that the tables do not have."""

import time

from pyspark.sql import functions as F

from storyloom.functions import numbers, text
from storyloom.operators import harvest, listing, merge, nested, repairs, windows
from storyloom.streaming import progress

from test_operators import values


def test_a_long_novel_takes_seconds(spark):
    """200,000 chapters of one novel, each with its neighbours."""
    rows = spark.range(200_000).select(F.lit(1).alias("novel_id"), F.floor(F.col("id") / 2).alias("sort_order"), F.col("id").cast("string").alias("id"))
    began = time.perf_counter()
    found = windows.with_neighbours(rows)
    assert found.where("prev_id IS NULL").count() == 2 and found.where("next_id IS NULL").count() == 2
    assert values(found.where("sort_order = 500").select("id", "prev_id", "next_id"), "id") == [("1000", "999", "1002"), ("1001", "999", "1002")]
    assert time.perf_counter() - began < 60


def test_addresses_of_clients(spark):
    rows = [("127.0.0.1", " 1.2.3.4 , 5.6.7.8"), ("::1", ""), ("9.9.9.9", "1.2.3.4"), (None, "1.2.3.4"), ("127.0.0.1", None)]
    frame = spark.createDataFrame(rows, "peer string, xff string")
    assert [r[0] for r in frame.select(text.client_address(F.col("peer"), F.col("xff"))).collect()] == ["1.2.3.4", "::1", "9.9.9.9", "unknown", "127.0.0.1"]
    hosts = spark.createDataFrame([("H.com:81",), ("h.com",), ("[::1]:90",), ("[::1]",)], "h string")
    assert values(hosts.select(*text.host_and_port(F.col("h")))) == [("h.com", 81), ("h.com", 80), ("[::1]", 90), ("[::1]", 80)]


def test_labels_and_waits(spark):
    frame = spark.createDataFrame([(0.4,), (119.4,), (120.0,), (1234.0,)], "m double")
    assert [r[0] for r in frame.select(numbers.eta_label(F.col("m"))).collect()] == ["0min", "119min", "2.0h", "20.6h"]
    assert spark.range(1).select(numbers.backoff(F.lit(3), F.lit(0.5)), numbers.throttle_wait(F.lit(1.0), F.lit(0.5), 2.0, 4.0), numbers.throttle_wait(F.lit(2.0), F.lit(0.5), 2.0, 4.0), numbers.coverage(F.lit(1), F.lit(0))).first() == (8.75, 2.0, 0.0, 0.0)


def test_watchdog_tells_why(spark):
    rows = [(1, True, 0, 5, 0, 1), (2, True, 0, 5, 0, 1), (3, True, 0, 4, 0, 1), (4, True, 1, 4, 1, 1), (5, False, 1, 0, 0, 1), (6, True, 0, 0, 0, 1)]
    found = windows.watchdog(spark.createDataFrame(rows, "t int, alive boolean, stuck int, pending int, running int, completed int"), "t")
    assert values(found.select("progressed", "restart", "reason"), "t") == [(False, True, "idle"), (False, True, "idle"), (True, False, None), (False, True, "stuck"), (True, True, "dead"), (False, False, None)]


def test_events_of_all_kinds(spark):
    said = ['{"type":"chapter","index":"x","total":7}', '{"type":"done"}', '{"type":"other"}', "{", "", None, "[1]", '{"type":"status","status":"failed","more":{"a":1}}']
    found = progress.typed(spark.createDataFrame([(k, s) for k, s in enumerate(said)], "k int, m string"), "m").orderBy("k").collect()
    assert [r.type for r in found] == ["chapter", "done", None, None, None, None, None, "status"]
    assert (found[0].as_chapter["index"], found[0].as_chapter.total, found[0].as_status, found[7].as_status.status) == (None, 7, None, "failed")
    assert [r.malformed for r in found] == [None, None, '{"type":"other"}', "{", "", None, "[1]", None]


def test_repairs_keep_what_is_good(spark):
    rows = spark.createDataFrame([(1, "Book-1", None, None), (1, "kept", "c", "short"), (2, " ", "", None), (None, None, None, None)], "id int, title string, cover string, content string")
    first = spark.createDataFrame([(1, "Book-9", "p", "x" * 51), (1, "T", "", "y" * 60), (9, "unknown", "z", None)], "id int, title string, cover string, content string")
    second = spark.createDataFrame([(1, "late"), (2, "two"), (None, "null")], "id int, title string")
    found = repairs.merged(rows, "id", [("first", first), ("second", second)])
    told = sorted(map(repr, (tuple(r) for r in found.collect())))
    assert told == sorted(map(repr, [
        (1, "T", "first", "p", "first", "x" * 51, "first"), (1, "kept", None, "c", None, "short", None), (2, "two", "second", "", None, None, None), (None, "null", "second", None, None, None, None),
    ]))


def test_counts_of_a_write(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "running"), (3, "a"), (4, None)], "id int, status string")
    left, told = merge.delete_counted(rows, spark.createDataFrame([(1,), (1,), (2,), (4,), (9,)], "id int"), "id", F.col("status") == "running")
    left.write.parquet(str(tmp_path / "left"))
    assert values(spark.read.parquet(str(tmp_path / "left")).select("id"), "id") == [(2,), (3,)] and told.get == {"deleted": 2, "skipped": 1}
    found = spark.createDataFrame([("u1", "x"), ("u2", "b"), ("u2", "a"), (None, "n")], "url string, title string")
    made, told = merge.insert_and_enqueue(found.limit(1), found, "url")
    made.write.parquet(str(tmp_path / "made"))
    assert told.get == {"inserted": 2, "enqueued": 4}
    assert sorted(map(repr, map(tuple, spark.read.parquet(str(tmp_path / "made")).where("kind = 'row'").collect()))) == ["('row', 'u2', 'a')", "('row', None, 'n')"]


def test_strings_are_put_back_in_their_places(spark):
    pages = spark.createDataFrame([(1, "书", ["类", None, "书", "x"]), (2, None, []), (3, "12", None)], "id int, title string, tags array<string>")
    cache = spark.createDataFrame([("书", "en", "book"), ("类", "de", "Art")], "t string, target_lang string, translated_text string").withColumn("source_hash", F.sha2("t", 256))
    def of(say):
        return {"title": say(F.col("title")), "tags": F.transform("tags", say)}

    shown = nested.translated_pages(pages, "id", [F.col("title"), F.coalesce("tags", F.array().cast("array<string>"))], of, cache, "en")
    assert values(shown, "id") == [(1, "book", ["类", None, "book", "x"]), (2, None, []), (3, "12", None)]
    assert nested.translated_pages(pages, "id", [F.col("title")], of, cache, "zh-TW") is pages


def test_volumes_in_novels(spark):
    rows = spark.createDataFrame([(1, 1, "a", ""), (1, 2, "b", "V"), (1, 3, "c", None), (2, 1, "d", "V")], "novel_id int, sort_order int, id string, volume string")
    found = {r.novel_id: ([(v.volume, [x.id for x in v.chapters]) for v in r.volumes], r.total) for r in nested.in_volumes(rows).collect()}
    assert found == {1: ([("正文", ["a"]), ("V", ["b", "c"])], 3), 2: ([], 1)}


def test_shifted_pages_and_recommendations(spark):
    rows = spark.range(100).select("id")
    one = spark.createDataFrame([(7,)], "shift int")
    assert [r.id for r in listing.shifted_page(rows, [F.asc("id")], 2, 5, one, "shift").collect()] == [12, 13, 14, 15, 16]
    novels = spark.createDataFrame([(k, f"t{k}", "c" if k < 4 else "") for k in range(6)], "id int, title string, cover string")
    chapters = spark.createDataFrame([(1, 1, "x"), (1, 2, "y")], "novel_id int, sort_order int, id string")
    found = listing.recommended(novels, chapters, 2).collect()
    assert len(found) == 12 and all(r.id != r.reader_of and r.id < 4 for r in found) and {r.chapter for r in found} <= {"y", "-"}


def test_kinds_of_links(spark):
    urls = spark.createDataFrame([("/book/1/",), ("/book/1/2.html",), ("/x",), (None,)], "u string")
    assert [r[0] for r in urls.select(harvest.kind_of(F.col("u"))).collect()] == ["novel", "chapter", None, None]


def test_ranks_fail_aloud(spark, monkeypatch):
    """A sketch that is much too coarse for its margin is noticed."""
    import pytest

    from storyloom.operators import stats

    rows = spark.range(50_000).select((F.col("id") * 7919 % 50_021).alias("v"))
    assert stats.nearest_rank(rows, "v").first().p50 == sorted(k * 7919 % 50_021 for k in range(50_000))[25_000]
    monkeypatch.setattr(stats, "SLACK", 0)
    monkeypatch.setattr(stats, "ACCURACY", 7)
    with pytest.raises(Exception, match="off by more"):
        stats.nearest_rank(rows, "v").collect()
