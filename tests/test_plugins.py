"""Plug-ins as a data source: filters open no other partition, chapters arrive by offset, three tables."""

import json

import pytest

from storyloom.sources import files, plugins


def values(frame, *order):
    return [tuple(r) for r in (frame.orderBy(*order) if order else frame).collect()]


def store(folder, novel, *titles):
    (folder / f"{novel}.json").write_text(json.dumps({"title": f"Novel {novel}", "author": "A", "chapters": [{"title": t, "url": f"u/{t}"} for t in titles]}))


@pytest.fixture
def dump(spark, tmp_path):
    plugins.register(spark)
    store(tmp_path, "n1", "a", "b")
    store(tmp_path, "n2", "c")
    return spark.read.format("crawl").option("source", "dump").option("root", files.resolved(spark, str(tmp_path))), tmp_path


def test_tables(spark, dump):
    read, _ = dump
    assert values(read.load(), "novel", "place") == [("n1", 1, "a", "u/a"), ("n1", 2, "b", "u/b"), ("n2", 1, "c", "u/c")]
    assert values(read.option("table", "novel_info").load(), "novel") == [("n1", "Novel n1", "A"), ("n2", "Novel n2", "A")]
    read.option("table", "search")
    assert values(read.load().where("words = 'n2'")) == [("n2", 0, "Novel n2", "A")] and read.load().count() == 0
    with pytest.raises(Exception, match="no table"):
        read.option("table", "none").load()


def test_filters_open_no_other_partition(spark, dump):
    read, folder = dump
    (folder / "broken.json").write_text("{")
    chapters = read.option("table", "chapters").load()
    assert values(chapters.where("novel = 'n1' AND place > 1")) == [("n1", 2, "b", "u/b")]
    assert values(chapters.where("novel IN ('n2', 'n1')").select("title"), "title") == [("a",), ("b",), ("c",)]
    assert chapters.where("novel = 'n1' AND novel = 'n2'").count() == 0
    assert chapters.where("novel = 'n1'").rdd.getNumPartitions() == 1
    with pytest.raises(Exception, match="Expecting"):
        read.load().count()


def test_new_chapters_arrive_by_offset(spark, dump, tmp_path_factory):
    _, folder = dump
    source = spark.readStream.format("crawl").option("source", "dump").option("root", files.resolved(spark, str(folder))).load()
    log = str(tmp_path_factory.mktemp("log"))
    told = []
    for _ in range(3):
        query = source.writeStream.foreachBatch(lambda df, k: told.extend(values(df.select("novel", "title"), "novel", "title"))).option("checkpointLocation", log).start()
        query.processAllAvailable()
        query.stop()
        if len(told) == 3:
            store(folder, "n2", "c", "d", "e")
            store(folder, "n3", "f")
    assert told == [("n1", "a"), ("n1", "b"), ("n2", "c"), ("n2", "d"), ("n2", "e"), ("n3", "f")]
