import gzip
import json

import pytest
from pyspark.sql import functions as F

from storyloom.sources import files, plugins
from storyloom.streaming import limits, progress


def values(frame, *order):
    return [tuple(r) for r in (frame.orderBy(*order) if order else frame).collect()]


def test_blobs_come_before_the_column(spark, tmp_path):
    (tmp_path / "n1").mkdir()
    for name, text in (("c1", "from the file\nsecond"), ("c2", "")):
        with gzip.open(tmp_path / "n1" / f"{name}.txt.gz", "wt") as f:
            f.write(text)
    blobs = files.read_blobs(spark, str(tmp_path))
    chapters = spark.createDataFrame([("c1", "old"), ("c2", "kept"), ("c3", None)], "id string, content string")
    assert values(files.resolve_content(chapters, blobs), "id") == [("c1", "from the file\nsecond"), ("c2", "kept"), ("c3", "")]
    assert files.count_files(spark, str(tmp_path)).first().files == 2


def test_blobs_round_trip(spark, tmp_path):
    texts = [("n1", "c1", "x\ny\n"), ("n1", "c2", ""), ("n2", "c3", None), ("n2", "c4", "日本\r\nlast")]
    rows = spark.createDataFrame(texts, "novel_id string, id string, content string")
    assert values(files.write_blobs(rows, str(tmp_path)).select("chapter_id"), "chapter_id") == [("c1",), ("c4",)]
    files.write_blobs(rows, str(tmp_path)).count()  # again, as a task that is run twice
    blobs = files.read_blobs(spark, str(tmp_path))
    assert values(blobs, "chapter_id") == [("n1", "c1", "x\ny\n"), ("n2", "c4", "日本\r\nlast")]
    assert values(files.blobs_exist(rows, blobs).select("id", "has_file"), "id") == [("c1", True), ("c2", False), ("c3", False), ("c4", True)]
    assert files.delete_blobs(spark, str(tmp_path), rows.where("novel_id = 'n1'")) == 1
    assert values(files.read_blobs(spark, str(tmp_path)).select("chapter_id")) == [("c4",)]


def test_rules_are_written_whole(spark, tmp_path):
    for name in ("Old", "新"):
        files.save_rule(spark, str(tmp_path), "mine", {"name": name})
        assert files.load_rule(spark, str(tmp_path), "mine", "name string").first().name == name
    assert files.delete_rule(spark, str(tmp_path), "mine") and not files.delete_rule(spark, str(tmp_path), "mine")
    with pytest.raises(ValueError, match="not the name"):
        files.save_rule(spark, str(tmp_path), "a/b", {})


def test_rules(spark, tmp_path):
    (tmp_path / "good.json").write_text(json.dumps({"name": "Good", "base_url": "https://x"}))
    (tmp_path / "bad.json").write_text("{")
    (tmp_path / "no name.json").write_text("{}")
    found = files.list_rules(spark, str(tmp_path)).select("source", "name", F.col("_corrupt_record").isNotNull())
    assert values(found) == [("bad", None, True), ("good", "Good", False)]
    assert files.load_rule(spark, str(tmp_path), "good", "name string").first().name == "Good"
    with pytest.raises(ValueError, match="not the name"):
        files.load_rule(spark, str(tmp_path), "../good", "name string")


def test_dictionary_falls_back_twice(spark, tmp_path):
    (tmp_path / "en.json").write_text('{"a": "A"}')
    (tmp_path / "zh.json").write_text('{\n  "a": "甲",\n  "b": "乙"\n}\n')
    both = files.dictionary(spark, str(tmp_path / "en.json"), "en").unionAll(files.dictionary(spark, str(tmp_path / "zh.json"), "zh"))
    keys = spark.createDataFrame([("a",), ("b",), ("c",)], "key string")
    assert values(files.translations(both, "en", keys), "key") == [("a", "A"), ("b", "乙"), ("c", "c")]


def test_log_tail(spark, tmp_path):
    (tmp_path / "log").write_text("".join(f" line {k} {'fixed' if k % 7 == 0 else ''}\n" for k in range(100)))
    log = files.read_log(spark, str(tmp_path / "log"))
    assert [r.value for r in files.tail(log, "line", 2).collect()] == ["line 98 fixed", "line 99"]
    assert [r.value for r in files.tail(log, "line", 3, "fixed", 20).collect()] == ["line 84 fixed", "line 91 fixed", "line 98 fixed"]


def test_plug_in_source(spark):
    plugins.register(spark)
    found = spark.read.format("chapters").option("source", "example").option("novels", "5,6").load()
    assert found.count() == 6 and found.where("novel = '6' AND place = 3").first().url == "https://example.com/6/3.html"


def test_streams_agree_with_their_batches(spark, tmp_path):
    rows = [(k, k % 3, ("start", "progress", "error")[k % 3 - 1], k, float(k)) for k in range(60)]
    events = spark.createDataFrame(rows, "event_id bigint, task_id bigint, type string, s int, value double").withColumn("ts", F.timestamp_seconds(F.col("s") + 86_400)).drop("s")  # a watermark begins at the epoch
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    batch = spark.read.parquet(str(tmp_path / "in"))

    stream = progress.stream(spark, str(tmp_path / "in"), events.schema)
    query = progress.latest_state(stream).writeStream.outputMode("complete").format("memory").queryName("latest").option("checkpointLocation", str(tmp_path / "c1")).start()
    query.processAllAvailable()
    query.stop()
    assert values(spark.table("latest"), "task_id") == values(progress.latest_state(batch), "task_id")

    one = progress.stream(spark, str(tmp_path / "in"), events.schema, 10)
    limited = limits.rate_limit_stream(one, "task_id", "ts", 2, 10)
    query = limited.writeStream.outputMode("append").format("memory").queryName("limited").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    wanted = limits.rate_limit(batch, "task_id", "ts", "event_id", 2, 10).select("task_id", "ts", "allowed")
    assert values(spark.table("limited").select("task_id", "ts", "allowed"), "task_id", "ts") == values(wanted, "task_id", "ts")
