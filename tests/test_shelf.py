"""Rows and blobs in one write: both or neither, whatever becomes of its tasks."""

import os

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from storyloom.sources import files, shelf

SCHEMA = "novel_id string, id string, title string, sort_order int, word_count int, content string"


def chapters(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


FIRST = [("n1", "c1", "One", 1, 2, "a\nb"), ("n1", "c2", "Two", 2, 0, ""), ("n2", "c 3%", None, 1, 3, "日本 x"), ("n2", "c4", "Four", 2, None, None)]


def seen(spark, root):
    return sorted((r.novel_id, r.id, r.title, r.sort_order, r.word_count, r.content) for r in shelf.contents(spark, root).collect())


def blobs(root):
    return sorted(f for _, _, names in os.walk(root) for f in names if f.endswith(".txt.gz"))


@pytest.mark.parametrize("prefix", ["", "file:", "file://"])
def test_round_trip(spark, tmp_path, prefix):
    root = f"{prefix}{tmp_path}/s"
    shelf.put(chapters(spark, FIRST).repartition(3), root)
    shelf.put(chapters(spark, [("n3", "c5", "Five", 1, 1, "more")]), root)
    wanted = [(*r[:5], r[5] or None) for r in FIRST] + [("n3", "c5", "Five", 1, 1, "more")]
    assert seen(spark, root) == sorted(wanted, key=lambda r: r[:2])
    assert shelf.rows(spark, root).where("content_file IS NULL").count() == 2 and len(blobs(f"{tmp_path}/s")) == 3
    assert not os.path.exists(f"{tmp_path}/s/_staging") or not os.listdir(f"{tmp_path}/s/_staging")


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    root = str(tmp_path / "s")
    shelf.put(chapters(spark, FIRST[:1]), root)
    broken = chapters(spark, FIRST).repartition(4).withColumn("content", F.when(F.col("id") == "c4", F.raise_error(F.lit("lost"))).otherwise(F.col("content")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        shelf.put(broken, root)
    # a task that outlives the abort may still write under _staging, where nobody looks
    assert [r[1] for r in seen(spark, root)] == ["c1"] and blobs(f"{root}/blobs") == ["c1.txt.gz"]


def test_an_attempt_that_was_killed_is_not_seen(spark, tmp_path):
    """One attempt of a task dies half way, the next ends well: only the latter's files are moved."""
    spark.range(1).count()
    writer = shelf.ShelfWriter(files.resolved(spark, str(tmp_path / "s")), False)
    rows = [Row(novel_id="n", id=f"c{k}", title="t", sort_order=k, word_count=1, content_file=None, content=f"text {k}") for k in range(5)]

    def dies():
        yield from rows[:3]
        raise OSError("executor lost")

    with pytest.raises(OSError, match="lost"):
        writer.write(dies())
    assert len(blobs(tmp_path)) == 3 and not (tmp_path / "s" / "rows").exists()
    message = writer.write(iter(rows))
    writer.commit([message, None])
    assert (message.rows, message.blobs) == (5, 5)
    assert [r[5] for r in seen(spark, str(tmp_path / "s"))] == [f"text {k}" for k in range(5)] and len(blobs(tmp_path)) == 5
    writer.abort([message])
    assert len(blobs(tmp_path)) == 5


def test_novels_go_with_their_texts(spark, tmp_path):
    root = str(tmp_path / "s")
    shelf.put(chapters(spark, FIRST), root)
    gone = spark.createDataFrame([("n1",), ("n1",), ("n9",)], "novel_id string")
    assert shelf.remove_novels(spark, root, gone) == 1
    assert [r[:2] for r in seen(spark, root)] == [("n2", "c 3%"), ("n2", "c4")] and blobs(root) == ["c 3%.txt.gz"]
    assert seen(spark, root)[0][5] == "日本 x"
    assert shelf.remove_novels(spark, root, gone) == 0


def test_texts_are_read_by_their_rows_and_no_folder_is_listed(spark, tmp_path):
    """Texts of rows come from the files that they name; a scan would list every folder of the shelf on the driver."""
    root = str(tmp_path / "s")
    shelf.put(chapters(spark, FIRST), root)
    os.makedirs(f"{root}/blobs/other/a/n9")
    with open(f"{root}/blobs/other/a/n9/c9.txt.gz", "wb") as stray:
        stray.write(b"no gzip")
    found = shelf.contents(spark, root)
    assert not any(".txt.gz" in f for f in found.inputFiles()) and found.rdd.getNumPartitions() == 16
    wanted = {r[1]: r[5] or None for r in FIRST}
    assert {r.id: r.content for r in found.collect()} == wanted
    gone = [os.path.join(d, f) for d, _, names in os.walk(f"{root}/blobs") for f in names if f == "c1.txt.gz"]
    os.unlink(gone[0])
    assert {r.id: r.content for r in shelf.contents(spark, root).collect()} == wanted | {"c1": None}


def test_long_texts_leave_a_task_in_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(shelf, "READ", 10)
    root = str(tmp_path / "s")
    rows = [("n", f"c{k}", "t", k, 1, f"text {k} " * (k % 3)) for k in range(40)]
    shelf.put(chapters(spark, rows), root)
    assert {r[1]: r[5] for r in seen(spark, root)} == {r[1]: r[5] or None for r in rows}
