"""Pages of texts as rows: the same as the pages of a column, given away few at a time."""

import pyarrow as pa
from pyspark.sql import functions as F

from storyloom.operators import pagination


def test_same_as_column(spark):
    texts = ["", None, "ab。" * 5000, "a" * 10_000, ("word " * 300 + "\n\n") * 40]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    column = rows.withColumn("pages", pagination.paginate("text", "word_count", 3000)).select("doc_id", F.posexplode("pages").alias("page", "content"))
    assert sorted(pagination.page_rows(rows, "text", "word_count", 3000, ["doc_id"]).collect()) == sorted(column.collect())


def test_few_at_a_time(spark, monkeypatch):
    """However many texts a batch has, no batch that is given away holds many more characters than the bound."""
    taken = {}
    monkeypatch.setattr(type(spark.range(1)), "mapInArrow", lambda self, run, schema: taken.update(run=run))
    pagination.page_rows(spark.createDataFrame([(1, "x")], "doc_id long, text string"), "text", "word_count", 3000, ["doc_id"])
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(400)), "text": ["x" * 20_000] * 400})
    given = list(taken["run"](iter([batch])))
    assert sum(len(t) for b in given for t in b.column("content").to_pylist()) == 400 * 20_000
    assert max(sum(len(t) for t in b.column("content").to_pylist()) for b in given) < pagination.CHARS + 3000
