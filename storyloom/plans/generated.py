"""Rows that come from no table (SRC10-15)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..registry import query
from ..sources import catalog, files


@query("SELECT i AS book_id, 'Book-' || i AS title, 'https://example.com/book/' || i || '/' AS source_url FROM range(100, 301) r(i)")
def book_range(spark: SparkSession, d: str) -> DataFrame:
    return files.book_range(spark, 100, 300, "https://example.com/")


@query()
def synthetic_sites(spark: SparkSession, d: str) -> DataFrame:
    return files.synthetic_sites(spark, 1000)


@query()
def synthetic_requests(spark: SparkSession, d: str) -> DataFrame:
    return files.synthetic_requests(spark, 10_000, 1000)


@query("""
SELECT event_id AS line, event_type AS value FROM (SELECT * FROM events ORDER BY event_id DESC LIMIT 20) WHERE event_type = 'error'
ORDER BY event_id DESC LIMIT 3""")
def log_tail_filtered(spark: SparkSession, d: str) -> DataFrame:
    """Of the last twenty lines, the last three with a word."""
    lines = catalog.table(spark, d, "events").select(F.col("event_id").alias("line"), F.col("event_type").alias("value"))
    return files.tail(lines, "line", 3, "error", 20)
