"""Progress events of tasks: the latest state of each, in batch and as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EVENT = "task_id bigint, type string, ts timestamp, value double"


def latest_state(events: DataFrame) -> DataFrame:
    """The newest event of each task and how many came; the same plan serves a stream."""
    return events.groupBy("task_id").agg(
        F.count(F.lit(1)).alias("events"),
        F.max(F.struct("ts", "event_id", "type", "value")).alias("last"),
        F.max(F.when(F.col("type") == "error", F.col("ts"))).alias("last_error"),
    ).select("task_id", "events", F.col("last.ts").alias("ts"), F.col("last.type").alias("type"), F.col("last.value").alias("value"), "last_error")


def sessions(events: DataFrame, gap: str = "2 hours") -> DataFrame:
    """Runs of events of a task that no longer silence interrupts: a session ends with its time to live."""
    return events.groupBy("task_id", F.session_window("ts", gap)).agg(F.count(F.lit(1)).alias("events")).select(
        "task_id", F.col("session_window.start").alias("started"), F.col("session_window.end").alias("expires"), "events"
    )


def drained(events: DataFrame, last: str) -> DataFrame:
    """Of each task that has sent ``last``: how many events came from then on, and when its stream is done."""
    here = F.struct("ts", "event_id")
    ends = events.groupBy("task_id").agg(F.min(F.when(F.col("type") == last, here)).alias("finish")).where(F.col("finish").isNotNull())
    rest = events.join(ends, "task_id").where(here >= F.col("finish"))
    return rest.groupBy("task_id").agg(F.count(F.lit(1)).alias("drained"), F.max("ts").alias("done_at"))


def stream(spark, path: str, schema, per_trigger: int = 1) -> DataFrame:
    """Event files as a stream; the source is read no faster than ``per_trigger`` files a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


#: The fields that each type of event has of its own, and their types.
EVENT_FIELDS = {
    "start": {"novel_title": "string"},
    "status": {"status": "string", "message": "string", "total_chapters": "bigint"},
    "progress": {"total": "bigint", "message": "string"},
    "chapter": {"index": "bigint", "total": "bigint", "title": "string", "speed": "double", "eta": "bigint"},
    "error": {"message": "string"},
    "heartbeat": {}, "done": {"message": "string"},
}


def typed(messages: DataFrame, column: str, fields: dict[str, dict[str, str]] = EVENT_FIELDS) -> DataFrame:
    """Events of JSON as rows of their type: a struct column for each type that has fields, set for its own events alone.

    A message is parsed once, to a variant. ``type`` is null for what is no JSON, has no type or one that is not known; such
    messages are kept in ``malformed``. A field that is absent or of another kind is null.
    """
    parsed = messages.withColumn("__v", F.try_parse_json(column))
    kind = F.try_variant_get("__v", "$.type", "string")
    known = F.when(kind.isin(*fields), kind)
    parsed = parsed.withColumn("type", known).withColumn("sent_at", F.try_variant_get("__v", "$.t", "string"))
    own = [F.when(F.col("type") == t, F.struct(*[F.try_variant_get("__v", f"$.{f}", k).alias(f) for f, k in of.items()])).alias(f"as_{t}") for t, of in fields.items() if of]
    return parsed.select(*messages.columns, "type", "sent_at", *own, F.when(F.col("type").isNull(), F.col(column)).alias("malformed"))
