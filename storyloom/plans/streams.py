"""Progress, rate limits and the reuse of keys (STM01-06, STM09, WIN10)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..registry import query
from ..sources import catalog as c
from ..streaming import limits, ordered, progress, sessions


def events(spark: SparkSession, d: str) -> DataFrame:
    return c.table(spark, d, "events").select("event_id", F.col("user_id").alias("task_id"), F.col("event_type").alias("type"), "ts", "value")


@query("""
SELECT user_id AS task_id, count(*) AS events, max(ts) AS ts, arg_max(event_type, (ts, event_id)) AS type, arg_max(value, (ts, event_id)) AS value,
       max(ts) FILTER (event_type = 'error') AS last_error FROM events GROUP BY 1""")
def progress_latest_state(spark: SparkSession, d: str) -> DataFrame:
    return progress.latest_state(events(spark, d))


@query("""
WITH marked AS (
  SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 2 HOUR THEN 0 ELSE 1 END AS starts FROM events),
numbered AS (SELECT *, sum(starts) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM marked)
SELECT user_id AS task_id, min(ts) AS started, max(ts) + INTERVAL 2 HOUR AS expires, count(*) AS events FROM numbered GROUP BY user_id, session""")
def task_sessions(spark: SparkSession, d: str) -> DataFrame:
    return progress.sessions(events(spark, d))


@query()
def rate_limit_replay(spark: SparkSession, d: str) -> DataFrame:
    """At most five calls in six hours."""
    return limits.rate_limit(events(spark, d), "task_id", "ts", "event_id", 5, 21_600)


@query("""
SELECT event_id, task_id, round(age, 6) AS age, coalesce(age < 36000, false) AS fresh FROM (
  SELECT event_id, user_id AS task_id, epoch(ts) - epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS age FROM events)""")
def cache_replay(spark: SparkSession, d: str) -> DataFrame:
    """Which accesses find their key asked for less than ten hours before."""
    return limits.reuse(events(spark, d), "task_id", "ts", "event_id", 36_000).select("event_id", "task_id", F.round("age", 6).alias("age"), "fresh")


#: Seconds that a session of these events lasts at most, and of silence before a heartbeat.
TTL, BEAT = 86_400, 7_200
_KINDS = {"signup": "start", "click": "progress", "view": "chapter", "purchase": "status", "error": "error"}

#: Events before the last one's millisecond: what a stream of them all has passed by its watermark.
_PASSED = """n AS (
  SELECT user_id AS task_id, ts, event_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn
  FROM events WHERE ts < (SELECT date_trunc('milliseconds', max(ts)) FROM events))"""

_SESSIONS_SQL = f"""
WITH RECURSIVE {_PASSED},
span AS (
  SELECT a.task_id, a.rn, a.ts AS started, min(b.rn) FILTER (b.event_type = 'purchase' AND b.ts <= a.ts + INTERVAL {TTL} SECOND) AS fin,
         min(b.rn) FILTER (b.ts > a.ts + INTERVAL {TTL} SECOND) AS over
  FROM n a JOIN n b ON a.task_id = b.task_id AND b.rn >= a.rn GROUP BY ALL),
starts AS (
  SELECT task_id, rn FROM n WHERE rn = 1 UNION ALL
  SELECT task_id, coalesce(fin + 1, over) FROM starts JOIN span USING (task_id, rn) WHERE coalesce(fin + 1, over) IS NOT NULL),
sessions AS (
  SELECT s.task_id, s.rn, s.started, s.fin, coalesce(s.fin + 1, s.over, c.n + 1) AS next, s.started + INTERVAL {TTL} SECOND AS latest
  FROM starts JOIN span s USING (task_id, rn) JOIN (SELECT task_id, count(*) AS n FROM n GROUP BY 1) c USING (task_id)),
cut AS (SELECT date_trunc('milliseconds', max(ts)) AS at FROM events),
closed AS (
  SELECT s.task_id, 'closed' AS kind, coalesce(f.ts, s.latest) AS at, s.started, s.next - s.rn AS events, s.fin IS NOT NULL AS finished
  FROM sessions s LEFT JOIN n f ON f.task_id = s.task_id AND f.rn = s.fin, cut WHERE s.fin IS NOT NULL OR s.latest < cut.at),
silences AS (
  SELECT s.task_id, s.started, e.ts, e.rn - s.rn + 1 AS events, CASE WHEN e.rn + 1 < s.next THEN x.ts END AS until, s.latest
  FROM sessions s JOIN n e ON e.task_id = s.task_id AND e.rn >= s.rn AND e.rn < s.next LEFT JOIN n x ON x.task_id = s.task_id AND x.rn = e.rn + 1
  WHERE s.fin IS NULL OR e.rn < s.fin),
beats AS (
  SELECT task_id, 'heartbeat' AS kind, ts + to_seconds(CAST(k * {BEAT} AS BIGINT)) AS at, started, events, false AS finished, until, latest FROM silences, range(1, {TTL // BEAT + 1}) r(k))
SELECT * FROM closed UNION ALL
SELECT task_id, kind, beats.at, started, events, finished FROM beats, cut WHERE (until IS NULL OR beats.at < until) AND beats.at <= latest AND beats.at < cut.at"""


def _event_stream(spark: SparkSession, d: str) -> DataFrame:
    return c.stream_of(spark, d, "events").select("event_id", F.col("user_id").alias("task_id"), F.col("event_type").alias("type"), "ts", "value")


def _passed(rows: DataFrame, time: str) -> DataFrame:
    """Rows before the last one's millisecond, and that moment: what a stream of them all has passed by its watermark."""
    last = rows.agg(F.floor(F.unix_micros(F.max(F.col(time).cast("timestamp"))) / 1000).alias("__ms"))
    cut = c.beside(rows, last.select((F.col("__ms") * 1000).cast("long").alias("__cut")))
    return cut.where(F.unix_micros(F.col(time).cast("timestamp")) < F.col("__cut"))


@query(_SESSIONS_SQL)
def sessions_closed(spark: SparkSession, d: str) -> DataFrame:
    """Sessions that a finishing event or their time closes, and heartbeats of their silences, from the table."""
    return ordered.batch(_passed(events(spark, d), "ts"), sessions.Sessions(("purchase",), TTL, BEAT), "task_id", "ts", "event_id", ["type"], "__cut")


@query(_SESSIONS_SQL)
def sessions_closed_stream(spark: SparkSession, d: str) -> DataFrame:
    """The same from a stream of the table, by state and event-time timers."""
    made = ordered.stream(_event_stream(spark, d), sessions.Sessions(("purchase",), TTL, BEAT), "task_id", "ts", "event_id", ["type"], "0 seconds")
    return ordered.settled(made, "sessions")


def _told(rows: DataFrame) -> DataFrame:
    """Events as a crawl tells of them: its start, its size, chapters with figures, errors and its end."""
    k = F.col("event_id") % 97
    return rows.select(
        "event_id", "task_id", "ts", c.relabel("type", _KINDS).alias("kind"), F.concat(F.col("type"), F.lit(" "), F.col("event_id").cast("string")).alias("message"),
        k.alias("index"), F.when(F.col("event_id") % 3 > 0, k + 50).alias("total_said"), F.round("value", 3).alias("speed_said"), F.when(k % 4 > 0, k * 2).alias("eta_said"),
        F.when(F.col("event_id") % 2 == 0, "completed").otherwise("failed").alias("status_said"),
    )


_VIEW = ["kind", "message", "index", "total_said", "speed_said", "eta_said", "status_said"]
_PROGRESS_SQL = f"""
WITH {_PASSED},
told AS (
  SELECT *, event_id % 97 AS k, CASE event_type WHEN 'signup' THEN 'start' WHEN 'click' THEN 'progress' WHEN 'view' THEN 'chapter' WHEN 'purchase' THEN 'status' ELSE 'error' END AS kind,
         event_type || ' ' || event_id AS message, CASE WHEN event_id % 3 > 0 THEN event_id % 97 + 50 END AS total FROM n),
lines AS (
  SELECT task_id, rn, 1 AS part, message FROM told UNION ALL
  SELECT task_id, rn, 2, 'done: ' || message FROM told WHERE kind = 'status' AND event_id % 2 = 0),
kept AS (SELECT * FROM lines QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY rn DESC, part DESC) <= 20),
logs AS (SELECT task_id, md5(string_agg(message, chr(10) ORDER BY rn, part)) AS log, count(*) AS lines FROM kept GROUP BY task_id)
SELECT task_id, coalesce(arg_max(k, rn) FILTER (kind = 'chapter'), 0) AS current,
       coalesce(arg_max(CASE WHEN kind = 'progress' THEN coalesce(total, 0) ELSE total END, rn) FILTER (kind = 'progress' OR (kind = 'chapter' AND total > 0)), 0) AS total,
       coalesce(arg_max(round(value, 3), rn) FILTER (kind = 'chapter'), 0) AS speed,
       coalesce(arg_max(CASE WHEN k % 4 > 0 AND k > 0 THEN (k * 2) || 's' ELSE '--' END, rn) FILTER (kind = 'chapter'), '--') AS eta,
       coalesce(arg_max(CASE kind WHEN 'start' THEN 'running' WHEN 'error' THEN 'failed' ELSE CASE WHEN event_id % 2 = 0 THEN 'completed' ELSE 'failed' END END, rn) FILTER (kind IN ('start', 'status', 'error')), 'connecting') AS status,
       any_value(log) AS log, CAST(any_value(lines) AS INTEGER) AS lines
FROM told JOIN logs USING (task_id) GROUP BY task_id"""


def _last_views(views: DataFrame, times: DataFrame) -> DataFrame:
    """The view after a task's last event."""
    last = times.groupBy("task_id").agg(F.max(F.struct("ts", "event_id"))["event_id"].alias("event_id"))
    rows = views.join(last, ["task_id", "event_id"], "left_semi")
    return rows.select("task_id", "current", "total", "speed", "eta", "status", F.md5(F.array_join("log", "\n")).alias("log"), F.size("log").alias("lines"))


@query(_PROGRESS_SQL)
def progress_views(spark: SparkSession, d: str) -> DataFrame:
    """What a viewer of each task sees at last, with a log of twenty lines."""
    rows = _passed(events(spark, d), "ts")
    return _last_views(ordered.batch(_told(rows), sessions.LastViews(20), "task_id", "ts", "event_id", _VIEW), rows)


@query(_PROGRESS_SQL)
def progress_views_stream(spark: SparkSession, d: str) -> DataFrame:
    """The same from a stream of the table, the log being a ring in state: a task's view is told once for all events that the watermark passes together."""
    made = ordered.stream(_told(_event_stream(spark, d)), sessions.LastViews(20), "task_id", "ts", "event_id", _VIEW, "0 seconds")
    return _last_views(ordered.settled(made, "views"), _passed(events(spark, d), "ts"))


def _snapshots(rows: DataFrame) -> DataFrame:
    """Each event as a snapshot of its task's counters."""
    k = F.col("event_id")
    return rows.select("event_id", "task_id", "ts", (k % 40).alias("pending"), (k * 7 % 1000).alias("completed"), (k % 5).alias("failed"))


_MONITOR_SQL = f"""
WITH {_PASSED},
shots AS (
  SELECT task_id, ts AS taken, event_id % 40 AS pending, event_id * 7 % 1000 AS completed, event_id % 5 AS failed, rn FROM n),
deltas AS (
  SELECT task_id, taken, (epoch_us(taken) - lag(epoch_us(taken)) OVER w) / 1e6 AS seconds, coalesce(pending - lag(pending) OVER w, 0) AS new_pending, coalesce(completed - lag(completed) OVER w, 0) AS new_completed,
         coalesce(failed - lag(failed) OVER w, 0) AS new_failed, pending FROM shots WINDOW w AS (PARTITION BY task_id ORDER BY rn)),
rates AS (SELECT *, CASE WHEN seconds > 0 THEN new_completed / seconds END AS rate FROM deltas)
SELECT task_id, taken, seconds, new_pending, new_completed, new_failed, round(rate, 9) AS per_second, CASE WHEN rate > 0 THEN round(pending / rate, 3) END AS eta_seconds FROM rates"""


def _rounded(rows: DataFrame) -> DataFrame:
    return rows.withColumn("per_second", F.round("per_second", 9)).withColumn("eta_seconds", F.round("eta_seconds", 3))


@query(_MONITOR_SQL)
def monitor_deltas(spark: SparkSession, d: str) -> DataFrame:
    """Differences between snapshots of each task's counters, with speed and time left."""
    return _rounded(ordered.batch(_snapshots(_passed(events(spark, d), "ts")), sessions.Monitor(), "task_id", "ts", "event_id", ["pending", "completed", "failed"]))


@query(_MONITOR_SQL)
def monitor_deltas_stream(spark: SparkSession, d: str) -> DataFrame:
    """The same as snapshots arrive, late ones in their place."""
    made = ordered.stream(_snapshots(_event_stream(spark, d)), sessions.Monitor(), "task_id", "ts", "event_id", ["pending", "completed", "failed"], "0 seconds")
    return _rounded(ordered.settled(made, "monitor"))
