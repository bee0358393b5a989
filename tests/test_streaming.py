"""Folds over streams: rows that arrive in any order give what the sorted table gives; timers, rings and late rows."""

import os
import random
import time
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from storyloom.streaming import ordered
from storyloom.streaming.sessions import Monitor, Progress, Sessions

SCHEMA = "event_id bigint, task_id bigint, ts timestamp, type string, completed bigint"
START = datetime(2024, 1, 1, 0, 0, 1, tzinfo=timezone.utc)


def at(seconds):
    return START + timedelta(seconds=seconds)


def micros(seconds):
    return int(at(seconds).timestamp() * 1_000_000)


def written(spark, folder, batches):
    """A stream that reads one file of rows in each batch, in the order given."""
    for k, rows in enumerate(batches):
        frame = spark.createDataFrame([(i, t, at(s), kind, n) for i, t, s, kind, n in rows], SCHEMA)
        frame.coalesce(1).write.mode("append").parquet(str(folder))
        for f in folder.glob("part-*.parquet"):
            if not (folder / f"{k:03}.parquet").exists() and not f.name[:3].isdigit():
                f.rename(folder / f"{k:03}.parquet")
        for f in (*folder.glob(".*.crc"), *folder.glob("_*")):
            f.unlink()
    for k in range(len(batches)):  # files are read in order of their time
        os.utime(folder / f"{k:03}.parquet", (time.time() - 1000 + k, time.time() - 1000 + k))
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder))


def rows_of(df, *but):
    return sorted(map(repr, df.drop(*but).toPandas().astype(object).values.tolist()))


def shuffled_within(rows, reach, seed):
    """Rows in an order of arrival in which none comes more than ``reach`` seconds late."""
    rng = random.Random(seed)
    return sorted(rows, key=lambda r: r[2] + rng.random() * reach)


FOLDS = {
    "sessions": (Sessions(("end",), ttl=300, beat=40), ["type"]),
    "monitor": (Monitor(), ["completed", "completed", "completed"]),
}


@pytest.mark.parametrize("name", sorted(FOLDS))
def test_any_order_gives_the_rows_of_the_table(spark, tmp_path, name):
    fold, values = FOLDS[name]
    rng = random.Random(2)
    rows = [(k, rng.randrange(3), s, rng.choice(["a", "b", "end"]), rng.randrange(50)) for k, s in enumerate(sorted(rng.sample(range(2000), 60)))]
    arrived = shuffled_within(rows, 100, 3)
    batches = [arrived[k : k + 9] for k in range(0, len(arrived), 9)] + [[(999, 9, 5000, "a", 0)]]  # the last row moves the watermark on
    source = written(spark, tmp_path, batches)
    if name == "monitor":
        source = source.select("*", F.col("completed").alias("pending"), F.col("completed").alias("failed"))
        values = ["pending", "completed", "failed"]
    made = ordered.settled(ordered.stream(source, fold, "task_id", "ts", "event_id", values, "2 minutes"), name).where("task_id < 9")
    table = spark.createDataFrame([(i, t, at(s), kind, n) for i, t, s, kind, n in rows], SCHEMA)
    table = table.select("*", F.col("completed").alias("pending"), F.col("completed").alias("failed"), F.lit(micros(5000 - 120)).alias("end"))
    wanted = ordered.batch(table, fold, "task_id", "ts", "event_id", values, "end")
    assert rows_of(made) == rows_of(wanted) and made.count() > 20


def test_sessions_close_early_or_by_time(spark):
    rows = [(1, 1, 0, "a"), (2, 1, 30, "end"), (3, 1, 31, "a"), (4, 1, 131, "a"), (5, 1, 132, "a"), (6, 2, 5, "end")]
    table = spark.createDataFrame([(i, t, at(s), kind, micros(1000)) for i, t, s, kind in rows], "event_id int, task_id int, ts timestamp, type string, end bigint")
    found = ordered.batch(table, Sessions(("end",), ttl=100, beat=1000), "task_id", "ts", "event_id", ["type"], "end")
    told = [(r.task_id, r.started.timestamp() - START.timestamp(), r.at.timestamp() - START.timestamp(), r.events, r.finished) for r in found.orderBy("task_id", "started").collect()]
    # an event at the very end of a session still belongs to it
    assert told == [(1, 0, 30, 2, True), (1, 31, 131, 2, False), (1, 132, 232, 1, False), (2, 5, 5, 1, True)]


def test_beats_stop_at_the_next_event_and_at_the_end():
    fold = Sessions(("end",), ttl=100, beat=15)
    state, _ = fold.row(fold.begin(), 0, 1, "a")
    state, told = fold.until(state, 45_000_000)
    assert [r[1] // 10**6 for r in told] == [15, 30]  # the event at 45 comes first
    state, _ = fold.row(state, 45_000_000, 2, "a")
    assert fold.wake(state) == 60_000_001
    state, told = fold.until(state, 10**12)
    assert [(r[0], r[1] // 10**6) for r in told] == [("heartbeat", 60), ("heartbeat", 75), ("heartbeat", 90), ("closed", 100)]
    assert state == fold.begin() and fold.until(state, 10**13) == (state, [])


def test_late_rows_are_dropped_and_silent_keys_cost_nothing(spark, tmp_path):
    """A batch drops what is before the watermark that the batch before it went by."""
    batches = [[(1, 1, 0, "a", 1)], [(2, 2, 1000, "a", 1)], [(5, 2, 1100, "a", 1)], [(3, 1, 10, "a", 1)], [(4, 2, 3000, "a", 1)]]
    made = ordered.stream(written(spark, tmp_path, batches), Sessions(("end",), ttl=50, beat=500), "task_id", "ts", "event_id", ["type"], "1 minute")
    found = ordered.settled(made, "late")
    assert sorted((r.task_id, r.events) for r in found.collect()) == [(1, 1), (2, 1), (2, 1)]


def test_views_keep_a_ring_of_lines():
    fold = Progress(3)
    state = fold.begin()
    for k, said in enumerate([("start", "s", None, None, None, None, None), ("progress", "p", None, 9, None, None, None), ("chapter", "c1", 1, None, 0.5, 4, None), ("heartbeat", "h", *[None] * 5), ("chapter", "c2", 2, 8, None, 0, None), ("status", "x", *[None] * 4, "completed")]):
        state, told = fold.row(state, k, k, *said)
    assert state == (2, 8, 0.0, "--", "completed", ["c2", "x", "done: x"]) and told == [(5, *state)]
    assert fold.row(state, 6, 6, "error", "e", *[None] * 5)[0][4:] == ("failed", ["x", "done: x", "e"])


class Cell:
    """A list or value of state that counts what it is told."""

    def __init__(self):
        self.rows, self.calls = [], 0

    def appendValue(self, row):
        self.rows.append(row)
        self.calls += 1

    def appendList(self, rows):
        self.rows += rows
        self.calls += len(rows)

    def get(self):
        return iter(self.rows)

    def exists(self):
        return bool(self.rows)

    def put(self, rows):
        self.rows = list(rows)

    def clear(self):
        self.rows = []


class Kept(Cell):
    def get(self):
        return self.rows[0] if self.rows else None

    def update(self, row):
        self.rows = [tuple(row)]


class Handle:
    def __init__(self):
        self.held, self.memory, self.timers = Cell(), Kept(), []

    def getListState(self, name, schema):
        return self.held

    def getValueState(self, name, schema):
        return self.memory

    def registerTimer(self, at):
        self.timers.append(at)


class Now:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def test_rows_that_come_together_are_one_message_of_state_and_so_is_what_they_tell():
    import pandas as pd

    n = 500
    frame = pd.DataFrame({"task_id": [1] * n, "row_micros": range(1000, 1000 + n * 1000, 1000)[::-1], "row_order": range(n), "type": ["a"] * (n - 1) + [None], "size": [None, *range(1, n)]})
    fold = Monitor()
    fold.row = lambda state, time, order, kind, size: (state, [(time, kind, size)])
    run, handle = ordered.InOrder(fold, "task_id", ["type", "size"], "row_micros bigint, row_order bigint, type string, size bigint"), Handle()
    run.init(handle)
    assert list(run.handleInputRows((1,), iter([frame]), Now(0))) == [] and handle.held.calls == 1 and handle.timers == [2]
    told = list(run.handleExpiredTimer((1,), Now(n), None))
    assert len(told) == 1 and told[0].shape[0] == 1 and told[0]["task_id"].tolist() == [1]
    # the row of the watermark's own millisecond waits for its turn, whole numbers and what is missing with it
    import pickle

    rows = pickle.loads(told[0]["told"][0])
    assert [r[0] for r in rows] == list(range(1000, n * 1000, 1000)) and rows[0] == (1000, None, n - 1)
    assert all(type(r[2]) is int for r in rows) and len(list(handle.held.get())) == 1
    later = list(run.handleExpiredTimer((1,), Now(n + 1), None))
    assert pickle.loads(later[0]["told"][0]) == [(n * 1000, "a", None)] and not handle.held.exists()


def test_last_views_are_told_once_for_the_events_that_pass_together(spark, tmp_path):
    from storyloom.streaming.sessions import LastViews

    kinds = ["start", "chapter", "error"]
    rows = [(k, k % 2, k, kinds[k % 3], k) for k in range(60)]
    source = written(spark, tmp_path, [rows[:30], rows[30:], [(999, 9, 5000, "error", 0)]])
    names = ["kind", "message", "index", "total_said", "speed_said", "eta_said", "status_said"]

    def told(table):
        said = {"kind": "type", "message": "type", "index": "completed", "total_said": "completed", "speed_said": "completed / 2D", "eta_said": "completed", "status_said": "type"}
        return table.select("event_id", "task_id", "ts", *[F.expr(v).alias(k) for k, v in said.items()])

    made = ordered.settled(ordered.stream(told(source), LastViews(3), "task_id", "ts", "event_id", names, "0 seconds"), "views").where("task_id < 9")
    table = spark.createDataFrame([(i, t, at(s), kind, n) for i, t, s, kind, n in rows], SCHEMA)
    every = ordered.batch(told(table), Progress(3), "task_id", "ts", "event_id", names)
    last = ordered.batch(told(table), LastViews(3), "task_id", "ts", "event_id", names)
    assert every.count() == 60 and rows_of(last) == rows_of(every.where("event_id >= 58"))
    # the watermark passes events 0-28, then 29-58, then the rest
    assert sorted(r.event_id for r in made.collect()) == [27, 28, 57, 58, 59]
    assert rows_of(made) == rows_of(every.where("event_id IN (27, 28, 57, 58, 59)"))
