"""State and timers over streams: rows of a key are folded in order of event time, whatever order they arrive in.

A row is held in list state until the watermark has passed it, as no earlier one can come then; a timer
wakes the key for it. Rows that arrive together are one element of that list, and what a key tells together is one
row until it has left the state's operator: each element is a message, and each key's frame is converted column by column. So a stream gives the rows that a batch over the sorted table gives, by the same fold.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: A moment after all others, in microseconds.
NEVER = 1 << 62
#: Rows after which a task gives away what it has.
TOLD = 10_000


class Fold:
    """What a key remembers, how a row changes it, and what is told; all times are microseconds.

    ``memory`` is the DDL of the state, ``told`` that of the rows given. ``begin()`` is the first state,
    ``row(state, time, *values)`` and ``until(state, time)`` return the next state and rows: the latter is called
    with a time that no coming row is before. ``rest(state)`` returns rows, ``wake(state)`` is the time at which ``until`` has something to tell.
    """

    memory = told = ""

    def begin(self) -> tuple:
        raise NotImplementedError

    def row(self, state: tuple, time: int, *values) -> tuple[tuple, list[tuple]]:
        raise NotImplementedError

    def until(self, state: tuple, time: int) -> tuple[tuple, list[tuple]]:
        return state, []

    def rest(self, state: tuple) -> list[tuple]:
        """What is told once all rows that were due are folded, and not for each of them."""
        return []

    def wake(self, state: tuple) -> int:
        return NEVER


def batch(rows: DataFrame, fold: Fold, key: str, time: str, order: str, values: Sequence[str], end: str | None = None) -> DataFrame:
    """The fold over a table: rows are dealt by key and sorted by Spark, and a task holds one key's state at a time.

    ``end`` names a column with the time up to which silence is known to last, in microseconds.
    """
    micros = F.unix_micros(F.col(time).cast("timestamp"))
    taken = [F.col(key).alias("__key"), micros.alias("__at"), F.col(order).alias("__order"), *values, (F.col(end) if end else F.lit(None).cast("long")).alias("__end")]
    dealt = rows.select(*taken).repartition("__key").sortWithinPartitions("__key", "__at", "__order")
    names = [key, *_told_names(fold)]

    def ended(held: tuple | None, state: tuple, limit: int | None) -> list[tuple]:
        if held is None:
            return []
        told = [*fold.rest(state), *(fold.until(state, limit)[1] if limit is not None else [])]
        return [(held[0], *r) for r in told]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, state, limit, out = None, None, None, []
        for part in batches:
            for row in _plain(part):
                if held is None or row[0] != held[0]:
                    out += ended(held, state, limit)
                    held, state = (row[0],), fold.begin()
                    limit = None if row[-1] is None else int(row[-1])
                state, told = fold.until(state, row[1])
                out += [(held[0], *r) for r in told]
                state, told = fold.row(state, row[1], *row[2:-1])
                out += [(held[0], *r) for r in told]
            if len(out) > TOLD:
                yield _frame(out, names, fold)
                out = []
        out += ended(held, state, limit)
        if out:
            yield _frame(out, names, fold)

    return dealt.mapInPandas(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, {fold.told}")


def _plain(frame: pd.DataFrame, names: Sequence[str] = ()) -> Iterator[tuple]:
    """Rows of plain values (of the columns named, or of all), with None for what is missing."""
    columns = []
    for name in names or frame.columns:
        column = frame[name]
        values = column.tolist()
        if column.dtype.kind not in "iub" and (gone := column.isna().to_numpy()).any():
            values = [None if no else v for v, no in zip(values, gone, strict=True)]
        columns.append(values)
    return zip(*columns, strict=True)


def _told_names(fold: Fold) -> list[str]:
    """Names of the DDL's columns, without a session to parse it."""
    out, depth, word = [], 0, ""
    for c in fold.told + ",":
        depth += (c in "<(") - (c in ">)")
        if c == "," and not depth:
            out.append(word.split()[0])
            word = ""
        else:
            word += c
    return out


def _frame(rows: list[tuple], names: list[str], fold: Fold) -> pd.DataFrame:
    frame = pd.DataFrame(dict(zip(names, zip(*rows, strict=True), strict=True)))
    kinds = dict(zip(_told_names(fold), _kinds(fold.told), strict=True))
    for name, kind in kinds.items():
        if kind == "timestamp":
            frame[name] = pd.to_datetime(frame[name], unit="us", utc=True)
    return frame


def _kinds(ddl: str) -> list[str]:
    out, depth, word = [], 0, ""
    for c in ddl + ",":
        depth += (c in "<(") - (c in ">)")
        if c == "," and not depth:
            out.append(" ".join(word.split()[1:]))
            word = ""
        else:
            word += c
    return out


class InOrder(StatefulProcessor):
    """Runs a fold over a stream: list state for rows that wait, value state for what the fold remembers, timers for both."""

    def __init__(self, fold: Fold, key: str, values: Sequence[str], held: str):
        self.fold, self.key, self.columns = fold, key, ["row_micros", "row_order", *values]
        self.whole = [k in ("bigint", "int", "smallint", "tinyint") for k in _kinds(held)]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "rows binary")
        self.memory = handle.getValueState("memory", self.fold.memory)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first = NEVER
        for frame in rows:
            held = list(_plain(frame, self.columns))
            # Whole numbers beside missing ones reach Python as fractions.
            broken = [whole and frame[name].dtype.kind not in "iub" for name, whole in zip(self.columns, self.whole, strict=True)]
            if any(broken):
                held = [tuple(int(v) if no and v is not None else v for v, no in zip(r, broken, strict=True)) for r in held]
            self.held.appendValue((pickle.dumps(held),))
            first = min(first, min(r[0] for r in held))
        self.handle.registerTimer(first // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = sorted((r for (packed,) in self.held.get() for r in pickle.loads(packed)), key=lambda r: r[:2])
        due, later = [r for r in waiting if r[0] < now], [r for r in waiting if r[0] >= now]
        memory, out = self.memory.get(), []
        state = self.fold.begin() if memory is None else tuple(memory)
        for r in due:
            state, told = self.fold.until(state, r[0])
            out += told
            state, told = self.fold.row(state, *r)
            out += told
        state, told = self.fold.until(state, now)
        out += told
        if due:
            out += self.fold.rest(state)
            self.held.put([(pickle.dumps(later),)]) if later else self.held.clear()
        if state == self.fold.begin() and not later:
            self.memory.clear()  # nothing is known of the key any more, so it costs nothing
        else:
            self.memory.update(state)
        soonest = min([self.fold.wake(state), *(r[0] for r in later[:1])])
        if soonest < NEVER:
            self.handle.registerTimer(max(soonest, now) // 1000 + 1)
        return iter([pd.DataFrame({self.key: [key[0]], "told": [pickle.dumps(out)]})] if out else ())


def stream(rows: DataFrame, fold: Fold, key: str, time: str, order: str, values: Sequence[str], late: str = "10 minutes") -> DataFrame:
    """The fold over a stream. Rows later than ``late`` are dropped; state of a key goes with its last row that matters."""
    micros = F.unix_micros(F.col(time).cast("timestamp"))
    taken = rows.select(F.col(key), F.col(time).cast("timestamp").alias(time), micros.alias("row_micros"), F.col(order).alias("row_order"), *[v for v in values if v not in (key, time)]).withWatermark(time, late)
    held = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in taken.select("row_micros", "row_order", *values).schema)
    kind = f"`{key}` {rows.schema[key].dataType.simpleString()}"
    told = taken.groupBy(key).transformWithStateInPandas(InOrder(fold, key, values, held), f"{kind}, told binary", "Append", "EventTime")
    schema = T._parse_datatype_string(f"{kind}, {fold.told}")
    return told.mapInArrow(_unpacked(to_arrow_schema(schema)), schema)


def _unpacked(schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Makes rows of what keys have told."""

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for part in batches:
            for key, told in zip(*(c.to_pylist() for c in part.columns), strict=True):
                out += [(key, *r) for r in pickle.loads(told)]
                if len(out) > TOLD:
                    yield batch(out)
                    out = []
        if out:
            yield batch(out)

    return run


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``; a local session without it gets one of its own."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="storyloom-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def settled(made: DataFrame, name: str) -> DataFrame:
    """Runs a stream over all that its source holds now, and reads what it wrote in the shared folder."""
    spark = made.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider, None)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        made.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/log").trigger(availableNow=True).start().awaitTermination()
    finally:
        if before:
            spark.conf.set(provider, before)
        else:
            spark.conf.unset(provider)
    return spark.read.schema(made.schema).parquet(f"{path}/rows")
