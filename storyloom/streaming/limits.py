"""State that feeds back on itself: the sliding rate limit; and how often keys are asked for again."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Requests a client may make in a number of seconds.
MOST, SECONDS = 100, 60


def admit(times: Iterator[float], recent: deque, most: int, seconds: float) -> list[bool]:
    """Which of a client's calls are admitted; a refused call is not recorded, so it delays nobody."""
    out = []
    for t in times:
        while recent and t - recent[0] >= seconds:
            recent.popleft()
        if ok := len(recent) < most:
            recent.append(t)
        out.append(ok)
    return out


def rate_limit(calls: DataFrame, client: str, time: str, order: str, most: int = MOST, seconds: int = SECONDS) -> DataFrame:
    """Adds ``allowed`` to calls. Whether one is refused depends on what was admitted, so no window frame can tell.

    Calls are dealt by client and sorted by Spark; a task reads them as they come and holds one
    client's recent admissions at a time, at most ``most`` of them, however many calls it made.
    """
    keyed = calls.withColumn("__at", F.col(time).cast("timestamp").cast("double")).repartition(client).sortWithinPartitions(client, "__at", order)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        who, recent = object(), deque()
        for batch in batches:
            allowed = []
            for c, t in zip(batch[client], batch["__at"], strict=True):
                if c != who:
                    who, recent = c, deque()
                allowed += admit(iter((t,)), recent, most, seconds)
            yield batch.drop(columns="__at").assign(allowed=allowed)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in calls.schema) + ", allowed boolean"
    return keyed.mapInPandas(run, schema)


def rate_limit_stream(calls: DataFrame, client: str, time: str, most: int = MOST, seconds: int = SECONDS, late: str = "10 minutes") -> DataFrame:
    """The same over a stream: a client's recent admissions are its state.

    A batch's calls of a client are put in order of their time before any is judged; calls later
    than ``late`` are dropped by the watermark. State expires once the watermark has passed the
    last admission by ``seconds``, so silent clients cost nothing.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        recent = deque(state.get[0]) if state.exists else deque()
        frame = pd.concat(list(frames)).sort_values(time, kind="stable")
        times = frame[time].astype("datetime64[ns]").astype("int64") / 1e9
        yield pd.DataFrame({client: key[0], time: frame[time], "allowed": admit(iter(times), recent, most, seconds)})
        state.update((list(recent),))
        state.setTimeoutTimestamp(max(int((recent[-1] + seconds) * 1000), state.getCurrentWatermarkMs() + 1))

    kind = calls.schema[client].dataType.simpleString()
    return calls.withWatermark(time, late).groupBy(client).applyInPandasWithState(
        step, f"`{client}` {kind}, `{time}` timestamp, allowed boolean", "recent array<double>", "append", GroupStateTimeout.EventTimeTimeout
    )


def reuse(log: DataFrame, key: str, time: str, order: str, seconds: float) -> DataFrame:
    """Adds the age of a key's last access, ``age``, and whether a store of so many seconds would still hold it, ``fresh``."""
    before = F.lag(F.col(time)).over(Window.partitionBy(key).orderBy(time, order))
    age = F.col(time).cast("timestamp").cast("double") - before.cast("timestamp").cast("double")
    return log.withColumn("age", age).withColumn("fresh", F.coalesce(F.col("age") < seconds, F.lit(False)))
