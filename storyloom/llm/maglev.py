"""Sharding by a permutation-filled lookup table (operator 5), in DataFrame operations only."""

from __future__ import annotations

from collections.abc import Sequence
from hashlib import md5

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHARDS = 16
#: A prime, over a hundred slots for each shard, so that shares differ by less than one in a hundred.
SLOTS = 2003


def _number(text: str) -> int:
    return int(md5(text.encode()).hexdigest()[:15], 16)


def lookup_table(shards: Sequence[str], slots: int = SLOTS) -> list[int]:
    """Which shard holds each slot.

    A shard prefers the slots ``(offset + j * skip) mod slots``; as ``slots`` is prime, that
    visits all of them. In turns, each shard claims its first slot that is still free. Taking a
    shard away moves its own slots and few others. The table has ``slots`` entries: it depends
    on the parameters, never on the data.
    """
    if slots < 2 or any(slots % k == 0 for k in range(2, int(slots**0.5) + 1)):
        raise ValueError("the number of slots must be prime")
    if not 0 < len(shards) <= slots or len(set(shards)) < len(shards):
        raise ValueError("shards must have distinct names, and no more than there are slots")
    at = [_number(f"offset:{s}") % slots for s in shards]
    skip = [_number(f"skip:{s}") % (slots - 1) + 1 for s in shards]
    table, left = [-1] * slots, slots
    while left:
        for k in range(len(shards)):
            while table[at[k]] >= 0:
                at[k] = (at[k] + skip[k]) % slots
            table[at[k]], left = k, left - 1
            if not left:
                break
    return table


def slot(key: Column, slots: int) -> Column:
    """The first 60 bits of the key's MD5, modulo ``slots``; a null key counts as an empty one."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return F.pmod(F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long"), F.lit(slots).cast("long"))


def place(df: DataFrame, key: str = "doc_id", shards: Sequence[str] | None = None, slots: int = SLOTS) -> DataFrame:
    """Adds ``slot``, ``shard`` and ``shard_name`` to each row, by its key.

    Rows of one key share a shard; a null key counts as an empty text. Repeated rows are kept,
    and input columns of the three names are replaced. The lookup table has a row for each slot,
    so its broadcast is bounded by ``slots``; rows are neither shuffled nor dropped.
    """
    names = list(shards) if shards is not None else shard_names(SHARDS)
    table = table_frame(df.sparkSession, names, slots)
    kept = df.drop("slot", "shard", "shard_name").withColumn("slot", slot(F.col(key), slots))
    return kept.join(F.broadcast(table), "slot", "left").select(*kept.columns, "shard", "shard_name")


def shard_names(n: int) -> list[str]:
    return [f"shard-{k:04d}" for k in range(n)]


def table_frame(spark: SparkSession, names: Sequence[str], slots: int = SLOTS) -> DataFrame:
    """The lookup table as rows: slot, shard, shard_name."""
    filled = F.split(F.lit(",".join(map(str, lookup_table(names, slots)))), ",")
    called = F.array(*[F.lit(n) for n in names])
    return (
        spark.range(1)
        .select(F.posexplode(filled).alias("slot", "shard"))
        .select(F.col("slot").cast("long").alias("slot"), F.col("shard").cast("int").alias("shard"))
        .withColumn("shard_name", F.element_at(called, F.col("shard") + 1))
    )
