"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of an Arrow batch that a text function sees at once, and their bytes but for a single longer text.
SLICE_ROWS, SLICE_BYTES = 512, 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``.

    It is taken from the session. Only a local session without the setting (as in tests)
    gets a folder of its own; a cluster without it is an error.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    import tempfile

    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="storyloom-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


_written: list[tuple[SparkSession, str]] = []


def materialize(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: lineage ends there.

    The table survives the loss of any executor, and later plans see its true size.
    """
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._storyloom_path = path
    _written.append((spark, path))
    return out


def delete_folder(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def release(*tables: DataFrame | None) -> None:
    """Deletes what ``materialize`` wrote, once nothing reads it any more."""
    for df in tables:
        path = getattr(df, "_storyloom_path", None)
        if path and (df.sparkSession, path) in _written:
            _written.remove((df.sparkSession, path))
            delete_folder(df.sparkSession, path)


@contextmanager
def tidied() -> Iterator[None]:
    """On leaving, deletes what was materialized inside and not released: results must be written by then."""
    before = len(_written)
    try:
        yield
    finally:
        while len(_written) > before:
            delete_folder(*_written.pop())


#: Keys that ``join_back`` deals by broadcast, at most.
HOT_KEYS = 1 << 13


def join_back(rows: DataFrame, per_key: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """Joins each row with the one row of its key; column ``n`` of ``per_key`` counts the key's rows, ``total`` all.

    A key of more than ``total / HOT_KEYS`` rows is hot. There are fewer than ``HOT_KEYS`` of
    them, whatever the data, so they are broadcast and their rows are not shuffled; no other key
    can fill a task. ``n`` is dropped.
    """
    least = max(1, total // HOT_KEYS)
    hot = F.broadcast(per_key.where(F.col(n) > least))
    warm = rows.join(hot, key)
    cold = rows.join(hot.select(key), key, "left_anti").join(per_key.where(F.col(n) <= least), key)
    return warm.unionByName(cold).drop(n)


#: A table is broadcast up to so many bytes.
BROADCAST_BYTES = 16 << 20


def sized(df: DataFrame, row_bytes: int) -> DataFrame:
    """A written table as the small side of a join: a broadcast if its rows, counted now, are small enough."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df.hint("shuffle_hash")


def row_keyed(df: DataFrame, name: str = "__row") -> DataFrame:
    """Adds a key of each row's own, which repeated rows do not share: its file and its place there.

    A table that was not read from files is written first, so that its keys stay the same.
    """
    def keyed(table: DataFrame) -> DataFrame:
        place = F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))
        return table.select("*", place.alias(name))

    try:
        return keyed(df)
    except AnalysisException:
        return keyed(materialize(df, "rows"))


def label_split(id_col: str, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus``: the fold of a row."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(modulus))


def bounded_sample(df: DataFrame, rows: int, *by: str) -> DataFrame:
    """About ``rows`` rows at most, picked by a hash of the columns ``by``.

    The share comes from one count, the pick needs no shuffle, and a retried task picks the
    same rows. Binomial spread aside, the sample has ``rows`` rows however large ``df`` is.
    """
    total = df.count()
    if total <= rows:
        return df
    buckets = 1 << 30
    return df.where(F.pmod(F.xxhash64(*by, F.lit("sample")), F.lit(buckets)) < int(buckets * rows / total))


def rest() -> None:
    """Gives back what a task no longer needs: its worker lives on, beside the next tasks'."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not every C library has it
    if trim is not None:
        trim(0)


_kept: dict[object, object] = {}


def kept(key: object, make: Callable[[], object]):
    """What ``make()`` gives, kept in this Python worker until something else is asked for.

    Workers outlive tasks and serve all stages; so one stage's memo never stands beside another's.
    """
    if key not in _kept:
        _kept.clear()
        _kept[key] = make()
    return _kept[key]


def slices(texts: pa.Array, rows: int = SLICE_ROWS, size: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """(first, number) of consecutive rows, at most ``rows`` and, but for a single longer text, ``size`` bytes."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(ends):
        upto = int(np.searchsorted(ends, (int(ends[at - 1]) if at else 0) + size, "right"))
        n = min(max(1, upto - at), rows, len(ends) - at)
        yield at, n
        at += n


def map_text(
    df: DataFrame,
    function: Callable[[], Callable[[list[str | None]], Sequence[Sequence]]],
    fields: Sequence[T.StructField],
    text_col: str = "text",
    carry: Iterable[str] = ("doc_id",),
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """Adds columns that a function of whole texts gives, in Arrow batches, without a shuffle.

    ``function()`` runs once a task and returns a function from a list of texts (or None) to
    one list for each of ``fields``. Columns in ``carry`` go through as they are; one that
    clashes with an output column gives way to the output. A slice of very long texts holds
    fewer rows, so memory follows the longest text and not the number of long ones.
    """
    names = [f.name for f in fields]
    carry = [c for c in dict.fromkeys(carry) if c not in names]
    types = [T.StructType([f]) for f in fields]
    from pyspark.sql.pandas.types import to_arrow_type

    arrow = [to_arrow_type(f.dataType) for f in fields]
    # A text that goes through is sent once, and taken back under its own name.
    whole = [c for c in carry if c == text_col and isinstance(df.schema[c].dataType, T.StringType)]
    source = df.select(*[F.col(c) for c in carry if c not in whole], F.col(text_col).cast("string").alias("__text"))
    schema = T.StructType([df.schema[c] for c in carry] + [f for t in types for f in t])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = function()
        for batch in batches:
            for at, n in slices(batch.column("__text"), slice_rows):
                part = batch.slice(at, n)
                made = of(part.column("__text").to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column("__text" if c in whole else c) for c in carry] + [pa.array(v, type=t) for v, t in zip(made, arrow, strict=True)],
                    names=[*carry, *names],
                )
        rest()

    return source.mapInArrow(run, schema)
