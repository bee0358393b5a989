"""Best-fit decreasing packing into training sequences (operator 10)."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import encoders
from .common import rest, slices

WINDOW = 2048
#: Documents that one task packs together, on average.
GROUP_DOCS = 8192
#: Texts encoded at once, if they are short.
ROWS = 1024


class OpenWindows:
    """Open windows by remaining capacity, under a segment tree that tells which are not empty."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.tree = [0] * (2 * self.size)
        self.at: list[list[int]] = [[] for _ in range(window + 1)]

    def add(self, capacity: int, window: int) -> None:
        self.at[capacity].append(window)
        k = self.size + capacity
        while k:
            self.tree[k] += 1
            k >>= 1

    def tightest(self, length: int) -> tuple[int, int] | None:
        """Takes out the window of least capacity that is ``length`` or more: (capacity, window)."""
        k = self.size + length
        if not self.tree[k]:
            while k > 1 and (k & 1 or not self.tree[k + 1]):
                k >>= 1
            if k <= 1:
                return None
            k += 1
            while k < self.size:
                k = 2 * k if self.tree[2 * k] else 2 * k + 1
        capacity = k - self.size
        while k:
            self.tree[k] -= 1
            k >>= 1
        return capacity, self.at[capacity].pop()


def best_fit_decreasing(lengths: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """For each length (1 to ``window``), its window's number and its offset there."""
    number, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    windows, opened = OpenWindows(window), 0
    for k in np.argsort(-lengths, kind="stable").tolist():
        length = int(lengths[k])
        found = windows.tightest(length) if length < window else None
        if found is None:
            found, opened = (window, opened), opened + 1
        capacity, number[k] = found
        offset[k] = window - capacity
        if capacity > length:
            windows.add(capacity - length, int(number[k]))
    return number, offset


def pieces(
    docs: DataFrame,
    vocabulary: str,
    end_id: int = 1,
    window: int = WINDOW,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = True,
) -> DataFrame:
    """Each document's ids with ``end_id`` after them, cut into full windows and what is left.

    Gives the id, ``start``, ``length``, ``ids_crc32`` (unsigned, of the piece's ids),
    ``doc_tokens`` and, if asked for, ``ids`` (little-endian unsigned 32-bit integers). A null or
    empty text is one piece that holds ``end_id`` alone; a very long one gives as many windows as
    it fills. Repeated rows each give their pieces; other columns are left out, whatever their
    names, and an empty table gives an empty one. There is no shuffle.
    """
    end, step = np.array([end_id], "<u4").tobytes(), 4 * window
    source = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("__text"))
    fields = [T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32", "doc_tokens")]
    fields += [T.StructField("ids", T.BinaryType())] * with_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoders.opened(encoders.WordEnds, vocabulary)
        for batch in batches:
            for at, n in slices(batch.column(1), ROWS):
                encoded = encoder.encode(batch.column(1).slice(at, n))
                sizes = np.array([len(x) for x in encoded], np.int64) + 4
                counts = -(-sizes // step)
                row = np.repeat(np.arange(n), counts)
                start = (np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)) * window
                length = np.minimum(sizes[row] // 4 - start, window)
                data = [x[a : a + step] for x in (ids + end for ids in encoded) for a in range(0, len(x), step)]
                columns = [start, length, [zlib.crc32(x) for x in data], sizes[row] // 4]
                made = [batch.column(0).slice(at, n).take(pa.array(row)), *(pa.array(c, pa.int64()) for c in columns)]
                if with_ids:
                    made.append(pa.array(data, pa.binary()))
                yield pa.RecordBatch.from_arrays(made, names=[id_col, *(f.name for f in fields)])
        rest()

    return source.mapInArrow(cut, T.StructType([source.schema[id_col], *fields]))


def pack(parts: DataFrame, n_docs: int, window: int = WINDOW, group_docs: int = GROUP_DOCS, length_col: str = "length") -> DataFrame:
    """Adds ``sequence_id``, ``offset`` and ``pad_tokens`` to pieces of 1 to ``window`` tokens.

    Rows are dealt by a hash of all their columns and of the task that reads them into
    ``n_docs / group_docs`` groups, so no id or length can fill one, and repeated rows of
    different tasks part; each group is packed by best-fit decreasing; every group wastes at most
    about one window more than packing all together would. Pieces of one length go by id and
    start. ``pad_tokens`` is what a sequence is padded by: up to ``window``, but not at all at a
    power of two. Repeated rows are packed one by one, null ids like others. Input columns of the
    three names are replaced. An empty table gives an empty one.
    """
    groups = max(1, -(-n_docs // group_docs))
    parts = parts.drop("sequence_id", "offset", "pad_tokens")
    dealt = parts.withColumn("__group", F.pmod(F.xxhash64(*parts.columns, F.spark_partition_id()), F.lit(groups)).cast("long"))
    out = T.StructType([*dealt.schema, *(T.StructField(c, T.LongType()) for c in ("sequence_id", "offset", "pad_tokens"))])

    def packed(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([c for c in ("doc_id", "start") if c in rows], kind="stable")
        number, offset = best_fit_decreasing(rows[length_col].to_numpy(np.int64), window)
        filled = np.bincount(number, rows[length_col].to_numpy(np.float64)).astype(np.int64)
        pad = np.where(filled & (filled - 1), window - filled, 0)
        return rows.assign(sequence_id=(rows["__group"].to_numpy(np.int64) << 32) + number, offset=offset, pad_tokens=pad[number])

    return dealt.groupBy("__group").applyInPandas(packed, out).drop("__group")
