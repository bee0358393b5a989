"""Token ids in files of bit planes (operator 1).

Ids are laid end to end in ascending doc_id order and cut into blocks of a fixed size. A block
is transposed into bit planes (or byte planes), so that like bits lie together; each plane is
compressed with zstandard alone, and planes above the block's largest id are not stored.

On disk, in one folder:

* ``blocks``: a row for each block with ``shard``, ``block``, ``first`` (its first id's place in
  the shard), ``n_ids``, ``planes`` (compressed, one after another), ``plane_ends`` and ``docs``
  (which documents' ids it holds, and where);
* ``index``: the chunk index, a row for each block without the payload, with the block's
  ``start`` among all ids. ``read`` takes the starts of documents from it, and ``span`` the blocks
  that hold some range of ids, so that no others are opened.

The files are written by Spark's committer, so a lost executor leaves no half file behind.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import encoders
from .common import rest, slices

BLOCK_IDS = 65_536
#: Byte planes came out smaller than bit planes here, and faster both ways.
KIND = "byte"
#: Texts encoded at once, if they are short.
ROWS = 1024

_BLOCKS = (
    "shard int, block int, first bigint, n_ids int, planes binary, plane_ends array<int>,"
    "docs array<struct<doc_id:bigint,doc_start:bigint,doc_tokens:bigint,piece:bigint,at:int,length:int>>"
)


def transpose(ids: np.ndarray, kind: str = KIND) -> list[bytes]:
    """The planes of unsigned 32-bit ids, lowest first, none above the highest that is not 0."""
    raw = np.ascontiguousarray(ids, "<u4")
    width = int(raw.max(initial=0)).bit_length()
    if kind == "byte":
        return [p.tobytes() for p in raw.view(np.uint8).reshape(-1, 4).T[: -(-width // 8)]]
    bits = np.unpackbits(raw.view(np.uint8).reshape(-1, 4)[:, : -(-width // 8)], axis=1, bitorder="little")
    return [p.tobytes() for p in np.packbits(bits.T[:width], axis=1, bitorder="little")]


def restore(planes: list[bytes], n_ids: int, kind: str = KIND) -> np.ndarray:
    """The ids whose planes ``transpose`` gave."""
    out = np.zeros((n_ids, 4), np.uint8)
    if kind == "byte":
        for k, p in enumerate(planes):
            out[:, k] = np.frombuffer(p, np.uint8)
    elif planes:
        packed = np.frombuffer(b"".join(planes), np.uint8).reshape(len(planes), -1)
        bits = np.unpackbits(packed, axis=1, count=n_ids, bitorder="little").T
        whole = np.packbits(bits, axis=1, bitorder="little")
        out[:, : whole.shape[1]] = whole
    return out.view("<u4").ravel()


def write(
    docs: DataFrame,
    path: str,
    vocabulary: str,
    end_id: int = 0,
    block_ids: int = BLOCK_IDS,
    kind: str = KIND,
    level: int = 3,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> None:
    """Encodes ``docs`` and writes the files described above under ``path``.

    Each document gets ``end_id`` after its ids. A null text counts as an empty one; a null id
    comes first; rows that share an id follow each other in order of a hash of their texts, and
    each is a document of its own. Other columns are ignored, whatever their names. An empty
    table writes empty files. A document longer than a block spans as many as it needs.
    """
    order = [F.col(id_col).asc_nulls_first(), F.xxhash64(text_col).asc()]
    ordered = docs.select(id_col, text_col).repartitionByRange(*order).sortWithinPartitions(*order)
    end = np.array([end_id], "<u4").tobytes()
    arrow = pa.list_(pa.struct([(n, pa.int32() if n in ("at", "length") else pa.int64()) for n in ("doc_id", "doc_start", "doc_tokens", "piece", "at", "length")]))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        press = zstandard.ZstdCompressor(level=level).compress
        shard, block, first, place = TaskContext.get().partitionId(), 0, 0, 0
        buffer, held, docs_in = [], 0, []

        def flush() -> pa.RecordBatch:
            nonlocal block, first, buffer, held, docs_in
            planes = [press(p) for p in transpose(np.frombuffer(b"".join(buffer), "<u4"), kind)]
            row = [[shard], [block], [first], [held], [b"".join(planes)], [np.cumsum([len(p) for p in planes], dtype=np.int32).tolist()]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int32())]
            made = [pa.array(v, t) for v, t in zip(row, kinds, strict=True)] + [pa.array([docs_in], arrow)]
            block, first, buffer, held, docs_in = block + 1, first + held, [], 0, []
            return pa.RecordBatch.from_arrays(made, names=["shard", "block", "first", "n_ids", "planes", "plane_ends", "docs"])

        encoder = encoders.opened(encoders.ByteLevel, vocabulary)
        for batch in batches:
            for at, n in slices(batch.column(1), ROWS):
                part = batch.slice(at, n)
                for doc_id, ids in zip(part.column(0).to_pylist(), encoder.encode(part.column(1)), strict=True):
                    ids, taken = ids + end, 0
                    total = len(ids) // 4
                    while taken < total:
                        n = min(total - taken, block_ids - held)
                        buffer.append(ids[4 * taken : 4 * (taken + n)])
                        docs_in.append({"doc_id": doc_id, "doc_start": place, "doc_tokens": total, "piece": taken, "at": held, "length": n})
                        held, taken = held + n, taken + n
                        if held == block_ids:
                            yield flush()
                    place += total
        if held:
            yield flush()
        rest()

    spark = docs.sparkSession
    ordered.mapInArrow(blocks, _BLOCKS).write.option("compression", "uncompressed").parquet(f"{path}/blocks")
    chunks = spark.read.parquet(f"{path}/blocks").select("shard", "block", "first", "n_ids", "plane_ends")
    chunks.join(F.broadcast(_shard_starts(chunks)), "shard").select(
        "shard", "block", (F.col("shard_start") + F.col("first")).alias("start"), "n_ids", "plane_ends"
    ).write.parquet(f"{path}/index")


def _shard_starts(blocks: DataFrame) -> DataFrame:
    """How many ids lie before each shard: a row for each write task, so it can be broadcast."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    totals = blocks.groupBy("shard").agg(F.sum("n_ids").alias("ids"))
    return totals.select("shard", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("shard_start"))


def read(spark: SparkSession, path: str, kind: str = KIND, with_ids: bool = True) -> DataFrame:
    """The documents in the files: doc_id, start (ids before it), n_tokens, ids_crc32 and ids.

    ``ids`` holds little-endian unsigned 32-bit integers, and can be left out. The compressed
    blocks of a shard are brought together in order, so each is opened once, and a document that
    lies across blocks is put together as they pass by. Starts come from the chunk index.
    """

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpress = zstandard.ZstdDecompressor().decompress
        held: list[bytes] = []

        def rows(shard: int, docs: pa.StructArray, ids: list[bytes]) -> pa.RecordBatch:
            fields = [docs.field(c) for c in ("doc_id", "doc_start", "doc_tokens")]
            made = [pa.array([shard] * len(docs), pa.int32()), *fields, pa.array(list(map(zlib.crc32, ids)), pa.int64())]
            made += [pa.array(ids, pa.binary())] * with_ids
            return pa.RecordBatch.from_arrays(made, names=["shard", "doc_id", "doc_start", "n_tokens", "ids_crc32", "ids"][: len(made)])

        for batch in batches:
            shards, counts, ends = (batch.column(c).to_pylist() for c in ("shard", "n_ids", "plane_ends"))
            for k in range(batch.num_rows):
                planes, docs = batch.column("planes")[k].as_buffer(), batch.column("docs")[k].values
                ids = restore([unpress(planes[a:b]) for a, b in zip([0, *ends[k]], ends[k], strict=False)], counts[k], kind).tobytes()
                at, length, piece, total = (docs.field(c).to_numpy() for c in ("at", "length", "piece", "doc_tokens"))
                part = np.flatnonzero(length < total).tolist()
                low, high = 0, len(docs)
                for d in part:
                    held.append(ids[4 * at[d] : 4 * (at[d] + length[d])])
                    if piece[d] + length[d] == total[d]:
                        yield rows(shards[k], docs.slice(d, 1), [b"".join(held)])
                        held.clear()
                    low, high = (d + 1, high) if d == 0 else (low, d)
                if high > low:
                    cuts = [4 * x for x in (*at[low:high].tolist(), int(at[high - 1] + length[high - 1]))]
                    yield rows(shards[k], docs.slice(low, high - low), [ids[a:b] for a, b in zip(cuts, cuts[1:], strict=False)])

    blocks, index = spark.read.parquet(f"{path}/blocks"), spark.read.parquet(f"{path}/index")
    # A row for each task that wrote, so it can be broadcast.
    starts = F.broadcast(index.where("block = 0").select("shard", F.col("start").alias("shard_start")))
    ordered = blocks.repartitionByRange("shard").sortWithinPartitions("shard", "block")
    columns = "shard int, doc_id bigint, doc_start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids binary" * with_ids
    found = ordered.mapInArrow(documents, columns).join(starts, "shard")
    more = ["ids"] * with_ids
    return found.select("doc_id", (F.col("shard_start") + F.col("doc_start")).alias("start"), "n_tokens", "ids_crc32", *more)


def span(spark: SparkSession, path: str, start: int, n: int, kind: str = KIND) -> DataFrame:
    """The ids from place ``start`` among all ids on, ``n`` of them at most: rows of ``start`` and ``ids``.

    The chunk index names the blocks; only these are opened, each by itself.
    """
    chunks = spark.read.parquet(f"{path}/index").where((F.col("start") < start + n) & (F.col("start") + F.col("n_ids") > start))
    blocks = spark.read.parquet(f"{path}/blocks").select("shard", "block", "planes").join(chunks, ["shard", "block"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpress = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for row in batch.to_pylist():
                ends = row["plane_ends"]
                ids = restore([unpress(row["planes"][a:b]) for a, b in zip([0, *ends], ends, strict=False)], row["n_ids"], kind)
                low, high = max(0, start - row["start"]), min(row["n_ids"], start + n - row["start"])
                made = pa.array([row["start"] + low], pa.int64()), pa.array([ids[low:high].tobytes()], pa.binary())
                yield pa.RecordBatch.from_arrays(list(made), names=["start", "ids"])

    return blocks.select("start", "n_ids", "plane_ends", "planes").mapInArrow(cut, "start bigint, ids binary")
