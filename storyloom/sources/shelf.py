"""Chapters and their texts in one write: rows as Parquet and gzipped blobs appear together, or neither does.

A folder holds ``rows/<write>/*.parquet`` and ``blobs/<write>/<novel>/<chapter>.txt.gz``; a row names its blob in
``content_file``. Tasks write under ``_staging/<write>``; the driver's commit moves the blobs and then the rows by one rename
each, and the second is what readers see. A write that fails is deleted, as is what failed attempts left.
"""

from __future__ import annotations

import gzip
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from .files import BLOB_LEVEL, opened, resolved

#: What a row has besides its text.
COLUMNS = "novel_id string, id string, title string, sort_order int, word_count int"
ROWS = f"{COLUMNS}, content_file string"
#: Rows that a task holds before it writes them.
HELD = 10_000
#: Bytes of texts that a task reads before it gives them away.
READ = 16_000_000


class Written(WriterCommitMessage):
    """What a task wrote: its attempt's name, rows and blobs."""

    def __init__(self, attempt: str, rows: int, blobs: int):
        self.attempt, self.rows, self.blobs = attempt, rows, blobs


class ShelfWriter(DataSourceWriter):
    def __init__(self, root: str, overwrite: bool):
        self.root, self.overwrite, self.name = root, overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator) -> Written:
        system, base = opened(self.root)
        attempt, rows, blobs = uuid.uuid4().hex, 0, 0
        staging = f"{base}/_staging/{self.name}"
        schema = pa.schema([(n, pa.int32() if n in ("sort_order", "word_count") else pa.string()) for n in ("novel_id", "id", "title", "sort_order", "word_count", "content_file")])
        system.create_dir(f"{staging}/rows", recursive=True)
        place, held, made = f"{staging}/rows/{attempt}.parquet", [], set()

        with system.open_output_stream(place) as out, pq.ParquetWriter(out, schema) as file:
            for row in iterator:
                where = row.content_file if "content_file" in row else None
                if row.content:
                    own = f"{attempt}/{row.novel_id}"
                    where = f"blobs/{self.name}/{own}/{row.id}.txt.gz"
                    if own not in made:
                        system.create_dir(f"{staging}/blobs/{own}", recursive=True)
                        made.add(own)
                    with system.open_output_stream(f"{staging}/blobs/{own}/{row.id}.txt.gz", compression=None) as blob:
                        blob.write(gzip.compress(row.content.encode("utf-8", "surrogatepass"), BLOB_LEVEL, mtime=0))
                    blobs += 1
                held.append((row.novel_id, row.id, row.title, row.sort_order, row.word_count, where))
                rows += 1
                if len(held) == HELD:
                    file.write_table(pa.Table.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema))
                    held = []
            if held:
                file.write_table(pa.Table.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema))
        return Written(attempt, rows, blobs)

    def commit(self, messages: list) -> None:
        """Drops what attempts left that did not end well, moves blobs, then rows; then what an overwrite replaces goes."""
        from pyarrow import fs

        system, base = opened(self.root)
        staging, good = f"{base}/_staging/{self.name}", {m.attempt for m in messages if m is not None}
        before = [i.path for i in system.get_file_info(fs.FileSelector(f"{base}/rows", allow_not_found=True))] if self.overwrite else []
        for kind in ("blobs", "rows"):
            for info in system.get_file_info(fs.FileSelector(f"{staging}/{kind}", allow_not_found=True)):
                if info.base_name.removesuffix(".parquet") not in good:
                    (system.delete_dir if info.type == fs.FileType.Directory else system.delete_file)(info.path)
            if system.get_file_info(f"{staging}/{kind}").type == fs.FileType.Directory:
                system.create_dir(f"{base}/{kind}", recursive=True)
                system.move(f"{staging}/{kind}", f"{base}/{kind}/{self.name}")
        for path in before:
            system.delete_dir(path)
        if system.get_file_info(staging).type == fs.FileType.Directory:
            system.delete_dir(staging)

    def abort(self, messages: list) -> None:
        from pyarrow import fs

        system, base = opened(self.root)
        if system.get_file_info(f"{base}/_staging/{self.name}").type == fs.FileType.Directory:
            system.delete_dir(f"{base}/_staging/{self.name}")


class Shelf(DataSource):
    """``df.write.format("shelf").option("path", ...)``; texts are in ``content``, and a ``content_file`` that is set stays."""

    @classmethod
    def name(cls) -> str:
        return "shelf"

    def schema(self) -> str:
        return f"{ROWS}, content string"

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceWriter:
        return ShelfWriter(self.options["path"], overwrite)


def put(chapters: DataFrame, root: str, overwrite: bool = False) -> None:
    """Writes chapters with their texts; ``overwrite`` replaces all rows."""
    spark = chapters.sparkSession
    spark.dataSource.register(Shelf)
    known = {"content_file": "string", "content": "string"}
    own = [F.col(f.name).cast(f.dataType).alias(f.name) for f in T._parse_datatype_string(COLUMNS)]
    own += [(F.col(c) if c in chapters.columns else F.lit(None)).cast(k).alias(c) for c, k in known.items()]
    chapters.select(*own).write.format("shelf").option("path", resolved(spark, root)).mode("overwrite" if overwrite else "append").save()


def rows(spark: SparkSession, root: str) -> DataFrame:
    """The rows of all writes that were committed."""
    return spark.read.schema(ROWS).option("recursiveFileLookup", True).parquet(f"{root.rstrip('/')}/rows")


def contents(spark: SparkSession, root: str) -> DataFrame:
    """Rows with their texts; a row without a blob has none.

    Tasks open the blobs that their rows name: no folder is listed, and rows are dealt, as each is a file to open.
    """
    named = rows(spark, root).repartition(4 * spark.sparkContext.defaultParallelism, "content_file", "novel_id", "id")
    folder = resolved(spark, root)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = opened(folder)
        for batch in batches:
            first, texts, size = 0, [], 0
            for k, place in enumerate(batch.column("content_file").to_pylist(), 1):
                texts.append(_text(system, base, place))
                size += len(texts[-1] or b"")
                if size > READ or k == batch.num_rows:
                    part = batch.slice(first, k - first)
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.binary())], names=[*batch.schema.names, "content"])
                    first, texts, size = k, [], 0

    return named.mapInArrow(read, f"{ROWS}, content binary").withColumn("content", F.col("content").cast("string"))


def _text(system, base: str, place: str | None) -> bytes | None:
    """A blob's bytes; None where there is none."""
    if place is None:
        return None
    try:
        with system.open_input_stream(f"{base}/{place}", compression=None) as blob:
            return gzip.decompress(blob.read())
    except FileNotFoundError:
        return None


def remove_novels(spark: SparkSession, root: str, novels: DataFrame) -> int:
    """Deletes novels' chapters and then their texts, so no row is ever without its text; gives how many texts went."""
    from .files import delete_paths

    own = novels.select(F.col("novel_id").cast("string").alias("novel_id")).distinct()
    # The list of texts is written before the rows that name them go.
    listed = f"{root.rstrip('/')}/_gone/{uuid.uuid4().hex}"
    rows(spark, root).join(own, "novel_id", "left_semi").where("content_file IS NOT NULL").select("content_file").write.parquet(listed)
    put(rows(spark, root).join(own, "novel_id", "left_anti"), root, overwrite=True)
    return delete_paths(spark, root, spark.read.schema("content_file string").parquet(listed), "content_file")
