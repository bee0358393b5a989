"""Readers of text blobs, rules, dictionaries and logs, writers of blobs, and generated rows."""

from __future__ import annotations

import gzip
import json
import re
import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Names a rule may have, the language all others fall back to, and the languages of a synthetic site.
RULE_NAME = r"^[a-zA-Z0-9_-]+$"
BASE_LANGUAGE = "zh"
#: Fixed value: the level at which texts are compressed.
BLOB_LEVEL = 3
LANGUAGES = ("en", "zh", "ja", "ko", "fr", "de", "es", "ru")
PAGE_KINDS = ("/", "/novels", "/novels?category=1", "/search?q=test")


def jdbc(spark: SparkSession, url: str, table: str, key: str | None = None, bounds: tuple[int, int] = (0, 1), partitions: int = 8) -> DataFrame:
    """A table of a relational server; with a numeric key it is read in parallel ranges."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    if key:
        reader = reader.options(partitionColumn=key, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=partitions)
    return reader.load()


def read_blobs(spark: SparkSession, root: str) -> DataFrame:
    """Gzipped texts laid out as ``novel/chapter.txt.gz``: their two ids and the text."""
    path = F.col("_metadata.file_path")
    texts = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt.gz").text(root, wholetext=True)
    return texts.select(
        F.regexp_extract(path, r"([^/]+)/[^/]+\.txt\.gz$", 1).alias("novel_id"),
        F.regexp_extract(path, r"([^/]+)\.txt\.gz$", 1).alias("chapter_id"),
        F.col("value").alias("file_text"),
    )


def resolved(spark: SparkSession, root: str) -> str:
    """A folder's whole address, by the file system that Spark takes it for (that of ``fs.defaultFS`` where it names none)."""
    where = spark._jvm.org.apache.hadoop.fs.Path(root)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toString().rstrip("/")


def opened(address: str):
    """The file system of a whole address, and its path there; for use in tasks, which have no JVM to ask."""
    from pyarrow import fs

    if address.startswith("file:"):
        return fs.LocalFileSystem(), "/" + address.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(address)


def delete_paths(spark: SparkSession, root: str, paths: DataFrame, column: str) -> int:
    """Deletes files by their paths below ``root``; one that is not there is passed over. Gives how many there were."""
    folder = resolved(spark, root)

    def delete(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, base = opened(folder)
        for batch in batches:
            done = []
            for path in batch.column(0).to_pylist():
                there = system.get_file_info(f"{base}/{path}").type == fs.FileType.File
                if there:
                    system.delete_file(f"{base}/{path}")
                done.append(int(there))
            yield pa.RecordBatch.from_arrays([pa.array(done, pa.int32())], names=["deleted"])

    # Paths are few bytes each, and each is a call of the file system: all cores get a share.
    dealt = paths.select(F.col(column).cast("string").alias("path")).repartition(4 * spark.sparkContext.defaultParallelism, "path")
    deleted = dealt.distinct().mapInArrow(delete, "deleted int")
    return int(deleted.agg(F.coalesce(F.sum("deleted"), F.lit(0))).first()[0])


def write_blobs(chapters: DataFrame, root: str) -> DataFrame:
    """Texts that are not empty, each gzipped to ``novel/chapter.txt.gz`` under ``root``; gives what was written.

    A file's name is final only when all of it is there: it is written beside its place by the
    file system that Spark has for ``root``, and renamed. So a task can be run again at any time.
    """
    from pyspark.sql import types as T

    folder = resolved(chapters.sparkSession, root)
    texts = chapters.where(F.length("content") > 0).select(
        F.col("novel_id").cast("string").alias("novel_id"), F.col("id").cast("string").alias("id"), F.col("content").cast("binary").alias("content")
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = opened(folder)
        for batch in batches:
            sizes = []
            for novel, chapter, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                packed = gzip.compress(content, BLOB_LEVEL, mtime=0)
                place, beside = f"{base}/{novel}/{chapter}.txt.gz", f"{base}/{novel}/.{chapter}.{uuid.uuid4().hex}"
                system.create_dir(f"{base}/{novel}", recursive=True)
                with system.open_output_stream(beside) as out:
                    out.write(packed)
                system.move(beside, place)
                sizes.append(len(packed))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64())], names=["novel_id", "chapter_id", "bytes"])

    schema = T.StructType([T.StructField("novel_id", T.StringType()), T.StructField("chapter_id", T.StringType()), T.StructField("bytes", T.LongType())])
    return texts.mapInArrow(write, schema)


def delete_blobs(spark: SparkSession, root: str, gone: DataFrame) -> int:
    """Deletes the files of ``novel_id`` and ``id``; a file that is not there is passed over. Gives how many there were."""
    path = F.concat_ws("/", F.col("novel_id").cast("string"), F.concat(F.col("id").cast("string"), F.lit(".txt.gz")))
    return delete_paths(spark, root, gone.select(path.alias("path")), "path")


def blobs_exist(chapters: DataFrame, blobs: DataFrame) -> DataFrame:
    """Adds ``has_file`` to chapters; the files are listed, not read."""
    there = blobs.select(F.col("chapter_id").alias("id"), F.lit(True).alias("has_file")).distinct()
    return chapters.join(there, "id", "left").withColumn("has_file", F.coalesce("has_file", F.lit(False)))


def save_rule(spark: SparkSession, root: str, source: str, rule: dict) -> None:
    """Writes a rule file by way of another name, so that no reader sees half of it."""
    if not re.fullmatch(RULE_NAME, source):
        raise ValueError(f"not the name of a rule: {source!r}")
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    place = jvm.org.apache.hadoop.fs.Path(f"{root}/{source}.json")
    beside = jvm.org.apache.hadoop.fs.Path(f"{root}/.{source}.{uuid.uuid4().hex}")
    system = place.getFileSystem(conf)
    out = system.create(beside, True)
    out.write(bytearray(json.dumps(rule, ensure_ascii=False, indent=2).encode()))
    out.close()
    files = jvm.org.apache.hadoop.fs
    over = spark.sparkContext._gateway.new_array(files.Options.Rename, 1)
    over[0] = files.Options.Rename.OVERWRITE
    files.FileContext.getFileContext(system.getUri(), conf).rename(system.makeQualified(beside), system.makeQualified(place), over)


def delete_rule(spark: SparkSession, root: str, source: str) -> bool:
    """Whether there was such a rule file."""
    if not re.fullmatch(RULE_NAME, source):
        raise ValueError(f"not the name of a rule: {source!r}")
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{source}.json")
    return bool(place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, False))


def resolve_content(chapters: DataFrame, blobs: DataFrame) -> DataFrame:
    """A chapter's text: its file's, else its own column's, else an empty one."""
    joined = chapters.join(blobs.select("chapter_id", "file_text"), chapters["id"] == blobs["chapter_id"], "left")
    return joined.withColumn("content", F.coalesce(F.nullif("file_text", F.lit("")), "content", F.lit(""))).drop("file_text", "chapter_id")


def count_files(spark: SparkSession, root: str, pattern: str = "*.gz") -> DataFrame:
    """How many files there are; their content is not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    return files.select("path").agg(F.count(F.lit(1)).alias("files"))


def list_rules(spark: SparkSession, root: str, schema: str = "name string, base_url string, _corrupt_record string") -> DataFrame:
    """Rule files and what they hold; one that can't be read is a row with its text in ``_corrupt_record``."""
    rules = spark.read.schema(schema).option("multiLine", True).option("pathGlobFilter", "*.json").json(root)
    source = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.json$", 1)
    return rules.select(source.alias("source"), "*").where(F.col("source").rlike(RULE_NAME)).orderBy("source")


def load_rule(spark: SparkSession, root: str, source: str, schema: str) -> DataFrame:
    if not re.fullmatch(RULE_NAME, source):
        raise ValueError(f"not the name of a rule: {source!r}")
    return spark.read.schema(schema).option("multiLine", True).json(f"{root}/{source}.json")


def dictionary(spark: SparkSession, path: str, language: str) -> DataFrame:
    """A flat JSON object of strings as rows."""
    text = spark.read.text(path, wholetext=True)
    entries = text.select(F.explode(F.from_json("value", "map<string,string>")).alias("key", "value"))
    return entries.withColumn("language", F.lit(language))


def translations(entries: DataFrame, language: str, keys: DataFrame) -> DataFrame:
    """Each key's text in a language, else in the base language, else the key itself."""
    def of(which: str, name: str) -> DataFrame:
        return entries.where(F.col("language") == which).select("key", F.col("value").alias(name))

    found = keys.join(of(language, "__own"), "key", "left").join(of(BASE_LANGUAGE, "__base"), "key", "left")
    return found.select("key", F.coalesce("__own", "__base", "key").alias("text"))


def tail(lines: DataFrame, order: str | Column, size: int, containing: str | None = None, of_last: int | None = None) -> DataFrame:
    """The last lines, in their order; of the last ``of_last`` only those that contain a word, if it is given."""
    key = F.col(order) if isinstance(order, str) else order
    kept = lines.orderBy(key.desc()).limit(of_last or size)
    if containing is not None:
        kept = kept.where(F.col("value").contains(containing)).orderBy(key.desc()).limit(size)
    return kept.orderBy(key.asc())


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """A log's lines, stripped, each with its place: file and offset follow from the reading order of its splits."""
    lines = spark.read.text(path).select(F.btrim("value", F.lit(" \t\r")).alias("value"))
    return lines.withColumn("line", F.monotonically_increasing_id())


def book_range(spark: SparkSession, first: int, last: int, base: str) -> DataFrame:
    """A placeholder for each book number of a range."""
    return spark.range(first, last + 1).select(
        F.col("id").alias("book_id"),
        F.concat(F.lit("Book-"), F.col("id").cast("string")).alias("title"),
        F.concat(F.lit(f"{base.rstrip('/')}/book/"), F.col("id").cast("string"), F.lit("/")).alias("source_url"),
    )


def _pick(values: Sequence[str], number: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(number, F.lit(len(values))) + 1).cast("int"))


def synthetic_sites(spark: SparkSession, n: int, seed: int = 7) -> DataFrame:
    return spark.range(n).select(
        F.format_string("site%04d.test", "id").alias("domain"),
        _pick(LANGUAGES, F.col("id")).alias("language"),
        F.floor(F.rand(seed) * 1000).cast("int").alias("offset_val"),
    )


def synthetic_requests(spark: SparkSession, n: int, sites: int, seed: int = 7) -> DataFrame:
    """Requests of random pages of random sites."""
    drawn = spark.range(n).select("id", F.floor(F.rand(seed) * sites).alias("site"), F.floor(F.rand(seed + 1) * len(PAGE_KINDS)).alias("page"))
    return drawn.select("id", F.format_string("site%04d.test", "site").alias("domain"), _pick(PAGE_KINDS, F.col("page")).alias("path"))
