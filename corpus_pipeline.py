"""From raw documents to packed training sequences, in stages that each write a table.

Each stage takes what its predecessor kept and returns the columns of ``documents``, but for the
last, which returns the pieces of the packed sequences. Stages go by rows and not by ids: a row is
known by its place in its file, so repeated rows, rows that share an id and rows without one are
each judged alone. Columns beyond those of ``documents`` go through under any name; an empty table
gives an empty one; very long texts are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.llm import decontam, encoders, host_rules, jaccard, langid, packing
from storyloom.llm.common import delete_folder, join_back, materialize, row_keyed, scratch, sized, tidied

#: Bytes of a row's key in a join.
KEY_BYTES = 32


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told.

    Null, empty and other texts without a letter go. If no row has a language to learn from, all
    texts with a letter stay. Of equal cosines the first language is told, so ties drop nothing.
    """
    profiles = langid.learn(docs)
    if not profiles.names:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    carried = docs.withColumnsRenamed({c: f"in_{c}" for c in docs.columns})
    told = langid.predict(carried, profiles, tuple(carried.columns), text_col="in_text")
    kept = told.where(F.col("lang_pred") != langid.UNDETERMINED)
    return kept.select(*[F.col(f"in_{c}").alias(c) for c in docs.columns])


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules, from hosts that do not mostly fail them.

    Null and empty texts go, as do all of fewer words than the rules ask for. Rows of a null
    source are a host together.
    """
    carried = docs.withColumnsRenamed({c: f"in_{c}" for c in docs.columns})
    judged = host_rules.evaluate(carried, "in_source", tuple(carried.columns), text_col="in_text")
    return judged.where("kept").select(*[F.col(f"in_{c}").alias(c) for c in docs.columns])


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of copies and near copies: that of the least id, null ids last.

    Of several rows of that id, the first in its file stays. A text without words has no copies.
    """
    keyed = row_keyed(docs)
    found = jaccard.join(keyed.withColumn("__none", F.col("doc_id").isNull()), carry=("__row", "__none"), row_col="__row")
    grouped = materialize(found.where(F.col("class_key").isNotNull()).select("class_key", F.struct("__none", "doc_id", "__row").alias("place")), "grouped")
    least = grouped.groupBy("class_key").agg(F.min("place").alias("least"), F.count(F.lit(1)).alias("n"))
    spare = join_back(grouped, least, "class_key", "n", grouped.count()).where(F.col("place") != F.col("least"))
    # Spare copies are a share of the table, so they are never broadcast, however small the table is.
    gone = spare.select(F.col("place.__row").alias("__row"))
    return keyed.join(gone.hint("shuffle_hash"), "__row", "left_anti").select(docs.columns)


def free_of_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Null and empty texts hold none."""
    keyed = row_keyed(docs)
    leaks = decontam.leaks(keyed, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col="__row")
    gone = materialize(leaks.select("__row").distinct(), "leaking")
    return keyed.join(sized(gone, KEY_BYTES), "__row", "left_anti").select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of training sequences, with a digest of each piece's ids. A null text is an empty one."""
    cut = packing.pieces(docs, encoders.tokenizer_path("word_bpe_49k.json"), with_ids=False)
    return packing.pack(cut, docs.count())


STAGES = [
    ("language ID", known_language),
    ("quality rules", good_quality),
    ("n-gram Jaccard join", one_of_each_group),
    ("benchmark decontamination", free_of_benchmarks),
    ("packing", packed),
]

#: SQL expresses neither the profiles' random vectors nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's table is written to the shared folder and read again.

    What a stage wrote on its way is deleted once its table is there, and that table once the next one is.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES:
        path = scratch(spark, "stage")
        with tidied():
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            delete_folder(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
