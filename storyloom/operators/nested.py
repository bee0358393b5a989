"""Nested results: chapters in volumes, novels with their categories, and pages whose strings are translated in place."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from .matching import looked_up
from .windows import FIRST_VOLUME

#: Fixed value: characters of a description that a page shows in another language.
SHOWN = 500


def in_volumes(chapters: DataFrame) -> DataFrame:
    """Of each novel its ``volumes``, an array of structs with their chapters in order; none where all chapters are of one.

    A blank volume is that of the chapter before. Chapters are shuffled once, by novel.
    """
    window = Window.partitionBy("novel_id").orderBy("sort_order", "id")
    so_far = window.rowsBetween(Window.unboundedPreceding, 0)
    filled = F.coalesce(F.last(F.nullif(F.trim("volume"), F.lit("")), True).over(so_far), F.lit(FIRST_VOLUME))
    placed = chapters.select("novel_id", "sort_order", "id", filled.alias("volume"))
    placed = placed.withColumn("starts", F.coalesce(F.lag("volume").over(window) != F.col("volume"), F.lit(True)).cast("int")).withColumn("run", F.sum("starts").over(so_far))
    own = F.array_sort(F.collect_list(F.struct("sort_order", "id"))).alias("chapters")
    runs = placed.groupBy("novel_id", "run").agg(F.first("volume").alias("volume"), own)
    every = runs.groupBy("novel_id").agg(F.array_sort(F.collect_list(F.struct("run", "volume", "chapters"))).alias("runs"))
    shown = F.transform("runs", lambda r: F.struct(r["volume"].alias("volume"), r["chapters"].alias("chapters")))
    return every.select("novel_id", F.when(F.size("runs") > 1, shown).otherwise(F.slice(shown, 1, 0)).alias("volumes"), F.aggregate("runs", F.lit(0), lambda n, r: n + F.size(r["chapters"])).alias("total"))


def with_children(parents: DataFrame, children: DataFrame, key: str, name: str, *columns: str) -> DataFrame:
    """Each parent with its children in order, an array of structs of ``columns``; an empty one where it has none."""
    own = children.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(name))
    joined = parents.join(own, key, "left")
    none = F.slice(F.array(F.struct(*[F.lit(None).cast(children.schema[c].dataType).alias(c) for c in columns])), 1, 0)
    return joined.withColumn(name, F.coalesce(name, none))


def translated_pages(pages: DataFrame, key: str, strings: list[Column], rebuilt: Callable[[Callable[[Column], Column]], dict[str, Column]], cache: DataFrame, language: str) -> DataFrame:
    """Pages with all their strings in another language, those nested in arrays too.

    ``strings`` are columns of strings or arrays of strings that a page shows; ``rebuilt(say)`` gives its columns anew, with ``say``
    around each string. Only strings of CJK letters that are more than marks and digits are looked up, each distinct
    one once, by hash and language; what the cache lacks stays. Strings that very many pages hold (a category's name) are
    dealt over several tasks.
    """
    if language.startswith("zh"):
        return pages
    every = F.array_distinct(F.concat(*[s if pages.select(s).schema[0].dataType.typeName() == "array" else F.array(s) for s in strings]))
    wanted = pages.select(key, F.explode(F.filter(every, lambda s: s.isNotNull() & text.translatable(s))).alias("said"))
    wanted = wanted.withColumn("source_hash", F.sha2("said", 256))
    known = cache.where(F.col("target_lang") == language).select("source_hash", "translated_text")
    distinct = wanted.select("source_hash").distinct().join(known, "source_hash")
    found = looked_up(wanted, distinct, ["source_hash"]).where(F.col("translated_text").isNotNull())
    own = found.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("said", "translated_text"))).alias("__told"))
    joined = pages.join(own, key, "left")

    def say(value: Column) -> Column:
        return F.coalesce(F.try_element_at(F.col("__told"), value), value)

    columns = rebuilt(say)
    return joined.select(*[columns[c].alias(c) if c in columns else F.col(c) for c in pages.columns])
