"""Writes as joins: each gives the table as it is after the change."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions import text


def update_ignoring_null(rows: DataFrame, changes: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Replaces what the change sets; a null in it leaves the old value."""
    new = changes.select(key, *[F.col(c).alias(f"__new_{c}") for c in columns])
    joined = rows.join(new, key, "left")
    return joined.select(*[F.coalesce(f"__new_{c}", c).alias(c) if c in columns else F.col(c) for c in rows.columns])


def fill_missing(rows: DataFrame, found: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Upsert: values fill what is null or empty in known rows; unknown keys are added."""
    new = found.select(key, *[F.col(c).alias(f"__new_{c}") for c in columns])
    joined = rows.join(new, key, "full_outer")
    old = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.col(f"__new_{c}"), F.col(c)).alias(c)
    return joined.select(*[old(c) if c in columns else F.col(c) for c in rows.columns])


def insert_absent(rows: DataFrame, found: DataFrame, key: str) -> DataFrame:
    added = found.join(rows.select(key), key, "left_anti")
    return rows.unionByName(added, allowMissingColumns=True)


def append_chapters(chapters: DataFrame, new: DataFrame) -> DataFrame:
    """New chapters of valid title, numbered after the last one of their novel in order of ``position``."""
    last = chapters.groupBy("novel_id").agg(F.max("sort_order").alias("__last"))
    # A row for each novel is no small table; sorted by novel, the join shares the shuffle of the numbers.
    good = new.where(text.valid_title(F.col("title"))).join(last.hint("merge"), "novel_id", "left")
    number = F.row_number().over(Window.partitionBy("novel_id").orderBy("position"))
    return good.withColumn("sort_order", F.coalesce("__last", F.lit(0)) + number).withColumn(
        "word_count", text.count_words(F.col("content"))
    ).drop("__last", "position")


def reorder(chapters: DataFrame, orders: DataFrame, key: str = "id") -> DataFrame:
    return update_ignoring_null(chapters, orders, key, ["sort_order"])


def delete(rows: DataFrame, gone: DataFrame, key: str, keep: Column | None = None) -> DataFrame:
    """Without the rows listed, but for those that ``keep`` holds for."""
    listed = gone.select(key).distinct().withColumn("__gone", F.lit(True))
    held = F.lit(False) if keep is None else F.coalesce(keep, F.lit(False))
    return rows.join(listed, key, "left").where(F.col("__gone").isNull() | held).drop("__gone")


def deleted(rows: DataFrame, gone: DataFrame, key: str, scope: Column) -> DataFrame:
    """The rows that a list of keys removes inside a scope: what a delete by list counts."""
    return rows.where(F.coalesce(scope, F.lit(False))).join(gone.select(key).distinct(), key, "left_semi")


def upsert_last(rows: DataFrame, messages: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Each key's last message by ``order`` replaces its row or adds it; rows without a message stay."""
    columns = [c for c in rows.columns if c != key]
    last = messages.groupBy(key).agg(F.max(F.struct(*order, *columns)).alias("__last")).select(key, *[F.col(f"__last.{c}").alias(c) for c in columns])
    return rows.join(last, key, "left_anti").unionByName(last)


def sweep(locks: DataFrame, now: Column) -> DataFrame:
    """Frees the locks whose time is over; ``swept`` tells which."""
    over = F.coalesce(F.unix_timestamp(now) - F.unix_timestamp("locked_at") > F.col("ttl"), F.lit(True))
    held = F.coalesce(F.col("owner") != "", F.lit(False))
    return locks.withColumn("swept", held & over).withColumn("owner", F.when(~F.col("swept"), F.col("owner")))


def reset_stuck(tasks: DataFrame, now: Column, seconds: int = 600) -> DataFrame:
    """Running tasks that began before the cutoff wait again."""
    stuck = (F.col("status") == "running") & (F.col("created_at") < now - F.make_dt_interval(secs=F.lit(seconds)))
    return tasks.withColumn("was_stuck", stuck).withColumn("status", F.when(stuck, "pending").otherwise(F.col("status")))


def lease(locks: DataFrame, owner: str, now: Column) -> DataFrame:
    """A lock is taken if it is free, its time is unknown, or its time is over."""
    age = F.unix_timestamp(now) - F.unix_timestamp("locked_at")
    free = F.col("owner").isNull() | (F.col("owner") == "") | F.col("locked_at").isNull() | (age > F.col("ttl"))
    return locks.withColumn("taken", free).withColumn("owner", F.when(free, F.lit(owner)).otherwise(F.col("owner"))).withColumn(
        "locked_at", F.when(free, now).otherwise(F.col("locked_at"))
    )


def claim(tasks: DataFrame, size: int) -> DataFrame:
    """The oldest waiting tasks, now running."""
    return tasks.where(F.col("status") == "pending").orderBy("created_at", "id").limit(size).withColumn("status", F.lit("running"))


def recount(novels: DataFrame, chapters: DataFrame) -> DataFrame:
    counts = chapters.groupBy(F.col("novel_id").alias("id")).agg(F.count(F.lit(1)).alias("__n"))
    return novels.drop("total_chapters").join(counts, "id", "left").withColumn("total_chapters", F.coalesce("__n", F.lit(0))).drop("__n")


def update_content(chapters: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """New texts; words are counted again where a text differs from the old one."""
    new = changes.select(key, F.col("content").alias("__new"))
    changed = F.col("__new").isNotNull() & ~F.col("__new").eqNullSafe(F.col("content"))
    joined = chapters.join(new, key, "left")
    values = {
        "content": F.when(changed, F.col("__new")).otherwise(F.col("content")).alias("content"),
        "word_count": F.when(changed, text.count_words(F.col("__new"))).otherwise(F.col("word_count")).alias("word_count"),
    }
    return joined.select(*[values.get(c, F.col(c)) for c in chapters.columns])


def correct_titles(rows: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Takes a title found for a row if it holds CJK and differs; tells which rows were ``corrected``."""
    joined = rows.join(found.select(key, F.col("title").alias("__new")), key, "left")
    better = F.coalesce(text.has_cjk(F.col("__new")) & (F.col("__new") != F.col("title")), F.lit(False))
    kept = [F.when(better, F.col("__new")).otherwise(F.col(c)).alias(c) if c == "title" else F.col(c) for c in rows.columns]
    return joined.select(*kept, better.alias("corrected"))


def drop_script_links(rows: DataFrame, url: str) -> DataFrame:
    return rows.withColumn(url, F.when(~F.col(url).startswith("javascript:"), F.col(url)))


def _times(condition: Column, name: str) -> Column:
    return F.coalesce(F.sum(F.coalesce(condition, F.lit(False)).cast("long")), F.lit(0)).alias(name)


def delete_counted(rows: DataFrame, gone: DataFrame, key: str, keep: Column) -> tuple[DataFrame, Observation]:
    """``delete``, and how many rows it ``deleted`` and how many listed ones it ``skipped``: told by the pass that writes the rest."""
    listed = gone.select(key).distinct().withColumn("__gone", F.lit(True))
    met = rows.join(listed, key, "left").withColumn("__held", F.coalesce(keep, F.lit(False)))
    told = Observation()
    there = F.col("__gone").isNotNull()
    left = met.observe(told, _times(there & ~F.col("__held"), "deleted"), _times(there & F.col("__held"), "skipped"))
    return left.where(F.col("__gone").isNull() | F.col("__held")).drop("__gone", "__held"), told


def insert_and_enqueue(rows: DataFrame, found: DataFrame, key: str) -> tuple[DataFrame, Observation]:
    """Inserts what is found and absent, the first of each key, and asks for a task for each row found, known or not.

    Gives one table of ``kind`` (``row`` or ``task``) and the columns of ``rows``, and the numbers that are ``inserted`` and
    ``enqueued``, told by the pass that writes it. ``key`` is kept for tasks; their other columns are null.
    """
    known = rows.select(key).distinct().withColumn("__known", F.lit(True))
    place = Window.partitionBy(key).orderBy(*[c for c in found.columns if c != key])
    met = found.withColumn("__n", F.row_number().over(place)).join(known, key, "left")
    new = F.col("__known").isNull() & (F.col("__n") == 1)
    told = Observation()
    made = met.withColumn("kind", F.explode(F.when(new, F.array(F.lit("row"), F.lit("task"))).otherwise(F.array(F.lit("task")))))
    made = made.observe(told, _times(F.col("kind") == "row", "inserted"), _times(F.col("kind") == "task", "enqueued"))
    only = [F.col(c) if c == key else F.when(F.col("kind") == "row", F.col(c)).alias(c) for c in rows.columns]
    return made.select("kind", *only), told


def cascade(parents: DataFrame, children: DataFrame, gone: DataFrame, key: str, parent: str) -> tuple[DataFrame, DataFrame]:
    """Parents and children that are left once some parents and all of theirs are gone."""
    listed = gone.select(F.col(key).alias("__gone")).distinct()
    return parents.join(listed, F.col(key) == F.col("__gone"), "left_anti"), children.join(listed, F.col(parent) == F.col("__gone"), "left_anti")
