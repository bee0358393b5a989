"""Filters, searches, sorted pages and their envelopes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Columns by which novels may be sorted; another falls back to the last.
SORTABLE = ("title", "total_chapters", "status", "updated_at")
PAGE_SIZE, SITE_PAGE_SIZE = 20, 24
SHORT_QUERY = 2


def contains_text(text: str, *columns: str) -> Column:
    """Case-insensitive containment in any of the columns; ``%`` and ``_`` stand for themselves."""
    literal = text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    found = F.lit(False)
    for c in columns:
        found = found | F.coalesce(F.col(c).ilike(f"%{literal}%"), F.lit(False))
    return found


def sort_key(column: str, direction: str) -> Column:
    name = column if column in SORTABLE else SORTABLE[-1]
    return F.col(name).asc() if direction == "asc" else F.col(name).desc()


def filtered(
    novels: DataFrame, search: str | None = None, status: str | None = None, members: DataFrame | None = None, category: str | DataFrame | None = None
) -> DataFrame:
    """The novels that meet all given conditions; one that is None or empty does not count.

    ``members`` is the bridge of novels and categories: a category is a semi-join on it, so a
    novel comes once however many rows link it. It may be the one row of a table too.
    """
    if search:
        novels = novels.where(contains_text(search, "title", "author"))
    if status:
        novels = novels.where(F.col("status") == status)
    if category is not None and category != "" and members is not None:
        if isinstance(category, str):
            members = members.where(F.col("category") == category)
        else:
            members = members.join(F.broadcast(category.limit(1)), "category", "left_semi")
        inside = members.select(F.col("novel_id").alias("id"))
        novels = novels.join(inside, "id", "left_semi")
    return novels


def page_of(rows: DataFrame, order: Sequence[Column], page: int = 1, size: int = PAGE_SIZE, shift: int = 0) -> DataFrame:
    """One page in a total order. Spark plans it as a top-k of ``shift + page * size`` rows."""
    return rows.orderBy(*order).offset(shift + (page - 1) * size).limit(size)


def shifted_page(rows: DataFrame, order: Sequence[Column], page: int, size: int, one: DataFrame, shift: str, most: int = 10_000) -> DataFrame:
    """A page behind as many rows as a one-row table says, ``most`` at the utmost: a top-k, then the page's rows, in one plan."""
    from ..sources.catalog import beside

    first = beside(rows.orderBy(*order).limit(most + page * size), one)
    place = F.row_number().over(Window.orderBy(*order))
    start = F.least(F.col(shift), F.lit(most)) + (page - 1) * size
    return first.withColumn("__place", place).where((F.col("__place") > start) & (F.col("__place") <= start + size)).orderBy("__place").drop("__place", shift)


def envelope(rows: DataFrame, page: int, size: int, least_pages: int = 1) -> DataFrame:
    """``total``, ``page``, ``size`` and ``pages`` of a listing, in one row."""
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    pages = F.greatest(F.lit(least_pages), F.ceil(F.col("total") / F.lit(size))).cast("long")
    return total.select("total", F.lit(page).alias("page"), F.lit(size).alias("size"), pages.alias("pages"))


def search_titles(rows: DataFrame, text: str, *columns: str) -> DataFrame:
    """As the public search does: fewer than two characters find nothing."""
    text = text.strip()
    return rows.limit(0) if len(text) < SHORT_QUERY else rows.where(contains_text(text, *columns))


def in_scope(column: str, scope: str | int) -> Column:
    """Rows of a scope, and those of no scope at all (null or empty)."""
    text = F.col(column).cast("string")
    return F.col(column).isNull() | (text == "") | (text == str(scope))


def scope_choice(rows: DataFrame, column: str, choice: str | int | None) -> DataFrame:
    """All rows, only global ones (``'global'``: null or empty), or those of one scope."""
    if choice is None:
        return rows
    return rows.where(missing(column)) if choice == "global" else rows.where(F.col(column) == choice)


def missing(column: str) -> Column:
    return F.col(column).isNull() | (F.col(column).cast("string") == "")


def contains_any(words: Sequence[str], *columns: str) -> Column:
    """Whether any word stands in any column, in one pass over each."""
    found = F.lit(False)
    for c in columns:
        for w in words:
            found = found | F.coalesce(F.col(c).contains(w), F.lit(False))
    return found


def random_sample(rows: DataFrame, size: int, seed: int = 7) -> DataFrame:
    """``size`` rows at random, by a top-k on a random number."""
    return rows.orderBy(F.rand(seed)).limit(size)


def empty_chapter() -> Column:
    """Whether a chapter has neither a text nor a file, but an address to fetch it from."""
    return F.col("content").isNull() & F.col("content_file").isNull() & F.col("source_url").isNotNull()


def recommended(novels: DataFrame, chapters: DataFrame, size: int = 5, seed: int = 7) -> DataFrame:
    """For each novel, ``size`` others with a cover, drawn by a seed, each with its latest chapter (``-`` if it has none).

    One more than ``size`` are drawn for all, so that each novel can leave itself out: the draw is a top-k, and goes
    to every novel by a broadcast of ``size + 1`` rows.
    """
    from .windows import first_per_key

    dice = F.md5(F.concat(F.col("id").cast("string"), F.lit(f":{seed}")))
    drawn = novels.where(~missing("cover")).select("id", "title", dice.alias("dice")).orderBy("dice").limit(size + 1)
    own = chapters.join(F.broadcast(drawn.select(F.col("id").alias("novel_id"))), "novel_id", "left_semi")
    last = first_per_key(own, "novel_id", [F.desc("sort_order"), F.desc("id")]).select("novel_id", F.col("id").cast("string").alias("chapter"))
    full = drawn.join(last, F.col("id") == F.col("novel_id"), "left").agg(
        F.array_sort(F.collect_list(F.struct("dice", "id", "title", F.coalesce("chapter", F.lit("-")).alias("chapter")))).alias("all")
    )
    rows = novels.select(F.col("id").alias("reader_of"), F.lit(1).alias("__one")).join(F.broadcast(full.withColumn("__one", F.lit(1))), "__one")
    others = F.slice(F.filter("all", lambda b: b["id"] != F.col("reader_of")), 1, size)
    return rows.select("reader_of", F.explode(others).alias("book")).select("reader_of", "book.id", "book.title", "book.chapter")
