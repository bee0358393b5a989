"""Which links a page shows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from .windows import first_per_key

#: Pages that carry links by default, the novel address, and the name of an unknown novel.
DEFAULT_PAGES = ("novel_detail", "chapter_read")
NOVEL_PATTERN = "/novel/{id}/"
UNKNOWN_NOVEL = "未知书名"


def _open_to(column: str, value) -> Column:
    """Rows whose column is null or empty, which stands for any value, or has this one; no value is asked for by None."""
    if value is None:
        return F.lit(True)
    text_of = F.col(column).cast("string")
    return F.coalesce((text_of == "") | (text_of == str(value)), F.lit(True))


def resolve(rings: DataFrame, targets: DataFrame, sites: DataFrame, novels: DataFrame, site_id: int, page: str, most: int = 8, novel_id: int | None = None) -> DataFrame:
    """The links of a page of one site: each ring's first targets that apply, one of each address, in order.

    A target without a source site or novel applies to all. An inactive target never counts. Rings
    and targets may leave out what they do not set: ``source_novel_id``, ``target_url``, the
    target's ``anchor_text``, and a site's ``novel_pattern``.
    """
    def optional(table: DataFrame, *columns: str) -> DataFrame:
        return table.select("*", *[F.lit(None).cast("string").alias(c) for c in columns if c not in table.columns])

    targets = optional(targets, "source_novel_id", "target_url", "anchor_text").withColumnRenamed("anchor_text", "own_anchor")
    sites = optional(sites, "novel_pattern")
    shown = F.array_contains(F.coalesce("on_pages", F.array(*map(F.lit, DEFAULT_PAGES))), page)
    applies = F.col("is_active") & _open_to("source_site_id", site_id) & _open_to("source_novel_id", novel_id)
    inside = rings.where(shown).join(targets.where(applies), "ring_id")
    place = F.row_number().over(Window.partitionBy("ring_id").orderBy("target_id"))
    chosen = inside.withColumn("place", place).where(F.col("place") <= F.col("max_links"))
    known_sites = sites.select(F.col("id").alias("target_site_id"), "domain", F.col("name").alias("site_name"), "novel_pattern")
    # Few targets are chosen; only their novels are looked up, where they are.
    wanted = F.broadcast(chosen.select("target_novel_id").distinct())
    known_novels = novels.select(F.col("id").alias("target_novel_id"), F.lit(True).alias("known"), "title", "author").join(wanted, "target_novel_id", "left_semi")
    full = chosen.join(known_sites, "target_site_id", "left").join(known_novels, "target_novel_id", "left")
    base = F.coalesce(F.concat(F.lit("http://"), F.col("domain")), F.lit(""))
    values = {
        "title": F.when(F.col("known"), F.col("title")).otherwise(F.lit(UNKNOWN_NOVEL)),
        "author": F.col("author"),
        "site_name": F.col("site_name"),
    }
    pattern = F.coalesce("novel_pattern", F.lit(NOVEL_PATTERN))
    address = F.coalesce(F.nullif("target_url", F.lit("")), F.when(F.col("target_novel_id").isNotNull(), F.concat(base, text.fill(pattern, {"id": F.col("target_novel_id")}))))
    form = F.coalesce(F.nullif("own_anchor", F.lit("")), F.nullif("link_format", F.lit("")), F.lit("{title}"))
    made = full.withColumn("url", address).where(F.length("url") > 0).withColumn(
        "anchor_text", F.coalesce(F.nullif(text.anchor(form, values), F.lit("")), F.col("ring_name"))
    )
    order = [F.asc("ring_id"), F.asc("place")]
    return first_per_key(made, "url", order).orderBy(*order).limit(most).select("ring_name", "place", "url", "anchor_text")


def resolve_or_hot(rings: DataFrame, targets: DataFrame, sites: DataFrame, novels: DataFrame, site_id: int, page: str, most: int = 8, novel_id: int | None = None) -> DataFrame:
    """The links of a page, or, if no ring has an active target at all, the novels of the hot ranking: in one plan."""
    any_active = targets.where("is_active").join(rings.select("ring_id"), "ring_id", "left_semi").limit(1).select(F.lit(1).alias("__any"))
    place = F.row_number().over(Window.orderBy(F.desc("total_chapters"), F.asc("id")))
    hot = hot_ranking(novels, most).select(
        F.lit("").alias("ring_name"), place.alias("place"), F.concat(F.lit("/novel/"), F.col("id").cast("string")).alias("url"), F.col("title").alias("anchor_text"), F.lit(1).alias("__any")
    )
    fallback = hot.join(F.broadcast(any_active), "__any", "left_anti").drop("__any")
    return resolve(rings, targets, sites, novels, site_id, page, most, novel_id).unionByName(fallback)


def hot_ranking(novels: DataFrame, most: int) -> DataFrame:
    return novels.orderBy(F.desc("total_chapters"), F.asc("id")).limit(most)
