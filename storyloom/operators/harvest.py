"""Links of listings over several pages, told apart as novels and chapters (HTM10, SET04)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import html

#: Addresses of a novel and of one of its chapters, and chapters that a summary shows.
NOVEL, CHAPTER = r"/book/(\d+)", r"/book/\d+/\d+\.html"
SHOWN_CHAPTERS = 50


def kind_of(url: Column) -> Column:
    """``chapter`` or ``novel``, by the address; null for neither."""
    return F.when(url.rlike(CHAPTER), "chapter").when(url.rlike(NOVEL), "novel")


def over_pages(pages: DataFrame, container: str, fields: dict[str, dict], pattern: str = NOVEL, key: str = "page_id", by: str = "site", number: str = "page") -> DataFrame:
    """All links of a listing's pages, by its rule, else by their addresses, up to the first empty page after the first.

    ``pages`` have ``by`` and ``number``. Gives ``by``, ``number``, ``position``, ``url``, ``title``, ``kind`` and ``first``: whether
    a novel's link is the first of its book in the listing (chapters all count).
    """
    own = [by, number]
    ruled = html.extract(pages, fields, container=container, key=key, carry=own).where(F.length("url") > 0).select(key, *own, "position", "url", "title", F.lit(True).alias("__ruled"))
    generic = html.harvest_links(pages, pattern, key=key, carry=own).select(key, *own, "position", F.col("href").alias("url"), "title", F.lit(False).alias("__ruled"))
    # Each page has a row without an address, so that empty ones are known.
    bare = pages.select(key, *own, *[F.lit(None).cast(kind).alias(n) for n, kind in (("position", "int"), ("url", "string"), ("title", "string"), ("__ruled", "boolean"))])
    found = ruled.unionByName(generic).unionByName(bare).repartition(by)
    # Links by addresses count only on pages where the rule finds none.
    any_ruled = F.coalesce(F.max("__ruled").over(Window.partitionBy(by, key)), F.lit(False))
    found = found.withColumn("__any", any_ruled).where(F.col("__ruled").isNull() | (F.col("__ruled") == F.col("__any")))
    found = found.withColumn("links", F.count("url").over(Window.partitionBy(by, key)))
    rows = html.first_pages(found, number, "links", by).where(F.col("url").isNotNull()).withColumn("kind", kind_of(F.col("url")))
    place = F.row_number().over(Window.partitionBy(by, "kind", F.regexp_extract("url", NOVEL, 1)).orderBy(number, "position"))
    return rows.select(by, number, "position", "url", "title", "kind", ((F.col("kind") == "chapter") | (place == 1)).alias("first"))
