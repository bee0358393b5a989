"""What a crawl makes of pages: novels, search results, listings, covers, catalogs, chapters, and tests of rules.

Fields come out of the pages in one pass; cascades, joins and numbers are columns after that.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numbers, text
from . import html, merge

#: States of a novel as pages name them, and the prefix of an author's link.
PAGE_STATES = {"连载": "ongoing", "完结": "completed", "完本": "completed"}
FIRST_STATE = "连载"
AUTHOR_PREFIX = "作者："
#: Where a cover is looked for, after ``og:image``.
COVER_SELECTORS = (".module-item-pic img", ".novel-cover img", ".book-cover img", "img[src*='cover']", "img[src*='image']")
STAND_IN = "loading.gif"
#: Rows that a dry run shows, and characters that a tested chapter must have.
SHOWN, LEAST_CHAPTER = 20, 50
BOOK_ID = r"/book/(\d+)"


def _first(*values: Column) -> Column:
    """The first that is neither null nor empty; an empty one if there is none."""
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values], F.lit(""))


def joined(left: DataFrame, right: DataFrame, on: str | Sequence[str], how: str) -> DataFrame:
    """A join of rows that grow with the pages, by sorted shuffles. Pages, texts and what is known of them are made inside the
    plan: Spark judges their size by their files' bytes, far below it, and would send all of them through the driver."""
    return left.join(right.hint("merge"), on, how)


def novel_info(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """The nine fields of a novel's page, each from the first place that has it."""
    meta = {k: {"selectors": [f'meta[property="{p}"]'], "attr": "content"} for k, p in {
        "book_name": "og:novel:book_name", "og_title": "og:title", "og_author": "og:novel:author", "og_text": "og:description",
        "text": "description", "image": "og:image", "state": "og:novel:status", "tags": "og:novel:tags",
    }.items()}
    meta["image"]["absolute"] = True
    fields = meta | {
        "heading": {"selectors": ["h1.page-title"]},
        "by": {"selectors": [".novel-info-aux a[title]"], "attr": "title"},
        "category_name": {"selectors": [".novel-info-aux a[href*='/book/lastupdate']"]},
        "words": {"selectors": ["span.tag-link"], "must": "万字"},
    }
    found = html.extract(pages, fields, key=key, carry=["url"])
    by = F.when(F.col("by").startswith(AUTHOR_PREFIX), F.substr("by", F.lit(len(AUTHOR_PREFIX) + 1)))
    state = F.coalesce("state", F.lit(FIRST_STATE))
    states = F.create_map(*[F.lit(x) for pair in PAGE_STATES.items() for x in pair])
    return found.select(
        key,
        text.collapse(_first(F.col("book_name"), F.col("og_title"), F.col("heading"))).alias("title"),
        text.collapse(_first(F.col("og_author"), by)).alias("author"),
        text.collapse(text.breaks_to_lines(_first(F.col("og_text"), F.col("text")))).alias("description"),
        _first(F.col("image")).alias("cover_url"),
        F.coalesce(states[state], F.lit("ongoing")).alias("status"),
        _first(F.col("category_name")).alias("category_name"),
        _first(F.col("tags")).alias("tags"),
        F.coalesce(numbers.parse_magnitude(F.col("words")), F.lit(0)).alias("word_count"),
        F.regexp_extract("url", BOOK_ID, 1).alias("book_id"),
    )


def after_title(whole: Column, title: Column, author: Column) -> Column:
    """What stands behind the title in a result's text, without the author in front and dots around it."""
    rest = F.when(title != "", F.when(F.instr(whole, title) > 0, text.strip(F.substr(whole, F.instr(whole, title) + F.length(title)))).otherwise(F.lit("")))
    rest = F.coalesce(rest, F.lit(""))
    bare = F.btrim(F.substr(rest, F.length(author) + 1), F.lit(" ."))
    return text.collapse(F.when((author != "") & rest.startswith(author), bare).otherwise(rest))


def search_results(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """Rows of a search page: results of three links or more, of which the third is the title's."""
    fields = {
        "title": {"selectors": ["a"], "nth": 2},
        "url": {"selectors": ["a"], "nth": 2, "attr": "href", "absolute": True},
        "whole": {"selectors": ["&"]},
    }
    rows = html.extract(pages, fields, container=".module-search-item", key=key).where(F.col("url").isNotNull())
    title, whole = text.collapse(F.coalesce("title", F.lit(""))), F.coalesce("whole", F.lit(""))
    parts = F.split(whole, r"\.")
    author = F.when(F.size(parts) >= 3, text.strip(F.get(parts, F.lit(2)))).otherwise(F.lit(""))
    return rows.select(
        key, "position", title.alias("title"), author.alias("author"), "url", F.regexp_extract("url", BOOK_ID, 1).alias("book_id"),
        after_title(whole, title, author).alias("description"),
    )


def category_listing(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """Rows of a category page; items without a link to a book are none."""
    fields = {
        "url": {"selectors": ["a[href*='/book/']"], "attr": "href", "absolute": True},
        "title": {"selectors": [".module-item-title"]},
        "author": {"selectors": [".module-item-text"]},
        "cover_url": {"selectors": ["img"], "attr": "data-src", "absolute": True},
    }
    rows = html.extract(pages, fields, container=".module-item", key=key).where(F.col("url").isNotNull())
    shown = [F.coalesce(c, F.lit("")).alias(c) for c in ("title", "author", "cover_url")]
    return rows.select(key, "position", "url", F.regexp_extract("url", BOOK_ID, 1).alias("book_id"), *shown)


def covers(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """The address of a page's cover: ``og:image``, else the first picture of each place in turn, but for stand-ins."""
    fields: dict[str, dict] = {"og": {"selectors": ['meta[property="og:image"]'], "attr": "content"}}
    for k, selector in enumerate(COVER_SELECTORS):
        fields |= {f"src{k}": {"selectors": [selector], "attr": "src", "nth": 0, "absolute": True}, f"late{k}": {"selectors": [selector], "attr": "data-src", "nth": 0, "absolute": True}}
    found = html.extract(pages, fields, key=key)
    shown = [F.coalesce(F.nullif(F.col(f"src{k}"), F.lit("")), F.col(f"late{k}")) for k in range(len(COVER_SELECTORS))]
    return found.select(key, F.coalesce(F.nullif("og", F.lit("")), *[F.when(~s.endswith(STAND_IN), s) for s in shown]).alias("cover_url"))


def harvest_by_rule(pages: DataFrame, catalog: dict, search: dict, key: str = "page_id") -> DataFrame:
    """Rows by a rule's catalog section; for pages where it finds none, by its search section.

    A section has a ``container`` and ``fields``, among them ``url``; the first row of each address stays.
    """
    rows = html.extract_sections(pages, {"catalog": catalog, "search": search}, key=key).where(F.length("url") > 0)
    first = F.row_number().over(Window.partitionBy(key, "section", "url").orderBy("position"))
    listed = F.max(F.col("section") == "catalog").over(Window.partitionBy(key))
    rows = rows.withColumn("__first", first).withColumn("__listed", listed).where("__first = 1 AND (section = 'catalog' OR NOT __listed)")
    names = list(dict.fromkeys([*catalog["fields"], *search["fields"]]))
    return rows.select(key, "position", *names, "section")


def section_url(pattern: str, **values: Column) -> Column:
    """A section's address with ``{keyword}``, ``{book_id}`` and the like filled in."""
    return text.fill(F.lit(pattern), values)


def dry_run(wanted: DataFrame, pages: DataFrame, section: dict, key: str = "page_id", shown: int = SHOWN) -> DataFrame:
    """Tries a rule's section on the pages at the addresses ``url`` of ``wanted``: a row for each address, with its first rows."""
    found = joined(wanted.select("url").distinct(), pages.select("url", key, "html"), "url", "left")
    # Addresses without a page are read as empty pages, each spread by itself, so that pages are fetched by one join.
    found = found.withColumn("__page", F.struct("url", F.col(key).alias("key"))).withColumn("__read", F.col("html").isNotNull())
    rows = html.extract_sections(found, {"": section}, key="__page", carry=["__read"], empty=bool(section.get("container")))
    row = F.when(F.col("__read"), F.col("position"))
    nested = F.array_sort(F.collect_list(F.when(row < shown, F.struct("position", *section["fields"]))))
    made = rows.groupBy("__page").agg(F.max("__read").alias("read"), F.count(row).alias("rows"), nested.alias("shown"))
    fetched = F.col("read") | F.col("__page.key").isNotNull()
    return made.select("__page.url", fetched.alias("fetched"), "rows", F.when(F.col("rows") > 0, F.col("shown")).alias("shown"))


def catalogs(pages: DataFrame, header: str, item: str, key: str = "page_id") -> DataFrame:
    """Chapters of catalog pages in order, each with its place in its page from 1."""
    rows = html.catalog_rows(pages, header, item, key)
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy("position")))


def chapters(catalog: DataFrame, pages: DataFrame, container: str, key: str = "page_id") -> DataFrame:
    """A catalog's chapters with their cleaned texts, by the pages at their addresses; null where there is no page."""
    at = html.body_text(pages, container, key=key, carry=["url"]).select("url", text.clean_content(F.col("body")).alias("content"))
    return joined(catalog, at, "url", "left")


def self_test(catalog: DataFrame, pages: DataFrame, container: str, key: str = "page_id") -> DataFrame:
    """Of each catalog page: chapters found, whether the first one's text is long enough, and so whether it passes."""
    first = [F.max(F.when(F.col("place") == 1, F.col(c))).alias(c) for c in ("title", "url")]
    counts = catalog.groupBy(key).agg(F.count(F.lit(1)).alias("chapter_count"), *first)
    # Only the pages of first chapters are read; a catalog whose page is missing has a row all the same.
    own = pages.select("url", F.col(key).alias("__of"), "html", F.lit(True).alias("__there"))
    found = joined(counts, own, "url", "left").withColumn("__page", F.struct(key, "__of"))
    told = html.body_text(found, container, key="__page", carry=["chapter_count", "title", "__there"])
    size = F.when(F.col("__there"), F.length(text.clean_content(F.col("body"))))
    told = told.select(f"__page.{key}", "chapter_count", F.col("title").alias("chapter_title"), F.coalesce(size, F.lit(0)).alias("content_length"))
    return told.withColumn("passed", F.col("content_length") >= LEAST_CHAPTER)


def crawl(catalog: DataFrame, pages: DataFrame, known: DataFrame, container: str, novel: str = "novel_id", key: str = "page_id") -> DataFrame:
    """New chapters of novels: what a catalog lists and the table lacks, fetched, cleaned and numbered after the last.

    ``catalog`` has the novel's id; ``known`` holds ``novel_id``, ``url``, ``title`` and ``sort_order``.
    """
    listed = catalog.select(F.col(novel).alias("novel_id"), "url", "title", "place", key)
    own = known.select("novel_id", "url", "title", F.col("sort_order").alias("place"))
    new = joined(listed, own.where(F.col("url").isNotNull()).select("novel_id", "url"), ["novel_id", "url"], "left_anti")
    new = joined(new, own.where(F.col("title").isNotNull()).select("novel_id", "title", "place"), ["novel_id", "title", "place"], "left_anti")
    fetched = chapters(new, pages, container, key).where(F.length("content") > 0).withColumn("position", F.col("place"))
    titled = fetched.withColumn("title", text.clean_chapter_title(F.col("title")))
    return merge.append_chapters(known, titled).select("novel_id", "url", "title", "sort_order", "word_count", "content")


def noise_title(title: Column, markers: Sequence[str], under: int = 20) -> Column:
    """Whether a short title holds a marker of an error or a site's own name."""
    found = F.lit(False)
    for m in markers:
        found = found | title.contains(m)
    return F.coalesce(found & (F.length(title) < under), F.lit(False))


def by_rule(found: DataFrame, novels: DataFrame, known: DataFrame) -> DataFrame:
    """A crawl from what ``rules.apply`` read: new chapters, with the facts of their novels.

    ``found`` has ``novel_id``, ``page_url``, ``section``, ``position`` and ``fields``; ``novels`` has ``novel_id`` and a ``title``
    that is kept where it is set; ``known`` holds ``novel_id``, ``url``, ``title`` and ``sort_order`` of stored chapters.
    """
    fields = F.col("fields")
    # One pass: what was read of a novel stays together, a catalog's row beside the chapter at its address.
    link = F.when(F.col("section") == "chapter", F.col("page_url")).when(F.col("section") == "catalog", fields["url"])
    content = F.max(F.when(F.col("section") == "chapter", fields["content"])).over(Window.partitionBy("novel_id", "link"))
    facts = F.max(F.when(F.col("section") == "novel_info", F.struct(*[fields[f].alias(f) for f in ("title", "author", "cover")]))).over(Window.partitionBy("novel_id"))
    together = found.withColumn("link", link).repartition("novel_id").withColumn("content", content).withColumn("facts", facts)
    listed = together.where("section = 'catalog'").select("novel_id", F.col("link").alias("url"), fields["title"].alias("title"), (F.col("position") + 1).alias("place"), "content", "facts")
    new = joined(listed.where((F.col("url") != "") & (F.length("content") > 0)), known.where(F.col("url").isNotNull()).select("novel_id", "url"), ["novel_id", "url"], "left_anti")
    new = joined(new, known.where(F.col("title").isNotNull()).select("novel_id", "title", F.col("sort_order").alias("place")), ["novel_id", "title", "place"], "left_anti")
    titled = new.withColumn("position", F.col("place")).withColumn("title", text.clean_chapter_title(F.col("title")))
    added = joined(merge.append_chapters(known, titled), novels.select("novel_id", F.col("title").alias("__own")), "novel_id", "inner")
    return added.withColumn("novel", _first(F.col("__own"), F.col("facts.title"))).select("*", "facts.author", "facts.cover").drop("__own", "facts")
