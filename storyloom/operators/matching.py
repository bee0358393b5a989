"""Scores of candidates and categories, and joins that tell new rows from known ones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .windows import first_per_key

#: Words that a category and a name may share, and what each kind of match scores.
GENRE_WORDS = (
    "言情", "都市", "唯美", "耽美", "百合", "穿越", "青春", "玄幻", "武侠", "军事", "竞技", "科幻", "悬疑", "同人", "职场",
    "修真", "历史", "游戏", "空间", "惊悚", "官场", "魔法",
)
CATEGORY_IN_NAME, NAME_IN_CATEGORY, SHARED_WORD, LEAST_CATEGORY = 10, 5, 3, 3
#: Fixed value: how many characters of a string are looked up in those that may hold it.
KEY = 16
#: A key of a greater share of all rows than one in so many is dealt over several tasks.
HOT_KEYS = 1024
SAME_TITLE, PART_TITLE, SAME_AUTHOR, PART_AUTHOR, LEAST_MATCH = 50, 30, 40, 20, 30


def _within(a: Column, b: Column) -> Column:
    return (a != "") & (b != "") & (b.contains(a) | a.contains(b))


def match_score(title: Column, author: Column, other_title: Column, other_author: Column) -> Column:
    """How well two titles and authors agree; empty ones agree with nothing."""
    by_title = F.when((title == other_title) & (title != ""), SAME_TITLE).when(_within(title, other_title), PART_TITLE).otherwise(0)
    by_author = F.when((author == other_author) & (author != ""), SAME_AUTHOR).when(_within(author, other_author), PART_AUTHOR).otherwise(0)
    return F.coalesce(by_title, F.lit(0)) + F.coalesce(by_author, F.lit(0))


def category_score(name: Column, category: Column, words: Sequence[str] = GENRE_WORDS) -> Column:
    shared = F.lit(0)
    for w in words:
        shared = shared + F.when(category.contains(w) & name.contains(w), SHARED_WORD).otherwise(0)
    return F.when(name.contains(category), CATEGORY_IN_NAME).otherwise(0) + F.when(category.contains(name), NAME_IN_CATEGORY).otherwise(0) + shared


def best_category(names: DataFrame, name: str, categories: Sequence[str], words: Sequence[str] = GENRE_WORDS) -> DataFrame:
    """The category of greatest score for each name, the first of equals; none below the least score.

    Categories are a parameter, so each name carries its few scores along: no join is needed.
    """
    scored = F.array(*[F.struct(category_score(F.col(name), F.lit(c), words).alias("score"), F.lit(-k).alias("rank"), F.lit(c).alias("category")) for k, c in enumerate(categories)])
    best = F.array_max(scored)
    return names.withColumn("__best", best).select(
        *names.columns,
        F.when(F.col("__best.score") >= LEAST_CATEGORY, F.col("__best.category")).alias("category"),
        F.col("__best.score").alias("score"),
    )


def _contained(short: DataFrame, inner: str, long: DataFrame, outer: str) -> DataFrame:
    """Pairs of which the one string holds the other: keyed by the inner one's first characters, then compared whole."""
    pieces = F.flatten(
        F.transform(
            F.sequence(F.lit(1), F.length(outer)),
            lambda at: F.transform(F.sequence(F.lit(1), F.least(F.lit(KEY), F.length(outer) - at + 1)), lambda n: F.substr(F.col(outer), at, n)),
        )
    )
    keyed = long.where(F.col(outer) != "").select(outer, F.explode(F.array_distinct(pieces)).alias("__key"))
    starts = short.where(F.col(inner) != "").select(inner, F.left(inner, F.lit(KEY)).alias("__key"))
    return keyed.join(starts, "__key").where(F.col(outer).contains(F.col(inner))).drop("__key")


def _related(wanted: DataFrame, found: DataFrame, name: str) -> DataFrame:
    """Distinct strings of both sides of which one is, or holds, the other."""
    ours, theirs = wanted.select(name).distinct(), found.select(f"found_{name}").distinct()
    within = _contained(ours, name, theirs, f"found_{name}").unionByName(_contained(theirs, f"found_{name}", ours, name))
    return within.distinct()


def best_matches(wanted: DataFrame, found: DataFrame, size: int = 1) -> DataFrame:
    """For each wanted ``id``, the best ``size`` of all candidates, by score and then ``position``.

    Only what agrees in title or has the same author can reach the least score, so nothing else is
    paired. Of candidates that score at least as well as a later one in the same group (one title,
    one author, or both), only the first ``size`` can be among the best; equal titles and authors
    are scored once.
    """
    ours = wanted.select("id", *[F.coalesce(c, F.lit("")).alias(c) for c in ("title", "author")])
    theirs = found.select("position", *[F.coalesce(c, F.lit("")).alias(c) for c in ("found_title", "found_author")])
    pairs = ours.select("title", "author").distinct()
    kept = first_per_key(theirs, ["found_title", "found_author"], [F.asc("position")], size)
    of_title, of_author = (first_per_key(kept, c, [F.asc("position")], size) for c in ("found_title", "found_author"))
    titles, authors = _related(pairs, kept, "title"), _related(pairs, kept, "author")
    alike = pairs.join(titles, "title")
    columns = ("title", "author", "position", "found_title", "found_author")
    chosen = (
        alike.join(of_title, "found_title").select(*columns)
        .unionByName(alike.join(authors, "author").join(kept, ["found_title", "found_author"]).select(*columns))
        .unionByName(pairs.where(F.col("author") != "").join(of_author, F.col("author") == F.col("found_author")).select(*columns))
        .distinct()
        .withColumn("score", match_score(*[F.col(c) for c in ("title", "author", "found_title", "found_author")]))
    )
    best = first_per_key(chosen.where(F.col("score") >= LEAST_MATCH), ["title", "author"], [F.desc("score"), F.asc("position")], size)
    return ours.join(best, ["title", "author"])


def unknown_items(catalog: DataFrame, known: DataFrame) -> DataFrame:
    """Items of which neither the address nor the pair of title and place is known: two anti-joins."""
    addresses = known.where(F.col("url").isNotNull()).select("url")
    places = known.where(F.col("title").isNotNull()).select("title", "place")
    return catalog.join(addresses, "url", "left_anti").join(places, ["title", "place"], "left_anti")


def looked_up(rows: DataFrame, table: DataFrame, keys: Sequence[str], hot: int = HOT_KEYS) -> DataFrame:
    """All rows, with what a table of one row for each key knows of theirs.

    A key of over 1 / ``hot`` of all rows is hot. There are fewer than ``hot`` of them, whatever the
    data, so the keys are broadcast; their rows are dealt over parts of that share, and what the
    table knows of them is there once for each part. Rows of a null key find nothing and are dealt too.
    """
    counts = rows.dropna(subset=list(keys)).groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    total = counts.agg(F.sum("__n").alias("__all"))
    often = counts.join(F.broadcast(total), F.col("__n") * hot > F.col("__all"))
    parts = F.broadcast(often.select(*keys, F.least("__n", F.ceil(F.col("__n") * hot / F.col("__all"))).cast("int").alias("__parts")))
    blank = F.lit(False)
    for k in keys:
        blank = blank | F.col(k).isNull()
    dealt_by = [f.name for f in rows.schema if "map<" not in f.dataType.simpleString()]  # a task that is run again deals rows alike
    number = F.when(blank, hot).otherwise(F.coalesce("__parts", F.lit(1)))
    dealt = rows.join(parts, list(keys), "left").withColumn("__part", F.pmod(F.xxhash64(*dealt_by), number).cast("int")).drop("__parts")
    known = table.join(parts, list(keys), "left").withColumn("__part", F.explode(F.sequence(F.lit(0), F.coalesce("__parts", F.lit(1)) - 1))).drop("__parts")
    return dealt.join(known, [*keys, "__part"], "left").drop("__part")


def translated(rows: DataFrame, text: str, cache: DataFrame, language: str | Column) -> DataFrame:
    """Looks texts up by hash and target language, one for all rows or one of each row; what the cache lacks stays as it is."""
    own = cache.select(F.col("source_hash").alias("__hash"), F.col("target_lang").alias("__lang"), "translated_text")
    wanted = F.lit(language) if isinstance(language, str) else language
    keyed = rows.withColumn("__hash", F.sha2(F.col(text), 256)).withColumn("__lang", wanted)
    shown = looked_up(keyed, own, ["__hash", "__lang"]).withColumn("shown", F.coalesce("translated_text", F.col(text))).withColumn("hit", F.col("translated_text").isNotNull())
    return shown.drop("__hash", "__lang", "translated_text")
