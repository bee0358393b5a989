"""Repairs of novels from several sources at once, each column with the name of the source that set it."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a title begins with that stands for an unknown one, and characters that a description keeps.
PLACEHOLDER = "Book-"
DESCRIPTION = 2000
#: Fixed value: characters that a text must be longer than to replace an empty one.
LEAST_TEXT = 50


def blank(value: Column) -> Column:
    return F.coalesce(F.trim(value) == "", F.lit(True))


#: Of each column that is repaired: when it needs to be, what a candidate must be, and what of it is taken.
RULES = {
    "title": (lambda own: blank(own) | own.startswith(PLACEHOLDER), lambda new: ~blank(new) & ~new.startswith(PLACEHOLDER), lambda new: new),
    "cover": (blank, lambda new: ~blank(new), lambda new: new),
    "author": (blank, lambda new: ~blank(new), lambda new: new),
    "description": (blank, lambda new: ~blank(new), lambda new: F.left(new, F.lit(DESCRIPTION))),
    "content": (blank, lambda new: F.length(new) > LEAST_TEXT, lambda new: new),
}


def merged(rows: DataFrame, key: str, sources: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """Rows with what candidate sources, in order of priority, know of the columns that need repair.

    A source has ``key`` and any of the columns. Beside each repaired column, ``<column>_from`` names the source that set it,
    or is null where the row's own value stays. Rows and candidates meet in one shuffle by the key, however many sources
    there are; of a source's several candidates the least is taken. Candidates of unknown keys are left out.
    """
    columns = [c for c in RULES if c in rows.columns]

    def tagged(df: DataFrame, place: int, name: str | None) -> DataFrame:
        own = [(F.col(c) if c in df.columns else F.lit(None)).cast("string").alias(c) for c in columns]
        whole = F.struct(*rows.columns) if name is None else F.lit(None).cast(rows.select(F.struct(*rows.columns)).schema[0].dataType)
        return df.select(key, F.lit(place).alias("__place"), F.lit(name).cast("string").alias("__name"), whole.alias("__row"), *own)

    together = reduce(DataFrame.unionByName, [tagged(rows, -1, None), *[tagged(df, k, name) for k, (name, df) in enumerate(sources)]])
    best = [
        F.min(F.when((F.col("__place") >= 0) & good(F.col(c)), F.struct("__place", F.col(c).alias("value"), F.col("__name").alias("name")))).alias(f"__{c}")
        for c, (_, good, _) in RULES.items() if c in columns
    ]
    # A key may have several rows of its own: each is repaired alike.
    own = F.collect_list("__row").alias("__rows")
    met = together.groupBy(key).agg(own, *best).where(F.size("__rows") > 0).select(F.explode("__rows").alias("__row"), *[f"__{c}" for c in columns])
    out = []
    for c in rows.columns:
        if c not in columns:
            out.append(F.col(f"__row.{c}").alias(c))
            continue
        needs, _, taken = RULES[c]
        found = needs(F.col(f"__row.{c}")) & F.col(f"__{c}").isNotNull()
        out += [F.when(found, taken(F.col(f"__{c}.value"))).otherwise(F.col(f"__row.{c}")).alias(c), F.when(found, F.col(f"__{c}.name")).alias(f"{c}_from")]
    return met.select(*out)
