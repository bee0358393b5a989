"""Magnitudes, durations and projections as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TEN_THOUSAND = 10_000
SECONDS_A_DAY = 86_400


def parse_magnitude(text: Column) -> Column:
    """``1.5万字`` is 15000; a plain number is itself; anything else is null."""
    scaled = F.regexp_extract(text, r"([0-9.]+)\s*万", 1)
    plain = F.regexp_extract(text, r"([0-9]+)", 1)
    return F.when(scaled != "", (F.try_to_number(scaled, F.lit("999999.99")) * TEN_THOUSAND).cast("long")).otherwise(
        plain.try_cast("long")
    )


def format_magnitude(n: Column) -> Column:
    """``1.2万`` from ten thousand on, else digits in groups of three."""
    return F.when(n >= TEN_THOUSAND, F.concat(F.format_string("%.1f", (n / TEN_THOUSAND).cast("double")), F.lit("万"))).otherwise(
        F.format_number(n, 0)
    )


def duration_label(seconds: Column) -> Column:
    whole = F.floor(seconds)
    return (
        F.when(seconds.isNull(), F.lit("-"))
        .when(whole < 60, F.concat(whole.cast("string"), F.lit("秒")))
        .otherwise(F.concat(F.floor(whole / 60).cast("string"), F.lit("分"), (whole % 60).cast("string"), F.lit("秒")))
    )


def eta_label(minutes: Column) -> Column:
    return F.when(minutes < 120, F.concat(F.bround(minutes, 0).cast("int").cast("string"), F.lit("min"))).otherwise(
        F.concat(F.bround(minutes / 60, 1).cast("string"), F.lit("h"))
    )


def needed_rate(sites: Column, views_a_day: Column) -> Column:
    return sites * views_a_day / SECONDS_A_DAY


def page_size_estimate(percent: Column) -> Column:
    """540 pixels, and 1200 more at a hundred percent."""
    return F.round(F.lit(540) + percent / 100 * 1200).cast("int")


def backoff(attempt: Column, jitter: Column) -> Column:
    return F.pow(F.lit(2.0), attempt) + jitter * 1.5


def short_id(text: Column, size: int = 8) -> Column:
    return F.when(F.length(text) > size, F.concat(F.left(text, F.lit(size)), F.lit("..."))).otherwise(text)


def throttle_wait(elapsed: Column, jitter: Column, least: float, most: float) -> Column:
    """Seconds to wait before a host is called again, ``elapsed`` after the last call; ``jitter`` is 0 to 1."""
    return F.when(elapsed < least, F.lit(least) - elapsed + jitter * (most - least)).otherwise(F.lit(0.0))


def coverage(achieved: Column, needed: Column) -> Column:
    """What share of a needed rate is achieved, in percent; 0 where nothing is needed."""
    return F.when(needed > 0, achieved / needed * 100).otherwise(F.lit(0.0))
