"""Extraction rules as data: rows of JSON, joined with pages by site, that decide for each page what is read and how.

``compiled`` turns rules into two small tables, what their sections look for and what their fields ask for;
``apply`` joins these with pages and with what was found in them, so pages of all sites and sections are read by one plan.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from . import html

#: States of a novel as rules map them where a rule has no map of its own; containers that are whole pages.
STATES = {"完结": "completed", "连载": "ongoing", "连载中": "ongoing"}
WHOLE = ("", "body", "html")
#: Fallbacks that take their value from the row's context, and the place and mark at which a text is split.
FROM_URL, TEXT_SPLIT, AFTER_TITLE = "from_url", "text_split", "text_after_title"
SPLIT_MARK, SPLIT_PLACE = ".", 2

_SPEC = (
    "site string, section string, field string, place int, attribute string, fallback_attribute string, has_fallback boolean, fallback string, split_mark string, split_place int,"
    "transform string, pattern string, groups boolean, states map<string,string>, fallback_transform string, repeats boolean, cleans boolean, base_url string, address string"
)
_SPEC_NAMES = [c.split()[0] for c in _SPEC.replace("map<string,string>", "map").split(",")]


def _sections(batch: pd.DataFrame) -> Iterator[tuple[str, dict, str, dict]]:
    for site, rule in zip(batch["site"], batch["rule"], strict=True):
        if rule is None:
            continue
        rule = json.loads(rule)
        for section, own in rule.get("selectors", {}).items():
            yield site, rule, section, own


def _repeats(own: dict) -> bool:
    return (own.get("container") or "").strip().lower() not in WHOLE


def _compiled_asks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for site, _, section, own in _sections(batch):
            fields = {n: spec for n, spec in own.get("fields", {}).items() if not n.startswith("_")}
            cut = [*own.get("fields", {}).get("_cleanup", []), *(fields.get("content", {}).get("cleanup", []) if section == "chapter" else [])]
            box = "container" if _repeats(own) else "whole"
            wanted = {"container": own["container"]} if _repeats(own) else {}
            told = [box] if any(spec.get("fallback") in (TEXT_SPLIT, AFTER_TITLE) for spec in fields.values()) else []
            for name, spec in fields.items():
                for mark, selector, attribute in (("f", "selector", "attribute"), ("b", "fallback_selector", "fallback_attribute")):
                    if spec.get(selector):
                        wanted[f"{mark}:{name}"] = spec[selector]
                        told += [f"{mark}:{name}"] * (spec.get(attribute, "text") == "text")
            out.append((site, section, html.asks(wanted, told, ", ".join(cut) or None, None if _repeats(own) else box)))
        yield pd.DataFrame(out, columns=["site", "section", "asked"])


def _compiled_specs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for site, rule, section, own in _sections(batch):
            repeats = _repeats(own)
            for place, (name, spec) in enumerate(own.get("fields", {}).items()):
                if name.startswith("_"):
                    continue
                pattern = spec.get("transform_pattern", "")
                out.append((
                    site, section, name, place, spec.get("attribute", "text"), spec.get("fallback_attribute", "text"), bool(spec.get("fallback_selector")), spec.get("fallback", ""),
                    spec.get("split_pattern", SPLIT_MARK), int(spec.get("split_index", SPLIT_PLACE)), spec.get("transform", ""), pattern, re.compile(pattern).groups > 0,
                    spec.get("status_map", STATES), spec.get("fallback_transform", ""), repeats, bool(rule.get("cleaner", {}).get("enabled")), rule.get("base_url", ""), own.get("url", ""),
                ))
        yield pd.DataFrame(out, columns=_SPEC_NAMES)


def compiled(rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From ``site`` and ``rule`` (JSON): what each section looks for (see ``html.asks``), and a row for each field. A null rule has none."""
    own = rules.select(F.col("site").cast("string").alias("site"), F.col("rule").cast("string").alias("rule"))
    return own.mapInPandas(_compiled_asks, "site string, section string, asked string"), own.mapInPandas(_compiled_specs, _SPEC)


def transformed(value: Column, kind: Column, pattern: Column, groups: Column, states: Column, base: Column) -> Column:
    """A value after the transform that its row asks for; it stays as it is where nothing matches."""
    matched = F.regexp_like(value, pattern)
    first, whole = F.call_function("regexp_extract", value, pattern, F.lit(1)), F.call_function("regexp_extract", value, pattern, F.lit(0))
    param = F.regexp_extract(kind, r"(?s)^[^:]*:(.*)$", 1)
    return (
        F.when((value == "") | (kind == ""), value)
        .when(kind == "absolute_url", text.join_url(base, value))
        .when((kind == "regex") & (pattern != "") & matched, F.when(groups, first).otherwise(whole))
        .when(kind.startswith("strip_prefix:") & F.startswith(value, param), F.substr(value, F.length(param) + 1))
        .when(kind.startswith("strip_suffix:") & F.endswith(value, param), F.left(value, F.length(value) - F.length(param)))
        .when(kind == "status_map", F.coalesce(states[value], value))
        .otherwise(value)
    )


def apply(pages: DataFrame, rules: DataFrame, key: str = "page_id", carry: Sequence[str] = ()) -> DataFrame:
    """What each page's rule reads: ``key``, ``carry``, ``site``, ``section``, ``position`` and ``fields``, a map of the rule's own.

    ``pages`` have ``site``, ``section``, ``url`` and ``html``; a page whose site has no rule for its section gives no row. A
    section with a container gives a row for each element that it finds, else one for the page.

    A field is read by its selector, else by its fallback selector, else from the context: the page's
    address, a part of the element's text, or what stands behind the title there (the author in front of
    it left out); last comes its literal. Then its transform is applied, or that of the fallback if
    the fallback selector or the literal gave the value. ``title`` and ``author`` are context for the fields
    after them. Elements of the cleanup selectors do not count, nor does their text. Pages of one row are
    cleaned where the rule says so: ``content`` as a chapter's text, ``title`` as a novel's.
    """
    asked, specs = compiled(rules)
    by, row = ["site", "section"], [key, "row"]
    own = pages.select(key, *carry, F.col("site").cast("string").alias("site"), "section", "url", "html").join(F.broadcast(asked), by)
    found = html.hits(own, key, None, [*carry, *by, "url"])
    # A row's element has a row for each selector of its fields, and one for itself; the nearest match behind is its value, if it begins inside.
    marks = F.filter(
        F.array(*[F.struct(F.concat(F.lit(f"{m}:"), "field").alias("sel"), F.col(a).alias("attribute"), on.alias("on")) for m, a, on in (("f", "attribute", F.lit(True)), ("b", "fallback_attribute", F.col("has_fallback")))]),
        lambda r: r["on"],
    )
    roles = specs.groupBy(*by).agg(F.flatten(F.collect_list(marks)).alias("roles"))
    box = F.col("sel").isin("container", "whole")
    attribute = F.get(F.filter("roles", lambda r: r["sel"] == F.col("sel")), F.lit(0))["attribute"]
    met = found.join(F.broadcast(roles), by).withColumn("attribute", attribute)
    value = F.when(box, F.col("text")).when(F.col("attribute") == "text", html.shown(F.col("text"))).otherwise(text.strip(F.coalesce(F.col("attrs")[F.col("attribute")], F.lit(""))))
    met = met.select(
        key, *carry, *by, "url", "position", "upto", box.alias("box"), value.alias("value"),
        F.explode(F.when(box, F.concat(F.array(F.lit("")), F.transform("roles", lambda r: r["sel"]))).otherwise(F.array("sel"))).alias("role"),
    ).withColumn("value", F.when(~F.col("box") | (F.col("role") == ""), F.col("value"))).repartition(key)
    behind = Window.partitionBy(key, "role").orderBy(F.desc("position")).rangeBetween(Window.unboundedPreceding, -1)
    met = met.withColumn("hit", F.last(F.when(~F.col("box"), F.struct("position", "value")), ignorenulls=True).over(behind)).where("box")
    hit = F.struct("role", F.when(F.col("hit.position") <= F.col("upto"), F.col("hit.value")).alias("value"))
    boxes = met.groupBy(key, *carry, *by, "url", "position").agg(
        F.map_from_entries(F.collect_list(F.when(F.col("role") != "", hit))).alias("read"), F.max(F.when(F.col("role") == "", F.col("value"))).alias("raw")
    )
    boxes = boxes.withColumn("row", F.row_number().over(Window.partitionBy(key).orderBy("position")) - 1).drop("position")

    # One row for each field of each box.
    full = F.when(F.col("fallback").isin(TEXT_SPLIT, AFTER_TITLE), html.spaced(F.coalesce("raw", F.lit(""))))
    rows = boxes.join(F.broadcast(specs), by).select(
        "*", full.alias("full"), *[F.coalesce(F.col("read")[F.concat(F.lit(f"{m}:"), "field")], F.lit("")).alias(m) for m in ("f", "b")]
    ).drop("read", "raw")
    chosen = F.coalesce(F.nullif("f", F.lit("")), F.col("b"))
    parts = F.split("full", F.concat(F.lit(r"\Q"), "split_mark", F.lit(r"\E")))
    context = F.when(F.contains(F.col("fallback"), F.lit(FROM_URL)), F.coalesce("url", F.lit(""))).when(
        (F.col("fallback") == TEXT_SPLIT) & (F.size(parts) > F.col("split_place")), text.strip(F.get(parts, F.col("split_place")))
    )
    context = F.coalesce(context, F.lit(""))
    literal = F.when(F.col("fallback").isin(FROM_URL, TEXT_SPLIT, AFTER_TITLE), "").otherwise(F.col("fallback"))
    rows = rows.withColumn("value", F.coalesce(F.nullif(chosen, F.lit("")), F.nullif(context, F.lit("")), literal))
    fell = ((F.col("f") == "") & (F.col("b") != "")) | ((chosen == "") & (context == "") & (literal != ""))
    own_kind = F.when(fell & (F.col("fallback_transform") != ""), F.col("fallback_transform")).otherwise(F.col("transform"))
    own_pattern = F.when(fell & (F.col("fallback_transform") != ""), "").otherwise(F.col("pattern"))
    default = F.create_map(*[F.lit(x) for pair in STATES.items() for x in pair])
    own_states = F.when(fell & (F.col("fallback_transform") != ""), default).otherwise(F.col("states"))
    late = (F.col("value") == "") & (F.col("fallback") == AFTER_TITLE)
    rows = rows.withColumn("value", transformed(F.col("value"), own_kind, own_pattern, F.col("groups"), own_states, F.col("base_url")))

    # What stands behind the title: the author first, then fields that may follow both.
    of_row = Window.partitionBy(*row)
    for name in ("author", None):
        title, author = (F.max(F.when(F.col("field") == c, F.struct("place", "value"))).over(of_row) for c in ("title", "author"))
        rows = rows.withColumn("late", late).withColumn("title", title).withColumn("author", author)
        at = F.when(F.col("title.value") == "", 1).otherwise(F.instr(F.col("full"), F.col("title.value")))
        behind = F.substr(F.col("full"), at + F.length("title.value"))
        led = (F.col("author.place") < F.col("place")) & (F.col("author.value") != "") & F.startswith(behind, F.col("author.value"))
        behind = F.btrim(F.when(led, F.substr(behind, F.length("author.value") + 1)).otherwise(behind), F.lit(" ."))
        yes = F.col("late") & (F.col("title.place") < F.col("place")) & (at > 0) & (F.lit(True) if name is None else F.col("field") == name)
        kind, pattern = F.col("transform"), F.col("pattern")
        rows = rows.withColumn("value", F.when(yes, transformed(behind, kind, pattern, F.col("groups"), F.col("states"), F.col("base_url"))).otherwise(F.col("value"))).drop("title", "author", "late")

    cleans = F.col("cleans") & ~F.col("repeats") & (F.col("value") != "")
    rows = rows.withColumn(
        "value", F.when(cleans & (F.col("field") == "content"), text.clean_content(F.col("value"))).when(cleans & (F.col("field") == "title"), text.clean_novel_title(F.col("value"))).otherwise(F.col("value"))
    )
    fields = F.map_from_entries(F.transform(F.array_sort(F.collect_list(F.struct("place", "field", "value"))), lambda f: F.struct(f["field"], f["value"])))
    return rows.groupBy(*row, *carry, *by).agg(fields.alias("fields")).select(key, *carry, *by, F.col("row").cast("int").alias("position"), "fields")
