"""Texts cut into pages at good places."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Ends of sentences in order of preference, how far ahead a paragraph may end, and the least share of a page.
SENTENCE_ENDS = ("。", "！", "？", "」", "\n")
PART_ENDS = ("。", "！", "？", "\n\n", "\n")
PARAGRAPH_AHEAD, LEAST_SHARE = 500, 0.6
#: Characters and pages that a task gives away at once, and texts that it takes at once.
CHARS, ROWS, TEXTS = 1_000_000, 10_000, 16


def _good_end(text: str, low: int, high: int, ends: tuple[str, ...]) -> int | None:
    """Where the page ends: after the last of the first kind of mark that stands late enough."""
    for mark in ends:
        at = text.rfind(mark, low, high)
        if at - low > (high - low) * LEAST_SHARE:
            return at + 1
    return None


def pages_by_size(text: str | None, size: int) -> list[str]:
    if not text or size <= 0:
        return [text or ""]
    out, at = [], 0
    while len(text) - at > size:
        gap = text.find("\n\n", at + size, at + size + PARAGRAPH_AHEAD + 1)
        if gap >= 0:
            out.append(text[at:gap])
            at = gap + 2
        else:
            end = _good_end(text, at, at + size, SENTENCE_ENDS) or at + size
            out.append(text[at:end])
            at = end
    return [*out, text[at:]] if at < len(text) else out


def pages_by_number(text: str | None, number: int) -> list[str]:
    if not text or number <= 1:
        return [text or ""]
    size, out, at = len(text) // number, [], 0
    for _ in range(number - 1):
        end = _good_end(text, at, at + size, PART_ENDS) or at + size
        out.append(text[at:end])
        at = end
    return [p for p in [*out, text[at:]] if p.strip()]


_CUTS = {"word_count": pages_by_size, "page_count": pages_by_number}


def _given(pages: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*pages, strict=True), schema, strict=True)], schema=schema)


def page_rows(rows: DataFrame, text: str, method: str, size: int, carry: Sequence[str]) -> DataFrame:
    """A row for each page of a text: ``carry``, ``page`` from 0 and ``content``. A task holds a few texts and about ``CHARS`` characters of pages at a time."""
    from pyspark.sql.pandas.types import to_arrow_type

    cut, carry = _CUTS[method], list(carry)
    schema = pa.schema([*[(c, to_arrow_type(rows.schema[c].dataType)) for c in carry], ("page", pa.int32()), ("content", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, chars = [], 0
        for batch in batches:
            for a in range(0, batch.num_rows, TEXTS):
                few = batch.slice(a, TEXTS).to_pydict()
                for k, whole in enumerate(few[text]):
                    own = [few[c][k] for c in carry]
                    for page, content in enumerate(cut(whole, size)):
                        held.append((*own, page, content))
                        chars += len(content)
                        if chars >= CHARS or len(held) >= ROWS:
                            yield _given(held, schema)
                            held, chars = [], 0
        if held:
            yield _given(held, schema)

    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in carry)
    return rows.select(*carry, *([] if text in carry else [text])).mapInArrow(run, f"{kinds}, page int, content string")


def paginate(text: str, method: str, size: int) -> Column:
    """The pages of a text column: by ``word_count``, by ``page_count``, or one page."""
    cut = _CUTS.get(method)
    if cut is None:
        return F.array(F.coalesce(F.col(text), F.lit("")))

    @F.pandas_udf("array<string>")
    def pages(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: cut(t, size))

    return pages(F.col(text))


def page_at(pages: Column, number: Column) -> Column:
    """A page by its number, brought into range."""
    return F.element_at(pages, F.least(F.greatest(number, F.lit(1)), F.size(pages)))
