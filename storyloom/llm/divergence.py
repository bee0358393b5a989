"""How sources of one language differ in their words, by a two-pass vocabulary automaton (operator 13).

1. The first pass counts, exactly, in how many documents of its language each term stands; terms of
   enough documents are the vocabulary.
2. The second pass counts occurrences: each language's terms, padded with a delimiter, become an
   Aho-Corasick automaton, and one run of it over the delimited texts of a group finds them all.
3. The counts are sparse postings (group, term, count). Shares of terms follow from them by whole
   numbers alone; tiles of sources and terms give the distance of every pair of sources.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import kept, materialize, release, rest, sized, slices

MIN_DOCS = 30
SMOOTHING = 5
SCALE = 1_000_000_000
TOP = 50
#: Characters of terms that are broadcast and held as automata at once; a larger vocabulary takes several passes.
AUTOMATON_CHARS = 4_000_000
#: Counters that a task holds before it gives its counts away.
HELD_CELLS = 8_000_000
#: Sources and terms of a tile.
TILE_SOURCES, TILE_TERMS = 128, 2048
#: Texts that are counted at once, if they are short.
ROWS = 1 << 14

#: Letters of terms stay, A to Z in lower case; all other bytes of ASCII become the delimiter.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def delimited(texts: pa.Array) -> pa.LargeStringArray:
    """Each text with nothing but spaces between its terms, and A to Z in lower case; a null one is empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    own = data.slice(int(ends[0]), int(ends[-1] - ends[0])).to_pybytes().translate(_TABLE) if data else b""
    return pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer((ends - ends[0]).tobytes()), pa.py_buffer(own))


def _document_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, n in slices(batch.column("text"), ROWS):
            part = batch.slice(at, n)
            langs = part.column("lang").dictionary_encode()
            words = pc.ascii_split_whitespace(delimited(part.column("text")))
            coded = words.values.dictionary_encode()
            lang_of = np.repeat(langs.indices.to_numpy().astype(np.int64), np.diff(words.offsets.to_numpy()))
            doc = np.repeat(np.arange(n), np.diff(words.offsets.to_numpy()))
            terms = max(1, len(coded.dictionary))
            once = np.unique(doc * terms + coded.indices.to_numpy())
            first = np.searchsorted(doc, once // terms)  # any place of that document: all have its language
            pairs, docs = np.unique(lang_of[first] * terms + once % terms, return_counts=True)
            columns = [langs.dictionary.take(pa.array(pairs // terms)), coded.dictionary.take(pa.array(pairs % terms)).cast(pa.string()), pa.array(docs)]
            made = pa.RecordBatch.from_arrays(columns, names=["lang", "term", "docs"])
            yield made.filter(pc.not_equal(made.column("term"), ""))
    rest()


class Automata:
    """For each language: the automaton of its terms, padded with the delimiter, in order of their numbers."""

    def __init__(self, terms: dict[str, list[str]]):
        import ahocorasick

        self.size, self.by_lang = {lang: len(own) for lang, own in terms.items()}, {}
        for lang, own in terms.items():
            automaton = ahocorasick.Automaton()
            for k, term in enumerate(own):
                automaton.add_word(f" {term} ", k)
            automaton.make_automaton()
            self.by_lang[lang] = automaton

    def count(self, lang: str, text: str) -> np.ndarray:
        """Occurrences of each term in a delimited text; neighbours share a delimiter, and both are found."""
        found = np.fromiter(map(itemgetter(1), self.by_lang[lang].iter(text)), np.int64)
        return np.bincount(found, minlength=self.size[lang])


def _occurrences(source: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(lang, source, term, n): how often each term of ``vocabulary`` stands in each group, by one pass."""
    held: dict[str, list[str]] = {}
    for lang, term in zip(*(c.to_pylist() for c in vocabulary.select("lang", "term").orderBy("lang", "term").toArrow().columns), strict=True):
        held.setdefault(lang, []).append(term)
    shared, token = source.sparkSession.sparkContext.broadcast(held), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = shared.value
        automata = kept(("automata", token), lambda: Automata(terms))
        counts: dict[tuple[str, str], np.ndarray] = {}

        def given() -> Iterator[pa.RecordBatch]:
            for (lang, name), n in counts.items():
                there = np.flatnonzero(n)
                columns = [[lang] * len(there), [name] * len(there), [terms[lang][k] for k in there.tolist()], n[there]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.string()] * 3 + [pa.int64()], strict=True)], names=["lang", "source", "term", "n"])
            counts.clear()

        for batch in batches:
            for at, n in slices(batch.column("text"), ROWS):
                part = batch.slice(at, n)
                groups: dict[tuple[str, str], list[str]] = {}
                for lang, name, text in zip(part.column("lang").to_pylist(), part.column("source").to_pylist(), delimited(part.column("text")).to_pylist(), strict=True):
                    if lang in terms:
                        groups.setdefault((lang, name), []).append(text)
                for group, texts in groups.items():
                    found = automata.count(group[0], f" {' '.join(texts)} ")
                    if group in counts:
                        counts[group] += found
                    else:
                        counts[group] = found
                if sum(map(len, counts.values())) > HELD_CELLS:
                    yield from given()
        yield from given()
        rest()

    return source.mapInArrow(run, "lang string, source string, term string, n bigint")


def share(count: Column | str, total: Column | str, terms: Column | str, smoothing: int = SMOOTHING, scale: int = SCALE) -> Column:
    """1 + floor(scale * (count + smoothing) / (total + smoothing * terms)) in whole numbers; 0 without terms."""
    count, total, terms = (F.col(c) if isinstance(c, str) else c for c in (count, total, terms))
    above = (count + smoothing).cast("decimal(20,0)") * F.lit(scale).cast("decimal(10,0)")
    whole = F.call_function("div", above, (total + terms * smoothing).cast("decimal(20,0)"))
    return F.when(terms > 0, whole + 1).otherwise(F.lit(0)).cast("long")


def _tile(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """Of two blocks of sources: each pair's distance over the terms of a block that one of them holds."""
    names, first = np.unique(rows["source"].to_numpy(), return_index=True)
    row = np.searchsorted(names, rows["source"].to_numpy())
    block, base = rows["block"].to_numpy()[first], rows["base"].to_numpy()[first]
    there = rows["term"].notna().to_numpy()
    terms, column = np.unique(rows["term"].to_numpy()[there].astype(str), return_inverse=True)
    shares = np.repeat(base[:, None], len(terms), axis=1)
    shares[row[there], column] = rows["p"].to_numpy()[there]
    lang, low, high = key[0], key[1], key[2]
    left, right = np.flatnonzero(block == low), np.flatnonzero(block == high)
    out = []
    for s in left.tolist():
        others = right[right != s]
        far = np.abs(shares[others] - shares[s]).sum(axis=1)
        between = np.abs(base[others] - base[s])
        out.append(pd.DataFrame({"source": names[s], "item": names[others], "value": far, "between": between}))
        if low != high:
            out.append(pd.DataFrame({"source": names[others], "item": names[s], "value": far, "between": between}))
    made = pd.concat(out) if out else pd.DataFrame({"source": [], "item": [], "value": [], "between": []})
    made = made.astype({"source": str, "item": str, "value": np.int64, "between": np.int64})
    return made.assign(lang=lang, seen=len(terms))[["lang", "source", "item", "value", "between", "seen"]]


def audit(
    docs: DataFrame,
    min_docs: int = MIN_DOCS,
    smoothing: int = SMOOTHING,
    scale: int = SCALE,
    top: int = TOP,
    automaton_chars: int = AUTOMATON_CHARS,
    lang_col: str = "lang",
    source_col: str = "source",
    text_col: str = "text",
) -> DataFrame:
    """``lang``, ``source``, ``part``, ``item``, ``value``, ``rank``: what sets each source of a language apart.

    Part ``pair`` ranks the other sources of the language by their distance, the sum over the
    language's terms of the differences of shares; part ``term`` ranks the terms of the source
    whose share is above the language's, the first ``top`` of them. Of equal values the lesser
    item comes first, by its UTF-8 bytes. Terms are runs of letters and of characters beyond ASCII,
    with A to Z in lower case; a language keeps those that at least ``min_docs`` of its documents
    hold. All arithmetic is in whole numbers.

    A null text, language or source is an empty one; an empty text has no terms. Every language and
    source that occurs is a group, also without terms: a language without kept terms has pairs of
    value 0 and no part ``term``; a language of one source has no pairs. Repeated rows and rows that
    share an id each count; other columns are left out, whatever their names; very long texts are
    read whole; an empty table gives an empty one.

    Counts are summed inside tasks before they are shuffled, so a source with a third of all rows is
    no more work than others. The automata hold ``automaton_chars`` characters at a time, and a
    vocabulary of more takes a pass over the documents for each such part. Distances are summed in
    tiles of ``TILE_SOURCES`` by ``TILE_SOURCES`` sources and ``TILE_TERMS`` terms.
    """
    named = {c: F.coalesce(F.col(n).cast("string"), F.lit("")) for c, n in (("lang", lang_col), ("source", source_col), ("text", text_col))}
    source = docs.select(*[c.alias(n) for n, c in named.items()])
    found = source.select("lang", "text").mapInArrow(_document_frequencies, "lang string, term string, docs bigint")
    frequent = found.groupBy("lang", "term").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs)
    vocabulary = materialize(frequent, "vocabulary")
    chars = vocabulary.agg(F.sum(F.length("term") + 2)).first()[0] or 0
    # Parts by a hash differ in size a little; those of a fifth less than the bound stay within it.
    parts = max(1, -(-chars * 5 // (automaton_chars * 4)))
    counted = None
    for part in range(parts if chars else 0):
        own = vocabulary.where(F.pmod(F.xxhash64("lang", "term"), F.lit(parts)) == part)
        one = _occurrences(source, own)
        counted = one if counted is None else counted.unionAll(one)
    if counted is None:
        counted = source.sparkSession.createDataFrame([], "lang string, source string, term string, n bigint")
    postings = materialize(counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n")), "postings")

    terms = vocabulary.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"))
    totals = postings.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = source.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(terms, "lang", "left")
    groups = groups.select("lang", "source", F.coalesce("total", F.lit(0)).cast("long").alias("total"), F.coalesce("terms", F.lit(0)).cast("long").alias("terms"))
    groups = materialize(groups.withColumn("base", share(F.lit(0), "total", "terms", smoothing, scale)), "groups")

    known = postings.join(sized(groups, 128), ["lang", "source"]).withColumn("p", share("n", "total", "terms", smoothing, scale))
    known = materialize(known.select("lang", "source", "term", "p", "base"), "shares")
    overall = postings.groupBy("lang", "term").agg(F.sum("n").alias("n"))
    per_lang = groups.groupBy("lang").agg(F.sum("total").alias("total"), F.first("terms").alias("terms"), F.count(F.lit(1)).alias("sources"))
    overall = overall.join(sized(per_lang, 64), "lang").select("lang", "term", share("n", "total", "terms", smoothing, scale).alias("q"))
    above = known.join(overall, ["lang", "term"]).where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item").asc())
    of_terms = above.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)

    # Tiles: a source's postings go to every pair of source blocks with its own, each block of terms apart.
    blocks = per_lang.select(
        "lang", F.ceil(F.col("sources") / TILE_SOURCES).alias("source_blocks"), F.greatest(F.ceil(F.col("terms") / TILE_TERMS), F.lit(1)).alias("term_blocks"), F.col("terms").alias("all_terms")
    )
    blocks = materialize(blocks, "blocks")
    block = F.pmod(F.xxhash64("source"), F.col("source_blocks")).alias("block")
    rows = known.join(sized(blocks, 64), "lang").select("lang", "source", "term", "p", "base", block, "source_blocks", F.pmod(F.xxhash64("term"), F.col("term_blocks")).alias("term_block"))
    present = groups.join(sized(blocks, 64), "lang").select(
        "lang", "source", F.lit(None).cast("string").alias("term"), F.lit(0).cast("long").alias("p"), "base", block, "source_blocks",
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("term_blocks") - 1)).alias("term_block"),
    )
    dealt = rows.unionByName(present).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("source_blocks") - 1)))
    tiles = dealt.select("lang", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "term_block", "source", "block", "term", "p", "base")
    summed = tiles.groupBy("lang", "low", "high", "term_block").applyInPandas(_tile, "lang string, source string, item string, value bigint, between bigint, seen bigint")
    pairs = summed.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"), F.first("between").alias("between"), F.sum("seen").alias("seen"))
    pairs = pairs.join(sized(blocks, 64), "lang").select("lang", "source", F.lit("pair").alias("part"), "item", (F.col("value") + F.col("between") * (F.col("all_terms") - F.col("seen"))).alias("value"))
    of_pairs = pairs.withColumn("rank", F.row_number().over(order))
    result = materialize(of_pairs.unionByName(of_terms), "divergence")
    release(vocabulary, postings, groups, known, blocks)
    return result
