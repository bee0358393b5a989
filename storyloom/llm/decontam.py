"""Benchmark decontamination by rare n-gram seeds and Smith-Waterman alignment (operator 8).

1. Each document gives the seeds it holds: hashes of its word n-grams that some item has. Those
   that hold any are written with their texts, which no later step looks for again.
2. Seeds are counted, so it is known which are rare before any region is cut out.
3. Of each document and item that share a rare seed, or two seeds of any kind, the regions around
   the seeds are cut out and aligned at once.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_text, materialize, release, slices

#: Words of a seed. An item of fewer words is a seed as a whole.
SEED_WORDS = 4
#: A seed is rare if at most this share of the documents holds it.
RARE_SHARE = 0.0005
#: Least score of a leak: the alignment's share of what the whole item would score.
MIN_SCORE = 0.5
MATCH, MISMATCH, GAP = 2, -1, -1
#: Characters of benchmark text that are broadcast at once, but for one item; a larger benchmark takes several passes.
BROADCAST_CHARS = 16_000_000
#: Marks that do not count at the ends of a word.
EDGES = " .,;:!?\"'()[]{}<>*_`~«»¡¿…“”‘’-"

_BASE = np.uint64(0x9E3779B97F4A7C15)


def normal_words(texts: pa.Array) -> pa.ListArray:
    """The words of each text: parted by white space, in lower case, without marks at their ends.

    Items and documents both go through here. A word of marks alone stays as it is.
    """
    array = pc.utf8_lower(pc.utf8_trim_whitespace(pc.fill_null(texts.cast(pa.large_string()), "")))
    lists = pc.utf8_split_whitespace(array)
    coded = lists.values.dictionary_encode()
    bare = pc.utf8_trim(coded.dictionary, characters=EDGES)
    bare = pc.if_else(pc.equal(bare, ""), coded.dictionary, bare)
    return pa.LargeListArray.from_arrays(lists.offsets.cast(pa.int64()), bare.take(coded.indices))


def words_of(text: str | None) -> list[str]:
    return [w for w in normal_words(pa.array([text], pa.string()))[0].as_py() if w]


def align(item: list[str], region: list[str]) -> tuple[float, int, int]:
    """Smith-Waterman on words: score over the item's own, and the region's aligned span."""
    number: dict[str, int] = {}
    a = [number.setdefault(w, len(number)) for w in item]
    b = np.array([number.setdefault(w, len(number)) for w in region])
    n = len(b)
    climb = -GAP * np.arange(1, n + 1)
    row, begin = np.zeros(n + 1, np.int64), np.arange(n + 1)
    best, span = 0, (0, 0)
    for word in a:
        diagonal = row[:-1] + np.where(b == word, MATCH, MISMATCH)
        up = row[1:] + GAP
        value = np.maximum(np.maximum(diagonal, up), 0)
        start = np.where(value == 0, np.arange(1, n + 1), np.where(diagonal >= up, begin[:-1], begin[1:]))
        raised = value + climb  # a gap in the item costs the same for each word
        most = np.maximum.accumulate(raised)
        came = np.maximum.accumulate(np.where(raised == most, np.arange(n), 0))
        value, start = most - climb, start[came]
        row, begin = np.r_[0, value], np.r_[0, start]
        k = int(value.argmax())
        if value[k] > best:
            best, span = int(value[k]), (int(start[k]), k + 1)
    return best / (MATCH * len(a)), *span


class Seeds:
    """The seeds of some benchmark items, by the hashes of their words in order.

    Items are told apart by their place in the list: rows that share an ``item_id`` each count.
    """

    def __init__(self, items: list[tuple[int, str]], seed_words: int):
        self.words: dict[str, int] = {}
        held = [(i, w) for i, t in items if (w := words_of(t))]
        self.ids, self.items = [i for i, _ in held], [w for _, w in held]
        found: dict[int, dict[int, set[int]]] = defaultdict(lambda: defaultdict(set))
        #: How many distinct seeds each item has.
        self.distinct: list[int] = []
        for k, words in enumerate(self.items):
            ids = np.array([self.words.setdefault(w, len(self.words) + 1) for w in words], np.uint64)
            n = min(seed_words, len(ids))
            own = set(self.hashes(ids, n).tolist())
            self.distinct.append(len(own))
            for h in own:
                found[n][h].add(k)
        self.by_length: dict[int, tuple[np.ndarray, list[list[int]]]] = {}
        for n, seeds in found.items():
            keys = np.array(sorted(seeds), np.uint64)
            self.by_length[n] = keys, [sorted(seeds[k]) for k in keys.tolist()]

    @staticmethod
    def hashes(ids: np.ndarray, n: int) -> np.ndarray:
        value = np.full(max(0, len(ids) - n + 1), n, np.uint64)
        for k in range(n):
            value = (value ^ (value >> np.uint64(29))) * _BASE + ids[k : len(ids) - n + 1 + k]
        return value

    def _places(self, texts: pa.Array) -> tuple[pa.ListArray, list[tuple[np.ndarray, np.ndarray, np.ndarray, list[list[int]]]]]:
        """The words of texts and, for each length of seeds: documents, places, seeds, and the items of each."""
        lists = normal_words(texts)
        coded = lists.values.dictionary_encode()
        get = self.words.get
        known = np.array([get(w, 0) for w in coded.dictionary.to_pylist()] or [0], np.uint64)
        ids = known[coded.indices.to_numpy()] if len(coded) else np.zeros(0, np.uint64)
        ends, out = lists.offsets.to_numpy(), []
        for n, (keys, of) in self.by_length.items():
            if len(ids) < n:
                continue
            inside = np.convolve(ids == 0, np.ones(n, np.int64), "valid") == 0
            places = np.flatnonzero(inside)
            value = np.full(len(places), n, np.uint64)
            for k in range(n):
                value = (value ^ (value >> np.uint64(29))) * _BASE + ids[places + k]
            where = np.minimum(np.searchsorted(keys, value), len(keys) - 1)
            yes = keys[where] == value
            places, where = places[yes], where[yes]
            doc = np.searchsorted(ends, places, side="right") - 1
            fits = places + n <= ends[doc + 1]
            doc, places, where = doc[fits], places[fits], where[fits]
            out.append((doc, places - ends[doc], keys[where].astype(np.int64), [of[s] for s in where.tolist()]))
        return lists, out

    def held(self, texts: list[str | None]) -> list[list[int] | None]:
        """The distinct seeds of each text; None if it has none."""
        out: list[list[int] | None] = [None] * len(texts)
        seeds: dict[int, set[int]] = defaultdict(set)
        for doc, _, keys, _ in self._places(pa.array(texts, pa.string()))[1]:
            for d, s in zip(doc.tolist(), keys.tolist(), strict=True):
                seeds[d].add(s)
        for d, own in seeds.items():
            out[d] = sorted(own)
        return out

    def leaks(self, texts: pa.Array, common: frozenset[int], min_score: float) -> Iterator[tuple[int, int, float, int, int]]:
        """(text, item, score, first word, end) of what aligns well enough around seeds that tell."""
        lists, found = self._places(texts)
        at: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)
        for doc, place, keys, items in found:
            for d, p, s, of in zip(doc.tolist(), place.tolist(), keys.tolist(), items, strict=True):
                for item in of:
                    at[d, item].append((p, s))
        words: tuple[int, list[str]] = -1, []
        for (d, item), places in sorted(at.items()):
            seeds = {s for _, s in places}
            if seeds <= common and len(seeds) < min(2, self.distinct[item]):
                continue
            if words[0] != d:
                words = d, lists[d].as_py()
            for first, last in self.regions(item, sorted(p for p, _ in places)):
                score, start, end = align(self.items[item], words[1][first:last])
                if score >= min_score:
                    yield d, item, score, first + start, first + end

    def regions(self, item: int, places: list[int]) -> Iterator[tuple[int, int]]:
        """Seeds no further apart than the item is long share a region, an item longer on each side."""
        length, k = len(self.items[item]), 0
        while k < len(places):
            j = k
            while j + 1 < len(places) and places[j + 1] - places[j] <= length:
                j += 1
            yield max(0, places[k] - length), places[j] + 2 * length
            k = j + 1


def leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    min_score: float = MIN_SCORE,
    seed_words: int = SEED_WORDS,
    rare_share: float = RARE_SHARE,
    broadcast_chars: int = BROADCAST_CHARS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Pairs of a document and a benchmark item it holds, whole, edited or in good part.

    Gives the document's id, ``item_id``, ``score`` (0 to 1), and the words of the document
    that align, ``start_word`` to ``end_word``. Words are in lower case, parted by white space, and
    bare of marks at their ends. A document is compared with an item where they share a rare seed,
    or two seeds of any kind (one, if the item has no more), so a passage that very many documents
    hold is still found. An edited copy that keeps no ``seed_words`` words in a row shares no seed
    and is not found. All places of a document are aligned; the best one of each pair is returned,
    of equal ones the first.

    Null and empty texts, and items without words, match nothing; very long ones are read whole.
    Rows that share a document id count as one document, and those with a null id or item id are
    left out, as a pair needs both. Items that share an id each count. Other columns are left out,
    whatever their names; an empty table gives an empty one. Items are broadcast in parts of
    ``broadcast_chars`` characters and at most one item more, a pass over the documents for each.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id IS NOT NULL AND text IS NOT NULL")
    items = items.withColumn("mark", F.xxhash64("text"))
    # Only ids, marks and lengths meet in one task here, of the benchmark and of no document; texts are joined to their parts.
    sizes = items.select("item_id", "mark", F.length("text").alias("chars")).distinct()
    before = F.sum("chars").over(Window.orderBy("item_id", "mark").rowsBetween(Window.unboundedPreceding, -1))
    dealt = materialize(sizes.select("item_id", "mark", F.floor(F.coalesce(before, F.lit(0)) / broadcast_chars).cast("long").alias("part")), "parts")
    source = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text")).where(F.col("__id").isNotNull())
    parts = [r.part for r in dealt.select("part").distinct().orderBy("part").collect()]
    found = None
    for part in parts or [0]:
        own = items.join(dealt.where(F.col("part") == part), ["item_id", "mark"]).select("item_id", "text").distinct()
        one = _leaks(source, [(r.item_id, r.text) for r in own.collect()], min_score, seed_words, rare_share)
        found = one if found is None else found.unionAll(one)
    release(dealt)
    if len(parts) > 1:  # items of one id may lie in several parts
        found = materialize(_best(found), "leaks")
    return found.withColumnRenamed("__id", id_col)


def _best(scored: DataFrame) -> DataFrame:
    """The best place of each pair, of equal ones the first."""
    best = scored.groupBy("__id", "item_id").agg(F.max(F.struct("score", -F.col("start_word"), F.col("end_word"))).alias("best"))
    return best.select("__id", "item_id", "best.score", (-F.col("best.col2")).alias("start_word"), F.col("best.end_word"))


def _leaks(source: DataFrame, items: list[tuple[int, str]], min_score: float, seed_words: int, rare_share: float) -> DataFrame:
    context = source.sparkSession.sparkContext
    seeds = context.broadcast(Seeds(items, seed_words))
    kind = T.ArrayType(T.LongType())
    held = map_text(source, lambda: lambda texts: (seeds.value.held(texts),), [T.StructField("seeds", kind)], "__text", ["__id", "__text"])
    held = materialize(held.where(F.col("seeds").isNotNull()), "seeded")

    # Seeds are the benchmark's, so those found common are no more than were broadcast.
    most = max(1.0, rare_share * source.count())
    counts = held.select("__id", F.explode("seeds").alias("seed")).groupBy("seed").agg(F.count(F.lit(1)).alias("docs"))
    common = context.broadcast(frozenset(r.seed for r in counts.where(F.col("docs") > most).collect()))
    id_type = held.schema["__id"]

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["__id", "item_id", "score", "start_word", "end_word"]
        kinds = [pa.int64(), pa.float64(), pa.int64(), pa.int64()]
        for batch in batches:
            for at, n in slices(batch.column("__text")):
                rows = list(seeds.value.leaks(batch.column("__text").slice(at, n), common.value, min_score))
                ids = batch.column("__id").slice(at, n).take(pa.array([r[0] for r in rows], pa.int64()))
                values = [[seeds.value.ids[r[1]] for r in rows], *([r[k] for r in rows] for k in (2, 3, 4))]
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(v, t) for v, t in zip(values, kinds, strict=True))], names=names)

    fields = [T.StructField("item_id", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("start_word", T.LongType()), T.StructField("end_word", T.LongType())]
    scored = held.select("__id", "__text").mapInArrow(aligned, T.StructType([id_type, *fields]))
    best = materialize(_best(scored), "leaks")
    release(held)
    return best
