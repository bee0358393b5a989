"""Substring deduplication by relative Lempel-Ziv parsing (operator 12).

A window is some consecutive words; it is spare if it also starts in a document of a smaller id.

1. Seeds route the work. Of every window the least hash of its word n-grams is its seed, so windows
   of the same words have the same seed wherever they stand. Seeds are counted with the least id
   that holds each: that document is the reference of all windows of the seed.
2. Reference blocks: the regions of a document for which it is the reference are indexed by their
   windows, and the regions of all later documents with these seeds are factored against them,
   greedily: from a window of the index a factor runs on as long as words agree. Windows that cross the
   end of a factor are looked up one by one, so what lies in factors and at their ends is exactly what
   the block holds. No other block can hold a window of that seed for the first time but for variants:
3. Windows that their reference lacks are counted by their hashes, with the least id of each.
4. What is spare is a set of spans of words for each document; the rest is kept.

Words and windows are told apart by hashes of 64 and 128 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import join_back, map_text, materialize, release, rest, row_keyed, sized, slices

WINDOW = 13
#: Words of the n-grams of which a window's least is its seed.
SEED_WORDS = 7
#: Seeds of later documents that one task's copy of a reference block is met with.
BLOCK_SEEDS = 8192
#: Texts that are hashed at once, if they are short.
ROWS = 4096
#: Bytes of a row's key in a join.
KEY_BYTES = 32

_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_BASE, _OTHER = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
#: Where a row without an id stands: behind all others.
_LAST = (1 << 63) - 1


def hashed_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words, text after text, and where each text's end. Words are what ASCII white space parts."""
    import xxhash

    lists = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    coded = lists.flatten().dictionary_encode()
    distinct = np.array([xxhash.xxh64_intdigest(w) for w in coded.dictionary.to_pylist()] or [0], np.uint64)
    word, ends = coded.indices.to_numpy(), np.cumsum(pc.list_value_length(lists).to_numpy().astype(np.int64))
    blank = coded.dictionary.index("").as_py()
    flat = distinct[word] if len(word) else np.zeros(0, np.uint64)
    if blank >= 0:  # white space at the ends of a text
        there = word != blank
        flat, ends = flat[there], np.r_[0, np.cumsum(there)][ends]
    return flat, np.r_[0, ends].astype(np.int64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def rolling(words: np.ndarray, n: int, base: np.uint64 = _BASE) -> np.ndarray:
    """The hash of each ``n`` consecutive words."""
    value = np.full(max(0, len(words) - n + 1), n, np.uint64)
    for k in range(n):
        value = value * base + words[k : len(words) - n + 1 + k]
    return _mixed(value)


def window_seeds(words: np.ndarray, window: int, seed_words: int) -> np.ndarray:
    """The seed of each window: the least hash of its n-grams."""
    grams = rolling(words, seed_words)
    steps = window - seed_words + 1
    least = grams[: max(0, len(words) - window + 1)].copy()
    for k in range(1, steps):
        np.minimum(least, grams[k : len(least) + k], out=least)
    return least


def _seeds_of(window: int, seed_words: int):
    """Of texts: number of words, digest of the words, and the seeds of the windows; neighbours of one seed give it once."""

    def of(texts: list[str | None]):
        flat, ends = hashed_words(pa.array(texts, pa.string()))
        seeds = window_seeds(flat, window, seed_words).view(np.int64)
        counts, digests, made = np.diff(ends).tolist(), [], []
        for text, a, b in zip(texts, ends.tolist(), ends[1:].tolist(), strict=False):
            digests.append(hashlib.sha256(b" ".join((text or "").encode("utf-8", "surrogatepass").split())).hexdigest())
            own = seeds[a : max(a, b - window + 1)]
            made.append(own[np.r_[True, own[1:] != own[:-1]]] if len(own) else own)
        return counts, digests, made

    return of


def _regions(window: int, seed_words: int):
    """From rows of a text and its shared seeds: the regions of each reference, and whether it is the row itself."""
    names = ["first", "salt", "reader", "id", "row", "start", "words"]
    kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]

    def given(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, n in slices(batch.column("text"), ROWS):
                part = batch.slice(at, n)
                flat, ends = hashed_words(part.column("text"))
                asked = part.column("asked")
                pairs, edges = asked.flatten(), np.r_[0, np.cumsum(pc.list_value_length(asked).to_numpy().astype(np.int64))]
                seed, first, salts = (pairs.field(c).to_numpy() for c in ("seed", "first", "salts"))
                seeds, out, held = window_seeds(flat, window, seed_words).view(np.int64), [], 0
                ids, rows = part.column("id").to_pylist(), part.column("row").to_pylist()
                for k in range(n):
                    a, b = int(ends[k]), int(ends[k + 1])
                    own = slice(int(edges[k]), int(edges[k + 1]))
                    order = np.argsort(seed[own], kind="stable")
                    known, of, dealt = seed[own][order], first[own][order], salts[own][order]
                    windows = seeds[a : max(a, b - window + 1)]
                    place = np.minimum(np.searchsorted(known, windows), len(known) - 1)
                    start = np.flatnonzero(known[place] == windows)
                    place = place[start]
                    order = np.lexsort((start, of[place]))
                    start, place = start[order], place[order]
                    block = of[place]
                    new = np.flatnonzero(np.r_[True, (block[1:] != block[:-1]) | (start[1:] - start[:-1] > window)][: len(start)])
                    for x, y in zip(new.tolist(), [*new[1:].tolist(), len(start)], strict=True):
                        words = flat[a + start[x] : a + start[y - 1] + window].tobytes()
                        reader, many = bool(block[x] != ids[k]), int(dealt[place[x]])
                        # A reference goes to each part of its block, a reader to one.
                        for salt in [rows[k] % many] if reader else range(many):
                            out.append((int(block[x]), salt, reader, ids[k], rows[k], int(start[x]), words))
                            held += len(words)
                            if held > 8 << 20:
                                yield given(out)
                                out, held = [], 0
                if out:
                    yield given(out)
        rest()

    return run


class Block:
    """Regions of a reference document, indexed by their windows."""

    def __init__(self, window: int):
        self.window, self.regions, self.index = window, [], {}

    def add(self, words: np.ndarray) -> None:
        at = len(self.regions)
        self.regions.append(words)
        for k, key in reversed(list(enumerate(rolling(words, self.window).tolist()))):
            self.index[key] = at, k

    def factors(self, words: np.ndarray) -> tuple[list[tuple[int, int]], list[int]]:
        """The spans of ``words`` that factors cover, and the windows that the block lacks.

        A factor begins at a window of the block and runs on while words agree. The next may begin
        in its last words: windows that cross its end are looked up too.
        """
        keys, spans, lacking = rolling(words, self.window).tolist(), [], []
        i, find = 0, self.index.get
        while i < len(keys):
            found = find(keys[i])
            length = self._agree(self.regions[found[0]][found[1] :], words[i:]) if found else 0
            if length < self.window:
                lacking.append(i)
                i += 1
                continue
            if spans and spans[-1][1] >= i:
                spans[-1] = spans[-1][0], max(spans[-1][1], i + length)
            else:
                spans.append((i, i + length))
            i += length - self.window + 1
        return spans, lacking

    @staticmethod
    def _agree(a: np.ndarray, b: np.ndarray) -> int:
        """How many words agree from the start."""
        most, at, step = min(len(a), len(b)), 0, 64
        while at < most:
            differ = a[at : min(most, at + step)] != b[at : min(most, at + step)]
            if differ.any():
                return at + int(differ.argmax())
            at, step = at + step, step * 4
        return most


def _parsed(window: int):
    """From rows sorted by block, the reference first: each reader's spans, and its windows that the block lacks."""
    key = pa.struct([("start", pa.int64()), ("window", pa.binary())])
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.list_(key)]

    def given(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["id", "row", "spans", "lacking"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, block, out = None, Block(window), []
        for batch in batches:
            for first, salt, reader, doc, row, start, words in zip(*(batch.column(c).to_pylist() for c in ("first", "salt", "reader", "id", "row", "start", "words")), strict=True):
                if (first, salt) != held:
                    held, block = (first, salt), Block(window)
                words = np.frombuffer(words, np.uint64)
                if not reader:
                    block.add(words)
                    continue
                spans, lacking = block.factors(words)
                left = []
                if lacking:
                    at = np.array(lacking)
                    both = np.stack([rolling(words, window)[at], rolling(words, window, _OTHER)[at]], axis=1)
                    left = [{"start": start + i, "window": both[k].tobytes()} for k, i in enumerate(lacking)]
                out.append((doc, row, [{"start": start + a, "end": start + b} for a, b in spans], left))
                if len(out) > 4096:
                    yield given(out)
                    out = []
        if out:
            yield given(out)
        rest()

    return run


def _swept(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of plans that nothing holds any more."""
    spark._jvm.System.gc()


def keyed_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``row`` and ``text``: a row is known by its id and its place in its file."""
    source = row_keyed(docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).cast("string").alias("text")))
    return source.select(F.coalesce("__id", F.lit(_LAST)).alias("id"), F.xxhash64("__row.file", "__row.at").alias("row"), "text")


def repeats(source: DataFrame, window: int = WINDOW, seed_words: int = SEED_WORDS, block_seeds: int = BLOCK_SEEDS) -> tuple[DataFrame, DataFrame]:
    """Of ``keyed_texts``, two written tables: all rows with their words, and ``spans`` (start, end) of those with spare words.

    See ``deduplicate`` for what is spare, and for rows of odd ids and texts.
    """
    spark = source.sparkSession
    fields = [T.StructField("n_words", T.LongType()), T.StructField("words_sha256", T.StringType()), T.StructField("seeds", T.ArrayType(T.LongType()))]
    rows = materialize(map_text(source, lambda: _seeds_of(window, seed_words), fields, "text", ["id", "row"], ROWS), "seeds")

    seeds = rows.select(F.explode("seeds").alias("seed"), "id", "row")
    counted = seeds.groupBy("seed").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.count(F.lit(1)).alias("n"))
    shared = materialize(counted.where("first < last").select("seed", "first", "n"), "shared")
    load = shared.groupBy("first").agg(F.sum("n").alias("load"))
    salted = shared.join(load.hint("shuffle_hash"), "first").select("seed", "first", "n", F.ceil(F.col("load") / block_seeds).cast("long").alias("salts"))
    salted = materialize(salted, "salted")
    _swept(spark)
    total = rows.agg(F.sum(F.size("seeds"))).first()[0] or 0
    told = join_back(seeds, salted, "seed", "n", total)
    asked = materialize(told.groupBy("id", "row").agg(F.collect_list(F.struct("seed", "first", "salts")).alias("asked")), "asked")
    seeded, rows = rows, materialize(rows.drop("seeds"), "rows")
    release(shared, salted, seeded)
    _swept(spark)

    # Texts of rows without a shared seed are not shuffled where the keys of the others are few enough.
    keys = sized(asked.select("id", "row"), KEY_BYTES)
    texts = source.join(keys, ["id", "row"], "left_semi").join(asked.hint("shuffle_hash"), ["id", "row"])
    regions = texts.select("id", "row", "text", "asked").mapInArrow(_regions(window, seed_words), "first bigint, salt bigint, reader boolean, id bigint, row bigint, start bigint, words binary")
    dealt = regions.repartition("first", "salt").sortWithinPartitions("first", "salt", "reader")
    parsed = materialize(dealt.mapInArrow(_parsed(window), "id bigint, row bigint, spans array<struct<start:bigint,end:bigint>>, lacking array<struct<start:bigint,window:binary>>"), "parsed")
    release(asked)
    _swept(spark)

    lacking = parsed.select("id", "row", F.explode("lacking").alias("at")).select("id", "row", "at.start", "at.window")
    variants = lacking.groupBy("window").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.count(F.lit(1)).alias("n")).where("first < last").drop("last")
    again = join_back(lacking, materialize(variants, "variants"), "window", "n", lacking.count()).where("id > first").select("id", "row", "start", (F.col("start") + window).alias("end"))
    spans = parsed.select("id", "row", F.explode("spans").alias("span")).select("id", "row", "span.start", "span.end").unionAll(again)
    covered = materialize(spans.groupBy("id", "row").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans")), "covered")
    release(parsed)
    _swept(spark)
    return rows, covered


def deduplicate(
    docs: DataFrame,
    window: int = WINDOW,
    seed_words: int = SEED_WORDS,
    block_seeds: int = BLOCK_SEEDS,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_text: bool = False,
) -> DataFrame:
    """Each row's id, ``n_words``, ``n_removed`` and ``kept_sha256``; with ``with_text`` the ``kept_text`` too.

    Words are what ASCII white space parts, taken as they are. A word goes if it lies in a window of
    ``window`` words that also starts in a row of a smaller id; all windows are judged on the input.
    What is kept is joined by single spaces.

    A null text has no words; a text shorter than a window loses none. Rows that share an id are
    judged each by itself and never against each other; a null id is greater than all others.
    Repeated rows stay. Other columns are left out, whatever their names; an empty table gives an
    empty one. A very long text is read whole: its words are hashed at once in one task.

    Seeds are added up before they are shuffled, those of hot keys meet their references by a bounded
    broadcast, and a reference that very many documents share is copied to as many tasks as their
    seeds ask for (one for ``block_seeds``), so no passage fills a task.
    """
    source = keyed_texts(docs, id_col, text_col)
    rows, covered = repeats(source, window, seed_words, block_seeds)
    texts = source.join(sized(covered.select("id", "row"), KEY_BYTES), ["id", "row"], "left_semi").join(covered.hint("shuffle_hash"), ["id", "row"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], []]
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                words, kept, at = (text or "").encode("utf-8", "surrogatepass").split(), [], 0
                for span in spans:
                    if span["start"] > at:
                        kept += words[at : span["start"]]
                    at = max(at, span["end"])
                kept += words[at:]
                whole = b" ".join(kept)
                for to, value in zip(out, (len(words) - len(kept), hashlib.sha256(whole).hexdigest(), whole.decode("utf-8", "surrogatepass") if with_text else None), strict=True):
                    to.append(value)
            columns = [batch.column("id"), batch.column("row"), pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "row", "n_removed", "kept_sha256", "kept_text"])
        rest()

    cut = texts.select("id", "row", "text", "spans").mapInArrow(run, "id bigint, row bigint, n_removed bigint, kept_sha256 string, kept_text string")
    cut = materialize(cut if with_text else cut.drop("kept_text"), "cut")
    joined = rows.join(sized(cut, 128) if not with_text else cut.hint("shuffle_hash"), ["id", "row"], "left")
    own = [F.when(F.col("id") != _LAST, F.col("id")).alias(id_col), "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("kept_sha256", "words_sha256").alias("kept_sha256")]
    if with_text:
        plain = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", " "))
        joined = joined.join(source, ["id", "row"])
        own.append(F.coalesce("kept_text", plain).alias("kept_text"))
    result = materialize(joined.select(*own), "deduplicated")
    release(rows, covered, cut)
    return result
