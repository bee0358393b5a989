"""N-gram Jaccard join by MinHash banding (operator 9).

1. Each text becomes its set of word n-grams (64-bit hashes), a MinHash signature and band
   hashes; texts of one n-gram set are one class, so exact copies are never compared.
2. Band hashes are shuffled; the members of each bucket are tied to its least member, and the
   connected components of those ties hold every candidate pair.
3. Inside a component all pairs are checked on their full n-gram sets. A large component is
   split by set size (sets of a link differ by less than the threshold) and into blocks; each
   pair of blocks is a task of bounded size, which gives counts and a forest, never the pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import join_back, map_text, materialize, release, row_keyed, sized
from .graph import components

WORDS = 5
THRESHOLD = 0.8
RECALL = 0.9999
#: Members of a component that are compared with each other at once, and their n-grams but for a single larger one.
BLOCK, BLOCK_GRAMS = 1024, 2_000_000
#: How a member takes part in a group: compared with all of it, or with those of the other side.
LEFT, RIGHT, WITHIN = 0, 1, 2
#: Bytes of a row's key in a join.
KEY_BYTES = 32
#: Columns of a block's incidence matrix at once.
COLUMNS = 4096

_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_BASE = np.uint64(0x9E3779B97F4A7C15)


def bands_and_rows(threshold: float, recall: float, most_rows: int = 5) -> tuple[int, int]:
    """The fewest bands of ``most_rows`` rows by which a pair at the threshold is met with ``recall``."""
    miss = 1 - threshold**most_rows
    return max(1, int(np.ceil(np.log(1 - recall) / np.log(miss)))), most_rows


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def shingles(texts: list[str | None], words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's word n-grams.

    Words are what ASCII white space parts. A text of fewer words has one n-gram, of all of them;
    a text without words has none.
    """
    import xxhash

    lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pa.array([t or "" for t in texts], pa.large_string())))
    coded = lists.values.dictionary_encode()
    distinct = np.array([xxhash.xxh64_intdigest(w) for w in coded.dictionary.to_pylist()], np.uint64)
    hashed = distinct[coded.indices.to_numpy()] if len(distinct) else np.zeros(0, np.uint64)
    ends = lists.offsets.to_numpy()
    blank = coded.dictionary.index("").as_py() if len(distinct) else -1
    empty = np.uint64(distinct[blank]) if blank >= 0 else None
    out = []
    for a, b in zip(ends.tolist(), ends[1:].tolist(), strict=False):
        own = hashed[a:b]
        if b - a == 1 and empty is not None and own[0] == empty:
            own = own[:0]
        n = min(words, len(own))
        if not n:
            out.append(own)
            continue
        value = np.full(len(own) - n + 1, n, np.uint64)
        for k in range(n):
            value = value * _BASE + own[k : len(own) - n + 1 + k]
        out.append(np.unique(_mix(value)))
    return out


def signature_function(bands: int, rows: int, words: int):
    """From texts: the set's key, its size, and one hash for each band."""
    random = np.random.default_rng(20_240_501)
    factor = random.integers(1, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    shift = random.integers(0, 1 << 63, bands * rows, dtype=np.uint64)

    def sign(texts):
        sets = shingles(texts, words)
        keys = [int.from_bytes(hashlib.md5(s.tobytes()).digest()[:8], "little", signed=True) for s in sets]
        sizes = [len(s) for s in sets]
        full = [k for k, n in enumerate(sizes) if n]
        made: list = [[] for _ in sets]
        if full:
            flat = np.concatenate([sets[k] for k in full])
            starts = np.cumsum([0, *(sizes[k] for k in full[:-1])])
            band = np.zeros((len(full), bands), np.uint64)
            for b in range(bands):
                value = np.full(len(full), b + 1, np.uint64)
                for k in range(b * rows, (b + 1) * rows):
                    least = np.minimum.reduceat(flat * factor[k] + shift[k], starts)
                    value = _mix(value * _BASE + least)
                band[:, b] = value
            for k, row in zip(full, band.view(np.int64).tolist(), strict=True):
                made[k] = row
        return keys, sizes, made

    return sign


def linked(sets: list[np.ndarray], left: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs of sets have a Jaccard similarity of ``threshold`` or more.

    ``left``: rows to compare with all rows. Only n-grams that two sets or more hold are laid
    out, a slice of columns at a time, so memory is bounded by the block and not by the texts.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    flat, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(flat, kind="stable")
    flat, row = flat[order], row[order]
    new = np.r_[True, flat[1:] != flat[:-1]]
    column = np.cumsum(new) - 1
    shared = np.bincount(column)[column] > 1
    row, column = row[shared], np.cumsum(new[shared]) - 1
    common = np.zeros((len(left), len(sets)), np.float32)
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(column, [at, at + COLUMNS])
        there = np.zeros((len(sets), COLUMNS), np.float32)
        there[row[a:b], column[a:b] - at] = 1
        common += there[left] @ there.T
    both = sizes[left][:, None] + sizes[None, :] - common
    return common >= threshold * both - 1e-6


def _verify(threshold: float):
    """Of rows sorted by group: each linked member's links there, and the root of its tree."""

    def block(nodes, copies, sides, sets) -> list[tuple[int, int, int]]:
        nodes, copies, sides = np.array(nodes, np.int64), np.array(copies, np.int64), np.array(sides)
        left, right = np.flatnonzero(sides != RIGHT), np.flatnonzero(sides == RIGHT)
        if len(nodes) < 2 or (sides != WITHIN).any() and not (len(left) and len(right)):
            return []
        yes = linked([np.frombuffer(s, "<u8") for s in sets], left, threshold)
        if len(right):
            yes[:, left] = False
        yes[np.arange(len(left)), left] = False
        links = np.zeros(len(nodes), np.int64)
        links[left] += yes @ copies
        if len(right):
            links[right] += (copies[left] @ yes)[right]
        root = list(range(len(nodes)))

        def top(k):
            while root[k] != k:
                root[k] = root[root[k]]
                k = root[k]
            return k

        for k, i in enumerate(left.tolist()):
            for j in np.flatnonzero(yes[k]).tolist():
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
        return [(int(nodes[k]), int(links[k]), int(nodes[top(k)])) for k in np.flatnonzero(links).tolist()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, out = None, ([], [], [], []), []

        def full():
            made = pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in zip(*out, strict=True)], names=["node", "links", "root"])
            out.clear()
            return made

        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for group, *values in zip(*columns, strict=True):
                if group != key:
                    out += block(*held)
                    key, held = group, ([], [], [], [])
                    if len(out) > 10_000:
                        yield full()
                if held[0] and held[0][-1] == values[0]:  # a repeated row of one id
                    continue
                for to, value in zip(held, values, strict=True):
                    to.append(value)
        out += block(*held)
        if out:
            yield full()

    return run


def _blocks(members: DataFrame, threshold: float, block: int, grams: int) -> DataFrame:
    """For each candidate class: the pairs of blocks it takes part in, as (group, side).

    A component of up to a quarter of ``block`` members and ``grams`` n-grams is one group. A
    larger one is cut by set size at steps of 1 / threshold, so a link lies within a step or
    between neighbours, and each step is cut by a hash into blocks: up to eight of that quarter,
    so that one component is the work of many tasks, and from there on of about ``block`` members,
    so that no more copies of sets are shuffled than need be. Where two different blocks meet, each
    member has a side.
    """
    small = max(1, block // 4)
    step = F.floor(F.log(F.col("n_shingles").cast("double")) / F.lit(float(-np.log(threshold)) * 1.000001))
    counted = members.withColumn("step", step.cast("long"))
    number = F.greatest(F.ceil(F.col("n") / block), F.least(F.lit(8), F.ceil(F.col("n") / small)), F.ceil(F.col("grams") / grams)).cast("long")
    sizes = counted.groupBy("comp", "step").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("grams"))
    whole = sizes.groupBy("comp").agg(
        F.sum("n").alias("total"),
        ((F.sum("n") <= small) & (F.sum("grams") <= grams)).alias("one"),
        F.map_from_entries(F.collect_list(F.struct("step", number.alias("blocks")))).alias("steps"),
    )
    joined = join_back(counted, whole, "comp", "total", members.count())

    def blocks(at):
        return F.coalesce(F.col("steps")[at], F.lit(0)).cast("long")

    mine = F.pmod(F.xxhash64("node", F.lit("block")), F.greatest(blocks(F.col("step")), F.lit(1)))

    def meet(at, i, j, side):
        return F.struct(F.xxhash64("comp", at, i, j, F.lit("pair")).alias("group"), side.alias("side"))

    def upto(n):
        return F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(F.array().cast("array<bigint>"))

    one_side, other_side, within = F.lit(LEFT), F.lit(RIGHT), F.lit(WITHIN)
    same = F.transform(
        upto(blocks(F.col("step"))),
        lambda j: meet(F.col("step") * 2, F.least(j, F.col("mine")), F.greatest(j, F.col("mine")), F.when(j < F.col("mine"), other_side).when(j > F.col("mine"), one_side).otherwise(within)),
    )
    above = F.transform(upto(blocks(F.col("step") + 1)), lambda j: meet(F.col("step") * 2 + 1, F.col("mine"), j, one_side))
    below = F.transform(upto(blocks(F.col("step") - 1)), lambda j: meet(F.col("step") * 2 - 1, j, F.col("mine"), other_side))
    alone = F.array(F.struct(F.xxhash64("comp", F.lit("whole")).alias("group"), within.alias("side")))
    pairs = F.when(F.col("one"), alone).otherwise(F.concat(same, above, below))
    return joined.withColumn("mine", mine).withColumn("pairs", pairs).drop("mine", "step", "steps", "one")


def join(
    docs: DataFrame,
    threshold: float = THRESHOLD,
    words: int = WORDS,
    recall: float = RECALL,
    block: int = BLOCK,
    id_col: str = "doc_id",
    text_col: str = "text",
    carry: tuple[str, ...] = (),
    grams: int = BLOCK_GRAMS,
    row_col: str | None = None,
) -> DataFrame:
    """Each row's ``class_id``, ``n_links`` and ``n_copies`` by n-gram Jaccard similarity.

    ``n_links`` counts the other rows whose n-gram sets have a similarity of ``threshold`` or
    more with its own, equal sets included; ``n_copies`` counts the rows of its set, itself
    included; ``class_id`` is the least id among all rows that links connect to it, and
    ``class_key`` names those rows even where no id is. A text without words links to none: its
    row is a class of its own, without a key. A row of a null id links like any other, but cannot
    name a class: where only such rows are connected, ``class_id`` is null. Rows that share an id
    are told apart by their texts. Repeated rows are kept; columns other than the id and those in
    ``carry`` are left out, whatever their names; an empty table gives an empty one. A very long
    text is one set as any other, and is compared in blocks of fewer members.

    ``row_col`` names a column with the place of each row (see ``row_keyed``); without it places are
    taken from the files that ``docs`` is read from. By its place one row of each n-gram set gives
    its text to the comparison, so a row that is repeated any number of times is read once.

    What no later step reads is deleted from the shared folder; the result stays there.
    """
    bands, rows = bands_and_rows(threshold, recall)
    # A text is found again by its row's place, which repeated rows and rows without an id have too.
    source = docs.select(
        F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text"), *[F.col(c).alias(f"__in_{c}") for c in carry], *([F.col(row_col).alias("__place")] if row_col else [])
    )
    source = source if row_col else row_keyed(source, "__place")
    source = source.withColumn("__key", F.xxhash64("__place.file", "__place.at")).drop("__place")
    more = [f"__in_{c}" for c in carry]
    fields = [T.StructField("node", T.LongType()), T.StructField("n_shingles", T.IntegerType()), T.StructField("bands", T.ArrayType(T.LongType()))]
    signed = materialize(map_text(source, lambda: signature_function(bands, rows, words), fields, "__text", ["__id", "__key", *more]), "signed")
    sets = signed.where("n_shingles > 0").groupBy("node").agg(
        F.count(F.lit(1)).alias("n_copies"), F.min("__id").alias("rep"), F.min(F.struct(F.col("__id").isNull(), "__id", "__key"))["__key"].alias("rep_key"),
        F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"),
    )
    sets = materialize(sets, "sets")

    keyed = sets.select("node", F.explode("bands").alias("key"))
    buckets = keyed.groupBy("key").agg(F.min("node").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1")
    ties = join_back(keyed, buckets, "key", "n", bands * sets.count()).where(F.col("node") != F.col("least")).select("node", "least")
    candidates = components(ties, "node", "least").withColumnRenamed("label", "comp")
    known = sets.select("node", "rep", "rep_key", "n_copies", "n_shingles")
    candidates = materialize(candidates.join(known.drop("rep"), "node"), "candidates")
    members = materialize(_blocks(candidates, threshold, block, grams), "members")

    def whole_sets():
        def of(texts):
            made = shingles(texts, words)
            return [int.from_bytes(hashlib.md5(s.tobytes()).digest()[:8], "little", signed=True) for s in made], [s.tobytes() for s in made]

        return of

    # The candidates grow with the table, so their texts are found by a shuffle at every size; others stay out of it where their keys are few.
    kept = sized(members.select(F.col("rep_key").alias("__key")), KEY_BYTES)
    texts = source.select("__key", "__text").join(kept, "__key", "left_semi").join(members.hint("shuffle_hash"), F.col("__key") == F.col("rep_key"))
    found = map_text(
        texts, whole_sets, [T.StructField("own", T.LongType()), T.StructField("set", T.BinaryType())], "__text", ["node", "n_copies", "pairs"]
    ).where("own = node")
    grouped = found.select(F.explode("pairs").alias("pair"), "node", "n_copies", "set").select("pair.group", "node", "n_copies", "pair.side", "set")
    verified = materialize(
        grouped.repartition("group").sortWithinPartitions("group", "node").mapInArrow(_verify(threshold), "node bigint, links bigint, root bigint"), "verified"
    )
    release(members, candidates)

    labels = components(verified.select("node", "root"), "node", "root")
    links = verified.groupBy("node").agg(F.sum("links").alias("links"))
    known = known.join(labels, "node", "left").join(links, "node", "left")
    known = materialize(known.select("node", "rep", "n_copies", "links", F.coalesce("label", "node").alias("label")), "known")
    named = known.groupBy("label").agg(F.min("rep").alias("class_id"), F.count(F.lit(1)).alias("n"))
    known_sets = known.count()
    classes = join_back(known, named, "label", "n", known_sets).select(
        "node", F.col("label").alias("class_key"), "class_id", (F.coalesce("links", F.lit(0)) + F.col("n_copies") - 1).alias("n_links"), "n_copies",
        F.col("n_copies").alias("n"),
    )
    own = [F.col("__id").alias(id_col)]
    more = [F.col(f"__in_{c}").alias(c) for c in carry]
    linked_rows = join_back(signed.where("n_shingles > 0").drop("n_shingles", "bands"), classes, "node", "n", signed.count())
    alone = signed.where("n_shingles = 0").select(
        *own, *more, F.col("__id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(1).cast("long").alias("n_copies"), F.lit(None).cast("long").alias("class_key")
    )
    result = materialize(linked_rows.select(*own, *more, "class_id", "n_links", "n_copies", "class_key").unionAll(alone), "classes")
    release(signed, sets, verified, known)
    return result
