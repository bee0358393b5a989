"""Toxicity by the nearest labelled examples under exact TF-IDF cosine (operator 7).

1. The vocabulary is what the examples' labels tell apart: terms that label 1 holds more often than
   chance allows. Over all terms, neighbours are alike in topic and hardly in label (README has figures).
2. Examples become TF-IDF vectors over the vocabulary in a block-max inverted index.
3. Each text's nearest examples vote, by a power of their similarity; a logistic function fitted to such
   votes of all other examples on each example makes scores of them. They are the evidence, too.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_sample, label_split, map_text, materialize, release

#: Labelled documents that become examples, at most (a bounded sample picked by a hash of the id).
EXAMPLES = 8000
NEIGHBOURS = 15
#: Examples of a block of the index.
BLOCK = 64
#: Cells of the matrix of queries that are looked up at once.
QUERY_CELLS = 2_000_000
#: Least share of the examples that hold a term whose weights stand in the matrix.
COMMON = 1 / 32
#: Blocks that each query opens first, and more than single precision can err in a similarity.
FIRST_BLOCKS, MARGIN = 2, 1e-4
#: Least G statistic of the terms of the vocabulary (chance gives it to one of a hundred), and examples that hold each, copies counting once.
MIN_G, LEAST_HELD = 6.63, 4
#: The power of a neighbour's similarity that is its weight in a vote.
STEEP = 4
CUT = 0.3
FOLDS, HELD_FOLD = 4, 2
#: Sums of shares of copies below this are rounding errors.
LEAST_CELL = 1e-9
#: Weight of the overall share of label 1 in a vote, in neighbours of similarity 1.
PRIOR = 0.5
#: Tasks among which the examples are dealt that all others vote on.
CALIBRATION_TASKS = 32
#: Distinct chunks of text whose term a worker remembers.
MEMO = 400_000
_STRIP = " \t\n.,;:!?\"'()[]{}<>*#$%&|/\\-_=+~`@^«»¡¿…"


class Terms(dict):
    """The term of each chunk of text, kept once it was asked for: in lower case, without marks at its ends."""

    def __missing__(self, chunk: str) -> str:
        if len(self) > MEMO:
            self.clear()
        made = self[chunk] = chunk.lower().strip(_STRIP)
        return made


def term_counts(text: str | None, memo: dict[str, str]) -> Counter:
    """How often each term stands in a text; chunks of marks alone are none."""
    memo = memo if isinstance(memo, Terms) else Terms(memo)
    chunks = Counter((text or "").split())
    out: Counter = Counter()
    get = out.get
    for term, n in zip(map(memo.__getitem__, chunks), chunks.values(), strict=True):
        out[term] = get(term, 0) + n
    out.pop("", None)
    return out


def copy_key(text: str | None) -> int:
    """The least hash of a text's 3-word windows: near copies mostly share it, other texts do not."""
    words = (text or "").lower().encode("utf-8", "surrogatepass").split()
    return min((zlib.crc32(b" ".join(w)) for w in zip(words, words[1:], words[2:], strict=False)), default=-len(words))


def g_statistic(a: np.ndarray, n1: float, b: np.ndarray, n0: float) -> np.ndarray:
    """Of terms in ``a`` of ``n1`` rows of label 1 and ``b`` of ``n0`` others; below 0 if rarer in label 1."""
    total, held, g = n1 + n0, a + b, np.zeros(len(a))
    for x, e in ((a, n1 * held), (b, n0 * held), (n1 - a, n1 * (total - held)), (n0 - b, n0 * (total - held))):
        some = (x > LEAST_CELL) & (e > LEAST_CELL)
        g[some] += 2 * x[some] * np.log(x[some] * total / e[some])
    return np.where(a * n0 >= b * n1, g, -g)


def calibration(shares: np.ndarray, labels: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and offset of the logistic function of a share's logit that fits labels best; (1, 0) if nothing can be told."""
    if len(shares) < 20 or labels.min() == labels.max():
        return 1.0, 0.0
    x, y = np.stack([_logit(shares), np.ones(len(shares))], axis=1), labels.astype(float)
    fit = np.array([1.0, 0.0])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ fit, -30, 30)))
        bent = (x * (p * (1 - p))[:, None]).T @ x + np.diag([1e-2, 1e-2])  # a little ridge towards (1, 0)
        step = np.linalg.solve(bent, x.T @ (y - p) - 1e-2 * (fit - np.array([1.0, 0.0])))
        fit = fit + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return (float(fit[0]), float(fit[1])) if fit[0] > 0 else (1.0, 0.0)


def _logit(share):
    share = np.clip(share, 1e-6, 1 - 1e-6)
    return np.log(share / (1 - share))


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers from each start on, ``lengths`` of them, one range after another."""
    return np.arange(lengths.sum()) + np.repeat(starts - np.cumsum(lengths) + lengths, lengths)


class Index:
    """A block-max inverted index of labelled examples over the terms of the vocabulary.

    Terms that few examples hold have postings by example, so what they add to each similarity is
    known at once; the weights of the others stand in one matrix, with their greatest by block of
    examples. The bound of a block is the most that the former give there plus what the query's
    other terms could reach at most. Each query opens its most promising blocks, and then every
    block whose bound is not below its k-th best similarity by then. Sums are in single precision
    with a margin; what is left is summed again in double precision, so the neighbours are exact.

    Examples are (id, terms, label, copy key). All that share a key count as one document in the
    statistics of terms, so a text that was copied often does not make its words telling. Terms of
    a G statistic of ``min_g`` or more that ``LEAST_HELD`` examples hold are the vocabulary; ``min_g`` of None
    takes all that are there.
    """

    def __init__(self, examples: list[tuple[int, Counter, int, int]], min_g: float | None = MIN_G, block: int = BLOCK):
        names = sorted({t for _, terms, *_ in examples for t in terms})
        number = {t: k for k, t in enumerate(names)}
        terms = np.array([number[t] for _, held, *_ in examples for t in held], np.int64)
        counts = np.array([n for _, held, *_ in examples for n in held.values()], float)
        lengths = np.array([len(held) for _, held, *_ in examples], np.int64)
        ids, labels, keys = (np.array([e[k] for e in examples], np.int64) for k in (0, 2, 3))
        self._fill(ids, labels, keys, lengths, terms, counts, names, min_g, block)

    @classmethod
    def of_table(cls, rows: pa.Table, min_g: float | None = None, block: int = BLOCK) -> Index:
        """From columns ``__id``, ``__label``, ``key``, ``terms`` and ``counts``: no Python object for each term of each example."""
        rows = rows.sort_by([("__id", "ascending"), ("key", "ascending")]).combine_chunks()
        columns = {name: rows[name].combine_chunks() for name in rows.column_names}
        coded = pc.dictionary_encode(columns["terms"].flatten())
        names = np.array(coded.dictionary.to_pylist(), object)
        order = np.argsort(names)
        number = np.empty(len(names), np.int64)
        number[order] = np.arange(len(names))
        index = cls.__new__(cls)
        index._fill(
            columns["__id"].to_numpy(), (columns["__label"].to_numpy() > 0).astype(np.int64), columns["key"].to_numpy(),
            pc.list_value_length(columns["terms"]).to_numpy().astype(np.int64), number[coded.indices.to_numpy()] if len(names) else np.zeros(0, np.int64),
            columns["counts"].flatten().to_numpy().astype(float), names[order].tolist(), min_g, block,
        )
        return index

    def _fill(self, ids, labels, keys, lengths, terms, counts, names, min_g, block):  # noqa: PLR0913
        _, key, copies = np.unique(keys, return_inverse=True, return_counts=True)
        row, one = np.repeat(np.arange(len(ids)), lengths), 1 / copies[key]
        yes, no = (np.bincount(terms, (one * y)[row], len(names)) for y in (labels, 1 - labels))
        n1 = float((one * labels).sum())
        self.share = float(labels.sum()) / max(1, len(ids))
        if min_g is not None:
            chosen = (g_statistic(yes, n1, no, len(copies) - n1) >= min_g) & (yes + no >= LEAST_HELD - LEAST_CELL)
            mine = chosen[terms]
            names = [t for t, good in zip(names, chosen.tolist(), strict=True) if good]
            yes, no, lengths = yes[chosen], no[chosen], np.bincount(row[mine], minlength=len(ids))
            row, terms, counts = row[mine], (np.cumsum(chosen) - 1)[terms[mine]], counts[mine]
        self.term = {t: k for k, t in enumerate(names)}
        self.idf = np.log((1 + len(copies)) / (1 + yes + no)) + 1
        silent = labels[lengths == 0]
        #: The share of label 1 among examples that hold no term of the vocabulary: the score of a text that holds none.
        self.silent = (float(silent.sum()) + PRIOR * self.share) / (len(silent) + PRIOR)
        weights = (1 + np.log(counts)) * self.idf[terms]
        weights /= np.maximum(np.sqrt(np.bincount(row, weights**2, len(ids))), 1e-12)[row]
        held = np.bincount(terms, minlength=len(names))
        self.common = np.flatnonzero(held >= max(2, COMMON * len(ids)))
        # of like examples side by side: by the telling-most of their common terms, and then by copies
        leader = np.full(len(ids), len(names))
        usual = np.flatnonzero(np.isin(terms, self.common))
        usual = usual[np.lexsort((-weights[usual], row[usual]))]
        some, first = np.unique(row[usual], return_index=True)
        leader[some] = terms[usual[first]]
        order = np.lexsort((ids, keys, leader))
        order = order[lengths[order] > 0]
        at = _ranges((np.cumsum(lengths) - lengths)[order], lengths[order])
        self.ids, self.labels = ids[order], labels[order].astype(float)
        self.lengths = lengths[order]
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.terms, self.weights = terms[at].astype(np.int32), weights[at]
        self.block, self.blocks = block, -(-len(order) // block)
        #: How a share of votes becomes a probability; see ``calibration``.
        self.slope, self.offset = 1.0, 0.0

    def _postings(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.argsort(self.terms, kind="stable")
        row = np.repeat(np.arange(len(self.ids), dtype=np.int32), self.lengths)[order]
        return np.searchsorted(self.terms[order], np.arange(len(self.term) + 1)), row, self.weights[order]

    @property
    def at(self) -> dict[int, np.ndarray]:
        """Of each term, the examples that hold it."""
        starts, row, _ = self._postings()
        return {t: row[starts[t] : starts[t + 1]] for t in range(len(self.term))}

    @property
    def weight(self) -> dict[int, np.ndarray]:
        """Of each term, its weights in these."""
        starts, _, weight = self._postings()
        return {t: weight[starts[t] : starts[t + 1]] for t in range(len(self.term))}

    def _matrix(self, chosen: np.ndarray, kind: type) -> tuple[np.ndarray, np.ndarray]:
        """Weights of the chosen terms by example, and the column of each term, -1 if it has none."""
        column = np.full(len(self.term), -1, np.int32)
        column[chosen] = np.arange(len(chosen))
        out, own = np.zeros((len(self.ids), len(chosen)), kind), column[self.terms]
        out[np.repeat(np.arange(len(self.ids)), self.lengths)[own >= 0], own[own >= 0]] = self.weights[own >= 0]
        return out, column

    def _open(self) -> None:
        """Makes what lookups need, once in each process: it is not broadcast."""
        if hasattr(self, "dense"):
            return
        self.dense, self.column = self._matrix(self.common, np.float32)
        self.top = np.array([self.dense[k : k + self.block].max(axis=0) for k in range(0, len(self.ids), self.block)], np.float32)
        self.posting, self.posted, self.posted_weight = self._postings()

    def vector(self, terms: Counter) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and weights of the terms of the vocabulary: (1 + log of the count) times the inverse document
        frequency, over the length of that vector."""
        at = np.fromiter(map(self.term.get, terms, repeat(-1)), np.int64, len(terms))
        weight = 1 + np.log(np.fromiter(terms.values(), float, len(terms)))
        known = at >= 0
        at = at[known]
        weight = weight[known] * self.idf[at]
        length = math.sqrt(weight @ weight)
        return at, weight / max(length, 1e-12)

    def nearest(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query, the ``k`` examples of greatest cosine above 0, and the cosines; ties go to the lower id."""
        if not len(self.ids):
            return [(np.zeros(0, np.int64), np.zeros(0))] * len(queries)
        self._open()
        step = max(1, QUERY_CELLS // len(self.ids))
        return [found for a in range(0, len(queries), step) for found in self._nearest(queries[a : a + step], k)]

    def _nearest(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        n, size = len(queries), len(self.ids)
        row = np.repeat(np.arange(n), [len(at) for at, _ in queries])
        term, weight = np.concatenate([at for at, _ in queries]), np.concatenate([w for _, w in queries])
        column = self.column[term]
        usual, rare = column >= 0, column < 0
        q = np.zeros((n, len(self.common)), np.float32)
        q[row[usual], column[usual]] = weight[usual]
        length = self.posting[term[rare] + 1] - self.posting[term[rare]]
        at = _ranges(self.posting[term[rare]], length)
        cell = np.repeat(row[rare] * size, length) + self.posted[at]
        score = np.bincount(cell, np.repeat(weight[rare], length) * self.posted_weight[at], n * size).astype(np.float32).reshape(n, size)
        edges = np.arange(0, size, self.block)
        bound = np.maximum.reduceat(score, edges, axis=1) + q @ self.top.T
        first = np.zeros(bound.shape, bool)
        np.put_along_axis(first, np.argsort(-bound, axis=1, kind="stable")[:, :FIRST_BLOCKS], True, axis=1)
        exact = np.full(score.shape, -1, np.float32)
        last = max(0, size - k)
        kth = np.full(n, -1, np.float32)
        for wanted in (first, None):
            if wanted is None:
                wanted = ~first & (bound >= kth[:, None] - MARGIN)
            for b in np.flatnonzero(wanted.any(axis=0)).tolist():
                rows, here = np.flatnonzero(wanted[:, b]), slice(b * self.block, (b + 1) * self.block)
                exact[rows, here] = score[rows, here] + q[rows] @ self.dense[here].T
            kth = np.partition(exact, last, axis=1)[:, last]
        out, full = [], np.zeros(len(self.term))
        for i, (at, w) in enumerate(queries):
            near = np.flatnonzero(exact[i] >= max(kth[i] - MARGIN, 0))
            if not len(near):
                out.append((near, np.zeros(0)))
                continue
            full[at] = w
            place = _ranges(self.starts[near], self.lengths[near])
            length = self.lengths[near]
            own = np.round(np.add.reduceat(full[self.terms[place]] * self.weights[place], np.cumsum(length) - length), 12)
            full[at] = 0
            order = np.lexsort((self.ids[near], -own))[:k]
            order = order[own[order] > 0]
            out.append((near[order], own[order]))
        return out

    def shares(self, texts: list[Counter], k: int = NEIGHBOURS, own: list[int] | None = None) -> list[tuple[float, list[int], list[float]] | None]:
        """For each text: the share of label 1 among votes, and its nearest examples; None if it holds no term of theirs.

        The nearest vote by a power of their similarity, and the overall share where few have a say.
        ``own`` are ids of examples that do not vote on themselves.
        """
        vectors = [self.vector(t) for t in texts]
        some = [i for i, (at, _) in enumerate(vectors) if len(at)]
        out: list[tuple[float, list[int], list[float]] | None] = [None] * len(texts)
        known, mine = [vectors[i] for i in some], [own[i] for i in some] if own is not None else None
        near = self.nearest(known, k + (own is not None))
        if mine is not None:
            near = [(f[keep][:k], s[keep][:k]) for (f, s), i in zip(near, mine, strict=True) for keep in [self.ids[f] != i]]
        for i, (found, score) in zip(some, near, strict=True):
            weight = score**STEEP
            share = (weight @ self.labels[found] + PRIOR * self.share) / (weight.sum() + PRIOR)
            out[i] = float(share), self.ids[found].tolist(), score.tolist()
        return out

    def vote(self, texts: list[Counter], k: int = NEIGHBOURS) -> list[tuple[float, list[int], list[float]]]:
        """For each text: the calibrated probability of label 1, and its nearest examples."""
        return [(self.calibrated(r[0]), *r[1:]) if r else (self.silent, [], []) for r in self.shares(texts, k)]

    def calibrated(self, share: float) -> float:
        return float(1 / (1 + math.exp(-max(-30.0, min(30.0, self.slope * float(_logit(share)) + self.offset)))))


def vocabulary(examples: DataFrame, min_g: float = MIN_G, least_held: int = LEAST_HELD) -> list[str]:
    """The terms of examples (``key``, ``__label``, ``terms``) that label 1 holds more often than chance allows.

    What ``g_statistic`` gives, as columns; all examples of a key count as one. The examples are a bounded sample, and so
    is what they hold.
    """
    copies = examples.groupBy("key").agg((1 / F.count(F.lit(1))).alias("one"))
    weighed = examples.join(copies.hint("shuffle_hash"), "key").select("one", (F.col("__label") > 0).cast("double").alias("y"), "terms")
    total, n1 = weighed.agg(F.sum("one"), F.sum(F.col("one") * F.col("y"))).first()
    if not total:
        return []
    counts = weighed.select("one", "y", F.explode("terms").alias("term")).groupBy("term").agg(F.sum(F.col("one") * F.col("y")).alias("a"), F.sum(F.col("one") * (1 - F.col("y"))).alias("b"))
    n0, a, b = total - n1, F.col("a"), F.col("b")
    g = F.lit(0.0)
    for x, e in ((a, n1 * (a + b)), (b, n0 * (a + b)), (n1 - a, n1 * (total - a - b)), (n0 - b, n0 * (total - a - b))):
        g = g + F.when((x > LEAST_CELL) & (e > LEAST_CELL), 2 * x * F.log(x * total / e)).otherwise(0.0)
    told = counts.where((a * n0 >= b * n1) & (a + b >= least_held - LEAST_CELL) & (g >= min_g))
    return [r.term for r in told.select("term").collect()]


def learn(
    docs: DataFrame,
    labels: DataFrame,
    examples: int = EXAMPLES,
    min_g: float = MIN_G,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
) -> Index:
    """Indexes at most about ``examples`` labelled rows outside the held-out fold.

    Ids are sampled before any text is read. Terms are counted and the vocabulary is chosen on the
    executors, and only its terms reach the driver, as Arrow columns. Then the executors let all others vote on each example, and a
    logistic function of these votes is fitted to the labels: by it, scores are probabilities.

    Null labels and null ids are not used; of an id with two labels, the greater holds. Rows that
    share an id are each an example, and a null or empty text is one without terms. Columns are
    taken by name, so others do not matter; from empty tables comes an index without examples.
    """
    known = labels.select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__label")).where(
        F.col("__label").isNotNull() & (label_split("__id", FOLDS) != HELD_FOLD)
    )
    chosen = bounded_sample(known, examples, "__id").groupBy("__id").agg(F.max("__label").alias("__label"))
    texts = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).join(F.broadcast(chosen), "__id")

    def function():
        memo = Terms()

        def of(texts):
            made = [term_counts(t, memo) for t in texts]
            return [list(m) for m in made], [list(m.values()) for m in made], [copy_key(t) for t in texts]

        return of

    kinds = [T.StructField("terms", T.ArrayType(T.StringType())), T.StructField("counts", T.ArrayType(T.IntegerType())), T.StructField("key", T.LongType())]
    counted = materialize(map_text(texts, function, kinds, "__text", ["__id", "__label"]), "examples")
    words = docs.sparkSession.sparkContext.broadcast(frozenset(vocabulary(counted, min_g)))

    def of_vocabulary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [[(t, n) for t, n in zip(terms, counts, strict=True) if t in words.value] for terms, counts in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)]
            made = [pa.array([[p[k] for p in own] for own in pairs], batch.column(3 + k).type) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *made], names=["__id", "__label", "key", "terms", "counts"])

    fields = ["__id", "__label", "key", "terms", "counts"]
    chosen_terms = materialize(counted.select(*fields).mapInArrow(of_vocabulary, counted.select(*fields).schema), "chosen")
    release(counted)
    counted = chosen_terms
    index = Index.of_table(counted.toArrow())
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def voted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [Counter(dict(zip(t, n, strict=True))) for t, n in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            shares = [None if r is None else r[0] for r in shared.value.shares(held, own=batch.column(0).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(shares, pa.float64()), batch.column(1)], names=["share", "label"])

    told = counted.select("__id", "__label", "terms", "counts").repartition(CALIBRATION_TASKS).mapInArrow(voted, "share double, label int")
    told = told.where(F.col("share").isNotNull()).toPandas()
    shared.unpersist()
    release(counted)
    index.slope, index.offset = calibration(told["share"].to_numpy(), (told["label"].to_numpy() > 0).astype(int))
    return index


def score(
    docs: DataFrame, index: Index, carry: tuple[str, ...] = ("doc_id",), k: int = NEIGHBOURS, cut: float = CUT, text_col: str = "text"
) -> DataFrame:
    """``carry``, ``score`` (0 to 1), ``predicted`` and the neighbours behind it, nearest first.

    ``neighbours`` holds the examples' ids and similarities: the evidence. A null or empty text,
    and any of which no example holds a term, scores what such examples do. Whole texts count. Rows are
    kept as they are, without a shuffle; input columns named like an output are replaced. The
    index holds a bounded number of examples, so its broadcast is bounded too.
    """
    shared = docs.sparkSession.sparkContext.broadcast(index)
    kind = T.ArrayType(T.StructType([T.StructField("id", T.LongType()), T.StructField("similarity", T.DoubleType())]))

    def function():
        memo = Terms()

        def of(texts):
            made = shared.value.vote([term_counts(t, memo) for t in texts], k)
            near = [[{"id": i, "similarity": s} for i, s in zip(ids, sims, strict=True)] for _, ids, sims in made]
            return [m[0] for m in made], near

        return of

    scored = map_text(docs, function, [T.StructField("score", T.DoubleType()), T.StructField("neighbours", kind)], text_col, carry)
    return scored.withColumn("predicted", F.when(F.col("score") >= cut, 1).otherwise(0))
