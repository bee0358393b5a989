"""Language identification by hyperdimensional profiles (operator 6)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_sample, kept, label_split, map_text

DIMENSIONS = 1024
LETTERS = 3
#: Documents whose vectors are bundled at once: bounds the count matrix.
ROWS = 128
#: Letters of documents that are counted at once.
BATCH_LETTERS = 2_000_000
#: Distinct n-grams that are multiplied at once.
GRAMS = 8192
#: Labelled documents that prototypes are bundled from, at most (a bounded sample).
TRAIN_DOCS = 20_000
FOLDS, HELD_FOLD = 5, 0
#: Told when a text has no letter.
UNDETERMINED = "und"

#: Bits of a letter's number in an n-gram's key, and in the table used while there are few letters.
BITS, BITS_SMALL = 20, 7

_SPACE = 32
_fold: list[np.ndarray] = []


def _folding() -> np.ndarray:
    """For each code point: its lower-case letter, or a space if it is no letter."""
    if not _fold:
        table = np.full(0x110000, _SPACE, np.uint32)
        for k in range(0x110000):
            if chr(k).isalpha():
                low = chr(k).lower()
                table[k] = ord(low) if len(low) == 1 else k
        _fold.append(table)
    return _fold[0]


def letters(text: str | None) -> np.ndarray:
    """Lower-case letters; each run of anything else is one space, and so are both ends."""
    codes = _folding()[np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), "<u4")]
    codes = np.concatenate([[_SPACE], codes, [_SPACE]]).astype(np.uint32)
    space = codes == _SPACE
    return codes[np.r_[True, ~(space[1:] & space[:-1])]]


class Space:
    """Random bipolar letter vectors, and n-gram vectors bound from them when first met.

    Letters and n-grams get numbers as they are met, so n-grams are counted without sorting.
    """

    def __init__(self, dimensions: int, size: int):
        self.dimensions, self.size = dimensions, size
        self.forget()

    def forget(self) -> None:
        """Bounds a worker's memory: bound vectors follow from the letters alone, and can be made again."""
        self.letter_number = np.full(0x110000, -1, np.int64)
        self.vectors: list[np.ndarray] = []
        self.gram_row: dict[int, int] = {}
        self.table = np.zeros(0, np.int32)
        self.grams = np.zeros((GRAMS, self.dimensions), np.int8)

    def numbered(self, codes: np.ndarray) -> np.ndarray:
        out = self.letter_number[codes]
        if (out < 0).any():
            for code in np.unique(codes[out < 0]).tolist():
                bits = np.random.default_rng([20_240_501, code]).integers(0, 2, self.dimensions)
                self.letter_number[code] = len(self.vectors)
                self.vectors.append((2 * bits - 1).astype(np.int8))
            out = self.letter_number[codes]
        return out

    def bind(self, key: int) -> int:
        """The row of a new n-gram: each letter's vector is rotated by its place, and all multiplied."""
        bound = np.ones(self.dimensions, np.int8)
        for place in range(self.size):
            bound = bound * np.roll(self.vectors[(key >> (BITS * place)) & ((1 << BITS) - 1)], place)
        at = self.gram_row[key] = len(self.gram_row)
        if at >= len(self.grams):
            self.grams = np.concatenate([self.grams, np.zeros_like(self.grams)])
        self.grams[at] = bound
        return at

    def rows(self, keys: np.ndarray) -> np.ndarray:
        """The rows of n-grams; by a table while there are few letters, else by their distinct keys."""
        if len(self.vectors) <= 1 << (BITS_SMALL):
            if not len(self.table):
                self.table = np.full(1 << (BITS_SMALL * self.size), -1, np.int32)
            short = np.zeros(len(keys), np.int64)
            for place in range(self.size):
                short |= ((keys >> (BITS * place)) & ((1 << BITS) - 1)) << (BITS_SMALL * place)
            out = self.table[short]
            if (out < 0).any():
                new, first = np.unique(short[out < 0], return_index=True)
                for s, key in zip(new.tolist(), keys[out < 0][first].tolist(), strict=True):
                    self.table[s] = self.gram_row.get(key, -1) if key in self.gram_row else self.bind(key)
                out = self.table[short]
            return out
        distinct, inverse = np.unique(keys, return_inverse=True)
        return np.array([self.gram_row[k] if k in self.gram_row else self.bind(k) for k in distinct.tolist()])[inverse]

    def bundle(self, texts: list[str | None]) -> np.ndarray:
        """The sum of each text's n-gram vectors; zeros for a text without letters."""
        out = np.zeros((len(texts), self.dimensions), np.float32)
        at = 0
        while at < len(texts):
            if len(self.gram_row) > 4 * GRAMS or len(self.vectors) >= 1 << (BITS - 1):
                self.forget()
            keys, doc, n, begin = [], [], 0, at
            while at < len(texts) and (at == begin or (at - begin < ROWS and n + len(texts[at] or "") < BATCH_LETTERS)):
                codes = self.numbered(letters(texts[at]))
                if len(codes) > self.size - 1 and len(codes) > 1:
                    key = np.zeros(len(codes) - self.size + 1, np.int64)
                    for place in range(self.size):
                        key |= codes[self.size - 1 - place : len(codes) - place] << (BITS * place)
                    keys.append(key)
                    doc.append(np.full(len(key), at - begin))
                    n += len(key)
                at += 1
            if not keys:
                continue
            row, doc = self.rows(np.concatenate(keys)), np.concatenate(doc)
            used = np.flatnonzero(np.bincount(row))
            place = np.zeros(used[-1] + 1, np.int64)
            place[used] = np.arange(len(used))
            column = place[row]
            for low in range(0, len(used), GRAMS):
                some = used[low : low + GRAMS]
                there = slice(None) if len(used) <= GRAMS else (column >= low) & (column < low + GRAMS)
                cells = np.bincount(doc[there] * len(some) + column[there] - low, minlength=(at - begin) * len(some))
                out[begin:at] += cells.reshape(at - begin, len(some)).astype(np.float32) @ self.grams[some].astype(np.float32)
        return out


def _space(dimensions: int, size: int) -> Space:
    return kept((Space, dimensions, size), lambda: Space(dimensions, size))


def _unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.maximum(np.linalg.norm(vectors, axis=-1, keepdims=True), 1e-12)


class Profiles:
    """A prototype vector for each language, and the scale that turns cosines into a score."""

    def __init__(self, names: list[str], vectors: np.ndarray, dimensions: int, size: int):
        self.names, self.dimensions, self.size = names, dimensions, size
        self.vectors = _unit(vectors.astype(np.float32))

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """The language of greatest cosine, and that cosine (0 if it is negative)."""
        bundles = _space(self.dimensions, self.size).bundle(texts)
        silent = ~bundles.any(axis=1)
        if not self.names:
            return [UNDETERMINED] * len(texts), [0.0] * len(texts)
        cosine = _unit(bundles) @ self.vectors.T
        best = cosine.argmax(axis=1)
        top = np.clip(cosine[np.arange(len(texts)), best], 0, 1).astype(np.float64)
        named = [UNDETERMINED if s else self.names[b] for s, b in zip(silent.tolist(), best.tolist(), strict=True)]
        return named, np.where(silent, 0.0, top).tolist()


def learn(
    docs: DataFrame,
    train_docs: int = TRAIN_DOCS,
    dimensions: int = DIMENSIONS,
    size: int = LETTERS,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
) -> Profiles:
    """Bundles prototypes from the text and non-null language of rows outside the held-out fold.

    At most about ``train_docs`` rows are bundled: a sample picked by a hash of the id. Each
    document counts alike, whatever its length. Tasks return one vector for each language, which
    are summed by (language, dimension), so what reaches the driver depends on neither rows nor
    tasks. Rows of a null id have no fold and are not learned from, nor are those of a null
    language; repeated rows each count, and null or empty texts add nothing. Columns are taken by
    name, so others do not matter. From an empty table no language is learned.
    """
    usable = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"), F.col(lang_col).cast("string").alias("__lang"))
    usable = usable.where(F.col("__lang").isNotNull() & (label_split("__id", FOLDS) != HELD_FOLD))

    def bundled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space, sums = _space(dimensions, size), {}
        for batch in batches:
            langs = np.array(batch.column(1).to_pylist(), object)
            vectors = _unit(space.bundle(batch.column(0).to_pylist()))
            for lang in set(langs.tolist()):
                sums[lang] = sums.get(lang, 0) + vectors[langs == lang].sum(axis=0, dtype=np.float64)
        for lang, vector in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * dimensions), pa.array(range(dimensions), pa.int32()), pa.array(vector)], names=["lang", "at", "value"]
            )

    sample = bounded_sample(usable, train_docs, "__id")
    summed = sample.select("__text", "__lang").mapInArrow(bundled, "lang string, at int, value double").groupBy("lang", "at").agg(F.sum("value").alias("value"))
    rows = summed.collect()
    names = sorted({r["lang"] for r in rows})
    vectors = np.zeros((len(names), dimensions))
    for r in rows:
        vectors[names.index(r["lang"]), r["at"]] = r["value"]
    return Profiles(names, vectors, dimensions, size)


def predict(docs: DataFrame, profiles: Profiles, carry: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """``carry``, ``lang_pred`` and ``score`` (the cosine with the language's prototype).

    A text that is null, empty or without letters gets ``und`` and 0, and so does every text if no
    language was learned. Of languages at one cosine, the first by name is told. Whole texts
    count; very long ones make a slice of their own. Rows are kept as they are, repeated ones and
    null ids too, without a shuffle; input columns named like the two outputs are replaced.
    """
    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    return map_text(docs, lambda: profiles.predict, fields, text_col, carry)
