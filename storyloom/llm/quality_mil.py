"""Quality scores by attention-based multiple-instance learning (operator 2).

A document is a bag of passages of consecutive words. Each passage is encoded from its words, by a
learned embedding of their hashed uni- and bigrams, and from what it looks like. A gate
``tanh(V h) * sigmoid(U h)`` gives it an attention weight, and the document's score is a logistic
function of the weighted passage representation. Only documents carry labels.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass
from operator import eq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_sample, label_split, map_text

PASSAGE_WORDS = 64
#: Labelled documents the model is fitted on, and characters of theirs, at most (a bounded sample picked by a hash of the id).
TRAIN_DOCS, TRAIN_CHARS = 6000, 48_000_000
CUT = 0.3
FOLDS, HELD_FOLD = 5, 0
#: Characters whose shares are features of a passage.
MARKS = ("#", "*", "$", "%", "&", "|", "<>", "!", "?", ".", ",", ";:", "@/\\", "()[]{}", "-_=+~", "0123456789", "'\"`")
N_LOOKS = 10 + len(MARKS)
#: Rows of the embedding: n-grams are dealt to them by a hash, each with a sign.
BUCKETS = 256
N_FEATURES = N_LOOKS + BUCKETS
#: Passages that are encoded at once, and hashes of words a worker remembers.
ENCODED, MEMO = 4096, 400_000


class Hashes(dict):
    """The hash of each word, kept once it was asked for."""

    def __missing__(self, word: str) -> int:
        if len(self) > MEMO:
            self.clear()
        made = self[word] = zlib.crc32(word.encode("utf-8", "surrogatepass"))
        return made


def looks(words: list[str], low: list[str]) -> list[float]:
    """What a passage looks like: lengths, repetition, letter case, and shares of marks."""
    n, text = len(words), " ".join(words)
    size = len(text)
    kinds = set(low)
    return [
        np.log1p(n),
        (size - n + 1) / n,
        len(kinds) / n,
        sum(map(eq, low[1:], low)) / n,
        len(set(zip(low, low[1:], strict=False))) / n,
        sum(map(str.isupper, words)) / n,
        sum(map(str.istitle, words)) / n,
        sum(map(str.isalpha, words)) / n,
        len(set(text)) / min(size, 64),
        max(map(len, words)) / 16,
        *(100 * sum(map(text.count, marks)) / size for marks in MARKS),
    ]


@dataclass
class Bag:
    """The passages of a document: their looks, and the hashes of their words one after another."""

    looks: np.ndarray
    hashes: np.ndarray

    @property
    def sizes(self) -> np.ndarray:
        """How many words each passage has."""
        n, k = len(self.hashes), len(self.looks)
        return np.minimum(PASSAGE_WORDS, n - PASSAGE_WORDS * np.arange(k))


def bag_of(text: str | None, hashes: Hashes) -> Bag:
    """All passages of a whole text; one of no words if it has none."""
    words = (text or "").split()
    if not words:
        return Bag(np.zeros((1, N_LOOKS), np.float32), np.zeros(0, np.uint32))
    low = [w.lower() for w in words]
    cuts = range(0, len(words), PASSAGE_WORDS)
    made = [looks(words[k : k + PASSAGE_WORDS], low[k : k + PASSAGE_WORDS]) for k in cuts]
    return Bag(np.array(made, np.float32), np.fromiter(map(hashes.__getitem__, low), np.uint32, len(low)))


def features(bags: list[Bag]) -> np.ndarray:
    """Of all passages of some bags: their looks, and signed counts of their n-grams by bucket, over the root of their words."""
    sizes = np.concatenate([b.sizes for b in bags])
    word = np.concatenate([b.hashes for b in bags]).astype(np.uint64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    same = row[1:] == row[:-1] if len(row) else np.zeros(0, bool)
    pair = (word[:-1] * np.uint64(0x9E3779B1) + word[1:])[same] if len(row) else word
    gram, row = np.concatenate([word, pair]), np.concatenate([row, row[:-1][same] if len(row) else row])
    gram = gram * np.uint64(0x9E3779B97F4A7C15)
    gram ^= gram >> np.uint64(32)
    bucket, sign = (gram % np.uint64(BUCKETS)).astype(np.int64), 1.0 - 2.0 * ((gram >> np.uint64(20)) & np.uint64(1)).astype(float)
    counts = np.bincount(row * BUCKETS + bucket, sign, len(sizes) * BUCKETS).reshape(len(sizes), BUCKETS)
    counts = counts / np.sqrt(np.maximum(sizes, 1))[:, None]
    return np.concatenate([np.concatenate([b.looks for b in bags]), counts.astype(np.float32)], axis=1)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Model:
    """Weights: the encoder (E, e), the gates (V, U, w) and the classifier (c, d)."""

    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Passages as the encoder takes them, and their representations."""
        x = np.clip((x - self.mean) / self.scale, -8, 8)
        return x, np.tanh(x @ self.weights["E"] + self.weights["e"])

    def attend(self, h: np.ndarray, starts: np.ndarray) -> dict[str, np.ndarray]:
        """Weights of passages, and scores of the bags that begin at ``starts``."""
        p, sizes = self.weights, np.diff(np.r_[starts, len(h)])
        t, s = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        raw = (t * s) @ p["w"]
        weight = np.exp(raw - np.repeat(np.maximum.reduceat(raw, starts), sizes))
        weight /= np.repeat(np.add.reduceat(weight, starts), sizes)
        z = np.add.reduceat(h * weight[:, None], starts)
        return {"sizes": sizes, "t": t, "s": s, "weight": weight, "z": z, "score": _sigmoid(z @ p["c"] + p["d"])}

    def forward(self, x: np.ndarray, starts: np.ndarray) -> dict[str, np.ndarray]:
        x, h = self.encode(x)
        return {"x": x, "h": h, **self.attend(h, starts)}

    def gradient(self, x: np.ndarray, starts: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        p, f = self.weights, self.forward(x, starts)
        error = (f["score"] - labels) / len(labels)
        dz = np.repeat(error[:, None] * p["c"], f["sizes"], axis=0)
        pull = (dz * f["h"]).sum(axis=1)
        mean = np.repeat(np.add.reduceat(f["weight"] * pull, starts), f["sizes"])
        draw = f["weight"] * (pull - mean)
        gate = draw[:, None] * p["w"]
        dt, ds = gate * f["s"] * (1 - f["t"] ** 2), gate * f["t"] * f["s"] * (1 - f["s"])
        dh = f["weight"][:, None] * dz + dt @ p["V"].T + ds @ p["U"].T
        dx = dh * (1 - f["h"] ** 2)
        return {
            "E": f["x"].T @ dx, "e": dx.sum(axis=0), "V": f["h"].T @ dt, "U": f["h"].T @ ds,
            "w": (f["t"] * f["s"]).T @ draw, "c": f["z"].T @ error, "d": error.sum(keepdims=True),
        }

    def score(self, texts: list[str | None], hashes: Hashes | None = None) -> tuple[list[float], list[float], list[int]]:
        """Score, greatest attention weight, and the number of passages of each text."""
        hashes = Hashes() if hashes is None else hashes
        bags = [bag_of(t, hashes) for t in texts]
        sizes = np.array([len(b.looks) for b in bags])
        starts, encoded, held, n = np.cumsum(sizes) - sizes, [], [], 0
        for bag in bags:
            held.append(bag)
            n += len(bag.looks)
            if n >= ENCODED:
                encoded.append(self.encode(features(held))[1])
                held, n = [], 0
        if held:
            encoded.append(self.encode(features(held))[1])
        f = self.attend(np.concatenate(encoded), starts)
        return f["score"].tolist(), np.maximum.reduceat(f["weight"], starts).tolist(), sizes.tolist()


def fit(bags: list[np.ndarray], labels: list[int], hidden: int = 16, gates: int = 8, epochs: int = 40, batch: int = 64) -> Model:
    """Fits by Adam on the logistic loss, with a little weight decay; the same bags give the same model.

    A bag holds the features of a document's passages, a row for each. Without any bag the model knows nothing.
    """
    random = np.random.default_rng(7)
    if not bags:
        bags, labels = [np.zeros((1, N_FEATURES), np.float32)] * 2, [0, 1]
    every = np.concatenate(bags)
    n = every.shape[1]
    shape = {"E": (n, hidden), "e": (hidden,), "V": (hidden, gates), "U": (hidden, gates), "w": (gates,), "c": (hidden,), "d": (1,)}
    weights = {k: random.normal(0, 1 / np.sqrt(s[0]), s).astype(np.float32) if k not in "ed" else np.zeros(s, np.float32) for k, s in shape.items()}
    model = Model(every.mean(axis=0), every.std(axis=0) + np.float32(1e-3), weights)
    known = np.array(labels, np.float32)
    sizes = np.array([len(b) for b in bags])
    ends = np.cumsum(sizes)
    first, second = ({k: np.zeros(s, np.float32) for k, s in shape.items()} for _ in range(2))
    step = 0
    for epoch in range(epochs):
        order = random.permutation(len(bags))
        rate = 0.01 * (1 - epoch / epochs) + 1e-4
        for at in range(0, len(order), batch):
            some = order[at : at + batch]
            rows = np.concatenate([np.arange(ends[k] - sizes[k], ends[k]) for k in some])
            grad = model.gradient(every[rows], np.cumsum(sizes[some]) - sizes[some], known[some])
            step += 1
            for k, g in grad.items():
                g = g + 1e-4 * weights[k]
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                weights[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return model


def learn(
    docs: DataFrame,
    labels: DataFrame,
    train_docs: int = TRAIN_DOCS,
    train_chars: int = TRAIN_CHARS,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
) -> Model:
    """Fits on about ``train_docs`` labelled rows outside the held-out fold at most, and ``train_chars`` characters.

    The sample of ids is picked before any text is read and is small, so texts of other rows are
    never shuffled; if its texts are longer than allowed together, it is made smaller, and every
    passage of a document in it counts. Passages are read on the executors. Null labels and null
    ids are not used; of an id with two labels, the greater holds; rows that share an id are each
    learned from, as are null and empty texts. Columns are taken by name, so others do not matter.
    """
    known = labels.select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__label")).where(
        F.col("__label").isNotNull() & (label_split("__id", FOLDS) != HELD_FOLD)
    )
    chosen = bounded_sample(known, train_docs, "__id").groupBy("__id").agg(F.max("__label").alias("__label"))
    source = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text"))
    texts = source.join(F.broadcast(chosen), "__id")
    rows, chars = texts.agg(F.count(F.lit(1)), F.sum(F.length("__text"))).first()
    if (chars or 0) > train_chars:
        texts = source.join(F.broadcast(bounded_sample(chosen, int(rows * train_chars / chars), "__id")), "__id")

    def function():
        hashes = Hashes()

        def of(texts):
            made = [bag_of(t, hashes) for t in texts]
            return [m.looks.tobytes() for m in made], [m.hashes.tobytes() for m in made]

        return of

    kinds = [T.StructField("looks", T.BinaryType()), T.StructField("hashes", T.BinaryType())]
    found = map_text(texts, function, kinds, "__text", ["__id", "__label"]).toPandas()
    found = found.sort_values(["__id", "hashes", "looks"], kind="stable")
    bags = [features([Bag(np.frombuffer(a, np.float32).reshape(-1, N_LOOKS), np.frombuffer(b, np.uint32))]) for a, b in zip(found["looks"], found["hashes"], strict=True)]
    return fit(bags, found["__label"].tolist())


def score(docs: DataFrame, model: Model, carry: tuple[str, ...] = ("doc_id",), cut: float = CUT, text_col: str = "text") -> DataFrame:
    """``carry``, ``score`` (0 to 1), ``predicted`` and, of the passages, the greatest weight and count.

    Every passage of a whole text counts, however long it is. A null or empty text is one blank
    passage and gets the score of one. Rows are kept as they are, repeated ones and null ids too,
    without a shuffle; input columns named like an output are replaced.
    """

    fields = [T.StructField("score", T.DoubleType()), T.StructField("top_weight", T.DoubleType()), T.StructField("n_passages", T.IntegerType())]
    def function():
        hashes = Hashes()
        return lambda texts: model.score(texts, hashes)

    scored = map_text(docs, function, fields, text_col, carry)
    return scored.withColumn("predicted", F.when(F.col("score") >= cut, 1).otherwise(0))
