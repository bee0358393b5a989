import random
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from storyloom.llm import host_rules, langid, maglev, quality_mil, toxicity
from storyloom.llm.queries import oracle_sql


def prose(rng, n, kinds):
    return " ".join(rng.choice(kinds) for _ in range(n))


def test_measures_against_their_definitions(odd):
    import re

    def slow(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
        many = {w for w, n in Counter(windows).items() if n > 1}
        repeated = {k + j for k, w in enumerate(windows) if w in many for j in range(3)}
        lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), sum(x in lines[:k] for k, x in enumerate(lines)), len(repeated)

    texts = [r.text for r in odd.collect()] + ["a b c a b c x\n\na b\na b\n", "z z z z", "a b c d a b c", "\x1c \x85　x"]
    assert [host_rules.measures(t) for t in texts] == [slow(t) for t in texts]


def test_hosts(spark, odd, empty):
    assert host_rules.evaluate(empty).count() == 0
    assert host_rules.evaluate(odd).count() == odd.count()
    words = " ".join(f"w{k}" for k in range(60))
    rows = [(k, words, "good") for k in range(80)] + [(100 + k, "short", "bad") for k in range(80)] + [(200, words, "bad"), (201, words, "new"), (202, "x", "new"), (203, words, None)]
    found = {r.doc_id: r for r in host_rules.evaluate(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()}
    assert found[0].kept and not found[100].kept and not found[200].kept and not found[200].base_failed
    assert found[201].kept and 0.4 < found[201].host_rate < 0.6 and found[203].kept
    hosts = spark.createDataFrame([("https://user@A.Example:8/x",), ("no",), (None,)], "u string").select(host_rules.host_of(F.col("u")).alias("h"))
    assert [r.h for r in hosts.collect()] == ["a.example", "no", ""]


def test_verdicts_too_many_to_broadcast(spark, odd, monkeypatch):
    columns = ["doc_id", "n_words", "base_failed", "kept", "host_docs", "host_rate"]
    small = host_rules.evaluate(odd).select(columns).collect()
    monkeypatch.setattr(host_rules, "BROADCAST_BYTES", 0)
    assert Counter(host_rules.evaluate(odd).select(columns).collect()) == Counter(small)


def test_attention_gradient_and_fit(spark, odd, empty):
    rng = np.random.default_rng(1)
    bags = [rng.normal(size=(n, 30)) for n in (1, 3, 2)]
    model = quality_mil.fit(bags, [0, 1, 1], hidden=4, gates=3, epochs=2)
    model = quality_mil.Model(model.mean.astype(float), model.scale.astype(float), {k: w.astype(float) for k, w in model.weights.items()})
    flat, starts, labels = np.concatenate(bags), np.array([0, 1, 4]), np.array([0.0, 1, 1])
    grad = model.gradient(flat, starts, labels)

    def loss():
        p = model.forward(flat, starts)["score"]
        return -np.mean(labels * np.log(p) + (1 - labels) * np.log(1 - p))

    for name, w in model.weights.items():
        at = np.unravel_index(rng.integers(w.size), w.shape)
        keep = w[at]
        w[at] = keep + 1e-5
        up = loss()
        w[at] = keep - 1e-5
        slope = (up - loss()) / 2e-5
        w[at] = keep
        assert abs(slope - grad[name][at]) < 1e-6
    assert abs(model.forward(flat, starts)["weight"][1:4].sum() - 1) < 1e-9

    rand = random.Random(4)
    kinds = [f"word{k}" for k in range(300)]
    rows = [(k, prose(rand, 90, kinds) if k % 3 else " ".join([rand.choice(kinds)] * 90), int(k % 3 > 0)) for k in range(400)]
    docs, labels = spark.createDataFrame(rows, "doc_id bigint, text string, y int"), spark.createDataFrame([(r[0], r[2], 0) for r in rows] + [(None, 1, 1), (5000, None, None)], "doc_id bigint, quality int, toxic int")
    model = quality_mil.learn(docs, labels)
    held = quality_mil.score(docs, model, ("doc_id", "y")).where(quality_mil.label_split("doc_id", 5) == 0).collect()
    assert np.mean([r.predicted == r.y for r in held]) > 0.95
    assert quality_mil.score(odd, model).where("score between 0 and 1").count() == odd.count()
    nothing = quality_mil.learn(empty, labels.limit(0))
    assert quality_mil.score(empty, nothing).count() == 0


def test_scores_are_those_of_a_plain_scorer(odd, monkeypatch):
    """Bag by bag and passage by passage, in sums over words, by the formulas."""
    texts = [r.text for r in odd.collect()]
    hashes = quality_mil.Hashes()
    bags = [quality_mil.features([quality_mil.bag_of(t, hashes)]) for t in texts]
    model = quality_mil.fit(bags, [k % 2 for k in range(len(bags))], epochs=3)
    w, few = model.weights, quality_mil.BUCKETS

    def bucket(value):
        value = value * 0x9E3779B97F4A7C15 % 2**64
        value ^= value >> 32
        return value % few, 1 - 2 * (value >> 20 & 1)

    def encoded(words):
        x = np.zeros(quality_mil.N_FEATURES)
        if words:
            low = [zlib.crc32(v.lower().encode()) for v in words]
            x[: quality_mil.N_LOOKS] = quality_mil.looks(words, [v.lower() for v in words])
            for value in low + [(a * 0x9E3779B1 + b) % 2**64 for a, b in zip(low, low[1:], strict=False)]:
                at, sign = bucket(value)
                x[quality_mil.N_LOOKS + at] += sign / len(words) ** 0.5
        return np.tanh(np.clip((x - model.mean) / model.scale, -8, 8) @ w["E"] + w["e"])

    for size in (quality_mil.ENCODED, 3):
        monkeypatch.setattr(quality_mil, "ENCODED", size)
        score, top, n = model.score(texts)
        for k, text in enumerate(texts):
            words = (text or "").split()
            h = [encoded(words[a : a + 64]) for a in range(0, max(1, len(words)), 64)]
            raw = np.array([np.tanh(v @ w["V"]) * (1 / (1 + np.exp(-(v @ w["U"])))) @ w["w"] for v in h])
            share = np.exp(raw) / np.exp(raw).sum()
            want = 1 / (1 + np.exp(-(sum(a * v for a, v in zip(share, h, strict=True)) @ w["c"] + w["d"][0])))
            assert abs(score[k] - want) < 1e-4 and abs(top[k] - share.max()) < 1e-4 and n[k] == len(h)


def test_long_samples_are_made_smaller(spark):
    docs = spark.createDataFrame([(k, "word " * 200) for k in range(100)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(100)], "doc_id bigint, quality int")
    seen = []
    quality_mil.fit, keep = lambda bags, labels: seen.append(len(bags)), quality_mil.fit
    try:
        quality_mil.learn(docs, labels)
        quality_mil.learn(docs, labels, train_chars=20_000)
    finally:
        quality_mil.fit = keep
    assert seen[0] > 60 and 5 < seen[1] < 40


def test_language_bundles_and_accuracy(spark, odd, empty):
    space = langid.Space(64, 3)
    text = "Ab, cé"
    got = space.bundle([text, "", "a b"])
    letters = [" ", "a", "b", " ", "c", "é", " "]
    vector = lambda c: space.vectors[space.letter_number[ord(c)]]
    want = sum(np.roll(vector(letters[k]), 2) * np.roll(vector(letters[k + 1]), 1) * vector(letters[k + 2]) for k in range(5))
    assert np.allclose(got[0], want) and not got[1].any()

    rand = random.Random(2)
    kinds = {"aa": ["the", "of", "thing", "with"], "bb": ["der", "zwischen", "und", "nicht"], "cc": ["que", "para", "ción", "los"]}
    rows = [(k, prose(rand, rand.randint(3, 40), kinds[n]), n) for k, n in enumerate(sorted(kinds) * 100)]
    docs = spark.createDataFrame([*rows, (9001, "x", None), (None, None, "aa")], "doc_id bigint, text string, lang string")
    profiles = langid.learn(docs)
    assert profiles.names == ["aa", "bb", "cc"]
    found = langid.predict(docs, profiles, ("doc_id", "lang")).where("doc_id < 9000 AND lang_pred = lang").count()
    assert found > 0.97 * len(rows)
    told = langid.predict(odd, profiles).collect()
    assert len(told) == odd.count() and all(0 <= r.score <= 1 for r in told)
    assert {r.lang_pred for r in told if r.doc_id in (0, 1, 2, 3, 5)} == {"und"}
    assert langid.predict(empty, langid.learn(empty)).count() == 0
    assert {r.lang_pred for r in langid.predict(docs, langid.learn(empty)).collect()} == {"und"}


def test_nearest_examples_are_exact():
    rand = random.Random(6)
    kinds = [f"t{k}" for k in range(60)]
    examples = [(k, Counter(rand.choices(kinds, k=12)), k % 2, k) for k in range(300)]
    index = toxicity.Index(examples, min_g=None, block=16)
    dense = np.zeros((len(index.ids), len(index.term)))
    for t, at in index.at.items():
        dense[at, t] = index.weight[t]
    for _ in range(50):
        at, weight = index.vector(Counter(rand.choices(kinds, k=5)))
        found, score = index.nearest([(at, weight)], 7)[0]
        full = dense[:, at] @ weight
        order = np.lexsort((index.ids, -full))[:7]
        assert np.allclose(score, full[order]) and np.allclose(full[found], score)


def test_vocabulary_is_what_labels_tell_apart(spark):
    """Chosen by columns as by plain counts; copies count once; neighbours by it are exact and decide alone."""
    rand = random.Random(7)
    kinds, bad = [f"t{k}" for k in range(300)], ["vile", "scum", "oaf"]
    texts = [prose(rand, 40, kinds) + (f" {rand.choice(bad)}" if k % 6 == 0 else "") for k in range(300)]
    texts += [texts[0] + " often often"] * 40  # copies of one text do not make its words telling
    examples = [(k, toxicity.term_counts(t, {}), int(k % 6 == 0 or k >= 300), toxicity.copy_key(t)) for k, t in enumerate(texts)]
    index = toxicity.Index(examples)  # production parameters
    rows = [(i, y, key, list(c), list(c.values())) for i, c, y, key in examples]
    table = spark.createDataFrame(rows, "__id bigint, __label int, key bigint, terms array<string>, counts array<int>")
    assert set(toxicity.vocabulary(table)) == set(index.term) >= set(bad) and "often" not in index.term and len(index.term) < 30
    (toxic, near, similar), (clean, *_) = index.vote([examples[6][1], toxicity.term_counts(" ".join(kinds[:3]), {})])
    assert toxic >= toxicity.CUT > clean and len(near) == toxicity.NEIGHBOURS and similar == sorted(similar, reverse=True)
    labels = dict(zip(index.ids.tolist(), index.labels.tolist(), strict=True))
    votes = [s**toxicity.STEEP for s in similar]
    share = (sum(v * labels[i] for v, i in zip(votes, near, strict=True)) + toxicity.PRIOR * index.share) / (sum(votes) + toxicity.PRIOR)
    assert abs(index.calibrated(share) - toxic) < 1e-12  # the score is a function of the evidence


def test_toxic_words_are_found(spark, odd, empty):
    rand = random.Random(8)
    kinds, bad = [f"w{k}" for k in range(500)], ["vile", "scum"]
    rows = [(k, prose(rand, 60, kinds) + (f" {rand.choice(bad)}, {rand.choice(bad)}." if k % 5 == 0 else ""), int(k % 5 == 0)) for k in range(600)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, y int")
    labels = spark.createDataFrame([(r[0], 1, r[2]) for r in rows] + [(None, 1, 1), (7, 0, None)], "doc_id bigint, quality int, toxic int")
    index = toxicity.learn(docs, labels)
    assert set(index.term) >= set(bad)
    found = toxicity.score(docs, index, ("doc_id", "y")).collect()
    assert np.mean([r.predicted == r.y for r in found if r.doc_id % 3]) > 0.97
    assert toxicity.score(odd, index).where("score between 0 and 1").count() == odd.count()
    assert toxicity.score(docs, toxicity.learn(empty, labels.limit(0))).where("predicted = 0").count() == len(rows)


def test_lookup_table(spark, odd, empty):
    import duckdb

    names = maglev.shard_names(7)
    table = maglev.lookup_table(names, 503)
    counts = Counter(table)
    assert set(counts) == set(range(7)) and max(counts.values()) - min(counts.values()) <= 1
    fewer = maglev.lookup_table(names[:-1], 503)
    assert sum(a != b for a, b in zip(table, fewer, strict=True) if a != 6) < 0.25 * 503
    assert maglev.place(odd, shards=names).count() == odd.count() and maglev.place(empty).count() == 0
    assert maglev.place(odd).where("shard_name IS NULL OR slot IS NULL").count() == 0
    ids = spark.range(500).select(F.col("id").alias("doc_id"))
    duck = duckdb.connect()
    duck.sql("CREATE TABLE documents AS SELECT i AS doc_id FROM range(500) r(i)")
    assert sorted(map(tuple, maglev.place(ids).collect())) == sorted(duck.sql(oracle_sql()["op5_lookup_sharding"]).fetchall())
