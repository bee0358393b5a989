"""Substring deduplication against all windows of plain Python, and its factors against every window of a block."""

import hashlib
import os
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from storyloom.llm import factors
from storyloom.llm.queries import queries

SF_DIR, MORE_DIR = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
LAST = float("inf")


def brute_force(rows, window=13):
    texts = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    first = {}
    for i, words in texts:
        for k in range(len(words) - window + 1):
            w = tuple(words[k : k + window])
            first[w] = min(first.get(w, LAST), LAST if i is None else i)
    out = Counter()
    for i, words in texts:
        spare = set()
        for k in range(len(words) - window + 1):
            if first[tuple(words[k : k + window])] < (LAST if i is None else i):
                spare |= set(range(k, k + window))
        kept = " ".join(w for k, w in enumerate(words) if k not in spare)
        out[i, len(words), len(spare), hashlib.sha256(kept.encode()).hexdigest()] += 1
    return out


def found(df):
    return Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in df.collect())


def planted():
    """Passages at all distances, edited copies, variants around one seed, and repeats within a text."""
    rng = random.Random(5)
    words = [f"w{k}" for k in range(60)]
    passages = [[rng.choice(words) for _ in range(rng.choice((12, 13, 14, 20, 60)))] for _ in range(12)]
    rows = []
    for k in range(150):
        text = []
        for _ in range(rng.randrange(5)):
            text += [f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(8))]
            p = list(rng.choice(passages))
            if rng.random() < 0.5:
                p[rng.randrange(len(p))] = "edit"
            text += p[rng.randrange(3) :] * rng.choice((1, 1, 1, 2))
        rows.append((rng.choice((k, k, k - 1, None)), rng.choice((" ", "\n", "  ", "\x1c ")).join(text)))
    return rows


@pytest.mark.parametrize("block_seeds", [factors.BLOCK_SEEDS, 3])
def test_planted(spark, block_seeds):
    rows = planted()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7)
    wanted = brute_force(rows)
    assert found(factors.deduplicate(docs, block_seeds=block_seeds)) == wanted
    assert sum(n for (_, _, removed, _), n in wanted.items() if removed) > 40


def test_odd_texts(spark, odd):
    docs = odd.withColumnRenamed("node", "row").withColumnRenamed("shard", "seeds").withColumnRenamed("start", "id")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    result = factors.deduplicate(docs, with_text=True)
    assert found(result) == brute_force(rows)
    for r in result.collect():
        assert hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256


def test_one_passage_in_many_rows(spark):
    """A passage of a third of all rows, rows that are repeated, and a variant that its reference lacks."""
    passage = " ".join(f"p{k}" for k in range(40))
    rows = [(k, f"a{k} {passage} b{k}" if k % 3 == 0 else f"c{k} d{k}" if k % 3 == 1 else passage.replace("p20", "v") + f" {k}") for k in range(900)] + [(7, passage)] * 50
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(9)
    assert found(factors.deduplicate(docs, block_seeds=64)) == brute_force(rows)


def test_empty(spark, empty):
    result = factors.deduplicate(empty)
    assert result.count() == 0 and result.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]


def test_factors_are_what_the_block_holds():
    rng = np.random.default_rng(1)
    for window in (1, 3, 5):
        regions = [rng.integers(0, 3, n).astype(np.uint64) for n in (40, 7, 20)]
        block, text = factors.Block(window), rng.integers(0, 3, 200).astype(np.uint64)
        for r in regions:
            block.add(r)
        held = {tuple(r[k : k + window].tolist()) for r in regions for k in range(len(r) - window + 1)}
        yes = [k for k in range(len(text) - window + 1) if tuple(text[k : k + window].tolist()) in held]
        spans, lacking = block.factors(text)
        assert {k for a, b in spans for k in range(a, b)} == {j for k in yes for j in range(k, k + window)}
        assert sorted(lacking) == sorted(set(range(len(text) - window + 1)) - set(yes))


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="the tables are not here")
@pytest.mark.parametrize("where", [SF_DIR, MORE_DIR])
def test_op12(spark, where):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{where}/documents.parquet'").fetchall()
    assert found(queries()["op12_relative_factors"](spark, where)) == brute_force(rows)
