import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, node string, shard string, start string, sequence_id string, seeds string"


def odd_rows():
    """Nulls in every column, empty and blank texts, one very long text, ties, repeated rows."""
    rng = random.Random(3)
    words = [f"w{k}" for k in range(400)] + ["Straße", "ciónñ", "日本語", "é", "***", "<|endoftext|>", "▁x", "a\x1cb", " "]
    long = " ".join(rng.choice(words) for _ in range(40_000))
    some = " ".join(rng.choice(words) for _ in range(120))
    texts = [None, "", " ", "\n\t ", "a", "123 !!", "one two three four", "x  y\n z ", some, some, some + " more", long, "<|endoftext|> a <|startoftext|>", "퟿\U0001f642 ok"]
    rows = [(k, t, "en" if k % 2 else "de", f"s{k % 3}", len(t or "")) for k, t in enumerate(texts)]
    rows += [rows[8], rows[0], (None, some, None, None, None), (None, None, None, None, None), (8, "another text of the same id", "en", "s0", 1)]
    return [(*r, 1.5, "n", "s", "x", "q", "z") for r in rows]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
