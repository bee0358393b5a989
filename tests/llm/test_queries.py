"""Each opN query, with production parameters over whole tables, against a brute-force version of it."""

import math
import os
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from storyloom.llm import decontam, encoders, langid, packing, quality_mil, toxicity
from storyloom.llm.queries import oracle_sql, queries

from test_pairs import brute_force

SF_DIR = "/root/testdata/sf0.001"
MORE_DIR = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="the tables are not here")
ops = queries()


def table(name, where=SF_DIR):
    return [tuple(r) for r in duckdb.sql(f"SELECT * FROM '{where}/{name}.parquet'").fetchall()]


def fold(doc_id, modulus):
    return zlib.crc32(str(doc_id).encode()) % modulus


@pytest.fixture(scope="module")
def docs():
    return {i: t for i, t, *_ in table("documents")}


def test_op1(spark, docs):
    library, start, wanted = encoders.ByteLevel(encoders.tokenizer_path("byte_bpe_50k.json")).library, 0, []
    for i in sorted(docs):
        ids = np.array([*library.encode(docs[i] or "", add_special_tokens=False).ids, 0], "<u4")
        wanted.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(tuple(r) for r in ops["op1_bitplanes"](spark, SF_DIR).collect()) == wanted


def test_op2(spark, docs):
    found = {r.doc_id: r for r in ops["op2_attention_quality"](spark, SF_DIR).collect()}
    model = quality_mil.learn(spark.read.parquet(f"{SF_DIR}/documents.parquet"), spark.read.parquet(f"{SF_DIR}/labels.parquet"))
    assert set(found) == set(docs)
    for i, r in found.items():
        assert abs(r.score - model.score([docs[i]])[0][0]) < 1e-4 and 0 <= r.score <= 1
        assert r.held_out == (fold(i, 5) == 0) and r.predicted == int(r.score >= 0.3)


def test_op4(spark, docs):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=encoders.tokenizer_path("piece_bpe_32k.model"))
    wanted = [(i, len((t or "").encode()), n := len(library.encode(t or "")), n > 4096) for i, t in sorted(docs.items())]
    assert sorted(tuple(r) for r in ops["op4_token_counts"](spark, SF_DIR).collect()) == wanted


@pytest.mark.parametrize("name", ["op3_host_rules", "op5_lookup_sharding"])
def test_queries_with_sql(spark, name):
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF_DIR}/documents.parquet'")
    wanted = duck.sql(oracle_sql()[name])
    found = ops[name](spark, SF_DIR).select(wanted.columns).collect()
    assert Counter(map(tuple, found)) == Counter(wanted.fetchall())


def test_op6(spark):
    space, sums = langid.Space(langid.DIMENSIONS, langid.LETTERS), defaultdict(lambda: np.zeros(langid.DIMENSIONS))
    rows = table("documents")

    def unit(text):
        v = space.bundle([text])[0].astype(float)
        return v / max(np.linalg.norm(v), 1e-12)

    for i, text, lang, *_ in rows:
        if lang is not None and fold(i, 5):
            sums[lang] += unit(text)
    found = {r.doc_id: r for r in ops["op6_language_profiles"](spark, SF_DIR).collect()}
    for i, text, *_ in rows:
        cosine = {k: unit(text) @ v / np.linalg.norm(v) for k, v in sums.items()}
        r = found.pop(i)
        assert r.held_out == (fold(i, 5) == 0) and 0 <= r.score <= 1
        if any(c.isalpha() for c in text or ""):
            assert abs(r.score - max(0, max(cosine.values()))) < 1e-5 and abs(cosine[r.lang_pred] - max(cosine.values())) < 1e-5
        else:
            assert (r.lang_pred, r.score) == (langid.UNDETERMINED, 0)
    assert not found


def test_op7(spark, docs):
    """Exact cosines over the terms of all examples, without an index, blocks or bounds."""
    labels = {i: int(t) for i, _, t in table("labels") if t is not None and fold(i, 4) != 2 and i in docs}
    ids = sorted(labels)
    counts = {i: toxicity.term_counts(t, {}) for i, t in docs.items()}
    copies = Counter(toxicity.copy_key(docs[i]) for i in ids)
    share = {i: 1 / copies[toxicity.copy_key(docs[i])] for i in ids}
    n, held, held_toxic = len(copies), Counter(), Counter()
    for i in ids:
        for t in counts[i]:
            held[t] += share[i]
            held_toxic[t] += share[i] * labels[i]
    idf = {t: math.log((1 + n) / (1 + v)) + 1 for t, v in held.items()}
    toxic = sum(share[i] * labels[i] for i in ids)
    names = sorted(held)
    g = toxicity.g_statistic(np.array([held_toxic[t] for t in names]), toxic, np.array([held[t] - held_toxic[t] for t in names]), n - toxic)
    chosen = {t for t, v in zip(names, g, strict=True) if v >= toxicity.MIN_G and held[t] >= toxicity.LEAST_HELD - 1e-9}

    def vector(terms):
        v = {t: (1 + math.log(c)) * idf[t] for t, c in terms.items() if t in chosen}
        norm = math.sqrt(sum(w * w for w in v.values())) or 1
        return {t: w / norm for t, w in v.items()}

    vectors = {i: vector(counts[i]) for i in ids}
    overall = sum(labels.values()) / len(ids)

    def told(terms, but=None):
        v = vector(terms)
        near = [(-round(sum(w * vectors[i].get(t, 0) for t, w in v.items()), 12), i) for i in ids if i != but]
        near = [(i, -s) for s, i in sorted(near)[: toxicity.NEIGHBOURS] if s < 0]
        votes = [(s**toxicity.STEEP, labels[i]) for i, s in near]
        total = sum(w for w, _ in votes) + toxicity.PRIOR
        return (sum(w * y for w, y in votes) + toxicity.PRIOR * overall) / total, near

    known = [i for i in ids if vectors[i]]
    slope, offset = toxicity.calibration(np.array([told(counts[i], i)[0] for i in known]), np.array([labels[i] for i in known]))
    found = {r.doc_id: r for r in ops["op7_toxic_neighbours"](spark, SF_DIR).collect()}
    assert set(found) == set(docs)
    for i, r in found.items():
        assert r.held_out == (fold(i, 4) == 2) and r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1
        if vector(counts[i]):
            vote, near = told(counts[i])
            assert abs(r.score - 1 / (1 + math.exp(-(slope * math.log(vote / (1 - vote)) + offset)))) < 1e-4
            sims = dict(near)
            assert [round(sims[k], 6) for k in r.evidence_ids] == [round(s, 6) for _, s in near[:5]]


def test_op8(spark, docs):
    items = {i: decontam.words_of(t) for i, t in table("benchmark")}
    found = {(r.doc_id, r.item_id): r for r in ops["op8_benchmark_leaks"](spark, SF_DIR).collect()}
    for d, text in docs.items():
        words = decontam.words_of(text)
        for i, item in items.items():
            if not set(item) & set(words):
                continue
            score = decontam.align(item, words)[0]
            if (d, i) in found:
                assert abs(found[d, i].score - score) < 1e-9 and score >= decontam.MIN_SCORE
            else:
                assert score < 0.6  # an edited copy that keeps no four words in a row is not found


def test_op9_finds_every_link(spark):
    rows = [(i, t) for i, t, *_ in table("documents", MORE_DIR)]
    found = ops["op9_ngram_jaccard"](spark, MORE_DIR).collect()
    assert Counter((r.doc_id, r.class_id, r.n_links) for r in found) == brute_force(rows)


def test_op10(spark, docs):
    library = encoders.WordEnds(encoders.tokenizer_path("word_bpe_49k.json")).library
    ids = {i: np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for i, t in docs.items()}
    found, sequences, at = ops["op10_best_fit_packing"](spark, SF_DIR).collect(), defaultdict(list), Counter()
    for r in sorted(found, key=lambda r: (r.doc_id, r.start)):
        assert r.start == at[r.doc_id] and r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
        at[r.doc_id] += r.length
        sequences[r.sequence_id].append((r.offset, r.offset + r.length))
    assert at == Counter({i: len(x) for i, x in ids.items()})
    for spans in sequences.values():
        spans.sort()
        assert spans[0][0] == 0 and spans[-1][1] <= 2048 and all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))
    # One group holds this table, so there are as many sequences as one best-fit run over all pieces gives.
    lengths = np.array([r.length for r in found])
    assert len(sequences) == len(set(packing.best_fit_decreasing(lengths)[0].tolist())) <= math.ceil(lengths.sum() / 2048) * 1.02 + 1
