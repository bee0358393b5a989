import os
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from storyloom.llm import common, host_rules
from storyloom.llm.common import materialize

SF_DIR = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
stages = dict(corpus_pipeline.STAGES)


def rows(frame):
    return Counter(map(tuple, frame.collect()))


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="the tables are not here")
def test_stages_keep_clean_documents_and_drop_the_rest(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns, kept = docs.columns, [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, SF_DIR), "test-stage")
        assert docs.columns == columns
        kept.append(docs.count())
    assert kept == sorted(kept, reverse=True) and kept[-1] > 0.6 * kept[0]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR)
    assert packed.select("doc_id").distinct().count() == kept[-1]
    whole = corpus_pipeline.run(spark, SF_DIR)
    digest = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    assert rows(whole.select(digest)) == rows(packed.select(digest))


@pytest.mark.parametrize("name", list(stages))
def test_stages_take_empty_tables(spark, empty, name):
    assert stages[name](spark, empty.select(COLUMNS), SF_DIR).count() == 0


def test_language_stage_on_odd_rows(spark, odd):
    docs = odd.select(COLUMNS)
    lettered = Counter({r: n for r, n in rows(docs).items() if any(c.isalpha() for c in r[1] or "")})
    assert rows(stages["language ID"](spark, docs, SF_DIR)) == lettered
    unlabelled = docs.selectExpr("doc_id", "text", "CAST(NULL AS string) AS lang", "source", "n_chars")
    assert sum(rows(stages["language ID"](spark, unlabelled, SF_DIR)).values()) == sum(lettered.values())


def brute_force_quality(given):
    """The rows that stay: by the base rules, and by the shrunk failure rate of their source."""
    failed = [(words := (m := host_rules.measures(t))[0]) < 50 or 100 * m[-1] > 50 * words for _, t, *_ in given]
    hosts = defaultdict(list)
    for (*_, source, _), bad in zip(given, failed, strict=True):
        hosts[source or ""].append(bad)
    total, mean = len(given), sum(failed) / len(given)
    spread = sum(sum(h) ** 2 / len(h) for h in hosts.values()) / total - mean**2 - mean * (1 - mean) * len(hosts) / total
    strength = min(max(mean * (1 - mean) / spread - 1, 1), 1e6) if spread > 0 else 1e6
    rate = {k: (sum(h) + mean * strength) / (len(h) + strength) for k, h in hosts.items()}
    return Counter(tuple(r) for r, bad in zip(given, failed, strict=True) if not bad and rate[r[3] or ""] <= 0.5)


def test_quality_stage_on_odd_rows(spark, odd):
    good = [(200 + k, " ".join(f"v{k}x{j}" for j in range(60)), "en", f"s{k % 2}", 300) for k in range(80)]
    docs = odd.select(COLUMNS).unionAll(spark.createDataFrame(good, odd.select(COLUMNS).schema))
    wanted = brute_force_quality([tuple(r) for r in docs.collect()])
    assert rows(stages["quality rules"](spark, docs, SF_DIR)) == wanted and len(wanted) > 80


def test_one_row_of_each_group_stays(spark):
    words = " ".join(f"w{k}" for k in range(60))
    near, other, lone = words + " more", " ".join(f"x{k}" for k in range(60)), "of a null id alone"
    given = [(1, words), (1, words), (None, words), (2, words), (2, other), (3, near), (None, lone), (None, lone), (5, ""), (5, ""), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in given], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    wanted = Counter([(1, words), (2, other), (None, lone), (5, ""), (5, ""), (None, None)])
    assert Counter((r.doc_id, r.text) for r in stages["n-gram Jaccard join"](spark, docs, SF_DIR).collect()) == wanted
    read = materialize(docs, "test")
    assert Counter((r.doc_id, r.text) for r in stages["n-gram Jaccard join"](spark, read, SF_DIR).collect()) == wanted


@pytest.mark.parametrize("size", [0, common.BROADCAST_BYTES])
@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="the tables are not here")
def test_rows_that_hold_an_item_go(spark, monkeypatch, size):
    monkeypatch.setattr(common, "BROADCAST_BYTES", size)
    item = spark.read.parquet(f"{SF_DIR}/benchmark.parquet").first().text
    given = [(None, f"a b {item} c"), (1, item.upper()), (1, "something else"), (2, "clean"), (2, "clean"), (None, None), (None, "clean too"), (3, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in given], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    found = stages["benchmark decontamination"](spark, docs, SF_DIR)
    assert Counter((r.doc_id, r.text) for r in found.collect()) == Counter(given[2:])


def test_packing_stage_holds_all_rows(spark, odd):
    found = stages["packing"](spark, odd.select(COLUMNS), SF_DIR).collect()
    assert sum(r.start == 0 for r in found) == odd.count()
    assert sum(r.length for r in found) == sum(r.doc_tokens for r in found if r.start == 0)
