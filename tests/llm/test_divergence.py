"""The audit of sources against counts by plain Python; the query against its SQL."""

import os
import re
from collections import Counter, defaultdict

import duckdb
import pytest

from storyloom.llm import divergence
from storyloom.llm.queries import oracle_sql, queries

SF_DIR = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute_force(rows, min_docs, top=50, smoothing=5, scale=10**9):
    texts = [(lang or "", source or "", [re.sub("[A-Z]", lambda c: c[0].lower(), t) for t in TERM.findall(text or "")]) for lang, source, text in rows]
    held, counts, sources = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, terms in texts:
        held[lang].update(set(terms))
        sources[lang].add(source)
    for lang, source, terms in texts:
        kept = [t for t in terms if held[lang][t] >= min_docs]
        counts[lang, source].update(kept)
        counts[lang, None].update(kept)
    out = Counter()
    for lang, names in sources.items():
        kept = [t for t, n in held[lang].items() if n >= min_docs]

        def shares(source):
            own = counts[lang, source]
            total = sum(own.values()) + smoothing * len(kept)
            return {t: 1 + scale * (own[t] + smoothing) // total for t in kept}

        p, q = {s: shares(s) for s in names}, shares(None)
        for s in names:
            far = [(-sum(abs(p[s][t] - p[u][t]) for t in kept), u.encode(), u) for u in names if u != s]
            terms = [(q[t] - p[s][t], t.encode(), t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found in (("pair", sorted(far)), ("term", sorted(terms)[:top])):
                out.update((lang, s, part, item, -value, k + 1) for k, (value, _, item) in enumerate(found))
    return out


def found(df):
    return Counter((r.lang, r.source, r.part, r.item, r.value, r.rank) for r in df.collect())


@pytest.mark.parametrize("chars", [divergence.AUTOMATON_CHARS, 600])
def test_odd_texts(spark, odd, chars):
    """Neighbouring and overlapping terms, letters beyond ASCII, nulls; also by several passes."""
    more = [(200 + k, t, "en", s) for k, (t, s) in enumerate([("AB ab aB-ab_ab", "s0"), ("ab\x00ab ÄB äb", "s1"), ("a aa aaa a", "s9"), ("a", None), (None, "none"), ("日本 日本語", "s1")])]
    docs = odd.unionByName(spark.createDataFrame(more, "doc_id bigint, text string, lang string, source string"), allowMissingColumns=True)
    docs = docs.withColumnRenamed("node", "term").withColumnRenamed("shard", "value")
    rows = [(r.lang, r.source, r.text) for r in docs.select("lang", "source", "text").collect()]
    for least in (1, 2):
        assert found(divergence.audit(docs, min_docs=least, automaton_chars=chars)) == brute_force(rows, least)
    assert found(divergence.audit(docs, min_docs=30)) == brute_force(rows, 30)  # no term is kept


def test_many_sources(spark, monkeypatch):
    """Tiles: more sources and terms than one of them holds, and ties of values."""
    monkeypatch.setattr(divergence, "TILE_SOURCES", 3)
    monkeypatch.setattr(divergence, "TILE_TERMS", 5)
    rows = [("en" if k % 4 else "de", f"s{k % 11}", " ".join(f"w{chr(97 + (k * j) % 23)}" for j in range(k % 9))) for k in range(200)]
    docs = spark.createDataFrame(rows, "lang string, source string, text string").repartition(5)
    assert found(divergence.audit(docs, min_docs=3)) == brute_force(rows, 3)


def test_empty(spark, empty):
    result = divergence.audit(empty)
    assert result.count() == 0 and result.columns == ["lang", "source", "part", "item", "value", "rank"]


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="the tables are not here")
def test_op13(spark):
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF_DIR}/documents.parquet'")
    wanted = duck.sql(oracle_sql()["op13_source_divergence"])
    rows = queries()["op13_source_divergence"](spark, SF_DIR).select(wanted.columns).collect()
    assert Counter(map(tuple, rows)) == Counter(wanted.fetchall())
    assert len(rows) > 100
