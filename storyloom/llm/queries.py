"""The queries of this subpackage, one for each operator, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, bitplanes, decontam, divergence, encoders, factors, host_rules, jaccard, langid, maglev, packing, quality_mil, token_counts, toxicity
from .common import documents, label_split, scratch, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_bitplanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "bitplanes")
    bitplanes.write(documents(spark, sf_dir), path, encoders.tokenizer_path("byte_bpe_50k.json"))
    return bitplanes.read(spark, path, with_ids=False)


def op2_attention_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = quality_mil.learn(docs, table(spark, sf_dir, "labels"))
    held_out = label_split("doc_id", quality_mil.FOLDS) == quality_mil.HELD_FOLD
    return quality_mil.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted", "n_passages")


def op3_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = host_rules.evaluate(documents(spark, sf_dir))
    rate = F.round("host_rate", 6).alias("host_rate")
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", rate
    )


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count(documents(spark, sf_dir), encoders.tokenizer_path("piece_bpe_32k.model"))


def op5_lookup_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maglev.place(documents(spark, sf_dir).select("doc_id"))


def op6_language_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = label_split("doc_id", langid.FOLDS) == langid.HELD_FOLD
    return langid.predict(docs, langid.learn(docs)).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op7_toxic_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    index = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    held_out = label_split("doc_id", toxicity.FOLDS) == toxicity.HELD_FOLD
    evidence = F.transform(F.slice("neighbours", 1, 5), lambda n: n["id"]).alias("evidence_ids")
    return toxicity.score(docs, index).select("doc_id", held_out.alias("held_out"), "score", "predicted", evidence)


def op8_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(documents(spark, sf_dir)).drop("class_key")


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    cut = packing.pieces(docs, encoders.tokenizer_path("word_bpe_49k.json"), with_ids=False)
    return packing.pack(cut, docs.count())


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(documents(spark, sf_dir), encoders.tokenizer_path("byte_bpe_50k.json"), encoders.tokenizer_path("piece_bpe_32k.model"))


def op12_relative_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return factors.deduplicate(documents(spark, sf_dir))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(documents(spark, sf_dir))


def queries() -> dict[str, Query]:
    found = (
        op1_bitplanes, op2_attention_quality, op3_host_rules, op4_token_counts, op5_lookup_sharding, op6_language_profiles,
        op7_toxic_neighbours, op8_benchmark_leaks, op9_ngram_jaccard, op10_best_fit_packing, op11_tokenizer_alignment,
        op12_relative_factors, op13_source_divergence,
    )
    return {f.__name__: f for f in found}


_OP5_SQL = f"""
WITH RECURSIVE shards AS (
  SELECT i AS shard, 'shard-' || lpad(CAST(i AS VARCHAR), 4, '0') AS shard_name FROM range({maglev.SHARDS}) r(i)),
steps AS (
  SELECT shard, shard_name,
         ('0x' || substr(md5('offset:' || shard_name), 1, 15))::BIGINT % {maglev.SLOTS} AS first_slot,
         ('0x' || substr(md5('skip:' || shard_name), 1, 15))::BIGINT % ({maglev.SLOTS} - 1) + 1 AS skip
  FROM shards),
wishes AS (
  SELECT shard, list((first_slot + j * skip) % {maglev.SLOTS} ORDER BY j) AS wish
  FROM steps, range({maglev.SLOTS}) r(j) GROUP BY shard),
turns(turn, owner) AS (
  SELECT 0::BIGINT, list_transform(range({maglev.SLOTS}), lambda x: -1::BIGINT)
  UNION ALL
  SELECT turn + 1,
         list_transform(owner, lambda o, i: CASE WHEN i = claimed + 1 THEN turn % {maglev.SHARDS} ELSE o END)
  FROM (SELECT turn, owner, list_filter(wish, lambda s: owner[s + 1] < 0)[1] AS claimed
        FROM turns JOIN wishes ON wishes.shard = turns.turn % {maglev.SHARDS} WHERE turn < {maglev.SLOTS})),
filled AS (SELECT owner FROM turns WHERE turn = {maglev.SLOTS}),
placed AS (
  SELECT doc_id, ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15))::BIGINT % {maglev.SLOTS} AS slot
  FROM documents)
SELECT doc_id, slot, CAST(owner[slot + 1] AS INTEGER) AS shard, 'shard-' || lpad(CAST(owner[slot + 1] AS VARCHAR), 4, '0') AS shard_name
FROM placed, filled
"""


_OP3_SQL = f"""
WITH words AS (
  SELECT doc_id, coalesce(nullif(lower(regexp_extract(source, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)', 1)), ''), source, '') AS host, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words
  FROM documents),
placed AS (SELECT doc_id, unnest(range(1, len(words) - 1)) AS pos, words FROM words WHERE len(words) > 2),
windows AS (SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, words[pos], words[pos + 1], words[pos + 2]) AS n FROM placed),
repeated AS (
  SELECT doc_id, count(DISTINCT word) AS n_repeat_words
  FROM (SELECT doc_id, unnest([pos, pos + 1, pos + 2]) AS word FROM windows WHERE n > 1) GROUP BY doc_id),
lines AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM words)
  WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
measured AS (
  SELECT doc_id, host, CAST(len(words) AS BIGINT) AS n_words,
         CAST(coalesce(list_sum(list_transform(words, lambda w: length(w))), 0) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
  FROM words LEFT JOIN repeated USING (doc_id) LEFT JOIN lines USING (doc_id)),
judged AS (
  SELECT *, n_words < {host_rules.MIN_WORDS} OR 100 * n_repeat_words > {host_rules.MAX_REPEAT_PERCENT} * n_words AS base_failed
  FROM measured),
hosts AS (
  SELECT host, CAST(count(*) AS DOUBLE) AS n, CAST(sum(CASE WHEN base_failed THEN 1 ELSE 0 END) AS DOUBLE) AS f
  FROM judged GROUP BY host),
moments AS (
  SELECT sum(f) / sum(n) AS mean, sum(f * f / n) / sum(n) AS square, count(*) / sum(n) AS per_doc FROM hosts),
spreads AS (
  SELECT mean, mean * (1 - mean) AS chance, square - mean * mean - mean * (1 - mean) * per_doc AS spread FROM moments),
prior AS (
  SELECT mean, CASE WHEN spread > 0 THEN least(greatest(chance / spread - 1, {host_rules.STRENGTH[0]}), {host_rules.STRENGTH[1]})
                    ELSE {host_rules.STRENGTH[1]} END AS strength
  FROM spreads),
rates AS (SELECT host, (f + mean * strength) / (n + strength) AS rate FROM hosts, prior)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND rate <= {host_rules.MAX_HOST_RATE} AS kept, round(rate, 6) AS host_rate
FROM judged JOIN rates USING (host)
"""


def _share(count: str, total: str, terms: str) -> str:
    smooth = divergence.SMOOTHING
    return f"CASE WHEN {terms} = 0 THEN 0 ELSE 1 + ({divergence.SCALE}::HUGEINT * ({count} + {smooth})) // ({total} + {smooth} * {terms}) END"


_OP13_SQL = f"""
WITH docs AS (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
words AS (
  SELECT row, lang, source,
         translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term
  FROM docs),
vocabulary AS (SELECT lang, term FROM words GROUP BY lang, term HAVING count(DISTINCT row) >= {divergence.MIN_DOCS}),
counts AS (SELECT lang, source, term, count(*) AS n FROM words JOIN vocabulary USING (lang, term) GROUP BY lang, source, term),
sizes AS (SELECT lang, count(*) AS terms FROM vocabulary GROUP BY lang),
totals AS (SELECT lang, source, sum(n) AS total FROM counts GROUP BY lang, source),
groups AS (
  SELECT lang, source, coalesce(total, 0)::HUGEINT AS total, coalesce(terms, 0)::HUGEINT AS terms
  FROM (SELECT DISTINCT lang, source FROM docs) LEFT JOIN totals USING (lang, source) LEFT JOIN sizes USING (lang)),
shares AS (
  SELECT lang, source, term, coalesce(n, 0) AS n, {_share("coalesce(n, 0)", "total", "terms")} AS p
  FROM groups JOIN vocabulary USING (lang) LEFT JOIN counts USING (lang, source, term)),
langs AS (SELECT lang, sum(total) AS total, any_value(terms) AS terms FROM groups GROUP BY lang),
overall AS (
  SELECT lang, term, {_share("n", "total", "terms")} AS q
  FROM (SELECT lang, term, sum(n) AS n FROM counts GROUP BY lang, term) JOIN langs USING (lang)),
distances AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN distances d ON d.lang = a.lang AND d.source = a.source AND d.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, (p - q)::BIGINT FROM shares JOIN overall USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, rank::INTEGER AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM found)
WHERE part = 'pair' OR rank <= {divergence.TOP}
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_host_rules": _OP3_SQL, "op5_lookup_sharding": _OP5_SQL, "op13_source_divergence": _OP13_SQL}
