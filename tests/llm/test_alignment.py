"""The alignment of two tokenizers against whole texts encoded at once and pairs counted one by one."""

import hashlib
import os
from collections import Counter, defaultdict

import duckdb
import pytest
import sentencepiece
from tokenizers import Tokenizer

from storyloom.llm import alignment, encoders
from storyloom.llm.queries import queries

SF_DIR = "/root/testdata/sf0.001"
PATHS = encoders.tokenizer_path("byte_bpe_50k.json"), encoders.tokenizer_path("piece_bpe_32k.model")


def groups_of(text, a, b, bytes_a, bytes_b):
    """Groups of ids of a whole text, or None."""
    if not text:
        return None
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    joined = (" " + text).encode()
    if b"".join(bytes_a(k) for k in ids_a) != joined or b"".join(bytes_b(k) for k in ids_b) != joined:
        return None
    out, i, j = [], 0, 0
    while i < len(ids_a):
        own_a, own_b = [ids_a[i]], [ids_b[j]]
        at_a, at_b = len(bytes_a(ids_a[i])), len(bytes_b(ids_b[j]))
        i, j = i + 1, j + 1
        while at_a != at_b:
            if at_a < at_b:
                own_a.append(ids_a[i])
                at_a += len(bytes_a(ids_a[i]))
                i += 1
            else:
                own_b.append(ids_b[j])
                at_b += len(bytes_b(ids_b[j]))
                j += 1
        out.append((own_a, own_b))
    return out


def brute_force(rows):
    a, b = Tokenizer.from_file(PATHS[0]), sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    a.encode_special_tokens = True
    letters = alignment.byte_letters()

    def bytes_a(k):
        return bytes(letters[c] for c in a.id_to_token(k))

    def bytes_b(k):
        piece = b.id_to_piece(k)
        return bytes([int(piece[3:5], 16)]) if b.is_byte(k) else piece.replace("▁", " ").encode()

    cut = [(i, groups_of(t, a, b, bytes_a, bytes_b)) for i, t in rows]
    docs = Counter()
    for _, groups in cut:
        docs.update({(x, y) for own_a, own_b in groups or [] for x in own_a for y in own_b})
    best = defaultdict(int)
    for (x, _), n in docs.items():
        best[x] = max(best[x], n)
    out = []
    for i, groups in cut:
        if groups is None:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
            continue
        links = [(x, y) for own_a, own_b in groups for x in own_a for y in own_b]
        written = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((i, sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), len(links), sum(docs[p] == best[p[0]] for p in links), sum(docs[p] for p in links), hashlib.sha256(written.encode()).hexdigest()))
    return Counter(out), docs, best


def test_odd_texts(spark, odd):
    more = ["  two  spaces ", " a", "a ", "a\n b  c  d", "▁", "a ▁b", "<s> </s> <unk> <0x41>", "tab\there", "é́ \U0001f642‍", "　x y", "aaaa aaaa bbbb", " x", "\x00 y"]
    rows = odd.select("doc_id", "text", "n_chars", "batch" if "batch" in odd.columns else "source").collect()
    extra = spark.createDataFrame([(100 + k, t, "s") for k, t in enumerate(more)], "doc_id bigint, text string, source string")
    docs = odd.unionByName(extra, allowMissingColumns=True).withColumnRenamed("shard", "stripe").withColumnRenamed("score", "n_a")
    found = Counter(tuple(r) for r in alignment.align(docs, *PATHS).collect())
    wanted, pairs, best = brute_force([(r.doc_id, r.text) for r in rows] + [(100 + k, t) for k, t in enumerate(more)])
    assert found == wanted
    assert sum(n for r, n in wanted.items() if r[1]) > 20
    counted = {(r.a, r.b): (r.docs, r.best) for r in alignment.pair_counts(docs, *PATHS).collect()}
    assert counted == {p: (n, n == best[p[0]]) for p, n in pairs.items()}


def test_many_batches(spark, odd, monkeypatch):
    """Counts of a stripe that several tasks add up, and links that several tasks score."""
    monkeypatch.setattr(alignment, "BATCHES_A_TASK", 1)
    docs = odd.where("length(text) < 5000 OR text IS NULL")
    docs = docs.unionAll(docs).unionAll(docs).unionAll(docs).repartition(24)
    wanted, _, _ = brute_force([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert Counter(tuple(r) for r in alignment.align(docs, *PATHS, stripes=7).collect()) == wanted


def test_memo_starts_again(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(alignment, "MEMO_CHUNKS", 1)
    aligner, texts = alignment.Aligner(*PATHS), ["one two", "two three", "three  four", ""]
    together = aligner.documents(pa.array(texts))
    for k, text in enumerate(texts):
        alone = aligner.documents(pa.array([text]))
        assert together[0][:, k].tolist() == alone[0][:, 0].tolist() and together[1][k] == alone[1][0]


def test_empty(spark, empty):
    found = alignment.align(empty, *PATHS)
    assert found.count() == 0 and found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="the tables are not here")
def test_op11(spark):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{SF_DIR}/documents.parquet'").fetchall()
    found = queries()["op11_tokenizer_alignment"](spark, SF_DIR)
    assert Counter(tuple(r) for r in found.collect()) == brute_force(rows)[0]
