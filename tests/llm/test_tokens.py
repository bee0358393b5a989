import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from storyloom.llm import bitplanes, encoders, packing, token_counts
from storyloom.llm.common import scratch

BYTE, WORD, PIECE = (encoders.tokenizer_path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))
ALPHABET = [" ", "  ", "\n", "\t", "a", "B", "é", "İ", "Σ", "'s", "'", "!", "<|endoftext|>", "1", "²", "日", "́", "\x1c", "\xa0", "ß", "\n \n", "▁", "", "...", "\r\n", "🙂", "ﬁ"]


def strings(n=3000):
    rng = random.Random(5)
    return ["".join(rng.choices(ALPHABET, k=rng.randint(0, 25))) for _ in range(n)] + [None, ""]


@pytest.mark.parametrize(("kind", "path"), [(encoders.ByteLevel, BYTE), (encoders.WordEnds, WORD)])
def test_encoders_give_the_library_ids(kind, path, monkeypatch):
    monkeypatch.setattr(encoders, "MEMO_CHUNKS", 500)  # so that memos start again on the way
    encoder, texts = kind(path), strings()
    wanted = [np.array(e.ids, "<u4").tobytes() for e in encoder.library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert [x for at in range(0, len(texts), 700) for x in encoder.encode(texts[at : at + 700])] == wanted


def test_piece_counts_are_the_library_counts():
    counter, texts = encoders.Pieces(PIECE), strings()
    assert counter.count(texts) == [len(x) for x in counter.library.encode([t or "" for t in texts])]
    assert all(len(counter.library.encode(w)) == 1 for w in list(counter.single)[::50])


@pytest.mark.parametrize("kind", ["bit", "byte"])
@pytest.mark.parametrize("n", [0, 1, 7, 8, 1000])
def test_planes_round_trip(kind, n):
    ids = np.random.default_rng(n).integers(0, 2 ** (4 + n % 29), n).astype("<u4")
    assert (bitplanes.restore(bitplanes.transpose(ids, kind), n, kind) == ids).all()


def encoded(encoder, text, end):
    return encoder.whole([text or ""])[0] + np.array([end], "<u4").tobytes()


@pytest.mark.parametrize(("kind", "block"), [("bit", 64), ("byte", 65_536)])
def test_files_give_back_all_documents(spark, odd, kind, block):
    path = scratch(spark, "test")
    bitplanes.write(odd, path, BYTE, block_ids=block, kind=kind)
    found = bitplanes.read(spark, path, kind).collect()
    encoder = encoders.ByteLevel(BYTE)
    assert Counter((r.doc_id, bytes(r.ids)) for r in found) == Counter((r.doc_id, encoded(encoder, r.text, 0)) for r in odd.collect())
    at = 0
    for r in sorted(found, key=lambda r: r.start):
        assert (r.start, r.n_tokens * 4) == (at, len(r.ids))
        at += r.n_tokens
    ids = [r.doc_id for r in sorted(found, key=lambda r: r.start)]
    assert ids == sorted(ids, key=lambda i: (i is not None, i))
    index = spark.read.parquet(f"{path}/index")
    assert index.agg(F.sum("n_ids")).first()[0] == at


def test_empty_tables(spark, empty):
    path = scratch(spark, "test")
    bitplanes.write(empty, path, BYTE)
    assert bitplanes.read(spark, path).count() == 0
    assert token_counts.count(empty, PIECE).count() == 0
    assert packing.pack(packing.pieces(empty, WORD), 0).count() == 0


def test_token_counts(odd):
    counter = encoders.Pieces(PIECE)
    found = token_counts.count(odd, PIECE, limit=100).collect()
    wanted = Counter((r.doc_id, len((r.text or "").encode()), n := len(counter.library.encode(r.text or "")), n > 100) for r in odd.collect())
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in found) == wanted


def test_best_fit_decreasing_against_plain_search():
    lengths = np.random.default_rng(2).integers(1, 65, 400)
    number, offset = packing.best_fit_decreasing(lengths, 64)
    left: list[int] = []
    for length in sorted(lengths.tolist(), reverse=True):
        fits = [k for k, c in enumerate(left) if c >= length]
        if fits:
            left[min(fits, key=lambda k: left[k])] -= length
        else:
            left.append(64 - length)
    filled = np.bincount(number, lengths)
    assert sorted(64 - filled) == sorted(left)
    for k in range(len(filled)):
        spans = sorted((o, o + n) for o, n in zip(offset[number == k], lengths[number == k], strict=True))
        assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))


def test_packing_holds_each_id_once(odd):
    encoder = encoders.WordEnds(WORD)
    found = packing.pack(packing.pieces(odd, WORD, window=128), odd.count(), window=128, group_docs=6).collect()
    tokens = [encoded(encoder, r.text, 1) for r in odd.collect()]
    wanted = Counter((zlib.crc32(t[a : a + 512]), a // 4) for t in tokens for a in range(0, len(t), 512))
    assert Counter((zlib.crc32(r.ids), r.start) for r in found) == wanted
    by: dict[int, list] = {}
    for r in found:
        by.setdefault(r.sequence_id, []).append((r.offset, r.offset + r.length, r.pad_tokens))
    for spans in by.values():
        spans.sort()
        assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))
        full = spans[-1][1]
        assert full <= 128 and all(s[2] == (0 if full & (full - 1) == 0 else 128 - full) for s in spans)
