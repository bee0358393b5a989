"""Whole-text encoding by public tokenizers, with a memo of chunks met before.

The libraries split a text at places that no merge crosses, so a text's ids are the ids of
its chunks in order. Most chunks repeat; the memo holds the ids the library gave for each, and
new words are given to it many at once. A text for which the cut is not certain to be exact goes
through the library whole.
"""

from __future__ import annotations

import os
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import kept

#: Chunks a memo holds before it starts again: bounds a Python worker's memory.
MEMO_CHUNKS = 400_000
#: New words that are encoded in one call of the library.
JOINED = 64
#: Below this code point, letters and their normal forms are the same in every version of Unicode.
STABLE_BELOW = "ɐ"
#: Stands before a chunk that no space precedes.
HEAD = "\ue000"

_spaces = "[ \t\n\v\f\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
#: A mark right after a letter starts a piece of its own.
_mark_after_letter = r"([A-Za-z])([.,;:!?)])"


def tokenizer_path(name: str) -> str:
    """A vocabulary file's place, by the installed package of public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path(name)


def opened(kind: type, path: str):
    """The encoder of a path, with its memo, kept in a Python worker while its tasks ask for it."""
    return kept((kind, path), lambda: kind(path))


class Memo:
    """What was learned of strings, in two generations: what is still met moves to the young one.

    Holds about ``MEMO_CHUNKS`` entries at most, and forgets those that were not met for longest.
    """

    def __init__(self):
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def look(self, keys: list[str]) -> tuple[list[bytes | None], list[int]]:
        """What is known of each key, and the places of those of which nothing is."""
        found = list(map(self.young.get, keys))
        missing, old = [], self.old.get
        for k, ids in enumerate(found):
            if ids is None:
                if (ids := old(keys[k])) is None:
                    missing.append(k)
                else:
                    found[k] = self.young[keys[k]] = ids
        return found, missing

    def put(self, keys: list[str], values: list[bytes]) -> None:
        if len(self.young) > MEMO_CHUNKS // 2:
            self.old, self.young = self.young, {}
        self.young.update(zip(keys, values, strict=True))


class _Encoder:
    """``encode(texts)``: the ids of each text as little-endian unsigned 32-bit integers.

    ``edge`` tells, of each id, whether it can only stand at one end of a word: at the last piece
    if ``closes``, else at the first. So words that were encoded together are told apart.
    """

    closes: bool
    edge_mark: str

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.edge = np.zeros(self.library.get_vocab_size(), bool)
        for token, k in self.library.get_vocab().items():
            self.edge[k] = token.endswith(self.edge_mark) if self.closes else token.startswith(self.edge_mark)
        self.chunks = Memo()

    def whole(self, texts: list[str]) -> list[bytes]:
        found = self.library.encode_batch_fast(texts, add_special_tokens=False)
        return [array("I", e.ids).tobytes() for e in found]

    def uncertain(self, texts: pa.Array) -> pa.Array:
        """Of which texts the chunks may not be exact."""
        raise NotImplementedError

    def cut(self, texts: pa.Array) -> pa.ListArray:
        raise NotImplementedError

    def text_of(self, chunk: str) -> str:
        """What the library is given for a chunk alone."""
        raise NotImplementedError

    def is_word(self, chunk: str) -> bool:
        """Whether it is sure to be one piece also between other words."""
        raise NotImplementedError

    def encode(self, texts: pa.Array | list[str | None]) -> list[bytes]:
        if isinstance(texts, list):
            texts = pa.array(texts, pa.string())
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        unsure = self.uncertain(texts)
        if not pc.any(unsure).as_py():
            return self.by_chunks(texts)
        out = self.by_chunks(texts.filter(pc.invert(unsure)))
        at = np.flatnonzero(unsure.to_numpy(zero_copy_only=False))
        for k, ids in zip(at.tolist(), self.whole(texts.filter(unsure).to_pylist()), strict=True):
            out.insert(k, ids)
        return out

    def by_chunks(self, texts: pa.Array) -> list[bytes]:
        lists = self.cut(texts)
        coded = lists.values.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        found, new = self.chunks.look(distinct)
        if new:
            keys = [distinct[k] for k in new]
            values = self.learn(keys)
            self.chunks.put(keys, values)
            for k, ids in zip(new, values, strict=True):
                found[k] = ids
        ids = pa.array(found, pa.large_binary()).take(coded.indices)
        _, offsets, data = ids.buffers()
        ends = np.frombuffer(offsets, np.int64)[: len(ids) + 1][lists.offsets.to_numpy()].tolist()
        data = data.to_pybytes() if data else b""
        return [data[a:b] for a, b in zip(ends, ends[1:], strict=False)]

    def learn(self, chunks: list[str]) -> list[bytes]:
        """The ids of chunks; words go through the library many at once, all else alone."""
        word, of = self.is_word, self.text_of
        words = [k for k, c in enumerate(chunks) if word(c)]
        out: list = [None] * len(chunks)
        groups = [words[a : a + JOINED] for a in range(0, len(words), JOINED)]
        made = self.library.encode_batch_fast([self.joined([chunks[k] for k in g]) for g in groups], add_special_tokens=False)
        for group, encoded in zip(groups, made, strict=True):
            ids = np.array(encoded.ids, "<u4")
            at = np.flatnonzero(self.edge[ids])
            if len(at) != len(group):
                continue
            ends = (4 * np.r_[0, at + 1] if self.closes else 4 * np.r_[at, len(ids)]).tolist()
            data = ids.tobytes()
            for k, a, b in zip(group, ends, ends[1:], strict=False):
                out[k] = data[a:b]
        left = [k for k, ids in enumerate(out) if ids is None]
        for k, ids in zip(left, self.whole([of(chunks[k]) for k in left]), strict=True):
            out[k] = ids
        return out

    def joined(self, words: list[str]) -> str:
        raise NotImplementedError


class ByteLevel(_Encoder):
    """byte_bpe_50k: a space starts a piece unless white space stands beside it."""

    closes, edge_mark = False, "Ġ"

    def uncertain(self, texts):
        return pc.match_substring_regex(texts, f"{_spaces} | {_spaces}|<\\||{HEAD}")

    def cut(self, texts):
        marked = pc.replace_substring_regex(texts, _mark_after_letter, f"\\1 {HEAD}\\2")
        return pc.split_pattern(pc.binary_join_element_wise(pa.scalar(HEAD, pa.large_string()), marked, pa.scalar("", pa.large_string())), " ")

    def text_of(self, chunk):
        return chunk[1:] if chunk[:1] == HEAD else " " + chunk

    def is_word(self, chunk):
        return chunk.isalpha() and (chunk.isascii() or max(chunk) < STABLE_BELOW)

    def joined(self, words):
        return " " + " ".join(words)


class WordEnds(_Encoder):
    """word_bpe_49k: lower case, white space dropped, so white space always ends a piece."""

    closes, edge_mark = True, "</w>"

    def uncertain(self, texts):
        return pc.match_substring(texts, "<|")

    def cut(self, texts):
        return pc.ascii_split_whitespace(pc.replace_substring_regex(texts, _mark_after_letter, r"\1 \2"))

    def text_of(self, chunk):
        return chunk

    def is_word(self, chunk):
        return chunk.isalpha() and (chunk.isascii() or max(chunk) < STABLE_BELOW)

    def joined(self, words):
        return " ".join(words)


def single_tokens(path: str) -> frozenset[str]:
    """The strings of a vocabulary that the library encodes alone as one token: each is put through it."""
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [library.id_to_piece(i) for i in range(library.get_piece_size())]
    if bad := [p for p in names if "▁" in p.lstrip("▁")]:
        raise ValueError(f"pieces that cross a space: {bad[:5]}")
    words = [p[1:] for p in names if p.startswith("▁") and p[1:] and p[1] != "▁"]
    encoded = library.encode(words, num_threads=1)
    return frozenset(w for w, ids in zip(words, encoded, strict=True) if len(ids) == 1)


class Pieces:
    """piece_bpe_32k: token counts. Pieces of the vocabulary hold a space mark only in front.

    ``single`` holds the vocabulary strings proven to encode alone as one token (see
    ``single_tokens``). Chunks found there count 1 without any merge; only the rest is merged, and
    those counts are kept in a bounded memo.
    """

    def __init__(self, path: str, single: frozenset[str] | None = None):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.single = dict.fromkeys(single_tokens(path) if single is None else single, 1)
        self.merged: dict[str, int] = {}

    def count(self, texts: list[str | None]) -> list[int]:
        if len(self.merged) > MEMO_CHUNKS:
            self.merged.clear()
        single, merged = self.single.get, self.merged.get
        out: list[int] = []
        left: list[tuple[int, list[str]]] = []
        whole: list[int] = []
        for k, text in enumerate(texts):
            out.append(0)
            if not text:
                continue
            if text[0] == " " or text[-1] == " " or "  " in text or "▁" in text:
                whole.append(k)
                continue
            chunks = text.split(" ")
            rest = [c for c in chunks if single(c) is None]
            out[k] = len(chunks) - len(rest)
            left.append((k, rest))
        new = list({c for _, rest in left for c in rest if merged(c) is None})
        self.merged.update(zip(new, map(len, self.library.encode(new, num_threads=1)), strict=True))
        known = self.merged.__getitem__
        for k, rest in left:
            out[k] += sum(map(known, rest))
        for k, ids in zip(whole, self.library.encode([texts[k] for k in whole], num_threads=1), strict=True):
            out[k] = len(ids)
        return out
