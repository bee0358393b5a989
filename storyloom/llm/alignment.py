"""Alignment of two tokenizers by id-striped count matrices (operator 11).

1. Texts are cut at spaces that no token of either side crosses; what each distinct chunk gives (ids,
   groups, linked pairs) is worked out once, many chunks at a time, and a document's figures are sums
   of its chunks'.
2. A batch of documents is turned round: for every linked pair of ids, the documents that hold it.
   Pairs are dealt over stripes by the id of side A, so that a stripe's counts of documents are a
   dense block of a bounded size, to which batches are added in place.
3. The greatest count of a block's row is what A's id has best. The links of a stripe then meet its
   counts, and their sums go back to the documents.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import kept, materialize, release, rest, slices

#: Stripes of side A's ids.
STRIPES = 64
#: Documents of a batch (their places are unsigned 16-bit integers) and bytes of its texts, but for a single longer one.
BATCH_ROWS, BATCH_BYTES = 1 << 15, 6 << 20
#: Chunks that are remembered from batch to batch, and those that go through the libraries at once.
MEMO_CHUNKS, LEARNED = 250_000, 8192
#: Chunks that go through the libraries as one text.
JOINED = 256
#: Batches whose links of one stripe are the work of one task.
BATCHES_A_TASK = 512

_white = " \t\n\v\f\r\x1c-\x1f\x85\xa0  -     　▁"
#: What may not stand before a space at which a text is cut.
_WHITE = frozenset(chr(k) for k in range(0x3001) if chr(k).isspace()) | {"▁"}
#: Texts with such spaces are cut with more care.
_UNEVEN = f"^ | $|[{_white}] "
#: A space that follows no white space starts a token of both sides.
_CUT = re.compile(r"(?<=[^\s▁]) (?=.)", re.DOTALL)


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary, by the published rule."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Aligner:
    """Two vocabularies, and what was learned of chunks of text in a Python worker."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        letters = byte_letters()
        self.bytes_a = [bytes(letters[c] for c in (self.a.id_to_token(k) or "") if c in letters) for k in range(self.a.get_vocab_size())]
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)]
        self.length_a, self.length_b = (np.array([len(x) for x in side], np.int64) for side in (self.bytes_a, self.bytes_b))
        #: Ids as they are written: of A before another of its group and as the last, then those of B.
        self.marked = [f"{k}{m}" for side, marks in ((self.bytes_a, ",|"), (self.bytes_b, ",;")) for m in marks for k in range(len(side))]
        self.forget()

    def forget(self) -> None:
        """Starts with nothing known."""
        self.known: dict[str, int] = {}
        #: Of each chunk: tokens of A and of B, groups, links, and whether both sides give back its bytes.
        self.figures = np.zeros((5, 0), np.int64)
        self.groups: list[str] = []
        #: Linked pairs of all chunks, one after another, and where each chunk's end.
        self.pairs, self.pair_ends = np.zeros(0, np.int64), np.zeros(1, np.int64)
        #: What was learned and not yet laid behind the rest.
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def keep(self, numbers: np.ndarray) -> None:
        """Forgets all chunks but some."""
        names, groups = list(self.known), self.groups
        n = self.pair_ends[numbers + 1] - self.pair_ends[numbers]
        place = np.repeat(self.pair_ends[numbers] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        self.pairs, self.pair_ends, self.figures = self.pairs[place], np.r_[0, np.cumsum(n)], self.figures[:, numbers]
        self.known, self.groups = {names[k]: j for j, k in enumerate(numbers.tolist())}, [groups[k] for k in numbers.tolist()]

    def learn(self, chunks: list[str]) -> None:
        """What each new chunk gives; it stands after a space, which the library of B adds itself.

        Chunks go through the libraries many in one text, as such spaces part them there too. Where
        a text does not come back byte by byte, or a chunk ends in white space, each goes alone.
        """
        plain = [c for c in chunks if c and c[-1] not in _WHITE]
        alone = [c for c in chunks if not c or c[-1] in _WHITE]
        groups = [plain[k : k + JOINED] for k in range(0, len(plain), JOINED)]
        order: list[str] = []
        ids_a: list[int] = []
        ids_b: list[int] = []
        sizes: list[int] = []
        fits: list[bool] = []
        for group, own_a, own_b, text in self._encoded(groups):
            if own_a is None:
                alone += group
                continue
            order += group
            ids_a += own_a
            ids_b += own_b
            sizes += [len(c) + 1 for c in group] if text.isascii() else [len(c.encode()) + 1 for c in group]
            fits += [True] * len(group)
        for (chunk,), own_a, own_b, text in self._encoded([[c] for c in alone]):
            order.append(chunk)
            fits.append(own_a is not None)
            ids_a += own_a or []
            ids_b += own_b or []
            sizes.append(len(text) if fits[-1] else 0)
        self._cut_groups(np.array(ids_a, np.int64), np.array(ids_b, np.int64), np.cumsum(np.array(sizes, np.int64)), np.array(fits, bool))
        self.known |= {c: len(self.known) + k for k, c in enumerate(order)}

    def _encoded(self, groups: list[list[str]]) -> Iterator[tuple[list[str], list[int] | None, list[int] | None, bytes]]:
        """Each group as one text: the ids of both sides, or None if they do not give back its bytes."""
        joined = [" ".join(g) for g in groups]
        found_a = self.a.encode_batch_fast([" " + t for t in joined], add_special_tokens=False)
        found_b = self.b.encode(joined, num_threads=1)
        bytes_a, bytes_b = self.bytes_a.__getitem__, self.bytes_b.__getitem__
        for group, text, own_a, own_b in zip(groups, joined, found_a, found_b, strict=True):
            whole, own_a = (" " + text).encode("utf-8", "surrogatepass"), own_a.ids
            same = b"".join(map(bytes_a, own_a)) == whole == b"".join(map(bytes_b, own_b))
            yield (group, own_a, own_b, whole) if same else (group, None, None, whole)

    def _cut_groups(self, ids_a: np.ndarray, ids_b: np.ndarray, edges: np.ndarray, fits: np.ndarray) -> None:
        """Figures, links and written groups of chunks whose ids run over the same bytes and that end at ``edges``."""
        ends_a, ends_b = np.cumsum(self.length_a[ids_a]), np.cumsum(self.length_b[ids_b])
        cuts = np.intersect1d(ends_a, ends_b, assume_unique=True)
        if not np.isin(edges[edges > 0], cuts).all():
            raise ValueError("a token crosses a space that parts chunks")
        group_a, group_b = np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b)
        in_a, in_b = np.bincount(group_a, minlength=len(cuts)), np.bincount(group_b, minlength=len(cuts))
        chunk_a, chunk_b, chunk = (np.searchsorted(edges, x) for x in (ends_a, ends_b, cuts))
        n_a, n_b, n_groups = (np.bincount(x, minlength=len(edges)) for x in (chunk_a, chunk_b, chunk))
        n_links = np.bincount(chunk, in_a * in_b, minlength=len(edges)).astype(np.int64)
        # Each token of A is linked with all of B in its group.
        times = in_b[group_a]
        start = np.repeat((np.cumsum(in_b) - in_b)[group_a], times)
        step = np.arange(len(start)) - np.repeat(np.cumsum(times) - times, times)
        pairs = np.repeat(ids_a, times) * len(self.bytes_b) + ids_b[start + step]
        self.parts.append((pairs, n_links, np.array([n_a, n_b, n_groups, n_links, fits])))
        # Written: ids of A and then of B, group after group, each with the mark that follows it.
        last_a, last_b = np.r_[group_a[1:] != group_a[:-1], True][: len(ids_a)], np.r_[group_b[1:] != group_b[:-1], True][: len(ids_b)]
        size = len(self.bytes_a)
        token = np.r_[ids_a + last_a * size, ids_b + last_b * len(self.bytes_b) + 2 * size]
        order = np.argsort(np.r_[2 * group_a, 2 * group_b + 1], kind="stable")
        written = list(map(self.marked.__getitem__, token[order].tolist()))
        ends = np.cumsum(n_a + n_b).tolist()
        self.groups += ["".join(written[x:y]) for x, y in zip([0, *ends], ends, strict=False)]

    def lay(self) -> None:
        pairs, links, figures = zip(*self.parts, strict=True)
        self.pairs = np.concatenate([self.pairs, *pairs])
        self.pair_ends = np.concatenate([self.pair_ends, self.pair_ends[-1] + np.cumsum(np.concatenate(links))])
        self.figures = np.concatenate([self.figures, *figures], axis=1)
        self.parts = []

    @staticmethod
    def cut(texts: pa.Array) -> pa.Array:
        """The chunks of each text; a text has one at least."""
        uneven = pc.match_substring_regex(texts, _UNEVEN)
        if not pc.any(uneven).as_py():
            return pc.split_pattern(texts, " ")
        mask = uneven.to_numpy(zero_copy_only=False)
        even = pc.split_pattern(texts.filter(pc.invert(uneven)), " ")
        odd = pa.array([_CUT.split(t) for t in texts.filter(uneven).to_pylist()], even.type)
        place = np.empty(len(mask), np.int64)
        place[~mask], place[mask] = np.arange((~mask).sum()), (~mask).sum() + np.arange(mask.sum())
        return pa.concat_arrays([even, odd]).take(pa.array(place))

    def documents(self, texts: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Of each text: figures and the digest of its groups; then pairs, documents and times of what is linked."""
        if len(self.known) > MEMO_CHUNKS:
            self.keep(self.met)
        before = len(self.known)
        lists = self.cut(pc.fill_null(texts.cast(pa.large_string()), ""))
        coded = lists.flatten().dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        if new := [c for c in distinct if c not in self.known]:
            for k in range(0, len(new), LEARNED):
                self.learn(new[k : k + LEARNED])
            self.lay()
        known = self.known
        number, place = np.array([known[c] for c in distinct], np.int64), coded.indices.to_numpy()
        #: Chunks that were met again: in this batch, or here and before.
        self.met = np.sort(number[(np.bincount(place, minlength=len(distinct)) > 1) | (number < before)])
        chunk = number[place]
        lengths = pc.list_value_length(lists).to_numpy().astype(np.int64)
        ends = np.cumsum(lengths)
        starts = ends - lengths
        fits = np.logical_and.reduceat(self.figures[4][chunk] > 0, starts) if len(starts) else np.zeros(0, bool)
        figures = np.add.reduceat(self.figures[:4, chunk], starts, axis=1) * fits if len(starts) else np.zeros((4, 0), np.int64)
        groups, digests = self.groups, []
        for a, b, yes in zip(starts.tolist(), ends.tolist(), fits.tolist(), strict=True):
            digests.append(hashlib.sha256("".join([groups[k] for k in chunk[a:b].tolist()])[:-1].encode()).hexdigest() if yes else "")
        doc = np.repeat(np.arange(len(lengths)), lengths)
        there = fits[doc]
        of, times = np.unique(doc[there] * len(known) + chunk[there], return_counts=True)
        doc, chunk = of // len(known), of % len(known)
        n = self.pair_ends[chunk + 1] - self.pair_ends[chunk]
        place = np.repeat(self.pair_ends[chunk] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return figures, digests, self.pairs[place], np.repeat(doc, n), np.repeat(times, n)


def _slots(n_ids: int, stripes: int) -> int:
    """Ids of a stripe."""
    return -(-n_ids // stripes)


_LINKS = "stripe int, pairs binary, docs_of binary, docs binary, times binary"
_MADE = f"batch bigint, slot int, id_place int, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, {_LINKS}"


def _pack(values: np.ndarray, kind: str) -> bytes:
    import zstandard

    return zstandard.compress(values.astype(kind).tobytes(), 1)


def _unpack(data: bytes, kind: str) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.decompress(data), kind)


def _batches(path_a: str, path_b: str, stripes: int, id_type: T.DataType):
    """One row for each document, and one for each stripe of a batch: pairs, how many documents hold each, and which."""
    from pyspark.sql.pandas.types import to_arrow_type

    schema = pa.schema(
        [("doc_id", to_arrow_type(id_type)), ("batch", pa.int64()), ("slot", pa.int32())]
        + [(c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")]
        + [("groups_sha256", pa.string()), ("stripe", pa.int32())]
        + [(c, pa.binary()) for c in ("pairs", "docs_of", "docs", "times")]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = kept(("aligner", path_a, path_b), lambda: Aligner(path_a, path_b))
        width, rows = len(aligner.bytes_b), _slots(len(aligner.bytes_a), stripes)
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for at, n in slices(batch.column("text"), BATCH_ROWS, BATCH_BYTES):
                part = batch.slice(at, n)
                figures, digests, pairs, docs, times = aligner.documents(part.column("text"))
                nothing = pa.nulls(n, pa.binary())
                columns = [part.column("doc_id"), pa.array(np.full(n, number)), pa.array(np.arange(n, dtype=np.int32)), *map(pa.array, figures), pa.array(digests), pa.nulls(n, pa.int32()), *[nothing] * 4]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)
                a, b = pairs // width, pairs % width
                # Pairs in order of stripes: place in the dense block of a stripe, then the document.
                key = (((a % stripes) * rows + a // stripes) * width + b << 16) | docs
                order = np.argsort(key)
                key, times = key[order], times[order]
                new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][: len(key)])
                times, key = np.add.reduceat(times, new) if len(new) else times, key[new]
                docs, place = key & 0xFFFF, key >> 16
                edges = np.searchsorted(place, np.arange(stripes + 1) * rows * width)
                made: list[list] = [[] for _ in range(5)]
                for stripe, (x, y) in enumerate(zip(edges.tolist(), edges[1:].tolist(), strict=False)):
                    if x < y:
                        own, docs_of = np.unique(place[x:y] - stripe * rows * width, return_counts=True)
                        row = (stripe, _pack(own, "<u4"), _pack(docs_of, "<u4"), _pack(docs[x:y], "<u2"), _pack(times[x:y], "<u4"))
                        for to, value in zip(made, row, strict=True):
                            to.append(value)
                if made[0]:
                    m = len(made[0])
                    columns = [pa.nulls(m, schema[0].type), pa.array(np.full(m, number)), pa.nulls(m, pa.int32()), *[pa.nulls(m, pa.int64())] * 4, pa.nulls(m, pa.string())]
                    columns += [pa.array(made[0], pa.int32()), *(pa.array(v, pa.binary()) for v in made[1:])]
                    yield pa.RecordBatch.from_arrays(columns, schema=schema)
                number += 1
        rest()

    return run


def _counted(cells: int, kind: str, final: bool):
    """Of rows sorted by stripe: the counts of each stripe, added up in a dense block; at last with what is best."""

    def given(stripe: int, block: np.ndarray, width: int) -> pa.RecordBatch:
        there = np.flatnonzero(block)
        counts = block[there]
        row = [[stripe], [_pack(there, "<u4")], [_pack(counts, "<u8")]]
        kinds, names = [pa.int32(), pa.binary(), pa.binary()], ["stripe", "pairs", "docs_of"]
        if final:
            most = block.reshape(-1, width).max(axis=1)
            row, kinds, names = [*row, [_pack(counts == most[there // width], "?")]], [*kinds, pa.binary()], [*names, "best"]
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, kinds, strict=True)], names=names)

    def run(width: int, source: str):
        def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block, held = np.zeros(cells, np.int64), None
            for batch in batches:
                for stripe, pairs, docs_of in zip(*(batch.column(c).to_pylist() for c in ("stripe", "pairs", "docs_of")), strict=True):
                    if stripe != held and held is not None:
                        yield given(held, block, width)
                        block[:] = 0
                    held = stripe
                    np.add.at(block, _unpack(pairs, "<u4"), _unpack(docs_of, source).astype(np.int64))
            if held is not None:
                yield given(held, block, width)
            rest()

        return of

    return lambda width: run(width, kind)


def _scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by stripe, its counts first: each batch's documents, links that are best, and sums of counts."""
    pairs = counts = best = None
    for batch in batches:
        out: list[list] = [[] for _ in range(4)]
        for number, *row in zip(*(batch.column(c).to_pylist() for c in ("batch", "pairs", "docs_of", "docs", "times", "best")), strict=True):
            if row[4] is not None:
                pairs, counts, best = _unpack(row[0], "<u4"), _unpack(row[1], "<u8").astype(np.int64), _unpack(row[4], "?")
                continue
            at, docs_of = np.searchsorted(pairs, _unpack(row[0], "<u4")), _unpack(row[1], "<u4")
            docs, times = _unpack(row[2], "<u2"), _unpack(row[3], "<u4").astype(np.int64)
            sums, n_best = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
            np.add.at(sums, docs, times * np.repeat(counts[at], docs_of))
            np.add.at(n_best, docs, times * np.repeat(best[at], docs_of))
            own = np.unique(docs)
            for to, value in zip(out, (number, _pack(own, "<u2"), _pack(n_best[own], "<u8"), _pack(sums[own], "<u8")), strict=True):
                to.append(value)
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), *(pa.array(v, pa.binary()) for v in out[1:])], names=["batch", "docs", "n_best", "count_sum"])
    rest()


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by batch: the sums of each of its documents over all stripes."""
    held, n_best, sums, seen = None, np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), np.zeros(1 << 16, bool)

    def given() -> pa.RecordBatch:
        own = np.flatnonzero(seen)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(own), held)), pa.array(own.astype(np.int32)), pa.array(n_best[own]), pa.array(sums[own])], names=["batch", "slot", "n_best", "count_sum"])

    for batch in batches:
        for number, docs, best, count in zip(*(batch.column(c).to_pylist() for c in ("batch", "docs", "n_best", "count_sum")), strict=True):
            if number != held and held is not None:
                yield given()
                n_best[:], sums[:], seen[:] = 0, 0, False
            held, own = number, _unpack(docs, "<u2")
            n_best[own] += _unpack(best, "<u8").astype(np.int64)
            sums[own] += _unpack(count, "<u8").astype(np.int64)
            seen[own] = True
    if held is not None:
        yield given()


def _sizes(path_a: str, path_b: str, stripes: int) -> tuple[int, int]:
    """Ids of side B, and those of side A in a stripe."""
    import sentencepiece
    from tokenizers import Tokenizer

    return sentencepiece.SentencePieceProcessor(model_file=path_b).get_piece_size(), _slots(Tokenizer.from_file(path_a).get_vocab_size(), stripes)


def _linked(docs: DataFrame, path_a: str, path_b: str, stripes: int, id_col: str, text_col: str) -> DataFrame:
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    id_type = source.schema["doc_id"].dataType
    schema = f"doc_id {id_type.simpleString()}, batch bigint, slot int, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, {_LINKS}"
    return materialize(source.mapInArrow(_batches(path_a, path_b, stripes, id_type), schema), "linked")


def _matrix(links: DataFrame, batches: int, width: int, rows: int) -> DataFrame:
    """Counts of documents by stripe; many batches are added up in several tasks of a stripe first."""
    salts = -(-batches // (8 * BATCHES_A_TASK))
    counts, kind = links.select("stripe", "pairs", "docs_of", "batch"), "<u4"
    if salts > 1:
        dealt = counts.withColumn("salt", F.pmod(F.xxhash64("batch"), F.lit(salts))).repartition("stripe", "salt").sortWithinPartitions("stripe", "salt")
        counts, kind = dealt.select("stripe", "pairs", "docs_of").mapInArrow(_counted(rows * width, kind, False)(width), "stripe int, pairs binary, docs_of binary"), "<u8"
    by_stripe = counts.select("stripe", "pairs", "docs_of").repartition("stripe").sortWithinPartitions("stripe")
    return materialize(by_stripe.mapInArrow(_counted(rows * width, kind, True)(width), "stripe int, pairs binary, docs_of binary, best binary"), "matrix")


def pair_counts(docs: DataFrame, path_a: str, path_b: str, stripes: int = STRIPES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``a``, ``b``, ``docs``, ``best``: in how many documents two ids are linked, and whether no other of B is for A's id more often."""
    width, rows = _sizes(path_a, path_b, stripes)
    made = _linked(docs, path_a, path_b, stripes, id_col, text_col)
    matrix = _matrix(made.where("stripe IS NOT NULL"), made.select("batch").distinct().count(), width, rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for stripe, pairs, docs_of, best in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                place = _unpack(pairs, "<u4").astype(np.int64)
                columns = [place // width * stripes + stripe, place % width, _unpack(docs_of, "<u8").astype(np.int64), _unpack(best, "?")]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["a", "b", "docs", "best"])

    return matrix.mapInArrow(run, "a bigint, b bigint, docs bigint, best boolean")


def align(docs: DataFrame, path_a: str, path_b: str, stripes: int = STRIPES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's tokens of both sides, groups, links, links that are best, and sum of counts.

    Side A encodes a space and the text by a byte-level vocabulary, side B the text by a
    sentencepiece model, which adds the space. Byte offsets at which tokens of both end cut them into
    groups; all tokens of A in a group are linked with all of B there. A pair of ids counts in how
    many rows it is linked; a link is best if no pair of its A id counts more. ``groups_sha256`` is
    a digest of the ids by group.

    Null and empty texts, and those that the tokens of either side do not give back byte by byte, have
    no tokens: zeros and an empty digest. Rows that repeat or share an id, null ids included, each
    count and keep their place in the result; other columns are left out, whatever their names; an
    empty table gives an empty one. A text of more than a batch's bytes is a batch alone.

    A stripe's block holds ``vocabulary of A / stripes`` times the vocabulary of B counters, whatever
    the data. Links of one stripe are dealt over as many tasks as their batches ask for, and its counts
    go to each, so a frequent id fills no task.
    """
    width, rows = _sizes(path_a, path_b, stripes)
    made = _linked(docs, path_a, path_b, stripes, id_col, text_col)
    links = made.where("stripe IS NOT NULL")
    batches = made.select("batch").distinct().count()
    matrix = _matrix(links, batches, width, rows)
    salts = max(1, -(-batches // BATCHES_A_TASK))
    nothing = F.lit(None).cast("binary")
    counts = matrix.select("stripe", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("salt"), F.lit(None).cast("long").alias("batch"), "pairs", "docs_of", nothing.alias("docs"), nothing.alias("times"), "best")
    dealt = links.select("stripe", F.pmod(F.xxhash64("batch"), F.lit(salts)).alias("salt"), "batch", "pairs", "docs_of", "docs", "times", nothing.alias("best"))
    met = counts.unionByName(dealt).repartition("stripe", "salt").sortWithinPartitions("stripe", "salt", F.col("batch").asc_nulls_first())
    scored = met.mapInArrow(_scored, "batch bigint, docs binary, n_best binary, count_sum binary")
    sums = scored.repartition("batch").sortWithinPartitions("batch").mapInArrow(_summed, "batch bigint, slot int, n_best bigint, count_sum bigint")
    own = made.where("stripe IS NULL").select("batch", "slot", F.col("doc_id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    joined = own.join(sums.hint("shuffle_hash"), ["batch", "slot"], "left")
    result = joined.select(id_col, "n_a", "n_b", "n_groups", "n_links", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_best", "count_sum")], "groups_sha256")
    result = materialize(result, "aligned")
    release(made, matrix)
    return result
