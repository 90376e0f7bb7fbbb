"""Alignment of two tokenizers: sparse token-byte matrices, multiplied row by row, give links between their tokens."""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonewheel.llm.shared import kept, maybe_broadcast
from tonewheel.session import settle

#: Neither tokenizer has a token that goes on over a single space between two of these; both split there.
CUT = re.compile(r"(?<=[!-~À-ɏ]) (?=[!-~À-ɏ])")
#: Code points that are looked at in one go, segments that a worker remembers, and rows of a product at a time.
UNIT, MEMORY, BLOCK = 1 << 20, 300_000, 1 << 18
SPACE = "▁"


@dataclass
class Csr:
    """Sparse rows: the entries of row ``i`` lie at ``indptr[i]:indptr[i + 1]``."""

    indptr: np.ndarray
    indices: np.ndarray
    data: np.ndarray
    columns: int

    @classmethod
    def spans(cls, sizes: np.ndarray) -> Csr:
        """Tokens by bytes: each token holds the bytes that follow those of the one before."""
        ends = np.concatenate([[0], np.cumsum(sizes)])
        return cls(ends, np.arange(ends[-1]), np.ones(ends[-1], np.int64), int(ends[-1]))

    @classmethod
    def members(cls, group: np.ndarray, groups: int) -> Csr:
        """Tokens by groups: each token lies in one."""
        return cls(np.arange(len(group) + 1), group, np.ones(len(group), np.int64), groups)

    def transposed(self) -> Csr:
        rows = np.repeat(np.arange(len(self.indptr) - 1), np.diff(self.indptr))
        order = np.argsort(self.indices, kind="stable")
        ends = np.concatenate([[0], np.cumsum(np.bincount(self.indices, minlength=self.columns))])
        return Csr(ends, rows[order], self.data[order], len(self.indptr) - 1)


def row_products(a: Csr, b: Csr, block: int = BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``row, column, value`` of ``a @ b`` by Gustavson: row ``i`` is the sum of those rows of ``b`` that it names.

    Some rows at a time (at least one), so that what lies unsummed is bounded by ``block`` or by one row.
    """
    heavy = np.diff(b.indptr)[a.indices]
    work = np.concatenate([[0], np.cumsum(heavy)])[a.indptr]
    start, rows = 0, len(a.indptr) - 1
    while start < rows:
        end = max(start + 1, int(np.searchsorted(work, work[start] + block, "right")) - 1)
        lo, hi = a.indptr[start], a.indptr[end]
        count = heavy[lo:hi]
        row = np.repeat(np.repeat(np.arange(start, end), np.diff(a.indptr[start: end + 1])), count)
        place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(b.indptr[a.indices[lo:hi]], count)
        key = row * b.columns + b.indices[place]
        order = np.argsort(key, kind="stable")
        key, value = key[order], (np.repeat(a.data[lo:hi], count) * b.data[place])[order]
        first = np.flatnonzero(np.diff(key, prepend=-1))
        if len(key):
            yield key[first] // b.columns, key[first] % b.columns, np.add.reduceat(value, first)
        start = end


def row_sizes(a: Csr, b: Csr) -> np.ndarray:
    """Entries of each row of ``a @ b`` if no two rows of ``b`` that one names meet: the product without its values."""
    return np.add.reduceat(np.append(np.diff(b.indptr)[a.indices], 0), a.indptr[:-1]) if len(a.indptr) > 1 else np.zeros(0, np.int64)


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary: itself, or the next one from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Pair:
    """Both tokenizers, with the bytes of every token and what a worker remembers of segments it has met."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has the cores
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=path_b)
        letters = byte_letters()
        with open(path_a, encoding="utf-8") as file:
            entries = json.load(file)
        vocabulary = entries["model"]["vocab"] | {t["content"]: t["id"] for t in entries["added_tokens"]}
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for token, k in vocabulary.items():
            self.bytes_a[k] = bytes(letters.get(c, 0) for c in token)
        self.bytes_b = [self._piece(k) for k in range(self.b.get_piece_size())]
        self.size_a, self.size_b = (np.array(list(map(len, x)), np.int64) for x in (self.bytes_a, self.bytes_b))
        ids = [str(k) for k in range(max(len(self.bytes_a), len(self.bytes_b)))]
        self.ends = [[x + end for x in ids] for end in (",", "|", ";")]
        self.known: dict[str, int] = {}
        self.sums = np.zeros((0, 6), np.int64)  # tokens of A, of B, groups, links, shared-group links, whether bytes agree
        self.said: list[str] = []
        self.starts, self.keys, self.hits = np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _piece(self, k: int) -> bytes:
        piece = self.b.id_to_piece(k)
        return bytes([int(piece[3:-1], 16)]) if self.b.is_byte(k) else piece.replace(SPACE, " ").encode()

    def _forget(self) -> None:
        """Only segments met again since the last time stay, if they are few enough."""
        stay = np.flatnonzero(self.hits > 1)
        stay = stay if len(stay) <= MEMORY // 2 else stay[:0]
        parts, said = list(self.known), self.said
        self.known = {parts[i]: n for n, i in enumerate(stay.tolist())}
        self.said = [said[i] for i in stay.tolist()]
        self.keys = self.keys[self.linked(stay)]
        self.sums, self.hits = self.sums[stay], np.zeros(len(stay), np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sums[:, 3])])

    def linked(self, at: np.ndarray) -> np.ndarray:
        """Places in ``keys`` of the links of segments, one segment after the other."""
        size = self.sums[at, 3]
        return np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(self.starts[at], size)

    def tokens(self, parts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of space+part by A and of part by B, which adds the space itself."""
        a = self.a.encode_batch_fast([" " + p for p in parts], add_special_tokens=False)
        return [x.ids for x in a], self.b.encode(parts, num_threads=1)

    def learn(self, parts: list[str]) -> None:
        """Tokens, links and groups of segments, of all at once: matrices with one block for each segment."""
        a, b = self.tokens(parts)
        good = [
            b"".join(map(self.bytes_a.__getitem__, x)) == (whole := (" " + p).encode()) == b"".join(map(self.bytes_b.__getitem__, y))
            for p, x, y in zip(parts, a, b, strict=True)
        ]
        a, b = ([x if g else [] for x, g in zip(ids, good, strict=True)] for ids in (a, b))
        found = Alignment(self, a, b)
        number = {n: len(self.known) + n for n in range(len(parts))}
        self.known.update((p, number[n]) for n, p in enumerate(parts))
        self.sums = np.concatenate([self.sums, np.column_stack([*found.sums, np.array(good, np.int64)])])
        self.said += found.said()
        self.starts = np.concatenate([self.starts, len(self.keys) + np.cumsum(found.sums[3])])
        self.keys = np.concatenate([self.keys, found.keys])
        self.hits = np.concatenate([self.hits, np.zeros(len(parts), np.int64)])

    def places(self, parts: list[str]) -> np.ndarray:
        """Where each segment is remembered; new ones are learnt first."""
        if len(self.known) > MEMORY:
            self._forget()
        new = list(dict.fromkeys(p for p in parts if p not in self.known))
        if new:
            self.learn(new)
        at = np.fromiter(map(self.known.__getitem__, parts), np.int64, len(parts))
        self.hits += np.bincount(at, minlength=len(self.hits))
        return at


    def agree(self, parts: list[str]) -> bool:
        """Whether the tokens of both give the bytes back."""
        at = self.places(parts)
        return bool(self.sums[at, 5].all())


class Alignment:
    """Links and groups of the tokens of several texts whose bytes agree, as products of sparse matrices."""

    def __init__(self, pair: Pair, a: list[list[int]], b: list[list[int]]):
        self.pair = pair
        self.of_a, self.of_b = (np.repeat(np.arange(len(x)), list(map(len, x))) for x in (a, b))
        self.a, self.b = (np.array([i for ids in x for i in ids], np.int64) for x in (a, b))
        bytes_a, bytes_b = Csr.spans(pair.size_a[self.a]), Csr.spans(pair.size_b[self.b])
        links = list(row_products(bytes_a, bytes_b.transposed()))
        self.row, self.column, self.overlap = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (zip(*links) if links else ([], [], [])))
        self.keys = (self.a[self.row] << 16) | self.b[self.column]
        shared = np.intersect1d(bytes_a.indptr[1:], bytes_b.indptr[1:], assume_unique=True)
        self.group_a, self.group_b = (np.searchsorted(shared, m.indptr[1:]) for m in (bytes_a, bytes_b))
        in_a, in_b = Csr.members(self.group_a, len(shared)), Csr.members(self.group_b, len(shared))
        partners = row_sizes(in_a, in_b.transposed())
        n = len(a)
        count = lambda of, w=None: np.bincount(of, w, n).astype(np.int64)
        last = np.flatnonzero(np.diff(self.group_a, append=-1)) if len(self.a) else np.zeros(0, np.int64)
        self.sums = [count(self.of_a), count(self.of_b), count(self.of_a[last]), count(self.of_a[self.row]), count(self.of_a, partners)]

    def said(self) -> list[str]:
        """``a1,a2|b1;a3|b2,b3`` of each text."""
        n = len(self.a) + len(self.b)
        end_a = np.where(np.diff(self.group_a, append=-1) != 0, 1, 0)
        end_b = np.where(np.diff(self.group_b, append=-1) != 0, 2, 0)
        # tokens of A before those of B in every group
        order = np.lexsort((np.repeat([0, 1], [len(self.a), len(self.b)]), np.concatenate([self.group_a, self.group_b])))
        ids, ends = np.concatenate([self.a, self.b])[order].tolist(), np.concatenate([end_a, end_b])[order].tolist()
        words = [self.pair.ends[e][i] for i, e in zip(ids, ends, strict=True)]
        stops = np.cumsum(self.sums[0] + self.sums[1]).tolist()
        assert not stops or stops[-1] == n
        return ["".join(words[start:stop])[:-1] for start, stop in zip([0, *stops], stops, strict=False)]


def pair_of(path_a: str, path_b: str) -> Pair:
    return kept(("token pair", path_a, path_b), lambda: Pair(path_a, path_b))


def units(text: str) -> Iterator[str]:
    """A text in pieces of bounded size, cut where both tokenizers split (a text without such places is one piece)."""
    at = 0
    while at + UNIT < len(text) and (cut := CUT.search(text, at + UNIT)):
        yield text[at: cut.start()]
        at = cut.end()
    yield text[at:]


class Told:
    """What is known of one document while its pieces go by."""

    def __init__(self):
        self.sums, self.digest, self.first, self.whole = np.zeros(5, np.int64), hashlib.sha256(), True, True
        self.keys, self.times = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, pair: Pair, at: np.ndarray) -> None:
        """Takes in one piece, given by the places of its segments."""
        found = pair.sums[at].sum(0)
        self.whole &= found[5] == len(at)
        self.sums += found[:5]
        self.digest.update((("" if self.first else ";") + ";".join(map(pair.said.__getitem__, at.tolist()))).encode())
        self.first = False
        keys, times = np.unique(pair.keys[pair.linked(at)], return_counts=True)
        if len(self.keys):
            keys, back = np.unique(np.concatenate([self.keys, keys]), return_inverse=True)
            times = np.bincount(back, np.concatenate([self.times, times])).astype(np.int64)
        self.keys, self.times = keys, times

    def row(self) -> tuple:
        if self.first or not self.whole:
            return (0, 0, 0, 0, 0, "", [], [], [])
        return (*map(int, self.sums), self.digest.hexdigest(), self.keys >> 16, self.keys & 0xFFFF, self.times)


def _take_in(pair: Pair, pieces: list[tuple[Told, list[str]]]) -> None:
    """Pieces of documents, with their segments looked up together."""
    at = pair.places([p for _, parts in pieces for p in parts])
    start = 0
    for told, parts in pieces:
        if parts:
            told.add(pair, at[start: start + len(parts)])
        start += len(parts)


def _documents(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Counts and digest of each row, with its distinct id pairs and how often each is linked."""
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_shared", "groups_sha256", "a", "b", "times"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = pair_of(path_a, path_b)
        for batch in batches:
            start, out, waiting, size = 0, [], [], 0
            for text in batch.column(1):
                out.append(Told())
                for unit in units(text.as_py() or ""):
                    waiting.append((out[-1], CUT.split(unit) if unit else []))
                    size += len(unit)
                    if size >= UNIT:
                        _take_in(pair, waiting)
                        waiting, size = [], 0
                if not waiting and len(out) >= 64:
                    yield _batch(batch, start, out, names)
                    start, out = start + len(out), []
            _take_in(pair, waiting)
            yield _batch(batch, start, out, names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, (
        "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_shared long, groups_sha256 string, "
        "a array<int>, b array<int>, times array<int>"
    ))


def _batch(batch: pa.RecordBatch, start: int, told: list[Told], names: list[str]) -> pa.RecordBatch:
    out = [t.row() for t in told]
    kinds = [pa.int64()] * 5 + [pa.string()] + [pa.list_(pa.int32())] * 3
    columns = [
        pa.array([np.asarray(r[k], np.int32) for r in out] if k > 5 else [r[k] for r in out], kind) for k, kind in enumerate(kinds)
    ]
    return pa.record_batch([batch.column(0).slice(start, len(out)), *columns], names=names)


def aligned(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """One row per row of ``docs`` (``doc_id``, ``text``): how the tokens of two tokenizers lie on each other.

    ``doc_id, n_a, n_b, n_groups, n_links, n_shared, n_best, count_sum, groups_sha256``. A is a byte-level vocabulary
    (JSON) and gets space+text, B a piece model that adds the space itself. Byte offsets where tokens of both end cut
    them into groups. Links join tokens whose bytes overlap: the non-zero entries of A·Bᵀ, where A and B are matrices of
    tokens by bytes; ``n_shared`` counts those of the product of tokens-by-groups matrices (tokens of one group). A pair
    of ids counts as often as links hold it, over all rows; ``count_sum`` adds up the counts over a row's links, and
    ``n_best`` counts its links whose pair has the highest count of its B id, ties included.

    Texts are cut where both tokenizers split; a segment's tokens and products are computed once as long as a worker
    remembers it (``MEMORY`` segments). Texts that are null or empty, or whose bytes the tokens of A or B don't give
    back (the mark that stands for a space in B's pieces can't), have no tokens: zeros and an empty digest. A row that
    comes several times counts as often; a null ``doc_id`` stays null; other columns are not read; no rows give no rows.

    A row's links leave its task folded by pair. Pair counts are summed before they are shuffled, so a pair that all
    texts have is one row a task; they are broadcast only if counted to be few, else joined by a shuffle.
    """
    told = settle(_documents(docs, path_a, path_b).withColumn("_row", F.monotonically_increasing_id()))
    each = told.select("_row", F.explode(F.arrays_zip("a", "b", "times")).alias("x")).select("_row", "x.a", "x.b", "x.times")
    counts = settle(each.groupBy("a", "b").agg(F.sum("times").alias("n")))
    best = counts.groupBy("b").agg(F.max("n").alias("top"))  # at most one row for each id of B
    ranked = settle(counts.join(F.broadcast(best), "b").select("a", "b", "n", (F.col("n") == F.col("top")).alias("best")))
    sums = each.join(maybe_broadcast(ranked), ["a", "b"]).groupBy("_row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum")
    )
    zero = F.lit(0).cast("long")
    return told.drop("a", "b", "times").join(sums, "_row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_shared", F.coalesce("n_best", zero).alias("n_best"),
        F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256",
    )


def overlap_links(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Every link of every row: ``doc_id, a_place, b_place, a_id, b_id, n_bytes, grp``.

    Places count a row's tokens from 0, ``n_bytes`` is how much of both tokens overlaps (the entry of the product) and
    ``grp`` numbers the row's groups from 0: tokens with one number share a group, so shared-group links are rows of
    equal ``grp`` and never written out pair by pair. Null, empty and unequal texts give no rows.
    """
    names = ["doc_id", "a_place", "b_place", "a_id", "b_id", "n_bytes", "grp"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = pair_of(path_a, path_b)
        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                text, base = text.as_py(), np.zeros(3, np.int64)
                if text and all(pair.agree(CUT.split(u)) for u in units(text)):
                    for unit in units(text):
                        found = Alignment(pair, *pair.tokens([unit]))
                        columns = [found.row + base[0], found.column + base[1], found.a[found.row], found.b[found.column],
                                   found.overlap, found.group_a[found.row] + base[2]]
                        yield pa.record_batch(
                            [pa.array([doc.as_py()] * len(found.row), pa.int64()), *[pa.array(c, pa.int64()) for c in columns]], names=names)
                        base += [len(found.a), len(found.b), int(found.sums[2][0])]

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, ", ".join(f"{n} long" for n in names))
