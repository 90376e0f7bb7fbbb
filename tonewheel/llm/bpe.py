"""Byte-level BPE: texts are cut into overlapping chunks, pre-tokenised side by side, stitched, and encoded by pieces."""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator
from functools import cached_property
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonewheel.llm.shared import frugal, kept, maybe_broadcast
from tonewheel.session import settle

#: Code points of a chunk without its overlap, and how far it reads on into the next one.
CHUNK, OVERLAP = 16_384, 1_024
#: Chunks that a very long text is first cut into together.
STRETCH = 64
#: Chunks that a worker turns into Python strings at a time.
CHUNK_ROWS = 100
CACHE_PIECES = 200_000
PART = pa.struct([("k", pa.int32()), ("last", pa.int32()), *[(name, pa.binary()) for name in ("ids", "head", "tail")]])
PART_DDL = "struct<k:int,last:int,ids:binary,head:binary,tail:binary>"


class Codec:
    """Ranks and pre-token pattern of one vocabulary, with a bounded memory of encoded pieces."""

    def __init__(self, path: str, pattern: str):
        import regex
        import tiktoken

        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.coder = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=self.ranks, special_tokens={})
        self.find = regex.compile(pattern).finditer
        self.bytes_of = [b""] * (max(self.ranks.values()) + 1)
        for piece, rank in self.ranks.items():
            self.bytes_of[rank] = piece
        self.digits = [str(k) for k in range(len(self.bytes_of))]
        self.known: dict[str, tuple[int, ...]] = {}

    @cached_property
    def odd(self):
        """Code points that the two pattern libraries put into different classes: they know different Unicode tables."""
        import regex
        import tiktoken

        every = "".join(map(chr, chain(range(0xD800), range(0xE000, 0x110000))))
        single, odd = {bytes([k]): k for k in range(256)}, set()
        for kind in (r"\p{L}", r"\p{N}", r"\s"):
            coder = tiktoken.Encoding("class", pat_str=kind, mergeable_ranks=single, special_tokens={})
            odd |= set(bytes(coder.encode_ordinary(every)).decode()) ^ set(regex.findall(kind, every))
        points = sorted(map(ord, odd))
        firsts = [p for k, p in enumerate(points) if not k or points[k - 1] != p - 1]
        lasts = [p for k, p in enumerate(points) if k + 1 == len(points) or points[k + 1] != p + 1]
        ranges = "".join(rf"\U{a:08x}-\U{b:08x}" for a, b in zip(firsts, lasts, strict=True))
        return regex.compile(f"[{ranges}]") if odd else None

    def pieces_known(self, text: str) -> bool:
        """Whether the pattern splits this text here as it does in the coder."""
        return text.isascii() or self.odd is None or not self.odd.search(text)

    def encode(self, text: str) -> list[int]:
        return self.coder.encode_ordinary(text)

    def encode_pieces(self, pieces: list[str]) -> list[int]:
        """Each piece by itself: what lies around it doesn't count any more."""
        return list(chain.from_iterable(map(self.ids_of, pieces)))

    def ids_of(self, piece: str) -> tuple[int, ...]:
        ids = self.known.get(piece)
        if ids is None:
            ids = tuple(self.coder._encode_single_piece(piece))
            if len(piece) <= 64:
                if len(self.known) >= CACHE_PIECES:
                    self.known.clear()
                self.known[piece] = ids
        return ids

    def count(self, piece: str) -> int:
        """Tokens of one piece."""
        ids = self.known.get(piece)
        return len(ids) if ids is not None else len(self.encode_pieces([piece]))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def codec(path: str, pattern: str) -> Codec:
    return kept(("codec", path, pattern), lambda: Codec(path, pattern))


def _finished(keys: list, encoded: list[tuple[int, str, str]], extra: list[pa.Array], names: list[str]) -> pa.RecordBatch:
    n, ids, decoded = zip(*encoded, strict=True) if encoded else ((), (), ())
    columns = [pa.array(keys, pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())]
    return pa.record_batch(columns + extra, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *names])


def _digests(c: Codec, ids: list[int]) -> tuple[int, str, str]:
    return (
        len(ids), hashlib.sha256(",".join(map(c.digits.__getitem__, ids)).encode()).hexdigest(),
        hashlib.sha256(c.decode(ids)).hexdigest(),
    )


def _chunks(docs: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """``_row, doc_id, k, last, text``: overlapping chunks of each text, dealt out over the tasks.

    Texts are cut twice, into stretches of many chunks and those into chunks, so that no cut looks for its place from the
    far beginning of a very long text.
    """
    count = F.greatest(F.ceil(F.char_length("text") / chunk).cast("int"), F.lit(1))
    stretch = F.explode(F.sequence(F.lit(0), F.expr(f"cast(last div {STRETCH} as int)")))
    inner = F.explode(F.sequence(F.lit(0), F.least(F.lit(STRETCH - 1), F.expr(f"last - far * {STRETCH}"))))
    return (
        docs.withColumn("last", count - 1).withColumn("far", stretch)
        .withColumn("text", F.expr(f"substring(text, far * {STRETCH * chunk} + 1, {STRETCH * chunk + overlap})"))
        .withColumn("near", inner)
        .select(
            "_row", "doc_id", F.expr(f"far * {STRETCH} + near").cast("int").alias("k"), "last",
            F.expr(f"substring(text, near * {chunk} + 1, {chunk + overlap})").alias("text"),
        )
        .repartition("_row", "k")
    )


def _encoded_chunks(docs: DataFrame, path: str, pattern: str, chunk: int, overlap: int) -> DataFrame:
    """Every chunk split and encoded where it is cut: ``_row, doc_id, part``.

    ``part`` holds ``k``, ``last``, the chunk's ``ids`` (packed), and for the beginnings of pieces within the overlap at its
    front (``head``) and beyond its end (``tail``) their distance from the border with the number of ids before each. The
    text goes no further.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in batches:
            rows = batch.to_pydict()
            parts = []
            for text, k, last in zip(rows["text"], rows["k"], rows["last"], strict=True):
                if not c.pieces_known(text):
                    parts.append({"k": k, "last": last, "ids": None, "head": None, "tail": None})
                    continue
                ids, head, tail = array("I"), array("I"), array("I")
                for m in c.find(text):
                    at = m.start()
                    # a beginning near the cut end may owe itself to the cut: leave out the last piece
                    if k == last or m.end() < len(text):
                        if at <= overlap:
                            head.extend((at, len(ids)))
                        if at >= chunk and k < last:
                            tail.extend((at - chunk, len(ids)))
                    ids.extend(c.ids_of(m[0]))
                parts.append({"k": k, "last": last, "ids": ids.tobytes(), "head": head.tobytes(), "tail": tail.tobytes()})
            yield pa.record_batch([batch.column("_row"), batch.column("doc_id"), pa.array(parts, PART)], names=["_row", "doc_id", "part"])

    return _chunks(docs.select("_row", "doc_id", "text"), chunk, overlap).mapInArrow(
        frugal(run, CHUNK_ROWS), f"_row string, doc_id long, part {PART_DDL}"
    )


def _places(packed: bytes) -> list[tuple[int, int]]:
    flat = array("I", packed)
    return list(zip(flat[::2], flat[1::2], strict=True))


def _joined(parts: list[dict]) -> list[int] | None:
    """The ids of a text from its chunks in order; None if some chunk was not split or never falls into step."""
    if [p["k"] for p in parts] != list(range(parts[0]["last"] + 1)):
        raise RuntimeError("the rows came in another order when they were read again: write the input to a table first")
    out, since = array("I"), 0
    for k, part in enumerate(parts):
        if part["ids"] is None:
            return None
        ids = array("I", part["ids"])
        if k == part["last"]:
            out.extend(ids[since:])
            break
        follow = parts[k + 1]
        if follow["ids"] is None:
            return None
        here, there = dict(_places(part["tail"])), _places(follow["head"])
        met = next(((here[at], n) for at, n in there if at in here), None)
        if met is None:
            return None
        out.extend(ids[since:met[0]])
        since = met[1]
    return out.tolist()


def stitched(docs: DataFrame, path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``_row, doc_id, ids`` of texts of any length; ``docs`` has ``_row`` (unique), ``doc_id`` and ``text``.

    A chunk is split from its first code point on and over its end by ``overlap``. Where a piece begins depends on
    nothing before it, so from the first beginning that a chunk shares with its predecessor both go on alike; from
    there the chunk's own pieces count, up to the same place of its successor. Only ids and the beginnings around the
    borders are gathered for a text. ``ids`` is null for a text in which some chunk never falls into step (a piece longer
    than the overlap lies on a border) or whose code points the two pattern libraries class differently.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                one = batch.slice(at, 1)
                ids = _joined(one.column("parts")[0].as_py())
                yield pa.record_batch(
                    [one.column("_row"), one.column("doc_id"), pa.array([ids], pa.list_(pa.int32()))], names=["_row", "doc_id", "ids"])

    gathered = _encoded_chunks(docs, path, pattern, chunk, overlap).groupBy("_row").agg(
        F.first("doc_id").alias("doc_id"), F.sort_array(F.collect_list("part")).alias("parts"))
    return gathered.mapInArrow(frugal(run), "_row string, doc_id long, ids array<int>")


def round_trip(docs: DataFrame, path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` for every row of ``docs`` (``doc_id``, ``text``).

    The ids are the vocabulary's, without special tokens; decoding joins the raw bytes of the ids, and the digest is of
    those bytes. Null texts count as empty (no tokens, digests of nothing). Ids may repeat or be null: rows come back as
    they came. Texts of at most ``chunk`` code points are one chunk and are encoded where they are read; longer ones go
    through ``stitched``, so a very long text is spread over many tasks. The digests of these are written once; texts that
    could not be stitched are then encoded whole, each in one task.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in batches:
            found = [_digests(c, c.encode(t.as_py())) for t in batch.column(1)]
            yield _finished(batch.column(0).to_pylist(), found, [], [])

    def long(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in batches:
            found = [(None, None, None) if ids is None else _digests(c, ids) for ids in (x.as_py() for x in batch.column(2))]
            yield _finished(batch.column(1).to_pylist(), found, [batch.column(0)], ["_row"])

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    size = F.char_length("text")
    digest = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), "text"))
    keyed = rows.filter(size > chunk).withColumn("_key", digest)
    # rows of one text and id are told apart by their places
    placed = keyed.withColumn("_row", F.concat_ws(":", "_key", F.monotonically_increasing_id().cast("string")))
    told = settle(stitched(placed, path, pattern, chunk, overlap).mapInArrow(frugal(long), f"{schema}, _row string"))
    stuck = told.filter("n_tokens is null").select(F.substring_index("_row", ":", 1).alias("_key")).distinct()
    results = rows.filter(size <= chunk).mapInArrow(frugal(short), schema).union(told.filter("n_tokens is not null").drop("_row"))
    if stuck.isEmpty():
        return results
    rest = keyed.join(maybe_broadcast(stuck), "_key", "left_semi").select("doc_id", "text")
    return results.union(rest.mapInArrow(frugal(short), schema))
