"""Substring dedup by units: lines cut at sentence ends; the earliest of equal runs of units stays, the rest goes by its offsets."""

from __future__ import annotations

import hashlib
import re
import struct
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tonewheel.session import settle

#: Units of fewer words go only within a repeated run of so many: short sentences agree by chance.
LEAST_WORDS = 8
#: A digest with over this share of all units (and so many places) is joined back by broadcast: at most 1 / share can be.
#: One row in HOT_PART, drawn by hash, tells which they are.
HOT_SHARE, HOT_PLACES, HOT_PART = 1e-5, 1_000, 32
# A unit ends at a line's end, or after the sign that ends a sentence.
UNIT = re.compile(r"[^\n]+?(?:(?<=[.!?])(?=[^\S\n])|(?=\n)|\Z)")


#: A digest travels as two numbers: such rows are of fixed size, without place and length of a byte string.
DIGEST = ["d1", "d2"]


def _digest(words: str) -> tuple[int, int]:
    return struct.unpack("<qq", hashlib.blake2b(words.encode(), digest_size=16).digest())


def normal(unit: str) -> str:
    """Case and white space don't count."""
    return " ".join(unit.lower().split())


def units(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """``d1, d2, doc_id, nth, start, end``: every unit with at least so many words; ``nth`` counts equals in a document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d1, d2, ids, nths, starts, ends = [], [], [], [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen: dict[tuple[int, int], int] = {}
                for m in UNIT.finditer(text or ""):
                    words = m[0].lower().split()
                    if len(words) >= least_words:
                        digest = _digest(" ".join(words))
                        seen[digest] = nth = seen.get(digest, -1) + 1
                        d1.append(digest[0])
                        d2.append(digest[1])
                        ids.append(doc)
                        nths.append(nth)
                        lead = len(m[0]) - len(m[0].lstrip())
                        starts.append(m.start() + lead)
                        ends.append(m.end())
            yield pa.record_batch(
                [*(pa.array(c, pa.int64()) for c in (d1, d2, ids)), *(pa.array(c, pa.int32()) for c in (nths, starts, ends))],
                names=[*DIGEST, "doc_id", "nth", "start", "end"],
            )

    rows = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "d1 long, d2 long, doc_id long, nth int, start int, end int")


def runs(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """``d1, d2, row, doc_id, nth, own, lo, hi``: the shortest runs of adjacent units with so many words.

    Of every unit, the run that begins with it and the run that ends with it; a unit with words enough is one by itself.
    These runs cover each longer run: a unit of it either begins or ends one that lies within. Runs go over line ends,
    and units without words are in none. A run is units ``lo`` to ``hi`` (exclusive) of its text; ``own`` is where the
    first equal run in the same text ends. One more row a text, without a digest, has its units' ``starts`` and ``ends``,
    so that no run carries them.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (*(pa.int64(),) * 4, *(pa.int32(),) * 4, pa.list_(pa.int32()), pa.list_(pa.int32()))
        for batch in batches:
            out: list[tuple] = []
            for row, doc, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                parts, starts, ends = [], [], []
                for m in UNIT.finditer(text or ""):
                    words = m[0].lower().split()
                    if words:
                        parts.append(words)
                        starts.append(m.start() + len(m[0]) - len(m[0].lstrip()))
                        ends.append(m.end())
                seen: dict[tuple[int, int], tuple[int, int]] = {}
                for i, j in shortest([len(p) for p in parts], least_words):
                    digest = _digest(" ".join(w for p in parts[i:j] for w in p))
                    nth, own = seen.get(digest, (0, j))
                    seen[digest] = (nth + 1, own)
                    out.append((*digest, row, doc, nth, own, i, j, None, None))
                if seen:
                    out.append((None, None, row, doc, None, None, None, None, starts, ends))
            columns = list(zip(*out, strict=True)) or [()] * len(kinds)
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)],
                                  names=[*DIGEST, "row", "doc_id", "nth", "own", "lo", "hi", "starts", "ends"])

    rows = docs.filter("doc_id is not null").select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "d1 long, d2 long, row long, doc_id long, nth int, own int, lo int, hi int, starts array<int>, ends array<int>")


def shortest(counts: list[int], least: int) -> list[tuple[int, int]]:
    """``i, j`` in order: slices of at least so many words that lose them without their last, or without their first, unit."""
    upto = [0, *accumulate(counts)]
    found = set()
    for k in range(len(counts)):
        j = bisect_left(upto, upto[k] + least)
        if j < len(upto):
            found.add((k, j))
        i = bisect_right(upto, upto[k + 1] - least) - 1
        if i >= 0:
            found.add((i, k + 1))
    return sorted(found)


def repeats(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """``doc_id, start, end, first_doc_id, n_places``: the units to remove, as code points of the original text.

    Units are ranked by doc_id and then by place; of equal normalised units over the whole corpus the first stays.
    Null and blank texts have no units; rows with a null doc_id have no rank and are left alone; rows that repeat a
    doc_id are one document, whose first places stay in each of them. Other columns are not read; no rows give no rows.

    Units are shuffled once, by digest; those of a line that a third of all texts has go to any task. The digests over
    ``HOT_SHARE`` of all units number 100,000 at most, a few megabytes, and go to where the units are.
    """
    joined = _later(settle(units(docs, least_words)))
    return joined.select("doc_id", "start", "end", "first_doc_id", "n_places")


def passages(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """``doc_id, start, end, first_doc_id, n_places``: as ``repeats``, and the short units of repeated passages too.

    The limit holds for the passage, a run of adjacent units, not for the unit: a line or paragraph of short sentences
    goes as a whole, and a removed passage has no holes. There is one row per unit. A short unit has the values of its
    run with the earliest first document (then the most places). Where equal runs of the first document overlap, the
    first of them stays whole.
    """
    found = settle(runs(docs, least_words))
    begin = F.when(F.col("doc_id") == F.col("first_doc_id"), F.greatest("lo", "own")).otherwise(F.col("lo"))
    # a text's runs meet as runs; they are cut into units where they have met
    each = _later(found.filter("d1 is not null").drop("starts", "ends")).select(
        "row", "doc_id", begin.alias("lo"), "hi", "first_doc_id", "n_places").filter("lo < hi").repartition("row")
    least = F.min(F.struct("first_doc_id", (-F.col("n_places")).alias("less"))).alias("m")
    units_of = each.withColumn("unit", F.explode(F.sequence("lo", F.col("hi") - 1))).groupBy("row", "doc_id", "unit").agg(least)
    places = found.filter("starts is not null").select("row", "starts", "ends")
    start, end = (F.element_at(c, F.col("unit") + 1).alias(c[:-1]) for c in ("starts", "ends"))
    return units_of.join(places, "row").select("doc_id", start, end, F.col("m.first_doc_id").alias("first_doc_id"), (-F.col("m.less")).alias("n_places"))


def _later(found: DataFrame) -> DataFrame:
    """The rows of ``found`` whose digest has an earlier place, with ``first_doc_id`` and ``n_places``.

    Which digests are frequent is told from a part of the rows; that decides how a digest's rows meet, never what comes
    out. Frequent ones are counted in full and broadcast, one row each, so that a place meets one row at most; the places
    of all others meet in one shuffle, through which those of frequent ones go wherever there is room.
    """
    some = found.filter(F.pmod(F.xxhash64(*found.columns), F.lit(HOT_PART)) == 0).groupBy(*DIGEST).count()
    hot = settle(some.filter(F.col("count") * HOT_PART > max(HOT_PLACES, int(found.count() * HOT_SHARE))).select(*DIGEST, F.lit(True).alias("hot")))
    first, places = F.min("doc_id"), F.count(F.lit(1))
    # all others are one group without a digest, which meets nothing
    own = [F.when(F.col("hot"), F.col(c)).alias(c) for c in DIGEST]
    often = settle(found.join(F.broadcast(hot), DIGEST, "left").groupBy(*own).agg(first.alias("first_often"), places.alias("often")))
    deal = F.when(F.col("often").isNotNull(), F.xxhash64("doc_id", "nth")).otherwise(0)
    same = Window.partitionBy(*DIGEST, "deal")
    told = found.join(F.broadcast(often), DIGEST, "left").withColumn("deal", deal).select(
        *found.columns, F.coalesce("first_often", first.over(same)).alias("first_doc_id"), F.coalesce("often", places.over(same)).alias("n_places"))
    return told.filter("doc_id <> first_doc_id or nth > 0")
