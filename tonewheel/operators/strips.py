"""Search with a strip of test rows held in a task while the train rows stream past.

A cell is one strip of test rows and one chunk of train rows, sorted so that the strip comes first. The strip keeps the
best rows so far of every test row (and every split); they leave the task once, when the chunk has passed. So what is
handed on doesn't grow with the number of batches, and memory is the strip, its best rows and one slab of a product.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a strip and entries of its best rows at most, train rows of a chunk, and the sides of one product.
STRIP_ROWS, HELD, CHUNK_ROWS = 1 << 16, 1 << 22, 1 << 22
SLAB_TEST, SLAB_TRAIN = 512, 4096
#: Nearest columns of a row that are looked at first when splits hide some, and entries that are ranked at a time.
FIRST, RANKED = 32, 1 << 24
WORD = 62


def strip_count(rows: int, per_row: int, block_rows: int, work: int, cores: int) -> int:
    """Enough strips for memory and, up to twice the cores, for the work to be shared out."""
    most = max(1, min(STRIP_ROWS, HELD // max(per_row, 1)))
    return max(1, -(-rows // most), min(max(-(-rows // block_rows), work), 2 * cores))


def packed(flags: Column, count: int) -> Column:
    """An array of 0/1 or booleans as longs of ``WORD`` bits."""
    return F.array(*[
        F.aggregate(F.slice(flags, w + 1, min(WORD, count - w)), F.lit(0).cast("long"), lambda a, v: a * 2 + v.cast("long"))
        for w in range(0, count, WORD)
    ])


def unpacked(words: np.ndarray, count: int) -> np.ndarray:
    """``[rows, count]`` booleans of ``[rows, words]`` longs."""
    parts = []
    for w in range(words.shape[1]):
        bits = min(WORD, count - w * WORD)
        parts.append((words[:, w: w + 1] >> np.arange(bits - 1, -1, -1)) & 1)
    return np.concatenate(parts, axis=1).astype(bool)


def streamed(held: DataFrame, passing: DataFrame, on: Sequence[str], begin: Callable, schema: T.StructType) -> DataFrame:
    """``begin(table of held rows)`` for each cell, its ``feed(batch)`` for the passing rows, then the batches of ``hits()``.

    Cells without held or without passing rows give nothing.
    """
    on = list(on)

    def side(df: DataFrame, name: str, number: int) -> DataFrame:
        rest = [F.col(c) for c in df.columns if c not in on]
        return df.select(*on, F.lit(number).alias("_side"), F.struct(*rest).alias(name))

    both = side(held, "_held", 0).unionByName(side(passing, "_passing", 1), allowMissingColumns=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, waiting, state = None, [], None
        for batch in batches:
            keys = list(zip(*[batch.column(c).to_pylist() for c in (*on, "_side")], strict=True))
            cuts = [0, *[i for i in range(1, len(keys)) if keys[i] != keys[i - 1]], len(keys)]
            for start, end in zip(cuts, cuts[1:], strict=False):
                if start == end:
                    continue
                if keys[start][:-1] != at:
                    if state:
                        yield from state.hits()
                    at, waiting, state = keys[start][:-1], [], None
                if keys[start][-1] == 0:
                    waiting.append(pa.RecordBatch.from_struct_array(batch.column("_held").slice(start, end - start)))
                elif waiting or state:
                    state = state or begin(pa.Table.from_batches(waiting))
                    waiting = []
                    state.feed(pa.RecordBatch.from_struct_array(batch.column("_passing").slice(start, end - start)))
        if state:
            yield from state.hits()

    return both.repartition(*on).sortWithinPartitions(*on, "_side").mapInArrow(run, schema)


class Strip:
    """The ``k`` nearest train rows so far of each held row, for each of ``runs`` splits (``runs`` 0: no splits).

    A block of held rows has one pool of candidates for all splits: what is among the ``k`` nearest of some split that
    asks for the row. Once every such split has ``k``, only rows nearer than the pool's last can enter, so of later
    slabs next to nothing but the product is left. New candidates are sorted in when they outnumber the pool.
    """

    def __init__(self, held: pa.Table, k: int, metric: str, runs: int, names: Sequence[str], brought: Sequence[str], schema: pa.Schema):
        from tonewheel.operators.knn import distances, matrix, unit_rows

        self._matrix, self._unit, self._distances = matrix, unit_rows, distances
        self.held, self.k, self.metric, self.names, self.brought, self.schema = held, k, metric, list(names), list(brought), schema
        self.splits = runs
        self.q = self._rows(held["_vec"])
        self.asked = unpacked(matrix_of(held["_bits"]), runs) if runs else None
        self.held = held.select(self.names)
        starts = range(0, len(self.q), SLAB_TEST)
        self.pools = [_Pool(np.zeros(0, np.int32), np.zeros(0), np.zeros(0, np.int64)) for _ in starts]
        self.waiting: list[list[_Pool]] = [[] for _ in starts]
        #: Key and place of the last candidate that can still matter, by held row; infinite while a split lacks rows,
        #: negative where no split asks.
        self.limit, self.last = np.full(len(self.q), np.inf), np.full(len(self.q), -1, np.int64)
        if runs:
            self.limit[~self.asked.any(1)] = -np.inf
        self.kept: pa.Table | None = None
        self.member = np.zeros((0, -(-runs // 8)), np.uint8)

    def _rows(self, column: pa.ChunkedArray) -> np.ndarray:
        x = self._matrix(column)
        return self._unit(x) if self.metric == "cosine" else x

    def feed(self, batch: pa.RecordBatch) -> None:
        rows = pa.Table.from_batches([batch])
        here = rows.select(["_id", *self.brought])
        base = self.kept.num_rows if self.kept is not None else 0
        table = pa.concat_tables([self.kept, here]) if self.kept is not None else here
        ids = table["_id"].to_numpy()
        self.rank = ids if np.issubdtype(ids.dtype, np.integer) else np.unique(ids, return_inverse=True)[1]
        t = self._rows(rows["_vec"])
        if self.splits:
            self.member = np.concatenate([self.member, np.packbits(~unpacked(matrix_of(rows["_bits"]), self.splits), axis=1)])
        for b in range(0, len(t), SLAB_TRAIN):
            part = t[b: b + SLAB_TRAIN]
            for block in range(len(self.pools)):
                a = block * SLAB_TEST
                self._meet(block, self._distances(self.q[a: a + SLAB_TEST], part, self.metric), base + b)
        self._forget(table)

    def _forget(self, table: pa.Table) -> None:
        """Keeps of the train rows only those that are candidates."""
        pools = [p for block, pool in enumerate(self.pools) for p in (pool, *self.waiting[block])]
        used = np.unique(np.concatenate([p.ref for p in pools] + [self.last[self.last >= 0]]))
        for p in pools:
            p.ref = np.searchsorted(used, p.ref)
        self.last = np.where(self.last >= 0, np.searchsorted(used, self.last), -1)
        self.kept, self.rank = table.take(pa.array(used)).combine_chunks(), self.rank[used]
        self.member = self.member[used] if self.splits else self.member

    def _meet(self, block: int, d: np.ndarray, base: int) -> None:
        """Takes in the columns within each row's limit; rows without one look at their nearest, then wider."""
        from tonewheel.operators.knn import TIE_DECIMALS

        at = block * SLAB_TEST
        limit = self.limit[at: at + len(d)]
        wide = min(max(8 * self.k, 8 * FIRST) if self.splits else self.k, d.shape[1])
        beyond, open_ = np.full(len(d), -np.inf), np.flatnonzero(np.isposinf(limit))
        margin = 10.0**-TIE_DECIMALS  # more than rounding moves a distance
        upto = limit + margin
        while True:
            if len(open_):
                near = np.partition(d[open_], wide - 1, axis=1)[:, wide - 1] if wide < d.shape[1] else np.full(len(open_), np.inf)
                upto[open_] = near + margin
            if (beyond == -np.inf).all():
                r, c = np.nonzero(d <= upto[:, None])
            else:
                r, c = np.nonzero((d[open_] <= upto[open_, None]) & (d[open_] > beyond[open_, None]))
                r = open_[r]
            dist, ref = d[r, c], base + c
            key, own, last = np.round(dist, TIE_DECIMALS), self.limit[at + r], self.last[at + r]
            inside = (key < own) | ((key == own) & (self.rank[ref] < self.rank[last]))
            self.waiting[block].append(_Pool(r[inside].astype(np.int32), dist[inside], ref[inside]))
            if len(open_) or sum(len(p.ref) for p in self.waiting[block]) > max(len(self.pools[block].ref), 64 * len(d)):
                self._settle(block)
            if not len(open_):
                return
            beyond[open_] = upto[open_]
            open_ = open_[np.isposinf(self.limit[at + open_])]
            if wide == d.shape[1] or not len(open_):
                return
            wide = min(4 * wide, d.shape[1])

    def _settle(self, block: int) -> None:
        """Sorts what waits into the block's pool, drops what no split needs any more and draws the limits."""
        pools = [self.pools[block], *self.waiting[block]]
        self.waiting[block] = []
        row, dist, ref = (np.concatenate(part) for part in zip(*[(p.row, p.dist, p.ref) for p in pools], strict=True))
        key = self._key(dist)
        order = np.lexsort((self.rank[ref], key, row))
        row, dist, ref, key = row[order], dist[order], ref[order], key[order]
        at, count = block * SLAB_TEST, min(SLAB_TEST, len(self.q) - block * SLAB_TEST)
        keep = np.zeros(len(row), bool)
        for some, rows, used, full in self._chosen(at, row, ref, count):
            keep[some] = used.any(1)
            kept = np.flatnonzero(keep[some]) + some.start
            end = np.searchsorted(row[kept], rows[full], side="right") - 1
            self.limit[at + rows[full]], self.last[at + rows[full]] = key[kept[end]], ref[kept[end]]
        self.pools[block] = _Pool(row[keep], dist[keep], ref[keep])

    def _key(self, dist: np.ndarray) -> np.ndarray:
        from tonewheel.operators.knn import TIE_DECIMALS

        return np.round(dist, TIE_DECIMALS)

    def _chosen(self, at: int, row: np.ndarray, ref: np.ndarray, count: int) -> Iterator[tuple]:
        """Some sorted candidates at a time: their slice, their held rows, ``[candidates, splits]`` true where one is
        among the ``k`` nearest, and for which of the held rows each split that asks has ``k``."""
        first = np.searchsorted(row, np.arange(count + 1))
        step = max(1, RANKED // max(1, self.splits))
        lo = 0
        while lo < count:
            hi = max(lo + 1, int(np.searchsorted(first, first[lo] + step, side="right")) - 1)
            some, rows = slice(int(first[lo]), int(first[hi])), np.arange(lo, hi)
            place = np.arange(some.stop - some.start) - (first[row[some]] - some.start)
            if not self.splits:
                yield some, rows, (place < self.k)[:, None], first[lo + 1: hi + 1] - first[lo:hi] >= self.k
            else:
                asked = self.asked[at + lo: at + hi]
                mask = np.unpackbits(self.member[ref[some]], axis=1, count=self.splits).view(bool) & asked[row[some] - lo]
                length, start = np.diff(first[lo: hi + 1]), first[lo:hi] - first[lo]
                have = np.zeros((hi - lo, self.splits), np.uint8 if self.k < 256 else np.int64)
                by_length = np.argsort(-length, kind="stable")
                longer = np.searchsorted(-length[by_length], -np.arange(length.max(initial=0)), side="left")
                for place, n in enumerate(longer):  # the next candidate of each row that has one
                    of = by_length[:n]
                    taken = mask[start[of] + place] & (have[of] < self.k)
                    mask[start[of] + place] = taken
                    have[of] += taken
                full = (~asked | (have >= self.k)).all(1) & (length > 0)
                yield some, rows, mask, full
            lo = hi

    def hits(self) -> Iterator[pa.RecordBatch]:
        for block in range(len(self.pools)):
            self._settle(block)
            pool, at = self.pools[block], block * SLAB_TEST
            for some, _, used, _ in self._chosen(at, pool.row, pool.ref, min(SLAB_TEST, len(self.q) - at)):
                run, entry = np.nonzero(used.T)  # by split, then by row, nearest first
                held = pool.row[some][entry]
                new = np.flatnonzero(np.concatenate([[True], (run[1:] != run[:-1]) | (held[1:] != held[:-1])])) if len(run) else run
                place = np.arange(len(run)) - np.repeat(new, np.diff(np.append(new, len(run))))
                yield from self._named(at + held, run, place, pool.dist[some][entry], pool.ref[some][entry])

    def _named(self, rows: np.ndarray, run: np.ndarray, place: np.ndarray, dist: np.ndarray, ref: np.ndarray) -> Iterator[pa.RecordBatch]:
        for start in range(0, len(rows), 1 << 16):
            r, s, p, d, x = (v[start: start + (1 << 16)] for v in (rows, run, place, dist, ref))
            near = self.kept.take(pa.array(x))
            columns = {n: c for n, c in zip(self.names, self.held.take(pa.array(r)).columns, strict=True)}
            columns |= {"run": pa.array(s.astype(np.int32)), "rank": pa.array((p + 1).astype(np.int32)), "dist": pa.array(d)}
            columns |= {"neighbour": near["_id"]} | {n: near[n] for n in self.brought}
            yield from pa.table({n: columns[n] for n in self.schema.names}).combine_chunks().to_batches()


@dataclass
class _Pool:
    """Candidates of a block: the held row inside the block, the distance and the train row's place in the table kept."""

    row: np.ndarray
    dist: np.ndarray
    ref: np.ndarray


def matrix_of(column: pa.ChunkedArray) -> np.ndarray:
    """Equally long lists of longs as a matrix."""
    flat = column.combine_chunks()
    return flat.flatten().to_numpy().reshape(len(column), -1)
