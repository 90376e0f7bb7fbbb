"""Hard negatives: positives' upper limits cut the scores into disjoint slots, and each slot keeps its best rows."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonewheel.operators.skew import top_k
from tonewheel.session import settle

#: Anchors that a task holds while rows stream past, and the rows of the smallest chunk of the table.
STRIP, LEAST_CHUNK = 4096, 1024
#: Sides of one product.
SLAB_ANCHORS, SLAB_ROWS = 512, 2048
NONE, MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max
HIT = "_a long, slot int, score long, id long"


def quantised(x: np.ndarray, scale: float) -> np.ndarray:
    return np.floor(scale * x.astype(np.float64))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers; beyond a long, the nearest long."""
    bound = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(a.shape[1], 1)
    if bound < 2.0**53:  # every partial sum is a whole number that a double holds
        return (a @ b.T).astype(np.int64)
    whole = np.frompyfunc(int, 1, 1)
    found = whole(a).astype(object) @ whole(b).astype(object).T
    return np.clip(found, NONE + 1, MOST).astype(np.int64)


def by_length(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and matrix of the vectors of each length."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        flat = column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False)
        yield at, flat.reshape(len(at), int(size))


class Best:
    """The first ``k`` rows of each group (higher score, then smaller id) of all that were offered."""

    def __init__(self, groups: int, k: int):
        self.k, self.least = k, np.full(groups, NONE, np.int64)
        self.group, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))

    def offer(self, group: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        group, score, ids = (np.concatenate(p) for p in ((self.group, group), (self.score, score), (self.id, ids)))
        order = np.lexsort((ids, -score, group))
        group, score, ids = group[order], score[order], ids[order]
        rank = np.arange(len(group)) - np.searchsorted(group, group)
        keep = rank < self.k
        self.least[group[rank == self.k - 1]] = score[rank == self.k - 1]
        self.group, self.score, self.id = group[keep], score[keep], ids[keep]


class Strip:
    """The anchors of one cell, and the best rows of every slot so far.

    ``limits`` are descending upper limits, so a score belongs to the last slot whose limit it doesn't pass; ``low`` is
    the least score that any window of the anchor lets in.
    """

    def __init__(self, anchors: list[pa.RecordBatch], scale: float, k: int, same: bool):
        rows = pa.Table.from_batches(anchors).combine_chunks()
        column = {n: rows[n].chunk(0) if rows.num_rows else rows[n].combine_chunks() for n in rows.column_names}
        self.scale, self.k, self.same, self.codes = scale, k, same, {}
        self.key, self.id = column["_a"].to_numpy(), column["id"].to_numpy()
        self.label = self._coded(column["label"])
        given = column["limits"].to_pylist()
        self.slots = max(map(len, given), default=1)
        self.limits = np.array([x + [NONE] * (self.slots - len(x)) for x in given], np.int64).reshape(-1, self.slots)
        self.low = column["low"].to_numpy()
        self.best = Best(len(self.key) * self.slots, k)
        self.parts = [(at, quantised(m, scale)) for at, m in by_length(column["vec"])]

    def _coded(self, labels: pa.Array) -> np.ndarray:
        return np.array([self.codes.setdefault(x, len(self.codes)) for x in labels.to_pylist()], np.int64)

    def feed(self, rows: pa.RecordBatch) -> None:
        ids, labels = rows.column("id").to_numpy(), self._coded(rows.column("label"))
        for at, vectors in by_length(rows.column("vec")):
            for mine, own in self.parts:
                if own.shape[1] == vectors.shape[1]:
                    for a in range(0, len(mine), SLAB_ANCHORS):
                        for b in range(0, len(at), SLAB_ROWS):
                            to, part = at[b: b + SLAB_ROWS], quantised(vectors[b: b + SLAB_ROWS], self.scale)
                            self._meet(mine[a: a + SLAB_ANCHORS], own[a: a + SLAB_ANCHORS], part, ids[to], labels[to])

    def _meet(self, mine: np.ndarray, own: np.ndarray, part: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> None:
        score = products(own, part)
        match = (self.label[mine][:, None] == labels) == self.same
        match &= (self.id[mine][:, None] != ids) & (score >= self.low[mine][:, None])
        slot = (score[:, :, None] <= self.limits[mine][:, None, :]).sum(2) - 1
        for s in range(self.slots):
            here = np.where(match & (slot == s), score, NONE)
            least = self.best.least[mine * self.slots + s]
            if here.shape[1] > self.k:
                least = np.maximum(least, np.partition(here, -self.k, axis=1)[:, -self.k])
            r, c = np.nonzero((here >= least[:, None]) & (here > NONE))
            if len(r):
                self.best.offer(mine[r] * self.slots + s, here[r, c], ids[c])

    def hits(self) -> pa.RecordBatch:
        b = self.best
        return pa.record_batch([
            pa.array(self.key[b.group // self.slots], pa.int64()), pa.array((b.group % self.slots).astype(np.int32)),
            pa.array(b.score), pa.array(b.id),
        ], names=["_a", "slot", "score", "id"])


def _best_of_cells(anchors: DataFrame, rows: DataFrame, counts: tuple[int, int], scale: float, k: int, same: bool) -> DataFrame:
    """``_a, slot, score, id``: the first ``k`` rows of each anchor and slot, of rows of the same or of another label.

    A cell is one strip of anchors and one chunk of the table (``same``: of one label in it). Rows of a cell come sorted
    with the anchors first: those are held, the rows stream past in batches. Chunks grow as the root of the table, so
    what the cells hand on doesn't grow with it twice. Hot labels and common vectors are dealt by the row's id.
    """
    n, m = counts
    strips, chunks = max(1, ceil(m / STRIP)), max(1, ceil(sqrt(n / LEAST_CHUNK)))
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    held = anchors.select(
        "_a", "id", "label", "vec", "limits", "low", F.pmod(F.xxhash64("_a"), F.lit(strips)).cast("int").alias("_strip"),
        every(chunks).alias("_chunk"), F.lit(0).alias("_side"),
    )
    passing = rows.select(
        F.lit(None).cast("long").alias("_a"), "id", "label", "vec", F.lit(None).cast("array<long>").alias("limits"),
        F.lit(None).cast("long").alias("low"), every(strips).alias("_strip"),
        F.pmod(F.xxhash64("id"), F.lit(chunks)).cast("int").alias("_chunk"), F.lit(1).alias("_side"),
    )
    cell = ["_strip", "_chunk"] + (["label"] if same else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, waiting, strip = None, [], None
        for batch in batches:
            keys = list(zip(*[batch.column(c).to_pylist() for c in [*cell, "_side"]], strict=True))
            cuts = [0, *[i for i in range(1, len(keys)) if keys[i] != keys[i - 1]], len(keys)]
            for start, end in zip(cuts, cuts[1:], strict=False):
                if start == end:
                    continue
                part, here = batch.slice(start, end - start), keys[start][:-1]
                if here != at:
                    if strip:
                        yield strip.hits()
                    at, waiting, strip = here, [], None
                if keys[start][-1] == 0:
                    waiting.append(part)
                elif waiting or strip:
                    strip = strip or Strip(waiting, scale, k, same)
                    waiting = []
                    strip.feed(part)
        if strip:
            yield strip.hits()

    dealt = held.unionByName(passing).repartition(*cell).sortWithinPartitions(*cell, "_side")
    hits = dealt.mapInArrow(run, HIT)
    return top_k(hits, ["_a", "slot"], [F.col("score").desc(), F.col("id")], k, "place").drop("place")


def _exact(x: Column | str) -> Column:
    return (F.col(x) if isinstance(x, str) else x).cast("decimal(20,0)")


def hard_negatives(
    rows: DataFrame, is_anchor: Column, id_col: str = "vec_id", vec: str = "embedding", label: str = "label",
    positives: int = 5, k: int = 10, low: int = 30, high: int = 90, scale: float = 256.0,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for every anchor and positive.

    Vectors are compared by the inner product of ``floor(scale * x)``, exactly. An anchor's positives are its first
    ``positives`` other rows of its label; of each, the negatives are the first ``k`` rows of another label with
    ``low * p <= 100 * n <= high * p``. Higher scores come first, equal ones by smaller id.

    Slots: the distinct upper limits of an anchor's positives cut the scores into disjoint ranges. Tasks, then one top-k
    by anchor and slot, keep the first ``k`` of each range; a window's answer is the first ``k`` of the slots from its
    own limit downwards, one after the other, that its lower limit lets in. So all overlapping windows of an anchor are
    answered from at most ``positives * k`` rows.

    Rows with a null id or label, a null vector, or a null or non-finite component take no part. Vectors of different
    lengths are not compared. Rows of the anchor's own id are never its positives or negatives. A row that comes
    several times counts as often, as an anchor too. A negative positive score opens no window. Products beyond a long
    count as the nearest long. Other columns are not read; no rows, or no anchors, give no rows.
    """
    whole = F.col(vec).isNotNull() & F.coalesce(F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    taken = rows.select(
        F.col(id_col).cast("long").alias("id"), F.col(label).cast("string").alias("label"), F.col(vec).alias("vec"),
        F.coalesce(is_anchor, F.lit(False)).alias("_anchor"), whole.alias("_whole"),
    ).filter("id is not null and label is not null and _whole").drop("_whole")
    anchors = settle(taken.filter("_anchor").drop("_anchor")).withColumn("_a", F.monotonically_increasing_id())
    anchors = settle(anchors)
    taken = taken.drop("_anchor")
    counts = taken.count(), anchors.count()

    wide = anchors.withColumn("limits", F.array(F.lit(int(MOST)))).withColumn("low", F.lit(int(NONE) + 1))
    first = _best_of_cells(wide, taken, counts, scale, positives, True)
    limit = F.floor(_exact("score") * high / 100).cast("long")
    mine = settle(first.filter("score >= 0").select(
        "_a", F.col("id").alias("positive_id"), F.col("score").alias("p"), limit.alias("limit"),
        F.ceil(_exact("score") * low / 100).cast("long").alias("low"),
    ))
    bounds = mine.groupBy("_a").agg(F.sort_array(F.collect_set("limit"), False).alias("limits"), F.min("low").alias("low"))
    asking = settle(anchors.join(bounds, "_a"))
    kept = _best_of_cells(asking, taken, counts, scale, k, False)
    # slots in order, best first inside each: what follows a slot's beginning is its suffix
    suffix = kept.groupBy("_a").agg(F.array_sort(F.collect_list(F.struct(
        "slot", (-F.col("score")).alias("minus"), "id"))).alias("found"))
    slot = F.array_position("limits", F.col("limit")) - 1
    windows = (
        asking.select("_a", F.col("id").alias("anchor_id"), "limits")
        .join(mine, "_a").join(suffix, "_a")
        .withColumn("own", slot)
        .withColumn("found", F.slice(F.filter("found", lambda c: c["slot"] >= F.col("own")), 1, k))
        .withColumn("found", F.filter("found", lambda c: -c["minus"] >= F.col("low")))
    )
    return windows.select("anchor_id", "positive_id", "p", F.posexplode("found").alias("pos", "c")).select(
        "anchor_id", "positive_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("c.id").alias("negative_id"),
        F.col("p").alias("positive_score"), (-F.col("c.minus")).alias("negative_score"),
    )
