"""Embedding near-dedup on a robust-pruned flat graph, built on overlapping cluster shards and searched by range."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonewheel.llm.graphs import components
from tonewheel.session import settle

#: Vectors of a shard, about; the clusters' centres are a bounded sample, and a cluster beyond the size is cut by hash.
SHARD_ROWS = 1_024
MOST_CENTRES = 4_096
#: Clusters that a vector is indexed in; a query looks into every cluster that can own a vector in its range.
OVERLAP = 2
#: Neighbours kept in a list, how much nearer a detour must be to drop one, and nodes that a greedy search keeps open.
DEGREE, ALPHA, BEAM = 24, 1.2, 32
#: Queries of one search task, about: more that look into a shard are dealt to several tasks, each with the whole shard.
ASKED_ROWS = 8_192
#: Queries whose bounds are taken in one product, and nearest centres that a cell's planes are joined from.
BOUND_ROWS, PLANES = 256, 8


def usable(vectors: DataFrame) -> DataFrame:
    """Rows that may link: label and id known, no null or non-finite component, not zero."""
    return vectors.filter(_may_link())


def _may_link():
    v = F.col("embedding")
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return F.col("label").isNotNull() & F.col("vec_id").isNotNull() & v.isNotNull() & finite & F.exists(v, lambda c: c != 0)


def units(column: pa.Array) -> np.ndarray:
    """Unit rows in double precision."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(column), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def pruned(node: int, order: np.ndarray, near: np.ndarray, between: np.ndarray) -> list[int]:
    """Robust pruning: from near to far, a candidate is dropped if a kept one is nearer to it by the factor ALPHA."""
    kept: list[int] = []
    left = order
    while len(left) and len(kept) < DEGREE:
        best, left = int(left[0]), left[1:]
        kept.append(best)
        left = left[ALPHA * between[best, left] > near[left]]
    return kept


def shard_lists(x: np.ndarray) -> list[list[int]]:
    """Pruned neighbour lists of one shard, both ways, each of bounded length."""
    distance = np.sqrt(np.maximum(2 - 2 * x @ x.T, 0))
    np.fill_diagonal(distance, np.inf)
    width = min(4 * DEGREE, len(x) - 1)
    lists = []
    for k in range(len(x)):
        some = np.argpartition(distance[k], width - 1)[:width] if width < len(x) - 1 else np.delete(np.arange(len(x)), k)
        lists.append(pruned(k, some[np.argsort(distance[k, some], kind="stable")], distance[k], distance))
    back: list[set[int]] = [set(n) for n in lists]
    for k, own in enumerate(lists):
        for other in own:
            back[other].add(k)
    out = []
    for k, both in enumerate(back):
        some = np.fromiter(both, dtype=np.int64, count=len(both))
        some = some[np.argsort(distance[k, some], kind="stable")]
        out.append(some.tolist() if len(some) <= 2 * DEGREE else list(dict.fromkeys(lists[k] + some[:DEGREE].tolist())))
    return out


def landmarks(x: np.ndarray, lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entry points of a shard: the nodes, each node's nearest entry point, and the widest angle of each to its nodes.

    One node of each connected part of the graph, then evenly drawn ones; a few times the root of the shard's size in
    all. However they lie, the angles say which of the nodes that a search didn't meet can be in its range.
    """
    part = np.full(len(x), -1)
    both = [list(n) for n in lists]
    for k, near in enumerate(lists):
        for other in near.tolist():
            both[other].append(k)
    heads = []
    for k in range(len(x)):
        if part[k] < 0:
            heads.append(k)
            part[k], todo = k, [k]
            while todo:
                for other in both[todo.pop()]:
                    if part[other] < 0:
                        part[other] = k
                        todo.append(other)
    room = 4 * math.isqrt(len(x)) + 1
    marks = np.unique(np.concatenate([np.array(heads[:room]), np.linspace(0, len(x) - 1, min(len(x), room)).astype(np.int64)]))
    scores = x @ x[marks].T
    nearest = scores.argmax(axis=1)
    wide = np.zeros(len(marks))
    np.maximum.at(wide, nearest, np.arccos(np.clip(scores.max(axis=1), -1, 1)))
    return marks, nearest, wide


def range_search(
    x: np.ndarray, lists: list[np.ndarray], entries: tuple[np.ndarray, np.ndarray, np.ndarray], own: int | None, query: np.ndarray, least: float,
) -> np.ndarray:
    """All nodes with cosine >= least (less rounding): those that a search of the graph meets, then those it can't have met.

    The search starts at the query's own node and at the four nearest entry points. First the best BEAM nodes are
    expanded until none is left; from then on every node in range is expanded, however many there are. Parts of the
    range that no edge leads to are compared at last: nodes not seen whose entry point is near enough to have a node in
    range, by the triangle inequality.
    """
    marks, nearest, wide = entries
    angles = np.arccos(np.clip(x[marks] @ query, -1, 1))
    nodes = marks[np.argsort(angles, kind="stable")[:4]]
    if own is not None:
        nodes = np.union1d(nodes, [own])
    seen = np.zeros(len(x), dtype=bool)
    seen[nodes] = True
    scores = x[nodes] @ query
    done: set[int] = set()
    while True:
        top = np.argsort(-scores, kind="stable")[:BEAM]
        fresh = [int(n) for n, s in zip(nodes[top], scores[top], strict=True) if int(n) not in done][:4]
        if not fresh:
            fresh = [int(n) for n in nodes[scores >= least - 0.01] if int(n) not in done]
            if not fresh:
                break
        done.update(fresh)
        following = np.unique(np.concatenate([lists[n] for n in fresh]))
        following = following[~seen[following]] if len(following) else following
        if len(following):
            seen[following] = True
            nodes = np.concatenate([nodes, following])
            scores = np.concatenate([scores, x[following] @ query])
    rest = np.flatnonzero((angles - wide <= _reach(least))[nearest] & ~seen)
    if len(rest):
        nodes, scores = np.concatenate([nodes, rest]), np.concatenate([scores, x[rest] @ query])
    return nodes[scores >= least - 1e-9]


def may_meet(x: np.ndarray, queries: np.ndarray, own: np.ndarray, least: float) -> np.ndarray:
    """Of each query, whether any of the nodes ``x`` but its ``own`` (-1: it is none of them) can have cosine >= least with it.

    Nodes and queries are turned to the nodes' principal axes. On the first three quarters of them a cosine is what the parts make,
    beyond them it is the product of the rests' lengths at most. A query that no node's bound lets in has no link here,
    and so no search; whatever is let in is searched for in the graph.
    """
    axes = np.linalg.eigh(x.T @ x)[1][:, ::-1][:, : -(-3 * x.shape[1] // 4)]

    def turned(rows: np.ndarray) -> np.ndarray:
        part = rows @ axes
        rest = np.sqrt(np.maximum((rows * rows).sum(axis=1) - (part * part).sum(axis=1), 0))
        return np.column_stack([part, rest]).astype(np.float32)

    nodes, met = turned(x).T.copy(), np.zeros(len(queries), dtype=bool)
    for at in range(0, len(queries), BOUND_ROWS):
        # single precision errs by far less than the room left here
        bounds, mine = turned(queries[at: at + BOUND_ROWS]) @ nodes, own[at: at + BOUND_ROWS]
        bounds[np.flatnonzero(mine >= 0), mine[mine >= 0]] = -1
        met[at: at + BOUND_ROWS] = bounds.max(axis=1) >= least - 1e-4
    return met


def _reach(least: float) -> float:
    """The angle of a range, with some room for rounding."""
    return math.acos(max(min(least, 1.0), -1.0)) + 1e-6


def _centres(rows: DataFrame) -> dict[int, np.ndarray]:
    """Cluster centres per label: vectors drawn by hash, one for about SHARD_ROWS, at most MOST_CENTRES in all."""
    sizes = rows.groupBy("label").count().toArrow().to_pydict()  # labels are few; each gets a centre at least
    total = sum(sizes["count"])
    share = min(2.0 / SHARD_ROWS, MOST_CENTRES / max(total, 1))
    drawn = rows.withColumn("_h", F.pmod(F.xxhash64("vec_id", F.lit("centre")), F.lit(1_000_003))).filter(
        F.col("_h") < int(share * 1_000_003) + 1)
    least = rows.groupBy("label").agg(F.min("vec_id").alias("vec_id"))
    picked = drawn.select("label", "vec_id").union(least.select("label", "vec_id")).distinct()
    held = rows.join(F.broadcast(picked), ["label", "vec_id"]).select("label", "vec_id", "embedding").orderBy("label", "vec_id").toArrow()
    labels = held.column("label").to_numpy()
    x = units(held.column("embedding")) if held.num_rows else np.zeros((0, 0))
    return {int(label): x[labels == label] for label in np.unique(labels)}


def farthest_planes(near: np.ndarray, order: np.ndarray, between: np.ndarray) -> np.ndarray:
    """How far away, at least, every cluster is from each vector: the sine of the angle to the farthest plane before it.

    ``near`` are cosines of vectors with centres, ``order`` the centres from near to far, ``between`` their own cosines.
    The mean of the nearest t centres less a cluster's own centre is the normal of a plane with the cluster behind it.
    """
    beyond = np.zeros(near.shape)
    cosines, length = np.zeros(near.shape), np.zeros(len(near))
    total = np.zeros((len(near), 1))
    for t in range(min(PLANES, near.shape[1])):
        one = order[:, t]
        length += 2 * cosines[np.arange(len(one)), one] + between[one, one]
        cosines += between[one]
        total += np.take_along_axis(near, one[:, None], axis=1)
        apart = np.sqrt(np.maximum(length[:, None] / (t + 1) ** 2 - 2 * cosines / (t + 1) + np.diag(between), 0))
        beyond = np.maximum(beyond, np.where(apart < 1e-6, 0, (total / (t + 1) - near) / np.maximum(apart, 1e-6)))
    return beyond


def _placed(rows: DataFrame, centres: dict[int, np.ndarray], least: float) -> DataFrame:
    """A row per vector and cluster that indexes it (the first is its own) or that it looks into.

    It looks into a cluster unless a plane that has the whole cluster behind it is farther away than its range reaches.
    Such a plane lies between the cluster's centre and the vector's own; and as a cluster's vectors are nearer to their
    centre than to any others, also between that centre and the mean of the vector's nearest few.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            if batch.num_rows:
                x, labels, ids = units(batch.column(2)), batch.column(1).to_numpy(), batch.column(0).to_numpy()
                for label in np.unique(labels):
                    at = np.flatnonzero(labels == label)
                    own = centres[int(label)]
                    near = x[at] @ own.T
                    order = np.argsort(-near, axis=1, kind="stable")
                    rank = np.argsort(order, axis=1, kind="stable")
                    beyond = farthest_planes(near, order, own @ own.T)
                    wanted = (rank < OVERLAP) | (np.arcsin(np.clip(beyond, -1, 1)) <= _reach(least))
                    out += [(ids[at[r]], int(label), int(c), rank[r, c] == 0, rank[r, c] < OVERLAP) for r, c in zip(*np.nonzero(wanted), strict=True)]
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.bool_())
            yield pa.record_batch([pa.array([o[k] for o in out], t) for k, t in enumerate(kinds)], names=["vec_id", "label", "cluster", "own", "member"])

    return rows.select("vec_id", "label", "embedding").mapInArrow(run, "vec_id long, label int, cluster int, own boolean, member boolean")


def near_links(vectors: DataFrame, least: float = 0.98) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``vectors`` (``vec_id``, ``embedding``, ``label``).

    Vectors link if their labels are equal and known and their cosine, in double precision, is at least ``least``.
    Null, zero and non-finite vectors and null labels link with nothing and are their own component. Equal vectors of a
    label are one node with a count. Other columns are not read; rows that repeat a vec_id come back as often and are
    other vectors to each other only if they differ; an empty table gives no rows.

    Shards are clusters with overlap, each of bounded size (a crowded cluster is cut by hash and all its parts are
    looked into). Neighbour lists of all shards are united in one table; a search task holds its shard's nodes and the
    neighbours that other shards gave them. Queries that no node of a shard can be in range of are told at once by bounds
    on most of the axes and not searched for there. What a search's edges don't lead to is compared if it can be in range,
    so all links are found. A hit counts only in the shard that owns it, so counts add up, and each task
    hands on one link per node it joins, never its pairs.
    """
    rows = settle(usable(vectors).select("vec_id", F.col("label").cast("int").alias("label"), "embedding"))
    nodes = settle(rows.groupBy("label", "embedding").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("times")))
    centres = _centres(nodes)
    placed = settle(_placed(nodes, centres, least))
    sizes = placed.filter("member").groupBy("label", "cluster").agg(F.ceil(F.count("*") / (2 * SHARD_ROWS)).cast("int").alias("parts"))
    dealt = placed.join(F.broadcast(sizes), ["label", "cluster"]).withColumn("mine", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int"))
    cells = settle(dealt.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        "label", "cluster", "part", "vec_id", (F.col("own") & (F.col("part") == F.col("mine"))).alias("own"),
        (F.col("member") & (F.col("part") == F.col("mine"))).alias("member"),
    ))
    cell = ["label", "cluster", "part"]
    held = nodes.select("vec_id", "embedding", "times")

    def build(table: pa.Table) -> pa.Table:
        ids, x = table.column("vec_id").to_numpy(), units(table.column("embedding"))
        lists = shard_lists(x) if len(ids) > 1 else [[]]
        u = np.repeat(ids, [len(n) for n in lists])
        v = ids[np.concatenate([np.array(n, dtype=np.int64) for n in lists])] if len(u) else ids[:0]
        return pa.table({"u": u, "v": v})

    members = cells.filter("member").select(*cell, "vec_id", "own")
    edges = settle(members.join(held, "vec_id").groupBy(*cell).applyInArrow(build, "u long, v long").distinct())
    lists = edges.groupBy("u").agg(F.collect_list("v").alias("near"))  # bounded: a list is of at most 2 DEGREE per shard
    halo = members.join(edges, F.col("vec_id") == F.col("u")).select(*cell, F.col("v").alias("vec_id")).distinct()
    inside = members.select(*cell, "vec_id", "own", F.lit(True).alias("member"), F.lit(False).alias("asks"))
    around = halo.join(members.select(*cell, "vec_id"), [*cell, "vec_id"], "left_anti").select(
        *cell, "vec_id", F.lit(False).alias("own"), F.lit(True).alias("member"), F.lit(False).alias("asks"))
    asking = cells.select(*cell, "vec_id", F.lit(False).alias("own"), F.lit(False).alias("member"), F.lit(True).alias("asks"))
    every = inside.union(around).union(asking).groupBy(*cell, "vec_id").agg(*[F.max(c).alias(c) for c in ("own", "member", "asks")])
    asked = cells.groupBy(*cell).agg(F.ceil(F.count("*") / ASKED_ROWS).cast("int").alias("turns"))
    mine = F.pmod(F.xxhash64("vec_id", F.lit("turn")), F.col("turns")).cast("int")
    turned = every.join(asked, cell).withColumn("mine", mine).withColumn("turn", F.explode(
        F.when(F.col("member"), F.sequence(F.lit(0), F.col("turns") - 1)).otherwise(F.array("mine"))
    )).withColumn("asks", F.col("asks") & (F.col("turn") == F.col("mine"))).drop("mine", "turns")
    full = turned.join(held, "vec_id").join(lists, F.col("vec_id") == F.col("u"), "left").drop("u")

    def search(table: pa.Table) -> pa.Table:
        ids, own, member, asks, times = (table.column(c).to_numpy(zero_copy_only=False) for c in ("vec_id", "own", "member", "asks", "times"))
        x = units(table.column("embedding"))
        base = np.flatnonzero(member)
        held_x = x[base]
        place = {int(i): k for k, i in enumerate(ids[base])}
        asking = np.flatnonzero(asks) if len(base) else base
        mine = base[own[base]]
        if len(asking) and len(mine):  # a link is found where its other end is owned, so others' nodes call for no search
            at = {i: k for k, i in enumerate(ids[mine].tolist())}
            asking = asking[may_meet(x[mine], x[asking], np.array([at.get(i, -1) for i in ids[asking].tolist()], dtype=np.int64), least)]
        else:
            asking = asking[:0]
        near = table.column("near").to_pylist() if len(asking) else []
        lists = [np.array([place[n] for n in (near[k] or []) if n in place], dtype=np.int64) for k in base] if len(asking) else []
        entries = landmarks(held_x, lists) if len(asking) else None
        parent = list(range(len(ids)))

        def root(k: int) -> int:
            while parent[k] != k:
                parent[k] = parent[parent[k]]
                k = parent[k]
            return k

        out = {"vec_id": [], "hits": [], "other": []}
        for q in asking:
            found = base[range_search(held_x, lists, entries, place.get(int(ids[q])), x[q], least)]
            found = found[(found != q) & ((x[found] * x[q]).sum(axis=1) >= least)]
            for k in found.tolist():
                a, b = root(q), root(k)
                if a != b:
                    parent[a] = b
                    out["vec_id"].append(int(ids[q]))
                    out["hits"].append(0)
                    out["other"].append(int(ids[k]))
            count = int(times[found[own[found]]].sum())
            if count:
                out["vec_id"].append(int(ids[q]))
                out["hits"].append(count)
                out["other"].append(None)
        return pa.table({k: pa.array(v, type=pa.int64()) for k, v in out.items()})

    found = settle(full.groupBy(*cell, "turn").applyInArrow(search, "vec_id long, hits long, other long"))
    comps = components(found.filter("other is not null"), "vec_id", "other")
    hits = found.groupBy("vec_id").agg(F.sum("hits").alias("hits"))
    per_node = nodes.join(hits, "vec_id", "left").join(comps.withColumnRenamed("node", "vec_id"), "vec_id", "left").select(
        "label", "embedding", (F.coalesce("hits", F.lit(0)) + F.col("times") - 1).alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    linked = rows.join(per_node, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    alone = vectors.filter(~F.coalesce(_may_link(), F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def audit(vectors: DataFrame, found: DataFrame, every: int = 20, least: float = 0.98) -> float:
    """Recall of link counts: of the vectors whose id is divisible by ``every``, asked against all rows by brute force."""
    rows = usable(vectors).select("vec_id", "label", "embedding")
    asked = rows.filter(F.col("vec_id") % every == 0)

    def dot(a, b):
        return F.aggregate(F.zip_with(a, b, lambda u, v: u.cast("double") * v.cast("double")), F.lit(0.0), lambda s, v: s + v)

    a = asked.select("label", F.col("vec_id").alias("a"), F.col("embedding").alias("x"))
    pairs = a.join(rows, "label").filter("a <> vec_id").filter(
        dot(F.col("x"), F.col("embedding")) / F.sqrt(dot(F.col("x"), F.col("x")) * dot(F.col("embedding"), F.col("embedding"))) >= least)
    truth = pairs.groupBy("a").count()
    both = truth.join(found.select(F.col("vec_id").alias("a"), "n_links"), "a")
    sums = both.agg(F.sum(F.least("n_links", "count")), F.sum("count")).first()
    return 1.0 if not sums[1] else sums[0] / sums[1]
