"""Exact nearest neighbours inside groups, by blocked matrix products.

A group that fits one cell is one bounded co-group whose distances come from one numpy matrix product; nothing of it is
replicated. A larger group is cut into strips of test rows; each is held in a task while the group's train rows stream
past (see ``strips``), and only the ``k`` best rows per test row leave it. Row pairs never exist as rows.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tonewheel.operators.skew import null_safe_join, top_k
from tonewheel.operators.strips import CHUNK_ROWS, STRIP_ROWS, Strip, packed, streamed, strip_count
from tonewheel.session import settle

BLOCK_ROWS = 8192
MIN_CELL_WORK = 4096
BROADCAST_GROUPS = 100_000
#: Test rows of one product in a cell, and its entries: a worker's memory doesn't grow with the cell.
SLAB, CELL = 1024, 1 << 20
TIE_DECIMALS = 9


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """An Arrow list column as a 2-d float64 array, without a Python loop; NULL or uneven vectors are an error."""
    sizes = pc.unique(pc.list_value_length(column)).to_pylist()
    if len(sizes) > 1 or sizes == [None]:
        raise ValueError(f"vectors of one length expected, found {sizes}")
    flat = pa.concat_arrays([c.flatten() for c in column.chunks]) if column.num_chunks else pa.array([], pa.float64())
    values = flat.to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1) if len(column) else values.reshape(0, 0)


def unit_rows(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm == 0, 1.0, norm)


def distances(q: np.ndarray, t: np.ndarray, metric: str) -> np.ndarray:
    """Worked out in place: a slab of them is the largest thing in a search."""
    out = q @ t.T
    if metric == "cosine":
        return np.clip(np.subtract(1.0, out, out=out), 0.0, 2.0, out=out)
    np.multiply(out, 2.0, out=out)
    np.subtract((q * q).sum(1)[:, None] + (t * t).sum(1)[None, :], out, out=out)
    return np.sqrt(np.maximum(out, 0.0, out=out), out=out)


def best_k(dist: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, column and rank of the ``k`` smallest entries per row; equal distances go to the lower id.

    Distances are compared at a fixed number of decimals, so the order of additions in a product
    cannot decide between copies of one vector.
    """
    return best_keys(np.round(dist, TIE_DECIMALS), ids, k)


def best_keys(key: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``best_k`` for distances that are rounded already."""
    n, m = key.shape
    if n == 0 or m == 0:
        empty = np.zeros(0, dtype=np.int64)
        return empty, empty, empty
    k = min(k, m)
    limit = np.partition(key, k - 1, axis=1)[:, k - 1 : k]
    rows, cols = np.nonzero(key <= limit)
    order = np.lexsort((ids[cols], key[rows, cols], rows))
    rows, cols = rows[order], cols[order]
    first = np.searchsorted(rows, np.arange(n))
    rank = np.arange(len(rows)) - first[rows]
    keep = rank < k
    return rows[keep], cols[keep], rank[keep]


def _large_groups(test: DataFrame, train: DataFrame, keys: list[str], block_rows: int) -> DataFrame | None:
    """Groups that don't fit one cell, with their strips and chunks; None if there are none.

    Only those are listed; their number decides how they are joined.
    """
    cores = test.sparkSession.sparkContext.defaultParallelism
    te = F.col("_te")
    wanted = F.greatest(F.ceil(te / STRIP_ROWS), F.least(F.ceil(te / block_rows), F.lit(2 * cores)), F.lit(1))
    sizes = (
        train.groupBy(*keys).agg(F.count(F.lit(1)).alias("_tr"))
        .transform(null_safe_join, test.groupBy(*keys).agg(F.count(F.lit(1)).alias("_te")), keys)
        .where((F.col("_tr") > block_rows) | (te > block_rows))
        .select(*keys, wanted.cast("int").alias("_strips"), F.ceil(F.col("_tr") / CHUNK_ROWS).cast("int").alias("_chunks"))
    )
    large = sizes.limit(BROADCAST_GROUPS + 1).count()
    if large == 0:
        return None
    return F.broadcast(sizes) if large <= BROADCAST_GROUPS else sizes


def _others(df: DataFrame, listed: DataFrame, keys: list[str]) -> DataFrame:
    marked = null_safe_join(df, listed.select(*keys, F.lit(True).alias("_listed")), keys, "left")
    return marked.where("_listed is null").drop("_listed")


def knn_join(
    test: DataFrame,
    train: DataFrame,
    keys: Sequence[str],
    k: int,
    metric: str = "cosine",
    test_id: str = "file",
    train_id: str = "file",
    vec: str = "emb",
    carry: Sequence[str] = (),
    block_rows: int = BLOCK_ROWS,
    train_carry: Sequence[str] = (),
    row: str | None = None,
) -> DataFrame:
    """``(keys, test_id, carry, rank, dist, neighbour)`` with ranks from 1, for every test row.

    Test rows of one id are searched one by one; ``row`` names a column that tells them apart inside ``keys``.

    ``carry`` are columns of the test row; each ``c`` of ``train_carry`` comes along from the
    neighbour as ``n<c>``, so looking up a neighbour's class needs no join.
    ``cosine`` is ``1 - cos``; ``euclidean`` works on the vectors as they are. Groups without train
    rows yield nothing; a group smaller than ``k`` yields what it has.
    """
    keys, carry, brought = list(keys), list(carry), [f"n{c}" for c in train_carry]
    whole = not keys
    if whole:
        keys = ["_all"]
        test, train = test.withColumn("_all", F.lit(0)), train.withColumn("_all", F.lit(0))
    id_type = train.schema[train_id].dataType
    left = test.select(*keys, F.col(test_id).alias("_id"), F.col(vec).alias("_vec"), *carry)
    right = train.select(
        *keys, F.col(train_id).alias("_id"), F.col(vec).alias("_vec"), *[F.col(c).alias(f"n{c}") for c in train_carry]
    )
    large = _large_groups(left, right, keys, block_rows)
    left = left.withColumn("_row", F.lit(0).cast("bigint"))
    schema = T.StructType(
        [left.schema[c] for c in (*keys, "_row", "_id", *carry)]
        + [
            T.StructField("rank", T.IntegerType()),
            T.StructField("dist", T.DoubleType()),
            T.StructField("neighbour", id_type),
        ]
        + [right.schema[c] for c in brought]
    )
    passed = [*keys, "_row", "_id", *carry]
    nothing = test.sparkSession.createDataFrame([], schema).toArrow()

    def cell(a: pa.Table, b: pa.Table) -> pa.Table:
        if a.num_rows == 0 or b.num_rows == 0:
            return nothing
        q, t = matrix(a["_vec"]), matrix(b["_vec"])
        if metric == "cosine":
            q, t = unit_rows(q), unit_rows(t)
        # the whole group lies here, so a place in it names a row
        a = a.set_column(a.column_names.index("_row"), "_row", pa.array(np.arange(a.num_rows, dtype=np.int64)))
        ids = b["_id"].to_numpy()
        parts = []
        slab = max(1, min(SLAB, CELL // len(t)))
        for start in range(0, len(q), slab):
            d = distances(q[start : start + slab], t, metric)
            rows, cols, rank = best_k(d, ids, k)
            parts.append((rows + start, cols, rank, d[rows, cols]))
        rows, cols, rank, d = (np.concatenate(p) for p in zip(*parts))
        return _with_hits(a.select(passed).take(rows), rank + 1, d, b, cols, brought)

    if large is None:
        hits = _fresh(left).groupBy(*keys).cogroup(_fresh(right).groupBy(*keys)).applyInArrow(cell, schema)
    else:
        small = [_fresh(_others(side, large, keys)) for side in (left, right)]
        hits = small[0].groupBy(*keys).cogroup(small[1].groupBy(*keys)).applyInArrow(cell, schema)
        hits = hits.unionByName(_by_strips(left, right, large, keys, k, metric, passed, brought, schema, nothing.schema))
    out_keys = [] if whole else keys
    return hits.select(*out_keys, *([F.col("_row").alias(row)] if row else []), F.col("_id").alias(test_id), *carry, "rank", "dist", "neighbour", *brought)


def _by_strips(
    test: DataFrame, train: DataFrame, large: DataFrame, keys: list[str], k: int, metric: str, passed: list[str], brought: list[str],
    schema: T.StructType, arrow: pa.Schema,
) -> DataFrame:
    """Hits in groups above one cell. Their test rows are written once, so that a number tells rows of one id apart."""
    test = settle(null_safe_join(test, large, keys)).withColumn("_row", F.monotonically_increasing_id())
    every = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    held = test.withColumn("_strip", F.pmod(F.xxhash64("_row"), F.col("_strips")).cast("int")).withColumn("_chunk", every("_chunks"))
    passing = null_safe_join(train, large, keys).withColumn("_chunk", F.pmod(F.xxhash64("_id", "_vec"), F.col("_chunks")).cast("int"))
    passing = passing.withColumn("_strip", every("_strips"))
    on = [*keys, "_strip", "_chunk"]
    at = [F.col(c).alias(f"_on_{c}") for c in on]  # test rows bring their keys along
    names = [f"_on_{c}" for c in on]
    hits = streamed(
        held.select(*at, *passed, "_vec"), passing.select(*at, "_id", "_vec", *brought), names,
        lambda rows: Strip(rows, k, metric, 0, passed, brought, arrow), schema,
    )
    return top_k(hits.drop("rank"), [*keys, "_row"], [F.round("dist", TIE_DECIMALS), F.col("neighbour")], k).select(*schema.names)


def _fresh(df: DataFrame) -> DataFrame:
    """The same columns under new identities: both sides of a co-group may stem from one table."""
    return df.select(*[F.col(c).alias(c) for c in df.columns])


def _with_hits(head: pa.Table, rank: np.ndarray, dist: np.ndarray, train: pa.Table, rows: np.ndarray, brought: list[str]) -> pa.Table:
    out = head.append_column("rank", pa.array(rank.astype(np.int32))).append_column("dist", pa.array(dist))
    near = train.select(["_id", *brought]).take(rows)
    for name, column in zip(["neighbour", *brought], near.columns):
        out = out.append_column(name, column)
    return out


def knn_runs(
    vectors: DataFrame,
    member: str,
    runs: int,
    k: int,
    id_col: str = "file",
    vec: str = "emb",
    carry: Sequence[str] = (),
    block_rows: int = BLOCK_ROWS,
    train_carry: Sequence[str] = (),
) -> DataFrame:
    """Cosine neighbours for many train/test splits of one table in one pass.

    ``member`` is an array of booleans, true where the row is a test row of that run; it travels as packed bits. A strip
    of test rows is held while all train rows stream past: distances are computed and ordered once for all runs, and
    each row's hits leave once per run, however many batches went by (once a chunk of ``CHUNK_ROWS`` train rows).
    Returns ``(run, id_col, carry, rank, sim, neighbour)`` and ``n<c>`` for each of ``train_carry``.
    """
    carry, brought = list(carry), [f"n{c}" for c in train_carry]
    spark = vectors.sparkSession
    rows, cores = vectors.select(member).count(), spark.sparkContext.defaultParallelism
    chunks = max(1, -(-rows // CHUNK_ROWS))
    if chunks > 1:  # hits of a row come from several cells then: number the rows of a written table
        vectors = settle(vectors)
    strips = strip_count(rows, runs * k, block_rows, rows * runs // MIN_CELL_WORK, cores)
    named = vectors.select(
        F.col(id_col).alias("_id"), F.col(vec).alias("_vec"), packed(F.col(member), runs).alias("_bits"), *carry,
        *[F.col(c).alias(f"n{c}") for c in train_carry],
    ).withColumn("_row", F.monotonically_increasing_id() if chunks > 1 else F.lit(0).cast("long"))

    def dealt(name: str, count: int) -> Column:
        return F.pmod(F.xxhash64("_id", "_vec"), F.lit(count)).cast("int").alias(name)

    def every(name: str, count: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias(name)

    left = named.select(dealt("_strip", strips), "_row", "_id", "_vec", "_bits", *carry, every("_chunk", chunks))
    right = named.select(dealt("_chunk", chunks), "_id", "_vec", "_bits", *brought, every("_strip", strips))
    schema = T.StructType(
        [T.StructField("run", T.IntegerType()), named.schema["_row"], named.schema["_id"]] + [named.schema[c] for c in carry]
        + [T.StructField("rank", T.IntegerType()), T.StructField("dist", T.DoubleType()), T.StructField("neighbour", named.schema["_id"].dataType)]
        + [named.schema[c] for c in brought]
    )
    empty = spark.createDataFrame([], schema).toArrow().schema
    passed = ["_row", "_id", *carry]
    hits = streamed(left, right, ["_strip", "_chunk"], lambda held: Strip(held, k, "cosine", runs, passed, brought, empty), schema)
    if chunks > 1:
        hits = top_k(hits.drop("rank"), ["run", "_row"], [F.round("dist", TIE_DECIMALS), F.col("neighbour")], k)
    return hits.select(
        "run", F.col("_id").alias(id_col), *carry, "rank", (1 - F.col("dist")).alias("sim"), "neighbour", *brought
    )


def anomaly_scores(
    test: DataFrame,
    train: DataFrame,
    keys: Sequence[str],
    k: int = 1,
    metric: str = "cosine",
    carry: Sequence[str] = (),
    file: str = "file",
    vec: str = "emb",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``score`` = mean distance to the ``k`` nearest train vectors of the same group."""
    hits = knn_join(test, train, keys, k, metric, file, file, vec, carry, block_rows, row="_row")
    if k == 1:
        return hits.select(*keys, file, *carry, F.col("dist").alias("score"))
    return hits.groupBy(*keys, "_row", file, *carry).agg(F.avg("dist").alias("score")).drop("_row")


def znorm(df: DataFrame, keys: Sequence[str], score: str = "score") -> DataFrame:
    """Population z-score inside each group; a group without spread has none, so NULL."""
    from tonewheel.operators.skew import with_group_stats

    out = with_group_stats(df, keys, _m=F.avg(score), _s=F.stddev_pop(score))
    return out.withColumn(score, F.expr(f"case when _s > 0 then ({score} - _m) / _s end")).drop("_m", "_s")


def min_fusion(df: DataFrame, keys: Sequence[str], file: str, domain: str, carry: Sequence[str]) -> DataFrame:
    """Source-model and target-model scores of a row side by side, fused by the lower one.

    ``file`` and ``carry`` tell rows apart; rows that are equal in all of them have equal scores and stay as many.
    """
    source, target = F.col(domain) == 0, F.col(domain) == 1
    return (
        df.groupBy(*keys, file, *carry)
        .agg(
            F.max(F.when(source, F.col("score"))).alias("score_sou"),
            F.max(F.when(target, F.col("score"))).alias("score_tar"),
            F.greatest(F.count(F.when(source, 1)), F.count(F.when(target, 1))).alias("_n"),
        )
        .withColumn("score", F.least("score_sou", "score_tar"))
        .withColumn("_n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))))
        .drop("_n")
    )


def pool_scores(df: DataFrame, keys: Sequence[str], how: str, score: str = "score") -> DataFrame:
    """Several scores of one file to one: mean, min or max."""
    fold = {"mean": F.avg, "min": F.min, "max": F.max}[how]
    return df.groupBy(*keys).agg(fold(score).alias(score))
