"""Ordered work inside groups of any size.

A plain ``Window.partitionBy(group)`` sorts a group in one task. Here each group above
``target_rows`` is cut into value ranges first, the window runs per range, and one row per range
carries the offsets. Small groups stay in one range, so they pay no second sort.

The cut points come from rows picked by a hash of their own values: the same rows give the same
cut points in every evaluation, so a recomputed partition still agrees with its neighbours.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tonewheel.session import settle

TARGET_ROWS = 1 << 20
# Ranges of one level; a group that needs more is cut again inside each of them.
MAX_RANGES = 1024
SAMPLES_PER_RANGE = 16
SEARCH_STEP = 32


def _search(bounds: Column, value: Column) -> Column:
    """How many sorted ``bounds`` lie below ``value``, in two short scans instead of one long one."""
    coarse = F.size(F.filter(bounds["coarse"], lambda b: b < value))
    fine = F.filter(F.slice(bounds["fine"], coarse * SEARCH_STEP + 1, SEARCH_STEP), lambda b: b < value)
    return coarse * SEARCH_STEP + F.size(fine)


def hot_groups(df: DataFrame, keys: Sequence[str], target_rows: int = TARGET_ROWS) -> DataFrame | None:
    """Groups above ``target_rows`` with their sizes, or None if there are none.

    The check is a job over the key columns alone, folded before the shuffle. It keeps the plan of
    the usual case, no such group, at one window.
    """
    hot = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > target_rows)
    return None if hot.isEmpty() else hot


def with_range(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    hot: DataFrame | None,
    target_rows: int = TARGET_ROWS,
    name: str = "_range",
) -> DataFrame:
    """Add the value range each row falls in; ranges are ordered like ``order`` inside a group.

    ``keys + order`` should identify a row, else equal rows land in one range together. Ranges are arrays of one number
    a level: a group of more than ``MAX_RANGES`` times ``target_rows`` rows is cut again inside its ranges, so ranges
    stay small whatever the size of the group.
    """
    if hot is None:
        return df.withColumn(name, F.array(F.lit(0)))
    keys = list(keys)
    first = _one_level(df, keys, order, hot, target_rows, name)
    if hot.agg(F.max("_n")).first()[0] <= target_rows * MAX_RANGES:
        return first.withColumn(name, F.array(name))
    above, below = f"{name}_above", f"{name}_below"
    upper = settle(first.withColumnRenamed(name, above))  # else every level would evaluate all levels above it
    again = hot_groups(upper, [*keys, above], target_rows)
    if again is not None:  # a group of one value is one range: nothing to cut any more
        sizes = hot.select(*keys, F.col("_n").alias("_whole"))
        again = null_safe_join(again, sizes, keys) if keys else again.withColumn("_whole", sizes.select("_whole").scalar())
        again = again.where("_n < _whole").drop("_whole")
    if again is None or again.isEmpty():
        return upper.withColumn(name, F.array(above)).drop(above)
    lower = with_range(upper, [*keys, above], order, again, target_rows, below)
    return lower.withColumn(name, F.concat(F.array(above), below)).drop(above, below)


def _one_level(df: DataFrame, keys: list[str], order: Sequence[str], hot: DataFrame, target_rows: int, name: str) -> DataFrame:
    value = F.struct(*order)
    hot = hot.select(
        *keys,
        "_n",
        F.least(F.ceil(F.col("_n") / target_rows), F.lit(MAX_RANGES)).cast("int").alias("_ranges"),
    ).withColumn("_stride", F.greatest(F.lit(1), F.floor(F.col("_n") / (F.col("_ranges") * SAMPLES_PER_RANGE))))
    picked = df.select(*keys, *order)
    if keys:
        picked = null_safe_join(picked, hot, keys)
    else:
        one = hot.select(F.struct("_ranges", "_stride").alias("_h")).scalar()
        picked = picked.withColumn("_h", one).select(*order, "_h._ranges", "_h._stride")
    cuts = (
        picked.where(F.pmod(F.xxhash64(*order), "_stride") == 0)
        .distinct()
        .groupBy(*keys, "_ranges")
        .agg(F.array_sort(F.collect_list(value)).alias("_s"))
        .withColumn(
            "_cuts",
            F.transform(
                F.sequence(F.lit(1), F.greatest(F.col("_ranges") - 1, F.lit(1))),
                lambda i: F.col("_s")[F.floor(i * F.size("_s") / F.col("_ranges")).cast("int")],
            ),
        )
        .select(
            *keys,
            F.struct(
                F.col("_cuts").alias("fine"),
                F.filter(F.col("_cuts"), lambda c, i: i % SEARCH_STEP == SEARCH_STEP - 1).alias("coarse"),
            ).alias("_bounds"),
        )
    )
    joined = null_safe_join(df, cuts, keys, "left") if keys else df.withColumn("_bounds", cuts.scalar())
    return joined.withColumn(name, F.coalesce(_search(F.col("_bounds"), value), F.lit(0))).drop("_bounds")


def running_sums(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    sums: Sequence[str],
    descending: bool = False,
    target_rows: int = TARGET_ROWS,
    sized_by: DataFrame | None = None,
) -> DataFrame:
    """Inclusive running sum ``<c>_run`` and group total ``<c>_all`` of every column in ``sums``.

    ``sized_by`` may name a cheaper table with at least as many rows per group, for the size check.
    """
    keys, on = list(keys), [*keys, "_range"]
    direction = F.desc if descending else F.asc
    sort = [direction(c) for c in order]
    hot = hot_groups(df if sized_by is None else sized_by, keys, target_rows)
    if hot is None:
        upto = W.partitionBy(*keys).orderBy(*sort).rowsBetween(W.unboundedPreceding, 0)
        whole = W.partitionBy(*keys)
        run = [F.sum(c).over(upto).alias(f"{c}_run") for c in sums]
        return df.select("*", *run).select("*", *[F.sum(c).over(whole).alias(f"{c}_all") for c in sums])
    cut = with_range(df, keys, order, hot, target_rows)
    inside = W.partitionBy(*on).orderBy(*sort).rowsBetween(W.unboundedPreceding, 0)
    before = W.partitionBy(*keys).orderBy(direction("_range")).rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*keys)
    local = cut.select("*", *[F.sum(c).over(inside).alias(f"{c}_in") for c in sums])
    offsets = (
        cut.groupBy(*on)
        .agg(*[F.sum(c).alias(f"{c}_t") for c in sums])
        .select(
            *on,
            *[F.coalesce(F.sum(f"{c}_t").over(before), F.lit(0)).alias(f"{c}_off") for c in sums],
            *[F.sum(f"{c}_t").over(whole).alias(f"{c}_all") for c in sums],
        )
    )
    out = null_safe_join(local, offsets, on, "left")
    for c in sums:
        out = out.withColumn(f"{c}_run", F.col(f"{c}_in") + F.coalesce(f"{c}_off", F.lit(0)))
    return out.drop("_range", *[f"{c}{s}" for c in sums for s in ("_in", "_off")])


def positions(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    name: str = "pos",
    target_rows: int = TARGET_ROWS,
) -> DataFrame:
    """Zero-based position of every row inside its group, and the group size ``<name>_n``."""
    ones = df.withColumn("_one", F.lit(1).cast("bigint"))
    out = running_sums(ones, keys, order, ["_one"], target_rows=target_rows, sized_by=df)
    return out.withColumn(name, F.col("_one_run") - 1).withColumnRenamed("_one_all", f"{name}_n").drop("_one", "_one_run")


def forward_fill(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    value: Column,
    name: str,
    block: int = 4096,
) -> DataFrame:
    """Last non-null ``value`` at or before each row; ``order`` is an integer position in the group."""
    keys, on = list(keys), [*keys, "_block"]
    cut = df.withColumn("_v", value).withColumn("_block", F.floor(F.col(order) / block))
    inside = W.partitionBy(*on).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    before = W.partitionBy(*keys).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    carried = (
        cut.groupBy(*on)
        .agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), F.col(order))).alias("_last"))
        .select(*on, F.last("_last", ignorenulls=True).over(before).alias("_carry"))
    )
    return (
        null_safe_join(cut.withColumn("_in", F.last("_v", ignorenulls=True).over(inside)), carried, on, "left")
        .withColumn(name, F.coalesce("_in", "_carry"))
        .drop("_v", "_in", "_carry", "_block")
    )


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on ``keys`` where a null key is a group like any other; keys come from the left."""
    other = right.select(*[F.col(k).alias(f"_key_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    same = [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys]
    return left.join(other, same, how).drop(*[f"_key_{k}" for k in keys])


def with_group_stats(df: DataFrame, keys: Sequence[str], **aggregates: Column) -> DataFrame:
    """Attach group aggregates by aggregate-then-join: partial sums first, no per-group sort."""
    keys = list(keys)
    stats = df.groupBy(*keys).agg(*[c.alias(n) for n, c in aggregates.items()])
    if keys:
        return null_safe_join(df, stats, keys, "left")
    one = stats.select(F.struct(*stats.columns).alias("_one")).scalar()
    return df.withColumn("_one", one).select(*df.columns, *[F.col(f"_one.{n}").alias(n) for n in aggregates])


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, name: str = "rank") -> DataFrame:
    """First ``k`` rows of each group; Spark limits each group before the shuffle."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= k)
