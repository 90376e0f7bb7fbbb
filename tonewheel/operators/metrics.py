"""Accuracy reports, histograms, decisions, means and curves."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tonewheel.operators.skew import TARGET_ROWS, null_safe_join, running_sums, with_group_stats


def hmean(column: str | Column) -> Column:
    """Harmonic mean of the non-null values, as an aggregate; any 0 makes it 0."""
    c = F.col(column) if isinstance(column, str) else column
    inverse = F.sum(F.lit(1.0) / F.nullif(c, F.lit(0.0)))
    return F.when(F.min(c) == 0, F.lit(0.0)).otherwise(F.count(c) / F.nullif(inverse, F.lit(0.0)))


def hmean_of(*columns: str) -> Column:
    """Harmonic mean across columns of a row; NULL if one is missing, 0 if one is 0."""
    inverse = sum((F.lit(1.0) / F.nullif(F.col(c), F.lit(0.0)) for c in columns), F.lit(0.0))
    return F.when(F.least(*columns) == 0, F.lit(0.0)).otherwise(len(columns) / inverse)


def mean_of(*columns: str) -> Column:
    return sum((F.col(c) for c in columns), F.lit(0.0)) / len(columns)


def class_report(pred: DataFrame, keys: Sequence[str] = (), cls: str = "cls", guess: str = "pred", classes: DataFrame | None = None) -> DataFrame:
    """``(keys, scene, pred, correct, all, acc)`` from rows of true and predicted class.

    Every row counts once for its class and once for its prediction, so one aggregation is enough.
    ``classes`` (column ``scene``, plus the keys if any) adds classes nobody has or predicts; ``acc``
    of a class without rows is NULL.
    """
    keys = list(keys)
    hit = (F.col(cls) == F.col(guess)).cast("int")
    zero, one = F.lit(0), F.lit(1)
    marks = F.array(
        F.struct(F.col(cls).alias("scene"), zero.alias("p"), hit.alias("c"), one.alias("a")),
        F.struct(F.col(guess).alias("scene"), one.alias("p"), zero.alias("c"), zero.alias("a")),
    )
    rows = pred.select(*keys, F.explode(marks).alias("_m")).select(*keys, "_m.scene", "_m.p", "_m.c", "_m.a")
    if classes is not None:
        rows = rows.unionByName(classes.select(*keys, "scene", zero.alias("p"), zero.alias("c"), zero.alias("a")))
    return (
        rows.where(F.col("scene").isNotNull())
        .groupBy(*keys, "scene")
        .agg(F.sum("p").alias("pred"), F.sum("c").alias("correct"), F.sum("a").alias("all"))
        .withColumn("acc", F.col("correct") * 100.0 / F.nullif(F.col("all"), F.lit(0)))
    )


def accuracy(report: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """``macro_acc`` skips classes without rows; ``macro_acc_lib`` counts a class that is only
    predicted as 0; ``micro_acc`` pools the rows."""
    seen = (F.col("all") > 0) | (F.col("pred") > 0)
    return report.groupBy(*keys).agg(
        F.avg("acc").alias("macro_acc"),
        F.avg(F.when(seen, F.coalesce("acc", F.lit(0.0)))).alias("macro_acc_lib"),
        (F.sum("correct") * 100.0 / F.nullif(F.sum("all"), F.lit(0))).alias("micro_acc"),
    )


def group_median(df: DataFrame, keys: Sequence[str], score: str = "score", target_rows: int = TARGET_ROWS) -> DataFrame:
    """``(keys, median)``, exact: the mean of the two middle values.

    Equal values are folded and counted up in order, so no task holds the values of a group.
    """
    keys = list(keys)
    folded = df.where(F.col(score).isNotNull()).groupBy(*keys, F.col(score).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    steps = running_sums(folded, keys, ["_v"], ["_c"], target_rows=target_rows, sized_by=df)
    # a value covers the places (_c_run - _c, _c_run] of 1.._c_all
    low, high = F.floor((F.col("_c_all") + 1) / 2), F.floor(F.col("_c_all") / 2) + 1

    def covers(place: Column) -> Column:
        return (F.col("_c_run") - F.col("_c") < place) & (place <= F.col("_c_run"))

    return (
        steps.where(covers(low) | covers(high))
        .groupBy(*keys)
        .agg(((F.min("_v") + F.max("_v")) / 2).alias("median"))
    )


def median_decision(df: DataFrame, keys: Sequence[str], score: str = "score", target_rows: int = TARGET_ROWS) -> DataFrame:
    """1 where the score is above the exact median of its group."""
    medians = group_median(df, keys, score, target_rows).withColumnRenamed("median", "_med")
    out = null_safe_join(df, medians, keys, "left") if keys else df.join(medians, [], "left")
    return out.withColumn("decision", (F.col(score) > F.col("_med")).cast("int")).drop("_med")


def score_histogram(df: DataFrame, keys: Sequence[str], score: str = "score", status: str = "status", points: int = 50) -> DataFrame:
    """Counts of normal and anomalous scores in ``points - 1`` equal bins between the group's extremes.

    The last bin holds its upper edge; bins without rows are left out.
    """
    bins = points - 1
    out = with_group_stats(df, keys, lo=F.min(score), hi=F.max(score))
    place = F.floor((F.col(score) - F.col("lo")) * bins / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)))
    out = out.withColumn("bin", F.least(F.coalesce(place, F.lit(0)), F.lit(bins - 1)).cast("int"))
    return out.groupBy(*keys, "bin").agg(
        F.count(F.when(F.col(status) == 0, 1)).alias("normal"), F.count(F.when(F.col(status) == 1, 1)).alias("anomaly")
    )


def curve_area(df: DataFrame, keys: Sequence[str], x: str, y: str, method: str = "simpson") -> DataFrame:
    """Area under a curve of a few points per key (one per train fraction), by trapezoids or Simpson.

    Simpson runs over pairs of intervals of any widths above 0; an odd number of intervals gets the
    usual parabola correction on the last one.
    """
    keys = list(keys)
    w = W.partitionBy(*keys).orderBy(x)
    p = df.select(
        *keys,
        F.col(x).alias("_x"), F.col(y).alias("_y"),
        F.lag(x, 1).over(w).alias("_x1"), F.lag(y, 1).over(w).alias("_y1"),
        F.lag(x, 2).over(w).alias("_x2"), F.lag(y, 2).over(w).alias("_y2"),
        (F.row_number().over(w) - 1).alias("_i"),
        (F.count(F.lit(1)).over(W.partitionBy(*keys)) - 1).alias("_last"),
    )
    trapezoid = F.expr("case when _i > 0 then (_x - _x1) * (_y + _y1) / 2D else 0D end")
    if method == "trapezoid":
        part = trapezoid
    elif method == "simpson":
        p = p.withColumn("_h0", F.col("_x1") - F.col("_x2")).withColumn("_h1", F.col("_x") - F.col("_x1"))
        pair = (
            "(_h0 + _h1) / 6D * ((2D - _h1 / nullif(_h0, 0D)) * _y2"
            " + (_h0 + _h1) * (_h0 + _h1) / nullif(_h0 * _h1, 0D) * _y1 + (2D - _h0 / nullif(_h1, 0D)) * _y)"
        )
        end = (
            "_y * (2D * _h1 * _h1 + 3D * _h0 * _h1) / nullif(6D * (_h0 + _h1), 0D)"
            " + _y1 * (_h1 * _h1 + 3D * _h1 * _h0) / nullif(6D * _h0, 0D)"
            " - _y2 * _h1 * _h1 * _h1 / nullif(6D * _h0 * (_h0 + _h1), 0D)"
        )
        part = (
            F.when((F.col("_last") == 1), trapezoid)
            .when((F.col("_i") >= 2) & (F.col("_i") % 2 == 0), F.expr(pair))
            .when((F.col("_i") == F.col("_last")) & (F.col("_i") % 2 == 1) & (F.col("_i") >= 2), F.expr(end))
            .otherwise(0.0)
        )
    else:
        raise ValueError(f"unknown method {method!r}")
    return p.groupBy(*keys).agg(F.sum(part).alias("area"))
