"""Exact ROC metrics for many groups at once.

Rows are folded to one line per (group, score) before anything is sorted, so ties cost nothing and
a hot score value is one line. Areas are sums over curve steps; the curve never leaves the executors.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonewheel.operators.skew import TARGET_ROWS, running_sums


def fold_scores(df: DataFrame, keys: Sequence[str], y: Column, score: Column) -> DataFrame:
    """``(keys, score, pos, neg)``; rows without a label or a score take no part."""
    hit = F.when(y.cast("int") == 1, 1).otherwise(0).cast("bigint")
    return (
        df.where(y.isNotNull() & score.isNotNull())
        .groupBy(*keys, score.cast("double").alias("score"))
        .agg(F.sum(hit).alias("pos"), F.sum(1 - hit).alias("neg"))
    )


def roc_steps(
    folded: DataFrame, keys: Sequence[str], target_rows: int = TARGET_ROWS, sized_by: DataFrame | None = None
) -> DataFrame:
    """Curve steps from the highest score down: counts at the step, running counts, totals."""
    return running_sums(folded, keys, ["score"], ["pos", "neg"], True, target_rows, sized_by)


def roc_points(df: DataFrame, keys: Sequence[str], y: Column, score: Column, target_rows: int = TARGET_ROWS) -> DataFrame:
    """One point per distinct score: ``(keys, score, fpr, tpr)``. The origin is implied."""
    steps = roc_steps(fold_scores(df, keys, y, score), keys, target_rows, df)
    return steps.select(
        *keys,
        "score",
        F.expr("neg_run / nullif(cast(neg_all as double), 0D)").alias("fpr"),
        F.expr("pos_run / nullif(cast(pos_all as double), 0D)").alias("tpr"),
    )


def roc_aggregates(pos: Sequence[str], neg: Sequence[str], max_fpr: float = 0.1) -> tuple[Column, Column]:
    """AUC and standardised partial AUC as aggregates over curve steps.

    The positives of the curve are the sum of the ``pos`` columns, its negatives that of ``neg``; each
    needs its ``_run`` and ``_all`` columns. So several curves over one order of scores share one
    window. With one class only there is no curve, and both are NULL.
    """
    def added(columns: Sequence[str], suffix: str = "") -> Column:
        return reduce(add, [F.col(c + suffix) for c in columns]).cast("double")

    p, q, f = added(pos), added(neg), float(max_fpr)
    tp0, fp0 = added(pos, "_run") - p, added(neg, "_run") - q
    all_p, all_q = F.max(added(pos, "_all")), F.max(added(neg, "_all"))
    area = F.sum(q * (tp0 + p / 2))
    # width of a step left of the limit; the curve is linear inside a step
    dx = F.least(q, F.greatest(f * added(neg, "_all") - fp0, F.lit(0.0)))
    part = F.sum(F.coalesce(dx * (tp0 + p * dx / F.nullif(q, F.lit(0.0)) / 2), F.lit(0.0)))
    low = 0.5 * f * f
    cells = F.nullif(all_p * all_q, F.lit(0.0))
    return area / cells, 0.5 * (1 + (part / cells - low) / (f - low))


def roc_metrics(
    folded: DataFrame, keys: Sequence[str], max_fpr: float = 0.1, target_rows: int = TARGET_ROWS, sized_by: DataFrame | None = None
) -> DataFrame:
    """``auc`` and ``pauc`` of every group, from one pass over its curve."""
    auc, pauc = roc_aggregates(["pos"], ["neg"], max_fpr)
    return roc_steps(folded, keys, target_rows, sized_by).groupBy(*keys).agg(auc.alias("auc"), pauc.alias("pauc"))


def roc_by_group(
    df: DataFrame,
    keys: Sequence[str],
    y: Column,
    score: Column,
    max_fpr: float = 0.1,
    target_rows: int = TARGET_ROWS,
) -> DataFrame:
    return roc_metrics(fold_scores(df, keys, y, score), keys, max_fpr, target_rows, df)
