"""Labels to ids and back. Class tables have one row per class."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def by_first_appearance(parts: Sequence[DataFrame], label: str, pos: str) -> DataFrame:
    """``(label, id)`` numbered in order of first row, tables one after the other."""
    seen = None
    for i, part in enumerate(parts):
        one = part.groupBy(label).agg(F.min(pos).alias("_pos")).withColumn("_part", F.lit(i))
        seen = one if seen is None else seen.unionByName(one)
    first = seen.groupBy(label).agg(F.min(F.struct("_part", "_pos")).alias("_at"))
    order = W.orderBy("_at", label)
    return first.select(label, (F.row_number().over(order) - 1).alias("id"))


def by_sorted_union(parts: Sequence[DataFrame], label: str) -> DataFrame:
    """``(label, id)`` numbered in label order over all tables."""
    union = None
    for part in parts:
        one = part.select(label).distinct()
        union = one if union is None else union.unionByName(one)
    return union.distinct().select(label, (F.row_number().over(W.orderBy(label)) - 1).alias("id"))


def by_fixed_list(df: DataFrame, label: str, classes: Sequence[str], name: str = "id") -> DataFrame:
    """Id = place in a given list; NULL for a label outside it."""
    ids = F.create_map(*[F.lit(x) for i, c in enumerate(classes) for x in (c, i)])
    return df.withColumn(name, ids[F.col(label)])


def with_ids(df: DataFrame, table: DataFrame, label: str, name: str = "id") -> DataFrame:
    return df.join(table.select(label, F.col("id").alias(name)), label, "left")


def with_labels(df: DataFrame, table: DataFrame, id_col: str, label: str, name: str) -> DataFrame:
    """The way back from an id column to the label."""
    back = table.select(F.col("id").alias(id_col), F.col(label).alias(name))
    return df.join(back, id_col, "left")
