"""Many window vectors of a file to one file vector."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonewheel.functions.arrays import argmax

# Up to this width one aggregate per dimension keeps a row a row; above it, rows are exploded.
WIDE = 256


def _folds(how: str, v: Column) -> list[Column]:
    v = v.cast("double")
    one = {"sum": F.sum, "mean": F.avg, "std": F.stddev_pop, "max": F.max, "min": F.min, "soft": F.sum}
    if how == "mean_std":
        return [F.avg(v), F.stddev_pop(v)]
    return [one[how](v)]


def _field(name: str):
    return lambda row: row[name]


def pool_vectors(df: DataFrame, keys: Sequence[str], how: str, vec: str = "emb", dim: int | None = None) -> DataFrame:
    """``sum, mean, std, mean_std, max, min, raw, hard`` or ``soft`` over the vectors of each key.

    ``raw`` leaves the rows as they are: several rows per file are its form of "one file, n vectors".
    Standard deviation is that of the population. Vectors of another length than the first (or than ``dim``) and NULL
    vectors are an error, whichever plan the width calls for.
    """
    keys = list(keys)
    if how == "raw":
        return df.select(*keys, *[c for c in df.columns if c not in keys])
    if how == "hard":
        votes = df.groupBy(*keys, argmax(F.col(vec)).alias("_cls")).agg(F.count(F.lit(1)).alias("_n"))
        best = F.max_by("_cls", F.struct(F.col("_n"), -F.col("_cls")))
        return votes.groupBy(*keys).agg(F.array(best.cast("double")).alias(vec))
    if dim is None:
        first = df.where(F.col(vec).isNotNull()).select(F.size(vec).alias("d")).first()
        dim = first["d"] if first else 0
    wrong = F.raise_error(F.concat(F.lit(f"vector of {dim} numbers expected, found "), F.coalesce(F.size(vec).cast("string"), F.lit("NULL"))))
    df = df.withColumn(vec, F.when(F.col(vec).isNotNull() & (F.size(vec) == dim), F.col(vec)).otherwise(wrong))
    if 0 < dim <= WIDE:
        columns = [F.col(vec)[i] for i in range(dim)]
        parts = [_folds(how, c) for c in columns]
        ordered = [p[j] for j in range(len(parts[0])) for p in parts]
        flat = df.groupBy(*keys).agg(*[c.alias(f"_{i}") for i, c in enumerate(ordered)])
        out = flat.select(*keys, F.array(*[f"_{i}" for i in range(len(ordered))]).alias(vec))
    else:
        long = df.select(*keys, F.posexplode(vec).alias("_pos", "_v")).groupBy(*keys, "_pos")
        folded = long.agg(*[c.alias(f"_f{j}") for j, c in enumerate(_folds(how, F.col("_v")))])
        count = len(_folds(how, F.col("_v")))
        rows = F.array_sort(F.collect_list(F.struct("_pos", *[f"_f{j}" for j in range(count)])))
        whole = folded.groupBy(*keys).agg(rows.alias("_rows"))
        halves = [F.transform("_rows", _field(f"_f{j}")) for j in range(count)]
        out = whole.select(*keys, F.concat(*halves).alias(vec))
    if how == "soft":
        out = out.withColumn(vec, F.array(argmax(F.col(vec)).cast("double")))
    return out
