"""Statistics over runs, data sets and models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tonewheel.operators.metrics import hmean


def run_statistics(runs: DataFrame, keys: Sequence[str], run_names: Sequence[object], value: str = "value", run: str = "run", decimals: int | None = 2) -> DataFrame:
    """One row per key: a column ``run<i>`` per run, then ``mean`` and ``std`` over the runs."""
    def shown(c: Column) -> Column:
        return c if decimals is None else F.bround(c, decimals)

    columns = [shown(F.max(F.when(F.col(run) == r, F.col(value)))).alias(f"run{i}") for i, r in enumerate(run_names)]
    used = F.when(F.col(run).isin(list(run_names)), F.col(value))
    return runs.groupBy(*keys).agg(*columns, shown(F.avg(used)).alias("mean"), shown(F.stddev_samp(used)).alias("std"))


def anomaly_run_rows(machines: DataFrame, year: int, subsets: DataFrame | None = None) -> DataFrame:
    """Machine values plus the subset row and the overall row of each run: ``(run, setn, mt, value)``.

    ``machines`` has ``(run, setn, mt, value)``. Years up to 22 derive the subset row from the machine
    rows; later years bring it in ``subsets`` as ``(run, setn, value)``.
    """
    fold = F.avg if year == 20 else hmean
    if subsets is None:
        subsets = machines.groupBy("run", "setn").agg(fold("value").alias("value"))
    overall = subsets.groupBy("run").agg(fold("value").alias("value"))
    name = "mean" if year == 20 else "hmean"
    return (
        machines.select("run", "setn", "mt", "value")
        .unionByName(subsets.select("run", "setn", F.lit("subset").alias("mt"), "value"))
        .unionByName(overall.select("run", F.lit("all").alias("setn"), F.lit(name).alias("mt"), "value"))
    )


def across_datasets(overall: DataFrame, run_names: Sequence[object], decimals: int | None = 2) -> DataFrame:
    """Overall row of each data set by run, and a mean row over the data sets."""
    average = overall.groupBy("run").agg(F.avg("value").alias("value")).withColumn("dataset", F.lit("mean"))
    return run_statistics(overall.select("run", "dataset", "value").unionByName(average.select("run", "dataset", "value")), ["dataset"], run_names, decimals=decimals)


def accuracy_from_report(lines: DataFrame, key: str, column: str = "value") -> DataFrame:
    """``macro-acc`` and ``micro-acc`` out of text reports, one report line per row."""
    found = F.regexp_extract(F.col(column), rf"^\s*{key}:\s*([0-9.]+)\s*$", 1)
    return lines.withColumn("value", F.when(found != "", found).try_cast("double")).where("value is not null")


def benchmark_score(scores: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Mean per task and the mean of the task means: ``(keys, task, score)``, task ``overall`` on top."""
    keys = list(keys)
    tasks = scores.groupBy(*keys, "task").agg(F.avg("score").alias("score"))
    top = tasks.groupBy(*keys).agg(F.avg("score").alias("score")).withColumn("task", F.lit("overall"))
    return tasks.select(*keys, "task", "score").unionByName(top.select(*keys, "task", "score"))


def leaderboard_order(column: Column, descending: bool = True) -> list[Column]:
    """Sort by the number in a cell where there is one, else by its text."""
    number = F.regexp_replace(column, r"[^0-9.\-]", "").try_cast("double")
    return [F.desc_nulls_last(number), F.desc(column)] if descending else [F.asc_nulls_last(number), F.asc(column)]


def best_per_column(long: DataFrame, column: str = "dataset", value: str = "score") -> DataFrame:
    """Rows that hold the best value of their column, ties included; the maximum is folded, not sorted."""
    best = long.groupBy(column).agg(F.max(value).alias("_best"))
    return long.join(best, column).where(F.col(value) == F.col("_best")).drop("_best")


def numeric_suffix(name: Column) -> Column:
    """The number at the end of a name, so that run10 follows run2."""
    return F.regexp_extract(name, r"(\d+)\D*$", 1).try_cast("bigint")


def machine_order(df: DataFrame, machines: dict[str, list[str]], mt: str = "mt", setn: str = "setn") -> list[Column]:
    """Order by the machine's place in its data set's list, dev before eval."""
    known = list(dict.fromkeys([*machines["dev"], *machines["eval"]]))
    place = F.array_position(F.array(*[F.lit(m) for m in known]), F.col(mt))
    return [F.when(place > 0, place).asc_nulls_last(), F.when(F.col(setn) == "dev", 0).otherwise(1).asc()]
