"""Fault diagnosis: neighbour votes over fixed or repeated sealed splits, accuracy and its curves."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonewheel.operators.knn import knn_join, knn_runs
from tonewheel.operators.metrics import accuracy, class_report, curve_area
from tonewheel.operators.splits import Split, membership, sealed_splits
from tonewheel.operators.votes import for_every_k, vote


def nearest(test: DataFrame, train: DataFrame, k: int, cls: str = "cls", block_rows: int = 8192) -> DataFrame:
    """Cosine neighbours of every test row among all train rows: ``(file, cls, rank, sim, neighbour, ncls)``."""
    hits = knn_join(test, train, [], k, "cosine", carry=[cls], block_rows=block_rows, train_carry=[cls])
    return hits.withColumn("sim", 1 - F.col("dist")).withColumnRenamed(f"n{cls}", "ncls").drop("dist")


def diagnose(test: DataFrame, train: DataFrame, k: int, num_classes: int, cls: str = "cls") -> DataFrame:
    """Predictions ``(file, cls, pred, eval)`` with class ids."""
    return scored(vote(nearest(test, train, k, cls), ["file", cls], num_classes), cls)


def scored(pred: DataFrame, cls: str = "cls") -> DataFrame:
    return pred.withColumn("eval", (F.col("pred") == F.col(cls)).cast("int"))


def k_sweep(test: DataFrame, train: DataFrame, min_k: int, max_k: int, num_classes: int, cls: str = "cls") -> DataFrame:
    """Accuracy for every k from one search: ``(k, macro_acc, macro_acc_lib, micro_acc)``."""
    pred = vote(for_every_k(nearest(test, train, max_k, cls), min_k, max_k), ["k", "file", cls], num_classes)
    return accuracy(class_report(pred, ["k"], cls), ["k"])


def run_predictions(vectors: DataFrame, splits: Sequence[Split], unit: str, k: int, num_classes: int, cls: str = "cls", block_rows: int = 8192) -> DataFrame:
    """Predictions of all splits in one job: ``(run, test_size, file, cls, pred)``.

    A neighbour brings its class along, so no class table is joined.
    """
    marked = membership(vectors, unit, splits)
    hits = knn_runs(marked, "in_test", len(splits), k, carry=[cls], block_rows=block_rows, train_carry=[cls])
    hits = hits.withColumnRenamed("run", "split_id").withColumnRenamed(f"n{cls}", "ncls")
    pred = vote(hits, ["split_id", "file", cls], num_classes)
    facts = F.array(*[F.struct(F.lit(s.run).alias("run"), F.lit(s.test_size).alias("test_size")) for s in splits])
    return pred.withColumn("_s", F.get(facts, F.col("split_id"))).select("_s.run", "_s.test_size", "file", cls, "pred")


def repeated(vectors: DataFrame, unit: str, k: int, num_classes: int, test_sizes: Sequence[float] = (0.5,), runs: int = 10, seed: int = 111, cls: str = "cls") -> DataFrame:
    """Accuracy of every run and test size: ``(run, test_size, macro_acc, macro_acc_lib, micro_acc)``."""
    splits = sealed_splits(vectors, unit, cls, test_sizes, runs, seed)
    pred = run_predictions(vectors, splits, unit, k, num_classes, cls)
    return accuracy(class_report(pred, ["run", "test_size"], cls), ["run", "test_size"])


def run_summary(results: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Mean and sample deviation over runs; NULL deviation below two values."""
    return results.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))


def split_curve(summary: DataFrame, num_classes: int, keys: Sequence[str] = (), size: str = "test_size", value: str = "mean", method: str = "simpson") -> DataFrame:
    """Area under accuracy against train fraction, with chance level at 0 and a perfect 1 added."""
    keys = list(keys)
    point = F.struct((1 - F.col(size)).alias("x"), (F.col(value) / 100).alias("y"))
    ends = F.array(
        F.struct(F.lit(0.0).alias("x"), F.lit(1.0 / num_classes).alias("y")),
        F.struct(F.lit(1.0).alias("x"), F.lit(1.0).alias("y")),
    )
    points = summary.select(*keys, point.alias("_p"))
    edge = (summary.select(*keys).distinct() if keys else summary.groupBy().agg(F.lit(1).alias("_one"))).select(*keys, F.explode(ends).alias("_p"))
    curve = points.unionByName(edge).select(*keys, "_p.x", "_p.y")
    return curve_area(curve, keys, "x", "y", method).withColumn("area", F.col("area") * 100)
