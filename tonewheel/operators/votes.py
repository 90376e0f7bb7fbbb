"""Class decisions from neighbour lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonewheel.functions.arrays import softmax

VOTE_DECIMALS = 9


def neighbour_classes(hits: DataFrame, classes: DataFrame, file: str = "file", cls: str = "cls") -> DataFrame:
    """Attach the class of each neighbour; ``classes`` is ``(file, cls)`` of the train rows."""
    return hits.join(classes.select(F.col(file).alias("neighbour"), F.col(cls).alias("ncls")), "neighbour")


def class_sums(hits: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sum of similarities per class of the neighbours."""
    return hits.groupBy(*keys, "ncls").agg(F.sum("sim").alias("logit"))


def vote(hits: DataFrame, keys: Sequence[str], num_classes: int) -> DataFrame:
    """Similarity-weighted class; ties go to the lower id.

    A class without a neighbour counts as 0 and wins over negative sums. Only the classes seen
    are rows; the best absent one is the lowest id not among them.
    """
    sums = class_sums(hits, keys).withColumn("_l", F.round("logit", VOTE_DECIMALS) + F.lit(0.0))
    best = sums.groupBy(*keys).agg(
        F.max(F.struct(F.col("_l"), (-F.col("ncls")).alias("neg"))).alias("_best"),
        F.collect_set("ncls").alias("_seen"),
    )
    ids = F.sequence(F.lit(0), F.lit(num_classes - 1))
    best = best.withColumn("_absent", F.array_min(F.array_except(ids, F.col("_seen").cast("array<int>"))))
    present = (-F.col("_best.neg")).cast("int")
    absent_wins = F.col("_absent").isNotNull() & (
        (F.col("_best._l") < 0) | ((F.col("_best._l") == 0) & (F.col("_absent") < present))
    )
    return best.select(*keys, F.when(absent_wins, F.col("_absent")).otherwise(present).alias("pred"))


def class_probabilities(hits: DataFrame, keys: Sequence[str], num_classes: int) -> DataFrame:
    """Softmax over the sums of all classes, absent ones as 0: ``(keys, prob array)``."""
    pairs = F.map_from_entries(F.collect_list(F.struct(F.col("ncls").cast("int"), F.col("logit"))))
    dense = class_sums(hits, keys).groupBy(*keys).agg(pairs.alias("_m"))
    ids = F.sequence(F.lit(0), F.lit(num_classes - 1))
    logits = F.transform(ids, lambda c: F.coalesce(F.col("_m")[c], F.lit(0.0)))
    return dense.select(*keys, softmax(logits).alias("prob"))


def neighbour_lists(hits: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Neighbours of a file as one array of ``(sim, file)``, nearest first; bounded by k."""
    rows = F.array_sort(F.collect_list(F.struct("rank", "sim", "neighbour")))
    return hits.groupBy(*keys).agg(
        F.transform(rows, lambda r: F.struct(r["sim"].alias("sim"), r["neighbour"].alias("file"))).alias("pred")
    )


def for_every_k(hits: DataFrame, min_k: int, max_k: int) -> DataFrame:
    """Reuse one search at ``max_k`` for each k: a neighbour of rank r counts for every k from r on."""
    ks = F.sequence(F.greatest(F.col("rank"), F.lit(min_k)), F.lit(max_k))
    return hits.select("*", F.explode(ks).alias("k"))
