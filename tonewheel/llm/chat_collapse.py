"""Chat formatting: logged snapshots of growing conversations collapse to the longest before rendering. Native only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def turns_with_prefix(turns: DataFrame) -> DataFrame:
    """Every turn with its place ``k`` and ``prefix``, a rolling hash of roles and texts up to it (two times 64 bits).

    The hash of a turn holds its place, so the running exclusive-or of a conversation depends on the order of turns.
    Turns are ordered by turn, role and text, nulls first; a null role or text differs from an empty one.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    placed = turns.select("conv_id", "turn", "role", "text").withColumn("k", F.row_number().over(order))
    said = (F.col("k"), F.coalesce("role", F.lit("\u0000")), F.col("role").isNull(), F.coalesce("text", F.lit("\u0000")), F.col("text").isNull())
    one = placed.withColumn("h1", F.xxhash64(F.lit("a"), *said)).withColumn("h2", F.xxhash64(*said, F.lit("b")))
    upto = Window.partitionBy("conv_id").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    return one.withColumn("p1", F.bit_xor("h1").over(upto)).withColumn("p2", F.bit_xor("h2").over(upto)).drop("h1", "h2")


def maximal(turns: DataFrame) -> DataFrame:
    """``conv_id, turns, n_same``: conversations that are no proper prefix of another; of equal ones the least conv_id."""
    rolled = turns_with_prefix(turns.filter("conv_id is not null")).select("conv_id", "k", "p1", "p2")
    last = rolled.groupBy("conv_id").agg(F.max("k").alias("k")).join(rolled, ["conv_id", "k"])
    whole = last.groupBy("k", "p1", "p2").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_same"))
    inner = rolled.join(last.select("conv_id", F.col("k").alias("n")), "conv_id").filter("k < n").select("k", "p1", "p2").distinct()
    return whole.join(inner, ["k", "p1", "p2"], "left_anti").select("conv_id", F.col("k").alias("turns"), "n_same")


def rendered(turns: DataFrame) -> DataFrame:
    """``conv_id, turns, n_same, rendered`` of the maximal conversations: ``<|role|>\\ntext`` a turn, joined by line ends.

    Turns of a null conv_id belong to no conversation and are left out. A null role is ``unknown``, a null text empty.
    Repeated turns are turns. Other columns are not read; an empty table gives no rows. A hot first turn is one row of
    ``inner`` after a partial aggregate; equal conversations fold before the anti-join, so no key of it is hot.
    """
    kept = maximal(turns)
    said = F.concat(F.lit("<|"), F.coalesce("role", F.lit("unknown")), F.lit("|>\n"), F.coalesce("text", F.lit("")))
    rows = turns.select("conv_id", "turn", "role", "text").join(kept.select("conv_id"), "conv_id", "left_semi")
    lines = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text", said.alias("said")))).alias("all"))
    return kept.join(lines.select("conv_id", F.array_join(F.transform("all", lambda t: t["said"]), "\n").alias("rendered")), "conv_id")
