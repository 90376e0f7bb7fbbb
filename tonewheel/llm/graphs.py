"""Connected components of links that lie in a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonewheel.session import settle

MAX_ROUNDS = 64


def _stars(edges: DataFrame, larger: bool) -> DataFrame:
    """One star step over pairs ``u > v``: every node hangs its (larger, or smaller) neighbours on its least one."""
    if larger:
        both = edges.union(edges.select(F.col("v"), F.col("u"))).toDF("u", "v")
    else:
        both = edges
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = both.join(least, "u")
    if larger:
        return joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).filter(F.col("u") > F.col("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """``node, component`` for every node of a link: the least node that links reach from it.

    Alternates two star steps, each a partial aggregate and a join on the node, until the pairs stay the same. All
    rounds are tables in the shared folder; nothing is gathered but two numbers a round. A node with very many links is
    one aggregate with map-side combine and one join that adaptive execution can split.
    Links with a null end and links of a node with itself say nothing and are left out; no links give no rows.
    """
    edges = settle(
        links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"), F.col(a).alias("a"), F.col(b).alias("b"))
        .filter(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("u") > F.col("v"))).select("u", "v").distinct()
    )
    mark = None
    for _ in range(MAX_ROUNDS):
        edges = settle(_stars(_stars(edges, True), False))
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if tuple(now) == mark:
            break
        mark = tuple(now)
    else:
        raise RuntimeError(f"components not settled after {MAX_ROUNDS} rounds")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
