"""Stored vectors and sharded caches in Parquet."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tonewheel.operators.skew import positions


def write_vectors(df: DataFrame, path: str, file: str = "file", vec: str = "emb") -> None:
    df.select(F.col(file).alias("file"), F.col(vec).cast("array<float>").alias("emb")).write.mode("overwrite").parquet(path)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("file string, emb array<float>").parquet(path)


def stored(spark: SparkSession, path: str, compute: Callable[[], DataFrame], overwrite: bool = False) -> DataFrame:
    """The table at ``path``; computed and written first if it is not there in full or ``overwrite`` is set.

    A folder without the mark of a finished write counts as not there; any other trouble with it is an error.
    """
    if not overwrite:
        try:
            spark.read.text(f"{path}/_SUCCESS")
            return spark.read.parquet(path)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
    compute().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def _manifest(path: str) -> str:
    return f"{path}/_manifest"


def _digest(schema: T.StructType) -> str:
    return hashlib.md5(schema.json().encode()).hexdigest()


def write_shards(df: DataFrame, path: str, shards: int, order: str) -> None:
    """Contiguous ranges of ``order``, one per shard number, of equal size up to a row.

    A manifest (shards, rows of each, schema and its digest) is written last: a cache without one is unfinished.
    Fewer rows than shards leave shards empty.
    """
    spark = df.sparkSession
    placed = positions(df, [], [order], "_pos").withColumn("shard", F.floor(F.col("_pos") * shards / F.col("_pos_n")).cast("int"))
    placed.drop("_pos", "_pos_n").write.mode("overwrite").partitionBy("shard").parquet(path)
    full = T.StructType([*df.schema.fields, T.StructField("shard", T.IntegerType())])
    rows = spark.read.schema(full).parquet(path).groupBy("shard").agg(F.count(F.lit(1)).alias("rows"))
    every = spark.range(shards).select(F.col("id").cast("int").alias("shard")).join(rows, "shard", "left").na.fill(0, ["rows"])
    facts = every.select("shard", "rows", F.lit(df.schema.json()).alias("schema"), F.lit(_digest(df.schema)).alias("digest"))
    facts.coalesce(1).write.mode("overwrite").json(_manifest(path))  # a row for each shard


def read_shards(spark: SparkSession, path: str, shards: int, rows: int) -> DataFrame:
    """Read a sharded cache; an unfinished one, a wrong number of shards or rows, or other rows than its manifest tells
    of in some shard, are errors."""
    try:
        spark.read.text(f"{_manifest(path)}/_SUCCESS")
        facts = spark.read.schema("shard int, rows long, schema string, digest string").json(_manifest(path)).collect()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        raise ValueError(f"no finished cache at {path}") from None
    told = {f["shard"]: f["rows"] for f in facts}
    if len(told) != shards or sum(told.values()) != rows:
        raise ValueError(f"cache holds {sum(told.values())} rows in {len(told)} shards, expected {rows} in {shards}")
    schema = T.StructType.fromJson(json.loads(facts[0]["schema"]))
    if _digest(schema) != facts[0]["digest"]:
        raise ValueError(f"the schema of {path} isn't the one it was written with")
    df = spark.read.schema(T.StructType([*schema.fields, T.StructField("shard", T.IntegerType())])).parquet(path)
    held = {r["shard"]: r["n"] for r in df.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}
    wrong = sorted(k for k in told.keys() | held.keys() if told.get(k, 0) != held.get(k, 0))
    if wrong:
        raise ValueError(f"shards {wrong} of {path} hold other rows than were written")
    return df.drop("shard")
