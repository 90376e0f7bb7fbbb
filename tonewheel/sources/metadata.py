"""Metadata tables: schemas, scans by folder layout, ground-truth lists, partitioned sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tonewheel.functions import names
from tonewheel.functions.tables import MACHINES, TRUTH_FIELDS
from tonewheel.operators.skew import forward_fill
from tonewheel.sources.files import local_path

ANOMALY_SCHEMA = "file string, path string, mt string, sec int, domain int, status int, attri string"
TIMED_SCHEMA = ANOMALY_SCHEMA + ", num_frames bigint, sample_rate int, dur double"
FAULT_SCHEMA = "file string, scene string, status string, path string, ori string, dur double"


def read_metadata(spark: SparkSession, root: str, schema: str | T.StructType = ANOMALY_SCHEMA, conditions: Sequence[str] = ()) -> DataFrame:
    """CSV tables laid out as ``<dataset>/<setn>/<sett>/<mt>.csv``, with the folders as columns.

    Columns in another order than the schema's are an error. ``conditions`` are path substrings that must all occur. Folders other than train and test
    (supplementary data) are left out.
    """
    path = local_path(F.col("_metadata.file_path"))
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").schema(schema).csv(root, header=True, enforceSchema=False)
    parts = F.split(path, "/")
    return (
        raw.where(names.path_holds(path, conditions))
        .withColumn("dataset", F.element_at(parts, -4))
        .withColumn("setn", F.element_at(parts, -3))
        .withColumn("sett", F.element_at(parts, -2))
    )


def write_metadata(df: DataFrame, path: str, by: Sequence[str] = ("dataset", "setn", "sett", "mt"), fmt: str = "parquet") -> None:
    writer = df.write.mode("overwrite").partitionBy(*by)
    writer.option("header", True).csv(path) if fmt == "csv" else writer.parquet(path)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(path, line, value)`` of small list files, in file order."""
    text = spark.read.text(path, wholetext=True).select(local_path(F.col("_metadata.file_path")).alias("path"), "value")
    rows = text.select("path", F.posexplode(F.split("value", "\r?\n")).alias("line", "value"))
    return rows.where(F.trim("value") != "")


def parse_truth(lines: DataFrame, dataset: str, machines: Sequence[str] | None = None, key: str = "path") -> tuple[DataFrame, DataFrame]:
    """A sectioned list: a machine row opens a section, the rows below name its files.

    Returns ``(mt, file, orig)`` and the rows of unknown shape ``(line, value)``.
    """
    known = list(machines or MACHINES[dataset]["eval"])
    fields = F.split(F.rtrim("value"), ",")
    rows = lines.withColumn("_f", fields).withColumn("_n", F.size("_f"))
    opens = F.when((F.col("_n") == 1) & F.col("_f")[0].isin(known), F.col("_f")[0])
    filled = forward_fill(rows, [key], "line", opens, "mt")
    is_file = (F.col("_n") == TRUTH_FIELDS[dataset]) & F.col("mt").isNotNull()
    is_head = (F.col("_n") == 1) & F.col("_f")[0].isin(known)
    good = filled.where(is_file).select("mt", F.col("_f")[0].alias("file"), F.col("_f")[1].alias("orig"))
    return good, filled.where(~is_file & ~is_head).select("line", "value")
