"""Checksum manifests and the audit of the files they name; download plans."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK_BYTES = 1 << 22
# The two regular line forms, "MD5 (file) = sum" and "sum  file".
TAGGED = r"^MD5\s*\((.+)\)\s*=\s*([A-Fa-f0-9]{32})$"
PLAIN = r"^([A-Fa-f0-9]{32})\s+\*?(.+)$"


def parse_manifest(lines: DataFrame, value: str = "value") -> DataFrame:
    """Add ``checksum`` and ``path`` to every entry; blank lines and comments are dropped.

    A line of neither form is cut at its first blank; one that cannot be cut is no entry.
    """
    line = F.regexp_replace(F.col(value), r"^\s+|\s+$", "")
    rows = lines.withColumn("_l", line).where((F.col("_l") != "") & ~F.startswith("_l", F.lit("#")))
    tagged, plain = F.rlike("_l", F.lit(TAGGED)), F.rlike("_l", F.lit(PLAIN))
    loose = F.contains("_l", F.lit(" "))
    checksum = (
        F.when(tagged, F.regexp_extract("_l", TAGGED, 2))
        .when(plain, F.regexp_extract("_l", PLAIN, 1))
        .when(loose, F.regexp_extract("_l", r"^([^ ]*) ", 1))
    )
    path = (
        F.when(tagged, F.regexp_extract("_l", TAGGED, 1))
        .when(plain, F.regexp_extract("_l", PLAIN, 2))
        .when(loose, F.regexp_replace(F.regexp_extract("_l", r"^[^ ]* (.*)$", 1), r"^\s*\*?", ""))
    )
    return rows.withColumn("checksum", checksum).withColumn("path", path).drop("_l").where("checksum <> '' and path <> ''")


def file_checksums(spark, root: str) -> DataFrame:
    """``(path, actual)``: md5 of every file below ``root``, read as a stream in its task, whatever its size.

    Spark lists the files and their lengths (its readers pass over empty files, so those have no row); contents are
    opened by address on any file system that Arrow knows.
    """
    from tonewheel.sources.files import local_path

    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length")
    # the longest files first and one by one, so that none waits behind another
    spread = listed.repartition(max(1, spark.sparkContext.defaultParallelism * 4), "path").sortWithinPartitions(F.desc("length"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for path in batch.column("path").to_pylist():
                system, inner = fs.FileSystem.from_uri(path)
                md5 = hashlib.md5()
                with system.open_input_stream(inner) as stream:
                    while part := stream.read(CHUNK_BYTES):
                        md5.update(part)
                yield pa.record_batch([pa.array([path]), pa.array([md5.hexdigest()])], names=["path", "actual"])

    return spread.mapInArrow(digest, "path string, actual string").select(local_path(F.col("path")).alias("path"), "actual")


def audit(entries: DataFrame, files: DataFrame) -> DataFrame:
    """Add ``status``: missing, mismatch or verified. ``files`` is ``(path, actual)``."""
    status = (
        F.when(F.col("actual").isNull(), "missing")
        .when(F.lower("actual") == F.lower("checksum"), "verified")
        .otherwise("mismatch")
    )
    return entries.join(files, "path", "left").withColumn("status", status)


def audit_summary(audited: DataFrame) -> DataFrame:
    return audited.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def reconcile_plan(found: DataFrame, plan: DataFrame, dataset: str = "dataset_name") -> DataFrame:
    """Old plan plus the items of data sets it does not know yet, as not started; finished ones left out.

    ``found`` is ``(dataset_name, url)``, ``plan`` adds ``status`` and ``total_size``.
    """
    new = found.join(plan.select(dataset).distinct(), dataset, "left_anti").select(
        dataset, "url", F.lit("not_started").alias("status"), F.lit(0).cast("bigint").alias("total_size")
    )
    merged = plan.select(dataset, "url", "status", "total_size").unionByName(new)
    wanted = found.select(dataset).distinct()
    return merged.join(wanted, dataset, "left_semi").where(F.col("status") != "completed")
