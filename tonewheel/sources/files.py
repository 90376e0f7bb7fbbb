"""Signal files: catalog, headers, waveforms."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from tonewheel.session import settle

HEADER_BYTES = 44


def local_path(path: Column) -> Column:
    return F.regexp_replace(path, "^file:/+", "/")


def catalog(spark: SparkSession, root: str, suffix: str = "wav") -> DataFrame:
    """``(path, length)`` of every file below ``root``; contents are not read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{suffix}")
    return reader.load(root).select(local_path(F.col("path")).alias("path"), "length")


def _little_endian(header: Column, start: int, size: int) -> Column:
    """Unsigned integer at byte ``start`` of a binary column."""
    digits = [F.hex(F.substring(header, start + i + 1, 1)) for i in reversed(range(size))]
    return F.conv(F.concat(*digits), 16, 10).cast("bigint")


def with_header_facts(df: DataFrame, header: str = "header", length: str = "length") -> DataFrame:
    """``num_frames, sample_rate, dur`` from the first 44 bytes of a PCM file and its length."""
    h = F.col(header)
    channels, rate, bits = _little_endian(h, 22, 2), _little_endian(h, 24, 4), _little_endian(h, 34, 2)
    width = F.floor((bits + 7) / 8)
    frames = F.floor((F.col(length) - HEADER_BYTES) / F.nullif((channels * width).cast("double"), F.lit(0.0)))
    return (
        df.withColumn("channels", channels.cast("int"))
        .withColumn("num_frames", frames.cast("bigint"))
        .withColumn("sample_rate", rate.cast("int"))
        .withColumn("dur", F.col("num_frames") / F.nullif(F.col("sample_rate").cast("double"), F.lit(0.0)))
    )


def headers(files: DataFrame) -> DataFrame:
    """Read only the header bytes of every catalogued file, in parallel: adds ``header``.

    Works on any file system Arrow can open by its address.
    """
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            heads = []
            for path in batch.column("path").to_pylist():
                system, inner = fs.FileSystem.from_uri(path)
                with system.open_input_file(inner) as stream:
                    heads.append(stream.read(HEADER_BYTES))
            yield batch.append_column("header", pa.array(heads, pa.binary()))

    return files.mapInArrow(read, T.StructType([*files.schema.fields, T.StructField("header", T.BinaryType())]))


def scan_headers(spark: SparkSession, root: str) -> DataFrame:
    """``(path, length, channels, num_frames, sample_rate, dur)`` of all wav files below ``root``."""
    return with_header_facts(headers(catalog(spark, root))).drop("header")


def decode_pcm(content: bytes) -> tuple[int, np.ndarray]:
    """Sample rate and ``[frame, channel]`` samples in -1..1 of one RIFF file."""
    if content[:4] != b"RIFF" or content[8:12] != b"WAVE":
        raise ValueError("not a RIFF wave file")
    at, kind, channels, rate, bits, data = 12, 1, 1, 0, 16, b""
    while at + 8 <= len(content):
        name, size = content[at : at + 4], struct.unpack_from("<I", content, at + 4)[0]
        body = content[at + 8 : at + 8 + size]
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", body)
            if kind == 0xFFFE and len(body) >= 26:  # extensible: the real kind opens the sub-format
                kind = struct.unpack_from("<H", body, 24)[0]
        elif name == b"data":
            data = body
        at += 8 + size + (size & 1)
    width = bits // 8
    data = data[: len(data) // (width * channels) * width * channels]
    if kind == 3:
        x = np.frombuffer(data, "<f4" if bits == 32 else "<f8").astype(np.float64)
    elif bits == 8:
        x = (np.frombuffer(data, np.uint8).astype(np.float64) - 128) / 128
    elif bits == 24:
        raw = np.frombuffer(data, np.uint8).reshape(-1, 3).astype(np.int32)
        x = (((raw[:, 0] << 8) | (raw[:, 1] << 16) | (raw[:, 2] << 24)) >> 8) / float(1 << 23)
    else:
        x = np.frombuffer(data, f"<i{width}") / float(1 << (bits - 1))
    return rate, x.reshape(-1, channels)


def waveforms(spark: SparkSession, root: str, mixdown: bool = False) -> DataFrame:
    """``(path, sr, x)`` of every wav file. More than one channel is an error, or their mean with ``mixdown``."""
    raw = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.wav").load(root)
        .select(local_path(F.col("path")).alias("path"), "content")
    )

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                rate, x = decode_pcm(content.as_py())
                if x.shape[1] > 1 and not mixdown:
                    raise ValueError(f"{path} has {x.shape[1]} channels; only mono is supported")
                one = pa.array([x.mean(1).astype(np.float32)], pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([rate], pa.int32()), one], ["path", "sr", "x"])

    return raw.mapInArrow(decode, "path string, sr int, x array<float>")


def csv_signals(spark: SparkSession, path: str, channels: list[str | int], header: bool = True, separator: str = ",") -> DataFrame:
    """``(path, channel, x)`` from signal tables in text, one column per channel, in row order.

    A channel is a column name or a position from 0. A file is one row, so its sample order holds.
    """
    text = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(
        local_path(F.col("_metadata.file_path")).alias("path"), F.col("value")
    )
    lines = F.filter(F.split("value", "\r?\n"), lambda line: F.trim(line) != "")
    out = text.select("path", lines.alias("_l"))
    split = [separator]
    head = F.transform(F.split(F.col("_l")[0], split[0]), lambda c: F.trim(c))
    body = F.slice("_l", 2, F.greatest(F.size("_l") - 1, F.lit(0))) if header else F.col("_l")
    out = out.select("path", head.alias("_h"), F.transform(body, lambda line: F.split(line, split[0])).alias("_b"))
    picks = []
    for c in channels:
        index = F.lit(c) if isinstance(c, int) else (F.array_position("_h", F.lit(c)) - 1).cast("int")
        name = (F.get("_h", F.lit(c)) if header else F.lit(str(c))) if isinstance(c, int) else F.lit(c)
        picks.append(F.struct(name.alias("channel"), index.alias("i")))
    out = out.select("path", "_b", F.explode(F.array(*picks)).alias("_c")).where("_c.i >= 0")
    return out.select(
        "path", F.col("_c.channel").alias("channel"),
        F.transform("_b", lambda row: F.get(row, F.col("_c.i")).try_cast("float")).alias("x"),
    )


def numbered_splits(spark: SparkSession, path: str) -> DataFrame:
    """``(path, line, value)``: the lines of text files that are not blank, numbered from 0 in every file.

    A large file is many splits, each read by its own task: lines are counted per split first, and a split's lines go on
    from the sum of those before it. Text is read twice, no file is ever one row or one task.
    """
    lines = spark.read.option("recursiveFileLookup", True).text(path).select(
        F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_at"), "value"
    ).where(F.trim("value") != "")
    # rows of a split follow each other inside a partition, so their running number less the split's first is a place
    run = lines.withColumn("_run", F.monotonically_increasing_id())
    splits = run.groupBy("_file", "_at").agg(F.count(F.lit(1)).alias("_n"), F.min("_run").alias("_first"))
    before = W.partitionBy("_file").orderBy("_at").rowsBetween(W.unboundedPreceding, -1)  # a row for each split
    placed = settle(splits.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n"))
    joined = run.join(placed, ["_file", "_at"])
    return joined.select(local_path(F.col("_file")).alias("path"), (F.col("_run") - F.col("_first") + F.col("_before")).alias("line"), "value")


def csv_channels(
    spark: SparkSession, path: str, wanted: DataFrame, header: bool = True, separator: str = ",", rate: int | None = None
) -> DataFrame:
    """``(path, ch, sr, pos, value)`` and the other columns of ``wanted``: one row per sample of every wanted channel.

    ``wanted`` is the metadata: a row per channel with ``path``, ``ch`` (a column's name, or its place from 0 as text)
    and, if it has one, ``sr``; without, all have ``rate``. A name that is digits only counts as a place unless the
    header has it. Files are split, so a long one is read by many tasks; ``operators.blocks.blocks_of_samples`` folds
    the rows into blocks. Fields that are no number are null; a channel that a file doesn't have is an error.
    """
    lines = numbered_splits(spark, path)
    facts = wanted.withColumn("ch", F.col("ch").cast("string"))
    facts = facts if "sr" in facts.columns else facts.withColumn("sr", F.lit(rate).cast("int"))
    cells = F.split("value", separator)
    place = F.expr("try_cast(ch as int)")
    if header:
        heads = lines.where("line = 0").select("path", F.transform(cells, lambda c: F.trim(c)).alias("_h"))  # one a file
        facts = facts.join(heads, "path")
        at = F.array_position("_h", F.col("ch")).cast("int")
        unknown = F.raise_error(F.concat(F.lit("no channel "), F.coalesce(F.col("ch"), F.lit("NULL")), F.lit(" in "), F.col("path")))
        place = F.when(at > 0, at - 1).when(place < F.size("_h"), place).otherwise(unknown)
    facts = facts.withColumn("_i", place).drop("_h")
    body = lines.where("line > 0").withColumn("line", F.col("line") - 1) if header else lines
    joined = body.join(facts, "path")
    return joined.select(*wanted.drop("ch", "sr").columns, "ch", "sr", F.col("line").alias("pos"), F.get(cells, F.col("_i")).try_cast("double").alias("value"))
