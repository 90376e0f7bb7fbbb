"""Spectral features, resampling and encoders over columns of equally long windows.

Spark partitions the windows; each Arrow batch is one numpy call. Rows pass through unchanged,
with the result added as an array column.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tonewheel.functions import spectral
from tonewheel.functions.chain import Chain, vectors
from tonewheel.operators.knn import matrix

# Moments a task keeps before it hands them on, in numbers (8 bytes each).
HELD_NUMBERS = 1 << 24

Kernel = Callable[[np.ndarray], np.ndarray]


def _lists(values: np.ndarray) -> pa.Array:
    """``[rows, n]`` as list<double>, or ``[rows, t, n]`` as list<list<double>>."""
    values = np.ascontiguousarray(values, dtype=np.float64)
    out = pa.array(values.reshape(-1))
    for axis in range(values.ndim - 1, 0, -1):
        rows = int(np.prod(values.shape[:axis]))
        out = pa.ListArray.from_arrays(pa.array(np.arange(rows + 1) * values.shape[axis], pa.int32()), out)
    return out


def _by_length(column: pa.ChunkedArray, kernel: Kernel) -> pa.Array:
    """Apply a kernel for equal lengths to rows of mixed lengths, one call per length."""
    lengths = np.asarray(column.combine_chunks().value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64)
    parts, where = [], []
    for n in np.unique(lengths):
        rows = np.nonzero(lengths == n)[0]
        parts.append(_lists(kernel(matrix(pa.chunked_array([column.combine_chunks().take(pa.array(rows))])))))
        where.append(rows)
    order = np.argsort(np.concatenate(where), kind="stable")
    return pa.concat_arrays(parts).take(pa.array(order))


def apply_kernel(df: DataFrame, column: str, out: str, kernel: Kernel, depth: int = 1) -> DataFrame:
    """Add ``out`` = kernel of ``column``; ``depth`` 2 for a matrix per row."""
    kind: T.DataType = T.DoubleType()
    for _ in range(depth):
        kind = T.ArrayType(kind)
    schema = T.StructType([*df.schema.fields, T.StructField(out, kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            table = pa.Table.from_batches([batch])
            yield from table.append_column(out, _by_length(table[column], kernel)).combine_chunks().to_batches()

    return df.mapInArrow(run, schema)


def with_stft(df: DataFrame, conf: spectral.StftConfig, column: str = "x", out: str = "spec") -> DataFrame:
    return apply_kernel(df, column, out, lambda x: spectral.stft(x, conf), depth=3 if conf.data_type == "complex" and conf.channels else 2)


def with_fbank(df: DataFrame, conf: spectral.FbankConfig, column: str = "x", out: str = "spec") -> DataFrame:
    return apply_kernel(df, column, out, lambda x: spectral.fbank(x, conf), depth=2)


def with_resampled(df: DataFrame, rate: int, target: int, column: str = "x", out: str = "x") -> DataFrame:
    """Band-limited resampling to ``target``; the rate column, if any, is the caller's to update."""
    if rate == target:
        return df
    source = df.withColumnRenamed(column, "_x")
    done = apply_kernel(source, "_x", out, lambda x: spectral.resample(x, rate, target))
    return done.drop("_x")


ENCODERS: dict[str, Kernel] = {"spectral_statistics": spectral.spectral_statistics, "frame_statistics": spectral.frame_statistics}


def register_encoder(name: str, kernel: Kernel) -> None:
    """Add an encoder: ``[windows, samples]`` in, ``[windows, dimensions]`` out."""
    ENCODERS[name] = kernel


def encode(df: DataFrame, encoder: str = "spectral_statistics", column: str = "x", out: str = "emb") -> DataFrame:
    if encoder not in ENCODERS:
        raise KeyError(f"unknown encoder {encoder!r}; known: {sorted(ENCODERS)}")
    return apply_kernel(df, column, out, ENCODERS[encoder])


def with_vectors(windows: DataFrame, chain: Chain, column: str = "x") -> DataFrame:
    """Raw windows of mixed lengths to vectors: every step of the chain in one pass, windows of a length as one matrix.

    Adds ``emb`` and ``valid`` (valid samples, or frames of the feature) and drops the samples. Empty windows are an
    error: plan windows with ``segments.split_empty``.
    """
    if chain.encoder not in ENCODERS:
        raise KeyError(f"unknown encoder {chain.encoder!r}; known: {sorted(ENCODERS)}")
    kernel, names = ENCODERS[chain.encoder], [c for c in windows.columns if c != column]
    schema = T.StructType([*[windows.schema[c] for c in names], T.StructField("emb", T.ArrayType(T.DoubleType())), T.StructField("valid", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(column)
            sizes = np.asarray(x.value_lengths().to_numpy(zero_copy_only=False), np.int64)
            for n in np.unique(sizes):
                rows = pa.array(np.flatnonzero(sizes == n))
                emb, valid = vectors(matrix(pa.chunked_array([x.take(rows)])), chain, kernel)
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c).take(rows) for c in names], _lists(emb), pa.array(np.full(len(rows), valid, np.int32))], [*names, "emb", "valid"])

    return windows.mapInArrow(run, schema)


def group_pca(df: DataFrame, train: DataFrame, key: str, components: int, vec: str = "emb") -> DataFrame:
    """Project vectors on the leading components of their group's train vectors.

    Train moments (count, sum, outer products) are folded per partition and added up per group and
    matrix row, so no task sees a whole group. Only the ``dim x dim`` moment matrix of a group meets
    in one place. Each component's largest entry is made positive.
    """
    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for g, m in held.items():
                rows = len(m)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([g] * rows, kind), pa.array(np.arange(rows, dtype=np.int32)), _lists(m)], [key, "row", "m"]
                )
            held.clear()

        for batch in batches:
            table = pa.Table.from_batches([batch])
            names = np.asarray(table[key].to_pylist(), dtype=object)
            x = matrix(table[vec])
            for g in set(names.tolist()):
                part = x[names == g]
                full = np.column_stack([np.ones(len(part)), part])
                held[g] = held.get(g, 0.0) + full.T @ full
                if len(held) * full.shape[1] ** 2 > HELD_NUMBERS:
                    yield from flush()
        yield from flush()

    field = train.schema[key]
    kind = train.select(key).limit(0).toArrow().schema.field(key).type
    partial = train.select(key, vec).mapInArrow(
        moments, T.StructType([field, T.StructField("row", T.IntegerType()), T.StructField("m", T.ArrayType(T.DoubleType()))])
    )
    summed = (
        partial.select(key, "row", F.posexplode("m").alias("col", "v"))
        .groupBy(key, "row", "col")
        .agg(F.sum("v").alias("v"))
    )

    def axes(table: pa.Table) -> pa.Table:
        n = int(np.sqrt(table.num_rows))
        m = np.zeros((n, n))
        m[table["row"].to_numpy(), table["col"].to_numpy()] = table["v"].to_numpy()
        mean = m[0, 1:] / m[0, 0]
        spread = m[1:, 1:] - m[0, 0] * np.outer(mean, mean)
        _, vectors = np.linalg.eigh(spread)
        lead = vectors[:, ::-1][:, :components].T
        lead = lead * np.where(lead[np.arange(len(lead)), np.abs(lead).argmax(1)] < 0, -1.0, 1.0)[:, None]
        return pa.table(
            {key: table[key].slice(0, 1), "_mean": _lists(mean[None]), "_axes": _lists(lead[None])}
        )

    fitted = summed.groupBy(key).applyInArrow(
        axes,
        T.StructType(
            [field, T.StructField("_mean", T.ArrayType(T.DoubleType())), T.StructField("_axes", T.ArrayType(T.ArrayType(T.DoubleType())))]
        ),
    )
    moved = F.zip_with(F.col(vec), F.col("_mean"), lambda v, m: v.cast("double") - m)
    dots = F.transform(
        F.col("_axes"),
        lambda a: F.aggregate(F.zip_with(a, F.col("_moved"), lambda u, v: u * v), F.lit(0.0), lambda s, v: s + v),
    )
    out = df.join(fitted, key).withColumn("_moved", moved).withColumn(vec, dots)
    return out.drop("_mean", "_axes", "_moved")
