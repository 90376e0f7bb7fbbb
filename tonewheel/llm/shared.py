"""Small helpers of the operators on documents."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Callable, Hashable, Iterator
from types import ModuleType

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonewheel.functions.arrays import let

#: A table of keys up to this many rows (8 bytes each) may be broadcast; it is counted first.
BROADCAST_KEYS = 2_000_000


def kept(key: Hashable, make: Callable[[], object]):
    """An object that a Python worker makes once: functions come anew with every task, loaded modules stay."""
    store = vars(sys.modules.setdefault("tonewheel_worker_store", ModuleType("tonewheel_worker_store")))
    if key not in store:
        store[key] = make()
    return store[key]


def release() -> None:
    """Hands a worker's unused memory back: workers live on after a task, and several share an executor's memory."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def frugal(run: Callable, rows: int = 1000) -> Callable:
    """A function on batches that gets at most ``rows`` rows at a time and leaves no unused memory behind."""
    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        try:
            yield from run(b.slice(at, rows) for b in batches for at in range(0, b.num_rows, rows))
        finally:
            release()

    return inner


def maybe_broadcast(keys: DataFrame) -> DataFrame:
    """Marked for broadcast if it is counted to be small, else left to a shuffled join."""
    return F.broadcast(keys) if keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS else keys


def running_ends(lengths: Column) -> Column:
    """Running sums of an int array by blocks of 256, so that long arrays don't cost their square."""
    def ends(x: Column) -> Column:
        blocks = F.transform(
            F.sequence(F.lit(0), F.greatest(F.ceil(F.size(x) / 256).cast("int") - 1, F.lit(0))),
            lambda b: F.aggregate(F.slice(x, b * 256 + 1, 256), F.lit(0), lambda s, v: s + v),
        )
        return let(blocks, lambda bs: F.transform(x, lambda _, i: (
            F.aggregate(F.slice(bs, F.lit(1), F.floor(i / 256).cast("int")), F.lit(0), lambda s, v: s + v)
            + F.aggregate(F.slice(x, F.floor(i / 256).cast("int") * 256 + 1, i % 256 + 1), F.lit(0), lambda s, v: s + v)
        )))

    return let(lengths, ends)


def matches(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches as ``array<struct<s, e, m>>``: code points, end exclusive.

    The text between matches and the matches themselves come from two native passes; places are their running lengths.
    """
    def placed(parts: Column) -> Column:
        lengths = F.transform(parts["found"], lambda m, i: F.char_length(parts["gaps"][i]) + F.char_length(m))
        return let(running_ends(lengths), lambda ends: F.zip_with(
            parts["found"], ends, lambda m, e: F.struct((e - F.char_length(m)).alias("s"), e.alias("e"), m.alias("m"))
        ))

    return let(
        F.struct(
            F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("gaps")
        ),
        placed,
    )
