"""Strips held in a task against brute force: ties, hidden rows, several chunks and batches."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tonewheel.operators import knn, strips
from tonewheel.plans import diagnosis
from tonewheel.workloads import diagnosis as queries


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(strips, "SLAB_TEST", 5)
    monkeypatch.setattr(strips, "SLAB_TRAIN", 7)
    monkeypatch.setattr(strips, "FIRST", 2)
    monkeypatch.setattr(strips, "RANKED", 50)


def test_bits():
    draw = np.random.default_rng(0)
    for n in (1, 61, 62, 63, 190):
        flags = draw.integers(0, 2, (9, n))
        words = np.array([[int("".join(map(str, row[w: w + 62])), 2) for w in range(0, n, 62)] for row in flags.tolist()])
        assert (strips.unpacked(words, n) == flags.astype(bool)).all()


def test_packed_in_spark(spark):
    flags = [[int(i * k % 7 < 3) for k in range(130)] for i in range(5)]
    df = spark.createDataFrame([(f,) for f in flags], "f array<tinyint>")
    words = np.array([r.w for r in df.select(strips.packed(F.col("f"), 130).alias("w")).collect()])
    assert (strips.unpacked(words, 130) == np.array(flags, bool)).all()


def rows_of(n, seed):
    draw = np.random.default_rng(seed)
    x = draw.integers(-1, 2, (n, 3)).astype(float)  # many copies and ties
    x[(x == 0).all(1)] = 1.0
    return x, draw.integers(0, 2, (n, 70))


def brute(x, test, train, k, names):
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    d = np.round(np.clip(1 - unit @ unit.T, 0, 2), 9)
    return {(i, r + 1): names[j] for i in np.flatnonzero(test) for r, j in enumerate(
        sorted(np.flatnonzero(train), key=lambda j: (d[i, j], names[j]))[:k])}


@pytest.mark.parametrize("chunk", [1 << 22, 40])
def test_runs(spark, small, monkeypatch, chunk):
    monkeypatch.setattr(knn, "CHUNK_ROWS", chunk)
    x, flags = rows_of(130, 3)
    flags[:, 5] = 1  # a run without train rows
    flags[:, 6] = 0  # and one without test rows
    flags[3:, 7] = 1  # three train rows only
    names = [f"f{i:03d}" for i in range(130)]
    df = spark.createDataFrame([(names[i], int(i % 4), x[i].tolist(), flags[i].tolist()) for i in range(130)],
                               "file string, cls int, emb array<double>, m array<tinyint>").repartition(5)
    hits = knn.knn_runs(df, "m", 70, 4, carry=["cls"], block_rows=20, train_carry=["cls"]).collect()
    got = {}
    for r in hits:
        assert r.ncls == int(r.neighbour[1:]) % 4 and r.cls == int(r.file[1:]) % 4
        got.setdefault(r.run, {})[int(r.file[1:]), r.rank] = r.neighbour
    for run in range(70):
        assert got.get(run, {}) == brute(x, flags[:, run] == 1, flags[:, run] == 0, 4, names), run


def test_null_groups_and_mixed_sizes(spark, small, monkeypatch):
    monkeypatch.setattr(knn, "CHUNK_ROWS", 25)
    x, _ = rows_of(160, 4)
    group = [None if i % 2 else ("big" if i % 4 else "tiny" if i % 8 else "none") for i in range(160)]
    side = ["test" if i % 3 == 0 else "train" for i in range(160)]
    df = spark.createDataFrame([(i, group[i], x[i].tolist(), side[i]) for i in range(160)], "file long, g string, emb array<double>, s string")
    test, train = df.where("s = 'test'"), df.where("s = 'train'")
    want = {}
    for g in set(group):
        inside = np.array([h == g for h in group])
        want |= brute(x, inside & (np.array(side) == "test"), inside & (np.array(side) == "train"), 3, list(range(160)))
    for block in (8192, 30, 4):
        hits = knn.knn_join(test, train, ["g"], 3, block_rows=block).collect()
        cut = [r for r in hits if r.g is not None] if block == 8192 else hits
        assert len({(r.file, r["rank"]) for r in hits}) == len(hits)
        assert all(want[r.file, r["rank"]] == r.neighbour for r in cut)
        if block != 8192:
            assert len(hits) == len(want)


def test_hits_leave_once_whatever_the_blocks(spark, monkeypatch):
    """A strip hands on k rows per test row and run; smaller blocks only make more strips."""
    x, flags = rows_of(400, 5)
    df = spark.createDataFrame([(i, x[i].tolist(), flags[i][:3].tolist()) for i in range(400)], "file long, emb array<double>, m array<tinyint>")
    want = int(flags[:, :3].sum()) * 2
    for block in (8192, 32):
        plan = knn.knn_runs(df, "m", 3, 2, block_rows=block)
        assert plan.count() == want
        assert "row_number" not in plan._jdf.queryExecution().toString()


def test_grid_with_small_blocks(spark):
    """The ratio grid's predictions are the same in strips of 32 rows."""
    sf = "/root/testdata/sf0.001"
    vectors = queries.segments(spark, sf)
    from tonewheel.operators.splits import sealed_splits

    splits = sealed_splits(vectors, "ori", None, (0.3, 0.7), 3, 111)
    a, b = ({tuple(r) for r in diagnosis.run_predictions(vectors, splits, "ori", 5, 10, block_rows=n).collect()} for n in (8192, 32))
    assert a == b and len(a) > 50


def test_a_pool_serves_all_splits():
    """What is held of a row are the candidates that some split needs, not ``k`` places for each split."""
    import pyarrow as pa

    draw = np.random.default_rng(6)
    x, flags = draw.normal(size=(600, 4)), draw.random((600, 180)) < 0.5
    words = np.stack([(flags[:, w: w + 62].astype(np.int64) << np.arange(flags[:, w: w + 62].shape[1] - 1, -1, -1)).sum(1) for w in range(0, 180, 62)], 1)
    table = pa.table({"_id": np.arange(600), "_vec": pa.array(x.tolist()), "_bits": pa.array(words.tolist(), pa.list_(pa.int64()))})
    schema = pa.schema([("_id", pa.int64()), ("run", pa.int32()), ("rank", pa.int32()), ("dist", pa.float64()), ("neighbour", pa.int64())])
    strip = strips.Strip(table.slice(0, 50), 5, "euclidean", 180, ["_id"], [], schema)
    for batch in table.combine_chunks().to_batches(max_chunksize=100):
        strip.feed(batch)
    got = pa.Table.from_batches(list(strip.hits())).to_pylist()
    assert sum(len(p.ref) for p in strip.pools) < 50 * 180 * 5 / 20
    d = np.round(np.linalg.norm(x[:50, None] - x[None], axis=2), 9)
    want = {(i, run, r + 1, int(j)) for run in range(180) for i in np.flatnonzero(flags[:50, run])
            for r, j in enumerate(np.flatnonzero(~flags[:, run])[np.argsort(d[i][~flags[:, run]], kind="stable")][:5])}
    assert {(r["_id"], r["run"], r["rank"], r["neighbour"]) for r in got} == want


@pytest.mark.parametrize(("metric", "times"), [("cosine", 1.3), ("euclidean", 2.3)])
def test_memory_of_a_product(metric, times):
    """Distances are worked out in place, and a strip keeps its vectors once."""
    import tracemalloc

    import pyarrow as pa

    x = np.random.default_rng(7).normal(size=(512, 8))
    tracemalloc.start()
    d = knn.distances(x, x, metric)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < times * d.nbytes
    table = pa.table({"_id": np.arange(512), "_vec": pa.array(x.tolist())})
    assert strips.Strip(table, 3, metric, 0, ["_id"], [], pa.schema([])).held.column_names == ["_id"]
