import numpy as np

from tonewheel.llm import vector_graph
from tonewheel.llm.vector_graph import audit, near_links


def brute(rows):
    ok = [(i, np.array(v, dtype=float), lab) for i, v, lab, *_ in rows
          if lab is not None and v is not None and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    links = {i: set() for i, *_ in rows}
    for lab in {o[2] for o in ok}:
        ids = [o[0] for o in ok if o[2] == lab]
        x = np.array([o[1] / np.linalg.norm(o[1]) for o in ok if o[2] == lab])
        for a, b in zip(*np.nonzero(x @ x.T >= 0.98), strict=True):
            if a != b:
                links[ids[a]].add(ids[b])
    out = {}
    for i in links:
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        out[i] = (len(links[i]), min(seen), i == min(seen))
    return out


def test_links_and_components(spark):
    draw = np.random.default_rng(5)
    base = draw.normal(size=(30, 16))
    rows = [(k, [float(c) for c in base[k % 30] + draw.normal(size=16) * 0.05 * (k % 3)], k % 2, "x") for k in range(600)]
    rows += [(600, rows[0][1], 0, "x"), (601, None, 0, "x"), (602, [0.0] * 16, 0, "x"), (603, [float("nan")] * 16, 1, "x"), (604, rows[0][1], None, "x"), (605, [1.0, None] * 8, 0, "x")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, own string")
    got = near_links(table)
    rows32 = [(i, None if v is None else [None if c is None else float(np.float32(c)) for c in v], lab) for i, v, lab, _ in rows]
    assert {r[0]: tuple(r)[1:] for r in got.collect()} == brute(rows32)
    assert near_links(table.limit(0)).collect() == []


def test_recall_on_the_benchmark_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = near_links(table)
    want = brute([tuple(r) for r in table.collect()])
    found = {r[0]: tuple(r)[1:] for r in got.collect()}
    assert set(found) == set(want)
    assert all(found[i][0] <= want[i][0] for i in want)
    assert sum(found[i][0] for i in want) >= 0.99 * sum(w[0] for w in want.values())
    assert audit(table, got) >= 0.99


def test_many_groups_of_near_copies(spark):
    """Groups larger than a neighbour list has candidates, several to a shard, one larger than a shard, and chains."""
    draw = np.random.default_rng(11)
    rows = []
    for size in [120] * 8 + [1_300, 400]:
        middle = draw.normal(size=64)
        rows += [[float(c) for c in middle + draw.normal(size=64) * (0.05 if size != 400 else 0.11)] for _ in range(size)]
    a, b = draw.normal(size=(2, 64))
    rows += [[float(c) for c in np.cos(t) * a + np.sin(t) * b] for t in np.linspace(0, 1.4, 150)]
    rows = [(k, v, 0) for k, v in enumerate(rows)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    want = brute([(i, [float(np.float32(c)) for c in v], lab) for i, v, lab in rows])
    assert sum(w[0] for w in want.values()) > 500_000
    assert {r[0]: tuple(r)[1:] for r in near_links(table).collect()} == want


def test_only_possible_links_are_searched_for():
    """Far vectors cost no search of the graph; each near pair does, wherever it lies."""
    draw = np.random.default_rng(3)
    x = draw.normal(size=(400, 32))
    x[300:310] = x[:10] + draw.normal(size=(10, 32)) * 0.02
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    met = vector_graph.may_meet(x, x, np.arange(400), 0.98)
    assert set(np.flatnonzero(met)) >= {*range(10), *range(300, 310)} and met.sum() < 40
    assert vector_graph.may_meet(x, x[:5], np.full(5, -1), 0.98).all()
    centres = x[:60]
    near = x @ centres.T
    beyond = vector_graph.farthest_planes(near, np.argsort(-near, axis=1), centres @ centres.T)
    home, angle = near.argmax(axis=1), np.arccos(np.clip(x @ x.T, -1, 1))
    assert (np.arcsin(np.clip(beyond, -1, 1))[:, home] <= angle + 1e-7).all() and (beyond > 0).mean() > 0.5
