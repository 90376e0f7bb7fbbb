"""N-gram Jaccard join: size-banded tiles with bitmap signatures, then exact intersection of sorted arrays.

Two texts link when ``100 * |A & B| >= percent * |A | B|`` for their sets of word shingles. Every link lies in a tile
that both texts are in, because two such sets share two of the first ``n - ceil(t * n) + 2`` shingles of any common
order (for ``t`` up to a half: one of one less). The order used takes very frequent shingles last, by counts over all texts, so a passage that a third of all
texts carries makes no tile.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tonewheel.llm.graphs import components
from tonewheel.llm.prints import text_shingles
from tonewheel.llm.shared import frugal, maybe_broadcast
from tonewheel.session import settle

#: A bitmap has at least two bits a shingle, within these bounds, and always a power of two.
LEAST_BITS, MOST_BITS = 512, 1 << 16
TILE_ROWS = 256
#: Texts of a key up to which its pairs of like size are listed before their bitmaps are fetched.
FEW_ROWS = 32
HELD_HASHES = 1 << 18
#: Per cent by which two texts of a family may lie below the similarity asked for.
LOOSER = 15
#: Buckets of the sketch that tells frequent shingles, whatever the number of rows; and how far above a task's own mean
#: a bucket must lie to be told of, so that a task tells of few.
BUCKETS, TOLD = 1 << 18, 3
#: Pairs whose sets are unpacked at a time.
PAIR_ROWS = 512


def text_sets(texts: pa.Array, size: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    return map(np.unique, text_shingles(texts, size))


def bitmap(hashes: np.ndarray) -> bytes:
    bits = LEAST_BITS
    while bits < min(2 * len(hashes), MOST_BITS):
        bits *= 2
    marks = np.zeros(bits, dtype=bool)
    marks[(hashes & np.uint64(bits - 1)).astype(np.int64)] = True
    return np.packbits(marks).tobytes()


def halved(signature: bytes) -> bytes:
    """A bitmap of half the size: still a bound, and enough where most pairs are far apart."""
    bits = np.frombuffer(signature, dtype=np.uint64)
    return (bits[: len(bits) // 2] | bits[len(bits) // 2:]).tobytes() if len(bits) > LEAST_BITS // 64 else signature


def _folded(signatures: list[bytes], bits: int) -> np.ndarray:
    """One row of 64-bit words each; longer bitmaps are folded, as halves stand for the same hashes with a bit less."""
    out = np.zeros((len(signatures), bits // 64), dtype=np.uint64)
    for k, s in enumerate(signatures):
        out[k] = np.bitwise_or.reduce(np.frombuffer(s, dtype=np.uint64).reshape(-1, bits // 64), axis=0)
    return out


def class_digest(hashes: np.ndarray) -> bytes:
    return hashlib.blake2b(hashes, digest_size=16).digest()


def overlap_needed(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Least intersection of sets of these sizes that still link: ``100 i >= p (a + b - i)``."""
    return -(-percent * (a + b) // (100 + percent))


def shared_keys(percent: int) -> int:
    """Keys that unlike sets share if they link. With one shingle in common they are half alike at most; few share two by chance."""
    return 2 if percent > 50 else 1


def prefix_length(n: int, percent: int) -> int:
    return min(n, n - -(-percent * n // 100) + shared_keys(percent))


def _bucket_counts(held: list[np.ndarray], buckets: int) -> np.ndarray:
    every = np.concatenate([np.zeros(0, dtype=np.uint64), *held])
    return np.bincount((every % np.uint64(buckets)).astype(np.int64), minlength=buckets)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _sketched(rows: DataFrame, size: int, buckets: int) -> DataFrame:
    """Per row: set size, class digest, bitmap. One more row a task: how often its shingles fall into each bucket."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, dtype=np.int64)
        schema = pa.schema([
            ("doc_id", pa.int64()), ("text_key", pa.string()), ("n", pa.int64()), ("cls", pa.binary()), ("short", pa.int64()),
            ("bits", pa.binary()), ("half", pa.binary()), ("bucket", pa.list_(pa.int32())), ("times", pa.list_(pa.int64())),
        ])
        for batch in batches:
            ns, classes, shorts, bits, held = [], [], [], [], []
            for hashes in text_sets(batch.column(1), size):
                digest = class_digest(hashes)
                held.append(hashes)
                ns.append(len(hashes))
                classes.append(digest if len(hashes) else None)
                shorts.append(int.from_bytes(digest[:8], "little", signed=True) if len(hashes) else None)
                bits.append(bitmap(hashes) if len(hashes) else None)
                if sum(map(len, held)) > HELD_HASHES:
                    counts += _bucket_counts(held, buckets)
                    held = []
            counts += _bucket_counts(held, buckets)
            blank = pa.nulls(len(ns))
            halves = [b and halved(b) for b in bits]
            columns = [batch.column(0), batch.column(2), ns, classes, shorts, bits, halves, blank, blank]
            yield pa.record_batch([
                pa.array(c, type=f.type) if isinstance(c, list) else c.cast(f.type) for c, f in zip(columns, schema, strict=True)
            ], schema=schema)
        used = np.flatnonzero(counts >= max(16, TOLD * counts.mean()))  # what is frequent here; the rest says little
        one = [[None]] * 7 + [[used.tolist()], [counts[used].tolist()]]
        yield pa.record_batch([pa.array(c, type=f.type) for c, f in zip(one, schema, strict=True)], schema=schema)

    return rows.mapInArrow(
        frugal(run), "doc_id long, text_key string, n long, cls binary, short long, bits binary, half binary, bucket array<int>, times array<long>"
    )


def _postings(rows: DataFrame, size: int, percent: int, levels: np.ndarray) -> DataFrame:
    """``key, short, n``: the first shingles of each set in the common order, once per class and batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done, keys, shorts, ns = set(), [], [], []
            for hashes in text_sets(batch.column(0), size):
                if not len(hashes):
                    continue
                short = class_digest(hashes)[:8]
                if short in done:
                    continue
                done.add(short)
                level = levels[(hashes % np.uint64(len(levels))).astype(np.int64)]
                ordered = hashes[np.argsort(level, kind="stable")] if level.any() else hashes
                first = ordered[: prefix_length(len(hashes), percent)]
                keys.append(_signed(first))
                shorts.append(np.full(len(first), int.from_bytes(short, "little", signed=True), dtype=np.int64))
                ns.append(np.full(len(first), len(hashes), dtype=np.int32))
            if keys:
                yield pa.record_batch([
                    pa.array(np.concatenate(keys)), pa.array(np.concatenate(shorts)), pa.array(np.concatenate(ns))
                ], names=["key", "short", "n"])

    return rows.mapInArrow(frugal(run), "key long, short long, n int")


def _shared(posted: DataFrame, percent: int) -> DataFrame:
    """``key, short, n, rows, lo, hi``: postings with another class of like size at their key, once per class.

    A key's classes in order of size are cut where one is too small to link with the next: nothing links across such a
    gap, so each part is a key of its own, and a class alone in its part has no row. ``rows`` counts the part's classes,
    ``lo`` and ``hi`` are those of least and greatest digest (``short``, ``n``). Postings are shuffled once, by key.
    """
    by_size = Window.partitionBy("key").orderBy("n", "short")
    before = posted.withColumn("last", F.lag("short").over(by_size)).withColumn("less", F.lag("n").over(by_size))
    once = before.filter("last is null or last <> short or less <> n")
    less, more = F.lag("n").over(by_size), F.lead("n").over(by_size)

    def alike(small, large):
        return F.coalesce(100 * small.cast("long") >= percent * large.cast("long"), F.lit(False))

    sided = once.select("key", "short", "n", alike(less, F.col("n")).alias("down"), alike(F.col("n"), more).alias("up")).filter("down or up")
    gaps = F.sum(F.when(F.col("down"), 0).otherwise(1)).over(by_size.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    part = Window.partitionBy("key", "part")
    entry = F.struct("short", "n")
    return sided.withColumn("part", gaps).select(
        F.xxhash64("key", "part").alias("key"), "short", "n", F.count(F.lit(1)).over(part).alias("rows"),
        F.min(entry).over(part).alias("lo"), F.max(entry).over(part).alias("hi"),
    )


def _levels(sketch: DataFrame, buckets: int, mean: float) -> np.ndarray:
    """Per bucket: 0, or how many doublings its count lies above four times the mean. One byte each, bounded."""
    counts = np.zeros(buckets, dtype=np.float64)
    total = sketch.select(F.explode(F.arrays_zip("bucket", "times")).alias("x")).select("x.*")
    for part in total.groupBy("bucket").agg(F.sum("times").alias("times")).toArrow().to_batches():
        counts[part.column(0).to_numpy()] = part.column(1).to_numpy()
    return np.maximum(np.floor(np.log2(np.maximum(counts, 1) / (4 * max(mean, 1)))) + 1, 0).astype(np.int8)


def _possible(pairs: DataFrame, nodes: DataFrame, percent: int, by: str = "short") -> DataFrame:
    """Pairs ``a, b`` of digests (or nodes) as pairs of nodes whose bitmaps leave room for the overlap they need."""
    def side(name: str) -> DataFrame:
        return nodes.select(F.col(by).alias(name), *[F.col(c).alias(f"{c}_{name}") for c in ("rep", "n", "bits")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(at, 4 * PAIR_ROWS) for whole in batches for at in range(0, whole.num_rows, 4 * PAIR_ROWS)):
            n = [batch.column(c).to_numpy() for c in (1, 4)]
            left = []
            for n_a, a, n_b, b in zip(n[0], batch.column(2).to_pylist(), n[1], batch.column(5).to_pylist(), strict=True):
                x, y = _folded([a, b], 8 * min(len(a), len(b)))
                left.append(room(n_a, x, n_b, y))
            ok = pa.array(np.array(left, dtype=np.int64) >= overlap_needed(n[0], n[1], percent))
            yield pa.record_batch([batch.column(0), batch.column(3)], names=["a", "b"]).filter(ok)

    both = pairs.join(side("a"), "a").join(side("b"), "b").filter("rep_a <> rep_b")
    return both.select("rep_a", "n_a", "bits_a", "rep_b", "n_b", "bits_b").mapInArrow(frugal(run), "a long, b long").distinct()


def room(n_a: np.ndarray, bits_a: np.ndarray, n_b: np.ndarray, bits_b: np.ndarray) -> np.ndarray:
    """No intersection is larger: every bit that only one side has stands for a shingle only that side has."""
    only_a = np.bitwise_count(bits_a & ~bits_b).sum(axis=-1, dtype=np.int64)
    only_b = np.bitwise_count(bits_b & ~bits_a).sum(axis=-1, dtype=np.int64)
    return np.minimum(n_a - only_a, n_b - only_b)


def _sets(docs: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """``rep, hashes`` of these nodes (``rep``, ``cls`` and ``doc``, a document that has the set): only they are hashed again."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.binary(), pa.binary())
        for whole in batches:
            for at in range(0, whole.num_rows, PAIR_ROWS):
                batch = whole.slice(at, PAIR_ROWS)
                found = [(i, class_digest(h), h.tobytes()) for i, h in zip(batch.column(0).to_pylist(), text_sets(batch.column(1), size), strict=True)]
                yield pa.record_batch([pa.array([f[k] for f in found], type=t) for k, t in enumerate(kinds)], names=["doc", "cls", "hashes"])

    held = docs.join(maybe_broadcast(nodes.select(F.col("doc").alias("_id")).distinct()), F.col("doc_id") == F.col("_id"), "left_semi")
    made = held.mapInArrow(frugal(run), "doc long, cls binary, hashes binary")
    # a document's id may come with several texts, and a text with an id several times
    return made.join(maybe_broadcast(nodes.select("rep", "doc", "cls")), ["doc", "cls"]).select("rep", "hashes").dropDuplicates(["rep"])


def _links(sets: list[np.ndarray], pairs: tuple[np.ndarray, np.ndarray], percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs (positions) that link, by exact intersection of sorted arrays.

    Where most of a cell has to be compared, one product of 0/1 matrices gives all intersections, a strip of hashes at a
    time; the counts are the same.
    """
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    x, y = pairs
    if len(x) > 2000:
        every, place = np.unique(np.concatenate(sets), return_inverse=True)
        owner = np.repeat(np.arange(len(sets)), sizes)
        both = np.zeros((len(sets), len(sets)), dtype=np.float32)
        order = np.argsort(place, kind="stable")
        place, owner = place[order], owner[order]
        for lo in range(0, len(every), 8192):
            a, b = np.searchsorted(place, (lo, lo + 8192))
            strip = np.zeros((len(sets), min(8192, len(every) - lo)), dtype=np.float32)
            strip[owner[a:b], place[a:b] - lo] = 1
            both += strip @ strip.T
        shared = both[x, y].astype(np.int64)
        linked = 100 * shared >= percent * (sizes[x] + sizes[y] - shared)
        x, y, known = x[linked], y[linked], True
    else:
        known = False
    parent = list(range(len(sets)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    out = []
    for i, j in zip(x.tolist(), y.tolist(), strict=True):
        a, b = root(i), root(j)
        if a != b:
            if not known:
                shared = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if 100 * shared < percent * (len(sets[i]) + len(sets[j]) - shared):
                    continue
            parent[a] = b
            out.append((i, j))
    return out


def _cells(rows: DataFrame, group: str, percent: int) -> DataFrame:
    """Rows (``group``, ``rep``, ``n``, ..) dealt to cells ``b1, t1, b2, t2``: two tiles of a group that are compared.

    A group is cut by size into bands (a link spans at most two neighbouring ones) and each band into tiles of about
    ``TILE_ROWS`` rows by a hash of the node; ``left`` says which of its cell's two tiles a row is of.
    """
    rows = rows.withColumn("band", F.floor(F.log("n") / F.log(F.lit(100 / percent)) + 1e-9).cast("int"))
    tiles = rows.groupBy(group, "band").agg(F.ceil(F.count("*") / TILE_ROWS).cast("int").alias("tiles"))
    above = tiles.select(group, (F.col("band") - 1).alias("band"), F.col("tiles").alias("above"))
    below = tiles.select(group, (F.col("band") + 1).alias("band"), F.col("tiles").alias("below"))
    laid = tiles.join(above, [group, "band"], "left").join(below, [group, "band"], "left").fillna(0)
    own, band = F.col("own"), F.col("band")

    def cell(lo_band, lo_tile, hi_band, hi_tile, left):
        return F.struct(lo_band.alias("b1"), lo_tile.alias("t1"), hi_band.alias("b2"), hi_tile.alias("t2"), left.alias("left"))

    def upto(n):
        return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))

    same = F.transform(upto(F.col("tiles")), lambda t: cell(band, F.least(t, own), band, F.greatest(t, own), own <= t))
    up = F.transform(upto(F.col("above")), lambda t: cell(band, own, band + 1, t, F.lit(True)))
    down = F.transform(upto(F.col("below")), lambda t: cell(band - 1, t, band, own, F.lit(False)))
    dealt = rows.join(laid, [group, "band"]).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("tiles")).cast("int"))
    return dealt.withColumn("cell", F.explode(F.concat(same, up, down))).select("*", "cell.*").drop(
        "cell", "own", "tiles", "above", "below", "band"
    )


def _open_pairs(n, signatures, left, one, percent, apart=None) -> tuple[np.ndarray, np.ndarray]:
    """Positions of a cell's pairs, each once, whose bitmaps leave room (and that ``apart`` tells apart)."""
    every = np.arange(len(n))
    rows, cols = (every, every) if one else (np.flatnonzero(left), np.flatnonzero(~left))
    x, y = [every[:0]], [every[:0]]
    if len(cols) and (apart is None or (apart != apart[0]).any()):
        bits = _folded(signatures, 8 * min(map(len, signatures)))
        for i in rows:
            others = cols[cols > i] if one else cols
            others = others[np.minimum(n[others], n[i]) >= overlap_needed(n[i], n[others], percent)]
            if apart is not None:
                others = others[apart[others] != apart[i]]
            if len(others):
                fits = others[room(n[i], bits[i], n[others], bits[others]) >= overlap_needed(n[i], n[others], percent)]
                x.append(np.full(len(fits), i))
                y.append(fits)
    return np.concatenate(x), np.concatenate(y)


def _family_links(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links within families, compared cell by cell; a cell hands on a spanning forest, never its pairs."""
    def run(table: pa.Table) -> pa.Table:
        rep = table.column("rep").to_numpy()
        sets = [np.frombuffer(h, dtype=np.uint64) for h in table.column("hashes").to_pylist()]
        n, left = table.column("n").to_numpy(), table.column("left").to_numpy()
        one = table.column("b1")[0] == table.column("b2")[0] and table.column("t1")[0] == table.column("t2")[0]
        out = _links(sets, _open_pairs(n, table.column("bits").to_pylist(), left, one, percent), percent)
        return pa.table({c: pa.array([rep[o[k]] for o in out], type=pa.int64()) for k, c in enumerate("ab")})

    # rows are dealt to cells before they get their bitmaps and sets
    cells = _cells(members.select("family", "rep", "n"), "family", percent).join(members.select("rep", "bits").join(sets, "rep"), "rep")
    return settle(cells.groupBy("family", "b1", "t1", "b2", "t2").applyInArrow(run, "a long, b long"))


def _cross_links(shared: DataFrame, nodes: DataFrame, families: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Links between texts of different families that share a key: pairs by bitmap from each key's cells, then exact."""
    def run(table: pa.Table) -> pa.Table:
        cell, rep, n, family, left, one = (
            table.column(c).to_numpy() for c in ("cell_id", "rep", "n", "family", "left", "one")
        )
        order = np.argsort(cell, kind="stable")
        bits = table.column("bits").to_pylist()
        out = []
        for at in np.split(order, np.flatnonzero(np.diff(cell[order])) + 1):
            if len(at) > 1:
                x, y = _open_pairs(n[at], [bits[k] for k in at], left[at], one[at[0]], percent, family[at])
                out.append((rep[at[x]], rep[at[y]]))
        a, b = (np.concatenate([o[k] for o in out]) if out else rep[:0] for k in (0, 1))
        found = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
        return pa.table({"a": found[0], "b": found[1]})

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, PAIR_ROWS):
                batch = whole.slice(at, PAIR_ROWS)
                sides = [[np.frombuffer(h, dtype=np.uint64) for h in batch.column(c).to_pylist()] for c in (2, 3)]
                keep = [bool(_links([x, y], (np.array([0]), np.array([1])), percent)) for x, y in zip(*sides, strict=True)]
                yield pa.record_batch([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, type=pa.bool_()))

    placed = nodes.select("short", "rep").join(families, "rep", "left").select("short", "rep", F.coalesce("family", "rep").alias("family"))
    by_key = Window.partitionBy("key")
    opened = settle(
        shared.join(placed, "short").select("key", "rep", F.col("n").cast("long").alias("n"), "family", "rows")
        .withColumn("lo", F.min("family").over(by_key)).withColumn("hi", F.max("family").over(by_key))
        .filter("lo < hi").drop("lo", "hi")
    )
    # texts that link share two keys: a large one, whose cells compare all, or two of those whose pairs are listed
    few, many = opened.filter(F.col("rows") <= FEW_ROWS).drop("rows"), opened.filter(F.col("rows") > FEW_ROWS).drop("rows")
    other = few.select("key", F.col("rep").alias("b"), F.col("n").alias("m"), F.col("family").alias("f"))
    small = (
        few.withColumnRenamed("rep", "a").join(other, "key")
        .filter("a < b and family <> f").filter((100 * F.least("n", "m") >= percent * F.greatest("n", "m")))
        .groupBy("a", "b").agg(F.count(F.lit(1)).alias("times")).filter(F.col("times") >= shared_keys(percent)).select("a", "b")
    )
    cells = _cells(many, "key", percent).join(nodes.select("rep", F.col("half").alias("bits")), "rep")
    cells = cells.select(
        F.xxhash64("key", "b1", "t1", "b2", "t2").alias("cell_id"), "rep", "n", "bits", "family", "left",
        F.expr("b1 = b2 and t1 = t2").alias("one"),
    )
    # many small cells to a task's call; a cell itself is bounded, and rows are counted as often as they are dealt
    groups = 1 + _cells(many, "key", percent).count() // TILE_ROWS
    dealt = cells.withColumn("deal", F.pmod(F.xxhash64("cell_id"), F.lit(groups)))
    large = dealt.groupBy("deal").applyInArrow(run, "a long, b long")
    pairs = settle(_possible(small.union(large).distinct(), nodes, percent, "rep"))
    ids = pairs.select(F.col("a").alias("rep")).union(pairs.select("b")).distinct()
    sets = settle(_sets(docs, nodes.join(ids, "rep", "left_semi").select("rep", "doc", "cls"), size))
    a, b = (sets.select(F.col("rep").alias(s), F.col("hashes").alias(f"set_{s}")) for s in "ab")
    return settle(pairs.join(a, "a").join(b, "b").select("a", "b", "set_a", "set_b").mapInArrow(frugal(exact), "a long, b long"))


def _classified(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """``doc_id, text_key, n, node, component, component_id, n_same`` of every row; ``text_key`` is its text's md5.

    A node is a set of shingles, whatever the ids of the rows that have it; ``component`` is one of the nodes that links
    reach and ``component_id`` the least doc_id among all of them. Rows without a set or without a doc_id have no node.
    """
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.md5(F.coalesce(text, F.lit(""))).alias("text_key"))
    first = settle(_sketched(rows, size, BUCKETS))
    every = first.agg(F.sum("n")).first()[0] or 0
    levels = _levels(first.filter("bucket is not null"), BUCKETS, every / BUCKETS)
    kept = first.filter("bucket is null").select("doc_id", "text_key", "n", "cls", "short", "bits", "half")
    nodes = settle(
        kept.filter("n > 0 and doc_id is not null").groupBy("cls", "short", "n", "bits", "half")
        .agg(F.min("doc_id").alias("doc"), F.count("*").alias("n_same")).withColumn("rep", F.monotonically_increasing_id())
    )
    rows = rows.select("doc_id", "text")
    posted = _postings(rows.filter("doc_id is not null").select("text"), size, percent, levels)
    shared = settle(_shared(posted, percent))
    # a key lists each of its pairs with the least or the greatest digest once
    stars = (
        shared.filter(F.col("short") != F.col("hi.short")).select("short", "n", F.explode(F.array("hi", "lo")).alias("o"))
        .filter(F.col("short") != F.col("o.short"))
        .filter(100 * F.least("n", "o.n").cast("long") >= (percent - LOOSER) * F.greatest("n", "o.n").cast("long"))
        .groupBy(F.least("short", "o.short").alias("a"), F.greatest("short", "o.short").alias("b")).agg(F.count(F.lit(1)).alias("times"))
        .filter(F.col("times") >= shared_keys(percent)).select("a", "b")
    )
    families = components(_possible(stars, nodes, percent - LOOSER), "a", "b").toDF("rep", "family")
    members = nodes.join(families, "rep").select("rep", "doc", "cls", "n", "bits", "family")
    inner = _family_links(members, _sets(rows, members, size), percent)
    outer = _cross_links(shared.select("key", "short", "n", "rows"), nodes, families, rows, size, percent)
    comps = components(inner.union(outer), "a", "b").select(F.col("node").alias("rep"), "component")
    grouped = settle(nodes.select("cls", "rep", "doc", "n_same").join(comps, "rep", "left").withColumn("component", F.coalesce("component", "rep")))
    least = grouped.groupBy("component").agg(F.min("doc").alias("component_id"))
    placed = grouped.join(least, "component").select("cls", F.col("rep").alias("node"), "component", "component_id", "n_same")
    known = F.col("doc_id").isNotNull()
    return kept.drop("bits", "half").join(placed, "cls", "left").select("doc_id", "text_key", "n", *[
        F.when(known, F.col(c)).alias(c) for c in ("node", "component", "component_id", "n_same")])


def jaccard_components(docs: DataFrame, size: int = 4, percent: int = 85) -> DataFrame:
    """One row per row of ``docs`` (``doc_id``, ``text``; other columns are not read): set size and component.

    ``doc_id, n_shingles, component_id, n_same``: component_id is the least doc_id that links reach, n_same the number
    of rows with the same set. Null and blank texts have an empty set, link with nothing and are their own component.
    Rows with a null doc_id link with nothing and have no component. Repeated rows come back as often as they come in;
    rows of one doc_id with unlike texts are told apart by their sets; an empty table gives no rows.

    Equal sets are one node from the start. Nodes that share two keys with a key's least or greatest node are compared
    with it by bitmap; those that may be alike form families, which a group of many copies enters by about as many pairs as
    it has members. Families are compared cell by cell inside tasks. What shares a key across families is compared by
    bitmap and then exactly. So no group is ever written out as pairs, and no link between components is lost.
    """
    found = _classified(docs, size, percent)
    return found.select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"),
        F.coalesce("n_same", F.lit(1).cast("long")).alias("n_same"),
    )


def one_of_each(docs: DataFrame, size: int = 4, percent: int = 85) -> DataFrame:
    """``docs`` with one row of each component: its least doc_id's, whole. Rows without doc_id or words stay.

    Rows are told apart by doc_id and text, so unlike texts of one doc_id are judged each by its own links. Of several
    texts of the least doc_id in a component the one with the least md5 stays; of rows equal in both, the one with the
    least columns.
    """
    found = settle(_classified(docs, size, percent).filter("node is not null").select("doc_id", "text_key", "component"))
    kept = found.groupBy("component").agg(F.min(F.struct("doc_id", "text_key")).alias("kept"))
    told = found.join(kept, "component").withColumn("stays", F.struct("doc_id", "text_key") == F.col("kept"))
    name = "_text_key"
    while name in docs.columns:
        name += "_"
    keyed = docs.withColumn(name, F.md5(F.coalesce(F.col("text").cast("string"), F.lit(""))))

    same = (F.col("doc_id").cast("long") == F.col("_id")) & (F.col(name) == F.col("_key"))

    gone = told.filter("not stays").select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).distinct()
    left = keyed.join(maybe_broadcast(gone), same, "left_anti")
    twice = settle(
        told.filter("stays").groupBy("doc_id", "text_key").count().filter("count > 1")
        .select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"))
    )
    if twice.isEmpty():
        return left.drop(name)
    again = left.join(twice, same, "left_semi")
    rank = F.row_number().over(Window.partitionBy("doc_id", name).orderBy(*docs.columns))
    place = f"{name}rank"
    first = again.withColumn(place, rank).filter(F.col(place) == 1).drop(place)
    return left.join(twice, same, "left_anti").unionByName(first).drop(name)
