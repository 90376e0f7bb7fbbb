"""Random splits that hold when a task is retried, without shuffling the split table.

A recording goes to the test side if the md5 of ``seed|recording`` is among the
``ceil(test_size * n)`` smallest of its run. Only that limit is searched: recordings are counted per hash prefix, the
prefix that crosses the limit is counted again by longer prefixes until few recordings share it, and these few hashes
decide. With the limit known, each segment row decides on its own, so segments of one recording can never part and a
hot recording costs nothing.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tonewheel.session import settle

PREFIX = 2
SEED_STEP = 100
#: Hashes that are fetched for one cut, seeds tried for a split in one pass, and in all where counts can't decide.
FETCHED, MOST_SEEDS, MANY_TRIES = 1024, 16, 10_000


@dataclass(frozen=True)
class Split:
    run: int
    test_size: float
    seed: int
    limit: str


def unit_hash(seed: Column | int, unit: str) -> Column:
    seed = F.lit(seed) if isinstance(seed, int) else seed
    return F.md5(F.concat_ws("|", seed.cast("string"), F.col(unit).cast("string")))


def _hashed(units: DataFrame, unit: str, seeds: Sequence[int], carry: Sequence[str] = ()) -> DataFrame:
    """``(seed, h, p, carry)``: every unit hashed once per seed, with the hash prefix it is counted by."""
    # recordings are few and thin, their hashes are not: spread them before they are repeated per seed
    parts = int(units.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    seeded = units.repartition(parts, unit).select(F.explode(F.array(*[F.lit(s) for s in sorted(set(seeds))])).alias("seed"), unit, *carry)
    hashed = seeded.select("seed", unit_hash(F.col("seed"), unit).alias("h"), *carry)
    return hashed.withColumn("p", F.substring("h", 1, PREFIX))


def _number(h: Column) -> Column:
    """The first 60 bits of a hash: sums and extremes of numbers need no sort, those of strings do."""
    return F.conv(F.substring(h, 1, 15), 16, 10).cast("long")


def _summary(hashed: DataFrame) -> DataFrame:
    """``(seed, kind, key, c, lo, hi)``: per hash prefix (kind 0) and per class (kind 1) the recordings and their extremes.

    One pass over the recordings; at most ``16 ** PREFIX`` prefixes and the classes are left of each seed. Extremes are
    numbers (``_number``).
    """
    keys = F.concat(
        F.array(F.struct(F.lit(0).alias("kind"), F.col("p").alias("key"))),
        F.transform("_labels", lambda c: F.struct(F.lit(1).alias("kind"), c.cast("string").alias("key"))),
    )
    each = hashed.select("seed", _number(F.col("h")).alias("v"), F.explode(keys).alias("_k"))
    return each.groupBy("seed", "_k.kind", "_k.key").agg(F.count(F.lit(1)).alias("c"), F.min("v").alias("lo"), F.max("v").alias("hi"))


def _next(counts: list[tuple], places: dict[tuple, int]) -> dict[tuple, tuple[int, int]]:
    """Where each wanted place lies one prefix further: ``(seed, t, key) -> (place inside, recordings)``.

    ``counts`` are ``(seed, prefix, key, recordings)``, at most ``16 ** PREFIX`` keys below a prefix; ``places`` are
    ``(seed, t, prefix) -> place``.
    """
    below: dict[tuple, list] = {}
    for seed, prefix, key, c in counts:
        below.setdefault((seed, prefix), []).append((key, c))
    out = {}
    for (seed, t, prefix), k in places.items():
        for key, c in sorted(below[seed, prefix]):
            if k <= c:
                out[seed, t, key] = (k, c)
                break
            k -= c
    return out


def _limits(hashed: DataFrame, summary: DataFrame, wanted: Sequence[tuple[int, int, float]]) -> dict[tuple[int, int, float], str]:
    """The hash at the cut, for every ``(run, seed, test_size)``.

    Rounds of histograms narrow the prefix that holds the cut until few recordings share it; only those few hashes are
    fetched, at most ``FETCHED`` for each seed and size. A round brings at most ``16 ** PREFIX`` counts for each.
    """
    spark, sizes = hashed.sparkSession, sorted({(s, t) for _, s, t in wanted})

    def listed(keys) -> DataFrame:
        return F.broadcast(spark.createDataFrame(sorted({(s, p) for s, _, p in keys}), "seed int, p string"))

    counts = [(r["seed"], "", r["key"], r["c"]) for r in summary.where("kind = 0").collect()]
    total: dict[int, int] = {}
    for seed, _, _, c in counts:
        total[seed] = total.get(seed, 0) + c
    places = {(s, t, ""): min(total.get(s, 0), ceil(t * total.get(s, 0) - 1e-9)) for s, t in sizes}
    places, size, found = {p: k for p, k in places.items() if k > 0}, 0, {}
    while places:
        size += PREFIX
        reached = _next(counts, places)
        few = {p: k for p, (k, c) in reached.items() if c <= FETCHED or size >= 32}
        places = {p: k for p, (k, _) in reached.items() if p not in few}
        for keys, fetch in ((few, True), (places, False)):
            if not keys:
                continue
            inside = hashed.select("seed", "h", F.substring("h", 1, size).alias("p")).join(listed(keys), ["seed", "p"])
            if fetch:
                hashes: dict[tuple, list[str]] = {}
                for r in inside.collect():
                    hashes.setdefault((r["seed"], r["p"]), []).append(r["h"])
                found |= {(s, t): sorted(hashes[s, p])[k - 1] for (s, t, p), k in keys.items()}
            else:
                deeper = inside.groupBy("seed", "p", F.substring("h", 1, size + PREFIX).alias("key")).agg(F.count(F.lit(1)).alias("c"))
                counts = [tuple(r) for r in deeper.collect()]
    return {(r, s, t): found.get((s, t), "") for r, s, t in wanted}


def assign(df: DataFrame, unit: str, splits: Sequence[Split]) -> DataFrame:
    """One row per (row, split): adds ``run``, ``test_size`` and ``side``. A seed is hashed once for all its splits."""
    by_seed: dict[int, list[Split]] = {}
    for s in splits:
        by_seed.setdefault(s.seed, []).append(s)
    rules = F.array(*[
        F.struct(
            F.lit(seed).alias("seed"),
            F.array(*[
                F.struct(F.lit(s.run).alias("run"), F.lit(s.test_size).alias("test_size"), F.lit(s.limit).alias("limit"))
                for s in group
            ]).alias("rules"),
        )
        for seed, group in by_seed.items()
    ])
    seeded = df.select("*", F.explode(rules).alias("_s"))
    # hashed before the rules are listed: what stands beside an explode is made for each of its rows
    hashed = seeded.select(*df.columns, F.col("_s.rules").alias("_rules"), unit_hash(F.col("_s.seed"), unit).alias("_h"))
    hashed = hashed.select(*df.columns, F.explode("_rules").alias("_r"), "_h")
    return hashed.select(
        *df.columns, "_r.run", "_r.test_size", F.when(F.col("_h") <= F.col("_r.limit"), "test").otherwise("train").alias("side")
    )


def side_sums(df: DataFrame, unit: str, splits: Sequence[Split], keys: Sequence[str], value: Column) -> DataFrame:
    """``(run, test_size, keys, train, test)``: sums of ``value`` on each side of each split, NULL where a side has no row.

    A row is hashed once per seed and placed between the limits of that seed; it is summed there, and only these sums are
    repeated per split. ``value`` is a long.
    """
    limits: dict[int, list[str]] = {}
    for s in splits:
        limits[s.seed] = sorted({*limits.get(s.seed, ()), s.limit})
    hashed = df.select(*keys, value.alias("_v"), *[unit_hash(seed, unit).alias(f"_h{i}") for i, seed in enumerate(limits)])
    places = [sum(((F.col(f"_h{i}") > F.lit(x)).cast("int") for x in known), F.lit(0)) for i, known in enumerate(limits.values())]
    placed = hashed.select(*keys, "_v", *[p.alias(f"_p{i}") for i, p in enumerate(places)])
    each = placed.select(*keys, "_v", F.explode(F.array(*[
        F.struct(F.lit(seed).alias("seed"), F.col(f"_p{i}").alias("place")) for i, seed in enumerate(limits)])).alias("_s"))
    sums = each.groupBy(F.col("_s.seed").alias("_seed"), F.col("_s.place").alias("_place"), *keys).agg(F.sum("_v").alias("_v"))
    rules = F.array(*[
        F.struct(F.lit(s.run).alias("run"), F.lit(s.test_size).alias("test_size"), F.lit(s.seed).alias("seed"),
                 F.lit(limits[s.seed].index(s.limit)).alias("place"))
        for s in splits
    ])
    ruled = sums.select("*", F.explode(F.filter(rules, lambda r: r["seed"] == F.col("_seed"))).alias("_r"))
    # a hash within a limit lies above none but the limits below that one
    test = F.col("_place") <= F.col("_r.place")
    return ruled.groupBy("_r.run", "_r.test_size", *keys).agg(F.sum(F.when(~test, F.col("_v"))).alias("train"), F.sum(F.when(test, F.col("_v"))).alias("test"))


def membership(df: DataFrame, unit: str, splits: Sequence[Split], name: str = "in_test") -> DataFrame:
    """One row per row: array of booleans, true where it is a test row of split i."""
    flags = [unit_hash(s.seed, unit) <= F.lit(s.limit) for s in splits]
    return df.withColumn(name, F.array(*[f.cast("tinyint") for f in flags]))


def coverage(df: DataFrame, unit: str, label: str, splits: Sequence[Split]) -> DataFrame:
    """Classes on each side of each split: ``(run, test_size, classes, train_classes, test_classes)``."""
    units = df.groupBy(unit).agg(F.collect_set(label).alias("_labels"))
    return _coverage(_summary(_hashed(units, unit, [s.seed for s in splits], ["_labels"])), splits).drop("lone", "marks")


def _coverage(summary: DataFrame, splits: Sequence[Split]) -> DataFrame:
    """A class is on the test side if its lowest hash is within the limit, on the train side if its
    highest is beyond it; one pair of extremes per (seed, class) serves every test size."""
    rules = F.array(*[
        F.struct(F.lit(s.run).alias("run"), F.lit(s.test_size).alias("test_size"), F.lit(s.seed).alias("seed"),
                 F.lit(int(s.limit[:15], 16) if s.limit else -1).cast("long").alias("limit"))
        for s in splits
    ])
    each = summary.where("kind = 1").select("*", F.explode(F.filter(rules, lambda r: r["seed"] == F.col("seed"))).alias("_r"))
    return each.groupBy("_r.run", "_r.test_size", "_r.seed").agg(
        F.count(F.lit(1)).alias("classes"),
        F.count(F.when(F.col("hi") > F.col("_r.limit"), F.col("key"))).alias("train_classes"),
        F.count(F.when(F.col("lo") <= F.col("_r.limit"), F.col("key"))).alias("test_classes"),
        F.count(F.when(F.col("c") < 2, F.col("key"))).alias("lone"),
        F.sum("c").alias("marks"),
    ).drop("seed")


def _must_fail(n: int, classes: int, lone: int, marks: int, test_sizes: Sequence[float]) -> tuple[list[str], bool]:
    """Reasons why no draw can have every class on both sides, and whether there being none means that some draw can.

    ``n`` recordings of ``classes``, ``lone`` of which one recording has; ``marks`` is classes over recordings.
    """
    sides = {t: min(n, ceil(t * n - 1e-9)) for t in test_sizes}
    reasons = [f"{lone} of {classes} classes have one recording only"] if lone else []
    reasons += [f"test size {t} leaves no recording on a side" for t, m in sides.items() if classes and (m < 1 or m >= n)]
    single = marks <= n  # one class to a recording: the sides must have room for each
    reasons += [f"test size {t} has {m} of {n} recordings for {classes} classes" for t, m in sides.items() if single and (m < classes or n - m < classes)]
    return reasons, single


def sealed_splits(
    df: DataFrame,
    unit: str,
    label: str | None,
    test_sizes: Sequence[float] = (0.5,),
    runs: int = 1,
    seed: int = 111,
    max_tries: int | None = None,
) -> list[Split]:
    """Find the splits of every run and size; a split that misses a class on a side is drawn again.

    A retry adds ``SEED_STEP`` to the seed of that run and size, and the first good seed is taken; ever more seeds are
    tried in one pass. Whether a split can exist at all is decided beforehand by counting recordings per class; if not,
    the call fails at once. ``max_tries`` bounds the seeds of a run and size; without it the search ends when all are
    found (recordings of several classes, whose counts can't decide it: after ``MANY_TRIES``).

    Recordings are listed once, each with its few classes. Every pass hashes them and leaves counts per hash prefix and
    extremes per class; they are not written again, whatever the number of seeds, and no group of them is sorted.
    """
    # one pass over the segments; what follows works on recordings, each with its few classes
    kinds = F.collect_set(label) if label else F.first(F.array().cast("array<string>"))
    units = settle(df.where(F.col(unit).isNotNull()).groupBy(unit).agg(kinds.alias("_labels")))
    pending = [(r, seed + r, t) for t in test_sizes for r in range(runs)]
    done: list[Split] = []
    tried, batch = 0, 1
    while pending:
        batch = min(batch, max_tries - tried) if max_tries else batch
        wanted = [(r, s + SEED_STEP * j, t) for r, s, t in pending for j in range(tried, tried + batch)]
        hashed = _hashed(units, unit, [s for _, s, _ in wanted], ["_labels"])
        summary = settle(_summary(hashed))
        limits = _limits(hashed, summary, wanted)
        drawn = [Split(r, t, s, limits[(r, s, t)]) for r, s, t in wanted]
        if label is None:
            return drawn
        # one row per split: run numbers stand for places in the list here
        numbered = [Split(i, d.test_size, d.seed, d.limit) for i, d in enumerate(drawn)]
        covered = _coverage(summary, numbered).collect()
        if not tried and covered:
            n = units.count()
            reasons, single = _must_fail(n, covered[0]["classes"], covered[0]["lone"], covered[0]["marks"], test_sizes)
            if reasons:
                raise ValueError(f"no split with every class on both sides: {'; '.join(reasons)}")
            max_tries = max_tries or (None if single else MANY_TRIES)
        good = {c["run"] for c in covered if c["train_classes"] == c["classes"] == c["test_classes"]}
        good = good if covered else set(range(len(drawn)))  # no recording has a class: nothing to cover
        first: dict[tuple[int, float], Split] = {}
        for i, d in enumerate(drawn):
            if i in good:
                first.setdefault((d.run, d.test_size), d)
        done += first.values()
        pending = [p for p in pending if (p[0], p[2]) not in first]
        tried, batch = tried + batch, min(batch * 4, MOST_SEEDS)
        if pending and max_tries and tried >= max_tries:
            raise ValueError(f"no split with every class on both sides after {tried} tries: {pending}")
    order = {t: i for i, t in enumerate(test_sizes)}
    return sorted(done, key=lambda d: (order[d.test_size], d.run))


def ratio_grid(low: float = 0.05, high: float = 0.95, step: float = 0.05) -> list[float]:
    count = round((high - low) / step) + 1
    return [round(low + i * step, 4) for i in range(count)]


def fixed_split(df: DataFrame, column: str = "sett") -> tuple[DataFrame, DataFrame]:
    return df.where(F.col(column) == "train"), df.where(F.col(column) == "test")


def mix_sources(sources: Sequence[DataFrame], weights: Sequence[float], key: str, seed: int = 0) -> DataFrame:
    """Keep each row of source i with probability ``weights[i] / max(weights)`` and tag it."""
    from tonewheel.functions.arrays import hash_uniform

    top, out = max(weights), None
    for i, (df, weight) in enumerate(zip(sources, weights)):
        kept = df.where(hash_uniform(F.lit(seed), F.lit(i), F.col(key)) < weight / top).withColumn("source_id", F.lit(i))
        out = kept if out is None else out.unionByName(kept)
    return out


def shuffled(df: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """Rows in a seeded random order, range-partitioned over the cluster."""
    return df.orderBy(F.md5(F.concat_ws("|", F.lit(seed).cast("string"), F.col(key).cast("string"))), key)
