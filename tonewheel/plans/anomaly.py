"""Anomaly detection end to end: vectors and metadata to scores, scores to yearly metrics."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonewheel.operators import knn
from tonewheel.operators.metrics import hmean, hmean_of, mean_of
from tonewheel.operators.roc import roc_aggregates
from tonewheel.operators.skew import TARGET_ROWS, running_sums
from tonewheel.session import settle

# Grouping of train and test rows per scale; ``mt2set`` merges the dev and eval subsets.
SCALES = {"sec": ["setn", "mt", "sec"], "mt": ["setn", "mt"], "mt2set": ["mt"]}

Detector = Callable[..., DataFrame]


def knn_detector(test: DataFrame, train: DataFrame, keys: Sequence[str], carry: Sequence[str], k: int = 1, metric: str = "cosine", pca: int = 0) -> DataFrame:
    if pca > 0:
        from tonewheel.operators.features import group_pca

        key = "_group"
        test, train = (d.withColumn(key, F.concat_ws("|", *keys) if keys else F.lit("")) for d in (test, train))
        test, train = group_pca(test, train, key, pca), group_pca(train, train, key, pca)
    return knn.anomaly_scores(test, train, keys, k, metric, carry)


DETECTORS: dict[str, Detector] = {"knn": knn_detector}


def missing_groups(test: DataFrame, train: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Test groups without any train row."""
    return test.select(*keys).distinct().join(train.select(*keys).distinct(), list(keys), "left_anti")


def missing_vectors(meta: DataFrame, vectors: DataFrame, file: str = "file") -> DataFrame:
    """Metadata rows whose file has no vector."""
    return meta.join(vectors.select(file).distinct(), file, "left_anti")


def score(
    meta: DataFrame,
    vectors: DataFrame,
    detectors: Mapping[str, Mapping[str, object]] | None = None,
    scale: str = "sec",
    domains: str = "none",
    pool: str | None = None,
    normalise: bool = True,
    score_train: bool = False,
    dataset: str | None = None,
) -> DataFrame:
    """One long score table: metadata columns, ``detector``, ``score`` (and the two domain scores).

    ``meta`` holds train and test rows in ``sett``. ``domains='min'`` scores every test row against
    the source and the target train rows of its group and keeps the lower; train rows are then
    scored by the model of their own domain. Several vectors per file are scored one by one and
    pooled by ``pool``. Vectors are narrow-joined by file. A file without a vector and a test group without train rows
    are errors; ``missing_vectors`` and ``missing_groups`` list them.
    """
    if domains == "min" and dataset in ("dcase20", "dcase21"):
        raise ValueError(f"{dataset} has no use for fused domain models")
    if scale == "mt2set" and dataset == "dcase23":
        raise ValueError("the machine types of dev and eval differ in dcase23")
    keys = SCALES[scale]
    rows = meta.drop("path", *([] if dataset == "dcase20" else ["attri"]))
    carry = [c for c in rows.columns if c not in (*keys, "file")]
    wanted = rows if score_train else rows.where(F.col("sett") == "test")
    lost = missing_groups(wanted, rows.where(F.col("sett") == "train"), keys).first()
    if lost:
        raise ValueError(f"no train rows for {lost.asDict()}")
    absent = F.raise_error(F.concat(F.lit("no vector for file "), F.coalesce(F.col("file"), F.lit("NULL"))))
    joined = rows.join(vectors.select("file", "emb"), "file", "left").withColumn(
        "emb", F.when(F.col("emb").isNotNull(), F.col("emb")).otherwise(absent)
    )
    if pool:
        # a vector needs an identity of its own next to its file
        joined = joined.withColumn("_file", F.col("file")).withColumn(
            "file", F.concat_ws("#", "file", F.monotonically_increasing_id())
        )
        joined = settle(joined)
        carry = [*carry, "_file"]
    elif domains == "min":
        # both scores of a vector meet again by its file and itself
        joined, carry = joined.withColumn("_vector", F.xxhash64("emb")), [*carry, "_vector"]
    train = joined.where(F.col("sett") == "train")
    scored = joined if score_train else joined.where(F.col("sett") == "test")
    out = None
    for name, conf in (detectors or {"knn": {}}).items():
        one = _scored(DETECTORS[name], scored, train, keys, carry, domains, normalise, conf)
        if pool:
            values = [c for c in ("score_sou", "score_tar", "score") if c in one.columns]
            plain = [c for c in carry if c != "_file"]
            fold = {"mean": F.avg, "min": F.min, "max": F.max}[pool]
            one = one.groupBy(*keys, *plain, F.col("_file").alias("file")).agg(*[fold(v).alias(v) for v in values])
        one = one.drop("_vector").withColumn("detector", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def _scored(detect: Detector, scored: DataFrame, train: DataFrame, keys: list[str], carry: list[str], domains: str, normalise: bool, conf: Mapping[str, object]) -> DataFrame:
    if domains == "none":
        raw = settle(detect(scored, train, keys, carry, **conf))
        return knn.znorm(raw, [*keys, "sett"]) if normalise else raw
    if domains != "min":
        raise ValueError(f"unknown domain mode {domains!r}")
    both = F.when(F.col("sett") == "train", F.array("domain")).otherwise(F.array(F.lit(0), F.lit(1)))
    models = scored.withColumn("_dom", F.explode(both))
    base = train.withColumn("_dom", F.col("domain"))
    raw = settle(detect(models, base, [*keys, "_dom"], carry, **conf))
    if normalise:
        raw = knn.znorm(raw, [*keys, "_dom", "sett"])
    return knn.min_fusion(raw, keys, "file", "_dom", carry)




def section_metrics(scores: DataFrame, year: int, keys: Sequence[str] = ("setn", "mt", "sec"), target_rows: int = TARGET_ROWS) -> DataFrame:
    """Metrics of every section in percent, by the rules of the year.

    Rows are folded to counts per score and domain, and all curves of a section (a domain against
    its own anomalies, or against those of both) are read off one ordered pass.
    """
    keys = list(keys)
    hit, source = F.col("status") == 1, F.col("domain") == 0

    def count(condition):
        return F.count(F.when(condition, 1))

    parts = {"ps": hit & source, "pt": hit & ~source, "ns": ~hit & source, "nt": ~hit & ~source}
    if year == 20:
        parts = {"pos": hit, "neg": ~hit}
    used = scores.where(F.col("status").isNotNull() & F.col("score").isNotNull())
    folded = used.groupBy(*keys, F.col("score").cast("double").alias("score")).agg(*[count(c).alias(n) for n, c in parts.items()])
    steps = running_sums(folded, keys, ["score"], list(parts), True, target_rows, scores)
    if year == 20:
        auc, pauc = roc_aggregates(["pos"], ["neg"])
        wide, last = {"auc": auc, "pauc": pauc}, mean_of("auc", "pauc").alias("mean")
    elif year == 21:
        sou, tar = roc_aggregates(["ps"], ["ns"]), roc_aggregates(["pt"], ["nt"])
        wide = {"auc_s": sou[0], "pauc_s": sou[1], "auc_t": tar[0], "pauc_t": tar[1]}
        last = hmean_of(*wide).alias("hmean")
    else:
        anomalies = ["ps", "pt"]
        wide = {
            "auc_s": roc_aggregates(anomalies, ["ns"])[0],
            "auc_t": roc_aggregates(anomalies, ["nt"])[0],
            "pauc": roc_aggregates(anomalies, ["ns", "nt"])[1],
            "auc_dom_s": roc_aggregates(["ps"], ["ns"])[0],
            "auc_dom_t": roc_aggregates(["pt"], ["nt"])[0],
        }
        last = hmean_of("auc_s", "auc_t", "pauc").alias("hmean")
    return steps.groupBy(*keys).agg(*[(c * 100).alias(n) for n, c in wide.items()]).select("*", last)


def _fold(year: int):
    return F.avg if year == 20 else hmean


def _rounded(column, exact: bool):
    return column if exact else F.bround(column, 2)


def machine_metrics(sections: DataFrame, year: int, exact: bool = False) -> DataFrame:
    """One row per (subset, machine): every metric folded over its sections, rounded to 2 decimals."""
    last = "mean" if year == 20 else "hmean"
    metrics = [c for c in sections.columns if c not in ("detector", "setn", "mt", "sec")]
    keys = [c for c in ("detector", "setn", "mt") if c in sections.columns]
    fold = _fold(year)
    return sections.groupBy(*keys).agg(*[_rounded(fold(m), exact).alias(m) for m in metrics]).select(*keys, *metrics, F.col(last).alias("value"))


def subset_metrics(sections: DataFrame, year: int, exact: bool = False) -> DataFrame:
    """One row per subset. Up to year 22 over rounded machine rows, later over all sections at once."""
    keys = [c for c in ("detector", "setn") if c in sections.columns]
    if year >= 23:
        return sections.groupBy(*keys).agg(_rounded(hmean("hmean"), exact).alias("value"))
    return machine_metrics(sections, year, exact).groupBy(*keys).agg(_fold(year)("value").alias("value"))


def total_metric(subsets: DataFrame, year: int) -> DataFrame:
    keys = [c for c in ("detector",) if c in subsets.columns]
    return subsets.groupBy(*keys).agg(_fold(year)("value").alias("value"))


def report(scores: DataFrame, year: int, exact: bool = False, target_rows: int = TARGET_ROWS) -> DataFrame:
    """All levels in one long table: ``(level, setn, mt, sec, metric, value)``, section values rounded."""
    keys = [c for c in ("detector",) if c in scores.columns] + ["setn", "mt", "sec"]
    sections = settle(section_metrics(scores, year, keys, target_rows))
    metrics = [c for c in sections.columns if c not in keys]
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in metrics])).alias("_p")

    def level(df: DataFrame, name: str, value) -> DataFrame:
        have = [c if c in df.columns else F.lit(None).cast("string").alias(c) for c in keys if c != "sec"]
        sec = F.col("sec") if "sec" in df.columns else F.lit(None).cast("int")
        return df.select(F.lit(name).alias("level"), *have, sec.cast("int").alias("sec"), *value)

    long = level(sections, "section", [pairs]).select("level", *keys, "_p.metric", _rounded(F.col("_p.value"), exact).alias("value"))
    machines = level(machine_metrics(sections, year, exact).drop("value"), "machine", [pairs]).select("level", *keys, "_p.metric", "_p.value")
    subsets = subset_metrics(sections, year, exact)
    last = "mean" if year == 20 else "hmean"
    sub = level(subsets, "subset", [F.lit(last).alias("metric"), "value"])
    tot = level(total_metric(subsets, year), "total", [F.lit(last).alias("metric"), "value"])
    return long.unionByName(machines).unionByName(sub).unionByName(tot)
