"""Metadata tables of the supported collections, built from file catalogs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonewheel.functions import names
from tonewheel.functions import tables as tb


def yearly(files: DataFrame, root: str, dataset: str, truth: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Train and test rows of a yearly anomaly collection, and the rows that do not fit it.

    ``files`` has ``path`` and any header facts. Below ``root`` lies ``<setn>_data/<mt>/<sett>/<name>``.
    The names of eval test files say nothing; ``truth`` (``mt, file, orig``) has their real ones.
    """
    rows = names.derive(files, _rel=names.relative_to(F.col("path"), root), _name=names.basename(F.col("path")))
    parts = F.split("_rel", "/")
    folder = names.token(parts, 2)
    rows = names.derive(
        rows,
        file=names.last_parts(F.col("path"), 4) if dataset == "dcase21" else F.col("_rel"),
        setn=F.regexp_replace(names.token(parts, 0), "_data$", ""),
        mt=names.token(parts, 1),
        sett=F.when(folder.isin("source_test", "target_test"), "test").otherwise(folder),
    ).where(F.col("sett").isin("train", "test"))
    hidden = (F.col("setn") == "eval") & (F.col("sett") == "test")
    if truth is not None:
        named = truth.select("mt", F.col("file").alias("_name"), "orig")
        rows = rows.join(named, ["mt", "_name"], "left")
    else:
        rows = rows.withColumn("orig", F.lit(None).cast("string"))
    rows = rows.withColumn("_src", F.when(hidden, F.col("orig")).otherwise(F.col("_name")))
    rows = names.derive(rows, **names.yearly_layout(dataset, F.col("_src"))).withColumn("dataset", F.lit(dataset))
    rows = rows.drop("_name", "_src", "_rel", "orig")
    good = F.col("sec").isNotNull()
    return rows.where(good), rows.where(~good)


def supplementary(files: DataFrame, root: str, dataset: str = "dcase25") -> tuple[DataFrame, DataFrame]:
    rel = names.relative_to(F.col("path"), root)
    parts = F.split(rel, "/")
    rows = (
        files.withColumn("file", rel)
        .withColumn("setn", F.regexp_replace(names.token(parts, 0), "_data$", ""))
        .withColumn("mt", names.token(parts, 1))
        .withColumn("sett", F.lit("supple"))
        .where(names.token(parts, 2) == "supplemental")
    )
    rows = names.derive(rows, **names.layout_supplementary(F.col("file"), dataset))
    return rows.where("type is not null"), rows.where("type is null")


def compressed_air(files: DataFrame, root: str) -> DataFrame:
    out = names.derive(files, file=names.relative_to(F.col("path"), root))
    return names.derive(out, **names.layout_compressed_air(F.col("file")))


def engine(files: DataFrame, root: str) -> DataFrame:
    out = names.derive(files, file=names.relative_to(F.col("path"), root))
    return names.derive(out, **names.layout_engine(F.col("file"))).where("used").drop("used")


# Class list, healthy class, tokens to drop for the recording, suffix put back.
_PREFIXED = {
    "gearbox": (tb.GEARBOX_CLASSES, "healthy", 2, ".flac"),
    "shaft": (tb.SHAFT_CLASSES, "normal", 0, ""),
    "bearing": (tb.BEARING_CLASSES, "NC", 2, ""),
    "race": (tb.RACE_CLASSES, "healthy", 2, ""),
}


def fault_by_prefix(files: DataFrame, collection: str) -> tuple[DataFrame, DataFrame]:
    """Rows of a fault collection classified by the start of the name, and the rows of no class."""
    classes, healthy, drop, suffix = _PREFIXED[collection]
    out = files.withColumn("file", names.basename(F.col("path")))
    if collection == "gearbox":
        out = out.where(names.kept_names(F.col("path"), [".flac"], without=["keyphase"]))
    return _finish(out, names.first_prefix(F.col("file"), classes), healthy, drop, suffix)


def fault_by_substring(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    out = files.withColumn("file", names.basename(F.col("path")))
    return _finish(out, names.first_substring(F.col("file"), tb.PLANET_CLASSES), "normal", 2, "")


def _finish(df: DataFrame, scene: Column, healthy: str, drop: int, suffix: str) -> tuple[DataFrame, DataFrame]:
    out = names.derive(df, scene=scene).withColumn("status", names.status_of(F.col("scene"), healthy))
    out = out.withColumn("ori", names.recording_key(F.col("file"), drop, suffix))
    if "num_frames" in out.columns:
        out = out.withColumn("dur", names.duration(F.col("num_frames"), F.col("sample_rate"), 1))
    return out.where("scene is not null"), out.where("scene is null")


def eccentric_gear(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two independent labels per file; normal only where both are."""
    out = files.withColumn("file", names.basename(F.col("path")))
    out = names.derive(
        out,
        scene_G=names.first_substring(F.col("file"), tb.GEAR_CLASSES),
        scene_E=names.first_substring(F.col("file"), tb.ECCENTRIC_CLASSES),
    )
    normal = (F.col("scene_G") == "G1") & (F.col("scene_E") == "E00")
    out = out.withColumn("status", F.when(normal, "normal").otherwise("anomaly"))
    out = out.withColumn("ori", names.recording_key(F.col("file"), 2))
    both = F.col("scene_G").isNotNull() & F.col("scene_E").isNotNull()
    return out.where(both), out.where(~both)
