"""Result files: metric reports, submission files, predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonewheel.functions.names import basename
from tonewheel.operators.metrics import median_decision


def write_metric_report(long: DataFrame, path: str) -> None:
    """One folder per detector with the long metric rows as CSV."""
    long.write.mode("overwrite").partitionBy("detector").option("header", True).csv(path)


def submission_rows(scores: DataFrame) -> DataFrame:
    """``(mt, sec, name, score, decision)`` for the test rows; each section decides by its own median."""
    test = scores.where(F.col("sett") == "test") if "sett" in scores.columns else scores
    out = median_decision(test, ["mt", "sec"])
    return out.select("mt", "sec", basename(F.col("file")).alias("name"), "score", "decision")


def write_submission(rows: DataFrame, path: str) -> None:
    """Score and decision files without header, one folder per machine and section."""
    rows.select("mt", "sec", "name", "score").write.mode("overwrite").partitionBy("mt", "sec").csv(f"{path}/anomaly_score", header=False)
    rows.select("mt", "sec", "name", "decision").write.mode("overwrite").partitionBy("mt", "sec").csv(f"{path}/decision_result", header=False)


def write_predictions(pred: DataFrame, report: DataFrame, path: str) -> None:
    pred.write.mode("overwrite").option("header", True).csv(f"{path}/pred")
    report.withColumn("acc", F.bround("acc", 2)).write.mode("overwrite").option("header", True).csv(f"{path}/acc")
