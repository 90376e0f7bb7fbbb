"""Anomaly scores for files as they land."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tonewheel.operators.knn import anomaly_scores


def score_landing(vectors: DataFrame, train: DataFrame, keys: list[str], output: str, checkpoint: str, k: int = 1) -> StreamingQuery:
    """Score a stream of ``(keys, file, emb)`` against a stored train table and append the distances.

    A micro-batch goes through the same search as a batch job. Distances are left as they are: a
    z-score needs the whole group. Each batch writes its own folder, so a replayed batch replaces
    itself.
    """
    def score(batch: DataFrame, number: int) -> None:
        anomaly_scores(batch, train, keys, k).write.mode("overwrite").parquet(f"{output}/batch={number}")

    return vectors.writeStream.foreachBatch(score).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
