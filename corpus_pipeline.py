"""Documents to training data: one stage after the other, each written and read again.

``run(spark, sf_dir)`` applies ``STAGES`` to ``documents``. Every stage reads all that its predecessor kept; all but the
last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tonewheel.llm import bpe, decontamination, ngram_join, pii, toxicity
from tonewheel.session import settle

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain, fitted on the label table, doesn't find toxic."""
    labels = toxicity.with_categories(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    found = toxicity.score(docs, toxicity.fit(docs, labels, ["low_quality", "toxic"]))
    return found.filter("not is_toxic").select(*docs.columns)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shingles of five words join at a Jaccard similarity of 0.8."""
    return ngram_join.one_of_each(docs, size=5, percent=80)


def without_test_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontamination.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind."""
    return pii.redacted(docs)


def as_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token count and digests of the ids and of the decoded bytes of every document."""
    vocabulary = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.round_trip(docs, vocabulary, public_tokenizers.PATTERN)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", without_toxic),
    ("ngram_join", without_copies),
    ("decontamination", without_test_items),
    ("pii", without_personal_data),
    ("byte_bpe", as_tokens),
]

#: No SQL: trained classifiers, prefix tiles and byte pair ranks. The tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = settle(docs)
    return docs
