"""Queries on ``documents``."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from tonewheel.llm import language_id, toxicity
from tonewheel.llm.bpe import round_trip
from tonewheel.llm.decontamination import leaks
from tonewheel.llm.ngram_join import jaccard_components
from tonewheel.llm.line_dedup import passages
from tonewheel.llm.pii import personal_data
from tonewheel.llm.registry import load, query
from tonewheel.llm.secret_scan import secrets
from tonewheel.llm.token_counts import edited_counts, sample_edits
from tonewheel.llm.token_links import aligned


@query("op3_ngram_join")
def op3_ngram_join(spark, sf_dir):
    return jaccard_components(load(spark, sf_dir, "documents"), size=4, percent=85)


@query("op2_byte_bpe")
def op2_byte_bpe(spark, sf_dir):
    vocabulary = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return round_trip(load(spark, sf_dir, "documents"), vocabulary, public_tokenizers.PATTERN)


@query("op4_decontamination")
def op4_decontamination(spark, sf_dir):
    return leaks(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


@query("op1_toxicity_chain")
def op1_toxicity_chain(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    labels = toxicity.with_categories(load(spark, sf_dir, "labels"))
    found = toxicity.score(docs.select("doc_id", "text"), toxicity.fit(docs, labels, ["low_quality", "toxic"]))
    return found.drop("text")


@query("op5_pii_boosting")
def op5_pii_boosting(spark, sf_dir):
    return personal_data(load(spark, sf_dir, "documents"))


@query("op6_line_dedup")
def op6_line_dedup(spark, sf_dir):
    return passages(load(spark, sf_dir, "documents"))


@query("op10_secret_ownership")
def op10_secret_ownership(spark, sf_dir):
    return secrets(load(spark, sf_dir, "documents"))


@query("op8_edit_counts")
def op8_edit_counts(spark, sf_dir):
    vocabulary = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    docs = load(spark, sf_dir, "documents")
    return edited_counts(docs, sample_edits(docs["text"]), vocabulary, public_tokenizers.PATTERN)


@query("op12_token_links")
def op12_token_links(spark, sf_dir):
    paths = (public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    return aligned(load(spark, sf_dir, "documents"), *paths)


@query("op11_language_id")
def op11_language_id(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    return language_id.predict(docs, language_id.fit(docs, ~held_out), ["doc_id", held_out.alias("held_out")])
