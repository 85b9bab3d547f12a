"""A training-data pipeline over `documents`: each stage is one operator of rivertrack.llm."""

import public_tokenizers
from pyspark.sql import functions as F

from rivertrack.llm import jaccard_join, packing, quality_classifier, quality_rules, secret_scan
from rivertrack.llm.common import table, written
from rivertrack.sources.files import stage_path


NEAR_WORDS, NEAR_PERCENT = 5, 80  # near duplicates: shingle length, least Jaccard similarity


def quality_rules_stage(spark, docs, sf_dir):
    """Documents that the base rules or the adaptive cutoffs reject go."""
    return quality_rules.quality_filter(docs)


def quality_classifier_stage(spark, docs, sf_dir):
    """Documents that the classifier and their sites speak against go. It is fitted on labelled
    rows of `documents`, of which the earlier stage has removed nearly all bad ones."""
    labels = table(spark, sf_dir, "labels")
    model = quality_classifier.fit(table(spark, sf_dir, "documents"), labels)
    return quality_classifier.quality_keep(docs, labels, model)


def jaccard_join_stage(spark, docs, sf_dir):
    """Of each group of near duplicates, texts that share 80 % of their five-word shingles, the
    document with the smallest id stays."""
    return jaccard_join.one_of_each(docs, percent=NEAR_PERCENT, words=NEAR_WORDS)


def secret_scan_stage(spark, docs, sf_dir):
    """Secrets are masked in the text; n_chars follows."""
    masked = secret_scan.redact(docs, stage_path(spark, "secret-ledger"))
    return masked.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text")).cast("long"))


def packing_stage(spark, docs, sf_dir):
    """The pieces of all sequences, with their ids."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", quality_rules_stage),
    ("quality_classifier", quality_classifier_stage),
    ("jaccard_join", jaccard_join_stage),
    ("secret_scan", secret_scan_stage),
    ("packing", packing_stage),
]
ORACLE_SQL = None  # a trained classifier and a tokenizer; tests/llm/test_corpus_pipeline.py compares the stages with plain Python


def run(spark, sf_dir):
    """All stages over `documents`; each result is written as Parquet and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
