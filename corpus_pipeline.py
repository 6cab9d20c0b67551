"""The training-data pipeline: each stage reads what its predecessor kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import classifier, decontaminate, near_dups, packing, secrets
from lodestone.llm.common import discard, materialize, read, trim_executors
from lodestone.llm.queries import TOKENIZER


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    trim_executors(spark)
    model = classifier.fit(docs, read(spark, sf_dir, "labels"))
    return classifier.keep_good(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each class of near duplicates stays."""
    trim_executors(spark)
    return near_dups.keep_first(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of 13 words of a benchmark item go; so do those of which shorter items make up a twentieth of the words."""
    trim_executors(spark)
    return decontaminate.keep_clean(docs, read(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; its secrets are replaced by a mark."""
    trim_executors(spark)
    return secrets.redact_secrets(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 tokens."""
    trim_executors(spark)
    return packing.pack(docs, "doc_id", public_tokenizers.path(TOKENIZER))


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secret_scan),
    ("packing", pack),
]

#: Learned scores, alignment and tokenisation are outside SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage but the last is written and read again."""
    docs = read(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES[:-1]):
        kept = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        if i:
            discard(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
