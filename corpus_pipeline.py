"""The corpus pipeline: language ID, near-dedup, decontamination, sanitisation and encoding of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillspark.llm import bpe, dart_minhash, decontaminate, language_id, sanitise
from quillspark.llm.common import materialise, table

STAGES = [
    ("language_id", language_id.stage),
    ("near_dedup", dart_minhash.stage),
    ("decontamination", decontaminate.stage),
    ("sanitisation", sanitise.stage),
    ("bpe", bpe.stage),
]
#: Model fitting, near-duplicate search and sub-word encoding have no SQL form; tests/llm holds the brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}", scan=True)
    return docs
