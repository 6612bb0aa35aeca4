"""Corpus pipeline: quality rules, toxicity, near-duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and, but for the
last, returns the columns of documents. run() writes every stage's result to the shared folder and
hands the written table on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from evloom.llm import packing, quality_rules, simhash, suffix_dedup, toxicity
from evloom.session import alone, discard

STAGES = [
    ("quality_rules", quality_rules.stage),
    ("toxicity", toxicity.stage),
    ("simhash", simhash.stage),
    ("suffix_dedup", suffix_dedup.stage),
    ("packing", packing.stage),
]

# Fingerprints, learnt scores and byte-wise removal are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole `documents` table: the packed pieces of what is left (doc_id, start, length, ids_crc32,
    doc_tokens, sequence_id, offset).

    Rows with a null or repeated doc_id are documents of their own and keep their id; null texts are empty; an empty table
    gives an empty result; further columns of the table travel along up to the last stage. The tables of a
    stage are deleted once its result is written, and that once the next one is; the last result is a written table too."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        before, docs = docs, alone(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), f"pipeline-{name}")
        discard(before)
    return docs
