"""From raw documents to packed training sequences, stage by stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from memoquarry.llm import stages
from memoquarry.llm.common import Scratch, table

STAGES = [
    ("toxicity", stages.drop_toxic),
    ("ngram_jaccard_join", stages.drop_near_copies),
    ("suffix_dedup", stages.cut_repeats),
    ("benchmark_decontamination", stages.cut_benchmark),
    ("packing", stages.pack),
]

#: Exact longest-match and packing order have no practical SQL form; tests/llm/test_pipeline.py holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = scratch.write(stage(spark, docs, sf_dir), name)
        if k:
            scratch.drop(STAGES[k - 1][0])
    return docs
