"""The corpus pipeline: quality rules, toxicity, n-gram Jaccard join, benchmark decontamination, best-fit packing.

Every stage takes (spark, docs, sf_dir) and returns documents with all their columns, those that it keeps; the last
returns the pieces of the documents and their places in sequences. Each stage's rows are written as Parquet and read
again before the next one. Packing has no SQL form (nor have the learned stages), so ORACLE_SQL is None and the tests
hold the pipeline against a brute-force version.

Odd rows: a null text counts as an empty one, and quality rules let neither through. A row without doc_id is judged by
its own text, is nobody's duplicate and stays. Repeated rows of one doc_id are judged together (one that is rejected
takes all along) and leave the third stage as one. Ids may be of any type, in documents and labels alike. Very long
texts are judged and packed whole. Columns beyond those of documents pass all stages but the last, whatever their
names; an empty table gives an empty result of the same columns.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.decontamination import keep_unseen
from tidemark.llm.ngram_join import keep_one
from tidemark.llm.packing import best_fit_packing
from tidemark.llm.quality_rules import keep_clean
from tidemark.llm.queries_text import tokenizer_path
from tidemark.llm.toxicity import keep_civil
from tidemark.session import shared_dir, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return keep_clean(docs)


def civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are predicted toxic go."""
    return keep_civil(docs, table(spark, sf_dir, "labels"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: five words, similarity 0.8 or more."""
    return keep_one(docs, n=5, percent=80)


def unseen(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return keep_unseen(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 1024 tokens."""
    return best_fit_packing(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", quality),
    ("toxicity", civil),
    ("ngram_jaccard_join", distinct),
    ("benchmark_decontamination", unseen),
    ("best_fit_packing", packed),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    home = f"{shared_dir(spark)}/corpus_pipeline/{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{home}/{k}_{name}")
        docs = spark.read.parquet(f"{home}/{k}_{name}")
    return docs
