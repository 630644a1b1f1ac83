"""Queries of the operators that judge one text at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.language_id import language_id
from tidemark.llm.lm_scoring import lm_scoring
from tidemark.llm.packing import best_fit_packing
from tidemark.llm.perplexity import perplexity_filter
from tidemark.llm.quality_rules import quality_rules
from tidemark.llm.token_counts import token_counts
from tidemark.llm.toxicity import toxicity
from tidemark.session import table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole document."""
    return language_id(table(spark, sf_dir, "documents"))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of every whole document."""
    return lm_scoring(table(spark, sf_dir, "documents"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pieces of all documents in sequences of at most 1024 tokens."""
    return best_fit_packing(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every whole document."""
    return token_counts(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every whole document."""
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_perplexity_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole document against a model of those labelled as of good quality."""
    return perplexity_filter(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").where("quality = 1"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict for every whole document."""
    return quality_rules(table(spark, sf_dir, "documents"))


QUERIES = {"op1_language_id": op1_language_id, "op2_lm_scoring": op2_lm_scoring, "op3_best_fit_packing": op3_best_fit_packing, "op4_token_counts": op4_token_counts, "op6_toxicity": op6_toxicity, "op7_perplexity_filter": op7_perplexity_filter, "op9_quality_rules": op9_quality_rules}
ORACLES: dict[str, str] = {}
