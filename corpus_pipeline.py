"""The training-data pipeline: five stages over ``documents``, each one operator of ``kinspark.llm``.

Every stage takes what its predecessor kept. Stages 1 to 4 return the columns of
``documents``; the last returns the packed pieces. An empty table passes through all
of them; null texts, ids and sources are treated as the operators document.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kinspark.llm import exact_dedup, mixing, ngram_join, ordinal_toxicity, packing, tokens
from kinspark.llm.shared import stored


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal model grades as toxic go."""
    model = ordinal_toxicity.fit_ordinal(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return ordinal_toxicity.drop_toxic(docs, model)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id stays."""
    return exact_dedup.drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by five-word shingles (similarity 0.8 or more) the least id stays."""
    return ngram_join.keep_representatives(docs, k=5, num=80, den=100)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mixing.take_mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 tokens."""
    return packing.pack(docs, tokens.default_path("byte_bpe_50k.json"))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_copies),
    ("ngram_jaccard_join", near_copies),
    ("source_mix", mixture),
    ("packing", packed),
]

#: The fitted model, the tokenizer and the knapsack have no SQL form.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
