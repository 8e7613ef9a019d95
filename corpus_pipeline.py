"""From raw documents to packed sequences: toxicity, exact and near duplicates, mixing, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sorrel.llm.common import materialize, table
from sorrel.llm.exact_dedup import drop_duplicates
from sorrel.llm.minhash import drop_near_duplicates
from sorrel.llm.mixing import mixed_documents
from sorrel.llm.packing import pack_documents
from sorrel.llm.queries import QUALITY_SHARES, byte_bpe
from sorrel.llm.toxicity import drop_toxic, train


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the string-kernel machine scores 0.7 or more go; a null text counts as empty and stays."""
    return drop_toxic(docs, train(docs, table(spark, sf_dir, "labels"), "toxic"), threshold=0.7)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id stays, and rows with a null id; null texts are equal to empty ones."""
    return drop_duplicates(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document with the smallest id stays, and rows with a null id."""
    return drop_near_duplicates(docs, least=0.8, size=5)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated so that tokens come near the target shares; none has a rate below one, so none is lost.

    Labels that no document has are ignored; without any label nothing is repeated.
    """
    return mixed_documents(docs, table(spark, sf_dir, "labels"), byte_bpe(), QUALITY_SHARES, least_rate=1.0)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All tokens are placed in sequences of 2048. The column copy tells apart the rows of a document that is repeated."""
    numbered = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("copy"))
    return pack_documents(numbered, byte_bpe(), capacity=2048, carry=("copy",))


STAGES = [
    ("toxicity", toxicity),
    ("exact_duplicates", exact_duplicates),
    ("near_duplicates", near_duplicates),
    ("mixing", mixing),
    ("packing", packing),
]

#: The first stage is a fitted model, which SQL can't express; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the table documents; each stage's result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
