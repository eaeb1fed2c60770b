"""A training corpus in five stages over ``documents``.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet
and read again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusmill.jobs.ship import ship
from locusmill.llm.mixing import MixParams, mix_documents
from locusmill.llm.neardup import drop_near_duplicates
from locusmill.llm.pieces import encode_documents, model_bytes
from locusmill.llm.pii import redact_documents
from locusmill.llm.quality import filter_quality
from locusmill.operators.shared import shared_dir

#: The whole corpus is the budget: a source below its weight is repeated at most once, one above it is cut.
MIX = MixParams(share=100, max_epochs=2)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and their language's perplexity band keep."""
    ship(spark)
    return filter_quality(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each near-duplicate component."""
    ship(spark)
    return drop_near_duplicates(docs)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind in brackets."""
    ship(spark)
    return redact_documents(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents to the budgets of the domain, language and source tree; a second epoch is a second row."""
    ship(spark)
    return mix_documents(docs, MIX)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and source spans of every document."""
    ship(spark)
    out = encode_documents(docs.select("doc_id", "lang", "source", "text"), model_bytes())
    return out.select("doc_id", "lang", "source", *[F.col(f"pieces.{c}").alias(c) for c in ("n_tokens", "ids", "starts", "ends")])


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("pii", pii),
    ("mixing", mixing),
    ("sentencepiece", sentencepiece),
]

#: The perplexity model and the sketches have no SQL form; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            path = f"{shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
