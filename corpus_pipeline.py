"""Corpus pipeline: each stage reads what the stage before it kept, written as Parquet and read again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from gaugemill.llm import decontaminate, lshforest, packing, pii, toxicity
from gaugemill.llm.scratch import Scratch

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
TOXIC_FROM = 0.7


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score stays below TOXIC_FROM; the labels' own documents of the training part train the scorer."""
    chain = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    plain = docs.select(*(F.col(c).alias(f"c_{c}") if c in ("n_tokens", "score", "spans") else F.col(c) for c in docs.columns))
    scored = toxicity.score(plain, chain, spans=False)
    return scored.where(F.col("score") < TOXIC_FROM).select(*(F.col(f"c_{c}").alias(c) if c in ("n_tokens", "score", "spans") else F.col(c) for c in docs.columns))


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id; rows without an id or words all stay.

    Equal rows under one id are one document and stay together.
    """
    groups = lshforest.group(docs).where(F.col("doc_id").isNotNull() & (F.col("doc_id") != F.col("component_id"))).select(F.col("doc_id").cast(docs.schema["doc_id"].dataType)).distinct()
    return docs.join(groups.hint("merge"), "doc_id", "left_anti").select(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; null and empty texts, and all rows beside an empty benchmark, stay."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each personal span of a text replaced by its kind; null texts stay null, repeated rows repeated."""
    return pii.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's bucket, batch and slot; null and empty texts have one token, a text beyond the budget is alone."""
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("minhash_dedup", one_of_near_duplicates),
    ("decontamination", drop_leaks),
    ("pii", redact),
    ("packing", pack),
]
#: Scores, contexts and groups aren't SQL; the stages are tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; what a stage keeps is a table of its own in the shared folder."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return docs
