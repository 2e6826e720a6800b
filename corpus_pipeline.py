"""Corpus pipeline: classify, rule out, deduplicate, mix and tokenise documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tierflow.llm._common import numbered, stored
from tierflow.llm.minhash_dedup import keep_one
from tierflow.llm.mixing import mixed
from tierflow.llm.quality_classifier import keep_quality
from tierflow.llm.quality_rules import keep_judged
from tierflow.llm.queries import tokenizer
from tierflow.llm.sentencepiece_lattice import encode_documents


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality classifier takes for good, each judged by itself; without labels all of them."""
    return keep_quality(docs, _labels(spark, sf_dir))


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that pass the base rules and are no anomaly, each judged by itself; null and short texts go."""
    return keep_judged(docs, _labels(spark, sf_dir))


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, that of the least id; rows are compared by themselves, whatever their ids."""
    return keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows in the order of the mix; rows of one id follow each other, a null source is a source."""
    return mixed(docs)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens of every row with its ``position``: its place in the files that the mix has written."""
    return encode_documents(numbered(docs, "position"), tokenizer("piece_bpe_32k.model"), place="position")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", classify), ("quality rules", rules), ("near-duplicates", dedup), ("source mixing", mix), ("tokens", tokenise),
]

#: Trained models and the similarity join have no SQL; tests compare with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read by the next.

    Rows with null ids, and rows that share one, are rows of their own in every
    stage; columns of any name pass. An empty table, or one whose rows all go, gives no rows.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
