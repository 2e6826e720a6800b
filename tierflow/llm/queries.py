"""Registered queries of this subpackage, with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import mixing, sharding, url_filter, warc
from .embedding_dedup import near_vectors
from .minhash_dedup import near_documents
from .periodic_runs import runs_of_words
from .quality_classifier import score_quality
from .quality_rules import judge_quality
from .sentencepiece_lattice import encode_documents
from .spelling_variants import group_variants
from .suffix_dedup import remove_repeats
from .token_files import token_digest


def tokenizer(name: str) -> str:
    """Place of a public vocabulary file; another folder of them is a parameter of the environment."""
    import os

    if folder := os.environ.get("TOKENIZER_DIR"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(_table(spark, sf_dir, "embeddings"))


def op2_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_documents(_table(spark, sf_dir, "documents"))


def op3_extendible_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(_table(spark, sf_dir, "documents"))


def op4_seekable_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digest(_table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op5_warc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_digest(_table(spark, sf_dir, "pages"))


def op6_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, sf_dir, "documents"))


def op7_sentencepiece_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(_table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op8_isolation_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(_table(spark, sf_dir, "pages"))


def op10_factorisation_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op11_internal_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs_of_words(_table(spark, sf_dir, "documents"), rewrite=True)


def op12_bucket_refinement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(_table(spark, sf_dir, "documents"))


def op13_dense_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_variants(_table(spark, sf_dir, "documents"), planted=True)


QUERIES = {f.__name__: f for f in (
    op1_nn_descent, op2_chosen_path, op3_extendible_hashing, op4_seekable_tokens, op5_warc_segments,
    op6_pfair_mixing, op7_sentencepiece_lattice, op8_isolation_forest, op9_url_filter, op10_factorisation_machine,
    op11_internal_matching, op12_bucket_refinement, op13_dense_tiling,
)}
ORACLES = {
    "op3_extendible_hashing": sharding.ORACLE, "op5_warc_segments": warc.ORACLE,
    "op6_pfair_mixing": mixing.ORACLE, "op9_url_filter": url_filter.ORACLE,
}
