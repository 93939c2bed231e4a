"""The registered queries of the corpus operators: each applies one operator to its whole table."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bwt_merge, dim_scan, divergence, divide_skip, lang_cnn, line_crf, line_runs, packing, pfair, tox_chain
from .common import table
from .oracles import ORACLE_SQL


def vocabulary(path: str | None = None) -> bytes:
    """The tokenizer file's bytes; by default the installed public byte-level vocabulary."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    return Path(path).read_bytes()


def op1_dim_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dim_scan.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op2_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pfair.order(table(spark, sf_dir, "documents"))


def op3_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_crf.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_runs.digest(table(spark, sf_dir, "documents"))


def op5_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.judge(table(spark, sf_dir, "documents")).drop("class_distance", "word_distance")


def op6_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary())


def op7_divide_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divide_skip.near_duplicates(table(spark, sf_dir, "documents"), width=4, percent=85)


def op8_bwt_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bwt_merge.dedup(table(spark, sf_dir, "documents"))


def op9_lang_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lang_cnn.identify(table(spark, sf_dir, "documents"))


def op10_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tox_chain.detect(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (op1_dim_scan, op2_pfair_mix, op3_quality_crf, op4_line_runs, op5_divergence, op6_best_fit, op7_divide_skip, op8_bwt_merge, op9_lang_cnn, op10_toxicity_chain)}

__all__ = ["ORACLE_SQL", "QUERIES"]
