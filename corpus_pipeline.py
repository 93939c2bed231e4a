"""The corpus pipeline: stages over documents, each written as Parquet and read again by the next.

Every stage works on all that the one before kept. Repeated rows stay repeated until the near-duplicate stage; rows
with a null doc_id or without words pass all stages. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tapeline.llm import divide_skip, line_crf, line_runs, packing, pfair
from tapeline.llm.common import Scratch, table
from tapeline.llm.queries import vocabulary


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line field rejects go."""
    return line_crf.keep_good(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of 40 code points or more in five documents or more stay only in the largest doc_id."""
    return line_runs.clean(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by a Jaccard similarity of 0.8 on five-word shingles, the smallest doc_id stays."""
    return divide_skip.one_of_each(docs, width=5, percent=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of a Pfair mix of their sources: files, and rows in them, are in the order of slots."""
    return pfair.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens in best-fit sequences, numbered in the order of the mix as stored."""
    return packing.pack_in_order(docs, vocabulary())


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("mix", mix), ("pack", pack)]

#: Trained models and interleaves have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; a stage's table goes once the next one is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    with Scratch(spark) as scratch:
        for name, stage in STAGES:
            docs = scratch.keep(stage(spark, docs, sf_dir), name, result=name == STAGES[-1][0])
            if before is not None:
                scratch.drop(before)
            before = name
    return docs
