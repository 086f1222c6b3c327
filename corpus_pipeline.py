"""The corpus pipeline: quality rules, line dedup, MinHash near-dedup, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept, as that stage wrote it. All but
the last return the columns of ``documents``; the last returns the packed pieces.

Defined results: null and empty texts fail the quality rules; rows that share a doc_id are one document to line dedup and
near-dedup, and all of them stay or go; rows of null doc_id lose no lines and are in no group of near-duplicates, but are
judged, decontaminated and packed; of equal documents the one of least doc_id stays; texts of any length are read whole; an
empty table passes through every stage and gives no piece; columns beyond those of ``documents`` are carried up to the last
stage, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quire.llm import decontaminate, line_dedup, near_dedup, packing, quality_rules
from quire.llm.common import staged, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the likelihood ratio against the trusted ones."""
    return quality_rules.keep_good(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that an earlier line resembles; those with nothing left go."""
    return line_dedup.drop_lines(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, on five-word shingles at 0.8."""
    return near_dedup.keep_one_of_each(docs, shingle=5, percent=80)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark window."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences."""
    return packing.pack(docs)


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("minhash", near), ("decontamination", clean), ("packing", pack)]

#: No SQL expresses the near-duplicate and packing stages; tests/llm/test_pipeline.py holds brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, out, sf_dir)
        if k < len(STAGES) - 1:
            out = staged(out)
    return out
