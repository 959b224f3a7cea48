"""Documents to packed sequences: quality, line dedup, near-dedup, decontamination, packing.

Each stage takes a documents table (doc_id, text, lang and any further columns) and all but the last return its
columns. Null and empty texts fail the quality rules; where a stage is given them alone, the other stages keep them.
Repeated rows are repeated rows, except in near_dedup, which keeps one of each group. Null ids are ids like any other
that no label names. Empty tables give empty results at every stage.

A stage's tables in the shared folder are deleted once no result reads them; each stage begins by seeing to that, so the
disk holds one stage's tables at a time, and results of several runs can be alive together.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from pointloom.llm.common import table, tidy, written
from pointloom.llm.decontaminate import keep_clean
from pointloom.llm.linededup import cut_repeats
from pointloom.llm.packing import pack
from pointloom.llm.quality import keep_good
from pointloom.llm.simhash import keep_one

#: Bits in which the fingerprints of near-duplicates may differ: as many as the two segments find without further look-ups.
NEAR = 3

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def stage(fn: Stage) -> Stage:
    @wraps(fn)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        tidy(spark)
        return fn(spark, docs, sf_dir)

    return run_stage


@stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go; cutoffs are learnt from the labels of those that come in."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


@stage
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Runs of lines of 50 words or more that stand earlier are cut out of the texts."""
    return cut_repeats(docs)


@stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: that with the smallest id."""
    return keep_one(docs, NEAR)


@stage
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go."""
    return keep_clean(docs, table(spark, sf_dir, "benchmark"))


@stage
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their token ids and their places in the sequences."""
    return pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: Hashes, components and token ids are beyond SQL; tests hold ``run`` against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over all documents, each written as Parquet and read again as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = written(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
