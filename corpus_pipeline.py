"""The corpus pipeline: five stages over `documents`, each written as Parquet and read again by the next.

Nulls and edge cases: null, empty and blank texts fail the quality rules' base and go; null ids, languages and sources are values like others, and
a null id is never preferred to another; repeated rows are near copies, of which one stays; ties go to the smaller id, then to the earlier row; very long
texts are taken whole by every stage and cut into pieces only by the last; extra columns are passed on by all but the last stage, whatever
their names, and ignored by the last; an empty table gives an empty result; without labels the quality rules' base decides alone.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm.common import free_name, stored, table
from tracewell.llm.queries import byte_vocabulary
from tracewell.plans.tables import drop_stored, in_few_files, stored_so_far

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _stage(stage: Stage) -> Stage:
    """The stage with its result in few files, whoever writes it."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        return in_few_files(stage(spark, docs, sf_dir))

    return run


@_stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules, learned from the labels, don't reject."""
    from tracewell.llm.quality_rules import fit, keep

    return keep(docs, fit(docs, table(spark, sf_dir, "labels")))


@_stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8 or more."""
    from tracewell.llm.near_dedup import keep_one

    return keep_one(docs, shingle=5)


@_stage
def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 200 bytes or more that occur elsewhere too are cut out; documents that were nothing else go."""
    from tracewell.llm.suffix_dedup import strip

    before = free_name(docs, "__empty")
    marked = docs.withColumn(before, F.coalesce(F.length("text"), F.lit(0)) == 0)
    cut = strip(marked)
    # an empty result of a cut goes; what was empty before isn't this stage's business
    cut = cut.where(F.col(before) | (F.length("text") > 0)).drop(before)
    sizes = {"n_chars": F.length("text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {}
    return cut.withColumns(sizes).select(*docs.columns)


@_stage
def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: not at all, once or twice."""
    from tracewell.llm.mixing import taken_rows

    return taken_rows(docs)


@_stage
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the mixed documents with their places in sequences of 2048 tokens."""
    from tracewell.llm.packing import pack

    return pack(docs, vocabulary=byte_vocabulary())


STAGES: list[tuple[str, Stage]] = [("quality", quality), ("near_dedup", near_dedup), ("suffix_dedup", suffix_dedup), ("mixing", mixing), ("packing", packing)]

#: The learned rules, chosen paths and packing have no SQL; tests hold run() and each stage against plain Python.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. A stage's intermediate tables, and the documents it read, are deleted once its result is written."""
    docs, before = table(spark, sf_dir, "documents"), stored_so_far()
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs, f"pipeline-{name}")
            drop_stored(spark, since=before, last=False)
    return docs
