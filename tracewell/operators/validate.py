"""Constraints that Parquet doesn't enforce."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell import schemas


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with n. Rows with a null in the key never collide."""
    whole = F.lit(True)
    for k in keys:
        whole = whole & F.col(k).isNotNull()
    return df.where(whole).groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > 1)


def orphans(df: DataFrame, column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    """Rows whose non-null reference has no parent."""
    return df.where(F.col(column).isNotNull()).join(parent.select(F.col(parent_column).alias("__p")), F.col(column) == F.col("__p"), "left_anti")


def failing(df: DataFrame, predicate: str) -> DataFrame:
    return df.where(~F.coalesce(F.expr(predicate), F.lit(False)))


def violations(name: str, rows: DataFrame, existing: DataFrame, parents: dict[str, DataFrame]) -> DataFrame:
    """(problem, example) of rows that can't be added to table `name`; empty if all can.

    Of what exists only the keys of rows are looked up, by inner joins whose small side is rows, so a check's shuffles don't grow with the table.
    """
    found = rows.sparkSession.createDataFrame([], "problem string, example string")

    def add(problem: str, bad: DataFrame, example: str) -> None:
        nonlocal found
        found = found.unionAll(bad.select(F.lit(problem).alias("problem"), F.col(example).cast("string").alias("example")))

    for keys in schemas.UNIQUE.get(name, ()):
        if set(keys) <= set(rows.columns):
            message = f"{', '.join(keys)} not unique"
            add(message, duplicates(rows, list(keys)), keys[0])
            add(message, existing.select(*keys).join(rows.select(*keys).distinct(), list(keys)), keys[0])
    for column, parent, parent_column in schemas.FOREIGN.get(name, ()):
        asked = rows.select(column).where(F.col(column).isNotNull()).distinct()
        there = parents[parent].select(F.col(parent_column).alias(column)).join(asked, column).distinct()
        add(f"{column} has no row in {parent}", asked.join(there, column, "left_anti"), column)
    if name in schemas.CHECKS:
        add("value outside its domain", failing(rows, schemas.CHECKS[name]), "id")
    for column in schemas.NOT_NULL.get(name, ()):
        add(f"{column} is null", rows.where(F.col(column).isNull()), "id")
    return found
