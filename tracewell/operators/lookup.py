"""Lookups, filters, latest rows and orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def by_key(df: DataFrame, column: str, value: object) -> DataFrame:
    return df.where(F.col(column) == F.lit(value))


def by_keys(df: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """Rows whose column is among the only column of keys."""
    return df.join(keys.toDF("__k").distinct(), F.col(column) == F.col("__k"), "left_semi")


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n")
        out = one if out is None else out.unionAll(one)
    return out


def prefix_range(df: DataFrame, column: str, prefix: str, low: str = "|", high: str = "}") -> DataFrame:
    """Rows whose column begins with prefix + low, as a half-open range that reaches the scan."""
    return df.where((F.col(column) >= prefix + low) & (F.col(column) < prefix + high))


def latest(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order; groups are limited before the shuffle."""
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__r", first).where(F.col("__r") == 1).drop("__r")


def above_mark(df: DataFrame, column: str, mark: int) -> DataFrame:
    return df.where(F.col(column) > mark)


def numbered_labels(df: DataFrame, label: str, *order: Column) -> DataFrame:
    """df with `shown`: the label, with ' #n' from the second one on."""
    place = F.row_number().over(Window.partitionBy(label).orderBy(*order))
    return df.withColumn("shown", F.when(place == 1, F.col(label)).otherwise(F.concat(F.col(label), F.lit(" #"), place.cast("string"))))
