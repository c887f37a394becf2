"""Reports over the log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def channel_statistics(df: DataFrame, channel: Column, corroborations: Column) -> DataFrame:
    """(channel, activities, corroborations), unknown channels under that name."""
    rows = df.select(F.coalesce(channel, F.lit("unknown")).alias("channel"), corroborations.alias("__c"))
    return rows.groupBy("channel").agg(F.count("*").alias("activities"), F.coalesce(F.sum("__c"), F.lit(0)).cast("bigint").alias("corroborations"))


def breakdown(df: DataFrame, *by: str) -> DataFrame:
    """(by..., n)."""
    return df.groupBy(*by).agg(F.count("*").alias("n"))


def completeness(df: DataFrame, by: str, captured: Column) -> DataFrame:
    """(by, total, captured, percent)."""
    out = df.groupBy(by).agg(F.count("*").alias("total"), F.sum(captured.cast("bigint")).alias("captured"))
    return out.withColumn("percent", F.round(100.0 * F.col("captured") / F.col("total"), 4))


def spread(df: DataFrame, by: str, value: str) -> DataFrame:
    """Per group: n, mean, sample deviation and the half width of a 95 % interval."""
    out = df.groupBy(by).agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.stddev_samp(value).alias("s"))
    return out.select(by, "n", F.round("m", 4).alias("mean"), F.round("s", 4).alias("std"), F.round(1.96 * F.col("s") / F.sqrt("n"), 4).alias("ci95"))


def overhead(runs: DataFrame, by: str, tracked: str, seconds: str) -> DataFrame:
    """(by, percent): mean time with capture over mean time without."""
    means = runs.groupBy(by).agg(F.avg(F.when(F.col(tracked), F.col(seconds))).alias("w"), F.avg(F.when(~F.col(tracked), F.col(seconds))).alias("wo"))
    return means.select(by, F.round(100 * (F.col("w") / F.nullif("wo", F.lit(0.0)) - 1), 4).alias("percent"))


def bytes_per_operation(activities: DataFrame, by: str, size: Column) -> DataFrame:
    return activities.groupBy(by).agg(F.count("*").alias("operations"), F.round(F.sum(size) / F.count("*"), 4).alias("bytes_per_operation"))
