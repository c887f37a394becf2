"""The driver's tables read as a lineage log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events: arrival is event_id, a run lasts `value` seconds, channels take turns."""
    channel = F.element_at(F.array(F.lit("post_hook"), F.lit("run_wrapper"), F.lit("history_signal")), (F.col("event_id") % 3 + 1).cast("int"))
    start = F.col("ts").cast("timestamp")
    end = F.timestamp_micros(F.unix_micros(start) + (F.floor(F.col("value") * 1000) * 1000).cast("bigint"))
    return load(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.col("user_id").alias("session_id"), F.col("event_type").alias("algorithm_id"), F.col("props").alias("parameters"), start.alias("start_ts"), end.alias("end_ts"), channel.alias("channel"),
        F.when(F.col("event_type") == "error", "failed").otherwise("completed").alias("status"), F.concat("event_type", F.lit("|"), F.coalesce("props", F.lit(""))).alias("dedup_group"),
    )


def order_status(code: Column) -> Column:
    return F.when(code == "O", "completed").when(code == "F", "failed").when(code == "P", "cancelled")


def activities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("session_id"), F.col("o_orderpriority").alias("algorithm_id"), order_status(F.col("o_orderstatus")).alias("status"), F.col("o_orderdate").alias("started_at"))


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem: orders use the parts of lines with status F and make those of status O."""
    lines = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linestatus", "l_returnflag").distinct()
    used = F.col("l_linestatus") == "F"
    return lines.select(
        F.when(used, "used").otherwise("wasGeneratedBy").alias("relation_type"), F.when(used, F.col("l_orderkey")).otherwise(F.col("l_partkey")).alias("source_id"), F.when(used, F.col("l_partkey")).otherwise(F.col("l_orderkey")).alias("target_id"),
        F.when(used & (F.col("l_returnflag") == "R"), "overlay").when(used, "input").otherwise("output").alias("role"), F.col("l_orderkey").alias("activity_id"), F.col("l_partkey").alias("entity_id"),
    )


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct (session_id, activity_id, file_path). Orders and parts have ids of their own, so the ends are told apart by the edge's type."""
    pairs = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("activity_id"), F.col("l_partkey").alias("file_path")).distinct()
    return pairs.join(activities(spark, sf_dir).select(F.col("id").alias("activity_id"), "session_id"), "activity_id")


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem: each day on which a part shipped is a version of it."""
    from pyspark.sql.window import Window

    days = load(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("path"), F.col("l_shipdate").alias("at")).distinct()
    return days.withColumn("version", F.row_number().over(Window.partitionBy("path").orderBy("at")).cast("bigint"))
