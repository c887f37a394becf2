"""Workflows: activities of a session that share datasets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracewell.functions import fixed
from tracewell.functions.scalars import derived_id, suggested_name
from tracewell.plans.components import connected_components
from tracewell.plans.tables import stored


def session_datasets(activities: DataFrame, relations: DataFrame, entities: DataFrame) -> DataFrame:
    """Distinct (session_id, activity_id, file_path). An edge may point either way; two equi-joins take the place of a join on OR."""
    edges = relations.where(F.col("relation_type").isin("used", "wasGeneratedBy"))
    ends = edges.select(F.col("source_id").alias("activity_id"), F.col("target_id").alias("entity_id")).unionAll(edges.select(F.col("target_id").alias("activity_id"), F.col("source_id").alias("entity_id")))
    named = entities.where(F.col("file_path").isNotNull()).select(F.col("id").alias("entity_id"), "file_path")
    return ends.join(activities.select(F.col("id").alias("activity_id"), "session_id"), "activity_id").join(named, "entity_id").select("session_id", "activity_id", "file_path").distinct()


def session_components(activities: DataFrame, links: DataFrame, *, ident: str = "id", session: str = "session_id", activity: str = "activity_id", path: str = "file_path") -> DataFrame:
    """(activity, component) for every activity; component is the smallest activity that is reached over shared paths of a session.

    Activities on a path hang on the path's smallest one, so a path with many of them is a star and not all pairs.
    """
    known = links.where(F.col(path).isNotNull()).join(activities.select(F.col(ident).alias(activity), F.col(session).alias("__session")), activity)
    smallest = known.groupBy("__session", path).agg(F.min(activity).alias("__low"))
    edges = known.join(smallest, ["__session", path]).select(F.col(activity).alias("a"), F.col("__low").alias("b"))
    found = connected_components(edges)
    out = activities.select(F.col(ident).alias("activity")).join(found.withColumnRenamed("node", "activity"), "activity", "left")
    return out.select("activity", F.coalesce("component", "activity").alias("component"))


def in_sequence(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """df with sequence_order from 0 in each group."""
    return df.withColumn("sequence_order", (F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1).cast("int"))


def titles(df: DataFrame, keys: list[str], order: str, name: str) -> DataFrame:
    """Suggested name of each group."""
    return df.groupBy(*keys).agg(suggested_name(F.transform(F.array_sort(F.collect_list(F.struct(order, name))), lambda x: x[name])).alias("suggested_name"))


def list_workflows(workflows: DataFrame, members: DataFrame) -> DataFrame:
    """Workflows with their number of activities, newest first."""
    n = members.groupBy(F.col("workflow_id").alias("id")).agg(F.count("activity_id").alias("activity_count"))
    return workflows.join(n, "id", "left").withColumn("activity_count", F.coalesce("activity_count", F.lit(0))).orderBy(F.desc("created_at"), "id")


def regroup(activities: DataFrame, links: DataFrame, workflows: DataFrame, members: DataFrame) -> dict[str, DataFrame]:
    """Groups of the sessions in activities, reconciled with the workflows on record.

    A group keeps the oldest workflow that it overlaps; others that it overlaps, and workflows left without a group, are deleted. A workflow
    is renamed only if its name is what its earlier members suggest, or none. Result: workflows (id, name, session_id, created_at), members
    (workflow_id, activity_id, sequence_order) and deleted (workflow_id).
    """
    groups = stored(session_components(activities, links), "regroup-components")
    act = activities.select(F.col("id").alias("activity"), "session_id", "started_at", F.coalesce(F.nullif(F.trim("algorithm_name"), F.lit("")), "algorithm_id").alias("step"))
    placed = stored(in_sequence(groups.join(act, "activity"), ["component"], F.col("started_at"), F.col("activity")), "regroup-placed")
    named = titles(placed, ["component"], "sequence_order", "step")
    mine = workflows.join(activities.select("session_id").distinct(), "session_id", "left_semi").select(F.col("id").alias("workflow_id"), F.col("name").alias("old_name"), "session_id", F.col("created_at").alias("old_created"))
    before = members.join(mine.select("workflow_id"), "workflow_id", "left_semi")
    old_steps = before.join(act, F.col("activity_id") == F.col("activity")).select("workflow_id", "started_at", "activity", "step")
    old_title = titles(in_sequence(old_steps, ["workflow_id"], F.col("started_at"), F.col("activity")), ["workflow_id"], "sequence_order", "step")
    # each workflow goes to the first group that overlaps it, each group takes its oldest workflow
    overlap = before.join(groups, F.col("activity_id") == F.col("activity")).select("workflow_id", "component").distinct()
    head = placed.where(F.col("sequence_order") == 0).select("component", F.struct("started_at", F.col("activity").alias("x")).alias("first"))
    overlap = overlap.join(head, "component").groupBy("workflow_id").agg(F.min_by("component", "first").alias("component"))
    kept = overlap.join(mine, "workflow_id").groupBy("component").agg(F.min(F.struct("old_created", "workflow_id")).alias("k")).select("component", F.col("k.workflow_id").alias("workflow_id"))
    kept = stored(kept, "regroup-kept")
    full = named.join(head, "component").join(kept, "component", "left").join(mine.drop("session_id"), "workflow_id", "left").join(old_title.withColumnRenamed("suggested_name", "old_title"), "workflow_id", "left")
    sessions = placed.where(F.col("sequence_order") == 0).select("component", "session_id", "started_at")
    full = full.join(sessions, "component").withColumn("id", F.coalesce("workflow_id", derived_id(F.lit("workflow"), "component")))
    old = F.trim(F.coalesce("old_name", F.lit("")))
    auto = (old == "") | (old == fixed.UNNAMED) | (old == F.coalesce("old_title", F.lit("")))
    result = full.select("id", F.when(auto, F.col("suggested_name")).otherwise(F.col("old_name")).alias("name"), "session_id", F.coalesce("old_created", "started_at").alias("created_at"), "component")
    result = stored(result, "regroup-workflows")
    rows = placed.join(result.select("component", F.col("id").alias("workflow_id")), "component").select("workflow_id", F.col("activity").alias("activity_id"), "sequence_order")
    return {"workflows": result.drop("component"), "members": rows, "deleted": mine.select("workflow_id").join(kept.select("workflow_id"), "workflow_id", "left_anti")}


def user_name(name: str | None) -> str | None:
    """A name a person gives; blank ones are ignored."""
    return (name or "").strip() or None
