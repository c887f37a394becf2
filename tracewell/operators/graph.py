"""Reading the provenance graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.plans.tables import stored


def _semi(df: DataFrame, column: str, keys: DataFrame, how: str = "left_semi") -> DataFrame:
    return df.join(keys.toDF("__k"), F.col(column) == F.col("__k"), how)


def touching(relations: DataFrame, nodes: DataFrame, direction: str = "both") -> DataFrame:
    """Relations that leave (out), enter (in) or touch (both) any of nodes, each once; self-loops too."""
    out, into = _semi(relations, "source_id", nodes), _semi(relations, "target_id", nodes)
    if direction == "out":
        return out
    if direction == "in":
        return into
    if direction == "both":
        return out.unionAll(_semi(into, "source_id", nodes, "left_anti"))
    raise ValueError(f"direction is 'in', 'out' or 'both', not {direction!r}")


def endpoints(relations: DataFrame) -> DataFrame:
    return relations.select(F.col("source_id").alias("node")).unionAll(relations.select(F.col("target_id").alias("node"))).distinct()


def workflow_graph(tables: dict[str, DataFrame], workflow_id: str) -> dict[str, DataFrame]:
    """{workflow, activities, entities, agents, relations} of one workflow; an unknown id is an error."""
    workflow = tables["workflows"].where(F.col("id") == workflow_id)
    if workflow.isEmpty():
        raise ValueError(f"no workflow {workflow_id!r}")
    member = tables["workflow_activities"].where(F.col("workflow_id") == workflow_id).select(F.col("activity_id").alias("id"), "sequence_order")
    activities = tables["activities"].join(member, "id").orderBy(F.asc_nulls_first("sequence_order"), "started_at", "id")
    ids = member.select("id")
    first = touching(tables["relations"], ids)
    others = _semi(endpoints(first), "node", ids, "left_anti")
    entities, agents = _semi(tables["entities"], "id", others), _semi(tables["agents"], "id", others)
    own = entities.select("id")
    between = _semi(_semi(tables["relations"], "source_id", own), "target_id", own)
    between = between.join(first.select("id"), "id", "left_anti")
    return {"workflow": workflow, "activities": activities, "entities": entities, "agents": agents, "relations": first.unionByName(between)}


def files_of_jobs(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """(activity_id, file_path, way): datasets that each job read or made."""
    read = relations.where(F.col("relation_type") == "used").select(F.col("source_id").alias("activity_id"), F.col("target_id").alias("e"), F.lit("read").alias("way"))
    made = relations.where(F.col("relation_type") == "wasGeneratedBy").select(F.col("target_id").alias("activity_id"), F.col("source_id").alias("e"), F.lit("made").alias("way"))
    return read.unionAll(made).join(entities.select(F.col("id").alias("e"), "file_path"), "e").select("activity_id", "file_path", "way").distinct()


def derived_from(relations: DataFrame) -> DataFrame:
    """Distinct (derived, origin): what a job made comes from what it read."""
    made = relations.where(F.col("relation_type") == "wasGeneratedBy").select(F.col("target_id").alias("job"), F.col("source_id").alias("derived"))
    read = relations.where(F.col("relation_type") == "used").select(F.col("source_id").alias("job"), F.col("target_id").alias("origin"))
    return made.join(read, "job").select("derived", "origin").distinct()


def lineage(edges: DataFrame, start: DataFrame, *, child: str = "derived", parent: str = "origin", max_depth: int = 1000) -> DataFrame:
    """(start, node, depth): everything that start nodes come from, with the least number of steps. Cycles end by themselves.

    The frontier moves one step a round and leaves behind what was seen; each round is a stored table.
    """
    frontier = stored(start.toDF("start").select("start", F.col("start").alias("node"), F.lit(0).cast("bigint").alias("depth")).distinct(), "lineage-0")
    seen = frontier
    links = edges.select(F.col(child).alias("node"), F.col(parent).alias("next")).distinct()
    for depth in range(1, max_depth + 1):
        step = frontier.join(links, "node").select("start", F.col("next").alias("node")).distinct()
        step = step.join(seen.select("start", "node"), ["start", "node"], "left_anti").withColumn("depth", F.lit(depth).cast("bigint"))
        frontier = stored(step, f"lineage-{depth}")
        if frontier.isEmpty():
            return seen
        seen = seen.unionByName(frontier)
        if depth % 8 == 0:  # else each round reads a table for every round before it
            seen = stored(seen, f"lineage-seen-{depth}")
    raise RuntimeError(f"lineage is deeper than {max_depth}")


def layers(edges: DataFrame, *, child: str = "derived", parent: str = "origin", max_depth: int = 1000) -> DataFrame:
    """(node, layer): length of the longest path from a node without parents. Edges must have no cycle."""
    links = edges.select(F.col(child).alias("c"), F.col(parent).alias("p")).distinct()
    nodes = links.select(F.col("c").alias("node")).unionAll(links.select(F.col("p").alias("node"))).distinct()
    now = stored(nodes.withColumn("layer", F.lit(0)), "layers-0")
    for depth in range(1, max_depth + 1):
        raised = links.join(now, F.col("p") == F.col("node")).groupBy(F.col("c").alias("node")).agg((F.max("layer") + 1).alias("up"))
        after = stored(now.join(raised, "node", "left").select("node", F.coalesce("up", F.lit(0)).alias("layer"), (F.coalesce("up", F.lit(0)) != F.col("layer")).alias("moved")), f"layers-{depth}")
        if after.where("moved").isEmpty():
            return after.drop("moved")
        now = after.drop("moved")
    raise RuntimeError(f"edges have a cycle or a path longer than {max_depth}")
