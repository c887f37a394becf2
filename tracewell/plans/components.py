"""Connected components by alternating large-star and small-star steps.

Each step is a minimum per node (combined before the shuffle) and a join of the edges with it. A node with very many edges is
one row on the minimum's side, so adaptive execution can split it. Rounds grow with the logarithm of a component's size.
Every round is a stored table; rounds end when all edges form stars. The driver sees one truth value a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.plans.tables import stored


def _pull(edges: DataFrame, lowest: DataFrame) -> DataFrame:
    return edges.join(lowest.withColumnRenamed("u", "__u"), F.col("u") == F.col("__u")).drop("__u")


def _stars(edges: DataFrame) -> bool:
    """Does every node hang on one other at most, and nothing on those that hang?"""
    ends = edges.select(F.col("u").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionAll(edges.select(F.col("v").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    sums = ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return sums.where((F.col("up") > 1) | ((F.col("up") == 1) & (F.col("down") == 1))).isEmpty()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node that has an edge; component is its smallest node. Self-loops and null ends are ignored."""
    pairs = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    now = stored(pairs.distinct(), "cc-edges")
    for _ in range(max_rounds):
        # large star: hang larger neighbours on the smallest neighbour
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.min("v").alias("m"))
        large = _pull(both, lowest).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
        large = stored(large, "cc-large")
        # small star: hang smaller neighbours, and the node itself, on the smallest one
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = _pull(large, lowest).where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = stored(small.unionAll(lowest.select("u", F.col("m").alias("v"))).distinct(), "cc-small")
        if _stars(now):
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(roots)
