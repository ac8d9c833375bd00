"""Reachability over dependencies, by frontiers that are written out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.checks import ValidationError
from tidemark.sources.shared import written

COMPACT = 8


def reachable(edges: DataFrame, start: DataFrame, *, most: int = 1000) -> DataFrame:
    """(node) reached from start (node) along edges (source, target), start itself only if a path leads back to it.

    Each step joins only nodes that the step before was the first to reach, so cycles end; more than ``most`` steps raise.
    Every COMPACT steps what was reached is written as one table, so that long paths don't read ever more small ones.
    """
    seen = front = written(start.select("node").distinct(), "front")
    reached = None
    for step in range(1, most + 1):
        following = edges.join(front.withColumnRenamed("node", "source"), "source").select(F.col("target").alias("node")).distinct()
        fresh = written(following if reached is None else following.join(reached, "node", "left_anti"), "front")
        if fresh.isEmpty():
            return reached if reached is not None else seen.limit(0)
        reached = fresh if reached is None else reached.unionByName(fresh)
        if step % COMPACT == 0:
            reached = written(reached, "reached")
        front = fresh
    raise ValidationError("path too long")


def impacted_nodes(changed: DataFrame, dependencies: DataFrame) -> DataFrame:
    """(node) whose inputs, direct or not, changed; without the changed ones. dependencies: node, input."""
    edges = dependencies.select(F.col("input").alias("source"), F.col("node").alias("target"))
    return reachable(edges, changed.select("node")).join(changed.select("node"), "node", "left_anti")


def closes_cycle(edges: DataFrame, source: str, target: str) -> bool:
    """Whether an edge from source to target would close a cycle."""
    if source == target:
        return True
    spark = edges.sparkSession
    return not reachable(edges, spark.createDataFrame([(target,)], "node string")).where(F.col("node") == source).isEmpty()


def collectable(objects: DataFrame, edges: DataFrame, pins: DataFrame) -> DataFrame:
    """(node) of objects that no pin keeps, directly or through parents. edges: parent, child."""
    kept = reachable(edges.select(F.col("parent").alias("source"), F.col("child").alias("target")), pins.select("node"))
    return objects.select("node").join(kept.unionByName(pins.select("node")), "node", "left_anti")


def differing_input(old: DataFrame, new: DataFrame) -> DataFrame:
    """(input, change) between two derivations' inputs (name, ref)."""
    both = old.select(F.col("name"), F.col("ref").alias("_o")).join(new.select("name", F.col("ref").alias("_n")), "name", "full")
    change = F.when(F.col("_o").isNull(), "added").when(F.col("_n").isNull(), "removed").otherwise("replaced")
    return both.where(~F.col("_o").eqNullSafe(F.col("_n"))).select("name", change.alias("change"))
