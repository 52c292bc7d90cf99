"""Reachability, connected components and hierarchy steps over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.session import stage_table


def closure(edges: DataFrame, reflexive: bool = False) -> DataFrame:
    """(src, dst, depth): shortest paths of one step or more, cycles included; with ``reflexive`` each node to itself at 0.

    Breadth first from all sources at once: each round joins the frontier with the edges and keeps pairs not seen yet.
    Every round is written to the shared folder, so lineage stays short and a lost executor costs one round.
    """
    edges = stage_table(edges.select("src", "dst").filter("src is not null and dst is not null").distinct(), "edges")
    seen = stage_table(edges.withColumn("depth", F.lit(1)), "pairs")
    front = seen
    depth = 1
    while True:
        depth += 1
        step = front.select("src", F.col("dst").alias("via")).join(edges.select(F.col("src").alias("via"), "dst"), "via").select("src", "dst").distinct()
        fresh = stage_table(step.join(seen.select("src", "dst"), ["src", "dst"], "left_anti").withColumn("depth", F.lit(depth)), "pairs")
        if fresh.isEmpty():
            break
        seen = seen.unionByName(fresh)
        front = fresh
    if reflexive:
        nodes = edges.select("src").union(edges.select("dst")).distinct()
        same = nodes.select("src", F.col("src").alias("dst"), F.lit(0).alias("depth"))
        seen = same.unionByName(seen.filter("src <> dst"))
    return seen


def reachable(edges: DataFrame, start: str, goal: str) -> DataFrame:
    """One row ``answer``: whether ``goal`` is reached from ``start`` by zero or more edges; only that frontier is walked."""
    spark = edges.sparkSession
    if start == goal:
        return spark.createDataFrame([(True,)], "answer boolean")
    edges = stage_table(edges.select("src", "dst").distinct(), "edges")
    seen = front = spark.createDataFrame([(start,)], "node string")
    while True:
        step = front.join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        front = stage_table(step.join(seen, "node", "left_anti"), "front")
        if front.isEmpty():
            return spark.createDataFrame([(False,)], "answer boolean")
        if not front.filter(F.col("node") == goal).isEmpty():
            return spark.createDataFrame([(True,)], "answer boolean")
        seen = seen.unionByName(front)


def components(edges: DataFrame) -> DataFrame:
    """(node, component): connected components, named by their least node, by hash-to-least with label jumps."""
    both = edges.select("src", "dst").filter("src is not null and dst is not null")
    both = stage_table(both.union(both.select("dst", "src")).distinct(), "edges")
    label = stage_table(both.groupBy(F.col("src").alias("node")).agg(F.least(F.min("dst"), F.min("src")).alias("component")), "labels")
    while True:
        near = both.join(label.select(F.col("node").alias("src"), "component"), "src").groupBy(F.col("dst").alias("node")).agg(F.min("component").alias("near"))
        step = label.join(near, "node").select("node", F.least("component", "near").alias("best"), F.col("component").alias("before"))
        up = label.select(F.col("node").alias("best"), F.col("component").alias("up"))
        step = stage_table(step.join(up, "best", "left").select("node", F.least("best", F.coalesce("up", "best")).alias("component"), "before"), "labels", instead_of=label)
        if step.filter("component <> before").isEmpty():
            return step.select("node", "component")
        label = step
