"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.plans.skew import attach
from marginalia.plans.storage import discard, materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over rows (u, v) with u > v: hang the larger (or smaller) neighbours of a node on its minimum."""
    near = edges.select("u", "v")
    if large:
        near = near.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = near.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    low = low.withColumn("m", F.least("m", "u"))
    out = attach(near, low, "u", ["m"], "n", F.struct("u", "v"))
    if large:
        out = out.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = out.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(out.select("u", F.col("m").alias("v")))
    return out.filter(F.col("u") != F.col("v")).distinct()


def connected_components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(node, root) for every node of the long edges (a, b); root is the smallest node of the component.

    Each round is written to the shared folder, so a lost executor costs one round at most; nothing is collected
    but two numbers. An empty input gives an empty result.
    """
    a, b = F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    now = materialize(edges.select(a, b).filter(F.col("u") != F.col("v")).distinct(), "edges")
    seen = None
    for _ in range(max_rounds):
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark[0] == 0 or tuple(mark) == seen:
            break
        seen = tuple(mark)
        was, now = now, materialize(_star(_star(now, True), False), "edges")
        discard(was)
    else:
        raise RuntimeError("components did not settle")
    roots = now.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")
    return roots.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
