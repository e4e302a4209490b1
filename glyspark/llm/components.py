"""Connected components of an edge table by alternating large-star and small-star steps.

Every step is a join and a minimum per node; nothing is collected but counts, and each round is written
to the shared folder, which cuts lineage and survives lost executors. The large star's minima are written before
their join, so that it is one of plain tables, and Spark may split a hub's edges over tasks (adaptive skew join).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from ._io import Workspace

ROUNDS = 60


def _starred(edges: DataFrame, both: bool, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """Hang each node's neighbours on its least neighbour: the larger ones (large star), or the smaller ones (small star)."""
    n = edges
    if both:
        n = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = keep(n.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
    linked = n.join(least, "u")
    if both:
        return linked.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame, work: Workspace, name: str = "cc") -> DataFrame:
    """(node, component) for every node of an edge table (u, v) of longs; component: the least node.

    Rows with a null and loops are ignored; no edges give no rows.
    """
    tidy = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v").distinct()
    now, before = work.save(tidy, f"{name}0"), None
    for k in range(1, ROUNDS):
        # Small star: each edge points from the larger node to the smaller.
        large = _starred(now, True, lambda df: work.save(df, f"{name}_least")).filter("u > v").distinct()
        now = work.save(_starred(large, False).filter("u > v").distinct(), f"{name}{k}")
        work.drop(f"{name}{k - 1}", f"{name}_least")
        sign = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if sign == before:
            break
        before = sign
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
