"""Connected components of an edge table, by alternating large-star and small-star steps.

Every step is a grouped minimum (combined on the map side) and an equi-join, so
a node with very many neighbours is a skewed join at worst, which adaptive
execution splits. Edges never leave the executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulewright.storage import Workspace


def _ordered(edges: DataFrame) -> DataFrame:
    return edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
    return both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    low = edges.groupBy("u").agg(F.min("v").alias("low"))
    moved = edges.join(low, "u").where("v != low").select(F.col("v").alias("u"), F.col("low").alias("v"))
    return moved.unionByName(low.select("u", F.col("low").alias("v"))).distinct()


def connected_components(edges: DataFrame, ws: Workspace, label: str = "cc") -> DataFrame:
    """``edges(a, b)`` to ``(node, component)``, the smallest node of each component.

    Only nodes with an edge to another node appear. Null ends and loops are
    ignored; repeated edges count once; no edges give an empty table.
    """
    table = ws.save(_ordered(edges.dropna(subset=["a", "b"])), f"{label}-0")
    state, step = _fingerprint(table), 0
    while True:
        after = ws.save(_small_star(_large_star(table)), f"{label}-{step + 1}")
        ws.drop(f"{label}-{step}")
        seen, table, step = state, after, step + 1
        state = _fingerprint(table)
        if state == seen:
            break
    roots = table.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return table.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _fingerprint(edges: DataFrame) -> tuple:
    h = F.xxhash64("u", "v")
    row = edges.agg(F.count("*"), F.sum(h.bitwiseAND(0xFFFFFFFF)), F.sum(F.shiftrightunsigned(h, 32))).first()
    return tuple(row)
