"""Range joins by an interval index: each value meets the first interval that holds it.

The end points of a key's intervals cut its line into points and the gaps between
them. An interval covers a run of these segments, which splits into at most two
nodes of each level of a binary tree over the segments; a node keeps its first
interval (a grouped minimum), and a segment's winner is the first of the nodes
above it. So building takes rows times the logarithm of the points, however the
intervals overlap, and no value meets more than one row: the points of a key lie
in blocks of ``BLOCK``, a value finds its block among the first points of the
blocks and its segment inside the block, both by halving, and the join between
is an equi-join on key and block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rulewright.operators.labels import chunk_of, quantile_cuts
from rulewright.operators.sides import small

#: Points of a block.
BLOCK = 512


def last_at_most(array: Column, value: Column, at: str | None = None, bits: int = 31) -> Column:
    """How many entries of an ascending array (or of its entries' field ``at``) are at most the value, by halving."""

    def step(found: Column, size: Column) -> Column:
        entry = F.try_element_at(array, found + size)
        entry = entry if at is None else entry[at]
        return F.when(F.coalesce(entry <= value, F.lit(False)), found + size).otherwise(found)

    return F.aggregate(F.array(*(F.lit(1 << b) for b in reversed(range(bits)))), F.lit(0), step)


def _numbered(points: DataFrame, keys: list[str]) -> DataFrame:
    """Number the points of each key from 1 in ascending order: inside chunks of all points, plus the earlier chunks of the key."""
    cuts = points.agg(quantile_cuts("p").alias("cuts")).first()["cuts"]
    cut = points.withColumn("chunk", chunk_of(F.col("p"), cuts))
    sizes = cut.groupBy(*keys, "chunk").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*keys).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    local = F.row_number().over(Window.partitionBy(*keys, "chunk").orderBy("p"))
    joined = cut.withColumn("local", local).join(sizes.select(*keys, "chunk", before.alias("before")), [*keys, "chunk"])
    return joined.select(*keys, "p", (F.col("local") + F.col("before")).alias("at"))


def build_index(intervals: DataFrame, keys: list[str], lo: Column, hi: Column, order: list[Column]) -> DataFrame:
    """``keys, block, entries``: entries are (p, here, after), the intervals that win at the point and in the gap behind it.

    An interval is closed; one that runs backwards, or has a null bound or key, holds nothing.
    ``order`` must tell the intervals of a key apart.
    """
    own = [f"k{i}" for i in range(len(keys))]
    held = intervals.select(*(F.col(k).alias(n) for k, n in zip(keys, own, strict=True)), lo.cast("double").alias("lo"), hi.cast("double").alias("hi"), F.struct(*order).alias("ord"), F.struct(*intervals.columns).alias("hit"))
    held = held.where("lo <= hi").dropna(subset=own) if own else held.where("lo <= hi")
    points = _numbered(held.select(*own, F.explode(F.array("lo", "hi")).alias("p")).distinct(), own)
    levels = (2 * (points.agg(F.max("at")).first()[0] or 1)).bit_length()
    level = F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("level")

    # A point is segment 2 at - 1, the gap behind it segment 2 at.
    def ends(name: str) -> DataFrame:
        return points.select(*own, F.col("p").alias(name), (2 * F.col("at") - 1).alias(f"{name}_at"))

    runs = held.join(ends("lo"), [*own, "lo"]).join(ends("hi"), [*own, "hi"]).select(*own, "ord", "hit", "lo_at", "hi_at", level)
    sides = runs.select(*own, "ord", "hit", "level", F.expr("shiftright(lo_at + shiftleft(1L, level) - 1, level)").alias("a"), F.expr("shiftright(hi_at + 1, level)").alias("b")).where("a < b")
    nodes = sides.select(*own, "ord", "hit", "level", F.explode(F.expr("filter(array(if(a % 2 = 1, a, null), if(b % 2 = 1, b - 1, null)), x -> x is not null)")).alias("node"))
    first = nodes.groupBy(*own, "level", "node").agg(F.min_by("hit", "ord").alias("hit"), F.min("ord").alias("ord"))
    above = points.select(*own, "at", level).select(*own, "at", "level", F.inline(F.expr("array(struct(true as here, shiftright(2 * at - 1, level) as node), struct(false as here, shiftright(2 * at, level) as node))")))
    best = above.join(first, [*own, "level", "node"]).groupBy(*own, "at").agg(*(F.min_by(F.when(side, F.col("hit")), F.when(side, F.col("ord"))).alias(n) for n, side in (("here", F.col("here")), ("after", ~F.col("here")))))
    entries = F.array_sort(F.collect_list(F.struct("p", "here", "after")), lambda a, b: F.when(a["p"] < b["p"], -1).when(a["p"] > b["p"], 1).otherwise(0))
    blocks = points.join(best, [*own, "at"], "left").groupBy(*own, F.expr(f"(at - 1) div {BLOCK}").alias("block")).agg(entries.alias("entries"))
    return blocks.withColumnsRenamed(dict(zip(own, keys, strict=True)))


def first_interval(subjects: DataFrame, intervals: DataFrame, value: Column, keys: list[str], lo: Column, hi: Column, order: list[Column], hit: str, how: str = "inner") -> DataFrame:
    """Each row of ``subjects`` with ``hit``, the first interval of its keys (all columns, as a struct) that holds its value.

    Subjects may repeat: a row in is a row out. ``how`` is inner, or left to keep
    rows that no interval holds. Keys are columns of both sides; none means one line for all.
    """
    index = build_index(intervals, keys, lo, hi, order).withColumnsRenamed({**{k: f"__{k}" for k in keys}, "block": "__block", "entries": "__entries"})
    starts = index.groupBy(*(f"__{k}" for k in keys)).agg(F.sort_array(F.collect_list(F.col("__entries")[0]["p"])).alias("__starts"))
    asked = subjects.withColumn("__value", value.cast("double"))
    same = [F.col(k) == F.col(f"__{k}") for k in keys]
    if keys:
        found = asked.join(small(starts), same, "left").drop(*(f"__{k}" for k in keys))
    else:
        found = asked.withColumn("__starts", starts.scalar())
    found = found.withColumn("__at", (last_at_most(F.col("__starts"), F.col("__value"), bits=24) - 1).cast("long")).drop("__starts")
    met = found.join(small(index), [*same, F.col("__at") == F.col("__block")], "left")
    place = last_at_most(F.col("__entries"), F.col("__value"), "p", BLOCK.bit_length())
    met = met.withColumn("__entry", F.try_element_at("__entries", F.nullif(place, F.lit(0))))
    met = met.withColumn(hit, F.when(F.col("__entry")["p"] == F.col("__value"), F.col("__entry")["here"]).otherwise(F.col("__entry")["after"]))
    met = met if how == "left" else met.where(F.col(hit).isNotNull())
    return met.select(*subjects.columns, hit)
