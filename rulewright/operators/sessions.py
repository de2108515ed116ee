"""Conversation state: tails, counters, carried and latest values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tail_after_last(df: DataFrame, key: str, order: str, marker: Column) -> DataFrame:
    """Rows after the last marker row of each key; all rows if there is none."""
    last = F.max(F.when(marker, F.col(order))).over(Window.partitionBy(key))
    return df.withColumn("__last", last).where(F.col("__last").isNull() | (F.col(order) > F.col("__last"))).drop("__last")


def turn_counter(df: DataFrame, key: str, order: str, reset: Column, cap: int) -> DataFrame:
    """Rows since the last reset row, capped."""
    w = Window.partitionBy(key).orderBy(order)
    island = df.withColumn("__island", F.sum(reset.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    rn = F.row_number().over(Window.partitionBy(key, "__island").orderBy(order))
    return island.withColumn("iteration", F.least(rn - F.when(F.col("__island") > 0, 1).otherwise(0), F.lit(cap)).cast("int")).drop("__island")


def carry_forward(df: DataFrame, key: str, order: str, value: Column, name: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(w))


def summary(df: DataFrame, key: str, order: str, role: str, text: str) -> DataFrame:
    """First user text (200 characters), latest user text, last non-empty assistant text, counts."""
    user, said = F.col(role) == "user", F.coalesce(F.col(text), F.lit("")) != ""
    assistant = (F.col(role) == "assistant") & said
    return df.groupBy(key).agg(
        F.min_by(F.when(user, F.substring(text, 1, 200)), F.when(user, F.col(order))).alias("goal"),
        F.max_by(F.when(user, F.col(text)), F.when(user, F.col(order))).alias("latest_user"),
        F.max_by(F.when(assistant, F.col(text)), F.when(assistant, F.col(order))).alias("latest_answer"),
        F.count("*").alias("n_rows"),
        F.count_if(user).alias("n_user"),
    )


def after_offset(df: DataFrame, keys: list[str], order: str, offset: int) -> DataFrame:
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return df.withColumn("position", rn).where(F.col("position") > offset)


def keep_best(df: DataFrame, keys: list[str], metric: str, tie: str, k: int) -> DataFrame:
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(metric, tie))
    return df.withColumn("rank", rn).where(F.col("rank") <= k)


def stages_done(scores: Column, recommendations: Column, evidence: Column) -> Column:
    """Which stages have results, and whether they suffice: scores, and recommendations or evidence."""
    held = {"scores": scores, "recommendations": recommendations, "evidence": evidence}
    has = {k: F.coalesce(F.size(v), F.lit(0)) > 0 for k, v in held.items()}
    done = F.array_join(F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in has.items()))), ",")
    return F.struct(done.alias("done"), (has["scores"] & (has["recommendations"] | has["evidence"])).alias("sufficient"))


def gap_sessions(df: DataFrame, key: str, ts: str, turn: str, role: str, text: str, gap: str) -> DataFrame:
    """Sessions of each key in a table: rows of which none follows the one before by more than the gap; every session, the last one too."""
    w = Window.partitionBy(key).orderBy(ts, turn)
    silent = F.col(ts) > F.lag(ts).over(w) + F.expr(f"INTERVAL {gap}")
    islands = df.withColumn("__no", F.sum(F.coalesce(silent, F.lit(False)).cast("int")).over(w))
    order, user = F.struct(ts, turn), F.col(role) == "user"
    goal = F.min_by(F.when(user, F.substring(text, 1, 200)), F.when(user & F.col(text).isNotNull(), order))
    out = islands.groupBy(key, "__no").agg(
        F.min(ts).alias("started"), F.max(ts).alias("ended"), F.count("*").alias("n_rows"), F.count_if(user).alias("n_user"), goal.alias("goal"), F.max_by(role, order).alias("last_role")
    )
    return out.drop("__no")
