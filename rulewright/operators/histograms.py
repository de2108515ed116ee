"""Histograms, cumulative shares and equalisation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def histogram_cdf(df: DataFrame, bin_col: str) -> DataFrame:
    """Counts, share and cumulative share of each bin; the window runs over the bins only."""
    counts = df.groupBy(bin_col).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    upto = F.sum("n").over(Window.orderBy(bin_col).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return counts.select(bin_col, "n", (F.col("n") / total).alias("pdf"), (upto / total).alias("cdf"))


def equalize(df: DataFrame, bin_col: str, cdf: DataFrame, top: int = 255) -> DataFrame:
    """Each value through the cumulative share of its bin."""
    return df.join(cdf.select(bin_col, "cdf"), bin_col).withColumn("equalized", F.floor(F.col("cdf") * top).cast("int")).drop("cdf")


def masked_stats(df: DataFrame, keys: list[str], value: str, low: float = 60, high: float = 200) -> DataFrame:
    """Mean, population deviation, and shares below and above two limits."""
    v = F.col(value)
    return df.groupBy(*keys).agg(
        F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.avg((v < low).cast("double")).alias("low_share"), F.avg((v > high).cast("double")).alias("high_share")
    )
