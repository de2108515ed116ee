"""Evaluation: confusion, precision and recall, order statistics, intervals and exact tests."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rulewright.operators import labels
from rulewright.operators.labels import join_keys


def confusion(df: DataFrame, truth: str, pred: str, classes: list) -> DataFrame:
    """One row per true label, one column per predicted label of a fixed set."""
    table = df.groupBy(truth).pivot(pred, classes).count().na.fill(0)
    return table.select(truth, *(F.col(str(x)).alias(f"pred_{x}") for x in classes))


def confusion_shares(df: DataFrame, truth: str, pred: str, group: str) -> DataFrame:
    """Row-normalised counts by group and for all rows together (group null)."""
    counts = df.groupingSets([[group, truth, pred], [truth, pred]], group, truth, pred).agg(F.count("*").alias("n"), F.grouping(group).cast("int").alias("merged"))
    total = F.sum("n").over(Window.partitionBy("merged", group, truth))
    return counts.withColumn("share", F.coalesce(F.try_divide(F.col("n"), total), F.lit(0.0)))


def precision_recall(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """tp, fp, fn, precision, recall and F1 of every class, 0 where undefined."""
    tagged = df.select(F.explode(F.array_distinct(F.array(truth, pred))).alias("label"), F.col(truth).alias("t"), F.col(pred).alias("p"))
    counts = tagged.groupBy("label").agg(
        F.count_if((F.col("t") == F.col("label")) & (F.col("p") == F.col("label"))).alias("tp"),
        F.count_if((F.col("t") != F.col("label")) & (F.col("p") == F.col("label"))).alias("fp"),
        F.count_if((F.col("t") == F.col("label")) & (F.col("p") != F.col("label"))).alias("fn"),
    )
    zero = F.lit(0.0)
    precision = F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), zero)
    recall = F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")), zero)
    f1 = F.coalesce(F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), zero)
    return counts.withColumns({"precision": precision, "recall": recall, "f1": f1})


def rate(hit: Column, among: Column | None = None) -> Column:
    """Mean of a condition over the rows of a denominator; null if that is empty."""
    return F.avg(hit.cast("double") if among is None else F.when(among, hit.cast("double")))


def index_quantiles(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``sorted[n // 4]``, ``sorted[n // 2]`` and ``sorted[3 n // 4]`` with mean, min, max and n; null values take no part.

    A distributed selection: approximate quantiles of each key bracket its values,
    exact counts of the brackets tell which one holds each place, and only the
    values of those brackets are put in order, equal ones as one row.
    """
    held = labels.key_chunks(df.select(*keys, value).where(F.col(value).isNotNull()), keys, value)
    sizes = held.groupBy(*keys, "__chunk").agg(F.count("*").alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi"), F.sum(value).alias("sum"))
    whole = sizes.groupBy(*keys).agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("sum").alias("sum"))
    places = F.array(*(F.struct(F.lit(q).alias("q"), F.floor(F.col("all") * i / 4).alias("i")) for i, q in enumerate(("q1", "q2", "q3"), 1)))
    asked = join_keys(labels.chunk_offsets(sizes, keys, ["n"]).withColumnRenamed("__n", "before"), sizes.select(*keys, "__chunk", "n"), [*keys, "__chunk"])
    asked = join_keys(asked, whole.select(*keys, F.col("n").alias("all")), keys).select(*keys, "__chunk", "before", "n", F.inline(places)).where("i >= before AND i < before + n").select(*keys, "__chunk", "q", (F.col("i") - F.col("before")).alias("place"))
    near = join_keys(held, asked.select(*keys, "__chunk").distinct(), [*keys, "__chunk"]).groupBy(*keys, "__chunk", value).agg(F.count("*").alias("f"))
    upto = F.sum("f").over(Window.partitionBy(*keys, "__chunk").orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    found = join_keys(near.withColumn("upto", upto), asked, [*keys, "__chunk"]).where("place < upto AND place >= upto - f")
    found = found.groupBy(*keys).agg(*(F.max(F.when(F.col("q") == q, F.col(value))).alias(q) for q in ("q1", "q2", "q3")))
    return join_keys(whole, found, keys).select(*keys, "n", "q1", "q2", "q3", "lo", "hi", (F.col("sum") / F.col("n")).alias("mean"))


#: Fixed value: the 0.975 quantile of the normal distribution.
Z = 1.959963984540054


def wilson(k: Column, n: Column) -> Column:
    """Score interval at 95 %; the whole range for no trials."""
    p = k / n
    denom = 1 + Z * Z / n
    centre = (p + Z * Z / (2 * n)) / denom
    half = Z * F.sqrt(p * (1 - p) / n + Z * Z / (4 * n * n)) / denom
    low = F.when(n == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), centre - half))
    high = F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), centre + half))
    return F.struct(low.alias("low"), high.alias("high"))


def binomial_tail(cases: DataFrame, keys: list[str], alternative: str = "greater") -> DataFrame:
    """Exact one-sided tail of ``cases(keys, k, n, p0)``; 1 for no trials.

    Log-factorials are a running sum over 1..max(n); each case sums its own
    terms, as rows of a join on the term's number.
    """
    top = cases.agg(F.max("n")).first()[0] or 0
    spark = cases.sparkSession
    numbers = spark.range(top + 1).withColumnRenamed("id", "i")
    logs = labels.running_sums(numbers, F.col("i"), F.floor(F.col("i") / 65_536), {"lf": F.when(F.col("i") > 0, F.ln("i")).otherwise(0.0)})
    span = F.sequence(F.col("k"), F.col("n")) if alternative == "greater" else F.sequence(F.lit(0).cast("long"), F.col("k"))
    terms = cases.where("n > 0").select(*keys, "k", "n", "p0", F.explode(span).alias("i"))

    def with_log(df: DataFrame, at: Column, name: str) -> DataFrame:
        return df.withColumn("__at", at).join(logs.select(F.col("i").alias("__at"), F.col("lf").alias(name)), "__at").drop("__at")

    t = with_log(with_log(with_log(terms, F.col("n"), "lf_n"), F.col("i"), "lf_i"), F.col("n") - F.col("i"), "lf_r")
    mass = F.exp(F.col("lf_n") - F.col("lf_i") - F.col("lf_r") + F.col("i") * F.ln("p0") + (F.col("n") - F.col("i")) * F.ln(1 - F.col("p0")))
    tails = t.groupBy(*keys).agg(F.least(F.sum(mass), F.lit(1.0)).alias("p_value"))
    return cases.join(tails, keys, "left").withColumn("p_value", F.coalesce("p_value", F.lit(1.0)))


#: Fixed values of the bootstrap's hash: a prime modulus, and multipliers below it of row, replicate and seed.
PRIME, _ROW, _REPLICATE, _SEED = (1 << 31) - 1, 1_103_515_245, 742_938_285, 950_706_376
#: Upper ends of the weights 0, 1, 2, .. among the hashes: the Poisson distribution of mean 1, as far as the modulus tells it apart.
POISSON = [int(PRIME * sum(math.exp(-1) / math.factorial(j) for j in range(k + 1))) for k in range(12)]
#: Rows that meet all replicates at a time.
_DRAW_ROWS = 128


def _mod(x: np.ndarray) -> np.ndarray:
    """Remainder of numbers below 2^62 by the Mersenne prime, by shifts."""
    x = (x & PRIME) + (x >> 31)
    return np.where(x >= PRIME, x - PRIME, x)


def draw_weights(rows: np.ndarray, replicates: np.ndarray, seed: int) -> np.ndarray:
    """How often each replicate draws each row (rows x replicates), by a hash: two fifth powers modulo a prime, each a permutation."""
    x = (rows.astype(np.int64) % PRIME)[:, None]
    z = _mod(_mod(x * _ROW) + _mod(replicates.astype(np.int64)[None, :] * _REPLICATE) + seed * _SEED % PRIME)
    for _ in range(2):
        fourth = _mod(z * z)
        z = _mod(_mod(_mod(fourth * fourth) * z) + x + replicates[None, :])  # below the modulus again
    weight = np.zeros(z.shape, np.uint8)
    for end in POISSON:
        weight += z >= end
    return weight


def bootstrap_mean(df: DataFrame, keys: list[str], value: str, row: str, resamples: int = 10_000, seed: int = 0) -> DataFrame:
    """Mean and 95 % interval by resampling; values that are all the same have no spread.

    A row is drawn by every replicate as often as a Poisson weight of mean 1, hashed
    from its integer id ``row`` and the replicate, says: partial sums of any part of
    the rows add up to the same replicates. Each task holds two sums for each key and
    replicate, whatever its rows, and only those are shuffled. Null values take no part.
    """
    own = df.select(*keys, F.col(row).cast("long").alias("row"), F.col(value).cast("double").alias("v")).where("v IS NOT NULL")
    replicates = np.arange(resamples)

    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, list[np.ndarray]] = {}
        for frame in frames:
            for key, part in frame.groupby(keys, dropna=False, sort=False):
                both = held.setdefault(key, [np.zeros(resamples), np.zeros(resamples)])
                for first in range(0, len(part), _DRAW_ROWS):
                    rows, v = (part[c].to_numpy()[first : first + _DRAW_ROWS] for c in ("row", "v"))
                    weight = draw_weights(rows, replicates, seed).astype(np.float64)
                    both[0] += v @ weight
                    both[1] += weight.sum(0)
            if len(held) > 256:  # many keys: their sums go out as they are
                yield from _sums_of(held, keys)
                held = {}
        yield from _sums_of(held, keys)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema[: len(keys)])
    drawn = own.mapInPandas(sums, f"{kinds}, s array<double>, w array<double>").select(*keys, F.posexplode(F.arrays_zip("s", "w")).alias("b", "z"))
    means = drawn.groupBy(*keys, "b").agg(F.try_divide(F.sum("z.s"), F.sum("z.w")).alias("m"))
    bounds = means.groupBy(*keys).agg(F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high"))
    whole = own.groupBy(*keys).agg(F.avg("v").alias("mean"), F.count("*").alias("n"), (F.min("v") == F.max("v")).alias("same"))
    out = join_keys(whole, bounds, keys)
    return out.select(*keys, "mean", "n", *(F.when(F.col("same"), F.col("mean")).otherwise(F.col(c)).alias(c) for c in ("low", "high")))


def _sums_of(held: dict[tuple, list[np.ndarray]], keys: list[str]) -> Iterator[pd.DataFrame]:
    for key, (s, w) in held.items():
        yield pd.DataFrame({**{k: [x] for k, x in zip(keys, key, strict=True)}, "s": [s], "w": [w]})


def signed_rank(df: DataFrame, keys: list[str], value: str, midpoint: float) -> DataFrame:
    """W+ of the Wilcoxon signed-rank test with tie-averaged ranks, and its normal approximation.

    Null for fewer than five values. Equal absolute differences are one row with
    their number; ranks are running sums inside chunks of a key, plus those before.
    """
    diffs = df.select(*keys, (F.col(value) - F.lit(midpoint)).alias("d"))
    n_all = diffs.groupBy(*keys).agg(F.count("*").alias("n_values"))
    ties = diffs.where("d != 0").groupBy(*keys, F.abs("d").alias("a")).agg(F.count("*").alias("t"), F.count_if(F.col("d") > 0).alias("up"))
    upto = labels.running_sums(labels.key_chunks(ties, keys, "a"), F.col("a"), F.col("__chunk"), {"upto": F.col("t")}, keys)
    ranked = upto.withColumn("r", F.col("upto") - F.col("t") + (F.col("t") + 1) / 2)
    sums = ranked.groupBy(*keys).agg(
        F.sum(F.col("r") * F.col("up")).alias("w_plus"), F.sum("t").alias("n"), F.sum(F.pow(F.col("t"), 3) - F.col("t")).alias("tie_term")
    )
    n = F.col("n")
    spread = F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("tie_term") / 48)
    z = F.try_divide(F.col("w_plus") - n * (n + 1) / 4, spread)
    enough = F.col("n_values") >= 5
    out = join_keys(n_all, sums, keys, "left")
    return out.select(*keys, "n_values", F.when(enough, F.col("w_plus")).alias("w_plus"), F.when(enough, z).alias("z"))


def roc_points(df: DataFrame, truth: str, score: str) -> DataFrame:
    """Cumulative true and false positives at each distinct score, highest first."""
    at = df.groupBy(score).agg(F.sum(F.col(truth)).alias("pos"), F.count("*").alias("all"))
    cuts = df.agg(labels.quantile_cuts(score).alias("cuts")).first()["cuts"]
    summed = labels.running_sums(at, F.desc(score), -labels.chunk_of(F.col(score), cuts), {"tp": F.col("pos"), "fp": F.col("all") - F.col("pos")})
    return summed.select(score, "tp", "fp")


def group_minimum(df: DataFrame, keys: list[str], score: str, name: str, line: bool = True) -> DataFrame:
    """The lowest member of each group by (score, name), their number and, if asked for, one line of all.

    Without the line a group is a grouped minimum; with it the members pass through
    chunks of their order, so that only the line itself is as long as the group.
    """
    first = F.min(F.struct(F.col(score).alias("score"), F.col(name).alias("name")))
    rows = df.groupBy(*keys).agg(first.alias("first"), F.count("*").cast("int").alias("n_members")).select(*keys, F.col("first.name").alias("worst"), F.col("first.score").alias("worst_score"), "n_members")
    return join_keys(rows, member_lines(df, keys, score, name, F.concat_ws(" ", F.col(name), F.col(score).cast("string"))), keys) if line else rows


def member_lines(df: DataFrame, keys: list[str], score: str, name: str, said: Column) -> DataFrame:
    """``line``: what is said of each member, lowest (score, name) first, joined by comma; made of lines of the order's chunks."""
    cut = labels.key_chunks(df.select(*keys, score, name, said.alias("said")), keys, score)
    member = F.array_sort(F.collect_list(F.struct(F.col(score).alias("s"), F.col(name).alias("n"), "said")))
    parts = cut.groupBy(*keys, "__chunk").agg(F.array_join(F.transform(member, lambda m: m["said"]), ", ").alias("part"))
    return parts.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__chunk", "part"))), lambda p: p["part"]), ", ").alias("line"))


def worst_members(df: DataFrame, keys: list[str], score: str, name: str, k: int = 3) -> DataFrame:
    """``worst``: the names of the k lowest of each group by (score, name); tasks send at most k rows of a group."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(score, name))
    lowest = df.select(*keys, score, name, rank.alias("rank")).where(F.col("rank") <= k)
    return lowest.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.col(name).alias("n")))), lambda m: m["n"]).alias("worst"))


def below_treated(df: DataFrame, keys: list[str], score: str, treated: str, name: str, k: int = 3) -> DataFrame:
    """Untreated items that score below the lowest treated one, the worst k."""
    low = F.min(F.when(F.col(treated), F.col(score))).over(Window.partitionBy(*keys))
    found = df.withColumn("__low", low).where(~F.col(treated) & (F.col(score) < F.col("__low")))
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(score, name))
    return found.withColumn("rank", rn).where(F.col("rank") <= k).drop("__low")


def column_nulls(df: DataFrame) -> DataFrame:
    return df.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in df.columns))
