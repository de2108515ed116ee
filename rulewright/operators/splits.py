"""Train, validation and test splits in a fixed pseudo-random order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rulewright.functions.scores import md5_order
from rulewright.operators.labels import join_keys, numbered, running_sums


def ranked(df: DataFrame, strata: list[str], key: str, seed: int) -> DataFrame:
    """Add ``__rn``, the row's number in its stratum's hash order, and ``__n``, the stratum's size.

    A stratum is numbered in 256 ranges of the hash, which meet no task but
    their own; the sizes of earlier ranges are added.
    """
    at = df.withColumn("__at", md5_order(seed, key)).withColumn("__range", F.shiftright("__at", 20))
    sizes = at.groupBy(*strata, "__range").agg(F.count("*").alias("__size"))
    w = Window.partitionBy(*strata)
    earlier = F.coalesce(F.sum("__size").over(w.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select(*(F.col(c).alias(f"__{c}") for c in strata), F.col("__range").alias("__its"), earlier.alias("__before"), F.sum("__size").over(w).alias("__n"))
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in strata] + [F.col("__range") == F.col("__its")]
    local = F.row_number().over(Window.partitionBy(*strata, "__range").orderBy("__at", key))
    joined = at.withColumn("__local", local).join(offsets, same)
    return joined.select(*df.columns, (F.col("__local") + F.col("__before")).alias("__rn"), "__n")


def stratified(df: DataFrame, strata: list[str], key: str, seed: int = 42, test: float = 0.1, val: float = 0.1) -> DataFrame:
    """Quotas of each stratum, rounded; strata of one row go to train."""
    rn, n = F.col("__rn"), F.col("__n")
    n_test, n_val = F.round(n * test), F.round(n * val)
    split = F.when(n < 2, F.lit("train")).when(rn <= n_test, F.lit("test")).when(rn <= n_test + n_val, F.lit("val")).otherwise(F.lit("train"))
    return ranked(df, strata, key, seed).withColumn("split", split).drop("__rn", "__n")


def _quotas(classes: DataFrame, strata: list[str], size: str, share: float, name: str) -> DataFrame:
    """Add ``name``: the class's part of ``ceil(share * rows)``, rounded down, and one more for the largest remainders until the parts add up.

    Classes of one row have no part. Ties go by class; the window is over one row for each class.
    """
    held = F.when(F.col(size) > 1, F.col(size)).otherwise(0)
    every = Window.partitionBy()
    parts = classes.withColumn("__want", F.ceil(F.sum(held).over(every) * F.lit(share)).cast("long"))
    parts = parts.withColumn("__exact", F.coalesce(F.try_divide(held * F.col("__want"), F.sum(held).over(every)), F.lit(0.0)))
    parts = parts.withColumn("__low", F.floor("__exact"))
    place = F.row_number().over(Window.orderBy(F.desc(F.round(F.col("__exact") - F.col("__low"), 9)), *strata))
    more = F.when(place <= F.col("__want") - F.sum("__low").over(every), 1).otherwise(0)
    return parts.withColumn(name, (F.col("__low") + more).cast("long")).drop("__want", "__exact", "__low")


def stratified_twice(df: DataFrame, strata: list[str], key: str, seed: int = 42, held_out: float = 0.2, test: float = 0.5) -> DataFrame:
    """A stratified cut of ``held_out`` of the rows, and a stratified cut of these into val and test.

    Quotas are whole rows that add up over the classes (largest remainders). Classes
    of one row go to train; classes of which the first cut holds out one row cannot be
    cut again: that row goes to val.
    """
    counted = df.groupBy(*strata).agg(F.count("*").alias("__size"))
    first = _quotas(counted, strata, "__size", held_out, "__held")
    second = _quotas(first, strata, "__held", test, "__test").select(*strata, "__held", "__test")
    met = join_keys(ranked(df, strata, key, seed), second, strata)
    rn = F.col("__rn")
    split = F.when((F.col("__n") < 2) | (rn > F.col("__held")), F.lit("train")).when((F.col("__held") > 1) & (rn <= F.col("__test")), F.lit("test")).otherwise(F.lit("val"))
    return met.withColumn("split", split).select(*df.columns, "split")


def grouped(df: DataFrame, group: str, seed: int = 42, test: float = 0.1, val: float = 0.1) -> DataFrame:
    """Every row of a group lands in one split; ``test`` of the rows, and ``val`` of the rest, within one group's size.

    Groups come in a hash order. A group is test while the groups before it have
    fewer rows than the quota, and val while they have fewer than both; the running sum is
    of group sizes, inside ranges of the hash, plus those of the ranges before. Rows without a group are one group.
    """
    sizes = df.groupBy(group).agg(F.count("*").alias("__size")).withColumn("__at", md5_order(seed, F.col(group).cast("string")))
    summed = running_sums(sizes, F.struct("__at", group), F.shiftright("__at", 20), {"__upto": F.col("__size")})
    rows = df.count()
    before = F.col("__upto") - F.col("__size")
    split = F.when(before < rows * test, F.lit("test")).when(before < rows * (test + (1 - test) * val), F.lit("val")).otherwise(F.lit("train"))
    return join_keys(df, summed.select(group, split.alias("split")), [group])


def k_fold(df: DataFrame, label: str, key: str, k: int = 5, seed: int = 42) -> DataFrame:
    return ranked(df, [label], key, seed).withColumn("fold", ((F.col("__rn") - 1) % k).cast("int")).drop("__rn", "__n")


def sub_sample(df: DataFrame, label: str, key: str, share: float = 0.2, seed: int = 42) -> DataFrame:
    """One cut of each class; classes of one row are left out."""
    return ranked(df, [label], key, seed).where((F.col("__n") > 1) & (F.col("__rn") <= F.round(F.col("__n") * share))).drop("__rn", "__n")


def propagate(rows: DataFrame, users: DataFrame, user: str) -> DataFrame:
    return rows.join(users.select(user, "split"), user, "left")


def leaks(df: DataFrame, user: str) -> DataFrame:
    """Users in more than one split; must be empty."""
    return df.groupBy(user).agg(F.countDistinct("split").alias("n_splits")).where("n_splits > 1")


def route_by_listing(df: DataFrame, key: str, train: DataFrame, val: DataFrame) -> DataFrame:
    """Split by membership in two listings; train wins, rows in neither get null."""
    t = train.select(F.col(key).alias("__t")).distinct()
    v = val.select(F.col(key).alias("__v")).distinct()
    joined = df.join(t, F.col(key) == F.col("__t"), "left").join(v, F.col(key) == F.col("__v"), "left")
    return joined.withColumn("split", F.when(F.col("__t").isNotNull(), F.lit("train")).when(F.col("__v").isNotNull(), F.lit("val"))).drop("__t", "__v")


def sample_rows(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    return df.orderBy(md5_order(seed, key), key).limit(n)


def epoch_order(seed: int, epoch: int, key: str) -> Column:
    """Sort key of one epoch's shuffle."""
    return md5_order(seed, F.lit(str(epoch)), key)


def shuffled(df: DataFrame, keys: list[str], row: str, seed: int, epoch: int) -> DataFrame:
    """``position`` of each row of a key in one epoch's order: ranges of the epoch's hash are ordered apart, each numbered behind the ranges before."""
    at = df.withColumn("__at", epoch_order(seed, epoch, row))
    placed = running_sums(at, F.struct("__at", row), F.shiftright("__at", 20), {"position": F.lit(1).cast("long")}, keys)
    return placed.withColumn("position", F.col("position") - 1).drop("__at")


def buffered_shuffle(df: DataFrame, keys: list[str], order: str, tie: str, size: int, seed: int, epoch: int = 0) -> DataFrame:
    """``position`` of each row of a key in a stream that is shuffled through a buffer of ``size`` rows.

    The buffer is filled and emptied in turn: rows keep their block of ``size`` in the stream's
    order and are shuffled inside it, so none moves by ``size`` places or more, and
    no task holds more than a block. The same seed and epoch give the same order.
    """
    at = numbered(df, keys, order, tie, "__rn").withColumn("__block", F.floor((F.col("__rn") - 1) / size))
    inside = F.row_number().over(Window.partitionBy(*keys, "__block").orderBy(md5_order(seed, F.lit(str(epoch)), F.col(tie).cast("string")), tie))
    return at.withColumn("position", F.col("__block") * size + inside - 1).drop("__rn", "__block")


def chunked(df: DataFrame, keys: list[str], order: str, n: int) -> DataFrame:
    """``chunk`` of n rows of each key in the order of a numeric column that tells them apart."""
    return numbered(df, keys, order, order, "__rn").withColumn("chunk", F.floor((F.col("__rn") - 1) / n).cast("long")).drop("__rn")


def pick_one(groups: DataFrame, members: DataFrame, key: str, value: str, seed: int = 42, missing: int = -1) -> DataFrame:
    """One member of each group in hash order, the missing mark for an empty group."""
    best = members.groupBy(key).agg(F.min_by(value, F.struct(md5_order(seed, F.col(value).cast("string")), value)).alias("picked"))
    return groups.join(best, key, "left").withColumn("picked", F.coalesce("picked", F.lit(missing)))
