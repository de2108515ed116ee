"""Label tables: consensus, reshaping, quality filters, joins that check, global ranks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rulewright.operators.sides import small


def consensus(labels: DataFrame, user: str, label: str, how: str, ordinal: str | None = None) -> DataFrame:
    """One label per user: mode (ties: smallest), median, max, first, mean or rare (rarest class held)."""
    if how == "rare":
        freq = labels.groupBy(label).agg(F.count("*").alias("freq"))
        first = labels.groupBy(user, label).agg(F.min(ordinal).alias("at"))
        return first.join(freq, label).groupBy(user).agg(F.min_by(label, F.struct("freq", "at")).alias(label))
    rule = {
        "mode": F.mode(F.col(label), True),
        "median": F.least(F.greatest(F.floor(F.least(F.greatest(F.rint(F.median(label)), F.lit(0)), F.lit(9)) / 2), F.lit(0)), F.lit(4)),
        "max": F.max(label),
        "first": F.min_by(label, ordinal or label),
        "mean": F.rint(F.avg(label)),
    }[how]
    return labels.groupBy(user).agg(rule.cast("int").alias(label))


def label_disagreement(labels: DataFrame, user: str, label: str, complete: int = 4) -> DataFrame:
    """Mean label, number of labels, whether they differ, whether the set is incomplete."""
    return labels.groupBy(user).agg(
        F.rint(F.avg(label)).cast("int").alias("mean_label"),
        F.count(label).alias("n_labels"),
        (F.countDistinct(label) > 1).alias("disagrees"),
        (F.count(label) != complete).alias("incomplete"),
    )


def global_rank(df: DataFrame, order: list[Column], chunk: Column, rank: str = "rn") -> DataFrame:
    """Row number over all rows without a global window.

    ``chunk`` is a coarse, order-preserving cut of the first sort key. Rows are
    numbered inside their chunk; the numbers of earlier chunks are added.
    """
    cut = df.withColumn("__chunk", chunk)
    sizes = cut.groupBy("__chunk").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("__chunk", before.alias("__before"))
    local = F.row_number().over(Window.partitionBy("__chunk").orderBy(*order))
    return cut.withColumn("__local", local).join(offsets, "__chunk").withColumn(rank, (F.col("__local") + F.col("__before")).cast("long")).drop("__chunk", "__local", "__before")


def quantile_cuts(value: str, chunks: int = 64) -> Column:
    """Approximate quantiles that cut a column into chunks of about equal size, as an aggregate."""
    return F.percentile_approx(F.col(value).cast("double"), [i / chunks for i in range(1, chunks)], 10_000)


def chunk_of(value: Column, cuts: list[float] | None) -> Column:
    """The number of cuts below a value: an order-preserving chunk of it."""
    some = sorted(set(cuts or []))
    return F.size(F.filter(F.array(*map(F.lit, some)), lambda c: c < value.cast("double"))) if some else F.lit(0)


def join_keys(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """An equi-join on the keys, where null is a key like any other."""
    renamed = right.withColumnsRenamed({k: f"__{k}" for k in keys})
    return left.join(renamed, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys], how).drop(*(f"__{k}" for k in keys))


def key_chunks(df: DataFrame, keys: list[str], value: str, chunks: int = 64) -> DataFrame:
    """Add ``__chunk``, an order-preserving cut of a numeric column at the approximate quantiles of its own key."""
    cuts = df.groupBy(*(F.col(k).alias(f"__{k}") for k in keys)).agg(quantile_cuts(value, chunks).alias("__cuts"))
    met = df.join(small(cuts), [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
    below = F.aggregate(F.array_distinct("__cuts"), F.lit(0), lambda n, c: n + F.when(c < F.col(value).cast("double"), 1).otherwise(0))
    return met.select(*df.columns, F.coalesce(below, F.lit(-1)).alias("__chunk"))


def chunk_offsets(sizes: DataFrame, keys: list[str], sums: list[str]) -> DataFrame:
    """Of a table with a row for each key and ``__chunk``: the sums of the key's earlier chunks, under ``__`` and their name."""
    earlier = Window.partitionBy(*keys).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select(*keys, "__chunk", *(F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"__{n}") for n in sums))


def running_sums(df: DataFrame, order: Column, chunk: Column, sums: dict[str, Column], keys: list[str] | None = None) -> DataFrame:
    """Running sums in an order, of each key if any are given, without a window over all of their rows: inside chunks, plus the sums of the chunks before."""
    keys = keys or []
    rest = [c for c in df.columns if c != "__chunk"]
    cut = df.select(*rest, *(c.alias(n) for n, c in sums.items()), chunk.alias("__chunk"))
    whole = cut.groupBy(*keys, "__chunk").agg(*(F.sum(n).alias(n) for n in sums))
    before = chunk_offsets(whole, keys, list(sums))
    inside = Window.partitionBy(*keys, "__chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = join_keys(cut.withColumns({n: F.sum(n).over(inside) for n in sums}), before, [*keys, "__chunk"])
    return joined.select(*rest, *((F.col(n) + F.col(f"__{n}")).alias(n) for n in sums))


def numbered(df: DataFrame, keys: list[str], order: str, tie: str, number: str = "rn") -> DataFrame:
    """Row number of each row in its key by (order, tie), ``order`` numeric: numbers inside chunks, plus the sizes of the chunks before."""
    cut = key_chunks(df, keys, order)
    return running_sums(cut, F.struct(order, tie), F.col("__chunk"), {number: F.lit(1).cast("long")}, keys)


def rank_classes(df: DataFrame, value: str, tie: str, n_bins: int = 10, reverse: bool = False, chunks: int = 64) -> DataFrame:
    """Classes of equal size by rank; null values get -1. Class of rank r of n is floor(r / n * bins)."""
    held = df.where(F.col(value).isNotNull())
    spread = held.agg(F.count("*").alias("n"), quantile_cuts(value, chunks).alias("cuts")).first()
    chunk = chunk_of(F.col(value), spread["cuts"])
    order = [F.desc(value) if reverse else F.asc(value), F.col(tie)]
    ranked = global_rank(held, order, -chunk if reverse else chunk)
    classed = ranked.withColumn("rank_class", F.least(F.floor((F.col("rn") - 1) * n_bins / F.lit(spread["n"])), F.lit(n_bins - 1)).cast("int")).drop("rn")
    return classed.unionByName(df.where(F.col(value).isNull()).withColumn("rank_class", F.lit(-1)))


def keep_first(df: DataFrame, subset: list[str], order: list[str | Column]) -> DataFrame:
    """First row of each key in an explicit order."""
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(*subset).orderBy(*order))).where("__rn = 1").drop("__rn")


def unpivot_structs(df: DataFrame, keys: list[str], sides: dict[str, dict[str, str]], where: Column | None = None) -> DataFrame:
    """Paired columns to rows: ``sides`` maps a side name to {output column: input column}."""
    rows = F.array(*(F.struct(F.lit(side).alias("side"), *(F.col(c).alias(out) for out, c in cols.items())) for side, cols in sides.items()))
    long = df.select(*keys, F.inline(rows))
    return long if where is None else long.where(where)


def pivot_sectors(df: DataFrame, keys: list[str], sector: str, names: list[str], value: str) -> DataFrame:
    return df.groupBy(*keys).pivot(sector, names).agg(F.first(value, ignorenulls=True))


def pair_views(left: DataFrame, right: DataFrame, key: str, pattern: str, to: str) -> DataFrame:
    """Full outer join of two views on a key from which the view mark is taken out."""

    def keyed(df: DataFrame, side: str) -> DataFrame:
        return df.select(F.regexp_replace(key, pattern, to).alias("pair_key"), *(F.col(c).alias(f"{side}_{c}") for c in df.columns))

    return keyed(left, "left").join(keyed(right, "right"), "pair_key", "full")


def pair_halves(df: DataFrame, key: str, name: str, marks: dict[str, str]) -> DataFrame:
    """Rows of one table whose name holds the first side's mark, paired by key with those that hold the second's; columns are named by side."""
    halves = [df.where(F.contains(F.col(name), F.lit(mark))).select(F.col(key), *(F.col(c).alias(f"{side}_{c}") for c in df.columns if c != key)) for side, mark in marks.items()]
    return halves[0].join(halves[1], key)


def fill_labels(df: DataFrame, columns: list[str], missing: int = -1) -> DataFrame:
    """Label columns as integers, with a mark where there is none or it is no number."""
    return df.withColumns({c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")), F.lit(missing)).cast("int") for c in columns})


def intersect_keys(key: str, *filters: DataFrame) -> DataFrame:
    """Keys that pass every independent filter."""
    return reduce(lambda a, b: a.join(b, key, "left_semi"), (f.select(key).distinct() for f in filters))


def checked_merge(a: DataFrame, b: DataFrame, key: str, same: list[str]) -> tuple[DataFrame, DataFrame]:
    """Inner join on a key, split into rows whose common attributes agree and rows where they do not."""
    other = b.withColumnsRenamed({c: f"__{c}" for c in same})
    joined = a.join(other, key)
    agree = reduce(lambda x, y: x & y, (F.col(c).eqNullSafe(F.col(f"__{c}")) for c in same))
    return joined.where(agree).drop(*(f"__{c}" for c in same)), joined.where(~agree)


def existing(df: DataFrame, listing: DataFrame, path: str) -> DataFrame:
    """Blank the path where the listing does not have it."""
    known = listing.select(F.col(path).alias("__path")).distinct()
    return df.join(known, F.col(path) == F.col("__path"), "left").withColumn(path, F.when(F.col("__path").isNull(), F.lit("")).otherwise(F.col(path))).drop("__path")


def repair_from(df: DataFrame, siblings: list[DataFrame], key: str, label: str) -> DataFrame:
    """Label of the first sibling that has the record, else the own one."""
    out = df.withColumnRenamed(label, "__own")
    for i, s in enumerate(siblings):
        out = out.join(s.select(key, F.col(label).alias(f"__s{i}")), key, "left")
    names = [f"__s{i}" for i in range(len(siblings))]
    return out.withColumn(label, F.coalesce(*names, "__own")).drop("__own", *names)


def incomplete_groups(df: DataFrame, keys: list[str], members: int = 4) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") != members)
