"""A growing keyed corpus: fold of sightings, upserts and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _first_filled(value: str, order: Column) -> Column:
    return F.min_by(F.when(F.col(value).isNotNull() & (F.col(value) != ""), F.col(value)), F.when(F.col(value).isNotNull() & (F.col(value) != ""), order))


def fold_sightings(sightings: DataFrame, key: str, ts: str, tie: str, fill: list[str], query: str, last: int = 8) -> DataFrame:
    """One row per key: first and last time, count, first filled value of each field, last distinct queries.

    Fill-only-if-empty is the value of the smallest (ts, tie) that is filled,
    so partial folds of batches combine to the same row.
    """
    order = F.struct(ts, tie)
    seen = sightings.where(F.col(key).isNotNull())
    first_query = seen.where(F.col(query).isNotNull() & (F.col(query) != "")).groupBy(key, query).agg(F.min(order).alias("at"))
    recent = first_query.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("at")))).where(F.col("n") <= last)
    queries = recent.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", F.col(query).alias("q")))), lambda x: x["q"]).alias("queries"))
    folded = seen.groupBy(key).agg(
        F.min(ts).alias("first_seen"), F.max(ts).alias("last_seen"), F.count("*").alias("seen_count"), *(_first_filled(c, order).alias(c) for c in fill)
    )
    return folded.join(queries, key, "left")


def merge_folds(old: DataFrame, new: DataFrame, key: str, fill: list[str], last: int = 8) -> DataFrame:
    """Combine the stored corpus with the fold of a later batch."""
    o, n = old.alias("o"), new.alias("n")
    queries = F.concat(F.coalesce(F.col("o.queries"), F.array().cast("array<string>")), F.filter(F.coalesce(F.col("n.queries"), F.array().cast("array<string>")), lambda q: ~F.coalesce(F.array_contains("o.queries", q), F.lit(False))))
    return o.join(n, key, "full").select(
        key,
        F.least("o.first_seen", "n.first_seen").alias("first_seen"),
        F.greatest("o.last_seen", "n.last_seen").alias("last_seen"),
        (F.coalesce("o.seen_count", F.lit(0)) + F.coalesce("n.seen_count", F.lit(0))).cast("long").alias("seen_count"),
        *(F.coalesce(f"o.{c}", f"n.{c}").alias(c) for c in fill),
        F.when(F.size(queries) > last, F.slice(queries, -last, last)).when(F.size(queries) > 0, queries).alias("queries"),
    )


def upsert(old: DataFrame, new: DataFrame, key: list[str], ordinal: str) -> DataFrame:
    """Keyed overwrite: the last row of a key in the batch wins over the stored one."""
    w = Window.partitionBy(*key).orderBy(F.desc(ordinal))
    fresh = new.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn", ordinal)
    return old.join(fresh.select(*key), key, "left_anti").unionByName(fresh)


def duplicate_keys(df: DataFrame, key: list[str]) -> DataFrame:
    """Keys that break uniqueness, with their row counts."""
    return df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def attach_vectors(rows: DataFrame, vectors: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows with their vectors by key, and the rows that have none (must be empty before an upload)."""
    return rows.join(vectors, key), rows.join(vectors.select(key), key, "left_anti")


def corpus_counts(corpus: DataFrame, vector: str) -> DataFrame:
    return corpus.agg(F.count("*").alias("n_papers"), F.count_if(F.col(vector).isNotNull()).alias("n_with_vector"))
