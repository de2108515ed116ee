"""Similarity joins over embeddings, candidate merging and ranking."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rulewright.functions import text
from rulewright.operators.batchfn import batch_score
from rulewright.operators.sides import small

#: Queries and items that meet in one cell of a search, on average, and queries whose products are held at a time.
BLOCK_QUERIES, BLOCK_ITEMS, _TILE = 4096, 8192, 256
#: How far below the k-th product a pair is looked at again, exactly; far beyond the rounding of a product.
_SLACK = 1e-9


def top_k(scored: DataFrame, keys: list[str], by: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each key in the given order."""
    w = Window.partitionBy(*keys).orderBy(*by)
    return scored.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def knn(queries: DataFrame, items: DataFrame, k: int, category: str | None = None, others: bool = False) -> DataFrame:
    """The k items of largest cosine for each query, by blocks: the queries' and items' columns, ``similarity`` and ``rank``.

    ``queries(query_id, [category], q, ..)`` and ``items(item_id, [category], v, ..)``;
    with a category only items of the query's own take part. Queries and items are
    dealt into blocks of bounded size, as many for each category as its rows ask for, so
    that a category that holds most rows is many cells. A cell is one matrix product
    with a top k for each query; no pair is a row. What the product finds is
    measured again one pair at a time, in double precision, so that equal vectors tie exactly; ties go to
    the smaller item. A vector that is null, empty or zero, or holds a null or non-finite component, or
    has another length, is at similarity 0. Items without id take no part; ``others`` leaves out the item of the query's own id.
    """
    items, of = items.where(F.col("item_id").isNotNull()), [category] if category else []
    sizes = [df.groupBy(*of).agg(F.ceil(F.count("*") / n).alias(name)) for df, n, name in ((items, BLOCK_ITEMS, "__chunks"), (queries, BLOCK_QUERIES, "__blocks"))]
    parts = small(sizes[0].join(sizes[1], of)) if of else [df.first()[0] for df in sizes]
    left = _dealt(queries, parts, of, "query_id", "__block", "__chunk").withColumnRenamed("q", "__vector")
    right = _dealt(items, parts, of, "item_id", "__chunk", "__block").withColumnRenamed("v", "__vector")
    cell = [*of, "__block", "__chunk"]
    kept = [c for c in queries.columns if c != "q"], [c for c in items.columns if c not in ("v", *of)]
    fields = [df.schema[c] for df, names in zip((queries, items), kept, strict=True) for c in names]

    def best(asked: pa.Table, known: pa.Table) -> pa.Table:
        q, v, similarity = _nearest(asked, known, k, others)
        columns = {c: t.column(c).take(pa.array(at)) for t, names, at in ((asked, kept[0], q), (known, kept[1], v)) for c in names}
        return pa.table({**columns, "similarity": similarity})

    schema = T.StructType([*fields, T.StructField("similarity", T.DoubleType())])
    right = right.toDF(*right.columns)  # both sides may come from one table
    found = left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInArrow(best, schema)
    return top_k(found, ["query_id"], [F.desc("similarity"), F.col("item_id")], k)


def _dealt(rows: DataFrame, parts: DataFrame | list[int], of: list[str], key: str, own: str, other: str) -> DataFrame:
    """Rows in a block of their category by a hash of their key, once for each block of the other side."""
    dealt = rows.join(parts, of) if of else rows.withColumns({"__chunks": F.lit(parts[0]), "__blocks": F.lit(parts[1])}).where("__chunks > 0 AND __blocks > 0")
    dealt = dealt.withColumn(own, F.pmod(F.xxhash64(key), F.col(f"{own}s")))
    return dealt.withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"{other}s") - 1))).drop("__blocks", "__chunks")


def _by_length(vectors: pa.ChunkedArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Rows and unit vectors of each length, for vectors that have a direction."""
    lists = vectors.combine_chunks()
    lengths = np.where(lists.is_valid().to_numpy(zero_copy_only=False), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False), 0)
    out = {}
    for n in np.unique(lengths[lengths > 0]).tolist():
        rows = np.flatnonzero(lengths == n)
        flat = lists.take(pa.array(rows)).flatten().cast(pa.float64())
        matrix = flat.to_numpy(zero_copy_only=False).reshape(-1, n)  # a null component is not a number
        size = np.sqrt((matrix * matrix).sum(1))
        some = np.isfinite(size) & (size > 0)
        if some.any():
            out[n] = rows[some], np.column_stack([matrix[some], size[some]])
    return out


def _nearest(asked: pa.Table, known: pa.Table, k: int, others: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of the queries, rows of the items and similarities: at most k for each query, and all that tie with the k-th within rounding."""
    order = np.empty(known.num_rows, np.int64)
    order[pc.sort_indices(known.column("item_id")).to_numpy()] = np.arange(known.num_rows)
    sides = [_by_length(t.column("__vector")) for t in (asked, known)]
    own = [np.asarray(t.column(c).to_pylist(), object) for t, c in ((asked, "query_id"), (known, "item_id"))] if others else None
    found = []
    for first in range(0, asked.num_rows, _TILE):
        rows = np.arange(first, min(first + _TILE, asked.num_rows))
        near = np.zeros((len(rows), known.num_rows))
        exact = []
        for n, (at, matrix) in sides[0].items():
            mine = (at >= first) & (at < first + _TILE)
            if mine.any() and n in sides[1]:
                to, other = sides[1][n]
                near[np.ix_(at[mine] - first, to)] = (matrix[mine, :n] / matrix[mine, n:]) @ (other[:, :n] / other[:, n:]).T
                exact.append((at, matrix, to, other, n))
        if others:
            near[own[0][rows][:, None] == own[1][None, :]] = -np.inf
        least = np.partition(near, -min(k, known.num_rows), axis=1)[:, -min(k, known.num_rows)]
        q, v = np.nonzero((near >= (least - _SLACK)[:, None]) & (near > -np.inf))
        similarity = np.zeros(len(q))
        for at, matrix, to, other, n in exact:
            i, j = np.searchsorted(at, q + first), np.searchsorted(to, v)
            hit = (i < len(at)) & (j < len(to))
            hit[hit] = (at[i[hit]] == q[hit] + first) & (to[j[hit]] == v[hit])
            a, b = matrix[i[hit]], other[j[hit]]
            similarity[hit] = (a[:, :n] * b[:, :n]).sum(1) / (a[:, n] * b[:, n])
        by = np.lexsort((order[v], -similarity, q))
        place = np.arange(len(q)) - np.searchsorted(q[by], q[by])
        by = by[place < k]
        found.append((q[by] + first, v[by], similarity[by]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def knn_postfiltered(queries: DataFrame, items: DataFrame, category: str, k: int, limit: int = 1) -> DataFrame:
    """Top k of all items first, then the category, then the limit; may give nothing."""
    found = knn(queries.withColumnRenamed(category, "__want"), items, k).where(F.col(category) == F.col("__want")).drop("__want")
    return top_k(found.drop("rank"), ["query_id"], [F.desc("similarity"), F.col("item_id")], limit)


def threshold_with_floor(ranked: DataFrame, keys: list[str], score: str, least: float, tie: str) -> DataFrame:
    """Rows of at least the score; the single best row where none reaches it."""
    w = Window.partitionBy(*keys)
    best = F.row_number().over(w.orderBy(F.desc(score), tie))
    return ranked.withColumn("__rn", best).withColumn("__max", F.max(score).over(w)).where((F.col(score) >= least) | ((F.col("__rn") == 1) & (F.col("__max") < least))).drop("__rn", "__max")


def rerank(ranked: DataFrame, external: DataFrame, keys: list[str], item: str, pool: int) -> DataFrame:
    """Items of the pool that the external order lists come first, by it; then the rest in their prior order."""
    joined = ranked.join(external, [*keys, item], "left").withColumn("__pos", F.when(F.col("rank") <= pool, F.col("position")))
    w = Window.partitionBy(*keys).orderBy(F.isnull("__pos"), "__pos", "rank")
    return joined.withColumn("new_rank", F.row_number().over(w)).drop("__pos", "position")


def priority_union(primary: DataFrame, secondary: DataFrame, key: list[str]) -> DataFrame:
    """All of the primary source and the secondary's rows with new keys, marked by source."""
    extra = secondary.join(primary.select(*key).distinct(), key, "left_anti")
    return primary.withColumn("source_rank", F.lit(0)).unionByName(extra.withColumn("source_rank", F.lit(1)), allowMissingColumns=True)


def first_level(levels: list[DataFrame], keys: list[str]) -> DataFrame:
    """Per key, the rows of the first level that has any."""
    union = levels[0].withColumn("level_no", F.lit(0))
    for i, level in enumerate(levels[1:], 1):
        union = union.unionByName(level.withColumn("level_no", F.lit(i)))
    return union.withColumn("__first", F.min("level_no").over(Window.partitionBy(*keys))).where("level_no = __first").drop("__first")


def cache_split(texts: DataFrame, cache: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """Rows found in a content cache by hash, and the distinct contents that miss."""
    keyed = texts.withColumn("content_key", text.content_key(text.hash_text(F.col(column))))
    hits = keyed.join(cache, "content_key", "left")
    misses = keyed.join(cache.select("content_key"), "content_key", "left_anti").groupBy("content_key").agg(F.min(text.hash_text(F.col(column))).alias("content"))
    return hits, misses


def matched_or_nearest(subjects: DataFrame, matched: DataFrame, items: DataFrame, keys: list[str], category: str, others: bool = False) -> DataFrame:
    """Rule matches, and for subjects without one the nearest item of their category; each labelled by its arm.

    A subject that neither arm finds anything for is a row without an item, labelled ``none``, to be
    reported. ``others`` (with one key) leaves out the item of the subject's own key.
    """
    rest = subjects.join(matched.select(*keys), keys, "left_anti")
    asked = rest.withColumn("query_id", F.col(keys[0]) if len(keys) == 1 else F.struct(*keys))
    near = knn(asked, items, 1, category, others).select(*keys, "item_id")
    nearest = rest.select(*keys).distinct().join(near, keys, "left").select(*keys, "item_id", F.when(F.col("item_id").isNull(), "none").otherwise("nearest").alias("matched_by"))
    return matched.select(*keys, "item_id", F.lit("rule").alias("matched_by")).unionByName(nearest)


def embed_missing(texts: DataFrame, cache: DataFrame, column: str, embed: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]]) -> DataFrame:
    """Vectors of all texts: cached ones by content hash, the distinct rest through a user's model in batches.

    ``cache(content_key, vector)``; the model gets batches with ``content`` and returns ``vector``. A text whose
    call failed has no vector and ``status`` failed, with its ``error``; all others have the status success.
    """
    _, misses = cache_split(texts, cache, column)
    made = batch_score(misses, embed, "vector array<double>").select("content_key", "vector", "status", "error")
    cached = cache.select("content_key", "vector", F.lit("success").alias("status"), F.lit(None).cast("string").alias("error"))
    keyed = texts.withColumn("content_key", text.content_key(text.hash_text(F.col(column))))
    return keyed.join(cached.unionByName(made), "content_key", "left")
