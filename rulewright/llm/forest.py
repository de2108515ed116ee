"""Random-projection trees over embeddings: nearest neighbours and near-duplicates.

A tree halves the unit vectors again and again: each level has one random
direction, and each node splits at the median of a bounded sample along it. The
sample bounds the depth too, so the model (directions and thresholds) has a
fixed largest size; every row is routed by it on the executors, and rows of one leaf meet in one group. Leaves that outgrow a block
are cut into blocks by a hash of the id, so no group is unbounded.

Equal vectors are one entry of the index. A vector takes no part if it is null,
empty, zero, or holds a null or a non-finite component. Vectors shorter than the
longest count as if filled up with zeros.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rulewright.llm.components import connected_components
from rulewright.storage import Workspace

#: Rows on which thresholds are fitted at most, chosen by a hash of the id, and the fewest of them at which a node is split. Together they bound the depth, and so the model.
FIT_ROWS = 32_768
NODE_ROWS = 32
#: Rows of a leaf that one group holds; larger leaves are cut.
BLOCK_ROWS = 2048


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``id`` and ``v`` of the vectors that take part."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    finite = F.forall("v", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)) & ~F.isnan(x))
    return rows.where(F.col("id").isNotNull() & finite & F.exists("v", lambda x: x != 0))


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """Rows of a list column in double precision, filled up to ``dim``."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if (lengths == dim).all():
        return flat.reshape(-1, dim)
    out = np.zeros((len(lengths), dim))
    row = np.repeat(np.arange(len(lengths)), lengths)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def _unit(rows: np.ndarray) -> np.ndarray:
    rows = rows / np.abs(rows).max(1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(1, keepdims=True))


@dataclass
class Forest:
    """Directions (trees x levels x dim), thresholds by level and node, sample share of each leaf."""

    dim: int
    directions: np.ndarray
    thresholds: list[np.ndarray]
    share: np.ndarray

    @property
    def trees(self) -> int:
        return self.directions.shape[0]

    @property
    def depth(self) -> int:
        return self.directions.shape[1]

    def project(self, unit: np.ndarray) -> np.ndarray:
        """Along every direction: rows x trees x levels."""
        return (unit @ self.directions.reshape(-1, self.dim).T).reshape(len(unit), self.trees, self.depth)

    def leaves(self, unit: np.ndarray) -> np.ndarray:
        """The leaf of each row in each tree."""
        along = self.project(unit)
        node = np.zeros((len(unit), self.trees), np.int64)
        for level in range(self.depth):
            limit = self.thresholds[level][np.arange(self.trees), node]
            node = 2 * node + (along[:, :, level] > limit)
        return node

    def spilled(self, unit: np.ndarray, margin: float) -> tuple[np.ndarray, np.ndarray]:
        """Row and code (tree, leaf) where rows within ``margin`` of a threshold go to both sides."""
        along = self.project(unit)
        rows, codes = [], []
        for tree in range(self.trees):
            row, node = np.arange(len(unit)), np.zeros(len(unit), np.int64)
            for level in range(self.depth):
                gap = along[row, tree, level] - self.thresholds[level][tree, node]
                left, right = gap <= margin, gap > -margin
                row, node = np.concatenate((row[left], row[right])), np.concatenate((2 * node[left], 2 * node[right] + 1))
            rows.append(row)
            codes.append((tree << self.depth) + node)
        return np.concatenate(rows), np.concatenate(codes)

    def search(self, along: np.ndarray, share: float) -> list[int]:
        """Codes of the leaves of one query, nearest first over all trees, until they hold the share of rows.

        One priority queue holds the open nodes of every tree. A node's
        priority is its path's worst signed distance to a threshold.
        """
        queue = [(-np.inf, t, 0, 0) for t in range(self.trees)]
        heapq.heapify(queue)
        found, held = [], 0.0
        while queue and held < share:
            cost, tree, level, node = heapq.heappop(queue)
            if level == self.depth:
                found.append((tree << self.depth) + node)
                held += self.share[tree, node]
                continue
            gap = along[tree, level] - self.thresholds[level][tree, node]
            heapq.heappush(queue, (max(cost, gap), tree, level + 1, 2 * node))
            heapq.heappush(queue, (max(cost, -gap), tree, level + 1, 2 * node + 1))
        return found


def fit(entries: DataFrame, trees: int, leaf_rows: int, seed: int, fit_rows: int = FIT_ROWS, least_spread: float = 0.0) -> Forest | None:
    """Thresholds from a bounded sample of ``entries(id, v)``; the depth follows the number of entries as far as the sample fills the nodes.

    A node whose standard deviation along its direction is below ``least_spread`` is not split: all its rows go left.
    """
    size = entries.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dim")).first()
    if not size["n"]:
        return None
    grid = 1 << 30
    sample = entries if size["n"] <= fit_rows else entries.where(F.pmod(F.xxhash64("id"), F.lit(grid)) < int(grid * fit_rows / size["n"]))
    dim = size["dim"]
    unit = _unit(_matrix(sample.select("v").toArrow().column("v"), dim)) if size["n"] else np.zeros((0, dim))
    depth = max(0, min(int(np.ceil(np.log2(size["n"] / leaf_rows))), int(np.log2(max(1, len(unit)) / NODE_ROWS))))
    rng = np.random.default_rng(seed)
    ways = rng.normal(size=(trees, depth, dim))
    ways /= np.linalg.norm(ways, axis=2, keepdims=True)
    along = np.einsum("nd,tld->ntl", unit, ways)
    thresholds, node = [], np.zeros((len(unit), trees), np.int64)
    for level in range(depth):
        limit = np.zeros((trees, 1 << level))
        for tree in range(trees):
            order = np.argsort(node[:, tree], kind="stable")
            parts = np.split(order, np.searchsorted(node[order, tree], np.arange(1, 1 << level)))
            whole = np.median(along[:, tree, level]) if len(unit) else 0.0
            limit[tree] = [np.inf if len(p) > 1 and along[p, tree, level].std() < least_spread else np.median(along[p, tree, level]) if len(p) else whole for p in parts]
        thresholds.append(limit)
        node = 2 * node + (along[:, :, level] > limit[np.arange(trees), node])
    share = np.stack([np.bincount(node[:, t], minlength=1 << depth) for t in range(trees)]) / max(1, len(unit))
    return Forest(dim, ways, thresholds, share)


def nearest(
    vectors: DataFrame, query_of: str, k: int = 5, trees: int = 8, leaf_rows: int = 800, share: float = 1.5, seed: int = 5, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """The ``k`` nearest vectors found of each query: ``query_id, rank, vec_id, score``.

    Queries are the usable vectors for which the condition ``query_of`` on
    ``id`` holds; candidates are all usable vectors but the query's own row.
    The score is the cosine in double precision; ties go to the smaller id.
    ``share`` is the number of rows (with repeats over trees, as a share of all
    rows) that a query reads in its leaves before the exact ranking. Rows that
    repeat an id count as candidates of that id once. No queries or no
    candidates give no rows.
    """
    ws = Workspace(vectors.sparkSession, "nearest")
    rows = ws.save(usable(vectors, id_col, vector_col).distinct(), "rows")
    first = Window.partitionBy("v").orderBy("id")
    # Of equal vectors, the k + 1 smallest ids are all that a query can return.
    listed = rows.withColumn("n", F.row_number().over(first)).where(F.col("n") <= k + 1).groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    entries = ws.save(listed.select(F.col("ids")[0].alias("id"), "v", "ids"), "entries")
    model = fit(entries.select("id", "v"), trees, leaf_rows, seed)
    asked = rows.where(query_of).select(F.col("id").alias("query_id"), "v").join(entries.select("v", F.col("id").alias("q")), "v")
    asked = ws.save(asked.select("query_id", "q", "v"), "asked")
    schema = "query_id long, rank int, vec_id long, score double"
    if model is None:
        return vectors.sparkSession.createDataFrame([], schema)
    shared = vectors.sparkSession.sparkContext.broadcast(model)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = shared.value
        for batch in batches:
            node = forest.leaves(_unit(_matrix(batch.column(1), forest.dim)))
            codes = node + (np.arange(forest.trees) << forest.depth)
            take = pa.array(np.repeat(np.arange(batch.num_rows), forest.trees))
            yield pa.RecordBatch.from_arrays([pa.array(codes.reshape(-1)), batch.column(0).take(take), batch.column(1).take(take)], names=["code", "id", "v"])

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = shared.value
        for batch in batches:
            along = forest.project(_unit(_matrix(batch.column(1), forest.dim)))
            found = [forest.search(a, share) for a in along]
            take = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]))
            codes = pa.array([c for f in found for c in f], pa.int64())
            yield pa.RecordBatch.from_arrays([codes, batch.column(0).take(take), batch.column(1).take(take)], names=["code", "id", "v"])

    def rank(queries: pa.Table, leaf: pa.Table) -> pa.Table:
        none = pa.table({"q": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        if not queries.num_rows or not leaf.num_rows:
            return none
        dim = shared.value.dim
        a, b = _matrix(queries.column("v"), dim), _matrix(leaf.column("v"), dim)
        length = np.sqrt((b * b).sum(1))
        ask, ids = queries.column("id").to_numpy(), leaf.column("id").to_numpy()
        out = []
        for at in range(0, len(a), 512):
            part = a[at : at + 512]
            score = part @ b.T / (np.sqrt((part * part).sum(1))[:, None] * length)
            score[ask[at : at + 512, None] == ids] = -2
            take = np.argpartition(-score, min(k, len(b)) - 1, axis=1)[:, :k]
            best = np.take_along_axis(score, take, 1)
            row, col = np.nonzero(best > -2)
            out.append((ask[at + row], ids[take[row, col]], best[row, col]))
        return pa.table({n: np.concatenate(x) for n, x in zip(("q", "id", "score"), zip(*out, strict=True), strict=True)})

    tiny = "code long, id long, v array<float>"
    index = entries.select("id", "v").mapInArrow(route, _with_vector(entries, tiny))
    index = ws.save(index, "index")
    blocks = index.groupBy("code").agg(F.ceil(F.count("*") / F.lit(BLOCK_ROWS)).alias("blocks"))
    index = index.join(blocks, "code").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    visits = asked.select(F.col("q").alias("id"), "v").dropDuplicates(["id"]).mapInArrow(visit, _with_vector(entries, tiny))
    visits = visits.join(blocks, "code").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    keys = ["code", "block"]
    met = visits.select(*keys, "id", "v").groupBy(*keys).cogroup(index.select(*keys, "id", "v").groupBy(*keys)).applyInArrow(rank, "q long, id long, score double")
    best = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    top = met.groupBy("q", "id").agg(F.max("score").alias("score")).withColumn("n", F.row_number().over(best)).where(F.col("n") <= k)
    own = asked.select("q").distinct().select("q", F.col("q").alias("id"), F.lit(None).cast("double").alias("score"))
    wide = top.select("q", "id", "score").unionByName(own).join(entries.select("id", "v", "ids"), "id")
    dot = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    wide = wide.select("q", F.explode("ids").alias("vec_id"), F.coalesce("score", dot / (F.sqrt(dot) * F.sqrt(dot))).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    out = asked.select("query_id", "q").join(wide, "q").where("vec_id != query_id").withColumn("rank", F.row_number().over(order))
    return out.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _with_vector(entries: DataFrame, ddl: str) -> str:
    return ddl.replace("array<float>", entries.schema["v"].dataType.simpleString())


def near_duplicates(
    vectors: DataFrame, cosine: float = 0.95, trees: int = 6, leaf_rows: int = 256, seed: int = 6, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """One row per vector: ``vec_id, n_links, component_id, kept``.

    Vectors link at a cosine of at least ``cosine`` in double precision. Rows
    are compared within the leaves of spill trees; the overlap is 0.75 standard
    deviations of the projected distance of a pair at the threshold, and a node
    that spreads less than two of them is not split but compared whole, in
    blocks, so that a tree parts such a pair with a probability of some
    hundredths whatever the density, all trees of about 1e-8 to 1e-6. Every link is counted once, in the first leaf that its
    ends share. Vectors that take no part have no links and are kept, as are
    null ids. Rows that repeat an id and a vector count once.
    """
    ws = Workspace(vectors.sparkSession, "near-vectors")
    rows = ws.save(usable(vectors, id_col, vector_col).distinct(), "rows")
    entries = ws.save(rows.groupBy("v").agg(F.min("id").alias("id"), F.count("*").alias("copies")), "entries")
    apart = float(np.sqrt(2 * (1 - cosine) / max(1, rows.agg(F.max(F.size("v"))).first()[0] or 1)))
    model = fit(entries.select("id", "v"), trees, leaf_rows, seed, least_spread=2 * apart)
    every = vectors.select(F.col(id_col).cast("long").alias("id"))
    if model is None:
        return every.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    shared = vectors.sparkSession.sparkContext.broadcast(model)
    margin = 0.75 * apart

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = shared.value
        for batch in batches:
            row, code = forest.spilled(_unit(_matrix(batch.column(1), forest.dim)), margin)
            order = np.lexsort((code, row))
            row, code = row[order], code[order]
            ends = np.searchsorted(row, np.arange(batch.num_rows + 1))
            codes = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(code))
            take = pa.array(row)
            columns = [pa.array(code), *(batch.column(i).take(take) for i in range(3)), codes.take(take)]
            yield pa.RecordBatch.from_arrays(columns, names=["code", "id", "v", "copies", "codes"])

    def compare(key: tuple, table: pa.Table) -> pa.Table:
        here, low, high = (int(k.as_py()) for k in key)
        dim = shared.value.dim
        x = _matrix(table.column("v"), dim)
        length = np.sqrt((x * x).sum(1))
        ids, copies, block = (table.column(c).to_numpy() for c in ("id", "copies", "block"))
        codes = table.column("codes").combine_chunks()
        owner, flat = np.repeat(np.arange(len(ids)), codes.value_lengths().to_numpy()), codes.flatten().to_numpy()
        owner, flat = owner[flat < here], flat[flat < here]
        # Which rows lie in which earlier leaf: two rows that share one were counted there.
        _, leaf = np.unique(flat, return_inverse=True)
        earlier = np.zeros((len(ids), int(leaf.max(initial=-1)) + 1), np.float32)
        earlier[owner, leaf] = 1
        left = np.flatnonzero(block == low)
        right = np.flatnonzero(block == high)
        links, root = np.zeros(len(ids)), np.arange(len(ids))
        for at in range(0, len(left), 512):
            part = left[at : at + 512]
            near = x[part] @ x[right].T / (length[part][:, None] * length[right]) >= cosine
            if low == high:
                near &= part[:, None] < right
            if not near.any():
                continue
            fresh = (near & (earlier[part] @ earlier[right].T == 0)).astype(np.float64)
            links[part] += fresh @ copies[right]
            links[right] += copies[part] @ fresh
            i, j = np.nonzero(near & (root[part][:, None] != root[right]))
            root = _unite(root, part[i], right[j])
        some = (links > 0) | (root != np.arange(len(ids)))
        lowest = np.full(len(ids), np.iinfo(np.int64).max)
        np.minimum.at(lowest, root, ids)
        return pa.table({"id": ids[some], "links": links[some].astype(np.int64), "root": lowest[root[some]]})

    leaves = ws.save(entries.select("id", "v", "copies").mapInArrow(spread, _with_vector(entries, "code long, id long, v array<float>, copies long, codes array<long>")), "leaves")
    blocks = leaves.groupBy("code").agg(F.count("*").alias("n")).where("n > 1").select("code", F.ceil(F.col("n") / F.lit(BLOCK_ROWS)).alias("blocks"))
    leaves = leaves.join(blocks, "code").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    leaves = leaves.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    pairs = leaves.select("code", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "id", "v", "copies", "codes", "block")
    found = ws.save(pairs.groupBy("code", "low", "high").applyInArrow(compare, "id long, links long, root long"), "found")
    labels = connected_components(found.select(F.col("id").alias("a"), F.col("root").alias("b")), ws)
    counted = entries.select("v", "id", "copies").join(found.groupBy("id").agg(F.sum("links").alias("links")), "id", "left")
    counted = counted.join(labels, counted["id"] == labels["node"], "left")
    named = counted.select("v", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    known = rows.join(named, "v").groupBy("id").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    out = every.join(known, "id", "left").select("id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def _unite(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Roots after joining the pairs (i, j); roots are positions."""
    while len(i):
        a, b = root[i], root[j]
        differ = a != b
        i, j, a, b = i[differ], j[differ], a[differ], b[differ]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]
    return root
