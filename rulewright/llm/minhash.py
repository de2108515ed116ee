"""Near-duplicate documents by min-max hashing.

Under each permutation both the minimum and the maximum of a document's shingle
hashes are kept: two signature values for one hash evaluation, each agreeing
with probability equal to the Jaccard similarity. Minima fill the first half of
the bands and maxima the second, so the values of one band always come from
different permutations.

Defaults: 60 permutations give 120 values in 24 bands of 5. A pair of
similarity 0.8 shares no band with probability (1 - 0.8**5)**24 = 7e-5.

Plan: one pass computes set digests and band keys. Rows with equal sets collapse
to one node, whatever their ids. In each band bucket every member is confirmed
against the bucket's first node on full sets, and the confirmed links are
united. Then buckets that still hold several components are opened again: their
members meet in groups of bounded size, where the set sizes of all pairs of
different components are counted. Only links that unite components leave a
group, so no bucket emits all its pairs, and no candidate is dropped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rulewright.llm.components import connected_components
from rulewright.llm.names import fresh
from rulewright.llm.shingles import constants, mix, shingle_sets
from rulewright.storage import TEXT_ROWS, Workspace

SIGNATURE = "id long, t1 long, t2 long, n_shingles long, k1 long, k2 long, bands array<long>"


def _texts(column: pa.Array) -> list[bytes]:
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x if x is not None else b"" for x in column.cast(kind).to_pylist()]


def signatures(docs: DataFrame, width: int = 4, permutations: int = 60, rows: int = 5) -> DataFrame:
    """``docs(id, t1, t2, text)`` to set size, set digest and band keys of every row; ``t1, t2`` name its text."""
    assert permutations % rows == 0
    n_bands = 2 * permutations // rows
    slope, shift = constants(permutations, 101), constants(permutations, 202)
    weight = constants(rows, 303)
    salt = constants(n_bands, 404)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = _texts(batch.column(3))
            n = len(texts)
            sizes = np.zeros(n, np.int64)
            digest = np.zeros((n, 2), np.int64)
            keys = np.zeros((n, n_bands), np.uint64)
            for first, offsets, values in shingle_sets(texts, width):
                count = np.diff(offsets)
                sizes[first : first + len(count)] = count
                full = np.flatnonzero(count)
                if not len(full):
                    continue
                begin = offsets[full]
                for i, a, b in zip((full + first).tolist(), begin.tolist(), offsets[full + 1].tolist(), strict=True):
                    digest[i] = np.frombuffer(hashlib.blake2b(values[a:b], digest_size=16).digest(), np.int64)
                sig = np.empty((2 * permutations, len(full)), np.uint64)
                for p in range(permutations):
                    y = values * slope[p] + shift[p]
                    np.minimum.reduceat(y, begin, out=sig[p])
                    np.maximum.reduceat(y, begin, out=sig[permutations + p])
                folded = (mix(sig).reshape(n_bands, rows, -1) * weight[None, :, None]).sum(1, dtype=np.uint64)
                keys[full + first] = mix(folded + salt[:, None]).T
            some = sizes > 0
            ends = np.concatenate(([0], np.cumsum(some * n_bands))).astype(np.int32)
            bands = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys[some].reshape(-1).view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(sizes), pa.array(digest[:, 0]), pa.array(digest[:, 1]), bands],
                names=["id", "t1", "t2", "n_shingles", "k1", "k2", "bands"],
            )

    return docs.select("id", "t1", "t2", "text").mapInArrow(sign, SIGNATURE)


def _pair_links(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` whose full shingle sets meet the similarity, by exact set sizes."""
    left = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")).hint("merge")
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")).hint("merge")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = []
            for id_at, text_at in ((0, 1), (2, 3)):
                ids = batch.column(id_at).to_numpy(zero_copy_only=False)
                _, once, back = np.unique(ids, return_index=True, return_inverse=True)
                parts = _texts(batch.column(text_at).take(pa.array(once)))
                sides.append((ids, [v for _, o, values in shingle_sets(parts, width) for v in np.split(values, o[1:-1])], back))
            (ids_a, sets_a, at_a), (ids_b, sets_b, at_b) = sides
            good = np.zeros(len(ids_a), bool)
            for i, (p, q) in enumerate(zip(at_a.tolist(), at_b.tolist(), strict=True)):
                x, y = sets_a[p], sets_b[q]
                if 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)) > 0:
                    both = np.concatenate((x, y))
                    both.sort()
                    common = int((both[1:] == both[:-1]).sum())
                    good[i] = 100 * common >= percent * (len(x) + len(y) - common)
            yield pa.RecordBatch.from_arrays([pa.array(ids_a[good]), pa.array(ids_b[good])], names=["a", "b"])

    joined = pairs.join(right, "b").join(left, "a").select("a", "text_a", "b", "text_b")
    return joined.mapInArrow(compare, "a long, b long")


#: Shingles of the members of an opened bucket that meet in one block; larger buckets are cut into blocks that meet in pairs.
BLOCK_SHINGLES = 1 << 19


def _bucket_links(opened: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Links between different components of a bucket, ``opened(key, node, part, n_shingles)``; enough of them to unite all."""

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [v.tobytes() for _, o, values in shingle_sets(_texts(batch.column(1)), width) for v in np.split(values, o[1:-1])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["node", "shingles"])

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, 3):
            a, b = _group_links(*(group.column(i).to_numpy() for i in (1, 2, 3, 4, 5)), group.column(6).to_pylist(), percent)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    nodes = opened.select("node").distinct()
    sets = texts.join(nodes.hint("merge"), "node", "left_semi").select("node", "text").mapInArrow(sets_of, "node long, shingles binary")
    sizes = opened.groupBy("key").agg(F.ceil(F.sum("n_shingles") / F.lit(BLOCK_SHINGLES)).alias("blocks"))
    rows = opened.join(sizes, "key").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    rows = rows.select("key", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "node", "part", "block")
    rows = rows.join(sets.hint("merge"), "node").select("key", "low", "high", "node", "part", "block", "shingles")
    return rows.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high").mapInArrow(unite, "a long, b long")


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Runs of rows of equal first columns, across batch borders."""
    held: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        edges = np.zeros(max(0, held.num_rows - 1), bool)
        for i in range(keys):
            values = held.column(i).to_numpy()
            edges |= values[1:] != values[:-1]
        cuts = [0, *(np.flatnonzero(edges) + 1).tolist()]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield held.slice(a, b - a)
        held = held.slice(cuts[-1]).combine_chunks()
    if held is not None and held.num_rows:
        yield held


def _group_links(low: np.ndarray, high: np.ndarray, ids: np.ndarray, part: np.ndarray, block: np.ndarray, sets: list[bytes], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between different parts of one group, each uniting two parts that were apart.

    A row's shared sizes with all others come from one count over the holders
    of its shingles. Of two different blocks only pairs across are compared.
    """
    values = [np.frombuffer(s, np.uint64) for s in sets]
    size = np.fromiter(map(len, values), np.int64, len(values))
    flat = np.concatenate(values)
    owner = np.repeat(np.arange(len(values)), size)
    order = np.argsort(flat, kind="stable")
    _, first, back, count = np.unique(flat[order], return_index=True, return_inverse=True, return_counts=True)
    term = np.empty(len(flat), np.int64)
    term[order] = back
    holder, begin = owner[order], np.concatenate(([0], np.cumsum(size)))
    _, root = np.unique(part, return_inverse=True)
    a, b = [], []
    for i in range(len(values)):
        mine = term[begin[i] : begin[i + 1]]
        mine = mine[count[mine] > 1]
        reach = count[mine]
        at = np.repeat(first[mine] - np.concatenate(([0], np.cumsum(reach)[:-1])), reach) + np.arange(reach.sum())
        common = np.bincount(holder[at], minlength=len(values))
        near = (100 * common >= percent * (size[i] + size - common)) & (root != root[i])
        if low[0] != high[0]:
            near &= block != block[i]
        for j in np.flatnonzero(near).tolist():
            if root[j] != root[i]:
                a.append(ids[i])
                b.append(ids[j])
                root[root == root[j]] = root[i]
    return np.array(a, np.int64), np.array(b, np.int64)


def _labelled(docs: DataFrame, width: int, percent: int, permutations: int, rows: int, id_col: str, text_col: str) -> DataFrame:
    """Per row ``id, t1, t2, n_shingles`` and ``best``, the id and text name of the first row of its component."""
    ws = Workspace(docs.sparkSession, "minhash")
    docs = docs.select(F.col(id_col).cast("long").alias("id"), *_name(text_col), F.col(text_col).alias("text"))
    sig = ws.save(signatures(docs, width, permutations, rows), "signatures", TEXT_ROWS)
    live = sig.where("n_shingles > 0 and id is not null")
    row = F.struct("id", "t1", "t2")
    reps = live.groupBy("k1", "k2").agg(F.min(row).alias("rep")).select("k1", "k2", "rep", F.monotonically_increasing_id().alias("node"))
    reps = ws.save(reps, "reps")
    one = live.join(reps, ["k1", "k2"]).where(row == F.col("rep")).dropDuplicates(["node"]).select("node", "id", "t1", "t2", "n_shingles", "bands")
    one = ws.save(one, "one")
    keyed = one.select("node", "n_shingles", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.min("node").alias("pivot"), F.max("node").alias("last")).where("pivot != last")
    members = ws.save(keyed.join(shared.select("key", "pivot"), "key"), "members")
    wanted = one.select("node", "id", "t1", "t2").join(members.select("node").distinct().hint("merge"), "node", "left_semi")
    texts = ws.save(docs.join(wanted.hint("merge"), ["id", "t1", "t2"]).select("node", "text").dropDuplicates(["node"]), "texts")

    pairs = members.where("node != pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()
    links = ws.save(_pair_links(pairs, texts, width, percent), "pair-links", TEXT_ROWS)
    labels = ws.save(connected_components(links, ws, "pair-cc"), "pair-labels")
    marked = members.join(labels.withColumnRenamed("component", "part"), "node", "left").select("key", "node", "n_shingles", F.coalesce("part", "node").alias("part"))
    open_keys = marked.groupBy("key").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo != hi").select("key")
    opened = ws.save(marked.join(open_keys, "key").dropDuplicates(["key", "node"]), "opened")
    more = ws.save(_bucket_links(opened, texts, width, percent), "bucket-links", TEXT_ROWS)
    ws.drop("one", "texts", "members", "opened")
    both = more.unionByName(labels.select(F.col("node").alias("a"), F.col("component").alias("b")))
    labels = ws.save(connected_components(both, ws, "all-cc"), "labels")

    parts = reps.join(labels.hint("merge"), "node")
    best = parts.join(parts.groupBy("component").agg(F.min("rep").alias("best")), "component").select("node", "best")
    nodes = reps.join(best, "node", "left").select("k1", "k2", F.coalesce("best", "rep").alias("best"))
    joined = sig.select("id", "t1", "t2", "n_shingles", "k1", "k2").join(nodes, ["k1", "k2"], "left")
    alone = (F.col("n_shingles") == 0) | F.col("id").isNull()
    return joined.select("id", "t1", "t2", "n_shingles", F.when(alone, row).otherwise(F.col("best")).alias("best"))


def _name(text_col: str) -> list[Column]:
    return [F.xxhash64(text_col).alias("t1"), F.xxhash64(F.lit(31), text_col).alias("t2")]


def near_duplicates(
    docs: DataFrame, width: int = 5, percent: int = 80, permutations: int = 60, rows: int = 5, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per input row: id, ``n_shingles``, ``component_id``, ``kept``.

    Documents link when 100 * shared shingles >= percent * united shingles;
    ``component_id`` is the smallest id reachable over links. A null or blank
    text has no shingles and links with nothing. Rows with a null id link with
    nothing and stay their own (null) component, kept. Rows that share an id but
    not their text are documents of their own: each has the component of its
    text, and is kept if its id is the component's. Other columns are not read,
    whatever their names.
    """
    found = _labelled(docs, width, percent, permutations, rows, id_col, text_col).select("id", "n_shingles", F.col("best.id").alias("component_id"))
    return found.select(F.col("id").alias(id_col), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


#: A table of dropped rows up to this many bytes, at 40 a row, is broadcast; a larger one is joined by shuffle.
BROADCAST_BYTES = 32 << 20


def keep_first(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The first row of each component, by id and then by a hash of the text; all columns stay.

    Only the rows that lose to another row of their component go, not all rows
    of their id. Rows that are equal in id and text are one document and stay
    or go together.
    """
    ws = Workspace(docs.sparkSession, "minhash-keep")
    found = _labelled(docs, width, percent, 60, 5, id_col, text_col)
    names = fresh(docs, "gone_id", "gone_t1", "gone_t2")
    gone = ws.save(found.where("struct(id, t1, t2) != best").select("id", "t1", "t2").distinct(), "gone").toDF(*names)
    gone = F.broadcast(gone) if 40 * gone.count() <= BROADCAST_BYTES else gone.hint("merge")
    own = [F.col(id_col).cast("long"), *_name(text_col)]
    lost = [x == F.col(n) for x, n in zip(own, names, strict=True)]
    return docs.join(gone, lost, "left_anti")
