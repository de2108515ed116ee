"""Best-fit packing of whole documents into sequences, certified by lower bounds.

A document is its token ids and a separator. Only documents longer than a
sequence are cut; their full pieces are sequences of their own, and what is left
of them is an item like any short document. Items are packed by partition:

1. items are dealt to partitions of a bounded number of items, and each
   partition is packed by best fit decreasing;
2. dual feasible functions give a lower bound on the sequences that any set of
   items needs: f(size) sums to at most 1 over a full sequence, so the sum over the
   items, rounded up, bounds their number. The sums add up over partitions, so
   the bound of two partitions together needs only their sums;
3. in round r, partition p meets partition p xor 2^r. Where their sequences are
   as many as their common bound, both are certified; where there is a gap, they
   exchange all documents, run best fit decreasing again, keep the result if it
   has fewer sequences, and share its sequences out evenly, so that no partition
   grows. Rounds go on until the bound of the whole corpus is met or no round of a
   sweep helps.

Token ids are made and checked once, where the text is read; items are twelve
bytes each, and only they are moved between partitions.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulewright.llm.bpe import codec
from rulewright.storage import Workspace

SEQUENCE = 1024
#: Items of a partition on average: what one task packs at a time.
PART_ITEMS = 1 << 13
#: Lower bounds: cuts of the rounding functions at most, and denominators of the multiple-of-a-fraction functions.
_CUTS, _FRACTIONS = 512, 100
_STATE = "part long, bins long, uids array<long>, sizes array<int>, bin array<int>, offset array<int>, sums array<long>"


@lru_cache(maxsize=4)
def dual_feasible(capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Numerators of each function at each size (functions x sizes) and the functions' denominators.

    The sizes themselves; for each cut c, sizes over capacity - c count as whole
    and sizes under c as nothing; for each k, sizes are rounded down to multiples of
    1/k after scaling by k + 1, save those that are exact multiples of 1/(k + 1).
    """
    x = np.arange(capacity + 1, dtype=np.int64)
    rows, below = [x], [capacity]
    for cut in np.unique(np.linspace(1, max(1, capacity // 2), _CUTS).astype(np.int64)).tolist():
        rows.append(np.where(x > capacity - cut, capacity, np.where(x >= cut, x, 0)))
        below.append(capacity)
    for k in range(1, _FRACTIONS + 1):
        rows.append(np.where(x * (k + 1) % capacity == 0, x * k, (k + 1) * x // capacity * capacity))
        below.append(k * capacity)
    return np.array(rows), np.array(below, np.int64)


def lower_bound(sums: np.ndarray, capacity: int) -> int:
    """Sequences that items need at least, by the sums of all functions over them."""
    return int(np.max(-(-sums // dual_feasible(capacity)[1])))


def _sums(sizes: np.ndarray, capacity: int) -> np.ndarray:
    return dual_feasible(capacity)[0] @ np.bincount(sizes, minlength=capacity + 1)


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Best fit decreasing: each item's sequence, its place there, and the number of sequences. Equal items keep their order."""
    bins, offset, made = np.zeros(len(sizes), np.int32), np.zeros(len(sizes), np.int32), 0
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r is set where a sequence has room for exactly r more
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fits = rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            to = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            to, room, made = made, capacity, made + 1
        bins[i], offset[i] = to, capacity - room
        room -= size
        if room:
            by_room[room].append(to)
            rooms |= 1 << room
    return bins, offset, made


def cut_pieces(docs: DataFrame, path: str, separator: int, sequence: int, with_ids: bool) -> DataFrame:
    """``docs(id, text)`` to pieces ``uid, id, piece, start, length, ids_crc32`` and, if asked for, ``input_ids``."""
    kind = docs.schema["id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = codec(path)
        uid = TaskContext.get().partitionId() << 40
        for batch in batches:
            rows, numbers, starts, lengths, sums, parts = [], [], [], [], [], []
            for row, text in enumerate(batch.column(1).to_pylist()):
                ids = np.array([*book.encode(text), separator], "<u4")
                edges = [0, *range((len(ids) - 1) % sequence + 1, len(ids) + 1, sequence)]
                for piece, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
                    rows.append(row)
                    numbers.append(piece)
                    starts.append(a)
                    lengths.append(b - a)
                    sums.append(crc32(ids[a:b]))
                    if with_ids:
                        parts.append(ids[a:b].astype(np.int32))
            columns = [pa.array(np.arange(uid, uid + len(rows))), batch.column(0).take(pa.array(rows, pa.int64())), pa.array(numbers, pa.int32()), *(pa.array(x, pa.int64()) for x in (starts, lengths, sums))]
            names = ["uid", "id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns.append(pa.array(parts, pa.list_(pa.int32())))
                names.append("input_ids")
            uid += len(rows)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(cut, f"uid long, id {kind}, piece int, start long, length long, ids_crc32 long" + ", input_ids array<int>" * with_ids)


def _state(parts: list[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]], capacity: int) -> pa.Table:
    """Partitions (number, uids, sizes, sequence of each, offset of each) as rows of ``_STATE``."""
    lists = [[p[i] for p in parts] for i in range(1, 5)]
    return pa.table(
        {
            "part": pa.array([p[0] for p in parts], pa.int64()),
            "bins": pa.array([int(p[3].max(initial=-1)) + 1 for p in parts], pa.int64()),
            **{name: pa.array(x, pa.list_(kind)) for name, x, kind in zip(("uids", "sizes", "bin", "offset"), lists, (pa.int64(), pa.int32(), pa.int32(), pa.int32()), strict=True)},
            "sums": pa.array([_sums(p[2], capacity) for p in parts], pa.list_(pa.int64())),
        }
    )


def pack_items(items: DataFrame, capacity: int = SEQUENCE, part_items: int = PART_ITEMS) -> DataFrame:
    """``items(uid, size)`` with 1 <= size <= capacity to ``uid, sequence_id, offset``, in as few sequences as the method finds.

    ``uid`` must tell the items apart. Partition p numbers its sequences from p * 2^32.
    """
    ws = Workspace(items.sparkSession, "bestfit")
    histogram = items.groupBy("size").count().collect()  # one row for each size: at most ``capacity``
    total = sum(r["count"] for r in histogram)
    sizes = np.zeros(capacity + 1, np.int64)
    for r in histogram:
        sizes[r["size"]] = r["count"]
    bound = lower_bound(dual_feasible(capacity)[0] @ sizes, capacity)
    parts = max(1, math.ceil(total / part_items))

    def first(table: pa.Table) -> pa.Table:
        table = table.sort_by("uid")
        own = table.column("size").to_numpy().astype(np.int64)
        return _state([(table.column("part")[0].as_py(), table.column("uid").to_numpy(), own, *best_fit(own, capacity)[:2])], capacity)

    def exchange(table: pa.Table) -> pa.Table:
        table = table.sort_by("part")
        uids, own, old = (np.concatenate([np.asarray(x, np.int64) for x in table.column(c).to_pylist()]) for c in ("uids", "sizes", "bin"))
        order = np.argsort(uids, kind="stable")
        uids, own = uids[order], own[order]
        bins, offset, made = best_fit(own, capacity)
        if made >= sum(table.column("bins").to_pylist()):
            return table.drop_columns(["low"])
        sides = [(p, np.flatnonzero(bins % 2 == i)) for i, p in enumerate(table.column("part").to_pylist())]
        return _state([(p, uids[at], own[at], bins[at] // 2, offset[at]) for p, at in sides], capacity)

    dealt = items.select("uid", F.col("size").cast("int").alias("size"), F.pmod(F.xxhash64("uid"), F.lit(parts)).alias("part"))
    state, step, made = ws.save(dealt.groupBy("part").applyInArrow(first, _STATE), "state-0"), 0, None
    below = F.array(*(F.lit(int(d)) for d in dual_feasible(capacity)[1]))
    while made is None or bound < now < made:
        made = now if made is not None else math.inf
        for bit in (1 << r for r in range((parts - 1).bit_length())):
            known = state.select("part", "bins", "sums")
            high = known.where(F.col("part").bitwiseAND(bit) != 0).select((F.col("part") - bit).alias("part"), F.col("bins").alias("more"), F.col("sums").alias("other"))
            both = F.zip_with(F.zip_with("sums", "other", lambda a, b: a + b), below, lambda s, d: F.ceil(s / d))
            gaps = known.join(high, "part").where(F.col("bins") + F.col("more") > F.array_max(both)).select(F.col("part").alias("low"), F.lit(True).alias("gap"))
            if gaps.isEmpty():
                continue
            paired = state.withColumn("low", F.col("part") - F.col("part").bitwiseAND(bit)).join(gaps, "low", "left")
            met = paired.where("gap").drop("gap").groupBy("low").applyInArrow(exchange, _STATE)
            after = ws.save(met.unionByName(paired.where("gap IS NULL").drop("low", "gap")), f"state-{step + 1}")
            ws.drop(f"state-{step}")
            state, step = after, step + 1
        now = state.agg(F.sum("bins")).first()[0] or 0
    rows = state.select("part", F.explode(F.arrays_zip("uids", "bin", "offset")).alias("at"))
    return rows.select(F.col("at.uids").alias("uid"), (F.col("part") * (1 << 32) + F.col("at.bin")).alias("sequence_id"), F.col("at.offset").cast("long").alias("offset"))


def pack(docs: DataFrame, path: str, separator: int = 2, sequence: int = SEQUENCE, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text", part_items: int = PART_ITEMS) -> DataFrame:
    """One row per piece of a document: where it starts in it and where it lies.

    ``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` and, if asked
    for, ``input_ids``. A document of at most ``sequence`` ids (with its separator)
    is one piece; a longer one is cut into pieces of that length, of which the first
    may be shorter. An empty or null text is a document of one id. Rows with null
    or repeated ids are packed like any other; other columns are not read; an empty
    table gives no pieces. Sequence numbers are unique and have no order.
    """
    ws = Workspace(docs.sparkSession, "pieces")
    pieces = ws.save(cut_pieces(docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text")), path, separator, sequence, with_ids), "pieces")
    short = pieces.where(F.col("length") < sequence)
    placed = pack_items(short.select("uid", F.col("length").alias("size")), sequence, part_items)
    whole = pieces.where(F.col("length") == sequence).withColumns({"sequence_id": -1 - F.col("uid"), "offset": F.lit(0).cast("long")})
    return short.join(placed, "uid").unionByName(whole).drop("uid").withColumnRenamed("id", id_col)
