"""Mixture-controlled packing of documents into fixed-length token sequences.

Each source is a queue of tokens. Output is laid out in windows of
``WINDOW`` tokens. In every window each queue earns a credit (its target share
of the window), sends the whole tokens that its credit covers, and carries the
fractional deficit to the next window: deficit round-robin with the sources
served in a fixed order. When queues run dry, one window is filled by rounds
over what is left, and the shares of the others grow in proportion. Without
given weights the targets are the corpus's own proportions, so all queues run
dry together.

The credit of a queue after any window has a closed form, so partitions need no
running state: the plan (per queue and segment of windows: tokens taken, deficit
and credit) is made from the token total of each queue. Each task counts the
tokens of its own documents by queue while tokenizing; the sums by task and
queue give each task its offset in each queue; then every task cuts its own
documents at window and sequence boundaries. Token ids are written once and
never shuffled, unless the table of offsets outgrows a broadcast.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rulewright.llm.bpe import codec
from rulewright.storage import TEXT_ROWS, Workspace

SEQUENCE = 1024
WINDOW = 64 * SEQUENCE
#: Sources with a queue of their own besides those that weights name: the largest. Smaller ones share ``SHARED`` queues by hash, which bounds the plan.
OWN_QUEUES = 1024
SHARED = 64
#: Offsets (rows of task and queue) that are broadcast; more are joined by shuffle.
BROADCAST_ROWS = 200_000
#: Fraction bits of credits, and windows of one segment, so that products fit 63 bits.
_BITS, _SPAN = 24, 1 << 20


@dataclass
class Plan:
    """Segments of windows with constant credits; arrays are segments x queues."""

    queues: list[str]
    totals: np.ndarray
    first: list[int]
    taken: np.ndarray
    deficit: np.ndarray
    credit: np.ndarray

    def quota(self, windows: np.ndarray) -> np.ndarray:
        """Tokens that each queue has sent before each window (windows x queues)."""
        at = np.searchsorted(self.first, windows, side="right") - 1
        steps = (windows - np.asarray(self.first)[at])[:, None]
        sent = self.taken[at] + ((self.deficit[at] + steps * self.credit[at]) >> _BITS)
        return np.minimum(sent, self.totals)

    def window_of(self, queue: int, position: int) -> int:
        """The window that sends a queue's token."""
        at = max(0, bisect_right(self.taken[:, queue].tolist(), position) - 1)
        while at + 1 < len(self.first) and self.taken[at + 1, queue] <= position:
            at += 1
        credit = int(self.credit[at, queue])
        gone = ((position - int(self.taken[at, queue])) << _BITS) - int(self.deficit[at, queue])
        w = self.first[at] + (max(0, gone) // credit if credit else 0)
        while w > 0 and self.quota(np.array([w]))[0, queue] > position:
            w -= 1
        while self.quota(np.array([w + 1]))[0, queue] <= position:
            w += 1
        return w


def _shares(weights: np.ndarray, live: np.ndarray, window: int) -> np.ndarray:
    """Fixed-point credits of one window; they sum to the window exactly."""
    w = np.where(live, weights, 0.0)
    if not w.sum():
        w = live.astype(float)
    whole = window << _BITS
    credit = np.floor(w / w.sum() * whole).astype(np.int64)
    credit[int(np.argmax(w))] += whole - int(credit.sum())
    return credit


def make_plan(totals: dict[str, int], weights: dict[str, float] | None = None, window: int = WINDOW) -> Plan:
    """Deficit round-robin over whole queues; ``weights`` are target token proportions."""
    queues = sorted(totals)
    total = np.array([totals[q] for q in queues], np.int64)
    weight = np.array([max(0.0, (weights or totals).get(q, 0.0)) for q in queues], float)
    sent, deficit = np.zeros(len(queues), np.int64), np.zeros(len(queues), np.int64)
    first, rows, w = [], [], 0

    def note(credit: np.ndarray) -> None:
        first.append(w)
        rows.append((sent.copy(), deficit.copy(), credit))

    while (sent < total).any():
        live = sent < total
        deficit[~live] = 0
        credit = _shares(weight, live, window)
        left = zip(*(x[live].tolist() for x in (total, sent, deficit, credit)), strict=True)
        steps = min(_SPAN, *((((t - s + 1) << _BITS) - 1 - d) // c for t, s, d, c in left if c))
        if steps:
            note(credit)
            gone = deficit + steps * credit
            sent, deficit = sent + (gone >> _BITS), gone & ((1 << _BITS) - 1)
            w += steps
            continue
        give, space = np.zeros(len(queues), np.int64), window
        while space and (sent + give < total).any():
            part = _shares(weight, sent + give < total, space) >> _BITS
            part = np.minimum(part, total - sent - give)
            if not part.any():
                part[int(np.argmax(total - sent - give))] = 1
            give, space = give + part, space - int(part.sum())
        deficit[:] = 0
        note(give << _BITS)
        sent, w = sent + give, w + 1
    note(np.zeros(len(queues), np.int64))
    taken, left, credits = (np.array(x, np.int64).reshape(len(rows), len(queues)) for x in zip(*rows, strict=True))
    return Plan(queues, total, first, taken, left, credits)


def tokenize(docs: DataFrame, path: str, separator: int) -> DataFrame:
    """``docs(id, queue, source, text)`` to ids and, per task and queue, each document's start."""
    kind = docs.schema["id"].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = codec(path)
        width = "<u2" if max(book.size, separator + 1) <= 1 << 16 else "<u4"
        task, seen = TaskContext.get().partitionId(), {}
        for batch in batches:
            queues, starts, sizes, ids = batch.column(1).to_pylist(), [], [], []
            for queue, text in zip(queues, batch.column(3).to_pylist(), strict=True):
                own = book.encode(text)
                own.append(separator)
                starts.append(seen.get(queue, 0))
                seen[queue] = starts[-1] + len(own)
                sizes.append(len(own))
                ids.append(np.array(own, width).tobytes())
            columns = [*batch.columns[:3], pa.array([task] * len(ids), pa.int64()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "queue", "source", "task", "begin", "n", "ids"])

    return docs.mapInArrow(count, f"id {kind}, queue string, source string, task long, begin long, n long, ids binary")


def _queued(docs: DataFrame, weights: dict[str, float] | None) -> DataFrame:
    """Add ``queue``: the source after "=", or the number of a shared queue after "#"."""
    sizes = docs.groupBy("source").agg(F.sum(F.octet_length("text")).alias("size"))
    own = F.concat(F.lit("="), F.coalesce("source", F.lit("\0")))
    if sizes.limit(OWN_QUEUES + 1).count() <= OWN_QUEUES:
        return docs.withColumn("queue", own)
    large = sizes.orderBy(F.desc("size"), "source").limit(OWN_QUEUES).select("source")
    if weights:
        named = docs.sparkSession.createDataFrame([(s,) for s in weights], "source string")
        large = large.union(named).distinct()
    large = F.broadcast(large.select(F.col("source").alias("large"), F.lit(True).alias("own")))  # OWN_QUEUES rows and the caller's weights
    tail = F.concat(F.lit("#"), F.pmod(F.xxhash64("source"), F.lit(SHARED)).cast("string"))
    return docs.join(large, docs["source"].eqNullSafe(large["large"]), "left").withColumn("queue", F.when(F.col("own"), own).otherwise(tail)).drop("large", "own")


def pack(
    docs: DataFrame, path: str, weights: dict[str, float] | None = None, separator: int = 0, sequence: int = SEQUENCE, window: int = WINDOW, with_ids: bool = False,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """One row per piece of a document: where it starts in it and where it lies.

    ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source``
    and, if asked for, ``input_ids``. A document is its token ids and the
    separator, so an empty or null text is one token. All sequences but the last
    are full. Rows with null or repeated ids are packed like any other; a null
    source is a source of its own. Every source that ``weights`` name and the
    ``OWN_QUEUES`` largest are queues of their own; if there are more, the smaller
    ones share queues, in their joint proportion. Empty tables give no pieces.
    """
    ws = Workspace(docs.sparkSession, "packing")
    docs = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), F.coalesce(text_col, F.lit("")).alias("text"))
    docs = _queued(docs, weights).select("id", "queue", "source", "text")
    weights = weights and {f"={s}": w for s, w in weights.items()}
    coded = ws.save(tokenize(docs, path, separator), "coded", TEXT_ROWS)
    sums = ws.save(coded.groupBy("queue", "task").agg(F.sum("n").alias("n")), "sums")
    totals = {r["queue"]: r["n"] for r in sums.groupBy("queue").agg(F.sum("n").alias("n")).collect()}  # as many rows as there are queues: OWN_QUEUES, SHARED and the caller's weights at most
    before = Window.partitionBy("queue").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("queue", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    if sums.count() <= BROADCAST_ROWS:
        offsets = F.broadcast(offsets)
    placed = coded.join(offsets, ["queue", "task"]).select("id", "queue", (F.col("base") + F.col("begin")).alias("begin"), "n", "ids", "source")
    plan = make_plan(totals, weights, window)
    shared = docs.sparkSession.sparkContext.broadcast(plan)
    kind = docs.schema["id"].dataType.simpleString()
    wide = codec(path).size > 1 << 16 or separator >= 1 << 16

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = shared.value
        where = {q: i for i, q in enumerate(plan.queues)}
        for batch in batches:
            queues = np.array([where[q] for q in batch.column(1).to_pylist()])
            begin, n = (batch.column(i).to_numpy() for i in (2, 3))
            rows, starts, lengths, spots = [], [], [], []
            for q in np.unique(queues):
                own = np.flatnonzero(queues == q)
                own = own[np.argsort(begin[own], kind="stable")]
                for run in np.split(own, np.flatnonzero(begin[own][1:] != (begin + n)[own][:-1]) + 1):
                    for r, s, k, g in _cut(plan, int(q), begin[run], n[run], sequence):
                        rows.append(run[r])
                        starts.append(s)
                        lengths.append(k)
                        spots.append(g)
            row, start, length, spot = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (rows, starts, lengths, spots))
            ids = batch.column(4).to_pylist()
            sums, parts = np.zeros(len(row), np.int64), []
            loaded, values = -1, None
            for i, (r, s, k) in enumerate(zip(row.tolist(), start.tolist(), length.tolist(), strict=True)):
                if r != loaded:
                    loaded, values = r, np.frombuffer(ids[r], "<u4" if wide else "<u2").astype("<u4")
                sums[i] = crc32(values[s : s + k])
                if with_ids:
                    parts.append(values[s : s + k].astype(np.int32))
            at = pa.array(row)
            columns = [batch.column(0).take(at), *map(pa.array, (start, length, sums, n[row], spot // sequence, spot % sequence)), batch.column(5).take(at)]
            names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source"]
            if with_ids:
                columns.append(pa.array(parts, pa.list_(pa.int32())))
                names.append("input_ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string" + ", input_ids array<int>" * with_ids
    return placed.mapInArrow(cut, schema).withColumnRenamed("id", id_col)


def _cut(plan: Plan, q: int, begin: np.ndarray, n: np.ndarray, sequence: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Cut adjoining documents of one queue: document, start in it, length, place in the output."""
    low, high = int(begin[0]), int(begin[-1] + n[-1])
    w = plan.window_of(q, low)
    at = low
    while at < high:
        windows = np.arange(w, w + 256)
        sent = plan.quota(np.append(windows, w + 256))
        edge = sent[:, q]
        # Where this queue's part of each window lies: after all earlier windows and the queues served before it.
        place = sent[:-1].sum(1) + (sent[1:, :q] - sent[:-1, :q]).sum(1)
        upto = min(high, int(edge[-1]))
        if upto > at:
            some = (edge[1:] > at) & (edge[:-1] < upto) & (edge[1:] > edge[:-1])
            shift = place[some] - edge[:-1][some]
            left, right = np.maximum(edge[:-1][some], at), np.minimum(edge[1:][some], upto)
            cuts = [left, begin[(begin > at) & (begin < upto)]]
            for a, b, s in zip(left.tolist(), right.tolist(), shift.tolist(), strict=True):
                cuts.append(np.arange((a + s) // sequence * sequence + sequence - s, b, sequence))
            starts = np.unique(np.concatenate(cuts))
            ends = np.append(starts[1:], upto)
            doc = np.searchsorted(begin, starts, side="right") - 1
            yield doc, starts - begin[doc], ends - starts, starts + shift[np.searchsorted(left, starts, side="right") - 1]
            at = upto
        w += 256
