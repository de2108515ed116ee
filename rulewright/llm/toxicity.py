"""Toxicity by a classifier chain of linear models.

The categories are predicted one after the other. The model of a category sees
the text's features and the probabilities of the categories before it. While it
is trained, those are out-of-fold predictions, made by models that did not see
the document or a near copy of it; when it is used, they come from the earlier models of the chain.

Features are the presence of a word, of its beginnings of 3 to 8 bytes, and of
a run of signs, in lower case, hashed into a fixed number of buckets; a document's features have
unit length. The models are logistic regressions on features scaled by their log-odds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rulewright.llm.shingles import CHUNK_BYTES, constants, mix, span_hashes, word_bounds

BUCKETS = 1 << 18
PREFIXES = range(3, 9)
#: The chain is fitted on at most about this many labelled documents, chosen by a hash of the id.
MAX_TRAIN_DOCS = 10_000
FOLDS = 3
STEPS = 100
RIDGE = 1e-4
#: Features of fewer labelled documents than this are left out of the fit.
MIN_DOCS = 4
#: Features that the fit works on at a time: the driver holds those of the whole sample in one array only, at four bytes each.
RUN_CELLS = 1 << 19

_SEPARATORS = np.array([not (chr(b).isalnum() or b >= 128) for b in range(256)])
#: For runs of signs: everything but printable ASCII signs.
_NO_SIGNS = ~_SEPARATORS | np.array([b <= 32 or b == 127 for b in range(256)])


def features(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Yield (offsets, buckets) by runs of texts: the distinct sorted feature buckets of each text."""
    first = 0
    while first < len(texts):
        part, size = [], 0
        while first < len(texts) and (not part or size < CHUNK_BYTES):
            part.append(texts[first].lower().encode("utf-8", "replace"))
            size += len(part[-1]) + 1
            first += 1
        data = np.frombuffer(b" ".join(part) + b" ", np.uint8)
        begin = np.concatenate(([0], np.cumsum(np.fromiter(map(len, part), np.int64, len(part)) + 1)))
        start, end = word_bounds(data, _SEPARATORS)
        row = np.searchsorted(begin, start, side="right") - 1
        long = [np.flatnonzero(end - start > k) for k in PREFIXES]
        signs = word_bounds(data, _NO_SIGNS)
        spans = [(start, end), signs, *((start[at], start[at] + k) for k, at in zip(PREFIXES, long, strict=True))]
        rows = np.concatenate([row, np.searchsorted(begin, signs[0], side="right") - 1, *(row[at] for at in long)])
        # A whole word and an equal beginning of a longer word are one feature on purpose.
        hashes = np.concatenate(span_hashes(data, spans))
        cell = np.unique(rows * BUCKETS + (hashes >> np.uint64(46)).astype(np.int64))
        yield np.searchsorted(cell, np.arange(len(part) + 1) * BUCKETS), cell % BUCKETS


def _runs(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of texts with some ``RUN_CELLS`` features in all, so that no array but the features themselves has a place for each of them."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + RUN_CELLS, side="right")) - 1)
        yield first, last
        first = last


def _margin(offsets: np.ndarray, buckets: np.ndarray, weights: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Weighted feature sum of each text."""
    out = np.zeros(len(offsets) - 1)
    for a, b in _runs(offsets):
        some = a + np.flatnonzero(np.diff(offsets[a : b + 1]))
        if len(some):
            out[some] = np.add.reduceat(weights[buckets[offsets[a] : offsets[b]]], offsets[some] - offsets[a])
    return out * scale


def _sums(offsets: np.ndarray, buckets: np.ndarray, values: np.ndarray) -> np.ndarray:
    """For each bucket the sum of the values of the texts that have it."""
    total = np.zeros(BUCKETS)
    for a, b in _runs(offsets):
        total += np.bincount(buckets[offsets[a] : offsets[b]], np.repeat(values[a:b], np.diff(offsets[a : b + 1])), BUCKETS)
    return total


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Link:
    """One model of the chain: bucket weights, weights of earlier probabilities, and a bias."""

    def __init__(self, weights: np.ndarray, earlier: np.ndarray, bias: float) -> None:
        self.weights, self.earlier, self.bias = weights, earlier, bias

    def predict(self, offsets: np.ndarray, buckets: np.ndarray, before: np.ndarray) -> np.ndarray:
        scale = 1 / np.sqrt(np.maximum(1, np.diff(offsets)))
        return _sigmoid(_margin(offsets, buckets, self.weights, scale) + before @ self.earlier + self.bias)


def _fit(offsets: np.ndarray, buckets: np.ndarray, before: np.ndarray, y: np.ndarray, full: np.ndarray) -> Link:
    """Logistic regression on features scaled by their log-odds in the two classes, by gradient steps with momentum.

    Both classes weigh the same. ``full`` are the feature counts that set the unit length.
    """
    n, positive = len(y), y.sum()
    if positive in (0, n):
        return Link(np.zeros(BUCKETS), np.zeros(before.shape[1]), -40.0 if positive == 0 else 40.0)
    scale = 1 / np.sqrt(np.maximum(1, full))
    held = _sums(offsets, buckets, y)
    rest = _sums(offsets, buckets, np.ones(n)) - held
    odds = np.log((held + 1) / (positive + 2)) - np.log((rest + 1) / (n - positive + 2))
    weight = np.where(y > 0, 0.5 / positive, 0.5 / (n - positive))
    length = _margin(offsets, buckets, odds * odds, scale * scale) + (before * before).sum(1) + 1
    step = 4 / np.percentile(length, 95)
    w, v, b = np.zeros(BUCKETS), np.zeros(before.shape[1]), 0.0
    mw, mv, mb = 0.0 * w, 0.0 * v, 0.0
    for _ in range(STEPS):
        error = (_sigmoid(_margin(offsets, buckets, w * odds, scale) + before @ v + b) - y) * weight
        mw = 0.9 * mw + odds * _sums(offsets, buckets, error * scale) + RIDGE * w
        mv = 0.9 * mv + before.T @ error + RIDGE * v
        mb = 0.9 * mb + error.sum()
        w, v, b = w - step * mw, v - step * mv, b - step * mb
    return Link(w * odds, v, b)


def _take(offsets: np.ndarray, buckets: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The features of the texts that a mask chooses."""
    sizes = np.diff(offsets)
    return np.concatenate(([0], np.cumsum(sizes[rows]))), buckets[np.repeat(rows, sizes)]


def _group(offsets: np.ndarray, buckets: np.ndarray) -> np.ndarray:
    """A number for each document, the same for exact and near copies, so that no model is judged on a copy of what it saw.

    Documents that share a band of minima are compared with the first of the
    band; those with four fifths of their features in common are one group.
    """
    n = len(offsets) - 1
    root, some = np.arange(n), np.flatnonzero(np.diff(offsets))
    for band in range(8):
        minima = np.zeros((3, n), np.uint64)
        for a, b in _runs(offsets):
            here = some[(some >= a) & (some < b)]
            if len(here):
                cells = buckets[offsets[a] : offsets[b]].astype(np.uint64) + np.uint64(1)
                for row, k in zip(minima, constants(3, 500 + band), strict=True):
                    row[here] = np.minimum.reduceat(mix(cells * k), offsets[here] - offsets[a])
        first: dict[tuple, int] = {}
        for i, key in zip(some.tolist(), map(tuple, minima[:, some].T.tolist()), strict=True):
            j = first.setdefault(key, i)
            a, b = root[i], root[j]
            if a == b:
                continue
            x, y = (buckets[offsets[d] : offsets[d + 1]] for d in (i, j))
            if 1.8 * len(np.intersect1d(x, y, assume_unique=True)) >= 0.8 * (len(x) + len(y)):
                root[root == max(a, b)] = min(a, b)
    return root


def fit_chain(offsets: np.ndarray, buckets: np.ndarray, labels: np.ndarray) -> list[Link]:
    """The chain for ``labels`` (documents x categories), later models trained on out-of-fold probabilities."""
    full = np.diff(offsets)
    n = len(labels)
    common = _sums(offsets, buckets, np.ones(n)) >= MIN_DOCS
    kept = _margin(offsets, buckets, common.astype(float), np.ones(n)).astype(np.int64)
    offsets, buckets = np.concatenate(([0], np.cumsum(kept))), buckets[common[buckets]]
    fold = _group(offsets, buckets) % FOLDS
    before, chain = np.zeros((n, 0)), []
    for c in range(labels.shape[1]):
        y = labels[:, c].astype(float)
        chain.append(_fit(offsets, buckets, before, y, full))
        if c + 1 < labels.shape[1]:
            held = np.zeros(n)
            for f in range(FOLDS):
                a, h = fold != f, fold == f
                part = _fit(*_take(offsets, buckets, a), before[a], y[a], full[a])
                o, k = _take(offsets, buckets, h)
                held[h] = _sigmoid(_margin(o, k, part.weights, 1 / np.sqrt(np.maximum(1, full[h]))) + before[h] @ part.earlier + part.bias)
            before = np.column_stack((before, held))
    return chain


def train(labelled: DataFrame, categories: list[str], id_col: str = "doc_id", text_col: str = "text", max_docs: int = MAX_TRAIN_DOCS) -> list[Link]:
    """Fit on rows with a text and all labels (0 or 1), up to the documented bound on rows."""
    rows = labelled.where(F.col(text_col).isNotNull()).dropna(subset=categories)
    n = rows.count()
    if n > max_docs:
        grid = 1 << 30
        rows = rows.where(F.pmod(F.xxhash64(id_col), F.lit(grid)) < int(grid * max_docs / n))
    shape = rows.select(F.col(id_col).cast("long").alias("id"), text_col, F.array(*(F.col(c).cast("int") for c in categories)).alias("labels"))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [b.astype(np.int32) for o, k in features(batch.column(1).to_pylist()) for b in np.split(k, o[1:-1])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found, pa.list_(pa.int32()))], names=["id", "labels", "buckets"])

    table = shape.mapInArrow(extract, "id long, labels array<int>, buckets array<int>").toArrow().sort_by("id")
    column = table.column("buckets").combine_chunks()
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    labels = table.column("labels").combine_chunks().flatten().to_numpy().reshape(-1, len(categories))
    buckets = [column.flatten().to_numpy()]
    del table, column  # so that the fit can let go of rare features
    return fit_chain(np.concatenate(([0], np.cumsum(sizes))).astype(np.int64), buckets.pop(), labels)


def predict(docs: DataFrame, chain: list[Link], categories: list[str], text_col: str = "text") -> DataFrame:
    """Add ``p_<category>`` to every row, each model reading the probabilities before it.

    A null or empty text has no features: its probabilities are those of the
    biases. Columns named like the outputs are replaced.
    """
    docs = docs.drop(*(f"p_{c}" for c in categories))
    shared = docs.sparkSession.sparkContext.broadcast([(m.weights.astype(np.float32), m.earlier, m.bias) for m in chain])
    schema = T.StructType([*docs.schema.fields, *(T.StructField(f"p_{c}", T.DoubleType()) for c in categories)])
    at = docs.columns.index(text_col)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links = [Link(*m) for m in shared.value]
        for batch in batches:
            parts = [np.zeros((0, len(links)))]
            for offsets, buckets in features([t or "" for t in batch.column(at).to_pylist()]):
                before = np.zeros((len(offsets) - 1, 0))
                for link in links:
                    before = np.column_stack((before, link.predict(offsets, buckets, before)))
                parts.append(before)
            found = np.concatenate(parts)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(found[:, i]) for i in range(len(links)))], names=schema.names)

    return docs.mapInArrow(score, schema)


#: The chain over the labels table: junk, toxic, and toxic junk.
CATEGORIES = ["junk", "toxic", "toxic_junk"]


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Train on the labelled documents and score all: ``doc_id``, a probability by category, and ``toxic``.

    ``toxic`` holds from a probability of 0.5 on. A document that is labelled
    more than once has a category if any of its rows says so.
    """

    def flag(c: Column) -> Column:
        return c.cast("int")

    junk, toxic = F.col("quality") == 0, F.col("toxic") == 1
    known = labels.select("doc_id", flag(junk).alias("junk"), flag(toxic).alias("toxic"), flag(junk & toxic).alias("toxic_junk"))
    known = known.groupBy("doc_id").agg(*(F.max(c).alias(c) for c in CATEGORIES))
    chain = train(docs.select("doc_id", "text").join(known, "doc_id"), CATEGORIES)
    scored = predict(docs.select("doc_id", "text"), chain, CATEGORIES)
    return scored.select("doc_id", *(f"p_{c}" for c in CATEGORIES), (F.col("p_toxic") >= 0.5).alias("toxic"))
