"""Language identification: multinomial naive Bayes over hashed character n-grams.

Text becomes lower-case letters with single spaces for everything else. Its
n-grams of one to ``ORDERS`` characters are hashed into a fixed number of
buckets. Counts by language and bucket are summed by Spark and broadcast; they
make the smoothed log-probability matrix, of languages x buckets, and each batch
is scored as a sparse document-by-bucket count times that matrix, in blocks of
languages, so that any number of them is scored in bounded memory.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rulewright.llm.names import fresh
from rulewright.storage import TEXT_ROWS, Workspace

ORDERS = 4
BUCKETS = 1 << 16
#: The classifier is fitted on about this many labelled documents at most, chosen by a hash of the id.
MAX_TRAIN_DOCS = 30_000
#: Languages of one block of the matrix, which is languages x BUCKETS floats.
BLOCK_LANGUAGES = 128
UNKNOWN = "und"

_STEP = np.uint64(0x9E3779B97F4A7C15)
_SPACE = 32
#: Characters that are scored at a time; the arrays of a block take some 300 bytes for each.
_BLOCK_CHARS = 1 << 16


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point: itself if it is a letter, else a space."""
    table = np.full(0x110000, _SPACE, np.uint32)
    isletter = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    table[isletter] = np.flatnonzero(isletter)
    return table


def _grams(texts: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Yield (first index, letters of each text, row and bucket of each n-gram) by runs of texts."""
    first = 0
    while first < len(texts):
        last, size = first, 0
        while last < len(texts) and (last == first or size < _BLOCK_CHARS):
            size += len(texts[last]) + 2
            last += 1
        part = [f" {t.lower()} " for t in texts[first:last]]
        code = _letters()[np.frombuffer("".join(part).encode("utf-32-le", "surrogatepass"), np.uint32)]
        row = np.repeat(np.arange(len(part)), np.fromiter(map(len, part), np.int64, len(part)))
        keep = np.ones(len(code), bool)
        keep[1:] = (code[1:] != _SPACE) | (code[:-1] != _SPACE) | (row[1:] != row[:-1])
        code, row = code[keep].astype(np.uint64), row[keep]
        letters = np.bincount(row[code != _SPACE], minlength=len(part))
        rows, buckets, h = [], [], np.zeros(len(code), np.uint64)
        for n in range(1, ORDERS + 1):
            if n > len(code):
                break
            h = h[: len(code) - n + 1] * _STEP + code[n - 1 :]
            x = h * np.uint64(0xBF58476D1CE4E5B9)
            bucket = ((x ^ (x >> np.uint64(32))) * _STEP >> np.uint64(48)).astype(np.int64)
            inside = row[: len(h)] == row[n - 1 :]
            rows.append(row[: len(h)][inside])
            buckets.append(bucket[inside])
        yield first, letters, np.concatenate(rows), np.concatenate(buckets)
        first = last


class Model:
    """Languages, their share of documents and n-grams, and the counts of n-grams by language and bucket.

    ``cells`` are (bucket, language, count) arrays in the order of the languages;
    there are at most as many as the training rows have n-grams.
    """

    def __init__(self, languages: list[str], docs: np.ndarray, cells: tuple[np.ndarray, np.ndarray, np.ndarray]) -> None:
        self.languages, self.docs, self.cells = languages, docs, cells
        _, who, n = cells
        self.total = np.bincount(who, n, len(languages)) + 0.5 * BUCKETS
        self.prior = np.log(docs / max(1, docs.sum())) if languages else docs
        self._kept: tuple[int, np.ndarray] | None = None

    def table(self, first: int) -> np.ndarray:
        """Log-probabilities of the buckets in a block of languages; a block is kept until another is asked for."""
        if self._kept is None or self._kept[0] != first:
            last = min(first + BLOCK_LANGUAGES, len(self.languages))
            bucket, who, n = self.cells
            a, b = np.searchsorted(who, (first, last))
            sums = np.full((BUCKETS, last - first), 0.5)
            sums[bucket[a:b], who[a:b] - first] += n[a:b]
            self._kept = first, np.log(sums / self.total[first:last])
        return self._kept[1]

    def score(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """The most probable language of each text and its posterior probability; of equal ones the first by name."""
        names, best = [UNKNOWN] * len(texts), np.zeros(len(texts))
        if not self.languages:
            return names, best
        for first, letters, rows, buckets in _grams(texts):
            cell, count = np.unique(rows * BUCKETS + buckets, return_counts=True)
            at, bucket = cell // BUCKETS, cell % BUCKETS
            begin = np.flatnonzero(np.diff(at, prepend=-1))
            top, peak, mass = np.zeros(len(letters), np.int64), np.full(len(letters), -np.inf), np.zeros(len(letters))
            for low in range(0, len(self.languages), BLOCK_LANGUAGES):
                table = self.table(low)
                total = np.zeros((len(letters), table.shape[1])) + self.prior[low : low + table.shape[1]]
                if len(at):
                    total[at[begin]] += np.add.reduceat(table[bucket] * count[:, None], begin, axis=0)
                high = total.max(1)
                new = np.maximum(high, peak)
                mass = mass * np.exp(peak - new) + np.exp(total - new[:, None]).sum(1)
                top = np.where(high > peak, low + total.argmax(1), top)
                peak = new
            for i in np.flatnonzero(letters):
                names[first + i], best[first + i] = self.languages[top[i]], 1 / mass[i]
        return names, best


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_docs: int = MAX_TRAIN_DOCS) -> Model:
    """Fit on rows with a text and a label; equal at every size up to the documented bound on rows."""
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    n = rows.count()
    if n > max_docs:
        grid = 1 << 30
        rows = rows.where(F.pmod(F.xxhash64(id_col), F.lit(grid)) < int(grid * max_docs / n))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        docs: dict[str, int] = {}
        for batch in batches:
            texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lang in sorted(set(langs)):
                own = [t for t, x in zip(texts, langs, strict=True) if x == lang]
                docs[lang] = docs.get(lang, 0) + len(own)
                total = sums.setdefault(lang, np.zeros(BUCKETS, np.int64))
                for _, _, _, buckets in _grams(own):
                    total += np.bincount(buckets, minlength=BUCKETS)
        for lang, total in sums.items():
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * (len(some) + 1)), pa.array(np.append(some, -1).astype(np.int32)), pa.array(np.append(total[some], docs[lang]))], names=["lang", "bucket", "n"]
            )

    counts = rows.select(text_col, F.col(lang_col).cast("string")).mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    table = counts.toArrow()
    languages = sorted(set(table.column("lang").to_pylist()))
    place = {x: i for i, x in enumerate(languages)}
    who = np.fromiter((place[x] for x in table.column("lang").to_pylist()), np.int64, table.num_rows)
    bucket, n_of = table.column("bucket").to_numpy(), table.column("n").to_numpy()
    docs = np.zeros(len(languages))
    docs[who[bucket < 0]] = n_of[bucket < 0]
    order = np.lexsort((bucket, who))
    order = order[bucket[order] >= 0]
    return Model(languages, docs, (bucket[order], who[order], n_of[order]))


def predict(docs: DataFrame, model: Model, text_col: str = "text", lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """Add the predicted language and its probability to every row; all columns stay.

    A null text, or one without any letter, gives ``und`` with score 0. Columns
    named like the two outputs are replaced.
    """
    docs = docs.drop(lang_out, score_out)
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.docs, model.cells))
    schema = T.StructType([*docs.schema.fields, T.StructField(lang_out, T.StringType()), T.StructField(score_out, T.DoubleType())])
    at = docs.columns.index(text_col)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for batch in batches:
            names, best = own.score([t or "" for t in batch.column(at).to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(best)], names=[*batch.schema.names, lang_out, score_out])

    return docs.mapInArrow(label, schema)


def fold(id_col: str = "doc_id") -> Column:
    """The remainder by which documents are held out."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4


def identify(docs: DataFrame) -> DataFrame:
    """Train on the documents that are not held out and label every document."""
    model = train(docs.where(F.coalesce(fold() != 2, F.lit(True))))
    held = docs.select("doc_id", "text", F.coalesce(fold() == 2, F.lit(False)).alias("held_out"))
    return predict(held, model).select("doc_id", "held_out", "lang_pred", "score")


def keep_identified(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The documents whose language is found with at least the given probability, written and read again."""
    model = train(docs.where(F.coalesce(fold() != 2, F.lit(True))))
    lang, score = fresh(docs, "lang_found", "lang_score")
    scored = predict(docs, model, lang_out=lang, score_out=score)
    kept = scored.where((F.col(lang) != UNKNOWN) & (F.col(score) >= least)).select(*(F.col(f"`{c}`") for c in docs.columns))
    return Workspace(docs.sparkSession, "langid").save(kept, "kept", TEXT_ROWS)
