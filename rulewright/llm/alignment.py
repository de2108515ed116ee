"""Tokens of two tokenizers aligned by their bytes.

Tokenizer A is a byte-level BPE file, tokenizer B a sentencepiece model; both
read a space and the text. Their tokens cut the same bytes in two ways. Every
token points to the token of the other side that reaches farthest to the right
among those that overlap it; where both end at the same byte, A's points to B's,
which points to itself. Doubling the pointers (``to = to[to]``) until nothing
changes brings every token to the last token of its component, and that token
names the group. A run takes as many doublings as the logarithm of the longest
chain, for all documents of a slice at once.

A link is an overlapping pair of an A and a B token. In order, each link goes on
to the next A token, the next B token or, behind the end of a group, to both; so
the links of a text hold its tokens and its groups. A block of documents keeps
its distinct pairs of ids, and its links as places in that list: that is all that
is shuffled, once. Pairs are summed by block before the shuffle that counts them
over the corpus, and the counts go back to the blocks that hold the pair.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulewright.llm.bpe import _numbers, _planes, codec

#: Characters of one block of documents; a longer text is a block of its own.
BLOCK_CHARS = 2 << 20
#: How a link goes on from the one before: to the next A token, the next B token, or both (a new group).
_A, _B, _BOTH = range(3)


@lru_cache(maxsize=2)
def _model(path: str) -> tuple[sentencepiece.SentencePieceProcessor, pa.Array, np.ndarray]:
    """The model, the bytes of each piece and their number."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    table = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
    return model, pa.array(table, pa.binary()), np.array(list(map(len, table)), np.int64)


@lru_cache(maxsize=2)
def _book(path: str) -> tuple[pa.Array, np.ndarray]:
    """The bytes of each id of a byte-level file, and their number."""
    if not codec(path).plain:
        raise ValueError(f"{path} is not a plain byte-level BPE file")
    pieces = codec(path).pieces
    return pa.array(pieces, pa.binary()), np.array(list(map(len, pieces)), np.int64)


def _flat(ids: list) -> tuple[np.ndarray, np.ndarray]:
    """Id lists end to end, and the number of ids before each list and in all."""
    edges = np.concatenate(([0], np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)))))
    return np.concatenate([np.asarray(x, np.int32) for x in ids]) if ids else np.zeros(0, np.int32), edges


def _reads(table: pa.Array, size: np.ndarray, ids: np.ndarray, edges: np.ndarray, wanted: list[bytes]) -> np.ndarray:
    """Whether each list of ids spells its bytes."""
    data = memoryview(table.take(pa.array(ids)).buffers()[2] or b"").cast("B")
    ends = np.concatenate(([0], np.cumsum(size[ids])))[edges].tolist()
    return np.array([data[a:b] == w for a, b, w in zip(ends, ends[1:], wanted, strict=False)], bool)


def _before(ends: np.ndarray) -> np.ndarray:
    """For each byte up to the last end: the number of ends up to it, which is the token that begins there or holds it."""
    return np.cumsum(np.bincount(ends, minlength=1), dtype=np.int32)


def group_numbers(a_end: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Group of each token, from 0, by pointer jumping; ends of tokens are bytes, ascending, the last ones equal."""
    n = len(a_end)
    to_a = _before(a_end)[b_end - 1]  # the A token that holds the last byte of a B token
    own = np.arange(n, n + len(b_end), dtype=np.int32)
    last = a_end[to_a] == b_end if n else np.zeros(0, bool)
    to = np.concatenate((np.int32(n) + _before(b_end)[a_end - 1], np.where(last, own, to_a)))
    while True:
        further = to[to]
        if np.array_equal(further, to):
            break
        to = further
    number = np.cumsum(last) - 1
    return number[to[:n] - n], number[to[n:] - n]


def overlaps(a_end: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All overlapping pairs as positions of A tokens and of B tokens, in order."""
    upto = _before(b_end)
    first = upto[np.concatenate((np.zeros(min(1, len(a_end)), np.int64), a_end[:-1]))]
    many = upto[a_end - 1] - first + 1
    at = np.cumsum(many) - many
    return np.repeat(np.arange(len(a_end)), many), np.repeat(first - at, many) + np.arange(int(many.sum()))


def _linked(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """``docs(id, text)`` to one row per block: ids, links of each document, how each link goes on, its pair's place, the pairs and their uses."""
    kind = docs.schema["id"].dataType.simpleString()

    def block(number: int, ids: pa.Array, texts: list[str]) -> pa.RecordBatch:
        book, (model, b_table, b_size), (a_table, a_size) = codec(a_path), _model(b_path), _book(a_path)
        a, a_edge = _flat([book.encode_plain(" " + t) if t else [] for t in texts])
        b, b_edge = _flat(model.encode(texts, num_threads=1))
        wanted = [(" " + t).encode() if t else b"" for t in texts]
        good = _reads(a_table, a_size, a, a_edge, wanted) & _reads(b_table, b_size, b, b_edge, wanted)
        del texts, wanted
        (a, a_edge), (b, _) = (_keep(x, edge, good) for x, edge in ((a, a_edge), (b, b_edge)))
        a_end, b_end = np.cumsum(a_size[a]), np.cumsum(b_size[b])
        group = group_numbers(a_end, b_end)[0]
        at, bt = overlaps(a_end, b_end)
        step = np.where(np.diff(group[at], prepend=-1) > 0, _BOTH, np.where(np.diff(at, prepend=-1) > 0, _A, _B)).astype(np.uint8)
        found = pa.array(a[at].astype(np.int64) << 32 | b[bt]).dictionary_encode()
        pair, place = found.dictionary.to_numpy(), found.indices.to_numpy()
        uses = np.bincount(place, minlength=len(pair))
        order = np.argsort(-uses, kind="stable")
        rank = np.empty(len(pair), np.uint32)
        rank[order] = np.arange(len(pair), dtype=np.uint32)
        links = np.diff(np.searchsorted(at, a_edge))
        pair = pair[order]
        packed = (zstandard.compress(step.tobytes(), 3), _planes(rank[place]), _planes(pair >> 32), _planes(pair & 0xFFFFFFFF), _planes(uses[order]))
        return pa.RecordBatch.from_arrays(
            [pa.array([number]), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([links], pa.list_(pa.int64())), *(pa.array([x], pa.binary()) for x in packed)],
            names=["block", "ids", "links", "steps", "places", "a", "b", "uses"],
        )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            texts, first = batch.column(1).to_pylist(), 0
            size = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
            while first < len(texts):
                fit = int(np.searchsorted(size, (size[first - 1] if first else 0) + BLOCK_CHARS, side="right"))
                last = max(first + 1, fit)
                yield block(number, batch.column(0).slice(first, last - first), texts[first:last])
                texts[first:last] = [None] * (last - first)
                number, first = number + 1, last

    return docs.mapInArrow(read, f"block long, ids array<{kind}>, links array<long>, steps binary, places binary, a binary, b binary, uses binary")


def _keep(ids: np.ndarray, edges: np.ndarray, good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lists that are not good become empty."""
    n = np.diff(edges)
    return ids[np.repeat(good, n)], np.concatenate(([0], np.cumsum(np.where(good, n, 0))))


def _block_pairs(blocks: DataFrame) -> DataFrame:
    """The pairs of each block with their links there: ``block, a_id, b_id, n``."""

    def read(table: pa.Table) -> pa.Table:
        row = table.select(["block", "a", "b", "uses"]).to_pylist()[0]
        a, b, n = (_numbers(row[c]) for c in ("a", "b", "uses"))
        return pa.table({"block": np.full(len(a), row["block"]), "a_id": a.astype(np.int32), "b_id": b.astype(np.int32), "n": n.astype(np.int64)})

    return blocks.groupBy("block").applyInArrow(read, "block long, a_id int, b_id int, n long")


def _counts(pairs: DataFrame) -> DataFrame:
    counts = pairs.groupBy("a_id", "b_id").agg(F.sum("n").alias("n"))
    top = counts.groupBy("b_id").agg(F.max("n").alias("top"))
    return counts.join(top, "b_id").select("a_id", "b_id", "n", (F.col("n") == F.col("top")).alias("best"))


def _own(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))


def pair_counts(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Links over the corpus by pair of ids: ``a_id, b_id, n`` and ``best``, whether no A id has more links with the B id."""
    return _counts(_block_pairs(_linked(_own(docs, id_col, text_col), a_path, b_path)))


def _placed(docs: DataFrame, a_path: str, b_path: str, id_col: str, text_col: str, finish: Callable[[dict], dict], fields: str) -> DataFrame:
    """Count the pairs, send the counts to their blocks, and give ``finish`` each block's lists of tokens and cuts with the sums of its documents."""
    own = _own(docs, id_col, text_col)
    blocks = _linked(own, a_path, b_path)
    pairs = _block_pairs(blocks)  # shares the exchange of the blocks with the step that places the answers
    answers = pairs.select("block", "a_id", "b_id").join(_counts(pairs), ["a_id", "b_id"])

    def place(table: pa.Table, known: pa.Table) -> pa.Table:
        row = table.to_pylist()[0]
        a, b = _numbers(row["a"]).astype(np.int64), _numbers(row["b"]).astype(np.int64)
        asked, got = a << 32 | b, known.column("a_id").to_numpy().astype(np.int64) << 32 | known.column("b_id").to_numpy()
        order = np.argsort(got)
        if not np.array_equal(got[order], np.sort(asked)):
            raise RuntimeError("a block was made again from other rows than before")
        to = order[np.searchsorted(got[order], asked)]
        n, best = known.column("n").to_numpy()[to], known.column("best").to_numpy()[to].astype(np.int64)
        step, at = np.frombuffer(zstandard.decompress(row["steps"]), np.uint8), _numbers(row["places"])
        edge = np.concatenate(([0], np.cumsum(np.array(row["links"], np.int64))))
        upto = {name: np.concatenate(([0], np.cumsum(mask))) for name, mask in (("a", step != _B), ("b", step != _A), ("group", step == _BOTH), ("n", n[at]), ("best", best[at]))}
        start = np.flatnonzero(step == _BOTH)
        end, doc = np.append(start[1:], len(step))[: len(start)], np.searchsorted(edge, start, side="right") - 1
        lists = [(ids[at[step != other]], upto[name][edge]) for name, ids, other in (("a", a, _B), ("b", b, _A))]
        lists += [(upto[name][end] - upto[name][edge[doc]], upto["group"][edge]) for name in ("a", "b")]
        sums = {"n_links": np.diff(edge), "n_best": np.diff(upto["best"][edge]), "count_sum": np.diff(upto["n"][edge])}
        return pa.table({"id": pa.array(row["ids"], table.schema.field("ids").type.value_type), **finish(dict(zip(("a_ids", "b_ids", "a_cuts", "b_cuts"), lists, strict=True))), **sums})

    schema = f"id {own.schema['id'].dataType.simpleString()}, {fields}, n_links long, n_best long, count_sum long"
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(place, schema).withColumnRenamed("id", id_col)


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, a_ids, b_ids, a_cuts, b_cuts, n_links, n_best, count_sum``.

    ``a_cuts[g]`` and ``b_cuts[g]`` are the numbers of tokens up to the end of group
    g. ``n_best`` counts the links whose pair has as many links in the corpus as any
    of its B id, ``count_sum`` adds up the pairs' counts over the links. Strings of
    special tokens in a text are plain text. Texts that are null or empty, or that
    either tokenizer changes (normalisation), have no tokens. Rows with null or
    repeated ids are rows of their own; no other column is read. The rows of
    ``docs`` must come in the same order when a lost task reads them again, as
    those of a table do.
    """

    def lists(found: dict) -> dict:
        return {c: pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), pa.array(x.astype(np.int32))) for c, (x, edge) in found.items()}

    return _placed(docs, a_path, b_path, id_col, text_col, lists, "a_ids array<int>, b_ids array<int>, a_cuts array<int>, b_cuts array<int>")


@lru_cache(maxsize=2)
def _numerals(size: int) -> tuple[pa.Array, np.ndarray]:
    """The numbers below ``size`` with the mark behind an A id, in and at the end of a group, then behind a B id; and their lengths."""
    texts = [f"{i}{mark}".encode() for marks in (",|", ",;") for i in range(size) for mark in marks]
    return pa.array(texts, pa.large_binary()), np.array(list(map(len, texts)), np.int64)


def _group_texts(found: dict) -> Iterator[memoryview]:
    """Each document's groups as text: ids of A and of B by comma, the sides by ``|``, groups by ``;``.

    Every id is a numeral with the mark behind it, taken from a table of both;
    only a document's last mark is left out.
    """
    sides, groups = [found[c] for c in ("a_ids", "b_ids")], found["a_cuts"][1]
    # The tokens of a side up to the end of each group of the block.
    cuts = [x + np.repeat(edge[:-1], np.diff(groups)) for (x, _), (_, edge) in zip((found["a_cuts"], found["b_cuts"]), sides, strict=True)]
    others = [np.concatenate((np.zeros(min(1, len(cuts[1])), np.int64), cuts[1][:-1])), cuts[0]]
    size = 1 << max(int(ids.max(initial=1)).bit_length() for ids, _ in sides)
    taken = np.zeros(sum(len(ids) for ids, _ in sides), np.int64)
    for k, ((ids, _), cut, other) in enumerate(zip(sides, cuts, others, strict=True)):
        code = 2 * ids.astype(np.int64)
        code[cut - 1] += 1
        taken[np.arange(len(ids)) + np.repeat(other, np.diff(cut, prepend=0))] = code + 2 * size * k
    book, length = _numerals(size)
    ends = np.concatenate(([0], np.cumsum(length[taken])))[sides[0][1] + sides[1][1]].tolist()
    data = memoryview(book.take(pa.array(taken)).buffers()[2] or b"").cast("B")
    for a, b in zip(ends, ends[1:], strict=False):
        yield data[a : max(a, b - 1)]


def digest(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``align`` with sizes and a hash in place of the lists: ``doc_id, n_a, n_b, n_groups, groups_sha256`` (empty without tokens) and the sums."""

    def hashed(found: dict) -> dict:
        sizes = {name: np.diff(found[c][1]) for name, c in (("n_a", "a_ids"), ("n_b", "b_ids"), ("n_groups", "a_cuts"))}
        return {**sizes, "groups_sha256": [hashlib.sha256(t).hexdigest() if t else "" for t in _group_texts(found)]}

    return _placed(docs, a_path, b_path, id_col, text_col, hashed, "n_a long, n_b long, n_groups long, groups_sha256 string")
