"""Byte-pair encoding by a distinct-word table, and decoding by a piece table.

A public tokenizer file (its path is a parameter) gives the vocabulary. Encoding
runs in four steps that Spark partitions by key:

1. each task splits its documents into words, once, and cuts them into blocks of
   a bounded number of characters; a block holds its distinct words, and for
   each document the positions of its words in that list;
2. the words go to word buckets, packed by block; a bucket gathers the words of
   all blocks and encodes each distinct one once;
3. the ids go back to the blocks that asked;
4. each block joins the ids to the word positions of its documents.

A bucket streams through its task, which holds its distinct words only. Words travel once per block that holds
them, never per occurrence. A longer document is a block of its own.
"""

from __future__ import annotations

import json
import math
import re
import unicodedata
from collections.abc import Iterator
from functools import cached_property, lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

#: Characters of text of one block, and documents; a longer text is one block.
BLOCK_CHARS = 4 << 20
BLOCK_DOCS = 4096
#: Rows of a batch that are decoded at a time.
_SLICE = 512
#: Word buckets at most; beyond that a bucket's stream grows, of which only the distinct words are held.
BUCKETS = 4096

#: Fixed value: the word pattern of byte-level pre-tokenizers.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: White space that is too long for tiktoken's matcher, which gives up on runs of some hundred thousand; the library takes such texts.
_LONG_GAP = re.compile(r"\s{4096}")


def _byte_of_letter() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


def _spec(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


class Codec:
    """Encode and decode as the tokenizers library does with one vocabulary file.

    Words are merged by rank in tiktoken, which gives the same ids for a plain
    byte-level BPE file several times faster; any other file is left to the
    tokenizers library itself.
    """

    def __init__(self, path: str) -> None:
        spec = _spec(path)
        self.path = path
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.plain = _is_byte_level(spec)
        self.size = self.library.get_vocab_size()

    def __reduce__(self) -> tuple:
        """A task gets the few small facts, one object for all tasks of a worker, and loads a table of the file only if it asks for one."""
        return _shared, (self.path, tuple(self.special.items()), self.plain, self.size)

    @cached_property
    def library(self) -> Tokenizer:
        library = Tokenizer.from_file(self.path)
        library.no_truncation()
        library.no_padding()
        return library

    def _ranks(self) -> dict[bytes, int]:
        byte = _byte_of_letter()
        return {bytes(byte[c] for c in token): i for token, i in _spec(self.path)["model"]["vocab"].items() if token not in self.special}

    @cached_property
    def fast(self) -> tiktoken.Encoding:
        return tiktoken.Encoding("byte-level", pat_str=WORDS, mergeable_ranks=self._ranks(), special_tokens=self.special)

    @cached_property
    def pieces(self) -> list[bytes]:
        """The piece of each id."""
        pieces = [b""] * self.size
        for piece, i in [*self._ranks().items(), *((s.encode(), i) for s, i in self.special.items())]:
            pieces[i] = piece
        return pieces

    @cached_property
    def words(self) -> regex.Pattern:
        return regex.compile(WORDS)

    @cached_property
    def marks(self) -> regex.Pattern | None:
        return regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    @cached_property
    def unsure(self) -> frozenset[str]:
        return _newer_letters()

    @cached_property
    def beyond(self) -> re.Pattern:
        return re.compile(f"[{re.escape(min(self.unsure))}-{chr(0x10FFFF)}]" if self.unsure else r"(?!)")

    def encode(self, text: str) -> list[int]:
        if not self.plain or _LONG_GAP.search(text):
            return self.library.encode(text, add_special_tokens=False).ids
        if any(s in text for s in self.special):
            return self.fast.encode(text, allowed_special="all")
        return self.fast.encode_ordinary(text)

    @cached_property
    def plain_library(self) -> Tokenizer:
        library = Tokenizer.from_str(self.library.to_str())
        library.encode_special_tokens = True
        return library

    def encode_plain(self, text: str) -> list[int]:
        """As ``encode``, with the strings of special tokens as plain text."""
        if not self.plain or _LONG_GAP.search(text):
            return self.plain_library.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)

    def split(self, text: str) -> list[str]:
        """The words that are encoded one by one; special tokens are words of their own. Another vocabulary takes a text as one word."""
        if not self.plain:
            return [text] if text else []
        if self.marks and any(s in text for s in self.special):
            return [w for part in self.marks.split(text) for w in ([part] if part in self.special else self._split(part))]
        return self._split(text)

    def _split(self, text: str) -> list[str]:
        if not text.isascii() and self.beyond.search(text) and not self.unsure.isdisjoint(text):
            return [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]
        return self.words.findall(text)


def _is_byte_level(spec: dict) -> bool:
    """Whether ranks alone reproduce the file: byte-level words and ids in merge order."""
    pre, model = spec["pre_tokenizer"] or {}, spec["model"]
    shape = pre.get("type") == "ByteLevel" and not pre["add_prefix_space"] and pre["use_regex"] and not spec["normalizer"] and not spec["truncation"] and not spec["padding"]
    marks = all(not (t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]) for t in spec["added_tokens"])
    plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    if not (shape and marks and plain):
        return False
    merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
    ids = [model["vocab"][m] for m in merged]
    return ids == sorted(ids) and all(c in model["vocab"] for c in _byte_of_letter())


def _newer_letters() -> frozenset[str]:
    """Letters and numbers that newer character tables know; the library decides on texts that hold one."""
    unassigned = "".join(chr(c) for c in range(0x110000) if unicodedata.category(chr(c)) == "Cn")
    return frozenset(regex.findall(r"[\p{L}\p{N}\s]", unassigned))


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


@lru_cache(maxsize=2)
def _shared(path: str, special: tuple, plain: bool, size: int) -> Codec:
    made = Codec.__new__(Codec)
    made.path, made.special, made.plain, made.size = path, dict(special), plain, size
    return made


def _width(size: int) -> str:
    return "<u2" if size <= 1 << 16 else "<u4"


def _pack(items: list[bytes]) -> bytes:
    lengths = np.fromiter(map(len, items), "<u4", len(items))
    return zstandard.compress(np.uint32(len(items)).tobytes() + lengths.tobytes() + b"".join(items), 3)


def _unpack(packed: bytes) -> list[bytes]:
    raw = zstandard.decompress(packed)
    n = int(np.frombuffer(raw, "<u4", 1)[0])
    ends = np.cumsum(np.frombuffer(raw, "<u4", n, 4), dtype=np.int64) + 4 + 4 * n
    starts = np.concatenate(([4 + 4 * n], ends[:-1])) if n else ends
    return [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]


def _planes(numbers: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers, compressed byte by byte: first all lowest bytes, and so on."""
    return zstandard.compress(np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 3)


def _numbers(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(packed), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1)


def _by_use(uses: np.ndarray) -> np.ndarray:
    """Places in the order of the answers (by bucket, then by first use), the most used first: small numbers for common words."""
    return np.lexsort((np.arange(len(uses)), -uses.astype(np.int64)))


def _blocks(batches: Iterator[pa.RecordBatch], book: Codec, block_docs: int) -> Iterator[pa.RecordBatch]:
    """Rows (id, text) to blocks: ids, words of each document, positions in the block's word list, and that list by bucket."""
    task, made = TaskContext.get().partitionId(), 0
    for batch in batches:
        ids, first = batch.column(0), 0
        texts = batch.column(1).to_pylist()
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        buckets = batch.column(2)[0].as_py() if len(texts) else 1
        while first < len(texts):
            fit = int(np.searchsorted(np.cumsum(sizes[first : first + block_docs]), BLOCK_CHARS, side="right"))
            last = first + max(1, fit)
            place: dict[str, int] = {}
            counts, positions = [], []
            for i in range(first, last):
                own = book.split(texts[i])
                counts.append(len(own))
                positions.append(np.fromiter((place.setdefault(w, len(place)) for w in own), "<u4", len(own)))
                texts[i] = None
            words = [w.encode() for w in place]
            bucket = np.fromiter((crc32(w) for w in words), np.int64, len(words)) % buckets
            order = np.argsort(bucket, kind="stable")
            flat = np.concatenate(positions) if positions else np.zeros(0, "<u4")
            uses = np.bincount(flat, minlength=len(words)).astype("<u4")
            rank = np.empty(len(words), "<u4")
            rank[order[_by_use(uses[order])]] = np.arange(len(words), dtype="<u4")
            stream = _planes(rank[flat])
            names, begin = np.unique(bucket[order], return_index=True)
            ends = np.append(begin, len(order))
            lists = [_pack([words[i] for i in order[a:b].tolist()]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([(task << 32) + made]),
                    pa.ListArray.from_arrays(pa.array([0, last - first], pa.int32()), ids.slice(first, last - first)),
                    pa.array([counts], pa.list_(pa.int64())),
                    pa.array([stream], pa.binary()),
                    pa.array([_planes(uses[order])], pa.binary()),
                    pa.array([names], pa.list_(pa.int64())),
                    pa.array([lists], pa.list_(pa.binary())),
                ],
                names=["block", "ids", "counts", "positions", "uses", "buckets", "words"],
            )
            first, made = last, made + 1


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", block_docs: int = BLOCK_DOCS) -> DataFrame:
    """One row per input row: the id and ``ids``, the token ids of the whole text.

    A null text is empty; an empty text has no ids. Rows that repeat an id, or
    have none, are encoded like any other. No other column is read.
    """
    book = codec(path)
    docs = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    kind = docs.schema["id"].dataType.simpleString()
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = min(BUCKETS, max(1, math.ceil(size / (4 * BLOCK_CHARS))))
    blocks = docs.withColumn("buckets", F.lit(buckets)).mapInArrow(
        lambda batches: _blocks(batches, book, block_docs), f"block long, ids array<{kind}>, counts array<long>, positions binary, uses binary, buckets array<long>, words array<binary>"
    )

    def ask(table: pa.Table) -> pa.Table:
        names, words = (table.column(c).combine_chunks().flatten() for c in ("buckets", "words"))
        return pa.table({"block": pa.array([table.column("block")[0].as_py()] * len(names), pa.int64()), "bucket": names, "words": words})

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = _width(book.size)
        known: dict[bytes, bytes] = {}
        for batch in batches:
            out, asked = [], []
            for packed in batch.column(2).to_pylist():
                words = _unpack(packed)
                for word in words:
                    if word not in known:
                        known[word] = np.array(book.encode(word.decode()), kind).tobytes()
                out.append(_pack([known[w] for w in words]))
                asked.append(crc32(packed))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(asked, pa.int64()), pa.array(out, pa.binary())], names=["block", "bucket", "asked", "codes"])

    def place(table: pa.Table, answers: pa.Table) -> pa.Table:
        kind = _width(book.size)
        got = {a["bucket"]: a for a in answers.to_pylist()}
        codes: list[bytes] = []
        for bucket, packed in zip(*(table.column(c).combine_chunks().flatten().to_pylist() for c in ("buckets", "words")), strict=True):
            # A block that was made again after a loss, in another order, was not the one that asked.
            fits = bucket in got and got[bucket]["asked"] == crc32(packed)
            codes += _unpack(got[bucket]["codes"]) if fits else [np.array(book.encode(w.decode()), kind).tobytes() for w in _unpack(packed)]
        flat = np.frombuffer(b"".join(codes), kind).astype(np.int32)
        length = np.fromiter(map(len, codes), np.int64, len(codes)) // np.dtype(kind).itemsize
        begin = np.cumsum(length) - length
        at = _by_use(_numbers(table.column("uses")[0].as_py()))[_numbers(table.column("positions")[0].as_py())]
        ends = np.concatenate(([0], np.cumsum(length[at])))
        tokens = flat[np.repeat(begin[at] - ends[:-1], length[at]) + np.arange(ends[-1])]
        words = np.concatenate(([0], np.cumsum(table.column("counts").combine_chunks().flatten().to_numpy())))
        return pa.table({"id": table.column("ids").combine_chunks().flatten(), "ids": pa.ListArray.from_arrays(pa.array(ends[words].astype(np.int32)), pa.array(tokens))})

    # Both reads of the blocks share one exchange, so that a text is split once.
    asked = blocks.groupBy("block").applyInArrow(ask, "block long, bucket long, words binary")
    answered = asked.repartition("bucket").mapInArrow(answer, "block long, bucket long, asked long, codes binary")
    placed = blocks.groupBy("block").cogroup(answered.groupBy("block")).applyInArrow(place, f"id {kind}, ids array<int>")
    return placed.select(F.col("id").alias(id_col), "ids")


def decode(coded: DataFrame, path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Add the decoded text of an id array, keeping special tokens.

    The piece table (one row per id of the vocabulary, a fixed size) is joined
    to the ids of each batch by position (an Arrow take), and the pieces of a
    row are joined to its text. A null array gives a null text; bytes that are not
    UTF-8 become replacement characters, as in the library.
    """
    schema = T.StructType([*coded.schema.fields, T.StructField(out_col, T.StringType())])
    at = coded.columns.index(ids_col)
    book = codec(path)
    table = pa.array(book.pieces if book.plain else [], pa.binary())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, _SLICE) for b in batches for i in range(0, b.num_rows, _SLICE)):
            ids = batch.column(at)
            if book.plain:
                ends = ids.offsets.to_numpy()
                pieces = pa.ListArray.from_arrays(pa.array(ends - ends[0]), table.take(ids.values.slice(ends[0], ends[-1] - ends[0])))
                texts = [x.decode("utf-8", "replace") if some else None for x, some in zip(pc.binary_join(pieces, b"").to_pylist(), ids.is_valid().to_pylist(), strict=True)]
            else:
                texts = [book.library.decode(x, skip_special_tokens=False) if x is not None else None for x in ids.to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, out_col])

    return coded.mapInArrow(read, schema)
