import random
import zlib
from itertools import combinations

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from compare import SF
from tokenizers import Tokenizer

from rulewright.llm import bestfit, queries

PATH = public_tokenizers.path("byte_bpe_50k.json")


def check(rows, texts, separator=2, sequence=1024):
    """Every id of every document lies in one piece, at one place; returns the number of sequences and the lower bound."""
    book = Tokenizer.from_file(PATH)
    want = []
    for key, text in texts:
        ids = [*book.encode(text or "", add_special_tokens=False).ids, separator]
        first = len(ids) % sequence or sequence
        edges = [0, *range(first, len(ids) + 1, sequence)] if len(ids) > sequence else [0, len(ids)]
        want += [(str(key), i, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False))]
    assert sorted((str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == sorted(want)
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in by.values():
        spans.sort()
        assert [o for o, _ in spans] == [sum(n for _, n in spans[:i]) for i in range(len(spans))]
        assert sum(n for _, n in spans) <= sequence
    sizes = np.bincount([r["length"] for r in rows], minlength=sequence + 1)
    return len(by), bestfit.lower_bound(bestfit.dual_feasible(sequence)[0] @ sizes, sequence)


@pytest.mark.parametrize("sf", [SF, SF.replace("0.001", "0.01")])
def test_op12_equals_the_library_and_is_certified(spark, sf):
    texts = [tuple(r.values()) for r in pq.read_table(f"{sf}/documents.parquet").select(["doc_id", "text"]).to_pylist()]
    made, bound = check(queries.op12_best_fit_packing(spark, sf).collect(), texts)
    assert made <= bound * 1.005 + 1


def test_op12_edges(spark):
    texts = [(1, None), (1, ""), (None, "word " * 5000), (2, "a" * 1), (2, "a"), (3, " " * 600_000), (4, "x<|endoftext|>y")]
    df = spark.createDataFrame([(*t, 0, 0) for t in texts], "doc_id long, text string, uid long, id long")
    check(bestfit.pack(df, PATH).collect(), texts)
    assert bestfit.pack(df.limit(0), PATH).count() == 0
    out = bestfit.pack(df, PATH, with_ids=True).collect()
    assert all(len(r["input_ids"]) == r["length"] and zlib.crc32(np.array(r["input_ids"], "<u4").tobytes()) == r["ids_crc32"] for r in out)


def fewest(sizes, capacity):
    """The least number of sequences, by search over all ways."""
    best = [len(sizes)]

    def place(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(rooms)
            return
        for j in range(len(rooms)):
            if rooms[j] >= sizes[i] and rooms[j] not in rooms[:j]:
                place(i + 1, rooms[:j] + (rooms[j] - sizes[i],) + rooms[j + 1 :])
        place(i + 1, (*rooms, capacity - sizes[i]))

    place(0, ())
    return best[0]


def test_bounds_hold_and_are_tight_on_small_sets():
    draw, met = random.Random(5), 0
    for _ in range(150):
        capacity = draw.choice([10, 24, 30])
        sizes = sorted((draw.randint(1, capacity) for _ in range(draw.randint(1, 10))), reverse=True)
        least = fewest(sizes, capacity)
        bound = bestfit.lower_bound(bestfit._sums(np.array(sizes), capacity), capacity)
        assert bound <= least <= bestfit.best_fit(np.array(sizes), capacity)[2]
        met += bound == least
    assert met > 135


def test_dual_feasible_functions_never_pass_one():
    for capacity in (7, 12, 20):
        above, below = bestfit.dual_feasible(capacity)
        for n in (1, 2, 3, 4):
            for sizes in combinations([s for s in range(1, capacity + 1) for _ in range(min(n, capacity // s))], n) if n < 4 else [(a, b, c, capacity - a - b - c) for a in range(1, 5) for b in range(1, 5) for c in range(1, 5) if capacity - a - b - c > 0]:
                if sum(sizes) <= capacity:
                    assert (above[:, list(sizes)].sum(1) <= below).all()


def test_partitions_exchange_documents(spark):
    # Sizes that pair up across partitions only: each partition alone wastes room.
    draw = random.Random(11)
    sizes = [draw.randint(1, 1023) for _ in range(3000)]
    items = spark.createDataFrame(list(enumerate(sizes)), "uid long, size int")
    rows = bestfit.pack_items(items, part_items=60).collect()
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], sizes[r["uid"]]))
    assert sorted(r["uid"] for r in rows) == list(range(3000))
    assert all(sum(n for _, n in v) <= 1024 and sorted(o for o, _ in v) == [sum(n for _, n in sorted(v)[:i]) for i in range(len(v))] for v in by.values())
    bound = bestfit.lower_bound(bestfit._sums(np.array(sizes), 1024), 1024)
    alone = 0
    for r in items.selectExpr("pmod(xxhash64(uid), 50) AS part", "size").groupBy("part").agg({"size": "collect_list"}).collect():
        alone += bestfit.best_fit(np.array(r[1]), 1024)[2]
    assert len(by) - bound < (alone - bound) / 3
