"""Similarity joins in matrix cells against all pairs, one at a time."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rulewright.operators import similarity


def cosine(a, b):
    if not a or not b or len(a) != len(b) or any(x is None or not math.isfinite(x) for x in [*a, *b]):
        return 0.0
    size = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
    return sum(x * y for x, y in zip(a, b, strict=True)) / size if size else 0.0


def brute(queries, items, k, same=lambda q, i: True):
    out = set()
    for q, c, a in queries:
        found = sorted((-round(cosine(a, b), 12), i) for i, d, b in items if i is not None and same((q, c), (i, d)))[:k]
        out |= {(q, i, n, round(-s, 9) + 0.0) for n, (s, i) in enumerate(found, 1)}
    return out


def got(df):
    return {(r["query_id"], r["item_id"], r["rank"], round(r["similarity"], 9) + 0.0) for r in df.collect()}


@pytest.fixture
def rows():
    rng = np.random.default_rng(3)
    vectors = rng.integers(-9, 10, (150, 4)).astype(float).tolist()
    vectors[40:50] = vectors[:10]
    vectors[60:66] = [None, [], [0.0] * 4, [1.0, None, 2.0, 3.0], [math.nan, 1.0, 1.0, 1.0], [1.0, 2.0, 3.0]]
    vectors[66] = [3.0, 2.0, 1.0]
    return [(i, "hot" if i % 10 else "abc"[i % 3], v) for i, v in enumerate(vectors)]


@pytest.mark.parametrize("blocks", [(4096, 8192, 256), (50, 60, 7)])
def test_cells_equal_all_pairs(spark, rows, monkeypatch, blocks):
    for name, n in zip(("BLOCK_QUERIES", "BLOCK_ITEMS", "_TILE"), blocks, strict=True):
        monkeypatch.setattr(similarity, name, n)
    queries = spark.createDataFrame(rows, "query_id long, label string, q array<double>")
    items = spark.createDataFrame([*rows, (None, "hot", [1.0] * 4)], "item_id long, label string, v array<double>")
    out = similarity.knn(queries.drop("label"), items.drop("label"), 5)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert got(out) == brute(rows, rows, 5)
    assert got(similarity.knn(queries, items, 4, "label")) == brute(rows, rows, 4, lambda q, i: q[1] == i[1])
    assert got(similarity.knn(queries, items, 1, "label", others=True)) == brute(rows, rows, 1, lambda q, i: q[1] == i[1] and q[0] != i[0])
    first = {}
    for q, i, n, _ in sorted(brute(rows, rows, 5), key=lambda r: r[2]):
        if rows[q][1] == rows[i][1]:
            first.setdefault(q, i)
    found = similarity.knn_postfiltered(queries, items, "label", 5).select("query_id", "item_id").collect()
    assert {r["query_id"]: r["item_id"] for r in found} == first


def test_fewer_items_than_k_and_none(spark):
    queries = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "query_id long, q array<double>")
    items = spark.createDataFrame([(7, [1.0, 1.0]), (8, [0.0, 1.0])], "item_id long, v array<float>")
    assert {(r["query_id"], r["item_id"]) for r in similarity.knn(queries, items, 5).collect()} == {(1, 7), (1, 8), (2, 7), (2, 8)}
    assert similarity.knn(queries, items.limit(0), 5).count() == similarity.knn(queries.limit(0), items, 5).count() == 0


def test_a_subject_without_rule_or_item_is_reported(spark):
    subjects = spark.createDataFrame([(1, "a", [1.0]), (2, "b", [1.0]), (3, "c", [1.0]), (4, None, [1.0])], "id long, label string, q array<double>")
    matched = subjects.where("id = 1").select("id", F.lit(-1).cast("long").alias("item_id"))
    items = spark.createDataFrame([(9, "b", [2.0]), (8, "d", [2.0])], "item_id long, label string, v array<double>")
    out = similarity.matched_or_nearest(subjects, matched, items, ["id"], "label")
    assert sorted((r["id"], r["item_id"], r["matched_by"]) for r in out.collect()) == [(1, -1, "rule"), (2, 9, "nearest"), (3, None, "none"), (4, None, "none")]
