"""Projection trees against brute force, and their edge cases."""

import numpy as np
import pandas as pd
from compare import SF
from pyspark.sql import functions as F

from rulewright.llm import forest, queries


def unit(rows):
    x = np.stack(rows).astype(float)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_op4_recall_and_scores(spark):
    d = pd.read_parquet(f"{SF}/embeddings.parquet").sort_values("vec_id")
    x, ids = unit(d["embedding"]), d["vec_id"].to_numpy()
    got = queries.op4_nearest_neighbours(spark, SF).toPandas()
    hits = total = 0
    for q in np.flatnonzero(ids % 50 == 0):
        score = x @ x[q]
        score[q] = -2
        own = got[got["query_id"] == ids[q]].sort_values("rank")
        assert own["rank"].tolist() == [1, 2, 3, 4, 5]
        assert np.allclose(own["score"], score[np.searchsorted(ids, own["vec_id"])], atol=1e-12)
        hits += len(set(ids[np.lexsort((ids, -score))[:5]]) & set(own["vec_id"]))
        total += 5
    assert hits / total >= 0.9


def test_op4_recall_in_deep_trees(spark):
    """Clustered vectors: five levels, and less than a third of all rows read for a query."""
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(160, 32))
    x = (np.repeat(centres, 80, axis=0) + 0.35 * rng.normal(size=(12_800, 32))).astype(np.float32)
    df = spark.createDataFrame(pd.DataFrame({"vec_id": range(len(x)), "embedding": x.tolist()}), "vec_id long, embedding array<float>")
    model = forest.fit(forest.usable(df), 8, 400, 5)
    assert model.depth == 5
    got = forest.nearest(df, "id % 50 = 0", leaf_rows=400, share=0.3).toPandas()
    u, hits, read = unit(x), 0, []
    leaves = model.leaves(u) + (np.arange(8) << 5)
    asked = range(0, len(x), 50)
    for q in asked:
        score = u @ u[q]
        score[q] = -2
        hits += len(set(np.argsort(-score)[:5]) & set(got[got["query_id"] == q]["vec_id"]))
        codes = model.search(model.project(u[q : q + 1])[0], 0.3)
        read.append(np.isin(leaves, codes).any(1).mean())
    assert np.mean(read) < 0.3
    assert hits / (5 * len(asked)) >= 0.9


def test_the_model_does_not_grow_with_the_table(spark):
    df = spark.range(300_000).selectExpr("id", "array(cast(rand(1) - 0.5 as float), cast(rand(2) - 0.5 as float), cast(rand(3) - 0.5 as float)) AS v")
    assert forest.fit(df, 2, 1, 5).depth == 10


def test_op4_repeated_ids(spark):
    rows = [(0, [1.0, 0.0]), (7, [1.0, 0.1]), (7, [1.0, 0.1]), (7, [0.0, 1.0]), (8, [0.5, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = forest.nearest(df, "id = 0").orderBy("rank").collect()
    assert [r["vec_id"] for r in got][:1] == [7]
    assert {r["vec_id"] for r in got} == {7, 8}


def test_op4_edges(spark):
    v = [1.0, 0.0]
    rows = [(0, v), (50, [2.0, 0.0]), (100, v), (3, v), (4, v), (5, v), (6, v), (7, v), (8, v), (1, None), (2, []), (9, [0.0, 0.0]), (10, [float("nan"), 1.0]), (11, [None, 1.0]), (12, [1.0]), (None, v), (150, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("code", F.lit(1)).withColumn("id", F.lit("x"))
    got = {}
    for r in forest.nearest(df, "id % 50 = 0").orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], round(r["score"], 9)))
    assert got[0] == [(i, 1.0) for i in (3, 4, 5, 6, 7)]
    assert got[50] == [(i, 1.0) for i in (0, 3, 4, 5, 6)]
    assert got[100] == [(i, 1.0) for i in (0, 3, 4, 5, 6)]
    assert [s for _, s in got[150]] == [0.0] * 5
    assert forest.nearest(df.limit(0), "id % 50 = 0").collect() == []
    assert forest.nearest(df.where("vec_id = 0"), "id % 50 = 0").collect() == []


def test_op6_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 32))
    x[100:400] = x[0] + 0.05 * rng.normal(size=(300, 32))
    x[400:700] = x[1] + rng.normal(size=(300, 32)) * rng.uniform(0.1, 0.4, (300, 1))
    x = x.astype(np.float32)
    x[700:720] = x[2]
    ids = rng.permutation(5000)[: len(x)]
    df = spark.createDataFrame(pd.DataFrame({"vec_id": ids, "embedding": x.tolist()}), "vec_id long, embedding array<float>")
    got = forest.near_duplicates(df).toPandas().set_index("vec_id").loc[ids]
    u = unit(x)
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    assert got["n_links"].tolist() == near.sum(1).tolist()
    part = ids.copy()
    while True:
        low = np.minimum(part, np.where(near, part[None, :], 10**9).min(1))
        if (low == part).all():
            break
        part = low
    assert got["component_id"].tolist() == part.tolist()
    assert (got["kept"] == (got.index == got["component_id"])).all()


def test_op6_one_loose_group(spark):
    """A group with pairs on both sides of the threshold, in trees of six levels beside other vectors: no link is missed."""
    rng = np.random.default_rng(12)
    centre = rng.normal(size=64)
    x = np.concatenate([centre + 0.24 * rng.normal(size=(1800, 64)), rng.normal(size=(1800, 64))]).astype(np.float32)
    df = spark.createDataFrame(pd.DataFrame({"vec_id": range(len(x)), "embedding": x.tolist()}), "vec_id long, embedding array<float>")
    got = forest.near_duplicates(df, leaf_rows=60).toPandas().set_index("vec_id").sort_index()
    u = unit(x)
    want = (u @ u.T >= 0.95).sum(1) - 1
    assert 10_000 < want.sum() < 1800 * 1800 * 0.9
    assert got["n_links"].tolist() == want.tolist()


def test_op6_large_leaves_are_cut(spark, monkeypatch):
    monkeypatch.setattr(forest, "BLOCK_ROWS", 8)
    rng = np.random.default_rng(4)
    x = np.concatenate([1 + 0.01 * rng.normal(size=(60, 8)), rng.normal(size=(40, 8))]).astype(np.float32)
    df = spark.createDataFrame(pd.DataFrame({"vec_id": range(100), "embedding": x.tolist()}), "vec_id long, embedding array<float>")
    got = forest.near_duplicates(df, leaf_rows=16).toPandas().set_index("vec_id").sort_index()
    u = unit(x)
    near = u @ u.T >= 0.95
    assert got["n_links"].tolist() == (near.sum(1) - 1).tolist()
    assert (got["component_id"][:60] == 0).all()


def test_op6_edges(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [1.0, 0.0]), (4, None), (5, []), (6, [0.0, 0.0]), (7, [float("inf"), 1.0]), (8, [None, 1.0]), (None, [1.0, 0.0]), (9, [0.0, -1.0]), (3, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("copies", F.lit(1)).withColumn("v", F.lit("x"))
    got = forest.near_duplicates(df).collect()
    assert len(got) == len(rows)
    assert {(r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in got} == {
        (1, 2, 1, True), (2, 2, 1, False), (3, 2, 1, False), (4, 0, 4, True), (5, 0, 5, True), (6, 0, 6, True), (7, 0, 7, True), (8, 0, 8, True), (None, 0, None, True), (9, 0, 9, True),
    }
    assert forest.near_duplicates(df.limit(0)).collect() == []
