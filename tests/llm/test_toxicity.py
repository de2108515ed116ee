"""The classifier chain on labelled documents, and its edge cases."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from rulewright.llm import queries, toxicity

SF = "/root/testdata/sf0.01"


def test_op2_catches_toxic_and_leaves_clean(spark):
    got = queries.op2_toxicity(spark, SF).toPandas()
    assert len(got) == len(pd.read_parquet(f"{SF}/documents.parquet"))
    judged = got.merge(pd.read_parquet(f"{SF}/labels.parquet"), on="doc_id", suffixes=("", "_label"))
    assert judged[judged["toxic_label"] == 1]["toxic"].mean() > 0.9
    assert judged[judged["toxic_label"] == 0]["toxic"].mean() < 0.02
    assert got["p_toxic"].between(0, 1).all()


def chain_data(n=600):
    rng = np.random.default_rng(0)
    words = np.array([f"w{i}" for i in range(300)])
    labels = rng.random((n, 2)) < 0.3
    labels[:, 1] = labels[:, 0] & (rng.random(n) < 0.9)
    texts = [" ".join([*rng.choice(words, 20), *(["scum"] if a else [])]) for a, _ in labels]
    return texts, labels.astype(int)


def test_later_model_reads_earlier_probabilities():
    texts, labels = chain_data()
    parts = list(toxicity.features(texts))
    buckets = np.concatenate([k for _, k in parts])
    ends = np.concatenate([[0], *(np.diff(o) for o, _ in parts)]).cumsum()
    chain = toxicity.fit_chain(ends, buckets, labels)
    assert [len(m.earlier) for m in chain] == [0, 1]
    assert chain[1].earlier[0] > 0
    first = chain[0].predict(ends, buckets, np.zeros((len(texts), 0)))
    assert ((first >= 0.5) == labels[:, 0]).mean() > 0.98


def test_copies_share_a_fold():
    texts, _ = chain_data(300)
    texts += [f"{t} more" for t in texts[:100]] + texts[100:200]
    parts = list(toxicity.features(texts))
    ends = np.concatenate([[0], *(np.diff(o) for o, _ in parts)]).cumsum()
    group = toxicity._group(ends, np.concatenate([k for _, k in parts]))
    assert (group[300:400] == group[:100]).mean() > 0.97
    assert (group[400:] == group[100:200]).all()
    assert len(set(group[:300].tolist())) > 250


def test_chain_equals_a_plain_version():
    """Each probability again in plain Python, from the weights of the chain and the words of the text."""
    import math

    texts, labels = chain_data()
    parts = list(toxicity.features(texts))
    buckets = np.concatenate([k for _, k in parts])
    ends = np.concatenate([[0], *(np.diff(o) for o, _ in parts)]).cumsum()
    chain = toxicity.fit_chain(ends, buckets, labels)
    before = np.zeros((len(texts), 0))
    for link in chain:
        got = link.predict(ends, buckets, before)
        for i in range(0, len(texts), 7):
            own = buckets[ends[i] : ends[i + 1]].tolist()
            margin = sum(link.weights[b] for b in own) / math.sqrt(max(1, len(own))) + sum(p * w for p, w in zip(before[i].tolist(), link.earlier.tolist(), strict=True)) + link.bias
            assert abs(got[i] - 1 / (1 + math.exp(-margin))) < 1e-9
        before = np.column_stack((before, got))


def test_op2_on_documents_that_were_not_labelled_for_it(spark):
    """Trained without every third labelled document and all its copies; judged on those."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    text = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    out = {text[r["doc_id"]] for r in labels.collect() if r["doc_id"] % 3 == 0}
    kept = spark.createDataFrame([(i,) for i, t in text.items() if t not in out], "doc_id long")
    got = toxicity.classify(docs, labels.join(kept, "doc_id")).join(labels.withColumnRenamed("toxic", "want"), "doc_id").where("doc_id % 3 = 0").toPandas()
    assert got[got["want"] == 1]["toxic"].mean() > 0.82
    assert got[got["want"] == 0]["toxic"].mean() < 0.01


def test_features_do_not_depend_on_neighbours():
    one = [k.tolist() for _, k in toxicity.features(["The IDIOT said: ###"])]
    many = list(toxicity.features(["x", "The IDIOT said: ###", "", "idiots"]))
    offsets, buckets = many[0]
    assert buckets[offsets[1] : offsets[2]].tolist() == one[0]
    assert offsets[2] == offsets[3]
    assert len(buckets[offsets[3] : offsets[4]]) == 4


def test_op2_edges(docs, empty, spark):
    rows = [(i, f"you scum {i}" if i % 2 else f"dear friend {i}") for i in range(40)]
    rows += [(100, None), (101, ""), (None, "scum"), (102, "scum " * 100_000), (1, "you scum 1")]
    df = docs(rows).withColumn("p_toxic", F.lit("x")).withColumn("toxic", F.lit(1))
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(40)] + [(500, 0, 1), (3, None, 1)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.classify(df, labels).collect()}
    assert len(got) == 44
    assert got[1]["toxic"] and got[102]["toxic"] and not got[2]["toxic"]
    assert got[100]["p_junk"] == got[101]["p_junk"]
    assert toxicity.classify(empty, labels).collect() == []
    assert toxicity.classify(docs([(1, "a")]), labels.limit(0)).count() == 1


def test_fit_holds_the_sample_once(monkeypatch):
    """Besides the features themselves (8 MB here) the fit needs no memory that grows with them."""
    import tracemalloc

    monkeypatch.setattr(toxicity, "STEPS", 2)
    rng = np.random.default_rng(1)
    n, each = 1000, 2000
    buckets = np.sort(rng.integers(0, toxicity.BUCKETS // each, (n, each)) + np.arange(each) * (toxicity.BUCKETS // each), axis=1).astype(np.int32).reshape(-1)
    tracemalloc.start()
    chain = toxicity.fit_chain(np.arange(n + 1) * each, buckets, rng.integers(0, 2, (n, 2)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(chain) == 2
    assert peak < 80e6
