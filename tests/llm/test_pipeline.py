"""The pipeline against a plain Python version of its stages."""

import pandas as pd
from pyspark.sql import functions as F
from compare import SF
from test_near_duplicates import alike, character_sets, close_pairs, components, word_sets

import corpus_pipeline
from rulewright.llm import secrets


def test_run_equals_plain_version(spark):
    d = pd.read_parquet(f"{SF}/documents.parquet")
    # Every document of this table has letters in one language; none is rejected.
    found = [((i, k), x) for i, t in zip(d["doc_id"], d["text"], strict=True) for k, x in enumerate(t.split("\n")) if x.strip(" \t\r")]
    at = [a for a, _ in found]
    gone = {a for a, f in zip(at, components(at, close_pairs(character_sets([x for _, x in found]))), strict=True) if a != f}
    texts = {i: "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone) for i, t in zip(d["doc_id"], d["text"], strict=True)}
    texts = {i: t for i, t in texts.items() if t.strip(" \t\r\n") or not any(a[0] == i for a in gone)}
    ids = list(texts)
    parts = components(ids, alike(word_sets(texts.values(), 5)))
    texts = {i: secrets.mask(t, secrets.scan(t)) for (i, t), p in zip(texts.items(), parts, strict=True) if i == p}
    out = corpus_pipeline.run(spark, SF).toPandas()
    assert set(out["doc_id"]) == set(texts)
    from rulewright.llm.bpe import codec

    book = codec(corpus_pipeline.public_tokenizers.path(corpus_pipeline.TOKENIZER))
    want = {i: len(book.encode(t)) + 1 for i, t in texts.items()}
    assert out.groupby("doc_id")["length"].sum().to_dict() == want


def test_run_on_edge_cases(spark, docs, tmp_path):
    """Null and empty texts, repeated ids, a rejected document, a repeated line, a near copy, a secret, clashing columns."""
    said = "the quick brown fox jumps over the lazy dog and runs home"
    rows = [(i, f"{said} on day number {i * 37} of the year with {i * 11} friends\nline {i * 13} stands alone here", "en", "a") for i in range(30)]
    rows += [(100, None, "en", None), (101, "", "de", "b"), (102, "123 456", None, "b"), (103, "token=abcdef123 is in this english text of ours", "en", "b"), (103, "quite another english text of the same id, with words", "en", "b")]
    rows += [(104, "12 !!\nthe only words of this document are these few ones", "en", "c"), (105, "12 !!\nthe only words of this document are these few ones", "en", "c")]
    df = docs(rows).withColumn("line", F.lit(1)).withColumn("queue", F.lit("x")).withColumn("__gone", F.lit(2))
    df.write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    ids = set(out["doc_id"])
    assert {0, 1, 29, 103, 104} <= ids
    assert not ids & {100, 101, 102}
    assert 105 not in ids or out[out["doc_id"] == 105]["doc_tokens"].max() < 8
    assert len(out[(out["doc_id"] == 103) & (out["start"] == 0)]) == 2
    kept = corpus_pipeline.STAGES[0][1](spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path))
    assert kept.columns == df.columns
    masked = corpus_pipeline.STAGES[3][1](spark, kept, str(tmp_path))
    assert masked.where("text like '%abcdef123%'").count() == 0


def test_run_on_an_empty_table(spark, empty, tmp_path):
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert len(corpus_pipeline.STAGES) == 5
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(30), SF).columns == docs.columns
