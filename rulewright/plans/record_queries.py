"""Edges, look-ups, incremental writes and small reports."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulewright.functions import scores, text
from rulewright.operators import rules, sessions, similarity
from rulewright.plans.registry import query, table
from rulewright.sources import readers, sinks
from rulewright.storage import Workspace


@query("""SELECT o_orderkey AS source_id, c_custkey AS target_id, c_mktsegment AS feature_name, c_acctbal AS score FROM customer JOIN orders ON o_custkey = c_custkey AND o_orderkey % 25 = c_custkey % 25""")
def case_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("case_id"), F.col("c_custkey").alias("subject"), (F.col("c_custkey") % 25).alias("code"), F.col("c_mktsegment").alias("feature_name"), F.col("c_acctbal").alias("score"))
    found = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("rule_id"), F.col("o_custkey").alias("subject"), (F.col("o_orderkey") % 25).alias("code"))
    return rules.contribution_edges(cases, found, ["subject", "code"])


@query("""SELECT o_orderkey, s_suppkey FROM (SELECT o_orderkey, s_suppkey, row_number() OVER (PARTITION BY o_orderkey ORDER BY s_suppkey) AS rn FROM orders JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_nationkey = c_nationkey AND s_suppkey % 3 = o_orderkey % 3) WHERE rn = 1""")
def code_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    subject = o.select("o_orderkey", F.col("c_nationkey").alias("age_group"), (F.col("o_orderkey") % 3).alias("code"))
    sheet = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("age_group"), (F.col("s_suppkey") % 3).alias("code"), "s_suppkey")
    return rules.lookup_code(subject, sheet, ["age_group", "code"], "s_suppkey").select("o_orderkey", "s_suppkey")


@query("""WITH p AS (SELECT vec_id, (i - 1)::INT AS idx, embedding[i]::DOUBLE AS x, embedding[i + 8]::DOUBLE AS y FROM embeddings, range(1, 7) r(i)), q(i, j) AS (VALUES (0, 1), (2, 5), (3, 9))
    SELECT v.vec_id, q.i::INT AS i, q.j::INT AS j, round(atan2(b.y - a.y, b.x - a.x), 6) AS slope FROM (SELECT DISTINCT vec_id FROM p) v CROSS JOIN q LEFT JOIN p a ON a.vec_id = v.vec_id AND a.idx = q.i LEFT JOIN p b ON b.vec_id = v.vec_id AND b.idx = q.j""")  # fmt: skip
def landmark_slopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    xs, ys = (F.slice("embedding", at, 6) for at in (1, 9))
    points = e.select("vec_id", F.posexplode(F.arrays_zip(xs.alias("x"), ys.alias("y"))).alias("index", "p")).select("vec_id", "index", F.col("p.x").cast("double").alias("x"), F.col("p.y").cast("double").alias("y"))
    pairs = spark.createDataFrame([(0, 1), (2, 5), (3, 9)], "i int, j int")
    return rules.landmark_slopes(points, pairs, ["vec_id"]).withColumn("slope", F.round("slope", 6))


@query("SELECT conv_id, concat_ws(',', CASE WHEN s > 0 THEN 'scores' END, CASE WHEN u > 1 THEN 'recommendations' END, CASE WHEN a > 2 THEN 'evidence' END) AS done, s > 0 AND (u > 1 OR a > 2) AS sufficient FROM (SELECT conv_id, count(*) FILTER (role = 'system') AS s, count(*) FILTER (role = 'user') AS u, count(*) FILTER (role = 'assistant') AS a FROM conversations GROUP BY 1)")
def stage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(*(F.collect_list(F.when(F.col("role") == r, F.lit(1))).alias(r) for r in ("system", "user", "assistant")))
    told = sessions.stages_done(F.col("system"), F.slice("user", 2, 100), F.slice("assistant", 3, 100))
    return lists.select("conv_id", told.alias("t")).select("conv_id", "t.done", "t.sufficient")


@query(r"SELECT c_name, regexp_extract(c_name, '([0-9]+)$', 1)::INT AS epoch FROM customer WHERE regexp_extract(c_name, '([0-9]+)$', 1)::INT % 10 = 0")
def every_tenth(spark: SparkSession, sf_dir: str) -> DataFrame:
    epoch = F.regexp_extract("c_name", "([0-9]+)$", 1).try_cast("int")
    return table(spark, sf_dir, "customer").select("c_name", epoch.alias("epoch")).where("epoch % 10 = 0").orderBy(F.asc_nulls_last("epoch"))


@query("SELECT source, string_agg(quality || '=' || n, ',' ORDER BY quality) AS distribution FROM (SELECT source, quality, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY ALL) GROUP BY source")
def score_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score counts of each source as a map, written out by key."""
    j = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id")
    counts = j.groupBy("source", "quality").agg(F.count("*").alias("n")).groupBy("source").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("quality", "n")))).alias("m"))
    return counts.select("source", F.array_join(F.transform(F.array_sort(F.map_entries("m")), lambda e: F.concat_ws("=", e["key"].cast("string"), e["value"].cast("string"))), ",").alias("distribution"))


@query("SELECT count(*) AS n, sum(doc_id)::BIGINT AS ids FROM documents WHERE doc_id % 3 <> 0")
def skip_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only documents whose keys are not yet in the written table."""
    ws = Workspace(spark, "written")
    docs = table(spark, sf_dir, "documents")
    sinks.replace_table(docs.where("doc_id % 3 = 0").select("doc_id"), ws.path("done"))
    return sinks.only_new(docs, spark.read.parquet(ws.path("done")), ["doc_id"]).agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"))


@query(r"""WITH k AS (SELECT doc_id, coalesce(nullif(substr(regexp_replace(text, '^\s+|\s+$', '', 'g'), 1, 8000), ''), ' ') AS content FROM documents)
    SELECT doc_id, CASE WHEN content IN (SELECT content FROM k WHERE doc_id % 2 = 0) THEN 1.0 ELSE length(content)::DOUBLE END AS first, 'success' AS status FROM k""")  # fmt: skip
def embed_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cached vectors for the contents of even documents, a user's model for the distinct rest."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    cache = docs.where("doc_id % 2 = 0").select(text.content_key(text.hash_text(F.col("text"))).alias("content_key"), F.array(F.lit(1.0)).alias("vector")).distinct()

    def make():  # noqa: ANN202
        return lambda rows: pd.DataFrame({"vector": [[float(len(t))] for t in rows["content"]]})

    return similarity.embed_missing(docs, cache, "text", make).select("doc_id", F.col("vector")[0].alias("first"), "status")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, round(CASE WHEN l_linenumber % 2 = 0 THEN (l_quantity + l_tax) / 2 ELSE l_quantity END, 4) AS mean, round_even(l_quantity / 3, 0)::INT AS even, greatest(l_linenumber, 4) = 4 AND l_linenumber = 4 AS top FROM lineitem""")
def region_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    other = F.when(F.col("l_linenumber") % 2 == 0, F.col("l_tax"))
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.round(scores.row_mean(F.col("l_quantity"), other), 4).alias("mean"), scores.half_even(F.col("l_quantity") / 3).alias("even"),
        (scores.mean_unless_top(4, F.col("l_linenumber"), F.lit(-4)) == 4).alias("top"),
    )


@query("SELECT rule_id, code_a FROM (SELECT c_custkey::VARCHAR AS rule_id, c_mktsegment AS age_group, 'K' || c_nationkey AS code_a FROM customer WHERE c_custkey % 4 <> 0)")
def composite_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A wide sheet taken by position, without rows that lack a group."""
    group = F.when(F.col("c_custkey") % 4 != 0, F.col("c_mktsegment")).otherwise(" ")
    sheet = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string"), group, F.concat(F.lit("K"), "c_nationkey"))
    return readers.read_composite(sheet, ["rule_id", "age_group", "code_a"]).select("rule_id", "code_a")
