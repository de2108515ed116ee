"""Evidence retrieval: similarity, merging, ranking, the growing corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulewright.functions import text
from rulewright.operators import corpus, similarity
from rulewright.plans.registry import query, table
from rulewright.storage import Workspace
from rulewright.streaming.upserts import CorpusSink, run_upserts

_E = "e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings)"


def _queries(spark: SparkSession, sf_dir: str, every: int) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "label", F.col("embedding").alias("q"))


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), "label", F.col("embedding").alias("v"))


@query(f"""WITH {_E} SELECT query_id, item_id, rank, round(similarity, 6) AS similarity FROM (SELECT q.vec_id AS query_id, i.vec_id AS item_id, list_cosine_similarity(q.v, i.v) AS similarity,
    row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(q.v, i.v) DESC, i.vec_id)::INT AS rank FROM e q JOIN e i USING (label) WHERE q.vec_id % 20 = 0) WHERE rank <= 3""")  # fmt: skip
def knn_prefilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = similarity.knn(_queries(spark, sf_dir, 20), _items(spark, sf_dir), 3, "label")
    return found.select("query_id", "item_id", "rank", F.round("similarity", 6).alias("similarity"))


_GLOBAL = f"""WITH {_E}, k AS (SELECT * FROM (SELECT q.vec_id AS query_id, q.label AS want, i.vec_id AS item_id, i.label, list_cosine_similarity(q.v, i.v) AS similarity,
    row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(q.v, i.v) DESC, i.vec_id)::INT AS rank FROM e q, e i WHERE q.vec_id % 20 = 0) WHERE rank <= 5)"""


@query(_GLOBAL + " SELECT query_id, item_id, rank, round(similarity, 6) AS similarity FROM k")
def knn_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = similarity.knn(_queries(spark, sf_dir, 20).drop("label"), _items(spark, sf_dir), 5)
    return found.select("query_id", "item_id", "rank", F.round("similarity", 6).alias("similarity"))


@query(_GLOBAL + " SELECT query_id, item_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rn FROM k WHERE label = want) WHERE rn = 1")
def knn_postfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.knn_postfiltered(_queries(spark, sf_dir, 20), _items(spark, sf_dir), "label", 5).select("query_id", "item_id")


_DOCS = "d AS (SELECT doc_id, source, lang, n_chars, round(n_chars / 10000.0, 4)::DOUBLE AS sim FROM documents)"


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", F.round(F.col("n_chars") / 10000.0, 4).alias("sim"))


@query(f"""WITH {_DOCS}, r AS (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY sim DESC, doc_id) AS rn, max(sim) OVER (PARTITION BY source, lang) AS top FROM d)
    SELECT source, lang, doc_id, sim FROM r WHERE sim >= 0.5 OR (rn = 1 AND top < 0.5)""")  # fmt: skip
def threshold_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.threshold_with_floor(_scored(spark, sf_dir), ["source", "lang"], "sim", 0.5, "doc_id").select("source", "lang", "doc_id", "sim")


@query(f"""WITH {_DOCS}, r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY sim DESC, doc_id)::INT AS rank FROM d),
    x AS (SELECT *, CASE WHEN rank <= 6 AND doc_id % 3 = 0 THEN doc_id END AS pos FROM r)
    SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY pos IS NULL, pos, rank)::INT AS new_rank FROM x""")  # fmt: skip
def rerank_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _scored(spark, sf_dir)
    ranked = similarity.top_k(docs, ["source"], [F.desc("sim"), F.col("doc_id")], 1 << 30)
    listed = docs.where("doc_id % 3 = 0").select("source", "doc_id", F.col("doc_id").alias("position"))
    return similarity.rerank(ranked, listed, ["source"], "doc_id", 6).select("source", "doc_id", "new_rank")


@query("""WITH p AS (SELECT doc_id, 'label' AS origin FROM labels), s AS (SELECT doc_id, lang AS origin FROM documents WHERE n_chars > 1000)
    SELECT doc_id, origin, 0 AS source_rank FROM p UNION ALL SELECT doc_id, origin, 1 FROM s WHERE doc_id NOT IN (SELECT doc_id FROM p)""")  # fmt: skip
def priority_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    primary = table(spark, sf_dir, "labels").select("doc_id", F.lit("label").alias("origin"))
    secondary = table(spark, sf_dir, "documents").where("n_chars > 1000").select("doc_id", F.col("lang").alias("origin"))
    return similarity.priority_union(primary, secondary, ["doc_id"])


@query("""WITH l AS (SELECT source, doc_id, 0 AS level_no FROM documents WHERE n_chars > 9000 UNION ALL SELECT source, doc_id, 1 FROM documents WHERE n_chars > 5000
    UNION ALL SELECT source, doc_id, 2 FROM documents), f AS (SELECT *, min(level_no) OVER (PARTITION BY source) AS first FROM l)
    SELECT source, doc_id, level_no FROM f WHERE level_no = first""")  # fmt: skip
def relaxation_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars")
    levels = [docs.where("n_chars > 9000"), docs.where("n_chars > 5000"), docs]
    return similarity.first_level([d.drop("n_chars") for d in levels], ["source"])


@query(r"""WITH t AS (SELECT doc_id, coalesce(nullif(substr(regexp_replace(text, '^\s+|\s+$', '', 'g'), 1, 8000), ''), ' ') AS content FROM documents),
    k AS (SELECT *, sha256(content) AS content_key FROM t), c AS (SELECT DISTINCT content_key FROM k WHERE doc_id % 2 = 0)
    SELECT content_key, count(*) AS n FROM k WHERE content_key NOT IN (SELECT content_key FROM c) GROUP BY content_key""")  # fmt: skip
def hash_cache_miss(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    cache = docs.where("doc_id % 2 = 0").select(text.content_key(text.hash_text(F.col("text"))).alias("content_key")).distinct()
    hits, misses = similarity.cache_split(docs, cache, "text")
    return hits.join(misses.select("content_key"), "content_key").groupBy("content_key").agg(F.count("*").alias("n"))


def _sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").alias("pmid"), "ts", "event_id", F.when(F.col("value") > 300, F.col("event_type")).otherwise(F.when(F.col("value") > 200, "")).alias("title"), "props",
        F.concat_ws("-", "event_type", (F.col("event_id") % 5).cast("string")).alias("query"),
    )


_CORPUS_SQL = """WITH s AS (SELECT user_id AS pmid, ts, event_id, CASE WHEN value > 300 THEN event_type WHEN value > 200 THEN '' END AS title, props, event_type || '-' || (event_id % 5) AS query FROM events),
    q AS (SELECT pmid, query, min((ts, event_id)) AS seen_at FROM s GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY pmid ORDER BY seen_at DESC) AS n FROM q),
    l AS (SELECT pmid, string_agg(query, ',' ORDER BY seen_at) AS queries FROM r WHERE n <= 8 GROUP BY pmid),
    f AS (SELECT pmid, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS seen_count, arg_min(title, (ts, event_id)) FILTER (title <> '') AS title, arg_min(props, (ts, event_id)) FILTER (props <> '') AS props FROM s GROUP BY pmid)
    SELECT pmid, first_seen, last_seen, seen_count, title, props, queries FROM f LEFT JOIN l USING (pmid)"""


def _fold(df: DataFrame) -> DataFrame:
    return corpus.fold_sightings(df, "pmid", "ts", "event_id", ["title", "props"], "query")


@query(_CORPUS_SQL)
def corpus_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fold(_sightings(spark, sf_dir)).withColumn("queries", F.array_join("queries", ","))


@query("SELECT min(first_seen) AS first_seen, max(last_seen) AS last_seen, sum(seen_count)::BIGINT AS seen, count(*) AS n_papers, count(title) AS n_titles FROM (" + _CORPUS_SQL + ")")
def corpus_upsert_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same fold, batch by batch from a stream of the events table."""
    ws = Workspace(spark, "corpus-stream")
    events = _sightings(spark, sf_dir).repartition(3, "pmid")
    schema = ws.save(events, "events").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(ws.path("events"))
    sink = CorpusSink(spark, ws.path("corpus"), "pmid", "ts", "event_id", ["title", "props"], "query")
    run = run_upserts(stream, sink, ws.path("checkpoint"))
    run.awaitTermination()
    last = sink.version(run.lastProgress["batchId"])
    return last.agg(
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.sum("seen_count").alias("seen"), F.count("*").alias("n_papers"), F.count("title").alias("n_titles")
    )


@query("""SELECT c_nationkey, c_mktsegment, sum(c_acctbal) AS total, count(*) AS n FROM (SELECT c_custkey, c_nationkey, c_mktsegment, c_acctbal FROM customer WHERE c_custkey % 4 <> 0
    UNION ALL SELECT c_custkey, c_nationkey, 'UPDATED', 1.0 FROM customer WHERE c_custkey % 4 = 0) GROUP BY ALL""")  # fmt: skip
def keyed_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment", "c_acctbal")
    early = c.where("c_custkey % 4 = 0").select("c_custkey", "c_nationkey", F.lit("EARLY").alias("c_mktsegment"), F.lit(0.0).alias("c_acctbal"), F.lit(1).alias("ordinal"))
    late = early.withColumns({"c_mktsegment": F.lit("UPDATED"), "c_acctbal": F.lit(1.0), "ordinal": F.lit(2)})
    merged = corpus.upsert(c, early.unionByName(late), ["c_custkey"], "ordinal")
    return merged.groupBy("c_nationkey", "c_mktsegment").agg(F.sum("c_acctbal").alias("total"), F.count("*").alias("n"))


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.duplicate_keys(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT count(*) AS n_papers, count(vec_id) AS n_with_vector FROM documents LEFT JOIN embeddings ON doc_id = vec_id")
def corpus_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, e = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("vec_id").alias("v"))
    return corpus.corpus_counts(docs.join(e, "doc_id", "left"), "v")


@query("SELECT count(*) AS n, sum(doc_id)::BIGINT AS ids FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def missing_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, e = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    return corpus.attach_vectors(docs, e, "doc_id")[1].agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"))
