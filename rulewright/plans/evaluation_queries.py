"""Evaluation: confusion, rates, order statistics, intervals, histograms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulewright.functions import scores, text
from rulewright.operators import evaluation, histograms
from rulewright.plans.registry import query, table

_J = "j AS (SELECT doc_id, lang, quality, toxic, n_chars, least(n_chars // 1000, 9)::INT AS band, CASE WHEN n_chars > 1500 THEN 1 ELSE 0 END AS pred FROM documents JOIN labels USING (doc_id))"


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    j = docs.join(table(spark, sf_dir, "labels"), "doc_id")
    band = F.least(F.floor(F.col("n_chars") / 1000), F.lit(9)).cast("int")
    return j.withColumn("band", band).withColumn("pred", (F.col("n_chars") > 1500).cast("int"))


@query(f"WITH {_J} SELECT quality, count(*) FILTER (pred = 0) AS pred_0, count(*) FILTER (pred = 1) AS pred_1 FROM j GROUP BY quality")
def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.confusion(_judged(spark, sf_dir), "quality", "pred", [0, 1])


@query(f"""WITH {_J}, c AS (SELECT lang, quality, pred, count(*) AS n, grouping(lang)::INT AS merged FROM j GROUP BY GROUPING SETS ((lang, quality, pred), (quality, pred)))
    SELECT lang, quality, pred, n, merged, round(n / sum(n) OVER (PARTITION BY merged, lang, quality), 6) AS share FROM c""")  # fmt: skip
def confusion_norm_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    shares = evaluation.confusion_shares(_judged(spark, sf_dir), "quality", "pred", "lang")
    return shares.withColumn("share", F.round("share", 6))


@query(f"""WITH {_J}, t AS (SELECT unnest(list_distinct([quality, pred])) AS label, quality AS t, pred AS p FROM j),
    c AS (SELECT label, count(*) FILTER (t = label AND p = label) AS tp, count(*) FILTER (t <> label AND p = label) AS fp, count(*) FILTER (t = label AND p <> label) AS fn FROM t GROUP BY label)
    SELECT label, tp, fp, fn, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1 FROM c""")  # fmt: skip
def prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.precision_recall(_judged(spark, sf_dir), "quality", "pred")


@query(f"""WITH {_J} SELECT lang, round(avg((quality = pred)::INT), 6) AS accuracy, round(avg(CASE WHEN toxic = 1 THEN (quality = pred)::INT END), 6) AS toxic_accuracy,
    avg(CASE WHEN n_chars > 1000000 THEN 1.0 END) AS no_cases, round(avg((abs(band - quality) <= 1)::INT), 6) AS relaxed FROM j GROUP BY lang""")  # fmt: skip
def conditional_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = _judged(spark, sf_dir)
    right = F.col("quality") == F.col("pred")
    near = scores.relaxed(F.col("quality"), F.col("band")) == F.col("quality")
    return j.groupBy("lang").agg(
        F.round(evaluation.rate(right), 6).alias("accuracy"), F.round(evaluation.rate(right, F.col("toxic") == 1), 6).alias("toxic_accuracy"),
        evaluation.rate(F.lit(True), F.col("n_chars") > 1000000).alias("no_cases"), F.round(evaluation.rate(near), 6).alias("relaxed"),
    )


@query(f"""WITH {_J}, s AS (SELECT n_chars, sum(quality)::BIGINT AS pos, count(*) AS al FROM j GROUP BY n_chars)
    SELECT n_chars, (sum(pos) OVER (ORDER BY n_chars DESC))::BIGINT AS tp, (sum(al - pos) OVER (ORDER BY n_chars DESC))::BIGINT AS fp FROM s""")  # fmt: skip
def roc_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.roc_points(_judged(spark, sf_dir), "quality", "n_chars")


@query("""WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)
    SELECT event_type, max(n) AS n, max(value) FILTER (i = n // 4) AS q1, max(value) FILTER (i = n // 2) AS q2, max(value) FILTER (i = 3 * n // 4) AS q3, min(value) AS lo, max(value) AS hi, round(avg(value), 4) AS mean FROM r GROUP BY event_type""")  # fmt: skip
def index_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = evaluation.index_quantiles(table(spark, sf_dir, "events"), ["event_type"], "value")
    return q.withColumn("mean", F.round("mean", 4))


_Z = "1.959963984540054"


@query(f"""WITH c AS (SELECT event_type, count(*) FILTER (value > 250) AS k, count(*) AS n FROM events GROUP BY 1 UNION ALL SELECT 'none', 0, 0),
    p AS (SELECT *, CASE WHEN n = 0 THEN NULL ELSE k / n END AS p FROM c)
    SELECT event_type, CASE WHEN n = 0 THEN 0.0 ELSE round(greatest(0.0, ((p + {_Z}^2 / (2 * n)) - {_Z} * sqrt(p * (1 - p) / n + {_Z}^2 / (4 * n * n))) / (1 + {_Z}^2 / n)), 6) END AS low,
        CASE WHEN n = 0 THEN 1.0 ELSE round(least(1.0, ((p + {_Z}^2 / (2 * n)) + {_Z} * sqrt(p * (1 - p) / n + {_Z}^2 / (4 * n * n))) / (1 + {_Z}^2 / n)), 6) END AS high FROM p""")  # fmt: skip
def wilson(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count_if(F.col("value") > 250).alias("k"), F.count("*").alias("n"))
    cases = e.unionByName(spark.range(1).select(F.lit("none").alias("event_type"), F.lit(0).cast("long").alias("k"), F.lit(0).cast("long").alias("n")))
    n = F.col("n").cast("double")
    bounds = evaluation.wilson(F.try_divide(F.col("k"), n) * n, n)
    safe = F.when(F.col("n") == 0, F.struct(F.lit(0.0).alias("low"), F.lit(1.0).alias("high"))).otherwise(bounds)
    return cases.withColumn("b", safe).select("event_type", F.round("b.low", 6).alias("low"), F.round("b.high", 6).alias("high"))


@query("""WITH c AS (SELECT source, count(*) FILTER (n_chars > 1500) AS k, count(*) AS n FROM documents GROUP BY source),
    f AS (SELECT i, sum(CASE WHEN i > 0 THEN ln(i) ELSE 0 END) OVER (ORDER BY i) AS lf FROM range(100000) r(i) WHERE i <= (SELECT max(n) FROM c)),
    t AS (SELECT source, k, n, unnest(range(k, n + 1)) AS i FROM c)
    SELECT t.source, round(least(sum(exp(a.lf - b.lf - d.lf + t.i * ln(0.4) + (t.n - t.i) * ln(0.6))), 1.0), 6) AS p_value FROM t JOIN f a ON a.i = t.n JOIN f b ON b.i = t.i JOIN f d ON d.i = t.n - t.i GROUP BY t.source""")  # fmt: skip
def binomial_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = table(spark, sf_dir, "documents").groupBy("source").agg(F.count_if(F.col("n_chars") > 1500).alias("k"), F.count("*").alias("n")).withColumn("p0", F.lit(0.4))
    return evaluation.binomial_tail(cases, ["source"]).select("source", F.round("p_value", 6).alias("p_value"))


_P = evaluation.PRIME
_FIFTH = f"(((z * z % {_P}) * (z * z % {_P}) % {_P}) * z + x + b) % {_P} AS z"


@query(f"""WITH e AS (SELECT lang AS k, doc_id % {_P} AS x, n_chars::DOUBLE AS v, unnest(range(10000)) AS b FROM documents),
    h AS (SELECT k, x, v, b, (x * 1103515245 % {_P} + b * 742938285 % {_P}) % {_P} AS z FROM e), i AS (SELECT k, x, v, b, {_FIFTH} FROM h), j AS (SELECT k, v, b, {_FIFTH} FROM i),
    m AS (SELECT k, b, sum(w * v) / sum(w) AS m FROM (SELECT k, v, b, {" + ".join(f"(z >= {t})::INT" for t in evaluation.POISSON)} AS w FROM j) GROUP BY ALL),
    w AS (SELECT lang, round(avg(n_chars), 4) AS mean, count(*) AS n, min(n_chars) = max(n_chars) AS same FROM documents GROUP BY lang)
    SELECT lang, mean, n, CASE WHEN bool_and(same) THEN mean ELSE round(quantile_cont(m, 0.025), 4) END AS low, CASE WHEN bool_and(same) THEN mean ELSE round(quantile_cont(m, 0.975), 4) END AS high FROM m JOIN w ON w.lang IS NOT DISTINCT FROM m.k GROUP BY lang, mean, n""")  # fmt: skip
def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evaluation.bootstrap_mean(table(spark, sf_dir, "documents").select("lang", "doc_id", "n_chars"), ["lang"], "n_chars", "doc_id")
    return out.select("lang", F.round("mean", 4).alias("mean"), "n", F.round("low", 4).alias("low"), F.round("high", 4).alias("high"))


@query("""WITH d AS (SELECT event_type, floor(value / 10) - 12 AS d FROM events), n AS (SELECT event_type, count(*) AS n_values FROM d GROUP BY 1),
    t AS (SELECT event_type, abs(d) AS a, count(*) AS t, count(*) FILTER (d > 0) AS up FROM d WHERE d <> 0 GROUP BY ALL),
    r AS (SELECT *, coalesce(sum(t) OVER (PARTITION BY event_type ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (t + 1) / 2 AS r FROM t),
    s AS (SELECT event_type, sum(r * up)::DOUBLE AS w, sum(t)::DOUBLE AS n, sum(t::DOUBLE ** 3 - t) AS tt FROM r GROUP BY 1)
    SELECT event_type, n_values, w AS w_plus, round((w - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - tt / 48), 6) AS z FROM n JOIN s USING (event_type)""")  # fmt: skip
def signed_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_type", F.floor(F.col("value") / 10).cast("double").alias("v"))
    return evaluation.signed_rank(e, ["event_type"], "v", 12.0).withColumn("z", F.round("z", 6))


@query("SELECT lang, count(*) AS n, count(*) / sum(count(*)) OVER () AS share, max(count(*)) OVER () / sum(count(*)) OVER () AS majority FROM documents GROUP BY lang")
def class_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"))
    totals = counts.agg(F.sum("n").alias("t"), F.max("n").alias("m"))
    return counts.crossJoin(F.broadcast(totals)).select("lang", "n", (F.col("n") / F.col("t")).alias("share"), (F.col("m") / F.col("t")).alias("majority"))


@query("SELECT n_users, count(*) AS n FROM (SELECT o_custkey, count(DISTINCT o_orderstatus) AS n_users FROM orders GROUP BY 1) GROUP BY 1")
def distinct_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    inner = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.countDistinct("o_orderstatus").alias("n_users"))
    return inner.groupBy("n_users").agg(F.count("*").alias("n"))


@query("""SELECT quality, count(*) FILTER (s = 0) AS train, count(*) FILTER (s = 1) AS val, count(*) AS total, count(*) FILTER (s = 0) / count(*) AS train_ratio FROM (SELECT quality, doc_id % 2 AS s FROM labels) GROUP BY quality""")
def class_by_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").select("quality", F.when(F.col("doc_id") % 2 == 0, "train").otherwise("val").alias("split"))
    wide = rows.groupBy("quality").pivot("split", ["train", "val"]).count().na.fill(0)
    return wide.withColumn("total", F.col("train") + F.col("val")).withColumn("train_ratio", F.col("train") / F.col("total"))


@query("SELECT count(*) FILTER (doc_id IS NULL) AS doc_id, count(*) FILTER (quality IS NULL) AS quality, count(*) FILTER (toxic IS NULL) AS toxic FROM documents d LEFT JOIN labels l USING (doc_id)")
def null_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return evaluation.column_nulls(j)


@query("""SELECT event_type, count(value) AS n, round(avg(value), 4) AS mean, round(stddev_samp(value), 4) AS std, min(value) AS lo, round(quantile_cont(value, 0.5), 4) AS median, max(value) AS hi FROM events GROUP BY event_type""")
def column_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(
        F.count(v).alias("n"), F.round(F.avg(v), 4).alias("mean"), F.round(F.stddev_samp(v), 4).alias("std"), F.min(v).alias("lo"), F.round(F.percentile(v, F.lit(0.5)), 4).alias("median"), F.max(v).alias("hi")
    )


@query("""WITH w AS (SELECT doc_id, list_distinct(regexp_extract_all(text, '[A-Z][a-z]{5,}')) AS ids, text FROM documents), k AS (SELECT list(DISTINCT x) AS known FROM (SELECT unnest(regexp_extract_all(text, '[A-Z][a-z]{5,}')) AS x FROM benchmark))
    SELECT doc_id, len(ids)::INT AS cited, len(list_filter(ids, lambda x: list_contains(known, x)))::INT AS known_ids, len(ids) > 0 AND len(list_filter(ids, lambda x: NOT list_contains(known, x))) = 0 AS grounded FROM w, k""")  # fmt: skip
def citation_grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capitalised words of a document against those of the benchmark; the known ids are joined by key, not collected."""
    pattern = "[A-Z][a-z]{5,}"
    docs = table(spark, sf_dir, "documents").select("doc_id", text.all_matches(F.col("text"), pattern).alias("ids"))
    known = table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias("id")).distinct()
    found = docs.select("doc_id", F.explode("ids").alias("id")).join(known, "id", "left_semi").groupBy("doc_id").agg(F.count("*").cast("int").alias("known_ids"))
    joined = docs.join(found, "doc_id", "left").withColumn("known_ids", F.coalesce("known_ids", F.lit(0)))
    return joined.select("doc_id", F.size("ids").alias("cited"), "known_ids", ((F.size("ids") > 0) & (F.size("ids") == F.col("known_ids"))).alias("grounded"))


@query("""WITH t AS (SELECT conv_id, string_agg(text, ' ' ORDER BY turn) FILTER (role = 'assistant') AS summary, list_distinct(flatten(list(regexp_extract_all(text, '[a-zA-Z]{9,}')) FILTER (role = 'user'))) AS ids FROM conversations GROUP BY conv_id)
    SELECT conv_id, CASE WHEN coalesce(len(ids), 0) > 0 THEN round(len(list_filter(ids, lambda i: contains(coalesce(summary, ''), i))) / len(ids), 6) END AS retention FROM t""")  # fmt: skip
def token_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == "assistant", F.struct("turn", "text")))), lambda x: x["text"]), " ")
    ids = F.array_distinct(F.flatten(F.collect_list(F.when(F.col("role") == "user", F.regexp_extract_all("text", F.lit("[a-zA-Z]{9,}"), F.lit(0))))))
    g = c.groupBy("conv_id").agg(said.alias("summary"), ids.alias("ids"))
    kept = F.size(F.filter("ids", lambda i: F.contains(F.col("summary"), i)))
    return g.select("conv_id", F.round(F.try_divide(kept, F.nullif(F.size("ids"), F.lit(0))), 6).alias("retention"))


@query("""SELECT event_type, count(*) FILTER (l = 'supported') AS supported, count(*) FILTER (l = 'refuted') AS refuted, count(*) FILTER (l = 'unknown') AS unknown FROM
    (SELECT event_type, unnest(CASE (props->>'n')::INT % 3 WHEN 0 THEN ['supported', 'unknown'] WHEN 1 THEN ['refuted', 'odd'] ELSE ['supported'] END) AS l FROM events) GROUP BY event_type""")  # fmt: skip
def claims_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.from_json("props", "n int")["n"] % 3
    claims = F.when(m == 0, F.array(F.lit("supported"), F.lit("unknown"))).when(m == 1, F.array(F.lit("refuted"), F.lit("odd"))).otherwise(F.array(F.lit("supported")))
    rows = table(spark, sf_dir, "events").select("event_type", F.explode(claims).alias("l"))
    return rows.groupBy("event_type").pivot("l", ["supported", "refuted", "unknown"]).count().na.fill(0)


@query("""WITH h AS (SELECT (n_chars % 256)::INT AS bin, count(*) AS n FROM documents GROUP BY 1) SELECT bin, n, n / sum(n) OVER () AS pdf, sum(n) OVER (ORDER BY bin) / sum(n) OVER () AS cdf FROM h""")
def hist_cdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histograms.histogram_cdf(table(spark, sf_dir, "documents").select((F.col("n_chars") % 256).cast("int").alias("bin")), "bin")


@query("""WITH h AS (SELECT (n_chars % 256)::INT AS bin, count(*) AS n FROM documents GROUP BY 1), c AS (SELECT bin, sum(n) OVER (ORDER BY bin) / sum(n) OVER () AS cdf FROM h)
    SELECT doc_id, floor(cdf * 255)::INT AS equalized FROM documents JOIN c ON bin = n_chars % 256""")  # fmt: skip
def hist_equalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") % 256).cast("int").alias("bin"))
    return histograms.equalize(docs, "bin", histograms.histogram_cdf(docs, "bin")).select("doc_id", "equalized")


@query("SELECT event_type, round(avg(value), 4) AS mean, round(stddev_pop(value), 4) AS std, avg((value < 60)::INT) AS low_share, avg((value > 200)::INT) AS high_share FROM events GROUP BY event_type")
def masked_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = histograms.masked_stats(table(spark, sf_dir, "events"), ["event_type"], "value")
    return s.withColumns({"mean": F.round("mean", 4), "std": F.round("std", 4)})


@query("""WITH p AS (SELECT p_brand, p_size, p_retailprice / 20 AS y, p_size - p_size % 10 AS lo, p_size - p_size % 10 + 9 AS hi FROM part)
    SELECT p_brand, round(avg(abs((lo + hi) / 2 - y)), 6) AS mae, round(avg((y BETWEEN lo AND hi)::INT), 6) AS in_band, round(avg((greatest(0, lo - y) + greatest(0, y - hi)) ** 2), 6) AS hinge FROM p GROUP BY p_brand""")  # fmt: skip
def band_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    lo = F.col("p_size") - F.col("p_size") % 10
    p = table(spark, sf_dir, "part").select("p_brand", (F.col("p_retailprice") / 20).alias("y"), lo.alias("lo"), (lo + 9).alias("hi"))
    out = scores.band_distance(F.col("y"), F.col("lo"), F.col("hi"))
    return p.groupBy("p_brand").agg(
        F.round(F.avg(F.abs((F.col("lo") + F.col("hi")) / 2 - F.col("y"))), 6).alias("mae"), F.round(F.avg(F.col("y").between(F.col("lo"), F.col("hi")).cast("int")), 6).alias("in_band"),
        F.round(F.avg(out * out), 6).alias("hinge"),
    )


@query(f"""WITH {_J} SELECT 'quality' AS dimension, 'accuracy' AS metric, round(avg((quality = pred)::INT), 6) AS value FROM j UNION ALL SELECT 'toxic', 'rate', round(avg(toxic), 6) FROM j UNION ALL SELECT 'rows', 'n', count(*)::DOUBLE FROM j""")
def headline_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = _judged(spark, sf_dir)
    wide = j.agg(F.round(F.avg((F.col("quality") == F.col("pred")).cast("int")), 6).alias("a"), F.round(F.avg("toxic"), 6).alias("t"), F.count("*").cast("double").alias("n"))
    rows = [("quality", "accuracy", "a"), ("toxic", "rate", "t"), ("rows", "n", "n")]
    return wide.select(F.inline(F.array(*(F.struct(F.lit(d).alias("dimension"), F.lit(m).alias("metric"), F.col(c).alias("value")) for d, m, c in rows))))


@query("""WITH p AS (SELECT vec_id, label, embedding[1:5]::DOUBLE[] AS a, embedding[6:10]::DOUBLE[] AS b FROM embeddings), e AS (SELECT vec_id, label, list_transform(a, lambda x, i: (x + b[i]) / 2) AS m FROM p)
    SELECT vec_id, (list_position(m, list_max(m)) - 1)::INT AS top, round(exp(list_max(m)) / list_sum(list_transform(m, lambda x: exp(x))), 6) AS share, (label = 3)::INT AS hot FROM e""")  # fmt: skip
def ensemble_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    halves = [F.transform(F.slice("embedding", at, 5), lambda x: x.cast("double")) for at in (1, 6)]
    m = e.select("vec_id", "label", scores.ensemble(*halves).alias("m"))
    return m.select("vec_id", scores.argmax(F.col("m")).alias("top"), F.round(F.array_max(scores.softmax(F.col("m"))), 6).alias("share"), F.element_at(scores.one_hot(F.col("label"), 10), 4).alias("hot"))


@query("SELECT lang, source, count(*) AS n, count(DISTINCT n_chars) AS sizes FROM documents GROUP BY ALL")
def sample_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"), F.countDistinct("n_chars").alias("sizes"))
