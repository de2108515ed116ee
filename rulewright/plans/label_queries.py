"""Label preparation: consensus, ranks, splits, reshaping, quality filters, joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulewright.functions import scores, text
from rulewright.operators import labels, splits
from rulewright.plans.registry import query, table

_EV = "ev AS (SELECT user_id, event_id, ts, floor(value / 50)::INT AS label FROM events)"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("user_id", "event_id", "ts", F.floor(F.col("value") / 50).cast("int").alias("label"))


@query(f"WITH {_EV}, c AS (SELECT user_id, label, count(*) AS n FROM ev GROUP BY ALL) SELECT user_id, label FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, label) AS rn FROM c) WHERE rn = 1")
def consensus_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.consensus(_events(spark, sf_dir), "user_id", "label", "mode")


@query(f"WITH {_EV} SELECT user_id, least(greatest(floor(least(greatest(round_even(median(label), 0), 0), 9) / 2), 0), 4)::INT AS label FROM ev GROUP BY user_id")
def consensus_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.consensus(_events(spark, sf_dir), "user_id", "label", "median")


@query(f"WITH {_EV} SELECT user_id, max(label) AS label FROM ev GROUP BY user_id")
def consensus_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.consensus(_events(spark, sf_dir), "user_id", "label", "max")


@query(f"WITH {_EV} SELECT user_id, arg_min(label, event_id) AS label FROM ev GROUP BY user_id")
def consensus_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.consensus(_events(spark, sf_dir), "user_id", "label", "first", "event_id")


@query(f"WITH {_EV}, f AS (SELECT label, count(*) AS freq FROM ev GROUP BY label), u AS (SELECT user_id, label, min(event_id) AS pos FROM ev GROUP BY ALL) SELECT user_id, arg_min(label, (freq, pos)) AS label FROM u JOIN f USING (label) GROUP BY user_id")
def consensus_rare(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.consensus(_events(spark, sf_dir), "user_id", "label", "rare", "event_id")


@query(f"WITH {_EV} SELECT user_id, round_even(avg(label), 0)::INT AS mean_label, count(label) AS n_labels, count(DISTINCT label) > 1 AS disagrees, count(label) <> 4 AS incomplete FROM ev GROUP BY user_id")
def consensus_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.label_disagreement(_events(spark, sf_dir), "user_id", "label")


@query("""WITH r AS (SELECT doc_id, n_chars, row_number() OVER (ORDER BY n_chars, doc_id) AS rn, count(*) OVER () AS n FROM documents)
    SELECT doc_id, least(floor((rn - 1) * 10 / n), 9)::INT AS rank_class FROM r""")  # fmt: skip
def rank_deciles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.rank_classes(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "n_chars", "doc_id").select("doc_id", "rank_class")


@query("""WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 17 <> 0 THEN c_acctbal END AS v FROM customer), r AS (SELECT c_custkey, row_number() OVER (ORDER BY v DESC, c_custkey) AS rn, count(*) OVER () AS n FROM c WHERE v IS NOT NULL)
    SELECT c_custkey, least(floor((rn - 1) * 7 / n), 6)::INT AS rank_class FROM r UNION ALL SELECT c_custkey, -1 FROM c WHERE v IS NULL""")  # fmt: skip
def rank_reverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 17 != 0, F.col("c_acctbal")).alias("v"))
    return labels.rank_classes(c, "v", "c_custkey", 7, reverse=True).select("c_custkey", "rank_class")


def _md5(seed: int, *ids: str) -> str:
    return f"('0x' || substr(md5(concat_ws('|', '{seed}', {', '.join(ids)})), 1, 7))::BIGINT"


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    return docs.join(table(spark, sf_dir, "labels"), "doc_id")


_LABELLED = "j AS (SELECT doc_id, lang, source, quality, toxic FROM documents JOIN labels USING (doc_id))"


def _stratified(parts: str) -> str:
    return f"""WITH {_LABELLED}, r AS (SELECT *, row_number() OVER (PARTITION BY {parts} ORDER BY {_md5(42, "doc_id")}, doc_id) AS rn, count(*) OVER (PARTITION BY {parts}) AS n FROM j)
    SELECT doc_id, CASE WHEN n < 2 THEN 'train' WHEN rn <= round(n * 0.1) THEN 'test' WHEN rn <= round(n * 0.1) + round(n * 0.1) THEN 'val' ELSE 'train' END AS split FROM r"""


@query(_stratified("quality"))
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.stratified(_labelled(spark, sf_dir), ["quality"], "doc_id").select("doc_id", "split")


@query(_stratified("source, toxic"))
def dataset_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.stratified(_labelled(spark, sf_dir), ["source", "toxic"], "doc_id").select("doc_id", "split")


@query(f"""WITH {_LABELLED}, c AS (SELECT source, toxic, count(*) AS n FROM j GROUP BY ALL),
    w AS (SELECT *, CASE WHEN n > 1 THEN n ELSE 0 END AS s FROM c), e AS (SELECT *, ceil(sum(s) OVER () * 0.2::DOUBLE)::BIGINT AS want, s * want / sum(s) OVER () AS x FROM w),
    h AS (SELECT *, floor(x) + (row_number() OVER (ORDER BY round(x - floor(x), 9) DESC, source, toxic) <= want - sum(floor(x)) OVER ())::INT AS held FROM e),
    w2 AS (SELECT source, toxic, n, held, CASE WHEN held > 1 THEN held ELSE 0 END AS s FROM h), e2 AS (SELECT *, ceil(sum(s) OVER () * 0.5::DOUBLE)::BIGINT AS want, s * want / sum(s) OVER () AS x FROM w2),
    q AS (SELECT *, floor(x) + (row_number() OVER (ORDER BY round(x - floor(x), 9) DESC, source, toxic) <= want - sum(floor(x)) OVER ())::INT AS test FROM e2),
    r AS (SELECT *, row_number() OVER (PARTITION BY source, toxic ORDER BY {_md5(42, "doc_id")}, doc_id) AS rn FROM j)
    SELECT doc_id, CASE WHEN n < 2 OR rn > held THEN 'train' WHEN held > 1 AND rn <= test THEN 'test' ELSE 'val' END AS split FROM r JOIN q USING (source, toxic)""")  # fmt: skip
def stratified_second_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.stratified_twice(_labelled(spark, sf_dir), ["source", "toxic"], "doc_id").select("doc_id", "split")


@query(f"""WITH g AS (SELECT user_id, count(*) AS n, {_md5(42, "user_id")} AS h FROM events GROUP BY user_id),
    u AS (SELECT user_id, coalesce(sum(n) OVER (ORDER BY h, user_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(n) OVER () AS rows FROM g)
    SELECT user_id, event_id, CASE WHEN before < rows * 0.1::DOUBLE THEN 'test' WHEN before < rows * (0.1::DOUBLE + 0.9::DOUBLE * 0.1::DOUBLE) THEN 'val' ELSE 'train' END AS split FROM events JOIN u USING (user_id)""")  # fmt: skip
def group_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.grouped(table(spark, sf_dir, "events"), "user_id").select("user_id", "event_id", "split")


@query(f"WITH {_LABELLED} SELECT doc_id, ((row_number() OVER (PARTITION BY quality ORDER BY {_md5(42, 'doc_id')}, doc_id) - 1) % 5)::INT AS fold FROM j")
def kfold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.k_fold(_labelled(spark, sf_dir), "quality", "doc_id").select("doc_id", "fold")


@query(f"""WITH {_LABELLED}, r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY {_md5(7, "doc_id")}, doc_id) AS rn, count(*) OVER (PARTITION BY source) AS n FROM j)
    SELECT source, doc_id FROM r WHERE n > 1 AND rn <= round(n * 0.2)""")  # fmt: skip
def sub_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.sub_sample(_labelled(spark, sf_dir), "source", "doc_id", seed=7).select("source", "doc_id")


@query("WITH e AS (SELECT user_id, CASE event_id % 97 WHEN 0 THEN 'val' WHEN 1 THEN 'test' ELSE 'train' END AS split FROM events) SELECT user_id, count(DISTINCT split) AS n_splits FROM e GROUP BY user_id HAVING count(DISTINCT split) > 1")
def leakage_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("event_id") % 97
    e = table(spark, sf_dir, "events").select("user_id", F.when(m == 0, "val").when(m == 1, "test").otherwise("train").alias("split"))
    return splits.leaks(e, "user_id")


@query("SELECT count(*) AS n FROM events WHERE false")
def group_split_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users of the grouped split in more than one part: none."""
    return splits.leaks(group_split(spark, sf_dir), "user_id").agg(F.count("*").alias("n"))


@query("""WITH u AS (SELECT DISTINCT o_custkey AS c_custkey, CASE WHEN o_custkey % 10 = 0 THEN 'val' ELSE 'train' END AS split FROM orders)
    SELECT c_nationkey, split, count(*) AS n FROM customer LEFT JOIN u USING (c_custkey) GROUP BY ALL""")  # fmt: skip
def split_propagate(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("split", F.when(F.col("c_custkey") % 10 == 0, "val").otherwise("train"))
    rows = splits.propagate(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), users, "c_custkey")
    return rows.groupBy("c_nationkey", "split").agg(F.count("*").alias("n"))


@query("""SELECT CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'train' WHEN doc_id IN (SELECT vec_id FROM embeddings) THEN 'val' END AS split, count(*) AS n FROM documents GROUP BY 1""")
def split_by_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    val = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"))
    routed = splits.route_by_listing(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", table(spark, sf_dir, "labels"), val)
    return routed.groupBy("split").agg(F.count("*").alias("n"))


@query(f"SELECT doc_id FROM documents ORDER BY {_md5(3, 'doc_id')}, doc_id LIMIT 50")
def sample_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.sample_rows(table(spark, sf_dir, "documents").select("doc_id"), 50, "doc_id", 3)


@query("SELECT source, chunk, count(*) AS n, min(doc_id) AS first_id FROM (SELECT source, doc_id, floor((row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) / 16)::BIGINT AS chunk FROM documents) GROUP BY ALL")
def chunk_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = splits.chunked(table(spark, sf_dir, "documents").select("source", "doc_id"), ["source"], "doc_id", 16)
    return cut.groupBy("source", "chunk").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))


@query(f"""SELECT n_nationkey, coalesce(arg_min(s_suppkey, ({_md5(42, "s_suppkey")}, s_suppkey)), -1) AS picked FROM nation LEFT JOIN (SELECT * FROM supplier WHERE s_acctbal > 5000) ON s_nationkey = n_nationkey GROUP BY n_nationkey""")
def pick_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = table(spark, sf_dir, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("n_nationkey"), "s_suppkey")
    return splits.pick_one(table(spark, sf_dir, "nation").select("n_nationkey"), members, "n_nationkey", "s_suppkey")


@query("""SELECT doc_id, side, label FROM (SELECT doc_id, 'quality' AS side, CASE WHEN doc_id % 5 = 0 THEN 6 ELSE quality END AS label FROM labels UNION ALL SELECT doc_id, 'toxic', CASE WHEN doc_id % 7 = 0 THEN -1 ELSE toxic END FROM labels) WHERE label NOT IN (6, -1)""")
def unpivot_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = table(spark, sf_dir, "labels").select(
        "doc_id", F.when(F.col("doc_id") % 5 == 0, 6).otherwise(F.col("quality")).alias("left"), F.when(F.col("doc_id") % 7 == 0, -1).otherwise(F.col("toxic")).alias("right")
    )
    return labels.unpivot_structs(wide, ["doc_id"], {"quality": {"label": "left"}, "toxic": {"label": "right"}}, ~F.col("label").isin(6, -1) & F.col("label").isNotNull())


@query("""SELECT conv_id, max(text) FILTER (role = 'system') AS system, max(text) FILTER (role = 'user') AS user, max(text) FILTER (role = 'assistant') AS assistant FROM
    (SELECT conv_id, role, arg_min(text, turn) AS text FROM conversations GROUP BY ALL) GROUP BY conv_id""")  # fmt: skip
def pivot_sectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = table(spark, sf_dir, "conversations").groupBy("conv_id", "role").agg(F.min_by("text", "turn").alias("text"))
    return labels.pivot_sectors(first, ["conv_id"], "role", ["system", "user", "assistant"], "text")


@query("""WITH l AS (SELECT 'img' || o_orderkey || '_L' AS path, o_totalprice AS v FROM orders WHERE o_orderkey % 3 <> 0), r AS (SELECT 'img' || o_orderkey || '_R' AS path, o_custkey AS v FROM orders WHERE o_orderkey % 4 <> 0)
    SELECT coalesce(regexp_replace(l.path, '_[LR]$', '_LR'), regexp_replace(r.path, '_[LR]$', '_LR')) AS pair_key, l.v AS left_v, r.v AS right_v FROM l FULL JOIN r ON regexp_replace(l.path, '_[LR]$', '_LR') = regexp_replace(r.path, '_[LR]$', '_LR')""")  # fmt: skip
def pair_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    left = o.where("o_orderkey % 3 != 0").select(F.concat(F.lit("img"), "o_orderkey", F.lit("_L")).alias("path"), F.col("o_totalprice").alias("v"))
    right = o.where("o_orderkey % 4 != 0").select(F.concat(F.lit("img"), "o_orderkey", F.lit("_R")).alias("path"), F.col("o_custkey").alias("v"))
    return labels.pair_views(left, right, "path", "_[LR]$", "_LR").select("pair_key", "left_v", "right_v")


@query("SELECT event_id, (props->>'n')::BIGINT AS n, round(value, 4) AS value FROM events")
def struct_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    nested = table(spark, sf_dir, "events").select("event_id", F.struct(F.from_json("props", "n long").alias("p"), "value").alias("r"))
    return nested.select("event_id", "r.p.n", F.round("r.value", 4).alias("value"))


@query("""SELECT doc_id FROM documents WHERE n_chars >= 384 INTERSECT SELECT doc_id FROM labels WHERE quality = 1 INTERSECT SELECT doc_id FROM documents
    WHERE (length(text) - length(replace(text, '$', '')) >= 20)::INT + (length(text) - length(replace(text, '#', '')) >= 20)::INT < 2""")  # fmt: skip
def quality_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    marks = F.transform(F.array(F.lit("$"), F.lit("#")), lambda c: (F.length("text") - F.length(F.replace(F.col("text"), c))).cast("double"))
    few = docs.where(scores.count_at_least(marks, 20.0) < 2)
    return labels.intersect_keys("doc_id", docs.where("n_chars >= 384"), table(spark, sf_dir, "labels").where("quality = 1"), few)


@query("""WITH a AS (SELECT doc_id, lang, source FROM documents), b AS (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'xx' ELSE lang END AS lang, n_chars FROM documents WHERE doc_id % 2 = 0)
    SELECT 'agree' AS side, count(*) AS n, sum(doc_id)::BIGINT AS ids FROM a JOIN b USING (doc_id) WHERE a.lang = b.lang UNION ALL SELECT 'differ', count(*), sum(doc_id)::BIGINT FROM a JOIN b USING (doc_id) WHERE a.lang <> b.lang""")  # fmt: skip
def consistency_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    a = docs.select("doc_id", "lang", "source")
    b = docs.where("doc_id % 2 = 0").select("doc_id", F.when(F.col("doc_id") % 11 == 0, "xx").otherwise(F.col("lang")).alias("lang"), "n_chars")
    agree, differ = labels.checked_merge(a, b, "doc_id", ["lang"])
    sides = agree.select(F.lit("agree").alias("side"), "doc_id").unionByName(differ.select(F.lit("differ").alias("side"), "doc_id"))
    return sides.groupBy("side").agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"))


@query("SELECT doc_id, CASE WHEN doc_id IN (SELECT page_id FROM pages) THEN doc_id::VARCHAR ELSE '' END AS path FROM documents")
def exists_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("path"))
    return labels.existing(docs, table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("path")), "path")


@query("""SELECT doc_id, coalesce(l.quality, v.label, -1)::INT AS label FROM documents LEFT JOIN labels l USING (doc_id) LEFT JOIN embeddings v ON v.vec_id = doc_id""")
def label_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.lit(-1).alias("label"))
    siblings = [table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label")), table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "label")]
    return labels.repair_from(docs, siblings, "doc_id", "label").select("doc_id", "label")


@query("SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) <> 4")
def incomplete_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.incomplete_groups(table(spark, sf_dir, "lineitem"), ["l_orderkey"])


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderdate, o_orderkey) AS rn FROM orders) WHERE rn = 1")
def keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.keep_first(table(spark, sf_dir, "orders"), ["o_custkey", "o_orderstatus"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey")


@query("""SELECT c_custkey, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'heavy' WHEN c_mktsegment = 'HOUSEHOLD' THEN 'home' ELSE 'other' END AS grp, lpad(c_custkey::VARCHAR, greatest(4, length(c_custkey::VARCHAR))::INT, '0') AS code,
    (floor(c_acctbal / 1000) - 1)::INT AS decade, regexp_extract(c_name, '[0-9]+')::INT AS number, CASE WHEN c_custkey % 5 = 0 THEN 6 WHEN c_nationkey % 2 = 1 THEN round_even((c_nationkey + 2) / 2, 0)::INT ELSE c_nationkey // 2 + 1 END AS two FROM customer""")  # fmt: skip
def label_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    groups = {"home": ["HOUSEHOLD"], "heavy": ["BUILDING", "MACHINERY"]}
    return c.select(
        "c_custkey", scores.normalise(F.col("c_mktsegment"), groups, "other").alias("grp"), text.pad_id(F.col("c_custkey").cast("string")).alias("code"),
        scores.decade_class(F.col("c_acctbal") / 100).alias("decade"), scores.first_integer(F.col("c_name")).alias("number"),
        scores.two_sided(F.when(F.col("c_custkey") % 5 != 0, F.col("c_nationkey")), F.lit(2)).alias("two"),
    )


@query("""SELECT c_custkey, o_orderkey, n_name, r_name FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 400000) ON o_custkey = c_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey""")
def label_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    big = table(spark, sf_dir, "orders").where("o_totalprice > 400000")
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    j = c.join(big, c["c_custkey"] == big["o_custkey"], "left").join(n, F.col("n_nationkey") == F.col("c_nationkey")).join(r, F.col("r_regionkey") == F.col("n_regionkey"))
    return j.select("c_custkey", "o_orderkey", "n_name", "r_name")


@query("SELECT c_custkey, count(o_orderkey) AS n FROM orders RIGHT JOIN customer ON o_custkey = c_custkey WHERE c_custkey NOT IN (SELECT doc_id FROM labels) AND c_custkey IN (SELECT doc_id FROM documents) GROUP BY c_custkey")
def semi_anti_right(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey")
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    ids = [table(spark, sf_dir, t).select(F.col("doc_id").alias("c_custkey")) for t in ("documents", "labels")]
    kept = c.join(ids[0], "c_custkey", "left_semi").join(ids[1], "c_custkey", "left_anti")
    return o.join(kept, "c_custkey", "right").groupBy("c_custkey").agg(F.count("o_orderkey").alias("n"))


@query("""SELECT id, kind, lang FROM (SELECT doc_id AS id, 'doc' AS kind, lang FROM documents UNION ALL SELECT page_id, 'page', NULL FROM pages)""")
def union_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.lit("doc").alias("kind"), "lang")
    return docs.unionByName(table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.lit("page").alias("kind")), allowMissingColumns=True)


@query("SELECT doc_id AS id FROM labels UNION SELECT vec_id FROM embeddings EXCEPT SELECT page_id FROM pages")
def union_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id")).union(table(spark, sf_dir, "embeddings").select("vec_id")).distinct()
    return a.subtract(table(spark, sf_dir, "pages").select("page_id"))
