"""Rules: text conditions compiled, matched, and reported on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulewright.functions import scores, text
from rulewright.operators import evaluation, rules, sides, similarity
from rulewright.plans.registry import query, table

#: A rule table: category, number, condition, code.
PART_RULES = [
    ("Brand#1", 1, "9점 이하", "A_0"), ("Brand#1", 2, "10-24점", "A_1"), ("Brand#1", 3, "20~39점", "A_2"), ("Brand#1", 4, "45점 이상", "A_3"),
    ("Brand#2", 1, "40-20점", "B_9"), ("Brand#2", 2, "15점 이하", "B_0"), ("Brand#2", 3, "16-50점", "B_1"),
    ("Brand#3", 1, "없음", "C_9"), ("Brand#3", 2, "30점 이상", "C_1"),
    ("Brand#4", 1, "1-50점", "D_1"), ("Brand#5", 1, "25-25점", "E_1"),
]
_RULES_SQL = "(VALUES " + ", ".join(str(r) for r in PART_RULES) + ") AS r(category, rule_no, condition, code)"
_BOUNDS_SQL = r"""bounds AS (
    SELECT *, CASE WHEN b1 <> '' THEN b1::DOUBLE WHEN m <> '' THEN 0.0 WHEN l <> '' THEN l::DOUBLE END AS lo,
        CASE WHEN b1 <> '' THEN b2::DOUBLE WHEN m <> '' THEN m::DOUBLE WHEN l <> '' THEN 100.0 END AS hi
    FROM (SELECT *, regexp_extract(condition, '(\d+)\s*[-~]\s*(\d+)\s*점', 1) AS b1, regexp_extract(condition, '(\d+)\s*[-~]\s*(\d+)\s*점', 2) AS b2,
        regexp_extract(condition, '(\d+)\s*점\s*이하', 1) AS m, regexp_extract(condition, '(\d+)\s*점\s*이상', 1) AS l FROM rules))"""
_PART_SQL = f"""WITH rules AS (SELECT * FROM {_RULES_SQL}), {_BOUNDS_SQL},
    subject AS (SELECT p_partkey, left(p_brand, 7) AS category, p_size::DOUBLE AS score FROM part),
    hit AS (SELECT s.p_partkey, s.category, s.score, b.rule_no, b.code, row_number() OVER (PARTITION BY s.p_partkey ORDER BY b.rule_no) AS rn
        FROM subject s JOIN bounds b ON s.category = b.category AND b.lo <= b.hi AND s.score BETWEEN b.lo AND b.hi)"""


def _part_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PART_RULES, "category string, rule_no int, condition string, code string")


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.substring("p_brand", 1, 7).alias("category"), F.col("p_size").cast("double").alias("score"))


@query(_PART_SQL + " SELECT p_partkey, category, score, rule_no, code FROM hit WHERE rn = 1")
def rule_match_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    matched = rules.match_ranges(_parts(spark, sf_dir), _part_rules(spark), ["p_partkey"], "category", "score")
    return matched.select("p_partkey", "category", "score", "rule_no", "code")


@query(_PART_SQL + " SELECT category, score, count(*) AS n FROM subject s WHERE category IN (SELECT category FROM rules) AND p_partkey NOT IN (SELECT p_partkey FROM hit) GROUP BY category, score")
def rule_gap_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    gaps = rules.gap_report(_parts(spark, sf_dir), _part_rules(spark), ["p_partkey"], "category", "score")
    return gaps.groupBy("category", "score").agg(F.count("*").alias("n"))


@query(_PART_SQL + """ SELECT code, count(*) AS n, count(*) / sum(count(*)) OVER () AS share, CASE WHEN code LIKE '%\\_0' ESCAPE '\\' THEN false ELSE true END AS needs
    FROM hit WHERE rn = 1 GROUP BY code""")  # fmt: skip
def rule_code_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = rule_match_first(spark, sf_dir).groupBy("code").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("code", "n", (F.col("n") / F.col("total")).alias("share"), scores.needs_treatment(F.col("code")).alias("needs"))


BILATERAL = [
    (1, "양쪽 값 40점 이상이면서\n한쪽 값 89점 이하"), (2, "양쪽 20점 이하"), (3, "한쪽이 90점 이상, 양쪽 10-95점"), (4, "10-20점"), (5, "한쪽 80~60점"),
]


@query("""WITH s AS (SELECT l_orderkey, l_linenumber, l_quantity * 2 AS l, l_discount * 1000 AS r FROM lineitem), m AS (
    SELECT l_orderkey, l_linenumber, 1 AS rule_no FROM s WHERE l BETWEEN 40 AND 100 AND r BETWEEN 40 AND 100 AND (l BETWEEN 0 AND 89 OR r BETWEEN 0 AND 89)
    UNION ALL SELECT l_orderkey, l_linenumber, 2 FROM s WHERE l BETWEEN 0 AND 20 AND r BETWEEN 0 AND 20
    UNION ALL SELECT l_orderkey, l_linenumber, 3 FROM s WHERE (l BETWEEN 90 AND 100 OR r BETWEEN 90 AND 100) AND l BETWEEN 10 AND 95 AND r BETWEEN 10 AND 95)
    SELECT rule_no, count(*) AS n, sum(l_orderkey)::BIGINT AS keys FROM (SELECT l_orderkey, l_linenumber, min(rule_no) AS rule_no FROM m GROUP BY ALL) GROUP BY rule_no""")  # fmt: skip
def rule_bilateral(spark: SparkSession, sf_dir: str) -> DataFrame:
    subject = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") * 2).alias("left"), (F.col("l_discount") * 1000).alias("right"))
    first = rules.first_bilateral(subject, spark.createDataFrame(BILATERAL, "rule_no int, condition string"), F.col("left"), F.col("right"))
    first = first.groupBy("l_orderkey", "l_linenumber").agg(F.min("rule_no").alias("rule_no"))  # the table repeats some keys
    return first.groupBy("rule_no").agg(F.count("*").alias("n"), F.sum("l_orderkey").alias("keys"))


TERMS = [
    (1, "무게 + 높이 + 0.5*폭·깊이 100-115점", "없음"), (2, "무게 + 2*높이 40점 이하", "길이 5점 이하"), (3, "길이 6-8점", ""), (4, "부피 20점 이하", "모름 3점 이하"),
    (5, "부피 20-24점", "길이 9~1점"), (6, "부피 25점 이상", "없음"),
]


@query("""WITH s AS (SELECT l_orderkey, l_linenumber, l_tax * 100 AS len, l_quantity AS weight, l_discount * 1000 AS height, l_extendedprice / 1000 AS width,
        CASE WHEN l_linenumber = 1 THEN NULL ELSE l_quantity END AS lv, CASE WHEN l_linenumber = 2 THEN NULL ELSE l_discount * 500 END AS rv FROM lineitem),
    v AS (SELECT *, coalesce((lv + rv) / 2, lv, rv) AS vol FROM s),
    m AS (SELECT *, CASE WHEN weight + height + 0.5 * width BETWEEN 100 AND 115 THEN 1 WHEN weight + 2 * height BETWEEN 0 AND 40 AND len BETWEEN 0 AND 5 THEN 2
        WHEN len BETWEEN 6 AND 8 THEN 3 WHEN vol BETWEEN 25 AND 100 THEN 6 END AS rule_no FROM v)
    SELECT rule_no, count(*) AS n, sum(l_orderkey)::BIGINT AS keys FROM (SELECT l_orderkey, l_linenumber, min(rule_no) AS rule_no FROM m WHERE rule_no IS NOT NULL GROUP BY ALL) GROUP BY rule_no""")  # fmt: skip
def rule_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    lv = F.when(F.col("l_linenumber") != 1, F.col("l_quantity"))
    rv = F.when(F.col("l_linenumber") != 2, F.col("l_discount") * 500)
    values = {
        "길이": F.col("l_tax") * 100, "무게": F.col("l_quantity"), "높이": F.col("l_discount") * 1000, "폭·깊이": F.col("l_extendedprice") / 1000, "부피": scores.left_or_mean(lv, rv),
    }
    table_ = spark.createDataFrame(TERMS, "rule_no int, c1 string, c2 string")
    first = rules.first_weighted(li, table_, ["c1", "c2"], values)
    first = first.groupBy("l_orderkey", "l_linenumber").agg(F.min("rule_no").alias("rule_no"))  # the table repeats some keys
    return first.groupBy("rule_no").agg(F.count("*").alias("n"), F.sum("l_orderkey").alias("keys"))


AGE_GROUPS = [(1, "29세 이하"), (2, "30-39세"), (3, "30세 이상"), (4, "35-36세"), (5, "60-90세"), (6, "전체")]


@query("""WITH g(ordinal, age_group, lo, hi) AS (VALUES (1, '29세 이하', 0, 29), (2, '30-39세', 30, 39), (3, '30세 이상', 30, 999), (4, '35-36세', 35, 36), (5, '60-90세', 60, 90), (6, '전체', 0, 999)),
    c AS (SELECT c_custkey, c_acctbal / 100 AS age FROM customer)
    SELECT c_custkey, age_group FROM (SELECT c_custkey, age_group, row_number() OVER (PARTITION BY c_custkey ORDER BY hi - lo, ordinal) AS rn
        FROM c JOIN g ON round_even(age, 0) BETWEEN lo AND hi) WHERE rn = 1""")  # fmt: skip
def narrowest_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_acctbal") / 100).alias("age"))
    groups = spark.createDataFrame(AGE_GROUPS, "ordinal int, age_group string")
    return rules.narrowest_group(people, groups, "age").select("c_custkey", "age_group")


@query("""WITH r(category, age_group, rule_no) AS (VALUES ('P', 'young', 1), ('P', 'old', 2), ('S', 'old', 1), ('S', 'old', 2)),
    s AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'P' THEN 'P' ELSE 'S' END AS category, CASE WHEN o_totalprice > 200000 THEN 'old' ELSE 'young' END AS age_group FROM orders),
    j AS (SELECT o_orderkey, rule_no, s.age_group = r.age_group AS same, bool_or(s.age_group = r.age_group) OVER (PARTITION BY o_orderkey) AS held FROM s JOIN r USING (category))
    SELECT rule_no, count(*) AS n FROM j WHERE same OR NOT held GROUP BY rule_no""")  # fmt: skip
def rule_group_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    table_ = spark.createDataFrame([("P", "young", 1), ("P", "old", 2), ("S", "old", 1), ("S", "old", 2)], "category string, age_group string, rule_no int")
    subject = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.when(F.col("o_orderstatus") == "P", "P").otherwise("S").alias("category"), F.when(F.col("o_totalprice") > 200000, "old").otherwise("young").alias("age_group")
    )
    return rules.with_group_fallback(subject, table_, ["o_orderkey"], "category", "age_group").groupBy("rule_no").agg(F.count("*").alias("n"))


@query("""WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
    subject AS (SELECT * FROM e WHERE vec_id % 20 = 0), item AS (SELECT * FROM e WHERE label <> 9),
    ruled AS (SELECT vec_id, label FROM subject WHERE label < 5),
    near AS (SELECT s.vec_id, i.vec_id AS item_id, row_number() OVER (PARTITION BY s.vec_id ORDER BY list_cosine_similarity(s.v, i.v) DESC, i.vec_id) AS rn
        FROM subject s JOIN item i ON i.label = s.label AND i.vec_id <> s.vec_id WHERE s.label >= 5)
    SELECT vec_id, -1 - label AS item_id, 'rule' AS matched_by FROM ruled UNION ALL SELECT vec_id, item_id, 'nearest' FROM near WHERE rn = 1
    UNION ALL SELECT vec_id, NULL, 'none' FROM subject WHERE label >= 5 AND vec_id NOT IN (SELECT vec_id FROM near)""")  # fmt: skip
def rule_or_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    subject = e.where("vec_id % 20 = 0").select("vec_id", "label", F.col("embedding").alias("q"))
    items = e.where("label != 9").select(F.col("vec_id").alias("item_id"), "label", F.col("embedding").alias("v"))  # a category without items
    table_ = spark.createDataFrame([(i, -1 - i) for i in range(5)], "label int, item_id long")
    matched = subject.join(sides.small(table_), "label").select("vec_id", "item_id")
    return similarity.matched_or_nearest(subject, matched, items, ["vec_id"], "label", others=True)


@query("""WITH l AS (SELECT l_orderkey, avg(l_quantity) AS m1, avg(l_discount) * 1000 AS m2, avg(l_tax) * 1000 AS m3 FROM lineitem GROUP BY 1),
    u AS (SELECT l_orderkey, 'quantity' AS region, round(m1, 2) AS score FROM l UNION ALL SELECT l_orderkey, 'discount', round(m2, 2) FROM l UNION ALL SELECT l_orderkey, 'tax', round(m3, 2) FROM l)
    SELECT l_orderkey, region, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY score, region)::INT AS rank FROM u) WHERE rank <= 2""")  # fmt: skip
def region_mean_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.round(F.avg("l_quantity"), 2).alias("quantity"), F.round(F.avg("l_discount") * 1000, 2).alias("discount"), F.round(F.avg("l_tax") * 1000, 2).alias("tax")
    )
    long = means.unpivot(["l_orderkey"], ["quantity", "discount", "tax"], "region", "score")
    return similarity.top_k(long, ["l_orderkey"], [F.col("score"), F.col("region")], 2)


@query("""SELECT s_nationkey, worst, worst_score, n_members, line FROM (SELECT s_nationkey, first(s_name ORDER BY s_acctbal, s_name) AS worst, min(s_acctbal) AS worst_score, count(*)::INT AS n_members,
    string_agg(s_name || ' ' || s_acctbal::VARCHAR, ', ' ORDER BY s_acctbal, s_name) AS line FROM supplier GROUP BY s_nationkey)""")  # fmt: skip
def group_minimum_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.group_minimum(table(spark, sf_dir, "supplier"), ["s_nationkey"], "s_acctbal", "s_name")


@query("""WITH s AS (SELECT o_custkey, o_orderkey, o_totalprice, o_orderstatus = 'F' AS treated, min(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END) OVER (PARTITION BY o_custkey) AS low FROM orders)
    SELECT o_custkey, o_orderkey, rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey)::INT AS rank FROM s WHERE NOT treated AND o_totalprice < low) WHERE rank <= 3""")  # fmt: skip
def severe_untreated(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice", (F.col("o_orderstatus") == "F").alias("treated"))
    return evaluation.below_treated(orders, ["o_custkey"], "o_totalprice", "treated", "o_orderkey").select("o_custkey", "o_orderkey", "rank")


@query("""SELECT p_partkey, CASE WHEN p_size <= 30 THEN 'severe' WHEN p_size <= 80 THEN 'moderate' ELSE 'mild' END AS severity,
    CASE WHEN lower(p_type) SIMILAR TO '.*(meta-analysis|systematic review).*' THEN 'A' WHEN lower(p_type) SIMILAR TO '.*(randomized|clinical trial|steel).*' THEN 'B' ELSE 'C' END AS grade FROM part""")  # fmt: skip
def severity_grade(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.regexp_replace(F.lower("p_type"), "steel", "clinical trial")
    return table(spark, sf_dir, "part").select("p_partkey", scores.severity(F.col("p_size")).alias("severity"), scores.evidence_grade(kind).alias("grade"))


@query("""WITH c AS (SELECT c_custkey AS rule_id, c_mktsegment AS age_group, 'K' || (c_nationkey % 5) AS code_a, CASE WHEN c_nationkey % 3 = 0 THEN '없음' ELSE 'K' || (c_nationkey % 7) END AS code_b FROM customer),
    l AS (SELECT rule_id, age_group, 'size' AS category, code_a AS code FROM c UNION ALL SELECT rule_id, age_group, 'nation', code_b FROM c WHERE code_b <> '없음'),
    r AS (SELECT DISTINCT seg AS age_group, 'K' || k AS code, seg || k AS target_id FROM (SELECT DISTINCT c_mktsegment AS seg FROM customer), range(4) t(k))
    SELECT category, count(*) AS n, sum(rule_id)::BIGINT AS ids FROM l JOIN r USING (age_group, code) GROUP BY category""")  # fmt: skip
def composite_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    wide = c.select(
        F.col("c_custkey").alias("rule_id"), F.col("c_mktsegment").alias("age_group"), F.concat(F.lit("K"), F.col("c_nationkey") % 5).alias("code_a"),
        F.when(F.col("c_nationkey") % 3 == 0, text.NONE_WORD).otherwise(F.concat(F.lit("K"), F.col("c_nationkey") % 7)).alias("code_b"),
    )
    segments = c.select(F.col("c_mktsegment").alias("age_group")).distinct().select("age_group", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k"))
    named = segments.select(F.concat("age_group", "k").alias("rule_id"), "age_group", F.concat(F.lit("K"), "k").alias("code"))
    target = named.withColumn("category", F.explode(F.array(F.lit("size"), F.lit("nation"))))
    edges = rules.edges_by_code(wide, target, {"code_a": "size", "code_b": "nation"})
    return edges.groupBy("category").agg(F.count("*").alias("n"), F.sum("source_id").alias("ids"))


BINS = [("discount", 0.0, 2.0, 1.0, 0.0), ("discount", 2.0, 6.0, 0.5, 1.0), ("discount", 6.0, 9.0, 2.0, -8.0), ("tax", 1.0, 4.0, -1.0, 4.0), ("tax", 4.0, 7.0, 3.0, 0.5)]


@query("""WITH b(axis, lo, hi, a, b) AS (VALUES ('discount', 0.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE, 0.0::DOUBLE), ('discount', 2.0, 6.0, 0.5, 1.0), ('discount', 6.0, 9.0, 2.0, -8.0), ('tax', 1.0, 4.0, -1.0, 4.0), ('tax', 4.0, 7.0, 3.0, 0.5)),
    x AS (SELECT l_orderkey, l_linenumber, 'discount' AS axis, round(l_discount * 100, 2) AS v FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, 'tax', round(l_tax * 100, 2) FROM lineitem),
    e AS (SELECT axis, min(lo) AS low, max(hi) AS top FROM b GROUP BY axis),
    c AS (SELECT l_orderkey, l_linenumber, axis, least(greatest(v, low), top) AS v, top FROM x JOIN e USING (axis)),
    f AS (SELECT c.l_orderkey, c.l_linenumber, sum(b.a * c.v + b.b) AS delta FROM c JOIN b ON c.axis = b.axis AND c.v >= b.lo AND (c.v < b.hi OR (c.v = c.top AND b.hi = c.top)) GROUP BY ALL)
    SELECT l_orderkey, l_linenumber, round(delta, 4) AS delta, round((1 - least(greatest((delta - -3.0) / 25.0, 0.0), 1.0)) * 10, 4) AS score FROM f""")  # fmt: skip
def piecewise_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(F.col("l_discount") * 100, 2).alias("discount"), F.round(F.col("l_tax") * 100, 2).alias("tax"))
    long = li.unpivot(["l_orderkey", "l_linenumber"], ["discount", "tax"], "axis", "v")
    bins = spark.createDataFrame(BINS, "axis string, lo double, hi double, a double, b double")
    delta = rules.piecewise(long, bins, ["axis"], "v").groupBy("l_orderkey", "l_linenumber").agg(F.sum("fitted").alias("delta"))
    score = scores.robust_score(F.col("delta"), F.lit(-3.0), F.lit(22.0), True)
    return delta.select("l_orderkey", "l_linenumber", F.round("delta", 4).alias("delta"), F.round(score, 4).alias("score"))
