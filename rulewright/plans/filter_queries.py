"""Row filters, nested reshapes, small value functions, and file round trips."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulewright.functions import scores, text
from rulewright.operators import evaluation, filters, labels, rules, splits
from rulewright.plans.registry import query, table
from rulewright.sources import readers, sinks
from rulewright.storage import Workspace


@query("SELECT p_partkey, p_size FROM part WHERE p_size >= 10 AND p_size < 40")
def half_open_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").where(filters.half_open(F.col("p_size"), 10, 40)).select("p_partkey", "p_size")


@query("SELECT p_partkey FROM part WHERE p_partkey % 10 = 0 OR (p_size * 20 >= 384 AND p_retailprice >= 384)")
def nested_size_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.struct((F.col("p_size") * 20).alias("width"), F.col("p_retailprice").alias("height")).alias("size")
    split = F.when(F.col("p_partkey") % 10 == 0, "test").otherwise("train").alias("split")
    nested = table(spark, sf_dir, "part").select("p_partkey", size, split)
    return nested.where(filters.large_enough(F.col("size"), 384, F.col("split"))).select("p_partkey")


_GAPS = "c AS (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_nationkey END AS a, CASE WHEN c_custkey % 3 = 0 THEN c_nationkey + 1 END AS b FROM customer)"


def _gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (F.when(F.col("c_custkey") % k == 0, F.col("c_nationkey") + k - 2).alias(n) for k, n in ((2, "a"), (3, "b")))
    return table(spark, sf_dir, "customer").select("c_custkey", a, b)


@query(f"WITH {_GAPS} SELECT * FROM c WHERE a IS NOT NULL OR b IS NOT NULL")
def drop_all_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.drop_all_null(_gaps(spark, sf_dir), ["a", "b"])


@query(f"WITH {_GAPS} SELECT * FROM c WHERE a IS NOT NULL AND b IS NOT NULL")
def drop_any_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.drop_any_null(_gaps(spark, sf_dir))


@query(f"WITH {_GAPS}, f AS (SELECT c_custkey, coalesce(a, -1)::INT AS a, coalesce(b, -1)::INT AS b FROM c) SELECT * FROM f WHERE a <> -1 OR b <> -1")
def any_label_given(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing labels as -1 in whole numbers, then rows that have any."""
    filled = _gaps(spark, sf_dir).na.fill(-1, ["a", "b"]).select("c_custkey", *(F.col(c).cast("int").alias(c) for c in ("a", "b")))
    return filled.where(filters.any_given(["a", "b"]))


@query("""WITH d AS (SELECT doc_id, (length(text) - length(replace(text, '#', '')) >= 3)::INT + (length(text) - length(replace(text, '$', '')) >= 3)::INT + (n_chars > 3000)::INT AS flags, (20 + doc_id % 50)::VARCHAR || 's' AS age FROM documents)
    SELECT doc_id, flags FROM d WHERE flags < 1 OR regexp_extract(age, '[0-9]+')::INT > 40""")  # fmt: skip
def quality_or_age(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Few quality flags, or an age above 40 that is given as text."""
    flags = sum((((F.length("text") - F.length(F.replace(F.col("text"), F.lit(c)))) >= 3).cast("int") for c in "#$"), (F.col("n_chars") > 3000).cast("int"))
    docs = table(spark, sf_dir, "documents").select("doc_id", flags.alias("flags"), F.concat((20 + F.col("doc_id") % 50).cast("string"), F.lit("s")).alias("age"))
    return docs.where(filters.few_or_older(F.col("flags"), 1, F.col("age"))).select("doc_id", "flags")


@query("SELECT 'nation' AS asked, c_custkey FROM customer WHERE c_nationkey = 7 UNION ALL SELECT 'both', c_custkey FROM customer WHERE c_nationkey = 7 AND c_mktsegment = 'BUILDING' UNION ALL SELECT 'none', c_custkey FROM customer")
def optional_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    asked = {"nation": (7, None), "both": (7, "BUILDING"), "none": (None, None)}
    parts = [c.where(filters.given_equal(c_nationkey=n, c_mktsegment=s)).select(F.lit(name).alias("asked"), "c_custkey") for name, (n, s) in asked.items()]
    return parts[0].union(parts[1]).union(parts[2])


@query("SELECT c_custkey, count(o_orderkey)::INT AS n, coalesce(string_agg(o_orderpriority, ',' ORDER BY o_orderkey), '') AS names FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def nested_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested items to their number and joined names."""
    item = F.struct("o_orderkey", F.col("o_orderpriority").alias("name"))
    nested = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.array_sort(F.collect_list(item)).alias("items"))
    joined = table(spark, sf_dir, "customer").select("c_custkey").join(nested, "c_custkey", "left")
    return joined.select("c_custkey", filters.counted_names(F.col("items")).alias("s")).select("c_custkey", "s.*")


@query("""WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'img' || o_orderkey || '.jpg' END AS l, CASE WHEN o_orderkey % 3 = 0 THEN 'img' || (o_orderkey + o_orderkey % 5 % 2) || '.jpg' END AS r FROM orders)
    SELECT o_orderkey, l AS path FROM o WHERE l IS NOT NULL UNION SELECT o_orderkey, r FROM o WHERE r IS NOT NULL""")  # fmt: skip
def path_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Side images back to their source images; both sides of one source give it once."""
    key = F.col("o_orderkey")
    left = F.when(key % 2 == 0, F.concat(F.lit("img"), key, F.lit("_l.jpg"))).alias("l")
    right = F.when(key % 3 == 0, F.concat(F.lit("img"), key + key % 5 % 2, F.lit("_r.jpg"))).alias("r")
    sides = table(spark, sf_dir, "orders").select("o_orderkey", left, right)
    return filters.expand_paths(sides, ["l", "r"], r"_[lr]\.jpg$", ".jpg").select("o_orderkey", "path")


@query("SELECT source, count(*) AS n, sum(n_chars)::BIGINT AS chars, split FROM (SELECT source, n_chars, CASE WHEN doc_id % 4 = 0 THEN 'val' ELSE 'train' END AS split FROM documents) WHERE split = 'val' GROUP BY ALL")
def manifest_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One split of every dataset, from the directories of a manifest."""
    ws = Workspace(spark, "manifest")
    docs = table(spark, sf_dir, "documents").select("source", "n_chars", F.when(F.col("doc_id") % 4 == 0, "val").otherwise("train").alias("split"))
    sinks.write_splits(docs.select("n_chars", F.col("source").alias("dataset"), "split"), ws.path("data"))
    manifest = docs.where("split = 'val'").select(F.col("source").alias("dataset")).distinct()
    found = readers.read_manifest_table(spark, ws.path("data"), manifest, "val", "n_chars long")
    return found.groupBy(F.col("dataset").alias("source"), "split").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("SELECT source, lang, 1::BIGINT AS files, true AS filled FROM (SELECT DISTINCT source, lang FROM documents)")
def file_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files below a folder by extension, with their sizes; the names are read, the contents are not."""
    ws = Workspace(spark, "listing")
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("dataset"), F.col("lang").alias("split"), "doc_id")
    sinks.write_splits(docs, ws.path("data"))
    listed = readers.list_files(spark, ws.path("data"), "*.json").withColumns({"source": F.regexp_extract("path", "dataset=([^/]+)", 1), "lang": F.regexp_extract("path", "split=([^/]+)", 1)})
    return listed.groupBy("source", "lang").agg(F.count("*").alias("files"), (F.min("length") > 0).alias("filled"))


@query("""SELECT s_name AS id, round(s_acctbal, 2)::VARCHAR AS balance, CASE WHEN s_nationkey % 2 = 0 THEN 'n' || s_nationkey ELSE 'early' END AS nation FROM supplier""")
def entity_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many files of nested JSON to one row per entity; the later file wins."""
    ws = Workspace(spark, "entities")
    s = table(spark, sf_dir, "supplier").select("s_name", "s_nationkey", F.round("s_acctbal", 2).cast("string").alias("balance"))
    first = s.select(F.lit(0).alias("run"), F.col("s_name").alias("id"), F.create_map(F.lit("balance"), "balance", F.lit("nation"), F.lit("early")).alias("fields"))
    later = s.where("s_nationkey % 2 = 0").select(F.lit(1).alias("run"), F.col("s_name").alias("id"), F.create_map(F.lit("nation"), F.concat(F.lit("n"), "s_nationkey")).alias("fields"))
    sinks.write_entity_files(first.unionByName(later), ws.path("files"), 50)
    return readers.read_entity_files(spark, ws.path("files"), ["balance", "nation"])


@query("SELECT doc_id, 'data/v0.3/val/' || lang || '/' || doc_id || '.json' AS path FROM documents")
def path_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("data/v0.2/train/"), "lang", F.lit("/"), "doc_id", F.lit(".json"))
    return table(spark, sf_dir, "documents").select("doc_id", sinks.rewrite_path(path, {"v0.2": "v0.3", "/train/": "/val/"}).alias("path"))


@query(r"""SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN coalesce(text, '') WHEN 1 THEN role || chr(10) || conv_id WHEN 2 THEN '' ELSE '[not a list' END AS said FROM conversations""")
def content_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text of plain strings, lists of blocks, nulls, and what only looks like a list."""
    blocks = F.to_json(F.array(F.struct(F.lit("text").alias("type"), F.col("role").alias("text")), F.struct(F.lit("text").alias("type"), F.col("conv_id").cast("string").alias("text"))))
    turn = F.col("turn") % 4
    content = F.when(turn == 0, F.col("text")).when(turn == 1, blocks).when(turn == 3, "[not a list")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.block_text(content).alias("said"))


@query("""SELECT p_partkey, (p_size - 5)::INT AS xmin, (p_size + 1)::INT AS ymin, (p_size + 45)::INT AS xmax, (2 * p_size - 9)::INT AS ymax,
    CASE WHEN p_retailprice < 950 THEN '***' WHEN p_retailprice < 1000 THEN '**' WHEN p_retailprice < 1100 THEN '*' ELSE 'ns' END AS stars,
    CASE p_brand WHEN 'Brand#11' THEN 0 WHEN 'Brand#12' THEN 1 ELSE -1 END AS brand_no, (p_brand = 'Brand#11')::INT::DOUBLE AS is_first, p_name AS name FROM part""")  # fmt: skip
def value_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Box re-basing, significance stars, lookup with a default, indicator weights, byte literals."""
    size = F.col("p_size")
    box = F.struct(size.alias("xmin"), (size + 10).alias("ymin"), (size + 50).alias("xmax"), (size * 2).alias("ymax"))
    origin = F.struct(F.lit(5).alias("xmin"), F.lit(9).alias("ymin"), F.lit(100).alias("xmax"), F.lit(100).alias("ymax"))
    p = F.when(F.col("p_retailprice") < 950, 0.0001).when(F.col("p_retailprice") < 1000, 0.005).when(F.col("p_retailprice") < 1100, 0.02).otherwise(0.2)
    return table(spark, sf_dir, "part").select(
        "p_partkey", scores.rebase(box, origin).alias("box"), scores.stars(p).alias("stars"), scores.lookup(F.col("p_brand"), {"Brand#11": 0, "Brand#12": 1}).alias("brand_no"),
        scores.indicator(F.col("p_brand"), "Brand#11").alias("is_first"), text.byte_literal(F.concat(F.lit("b'"), "p_name", F.lit("'"))).alias("name"),
    ).select("p_partkey", "box.*", "stars", "brand_no", "is_first", "name")


@query("""WITH s AS (SELECT s_nationkey, s_name, round(s_acctbal, 0) AS b FROM supplier), r AS (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY b, s_name) AS rn FROM s)
    SELECT s_nationkey, string_agg(s_name || ' ' || b::BIGINT || '.0', ', ' ORDER BY rn) AS line, string_agg(s_name, ',' ORDER BY rn) FILTER (rn <= 3) AS worst FROM r GROUP BY s_nationkey""")  # fmt: skip
def score_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored items as one line, and the three lowest."""
    items = table(spark, sf_dir, "supplier").select("s_nationkey", "s_name", F.round("s_acctbal", 0).alias("score"))
    lines = evaluation.member_lines(items, ["s_nationkey"], "score", "s_name", text.scored(F.col("s_name"), F.col("score")))
    worst = evaluation.worst_members(items, ["s_nationkey"], "score", "s_name", 3)
    return lines.join(worst, "s_nationkey").select("s_nationkey", "line", F.array_join("worst", ",").alias("worst"))


@query("""SELECT c_custkey, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'heavy' WHEN c_mktsegment = 'HOUSEHOLD' THEN 'home' END AS value,
    CASE WHEN c_mktsegment NOT IN ('BUILDING', 'MACHINERY', 'HOUSEHOLD') THEN 'unknown: ' || c_mktsegment END AS error FROM customer""")  # fmt: skip
def static_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many keys to few values; an unknown key becomes an error row."""
    found = filters.lookup_or_error(F.col("c_mktsegment"), {"BUILDING": "heavy", "MACHINERY": "heavy", "HOUSEHOLD": "home"})
    return table(spark, sf_dir, "customer").select("c_custkey", found.alias("f")).select("c_custkey", "f.*")


@query("""SELECT epoch, doc_id, (row_number() OVER (PARTITION BY epoch, lang ORDER BY ('0x' || substr(md5(concat_ws('|', '42', epoch, doc_id)), 1, 7))::BIGINT, doc_id))::INT AS place FROM documents, (VALUES ('0'), ('1')) e(epoch)""")
def epoch_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A new order of each language's documents in every epoch, the same on every run."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    orders = [splits.shuffled(docs, ["lang"], "doc_id", 42, e).withColumn("epoch", F.lit(str(e))) for e in (0, 1)]
    return orders[0].union(orders[1]).select("epoch", "doc_id", (F.col("position") + 1).cast("int").alias("place"))


@query("""WITH r AS (SELECT lang, doc_id, (row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1) // 100 AS block FROM documents)
    SELECT doc_id, block * 100 + row_number() OVER (PARTITION BY lang, block ORDER BY ('0x' || substr(md5(concat_ws('|', '42', '1', doc_id)), 1, 7))::BIGINT, doc_id) - 1 AS position FROM r""")  # fmt: skip
def buffer_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's documents as a stream that is shuffled through a buffer of 100."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return splits.buffered_shuffle(docs, ["lang"], "doc_id", "doc_id", 100, 42, 1).select("doc_id", "position")


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity BETWEEN 10 AND 20 THEN 1 WHEN l_tax * 100 BETWEEN 0 AND 3 THEN 2 WHEN l_quantity BETWEEN 45 AND 100 THEN 3 END AS rule_no FROM lineitem
    WHERE l_quantity BETWEEN 10 AND 20 OR l_tax * 100 BETWEEN 0 AND 3 OR l_quantity BETWEEN 45 AND 100""")  # fmt: skip
def rule_prefixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules of one named variable and its range."""
    names = {"무게": F.col("l_quantity"), "길이": F.col("l_tax") * 100}
    table_ = spark.createDataFrame([(1, "무게 10-20점"), (2, "길이 3점 이하"), (3, "무게 45점 이상"), (4, "높이 10점 이상")], "rule_no int, c1 string")
    return rules.first_weighted(table(spark, sf_dir, "lineitem"), table_, ["c1"], names).select("l_orderkey", "l_linenumber", "rule_no")


_SIDES = "(VALUES ('tilt', 0.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE, 0.0::DOUBLE, 1.0::DOUBLE), ('tilt', 2.0, 6.0, 0.5, 1.0, 1.0), ('turn', -4.0, 0.0, 2.0, 0.0, 0.0), ('turn', 0.0, 4.0, -1.0, 0.0, 0.0), ('width', 0.5, 1.5, 3.0, 0.25, 0.75)) AS p(axis, lo, hi, a, b, anchor)"


@query(f"""WITH p AS (SELECT * FROM {_SIDES}), e AS (SELECT axis, min(lo) AS low, max(hi) AS top, min(anchor) AS anchor FROM p GROUP BY axis),
    x AS (SELECT l_orderkey, l_linenumber, side, axis, v FROM (SELECT l_orderkey, l_linenumber, 'left' AS side, round(l_discount * 100, 2) AS tilt, round(-(l_tax * 100 - 4), 2) AS turn, round(l_quantity / 25, 4) AS width FROM lineitem
        UNION ALL SELECT l_orderkey, l_linenumber, 'right', round(l_discount * 100, 2), round(l_tax * 100 - 4, 2), round(l_quantity / 25, 4) FROM lineitem) UNPIVOT (v FOR axis IN (tilt, turn, width))),
    c AS (SELECT l_orderkey, l_linenumber, side, axis, least(greatest(v, low), top) AS v, least(greatest(anchor, low), top) AS w, top FROM x JOIN e USING (axis)),
    d AS (SELECT c.l_orderkey, c.l_linenumber, c.side, sum((p1.a * c.v + p1.b) - (p2.a * c.w + p2.b)) AS delta FROM c
        JOIN p p1 ON p1.axis = c.axis AND c.v >= p1.lo AND (c.v < p1.hi OR (c.v = c.top AND p1.hi = c.top)) JOIN p p2 ON p2.axis = c.axis AND c.w >= p2.lo AND (c.w < p2.hi OR (c.w = c.top AND p2.hi = c.top)) GROUP BY ALL),
    s AS (SELECT d.l_orderkey, d.side, 10 * (1 - least(greatest((l_quantity / 10 - delta + 4) / 12, 0), 1)) AS score FROM d JOIN lineitem USING (l_orderkey, l_linenumber))
    SELECT l_orderkey, round(sum(score) FILTER (side = 'left'), 3) AS "left", round(sum(score) FILTER (side = 'right'), 3) AS "right", round(sum(score), 3) AS total FROM s GROUP BY l_orderkey""")  # fmt: skip
def anchored_side_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values corrected by anchored piecewise lines on three axes, scored 0 to 10 and summed by side and in all."""
    li, zero = table(spark, sf_dir, "lineitem"), F.lit(100)
    turn = F.col("l_tax") * 100 - 4
    sides = [li.select("l_orderkey", "l_linenumber", F.lit(s).alias("side"), F.round(F.col("l_discount") * zero, 2).alias("tilt"), F.round(turn * k, 2).alias("turn"), F.round(F.col("l_quantity") / 25, 4).alias("width"), (F.col("l_quantity") / 10).alias("raw")) for s, k in (("left", -1), ("right", 1))]
    both = sides[0].union(sides[1])
    bins = spark.createDataFrame([("tilt", 0.0, 2.0, 1.0, 0.0), ("tilt", 2.0, 6.0, 0.5, 1.0), ("turn", -4.0, 0.0, 2.0, 0.0), ("turn", 0.0, 4.0, -1.0, 0.0), ("width", 0.5, 1.5, 3.0, 0.25)], "axis string, lo double, hi double, a double, b double")
    keys = ["l_orderkey", "l_linenumber", "side"]
    delta = rules.anchored_delta(both.unpivot(keys, ["tilt", "turn", "width"], "axis", "v"), bins, {"tilt": 1.0, "turn": 0.0, "width": 0.75}, keys, "axis", "v")
    score = scores.robust_score(F.col("raw") - F.col("delta"), F.lit(-4.0), F.lit(8.0), True)
    scored = both.select(*keys, "raw").join(delta, keys).select("l_orderkey", "side", score.alias("score"))
    sums = scored.groupBy("l_orderkey").agg(*(F.sum(F.when(F.col("side") == s, F.col("score"))).alias(s) for s in ("left", "right")), F.sum("score").alias("total"))
    return sums.select("l_orderkey", *(F.round(c, 3).alias(c) for c in ("left", "right", "total")))


@query("""WITH c AS (SELECT source, count(*) FILTER (n_chars > 1500) AS k, count(*) AS n FROM documents GROUP BY source),
    f AS (SELECT i, sum(CASE WHEN i > 0 THEN ln(i) ELSE 0 END) OVER (ORDER BY i) AS lf FROM range(100000) r(i) WHERE i <= (SELECT max(n) FROM c)),
    t AS (SELECT source, k, n, unnest(range(0, k + 1)) AS i FROM c)
    SELECT t.source, round(least(sum(exp(a.lf - b.lf - d.lf + t.i * ln(0.6) + (t.n - t.i) * ln(0.4))), 1.0), 6) AS p_value FROM t JOIN f a ON a.i = t.n JOIN f b ON b.i = t.i JOIN f d ON d.i = t.n - t.i GROUP BY t.source""")  # fmt: skip
def binomial_tail_below(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The other one-sided tail: at most so many successes."""
    from rulewright.operators import evaluation

    cases = table(spark, sf_dir, "documents").groupBy("source").agg(F.count_if(F.col("n_chars") > 1500).alias("k"), F.count("*").alias("n")).withColumn("p0", F.lit(0.6))
    return evaluation.binomial_tail(cases, ["source"], "less").select("source", F.round("p_value", 6).alias("p_value"))


@query("""SELECT doc_id, coalesce(quality, -1)::INT AS quality, coalesce(toxic, -1)::INT AS toxic FROM documents LEFT JOIN labels USING (doc_id)""")
def filled_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing labels as -1, all labels as integers."""
    given = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("double").alias("quality"), F.col("toxic").cast("double").alias("toxic"))
    return labels.fill_labels(table(spark, sf_dir, "documents").select("doc_id").join(given, "doc_id", "left"), ["quality", "toxic"])


_SECTORS = 7


@query(f"""SELECT p_partkey, 's' || s AS sector, ((p_size + s) % 6 - 1)::INT AS label, 'img' || p_partkey || '_' || s AS path FROM part, range({_SECTORS}) r(s) WHERE (p_size + s) % 6 <> 0 AND (p_partkey + s) % 4 <> 0""")
def unpivot_sectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven sectors of a wide table, each with a label and an image, without sectors that lack one."""
    key, size = F.col("p_partkey"), F.col("p_size")
    wide = table(spark, sf_dir, "part").select("p_partkey", *(c for s in range(_SECTORS) for c in (((size + s) % 6 - 1).cast("int").alias(f"l{s}"), F.when((key + s) % 4 != 0, F.concat(F.lit("img"), key, F.lit(f"_{s}"))).otherwise("").alias(f"p{s}"))))
    long = labels.unpivot_structs(wide, ["p_partkey"], {f"s{s}": {"label": f"l{s}", "path": f"p{s}"} for s in range(_SECTORS)}, (F.col("label") != -1) & (F.col("path") != ""))
    return long.withColumnRenamed("side", "sector")


@query("""WITH i AS (SELECT 'pair' || o_orderkey // 2 AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'left_' ELSE 'right_' END || o_orderkey AS name, o_totalprice AS label FROM orders)
    SELECT l.id, l.name AS left_name, l.label AS left_label, r.name AS right_name, r.label AS right_label FROM i l JOIN i r ON l.id = r.id WHERE contains(l.name, 'left') AND contains(r.name, 'right')""")  # fmt: skip
def paired_halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The left and right rows of one label table, paired again by id."""
    order = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("pair"), F.floor(order / 2)).alias("id"), F.concat(F.when(order % 2 == 0, "left_").otherwise("right_"), order).alias("name"), F.col("o_totalprice").alias("label")
    )
    return labels.pair_halves(rows, "id", "name", {"left": "left", "right": "right"})
