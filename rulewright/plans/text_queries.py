"""Text and number expressions, and files, on whole tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulewright.functions import scores, text
from rulewright.operators import batchfn
from rulewright.plans.registry import query, table
from rulewright.sources import readers, sinks
from rulewright.storage import Workspace


@query(r"SELECT page_id, regexp_replace(regexp_replace(replace(coalesce(html, ''), chr(13), chr(10)), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS clean FROM pages")
def text_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.clean(F.col("html")).alias("clean"))


@query(r"SELECT page_id, coalesce(nullif(substr(regexp_replace(regexp_replace(regexp_replace(coalesce(url, ''), '^\s+|\s+$', '', 'g'), '\s+', '_', 'g'), '[^0-9A-Za-z가-힣_.\-]', '', 'g'), 1, 40), ''), 'EMPTY') AS slug FROM pages")
def slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.slug(F.col("url"), 40).alias("slug"))


@query("""SELECT p_partkey, concat_ws('::', 'part', replace(p_name, ' ', '_'), p_partkey) AS key, 'name: ' || p_name || chr(10) || 'type: ' || CASE WHEN p_size % 4 = 0 THEN '없음' ELSE p_type END AS said,
    CASE WHEN p_size % 4 = 0 THEN p_brand ELSE p_brand || ' | ' || p_type END AS joined FROM part""")  # fmt: skip
def template_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("p_size") % 4 != 0, F.col("p_type"))
    return table(spark, sf_dir, "part").select(
        "p_partkey", text.surrogate_key(F.lit("part"), text.slug(F.col("p_name")), F.col("p_partkey").cast("string")).alias("key"),
        text.template(name=F.col("p_name"), type=kind).alias("said"), text.join_conditions(F.col("p_brand"), F.coalesce(kind, F.lit(text.NONE_WORD)), F.lit("")).alias("joined"),
    )


@query(r"""SELECT page_id, string_split(url, '/')[-1] AS base, regexp_replace(url, '\.[^./]*$', '.png') AS swapped, string_split(url, '/')[3] AS host, nullif(regexp_extract(url, '[0-9]+'), '') AS number, regexp_matches(html, '<p>') AS has_p,
    CASE WHEN contains(url, '_-45_') THEN 'left' WHEN contains(url, '_45_') THEN 'right' WHEN contains(url, '_0_') THEN 'front' END AS side FROM pages""")  # fmt: skip
def path_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    return table(spark, sf_dir, "pages").select(
        "page_id", text.basename(url).alias("base"), text.swap_extension(url, ".png").alias("swapped"), text.token(url, 3, "/").alias("host"), text.regex_or_null(url, "[0-9]+").alias("number"),
        F.contains("html", F.lit("<p>")).alias("has_p"), text.view_of(url).alias("side"),
    )


@query(r"""WITH b AS (SELECT doc_id, source || ': ' || lang || '; ; broken; n:' || n_chars AS t FROM documents), s AS (SELECT doc_id, unnest(string_split(t, ';')) AS p FROM b), q AS (SELECT doc_id, trim(p) AS p FROM s WHERE contains(p, ':'))
    SELECT doc_id, trim(split_part(p, ':', 1)) AS name, trim(substr(p, strpos(p, ':') + 1)) AS description FROM q""")  # fmt: skip
def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = F.concat("source", F.lit(": "), "lang", F.lit("; ; broken; n:"), "n_chars")
    return table(spark, sf_dir, "documents").select("doc_id", F.inline(text.named_blocks(told)))


@query(r"""WITH c AS (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'please image_path="/a/b' || conv_id || '.jpg", now' WHEN 1 THEN 'see ''my pic.PNG'' here' WHEN 2 THEN 'look at x' || turn || '.jpeg ok' ELSE text END AS t,
    CASE conv_id % 3 WHEN 0 THEN 'A female patient' WHEN 1 THEN 'one Man here' ELSE 'none' END AS g FROM conversations)
    SELECT conv_id, turn, trim(coalesce(nullif(regexp_extract(t, '(?i)(?:image_path|path|경로)\s*[:=]\s*([^\s,]+)', 1), ''), nullif(regexp_extract(t, '(?i)(?:image|img)\s*[:=]\s*([^\s,]+)', 1), ''), nullif(regexp_extract(t, '(?i)([^\s]+\.(?:jpg|jpeg|png|webp|bmp|gif))', 1), '')), '''"') AS path,
        CASE WHEN regexp_matches(lower(g), '(^|\s)(female|woman)(\s|$)') THEN 'female' WHEN regexp_matches(lower(g), '(^|\s)(male|man)(\s|$)') THEN 'male' END AS gender FROM c""")  # fmt: skip
def kv_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = (
        F.when(F.col("turn") % 4 == 0, F.concat(F.lit('please image_path="/a/b'), "conv_id", F.lit('.jpg", now')))
        .when(F.col("turn") % 4 == 1, F.lit("see 'my pic.PNG' here"))
        .when(F.col("turn") % 4 == 2, F.concat(F.lit("look at x"), "turn", F.lit(".jpeg ok")))
        .otherwise(F.col("text"))
    )
    g = F.when(F.col("conv_id") % 3 == 0, "A female patient").when(F.col("conv_id") % 3 == 1, "one Man here").otherwise("none")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.image_path(t).alias("path"), text.gender_word(g).alias("gender"))


@query("""SELECT event_id, CASE event_id % 3 WHEN 0 THEN '[' || props || ']' WHEN 1 THEN props END AS block, CASE WHEN event_id % 3 < 2 THEN (props->>'n')::BIGINT END AS n FROM events""")
def json_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    noisy = (
        F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("Here it is:\n```json\n["), "props", F.lit("]\n```\nbye")))
        .when(F.col("event_id") % 3 == 1, F.concat(F.lit("Sure! "), "props", F.lit(" done")))
        .otherwise(F.lit("nothing"))
    )
    e = table(spark, sf_dir, "events").select("event_id", text.json_block(noisy).alias("block"))
    n = F.coalesce(F.from_json("block", "array<struct<n:bigint>>")[0]["n"], F.from_json("block", "n bigint")["n"])
    return e.select("event_id", "block", n.alias("n"))


@query("""WITH p AS (SELECT p_partkey, p_name AS core, CASE WHEN p_size % 2 = 0 THEN p_type ELSE '' END AS extra, p_size % 3 AS m, CASE p_partkey % 3 WHEN 0 THEN 'strict' WHEN 1 THEN 'broad' ELSE 'broadest' END AS level FROM part),
    b AS (SELECT *, CASE WHEN extra <> '' THEN '((' || core || ') OR (' || extra || '))' ELSE '(' || core || ')' END AS base FROM p),
    n AS (SELECT *, CASE WHEN m > 0 AND level <> 'broadest' THEN '(' || base || ' AND (' || CASE m WHEN 1 THEN '"Skin"[MeSH Terms]' ELSE '"Skin"[MeSH Terms] OR "Aging"[MeSH Terms]' END || '))' ELSE base END AS q FROM b)
    SELECT p_partkey, CASE level WHEN 'broadest' THEN q WHEN 'broad' THEN q || ' AND Humans[MeSH Terms]' ELSE q || ' AND Humans[MeSH Terms] AND (Randomized Controlled Trial[Publication Type] OR Meta-Analysis[Publication Type] OR Systematic Review[Publication Type] OR Clinical Trial[Publication Type])' END AS q FROM n""")  # fmt: skip
def query_builder(spark: SparkSession, sf_dir: str) -> DataFrame:
    topics = F.slice(F.array(F.lit("Skin"), F.lit("Aging")), 1, F.col("p_size") % 3)
    level = F.element_at(F.array(F.lit("strict"), F.lit("broad"), F.lit("broadest")), (F.col("p_partkey") % 3 + 1).cast("int"))
    extra = F.when(F.col("p_size") % 2 == 0, F.col("p_type")).otherwise("")
    return table(spark, sf_dir, "part").select("p_partkey", text.boolean_query(F.col("p_name"), extra, topics, level).alias("q"))


@query("""WITH t AS (SELECT l_orderkey, list(l_returnflag ORDER BY l_linenumber, l_partkey) AS flags, list(l_linestatus ORDER BY l_linenumber, l_partkey) AS st FROM lineitem GROUP BY 1)
    SELECT l_orderkey, regexp_matches(array_to_string(flags, ''), 'N.*R') AS subsequence, list_contains(flags, 'N') AND len(list_distinct(flags)) = 1 AS same_set, len(flags)::INT AS n FROM t""")  # fmt: skip
def action_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Nulls stand last, and rows that the order leaves tied stay as they lie in the table, which is where DuckDB's stable sort leaves them.
    order = [*(x for c in ("l_linenumber", "l_partkey") for x in (F.isnull(c).alias(f"no_{c}"), F.col(c))), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")]
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.struct(*order, "l_returnflag").alias("line"))
    flags = F.transform(F.array_sort(F.collect_list("line")), lambda x: x["l_returnflag"])
    t = lines.groupBy("l_orderkey").agg(flags.alias("flags")).withColumn("known", F.array_compact("flags"))
    # Without a flag that is known the order is not known either.
    ordered = F.when(F.size("known") > 0, text.is_subsequence(F.array(F.lit("N"), F.lit("R")), F.col("known")))
    return t.select("l_orderkey", ordered.alias("subsequence"), (F.array_distinct("known") == F.array(F.lit("N"))).alias("same_set"), F.size("flags").alias("n"))


@query("""SELECT c_custkey, c_nationkey % 2 = 0 AS right_args, 'nation=''' || c_nationkey || ''', segment=''' || c_mktsegment || '''' AS args, CASE WHEN length(c_name) > 12 THEN substr(c_name, 1, 12) || '...' ELSE c_name END AS short,
    CASE WHEN c_custkey % 2 = 0 THEN 'segment=' || c_mktsegment ELSE 'unknown' END AS context, printf('%.1f', c_nationkey::DOUBLE) AS balance, contains(c_name, '7') OR contains(c_mktsegment, 'BUILD') AS any_word FROM customer""")  # fmt: skip
def tool_args(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = F.create_map(F.lit("segment"), F.col("c_mktsegment"), F.lit("nation"), F.col("c_nationkey").cast("string"))
    wanted = F.create_map(F.lit("nation"), F.when(F.col("c_nationkey") % 2 == 0, F.col("c_nationkey").cast("string")).otherwise("none"))
    return table(spark, sf_dir, "customer").select(
        "c_custkey", text.is_submap(wanted, got).alias("right_args"), text.args_text(got).alias("args"), text.ellipsis(F.col("c_name"), 12).alias("short"),
        text.key_values("unknown", segment=F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment"))).alias("context"), scores.number_text(F.col("c_nationkey").cast("double")).alias("balance"),
        (text.contains_any(F.col("c_name"), F.array(F.lit("7"))) | text.contains_any(F.col("c_mktsegment"), F.array(F.lit("BUILD")))).alias("any_word"),
    )


@query("""SELECT l_orderkey, l_linenumber, l_partkey, round(atan2(l_tax, l_discount + 0.01), 6) AS slope, round(l_quantity * cos(0.3) - l_tax * sin(0.3), 6) AS x, round(sqrt(l_tax * l_tax + l_discount * l_discount), 6) AS dist,
    abs(l_discount) < 0.05 AND abs(l_tax) < 0.05 AS valid, CASE WHEN greatest(0.0, l_tax * 100) < least(5.0, l_tax * 100 + 3) AND greatest(0.0, l_discount * 100) < least(5.0, l_discount * 100 + 3) THEN round((least(5.0, l_tax * 100 + 3) - greatest(0.0, l_tax * 100)) * (least(5.0, l_discount * 100 + 3) - greatest(0.0, l_discount * 100)), 4) END AS area FROM lineitem""")  # fmt: skip
def geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    tax, disc = F.col("l_tax"), F.col("l_discount")
    box = F.struct((tax * 100).alias("xmin"), (disc * 100).alias("ymin"), (tax * 100 + 3).alias("xmax"), (disc * 100 + 3).alias("ymax"))
    frame = F.struct(*(F.lit(v).alias(k) for k, v in {"xmin": 0.0, "ymin": 0.0, "xmax": 5.0, "ymax": 5.0}.items()))
    common = scores.overlap(box, frame)
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.round(scores.slope(tax, disc + 0.01), 6).alias("slope"), F.round(scores.rotate(F.col("l_quantity"), tax, F.lit(0.3))["x"], 6).alias("x"),
        F.round(F.sqrt(tax * tax + disc * disc), 6).alias("dist"), ((F.abs(disc) < 0.05) & (F.abs(tax) < 0.05)).alias("valid"),
        F.round((common["xmax"] - common["xmin"]) * (common["ymax"] - common["ymin"]), 4).alias("area"),
    )


@query("""SELECT doc_id, lang, 'train' AS split FROM documents WHERE doc_id % 10 > 1 UNION ALL SELECT doc_id, lang, 'val' FROM documents WHERE doc_id % 10 <= 1""")
def json_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written by dataset and split as JSON, and read back from the partition folders."""
    ws = Workspace(spark, "json-splits")
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", F.col("source").alias("dataset"), F.when(F.col("doc_id") % 10 > 1, "train").otherwise("val").alias("split"))
    sinks.write_splits(docs, ws.path("out"))
    return readers.read_json_records(spark, ws.path("out"), "doc_id long, lang string, dataset string, split string", multi_line=False).select("doc_id", "lang", "split")


@query("SELECT c_custkey::VARCHAR AS id, round(c_acctbal, 1) AS balance FROM customer")
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers written as CSV with rounded numbers, read back without the last column."""
    ws = Workspace(spark, "csv")
    to = sinks.write_csv(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"), "c_name"), ws.path("out"), 1, "20240101_120000")
    return readers.read_csv(spark, to, "id string, balance double, c_name string", drop_last=True)


@query("""SELECT doc_id::VARCHAR AS pmid, 'Doc ' || doc_id AS title, 'Part one. Part two.' AS abstract, 'Kim A, Lee B, Park C' || CASE WHEN doc_id % 2 = 0 THEN ', et al.' ELSE '' END AS authors, (2000 + doc_id % 24)::INT AS year,
    CASE WHEN doc_id % 3 = 0 THEN 'Meta-Analysis' ELSE 'Journal Article' END AS study_type FROM documents""")  # fmt: skip
def xml_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An article of XML for each document, parsed back."""
    ws = Workspace(spark, "xml")
    i = F.col("doc_id")

    year = (2000 + i % 24).cast("string")
    names = [F.struct(F.lit(last).alias("LastName"), F.lit(initials).alias("Initials")) for last, initials in (("Kim", "A"), ("Lee", "B"), ("Park", "C"), ("Choi", "D"))]
    authors = F.when(i % 2 == 0, F.array(*names)).otherwise(F.array(*names[:3]))
    kinds = F.when(i % 3 == 0, F.array(F.lit("Review"), F.lit("Meta-Analysis"))).otherwise(F.array(F.lit("Journal Article")))
    date = F.struct(F.when(i % 5 != 0, year).alias("Year"), F.when(i % 5 == 0, F.concat(year, F.lit(" Jan-Feb"))).alias("MedlineDate"))
    article = F.struct(
        F.concat(F.lit("Doc "), i).alias("ArticleTitle"),
        F.struct(F.array(F.lit("Part one."), F.lit("Part two.")).alias("AbstractText")).alias("Abstract"),
        F.struct(authors.alias("Author")).alias("AuthorList"),
        F.struct(kinds.alias("PublicationType")).alias("PublicationTypeList"),
        F.struct(F.struct(date.alias("PubDate")).alias("JournalIssue")).alias("Journal"),
    )
    rows = table(spark, sf_dir, "documents").select(F.struct(i.cast("string").alias("PMID"), article.alias("Article")).alias("MedlineCitation"))
    rows.write.format("xml").option("rowTag", "PubmedArticle").option("rootTag", "PubmedArticleSet").save(ws.path("in"))
    return readers.read_articles(spark, ws.path("in"))


@query("""SELECT run_ts, count(*) AS n, sum(n)::BIGINT AS docs FROM (SELECT '2024-02' AS run_ts, lang, count(*) AS n FROM documents WHERE doc_id % 2 = 0 GROUP BY lang) GROUP BY run_ts""")
def latest_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs appended; the latest one read."""
    ws = Workspace(spark, "runs")
    docs = table(spark, sf_dir, "documents")
    sinks.append_run(docs.groupBy("lang").agg(F.count("*").alias("n")), ws.path("runs"), "2024-01")
    sinks.append_run(docs.where("doc_id % 2 = 0").groupBy("lang").agg(F.count("*").alias("n")), ws.path("runs"), "2024-02")
    return sinks.latest_run(spark, ws.path("runs")).groupBy(F.col("run_ts").cast("string").alias("run_ts")).agg(F.count("*").alias("n"), F.sum("n").alias("docs"))


@query("""SELECT p_brand, count(*) AS n, min(row_no) AS first_row, max(rule_id) AS last_id FROM (SELECT p_brand, p_partkey AS row_no, 'feature::' || p_brand || '::' || p_type || '::C' || p_size || '::' || p_partkey AS rule_id FROM (SELECT p_brand, p_partkey, replace(p_type, ' ', '_') AS p_type, p_size FROM part )) GROUP BY p_brand""")
def load_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sheets of different layouts in one rule table."""
    two = F.endswith(F.col("p_brand"), F.lit("2"))
    conditions = [F.when(two, "a").otherwise("1-5점").alias("condition_1"), F.when(two, "b").alias("condition_2")]
    rows = table(spark, sf_dir, "part").select("p_brand", F.col("p_partkey").alias("row_no"), F.col("p_type").alias("age_group"), F.concat(F.lit("C"), "p_size").alias("code"), *conditions)
    rules = readers.load_tagged_rules(rows, "p_brand", ["Brand#11"])
    keyed = rules.withColumn("rule_id", F.regexp_replace("rule_id", "^feature::Brand(?=[0-9])", "feature::Brand#"))
    return keyed.groupBy(F.col("source_sheet").alias("p_brand")).agg(F.count("*").alias("n"), F.min("row_no").alias("first_row"), F.max("rule_id").alias("last_id"))


@query("SELECT CASE WHEN doc_id % 97 = 0 THEN 'failed' ELSE 'success' END AS status, count(*) AS n, sum(CASE WHEN doc_id % 97 <> 0 THEN length(text) END)::BIGINT AS total FROM documents GROUP BY 1")
def batch_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user model over batches; rows at fault are marked and the others scored."""

    def make():  # noqa: ANN202
        def model(rows: pd.DataFrame) -> pd.DataFrame:
            if (rows["doc_id"] % 97 == 0).any():
                raise ValueError("bad id")
            return pd.DataFrame({"score": rows["text"].str.len()})

        return model

    scored = Workspace(spark, "scored").save(batchfn.batch_score(table(spark, sf_dir, "documents").select("doc_id", "text"), make, "score long"), "scored")
    good, bad = batchfn.route_by_status(scored)
    return good.unionByName(bad).groupBy("status").agg(F.count("*").alias("n"), F.sum("score").alias("total"))
