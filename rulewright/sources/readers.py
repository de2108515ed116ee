"""Readers with explicit schemas."""

from __future__ import annotations

import warnings
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rulewright.functions import text
from rulewright.operators.sides import small

#: The columns of the one rule table.
RULE_COLUMNS = ["feature_name", "age_group", "condition_1", "condition_2", "condition_3", "code", "output_text", "customer_desc", "clinician_desc"]


def read_json_records(spark: SparkSession, paths: str | list[str], schema: str, multi_line: bool = True) -> DataFrame:
    """JSON arrays of records; identifiers are strings if the schema says so."""
    return spark.read.schema(schema).option("multiLine", multi_line).json(paths)


def read_manifests(spark: SparkSession, directories: list[str], task: str, split: str, schema: str) -> DataFrame:
    """``{directory}/{task}_{split}.json`` of every directory, with dataset and split from the path.

    A missing directory is an error, raised by the reader.
    """
    df = read_json_records(spark, [f"{d}/{task}_{split}.json" for d in directories], schema)
    path = F.col("_metadata.file_path")
    return df.withColumn("dataset", F.regexp_extract(path, r"([^/]+)/[^/]+$", 1)).withColumn("split", F.regexp_extract(path, r"_([a-z]+)\.json$", 1))


def read_manifest_table(spark: SparkSession, root: str, manifest: DataFrame, split: str, schema: str) -> DataFrame:
    """One split of the datasets that a table ``manifest(dataset)`` names, from folders that ``sinks.write_splits`` wrote below one root.

    Folders are partitions, so only the split is listed for reading, and only the
    manifest's datasets are read. A dataset without any folder of the split is an error.
    """
    found = spark.read.schema(f"{schema}, dataset string, split string").json(root).where(F.col("split") == split)
    wanted = manifest.select("dataset").distinct()
    missing = wanted.join(found.select("dataset").distinct(), "dataset", "left_anti").limit(5).collect()
    if missing:
        raise ValueError(f"missing datasets: {', '.join(str(r['dataset']) for r in missing)}")
    return found.join(small(wanted), "dataset", "left_semi")


def read_csv(spark: SparkSession, path: str, schema: str, drop_last: bool = False) -> DataFrame:
    df = spark.read.schema(schema).csv(path, header=True)
    return df.drop(df.columns[-1]) if drop_last else df


def list_files(spark: SparkSession, path: str, glob: str = "*.{jpg,jpeg,png}") -> DataFrame:
    """Paths and sizes below a directory; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    return files.select("path", "length").orderBy("path")


def read_entity_files(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """Files of ``{id: {key: value}}``; one row per id, the later file by path wins for a key."""
    raw = spark.read.option("wholetext", True).text(path).select("value", F.col("_metadata.file_path").alias("file"))
    entries = raw.select("file", F.explode(F.from_json("value", "map<string,map<string,string>>")).alias("id", "fields")).select("file", "id", F.explode("fields").alias("key", "value"))
    latest = entries.groupBy("id", "key").agg(F.max_by("value", "file").alias("value"))
    return latest.groupBy("id").pivot("key", names).agg(F.first("value"))


def read_articles(spark: SparkSession, path: str) -> DataFrame:
    """Article XML to one row per article: id, title, abstract, first authors, year, study type."""
    schema = """MedlineCitation struct<
        PMID: string,
        Article: struct<ArticleTitle: string, Abstract: struct<AbstractText: array<string>>,
            AuthorList: struct<Author: array<struct<LastName: string, Initials: string>>>,
            PublicationTypeList: struct<PublicationType: array<string>>,
            Journal: struct<JournalIssue: struct<PubDate: struct<Year: string, MedlineDate: string>>>>>"""
    raw = spark.read.schema(schema).option("rowTag", "PubmedArticle").format("xml").load(path)
    a = F.col("MedlineCitation.Article")
    authors = F.transform(a["AuthorList"]["Author"], lambda x: F.struct(x["LastName"].alias("last"), x["Initials"].alias("initials")))
    date = a["Journal"]["JournalIssue"]["PubDate"]
    # Study types in the order of preference.
    order = ["Meta-Analysis", "Systematic Review", "Randomized Controlled Trial", "Clinical Trial", "Review"]
    return raw.select(
        F.col("MedlineCitation.PMID").alias("pmid"),
        a["ArticleTitle"].alias("title"),
        F.array_join(a["Abstract"]["AbstractText"], " ").alias("abstract"),
        F.coalesce(text.author_line(authors), F.lit("")).alias("authors"),
        text.year_of(F.coalesce(date["Year"], date["MedlineDate"])).alias("year"),
        text.preferred(a["PublicationTypeList"]["PublicationType"], order).alias("study_type"),
    )


def normalise_sheet(sheet: DataFrame, feature: Column, source: Column) -> DataFrame:
    """Rule sheets of one, two or three condition columns in the one rule schema, numbered by row."""
    conditions = [c for c in sheet.columns if c.startswith("condition")]
    named = {f"condition_{i + 1}": text.clean(F.col(c)) for i, c in enumerate(sorted(conditions))}
    own = {c: text.clean(F.col(c)) for c in sheet.columns if c in RULE_COLUMNS and not c.startswith("condition")}
    columns = [(own | named | {"feature_name": feature}).get(c, F.lit("")).alias(c) for c in RULE_COLUMNS]
    keyed = sheet.select("row_no", *columns, source.alias("source_sheet"))
    raw = text.join_conditions(*(F.col(f"condition_{i}") for i in (1, 2, 3)))
    key = text.surrogate_key(F.lit("feature"), text.slug(F.col("feature_name")), text.slug(F.col("age_group")), text.slug(F.col("code")), F.col("row_no").cast("string"))
    return keyed.withColumn("raw_condition", raw).withColumn("rule_id", key)


def load_tagged_rules(rows: DataFrame, sheet: str, required: Iterable[str] = ()) -> DataFrame:
    """Any number of sheets that lie in one table, told apart by the column ``sheet``, in one pass.

    Condition columns that a sheet's layout lacks are null in its rows. A required sheet without rows is an error.
    """
    missing = set(required) - {r[0] for r in rows.where(F.col(sheet).isin(list(required))).select(sheet).distinct().collect()} if required else ()
    if missing:
        raise ValueError(f"missing rule sheets: {', '.join(sorted(missing))}")
    return normalise_sheet(rows, F.col(sheet), F.col(sheet))


def load_rules(sheets: dict[str, DataFrame], required: list[str], optional: Iterable[str] = ()) -> DataFrame:
    """All sheets as one rule table; a missing required sheet is an error, a missing optional one a warning."""
    missing = [s for s in required if s not in sheets]
    for name in (s for s in optional if s not in sheets):
        warnings.warn(f"missing rule sheet: {name}", stacklevel=2)
    if missing:
        raise ValueError(f"missing rule sheets: {', '.join(missing)}")
    return reduce(DataFrame.unionByName, (normalise_sheet(df, F.lit(name), F.lit(name)) for name, df in sheets.items()))


def read_composite(sheet: DataFrame, names: list[str]) -> DataFrame:
    """A wide composite sheet by position, without rows that lack an age group."""
    return sheet.toDF(*names).where(F.coalesce(F.trim("age_group"), F.lit("")) != "")
