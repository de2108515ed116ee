"""Condition texts compiled to typed predicates, and rules matched to subjects."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rulewright.functions import scores, text
from rulewright.operators import intervals
from rulewright.operators.sides import small

#: The grammar of range texts. "a-b" has priority, then "at most", then "at least".
BETWEEN = r"(\d+)\s*[-~]\s*(\d+)\s*점"
AT_MOST = r"(\d+)\s*점\s*이하"
AT_LEAST = r"(\d+)\s*점\s*이상"
BOTH, EITHER = "양쪽", "한쪽"
CLAUSES = r"이면서|,\s+"


def parse_range(c: Column) -> Column:
    """A range text as struct (lo, hi); null if there is none or it runs backwards."""

    def number(pattern: str, group: int = 1) -> Column:
        return F.nullif(F.regexp_extract(c, pattern, group), F.lit("")).cast("double")

    low, high, most, least = number(BETWEEN), number(BETWEEN, 2), number(AT_MOST), number(AT_LEAST)
    lo = F.when(low.isNotNull(), low).when(most.isNotNull(), F.lit(0.0)).otherwise(least)
    hi = F.when(low.isNotNull(), high).when(most.isNotNull(), most).when(least.isNotNull(), F.lit(100.0))
    return F.when(lo.isNotNull() & (lo <= hi), F.struct(lo.alias("lo"), hi.alias("hi")))


def _within(value: Column, lo: Column, hi: Column) -> Column:
    return (value >= lo) & (value <= hi)


def is_none(c: Column) -> Column:
    return text.strip(F.coalesce(c, F.lit(""))).isin("", text.NONE_WORD)


def compile_bilateral(c: Column) -> Column:
    """Clauses as array of (both, lo, hi); a clause without scope or range can never hold."""

    def clause(t: Column) -> Column:
        bounds = parse_range(t)
        scoped = F.contains(t, F.lit(BOTH)) | F.contains(t, F.lit(EITHER))
        return F.struct(F.contains(t, F.lit(BOTH)).alias("both"), F.when(scoped, bounds["lo"]).alias("lo"), F.when(scoped, bounds["hi"]).alias("hi"))

    flat = text.strip(F.replace(F.coalesce(c, F.lit("")), F.lit("\n"), F.lit(" ")))
    return F.transform(F.split(flat, CLAUSES), clause)


def eval_bilateral(clauses: Column, left: Column, right: Column) -> Column:
    def holds(k: Column) -> Column:
        a, b = _within(left, k["lo"], k["hi"]), _within(right, k["lo"], k["hi"])
        return F.coalesce(F.when(k["both"], a & b).otherwise(a | b), F.lit(False))

    return left.isNotNull() & right.isNotNull() & F.forall(clauses, holds)


def _names(variables: list[str]) -> str:
    return "|".join(r"\Q" + v + r"\E" for v in variables)


def compile_weighted(c: Column, variables: list[str]) -> Column:
    """``v1 + 0.5*v2 lo-hi`` as struct (terms: array of (coef, var), lo, hi); null if unreadable."""
    flat = text.strip(F.replace(F.coalesce(c, F.lit("")), F.lit("\n"), F.lit(" ")))
    # Fixed value: the grammar of a term, a factor and a name.
    pattern = rf"(?:(\d+(?:\.\d+)?)\s*\*\s*)?({_names(variables)})"
    coefs = F.transform(F.regexp_extract_all(flat, F.lit(pattern), F.lit(1)), lambda x: F.coalesce(F.nullif(x, F.lit("")).cast("double"), F.lit(1.0)))
    terms = F.zip_with(coefs, F.regexp_extract_all(flat, F.lit(pattern), F.lit(2)), lambda k, v: F.struct(k.alias("coef"), v.alias("var")))
    bounds = parse_range(flat)
    return F.when(bounds.isNotNull() & (F.size(terms) > 0) & ~is_none(c), F.struct(terms.alias("terms"), bounds["lo"].alias("lo"), bounds["hi"].alias("hi")))


def compile_prefixed(c: Column, variables: list[str]) -> Column:
    """``v lo-hi`` as the same struct with one term."""
    flat = text.strip(F.coalesce(c, F.lit("")))
    var = F.nullif(F.regexp_extract(flat, rf"^({_names(variables)})", 1), F.lit(""))
    bounds = parse_range(F.substring(flat, F.length(var) + 1, F.length(flat)))
    term = F.array(F.struct(F.lit(1.0).alias("coef"), var.alias("var")))
    return F.when(var.isNotNull() & bounds.isNotNull(), F.struct(term.alias("terms"), bounds["lo"].alias("lo"), bounds["hi"].alias("hi")))


def compile_condition(c: Column, variables: list[str]) -> Column:
    """Weighted if the text has ``+`` or ``*``, else prefixed."""
    return F.when(c.rlike("[+*]"), compile_weighted(c, variables)).otherwise(compile_prefixed(c, variables))


def weighted_value(compiled: Column, values: Column) -> Column:
    """The weighted sum over a map of values; null if any is missing."""
    return F.aggregate(compiled["terms"], F.lit(0.0), lambda s, t: s + t["coef"] * F.try_element_at(values, t["var"]))


def eval_condition(c: Column, compiled: Column, values: Column) -> Column:
    """An empty condition passes; an unreadable one or a missing value does not."""
    held = weighted_value(compiled, values).between(compiled["lo"], compiled["hi"])
    return is_none(c) | F.coalesce(held, F.lit(False))


#: Rules up to this many are compiled into the row's expression; larger tables are indexed or listed, with the same result.
INLINE_RULES = 500
#: Cuts of the first variable's line into lists of rules, and rules of one list that is not cut.
_CUTS, _LISTED = 64, 10_000


def first_holding(subjects: DataFrame, rules: DataFrame, test: Callable[[Row], Column], listed: Callable[[Column], Column], ordinal: str = "rule_no", on: Column | None = None, span: Column | None = None) -> DataFrame:
    """Subjects with ``ordinal`` of the first rule that holds, without those that none holds for.

    A small rule table becomes one chain of conditions (``test`` of each rule). A
    larger one is an ordered list that is searched inside the row up to the first
    rule that holds (``listed``, the same test over a struct column). With ``on`` and
    ``span`` the list is cut: ``span`` (a struct lo, hi over the rule's columns, null
    for no bound) must hold ``on`` of a subject that the rule holds for, so a row
    meets the rules of its stretch of the line only. A row in is at most a row out, at any number of rules.
    """
    found = rules.orderBy(ordinal).limit(INLINE_RULES + 1).collect()
    if len(found) > INLINE_RULES:
        if on is None:
            return _first_listed(subjects, rules, listed, ordinal)
        return _first_in_stretch(subjects, rules, listed, ordinal, on, span)
    if not found:
        return subjects.withColumn(ordinal, F.lit(None).cast(rules.schema[ordinal].dataType)).where(F.lit(False))
    first = F.coalesce(*(F.when(test(r), F.lit(r[ordinal])) for r in found))
    return subjects.withColumn(ordinal, first).where(F.col(ordinal).isNotNull())


def _search(rules: Column, listed: Callable[[Column], Column], kind: T.DataType, made: Callable[[Column], Column]) -> Column:
    """What is ``made`` of the first rule of an ordered list that holds; rules behind it are not tested.

    An aggregate, not a filter: over a filter whose lambda reads a column of the
    other side of a join, the optimizer infers a condition that it then evaluates on the wrong side.
    """
    return F.aggregate(rules, F.lit(None).cast(kind), lambda found, r: F.when(found.isNotNull(), found).when(listed(r), made(r)))


def _ordered(rules: DataFrame, ordinal: str) -> Column:
    rest = [c for c in rules.columns if c != ordinal]
    by = lambda a, b: F.when(a[ordinal] < b[ordinal], -1).when(a[ordinal] > b[ordinal], 1).otherwise(0)
    return F.array_sort(F.collect_list(F.struct(ordinal, *rest)), by)


def _first_listed(subjects: DataFrame, rules: DataFrame, listed: Callable[[Column], Column], ordinal: str) -> DataFrame:
    """Rules as lists of a bounded number, in order, each a value that is made once and searched inside the row."""
    ranked = rules.withColumn("__list", F.floor((F.row_number().over(Window.orderBy(ordinal)) - 1) / _LISTED))
    lists = -(-rules.count() // _LISTED)
    kind = rules.schema[ordinal].dataType
    found = subjects
    for i in range(lists):
        found = found.withColumn(f"__rules{i}", ranked.where(F.col("__list") == i).drop("__list").agg(_ordered(rules, ordinal)).scalar())
    first = F.coalesce(*(_search(F.col(f"__rules{i}"), listed, kind, lambda r: r[ordinal]) for i in range(lists)))
    return found.withColumn(ordinal, first).where(F.col(ordinal).isNotNull()).drop(*(f"__rules{i}" for i in range(lists)))


def _first_in_stretch(subjects: DataFrame, rules: DataFrame, listed: Callable[[Column], Column], ordinal: str, on: Column, span: Column) -> DataFrame:
    spans = rules.withColumn("__span", span)
    ends = spans.select(F.explode(F.array("__span.lo", "__span.hi")).alias("p")).where("p is not null")
    cuts = sorted(set(ends.agg(F.percentile_approx("p", [i / _CUTS for i in range(_CUTS + 1)], 10_000).alias("cuts")).first()["cuts"] or []))
    line = F.array(*map(F.lit, cuts)) if cuts else F.array().cast("array<double>")
    stretch = lambda c: intervals.last_at_most(line, c.cast("double"), bits=_CUTS.bit_length())
    last = F.when(F.col("__span.hi").isNull(), F.lit(len(cuts))).otherwise(stretch(F.col("__span.hi")))
    ordered = F.coalesce(F.col("__span.lo") <= F.col("__span.hi"), F.lit(True))
    lists = spans.where(ordered).select(*rules.columns, F.explode(F.sequence(stretch(F.col("__span.lo")), last)).alias("__stretch"))  # without a bound: from 0
    lists = lists.groupBy("__stretch").agg(_ordered(rules, ordinal).alias("__rules"))
    met = subjects.withColumn("__at", F.when(on.isNotNull(), stretch(on))).join(small(lists), F.col("__at") == F.col("__stretch"))
    first = _search(F.col("__rules"), listed, rules.schema[ordinal].dataType, lambda r: r[ordinal])
    return met.withColumn(ordinal, first).where(F.col(ordinal).isNotNull()).drop("__at", "__stretch", "__rules")


def first_bilateral(subjects: DataFrame, rules: DataFrame, left: Column, right: Column, ordinal: str = "rule_no") -> DataFrame:
    """Subjects with the first rule whose ``condition`` on both sides holds."""
    compiled = rules.withColumn("clauses", compile_bilateral(F.col("condition")))
    # Clauses on both sides bound the left value; others leave it open.
    both = F.filter("clauses", lambda k: k["both"] & k["lo"].isNotNull())
    span = F.struct(F.array_max(F.transform(both, lambda k: k["lo"])).alias("lo"), F.array_min(F.transform(both, lambda k: k["hi"])).alias("hi"))
    return first_holding(subjects, compiled, bilateral_test(left, right), lambda r: eval_bilateral(r["clauses"], left, right), ordinal, left, span)


def bilateral_test(left: Column, right: Column) -> Callable[[Row], Column]:
    """``eval_bilateral`` for one rule's compiled ``clauses``."""

    def test(rule: Row) -> Column:
        held = F.lit(True)
        for k in rule["clauses"]:
            if k["lo"] is None:
                return F.lit(False)
            a, b = left.between(k["lo"], k["hi"]), right.between(k["lo"], k["hi"])
            held = held & ((a & b) if k["both"] else (a | b))
        return left.isNotNull() & right.isNotNull() & held

    return test


def weighted_test(columns: list[str], values: dict[str, Column]) -> Callable[[Row], Column]:
    """``eval_condition`` for one rule, whose texts are compiled in ``<column>_none`` and ``<column>_compiled``; all must hold."""

    def one(rule: Row, column: str) -> Column:
        compiled = rule[f"{column}_compiled"]
        if rule[f"{column}_none"]:
            return F.lit(True)
        if compiled is None or any(t["var"] not in values for t in compiled["terms"]):
            return F.lit(False)
        total = sum((values[t["var"]] * F.lit(t["coef"]) for t in compiled["terms"]), F.lit(0.0))
        return F.coalesce(total.between(compiled["lo"], compiled["hi"]), F.lit(False))

    return lambda rule: reduce(lambda a, b: a & b, (one(rule, c) for c in columns))


def first_weighted(subjects: DataFrame, rules: DataFrame, columns: list[str], values: dict[str, Column], ordinal: str = "rule_no") -> DataFrame:
    """Subjects with the first rule all of whose condition texts hold over the named values."""
    compiled = rules.select("*", *(compile_condition(F.col(c), list(values)).alias(f"{c}_compiled") for c in columns), *(is_none(F.col(c)).alias(f"{c}_none") for c in columns))
    named = F.create_map(*(x for k, v in values.items() for x in (F.lit(k), v)))

    def listed(rule: Column) -> Column:
        held = (rule[f"{c}_none"] | F.coalesce(_within(weighted_value(rule[f"{c}_compiled"], named), rule[f"{c}_compiled"]["lo"], rule[f"{c}_compiled"]["hi"]), F.lit(False)) for c in columns)
        return reduce(lambda a, b: a & b, held)

    return first_holding(subjects, compiled, weighted_test(columns, values), listed, ordinal)


def first_match(matched: DataFrame, subject: list[str], ordinal: str = "rule_no") -> DataFrame:
    """Of all rules that match a subject, the first in rule order."""
    w = Window.partitionBy(*subject).orderBy(ordinal)
    return matched.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def match_ranges(subjects: DataFrame, rules: DataFrame, keys: list[str], category: str, value: str, how: str = "inner") -> DataFrame:
    """Subjects (``keys``, category, value) with the first rule whose range holds the value.

    Rules are ``(category, rule_no, condition, ...)``. A small rule table is one
    ordered list for each category, joined by it and searched inside the row; a
    larger one becomes an interval index. Either way subjects may repeat, a row in is
    at most a row out, and subjects are shuffled only beyond a broadcast. ``how`` is inner or left.
    """
    compiled = rules.withColumn("bounds", parse_range(F.col("condition")))
    rest = [c for c in compiled.columns if c not in (category, "rule_no")]
    if rules.limit(INLINE_RULES + 1).count() > INLINE_RULES:
        hit = intervals.first_interval(subjects, compiled, F.col(value), [category], F.col("bounds.lo"), F.col("bounds.hi"), [F.col("rule_no"), F.col("condition")], "__hit", how)
    else:
        listed = compiled.groupBy(category).agg(F.array_sort(F.collect_list(F.struct("rule_no", *rest))).alias("__rules"))
        joined = subjects.join(small(listed), category, how)
        kind = listed.schema["__rules"].dataType.elementType
        hit = joined.withColumn("__hit", _search(F.col("__rules"), lambda r: _within(F.col(value), r["bounds"]["lo"], r["bounds"]["hi"]), kind, lambda r: r))
        hit = hit if how == "left" else hit.where("__hit is not null")
    return hit.select(*subjects.columns, *(F.col(f"__hit.{c}").alias(c) for c in ("rule_no", *rest)))


def with_group_fallback(subjects: DataFrame, rules: DataFrame, keys: list[str], category: str, group: str) -> DataFrame:
    """Candidate rules of a subject: those of its group, or all of the category if the group has none."""
    renamed = rules.withColumnsRenamed({category: "__category", group: "__group"})
    joined = subjects.join(small(renamed), F.col(category) == F.col("__category")).drop("__category")
    same = F.coalesce(F.col("__group") == F.col(group), F.lit(False))
    held = F.max(same | F.col(group).isNull()).over(Window.partitionBy(*keys, category))
    return joined.withColumn("__same", same | F.col(group).isNull()).withColumn("__held", held).where("__same or not __held").drop("__same", "__held")


def gap_report(subjects: DataFrame, rules: DataFrame, keys: list[str], category: str, value: str) -> DataFrame:
    """Subjects whose category has rules but whose value lies in no range."""
    matched = match_ranges(subjects, rules, keys, category, value).select(*keys)
    known = rules.select(category).distinct()
    return subjects.where(F.col(value).isNotNull()).join(small(known), category, "left_semi").join(matched, keys, "left_anti")


def narrowest_group(subjects: DataFrame, groups: DataFrame, value: str) -> DataFrame:
    """The group whose interval holds the rounded value, the narrowest first, then by ordinal; a row in is at most a row out."""
    bounds = groups.withColumn("__b", scores.age_bounds(F.col("age_group")))
    rounded = F.bround(F.col(value), 0).cast("int")
    width = F.col("__b.hi") - F.col("__b.lo")
    found = bounds.orderBy(width, "ordinal").limit(INLINE_RULES + 1).collect()
    if len(found) > INLINE_RULES:
        hit = intervals.first_interval(subjects, bounds, rounded, [], F.col("__b.lo"), F.col("__b.hi"), [width, F.col("ordinal"), F.col("age_group")], "__g")
    else:
        made = [F.struct(*(F.lit(r[c]).cast(groups.schema[c].dataType).alias(c) for c in groups.columns)) for r in found]
        none = F.lit(None).cast(T.StructType(groups.schema.fields))
        first = F.coalesce(none, *(F.when(rounded.between(r["__b"]["lo"], r["__b"]["hi"]), s) for r, s in zip(found, made, strict=True)))
        hit = subjects.withColumn("__g", first).where("__g is not null")
    return hit.select(*subjects.columns, *(F.col(f"__g.{c}").alias(c) for c in groups.columns))


def edges_by_code(composite: DataFrame, rules: DataFrame, code_columns: dict[str, str], key: str = "rule_id") -> DataFrame:
    """Unpivot the code columns of composite rules and join rules on (category, age_group, code)."""
    long = composite.unpivot([key, "age_group"], list(code_columns), "column", "code").where(~F.col("code").isin(*text.SKIP_CODES))
    named = long.withColumn("category", scores.pick_head(F.col("column"), {k: F.lit(v) for k, v in code_columns.items()}))
    target = rules.select(F.col(key).alias("target_id"), "category", "age_group", "code")
    return named.join(target, ["category", "age_group", "code"]).select(F.col(key).alias("source_id"), "target_id", "category")


def piecewise(values: DataFrame, bins: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``a * x + b`` of the bin that holds x, x clamped to the bins of its axis; the last bin is closed."""
    edge = bins.groupBy(*keys).agg(F.min("lo").alias("__min"), F.max("hi").alias("__max"))
    clamped = values.join(small(edge), keys).withColumn("__x", scores.clip(F.col(value).cast("double"), F.col("__min"), F.col("__max")))
    side = bins.select(*(F.col(k).alias(f"__{k}") for k in keys), "lo", "hi", "a", "b")
    same = [F.col(k) == F.col(f"__{k}") for k in keys]
    inside = (F.col("__x") >= F.col("lo")) & ((F.col("__x") < F.col("hi")) | ((F.col("__x") == F.col("__max")) & (F.col("hi") == F.col("__max"))))
    joined = clamped.join(small(side), [*same, inside])
    return joined.withColumn("fitted", F.col("a") * F.col("__x") + F.col("b")).drop(*(f"__{k}" for k in keys), "__min", "__max", "__x", "lo", "hi", "a", "b")


def anchored_delta(values: DataFrame, bins: DataFrame, anchors: dict[str, float], keys: list[str], axis: str, value: str) -> DataFrame:
    """``delta`` of each key: over the axes that have bins, the line at the value less the line at the axis's anchor."""
    spark = values.sparkSession
    at = piecewise(spark.createDataFrame(list(anchors.items()), f"{axis} string, {value} double"), bins, [axis], value).select(axis, F.col("fitted").alias("__anchor"))
    fitted = piecewise(values, bins, [axis], value).join(small(at), axis)
    return fitted.groupBy(*keys).agg(F.sum(F.col("fitted") - F.col("__anchor")).alias("delta"))


def contribution_edges(cases: DataFrame, rules: DataFrame, keys: list[str], case_id: str = "case_id", rule_id: str = "rule_id") -> DataFrame:
    """An edge from each matched rule to its case, with the feature and the score; repeated edges once."""
    joined = cases.join(rules.select(*keys, rule_id), keys)
    return joined.select(F.col(rule_id).alias("source_id"), F.col(case_id).alias("target_id"), "feature_name", "score").dropDuplicates(["source_id", "target_id", "feature_name"])


def lookup_code(subjects: DataFrame, sheet: DataFrame, on: list[str], ordinal: str) -> DataFrame:
    """The first sheet row of (age group, code, ..) for each subject; the sheet is brought to one row of each key before the join."""
    rest = [c for c in sheet.columns if c not in on]
    first = sheet.groupBy(*on).agg(F.min_by(F.struct(*rest), ordinal).alias("__first"))
    return subjects.join(small(first), on).select(*subjects.columns, *(F.col(f"__first.{c}").alias(c) for c in rest))


def landmark_slopes(points: DataFrame, pairs: DataFrame, keys: list[str]) -> DataFrame:
    """``atan2(dy, dx)`` of each landmark pair; null where a landmark is missing."""
    side = small(pairs)
    a = points.select(*keys, F.col("index").alias("i"), F.col("x").alias("x0"), F.col("y").alias("y0"))
    b = points.select(*keys, F.col("index").alias("j"), F.col("x").alias("x1"), F.col("y").alias("y1"))
    wanted = points.select(*keys).distinct().join(side, F.col("i") >= 0)
    joined = wanted.join(a, [*keys, "i"], "left").join(b, [*keys, "j"], "left")
    return joined.select(*keys, "i", "j", scores.slope(F.col("y1") - F.col("y0"), F.col("x1") - F.col("x0")).alias("slope"))
