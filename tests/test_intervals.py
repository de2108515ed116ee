"""Range joins: the same rows from inline rules, lists and the interval index, at any number of rules."""

import math
import random

import pytest
from pyspark.sql import functions as F

from rulewright.operators import intervals, rules


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("n", [1, 500, 501, 5000])
def test_match_ranges_at_any_number_of_rules(spark, n):
    draw = random.Random(n)
    made = []
    for i in range(n):
        lo = draw.randint(0, 90)
        made.append((draw.choice("aaaaabc"), i, f"{lo}-{lo + draw.randint(0, 9)}점" if draw.random() < 0.9 else "없음", f"c{i}"))
    rows = [(draw.randint(0, 40), draw.choice(["a", "b", "c", "d", None]), draw.choice([None, draw.randint(0, 100), draw.uniform(0, 100)])) for _ in range(400)]
    rows = [(i, c, None if v is None else float(v)) for i, c, v in rows] * 2
    bounds = [(c, i, *map(int, t[:-1].split("-"))) for c, i, t, _ in made if t != "없음"]
    want = {(c, v): min((i for k, i, lo, hi in bounds if k == c and v is not None and lo <= v <= hi), default=None) for _, c, v in rows}
    subjects = spark.createDataFrame(rows, "id int, category string, score double")
    table = spark.createDataFrame(made, "category string, rule_no int, condition string, code string")
    for how in ("inner", "left"):
        out = rules.match_ranges(subjects, table, ["id"], "category", "score", how)
        assert "NestedLoop" not in plan(out) and "Cartesian" not in plan(out)
        got = sorted(((r["id"], r["category"], r["score"], r["rule_no"], r["code"]) for r in out.collect()), key=str)
        held = [(i, c, v, want[c, v], None if want[c, v] is None else f"c{want[c, v]}") for i, c, v in rows]
        assert got == sorted((h for h in held if how == "left" or h[3] is not None), key=str)


def test_both_sides_of_the_bound_agree(spark, monkeypatch):
    rows = [(1, 5.0, 50.0), (1, 15.0, None), (2, 15.0, 90.0), (2, 15.0, 90.0), (3, None, 1.0), (4, 99.0, 99.0), (5, 40.0, 95.0)]
    subjects = spark.createDataFrame(rows, "id int, l double, r double")
    bilateral = spark.createDataFrame([(1, "양쪽 40점 이상이면서 한쪽 89점 이하"), (2, "한쪽 80점 이상, 양쪽 10-99점"), (3, "양쪽 50~40점"), (4, "한쪽이 20점 이하"), (5, "10-20점")], "rule_no int, condition string")
    weighted = spark.createDataFrame([(1, "l + 0.5*r 30-40점", ""), (2, "l 20점 이하", "없음"), (3, "r 90점 이상", "l 15-20점")], "rule_no int, c1 string, c2 string")
    groups = spark.createDataFrame([(1, "29세 이하"), (2, "10-19세"), (3, "15-15세"), (4, "40세 이상"), (5, "전체")], "ordinal int, age_group string")
    calls = {
        "bilateral": lambda: rules.first_bilateral(subjects, bilateral, F.col("l"), F.col("r")),
        "weighted": lambda: rules.first_weighted(subjects, weighted, ["c1", "c2"], {"l": F.col("l"), "r": F.col("r")}),
        "narrowest": lambda: rules.narrowest_group(subjects, groups, "l"),
        "narrowest, none": lambda: rules.narrowest_group(subjects, groups.limit(0), "l"),
    }
    inline = {k: sorted(map(str, f().collect())) for k, f in calls.items()}
    assert [len(v) for v in inline.values()] == [5, 4, 6, 0]
    monkeypatch.setattr(rules, "INLINE_RULES", 0)
    monkeypatch.setattr(rules, "_LISTED", 2)
    for name, f in calls.items():
        out = f()
        assert sorted(map(str, out.collect())) == inline[name], name
        assert "NestedLoop" not in plan(out)


@pytest.mark.parametrize("n", [501, 3000])
def test_many_bilateral_rules(spark, n):
    draw = random.Random(n)
    made = []
    for i in range(n):
        lo, top = draw.randint(0, 99), draw.randint(0, 100)
        made.append((i, draw.choice([f"양쪽 {lo}-{lo + 1}점이면서 한쪽 {top}점 이하", f"한쪽 {lo}-{lo}점이면서 한쪽 {top}점 이하" if i % 97 == 0 else f"양쪽 {lo}점 이상, 한쪽 {lo}점 이하"])))
    rows = [(i % 50, float(draw.randint(0, 100)), float(draw.randint(0, 100))) for i in range(300)]
    subjects = spark.createDataFrame(rows, "id int, l double, r double")
    compiled = spark.createDataFrame(made, "rule_no int, condition string").withColumn("clauses", rules.compile_bilateral(F.col("condition"))).collect()

    def holds(c, a, b):
        return c["lo"] is not None and ((c["lo"] <= a <= c["hi"] and c["lo"] <= b <= c["hi"]) if c["both"] else (c["lo"] <= a <= c["hi"] or c["lo"] <= b <= c["hi"]))

    want = [(i, a, b, next((r["rule_no"] for r in compiled if all(holds(c, a, b) for c in r["clauses"])), None)) for i, a, b in rows]
    out = rules.first_bilateral(subjects, spark.createDataFrame(made, "rule_no int, condition string"), F.col("l"), F.col("r"))
    assert sorted(tuple(r) for r in out.collect()) == sorted(w for w in want if w[3] is not None)


def test_interval_index_edges(spark):
    made = [(1, 0.0, 10.0), (2, 5.0, 5.0), (3, 7.0, 3.0), (4, None, 5.0), (5, 10.0, 20.0), (6, -math.inf, -5.0), (7, 15.0, math.inf)]
    values = [-1e9, -5.0, -1.0, 0.0, 5.0, 7.5, 10.0, 12.0, 20.0, 1e18, math.nan, None]
    table = spark.createDataFrame(made, "no int, lo double, hi double")
    out = intervals.first_interval(spark.createDataFrame([(v,) for v in values], "v double"), table, F.col("v"), [], F.col("lo"), F.col("hi"), [F.col("no")], "hit", "left")
    got = {str(r["v"]): r["hit"] and r["hit"]["no"] for r in out.collect()}
    assert got == {"-1000000000.0": 6, "-5.0": 6, "-1.0": None, "0.0": 1, "5.0": 1, "7.5": 1, "10.0": 1, "12.0": 5, "20.0": 5, "1e+18": 7, "nan": None, "None": None}
    nothing = intervals.first_interval(table.select("no"), table.limit(0), F.col("no"), [], F.col("lo"), F.col("hi"), [F.col("no")], "hit", "left")
    assert [r["hit"] for r in nothing.collect()] == [None] * 7


def test_lookup_code_reduces_the_sheet_first(spark):
    subjects = spark.createDataFrame([(1, "x"), (1, "x"), (2, "y"), (3, None)], "id int, code string")
    sheet = spark.createDataFrame([("x", 3, "late"), ("x", 1, "early"), ("z", 0, "other")], "code string, no int, said string")
    out = rules.lookup_code(subjects, sheet, ["code"], "no")
    assert sorted(tuple(r) for r in out.collect()) == [(1, "x", 1, "early")] * 2
