"""Documented examples and edge cases of the expression libraries."""

import math

import pytest
from pyspark.sql import functions as F

from rulewright.functions import scores, text
from rulewright.operators import corpus, labels, rules, splits
from rulewright.sources import readers, sinks


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("said", "bounds"),
    [("49점 이하", (0, 49)), ("50-64점", (50, 64)), ("50~64 점", (50, 64)), ("80점 이상", (80, 100)), ("75-10점", None), ("", None), (None, None), ("없음", None)],
)
def test_range_text(spark, said, bounds):
    got = one(spark, rules.parse_range(F.lit(said).cast("string")))
    assert (None if got is None else tuple(got)) == bounds


@pytest.mark.parametrize(("left", "right", "held"), [(95, 70, True), (95, 95, False), (95, 50, False), (None, 70, False)])
def test_bilateral(spark, left, right, held):
    clauses = rules.compile_bilateral(F.lit("양쪽 볼 모두 60점 이상이면서\n한쪽 볼에서 89점 이하"))
    assert one(spark, rules.eval_bilateral(clauses, F.lit(left).cast("double"), F.lit(right).cast("double"))) is held


@pytest.mark.parametrize(("values", "held"), [((60, 40, 40), True), ((60, 40, 20), False)])
def test_weighted(spark, values, held):
    names = ["볼처짐", "팔자주름", "입가·턱주름"]
    c = F.lit("볼처짐 + 팔자주름 + 0.5*입가·턱주름 115-250점")
    m = F.create_map(*(x for n, v in zip(names, values, strict=True) for x in (F.lit(n), F.lit(float(v)))))
    assert one(spark, rules.eval_condition(c, rules.compile_condition(c, names), m)) is held


@pytest.mark.parametrize(("said", "bounds"), [("29세 이하", (0, 29)), ("30-39세", (30, 39)), ("30세 이상", (30, 999)), ("all", (0, 999)), (None, (0, 999))])
def test_age_text(spark, said, bounds):
    assert tuple(one(spark, scores.age_bounds(F.lit(said).cast("string")))) == bounds


def test_value_between_integer_bounds_matches_no_rule(spark):
    r = spark.createDataFrame([("a", 1, "49점 이하"), ("a", 2, "50-64점")], "category string, rule_no int, condition string")
    s = spark.createDataFrame([(1, "a", 49.5), (2, "a", 49.0), (3, "b", 1.0), (4, "a", None)], "id int, category string, score double")
    assert [x["id"] for x in rules.match_ranges(s, r, ["id"], "category", "score").collect()] == [2]
    assert [x["id"] for x in rules.gap_report(s, r, ["id"], "category", "score").collect()] == [1]


def test_text_edges(spark):
    assert one(spark, text.clean(F.lit(" a\r\n\n\n\nb\t"))) == "a\n\nb"
    assert one(spark, text.slug(F.lit("  "))) == "EMPTY"
    assert one(spark, text.pad_id(F.lit("12345"))) == "12345"
    assert one(spark, text.year_of(F.lit("Spring 1998 Jan"))) == 1998
    assert one(spark, text.byte_literal(F.lit("b'x'"))) == "x"
    assert one(spark, text.block_text(F.lit('[{"type":"text","text":"a"},{"type":"image"},{"text":"b"}]'))) == "a\nb"
    assert one(spark, text.gender_word(F.lit("여자 환자"))) == "female"
    assert one(spark, text.gender_word(F.lit("여성 환자"))) is None
    assert one(spark, text.image_path(F.lit("see 경로: 'a/b.webp', now"))) == "a/b.webp"
    assert one(spark, text.image_path(F.lit("img = x.bmp"))) == "x.bmp"
    assert one(spark, text.scored_line(F.expr("array(struct('b' as name, 2.0D as score), struct('a' as name, 1.5D as score))"))) == "a 1.5, b 2.0"
    assert one(spark, text.trimmed_lines(F.lit(" a \n\n b"))) == "a / b"


def test_score_edges(spark):
    assert one(spark, scores.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) == 0.0
    assert one(spark, scores.argmax(F.array(F.lit(1), F.lit(3), F.lit(3)))) == 1
    assert one(spark, scores.real_or(F.lit(-1), F.lit(4))) == 4
    assert one(spark, scores.mean_unless_top(4, F.lit(4), F.lit(0))) == 4
    assert one(spark, scores.lookup(F.lit("z"), {"a": 1})) == -1
    assert one(spark, scores.stars(F.lit(0.004))) == "**"
    # Bounds that coincide: all above them is at the top, as with a tiny width.
    assert one(spark, scores.robust_score(F.lit(5.0), F.lit(1.0), F.lit(1.0))) == 10.0
    assert one(spark, scores.robust_score(F.lit(1.0), F.lit(1.0), F.lit(1.0))) == 0.0
    box = F.expr("named_struct('xmin', 5, 'ymin', 5, 'xmax', 9, 'ymax', 9)")
    assert one(spark, scores.rebase(box, F.expr("named_struct('xmin', 2, 'ymin', 3)"))) == (3, 2, 7, 6)
    assert [round(v, 6) for v in one(spark, scores.euler(F.array(*(F.lit(float(v)) for v in (1, 0, 0, 0, 1, 0, 0, 0, 1)))))] == [0.0, 0.0, 0.0]
    c, s = math.cos(0.5), math.sin(0.5)
    for k, m in enumerate(((1, 0, 0, 0, c, -s, 0, s, c), (c, 0, s, 0, 1, 0, -s, 0, c), (c, -s, 0, s, c, 0, 0, 0, 1))):
        turned = one(spark, scores.euler(F.array(*(F.lit(float(v)) for v in m))))
        assert [round(v, 6) for v in turned] == [0.5 if i == k else 0.0 for i in range(3)]
    with pytest.raises(Exception, match="unknown value"):
        one(spark, scores.normalise_strict(F.lit("x"), {"male": ["M"]}))


def test_corpus_folds_combine(spark):
    rows = [("p", 1, 1, "", "q1"), ("p", 2, 2, "T", "q2"), ("p", 3, 3, "U", "q1"), (None, 1, 4, "X", "q"), *(("r", i, 10 + i, None, f"q{i}") for i in range(10))]
    df = spark.createDataFrame(rows, "k string, ts int, id int, title string, q string")
    fold = lambda d: corpus.fold_sightings(d, "k", "ts", "id", ["title"], "q")
    whole = {r["k"]: r for r in fold(df).collect()}
    parts = corpus.merge_folds(fold(df.where("ts < 3")), fold(df.where("ts >= 3")), "k", ["title"])
    assert {r["k"]: r for r in parts.select(*fold(df).columns).collect()} == whole
    assert whole["p"]["title"] == "T"
    assert whole["r"]["queries"] == [f"q{i}" for i in range(2, 10)]


def test_splits_hold_quotas(spark):
    df = spark.range(1003).withColumn("c", F.col("id") % 3).unionByName(spark.createDataFrame([(5000, 9)], "id long, c long"))
    n = {(r["c"], r["split"]): r["count"] for r in splits.stratified(df, ["c"], "id").groupBy("c", "split").count().collect()}
    assert n[(9, "train")] == 1
    assert all(abs(n[(c, "test")] - 33.4) < 1 and abs(n[(c, "val")] - 33.4) < 1 for c in range(3))
    assert splits.leaks(splits.grouped(df, "id"), "id").isEmpty()


def test_rank_classes_are_even(spark):
    df = spark.createDataFrame([(i, float(i % 7)) for i in range(53)] + [(99, None)], "id long, v double")
    got = [r["count"] for r in labels.rank_classes(df, "v", "id").where("rank_class >= 0").groupBy("rank_class").count().collect()]
    assert len(got) == 10
    assert max(got) - min(got) <= 1


def test_files(spark, tmp_path):
    d = spark.createDataFrame([("ds1", "train", "u1", 1), ("ds1", "val", "u2", 2)], "dataset string, split string, user_id string, n int")
    sinks.write_splits(d, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2
    (tmp_path / "a").mkdir()
    (tmp_path / "a/age_train.json").write_text('[{"user_id": 7, "n": 1}]')
    m = readers.read_manifests(spark, [str(tmp_path / "a")], "age", "train", "user_id string, n int").collect()
    assert [(r["user_id"], r["dataset"], r["split"]) for r in m] == [("7", "a", "train")]
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        readers.read_manifests(spark, [str(tmp_path / "no")], "age", "train", "user_id string").collect()
    (tmp_path / "e").mkdir()
    (tmp_path / "e/F_00.json").write_text('{"1": {"x": "a", "y": "b"}}')
    (tmp_path / "e/F_01.json").write_text('{"1": {"x": "c"}}')
    assert readers.read_entity_files(spark, str(tmp_path / "e"), ["x", "y"]).first().asDict() == {"id": "1", "x": "c", "y": "b"}
    (tmp_path / "img").mkdir()
    (tmp_path / "img/b.png").write_bytes(b"1")
    (tmp_path / "img/a.txt").write_bytes(b"1")
    assert [r["path"][-5:] for r in readers.list_files(spark, str(tmp_path / "img")).collect()] == ["b.png"]
    assert one(spark, sinks.rewrite_path(F.lit("/v0.2/train/a"), {"v0.2": "v0.3", "train": "val"})) == "/v0.3/val/a"
    with pytest.raises(ValueError, match="missing rule sheets"):
        readers.load_rules({}, ["a"])
