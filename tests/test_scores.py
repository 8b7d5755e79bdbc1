"""Scores, tests and residuals on small hand-made tables."""

import math
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.stat import ChiSquareTest
from pyspark.sql import functions as F

from crivo.operators import contingency as con
from crivo.operators import encode, rank, scores


def by_feature(df, *columns):
    return {r["feature"]: tuple(r[c] for c in columns) for r in df.collect()}


def class_sum_reference(rows, j, target):
    """Brute force over plain rows."""
    counts = Counter(r[target] for r in rows)
    total = sum(r[j] for r in rows)
    score = 0.0
    for y, n in counts.items():
        expected = n / len(rows) * total
        score += (sum(r[j] for r in rows if r[target] == y) - expected) ** 2 / expected
    return score


def full_reference(rows, j, target):
    counts = Counter(r[target] for r in rows)
    total = sum(r[j] for r in rows)
    score = 0.0
    for y, n in counts.items():
        o, e = sum(r[j] for r in rows if r[target] == y), n / len(rows) * total
        score += (o - e) ** 2 / (e + 1e-12) + ((n - o) - (n - e)) ** 2 / (n - e + 1e-12)
    return score


def test_majority_class_one_is_matched_by_key(spark):
    """Seven ones, three zeros: counts by frequency and sums by class differ in order."""
    rows = [(1.0, 1)] * 5 + [(0.0, 1)] * 2 + [(1.0, 0), (0.0, 0), (0.0, 0)]
    df = spark.createDataFrame(rows, "x double, y int")
    sums = con.class_sums(df, ["x"], "y")
    assert by_feature(scores.class_sum_scores(sums), "chi2_score")["x"][0] == pytest.approx(class_sum_reference(rows, 0, 1))
    score, v, p = by_feature(scores.full_scores(sums), "chi2_score", "cramers_v", "p_value")["x"]
    assert score == pytest.approx(full_reference(rows, 0, 1))
    assert v == pytest.approx(math.sqrt(score / 10))
    assert p == pytest.approx(math.erfc(math.sqrt(score / 2)))


def test_zero_feature_has_no_score_and_ranks_last(spark):
    df = spark.createDataFrame([(0.0, 1.0, 0), (0.0, 2.0, 1)], "z double, x double, y int")
    found = rank.ranked(scores.class_sum_scores(con.class_sums(df, ["z", "x"], "y")), "chi2_score")
    assert [r["feature"] for r in found.collect()] == ["x", "z"]
    assert by_feature(found, "chi2_score", "p_value")["z"] == (None, None)
    assert rank.top_names(found, "chi2_score", 5) == ["x"]


def test_missing_and_nan_do_not_count_and_narrow_groups_agree(spark):
    df = spark.createDataFrame([(1.0, 2.0, 0), (float("nan"), 1.0, 1), (None, 5.0, 1), (3.0, None, 0), (1.0, 1.0, None)], "a double, b double, y int")
    wide = {(r["feature"], r["class"]): r["o"] for r in con.class_sums(df, ["a", "b"], "y").collect()}
    narrow = {(r["feature"], r["class"]): r["o"] for r in con.class_sums(df, ["a", "b"], "y", width=1).collect()}
    assert wide == narrow == {("a", 0): 4.0, ("a", 1): 0.0, ("b", 0): 2.0, ("b", 1): 6.0}


def table(spark, rows):
    df = spark.createDataFrame(rows, "c string, y int")
    return con.contingency_table(df, ["c"], "y", n_classes=2)


TWO_BY_TWO = [("a", 1)] * 8 + [("a", 0)] * 2 + [("b", 1)] * 3 + [("b", 0)] * 7


def test_two_by_two_with_and_without_correction(spark):
    plain = by_feature(scores.contingency_tests(table(spark, TWO_BY_TWO), yates=False), "chi2", "dof", "p_value")["c"]
    assert plain[0] == pytest.approx(20 * (8 * 7 - 2 * 3) ** 2 / (10 * 10 * 11 * 9))
    drawn = by_feature(scores.contingency_tests(table(spark, TWO_BY_TWO)), "chi2", "dof")["c"]
    assert drawn[0] == pytest.approx(20 * (abs(8 * 7 - 2 * 3) - 10) ** 2 / (10 * 10 * 11 * 9))
    assert drawn[1] == 1


def test_correction_never_crosses_zero(spark):
    even = [("a", 1)] * 2 + [("a", 0)] * 2 + [("b", 1)] * 2 + [("b", 0)] * 2
    assert by_feature(scores.contingency_tests(table(spark, even)), "chi2")["c"] == (0.0,)


def test_empty_cell_counts_as_zero(spark):
    rows = [("a", 1)] * 4 + [("b", 0)] * 3 + [("b", 1)] * 1
    cross = {(r["value"], r["class"]): r["o"] for r in table(spark, rows).collect()}
    assert cross == {("a", 0): 0, ("a", 1): 4, ("b", 0): 3, ("b", 1): 1}
    residuals = {(r["value"], r["class"]): r["z"] for r in scores.adjusted_residuals(table(spark, rows)).collect()}
    assert residuals[("a", 0)] == pytest.approx(-residuals[("a", 1)])
    assert residuals[("a", 1)] > 0


def test_one_category_gives_no_v_and_p_one(spark):
    tests = scores.contingency_tests(table(spark, [("a", 1), ("a", 0), ("a", 0)]))
    assert by_feature(tests, "chi2", "dof", "p_value")["c"] == (0.0, 0, 1.0)
    assert by_feature(scores.cramers_v(tests), "cramers_v")["c"] == (None,)


def test_one_class_gives_no_residual(spark):
    cross = table(spark, [("a", 1), ("b", 1)])
    assert [r["z"] for r in scores.adjusted_residuals(cross).collect()] == [None, None]


def test_uncorrected_test_equals_the_model_library(spark, small_dir):
    items = spark.read.parquet(f"{small_dir}/lineitem.parquet").withColumn("y", (F.col("l_returnflag") == "R").cast("double"))
    cross = con.contingency_table(items, ["l_linestatus", "l_linenumber"], "y", n_classes=2)
    ours = by_feature(scores.contingency_tests(cross, yates=False), "chi2", "p_value")
    coded = items.withColumn("n", F.col("l_linenumber").cast("double"))
    coded = StringIndexer(inputCol="l_linestatus", outputCol="s").fit(coded).transform(coded)
    vectors = VectorAssembler(inputCols=["s", "n"], outputCol="x").transform(coded)
    theirs = ChiSquareTest.test(vectors, "x", "y").first()
    for i, name in enumerate(["l_linestatus", "l_linenumber"]):
        assert ours[name][0] == pytest.approx(theirs["statistics"][i], rel=1e-9)
        assert ours[name][1] == pytest.approx(theirs["pValues"][i], rel=1e-9)


ROWS = st.lists(st.tuples(st.sampled_from(["a", "b", "c", None, "Z"]), st.integers(0, 2)), min_size=2, max_size=40)


@settings(max_examples=6, deadline=None)
@given(ROWS)
def test_fused_one_hot_scores_equal_scores_of_real_columns(spark, rows):
    df = spark.createDataFrame(rows, "c string, y int")
    values = sorted({c for c, _ in rows if c is not None})
    fused = scores.full_scores(con.one_hot_sums(con.contingency_table(df, ["c"], "y", keep_missing=True)))
    if len(values) < 2:
        assert fused.isEmpty()
        return
    wide = encode.one_hot_wide(df, {"c": values})
    built = scores.full_scores(con.class_sums(wide, [c for c in wide.columns if c != "y"], "y"))
    a, b = by_feature(fused, "chi2_score"), by_feature(built, "chi2_score")
    assert a.keys() == b.keys()
    for name in a:
        assert a[name][0] == pytest.approx(b[name][0], abs=1e-9)


@settings(max_examples=6, deadline=None)
@given(ROWS, st.integers(1, 5))
def test_v_lies_in_unit_interval_whatever_the_partitioning(spark, rows, parts):
    df = spark.createDataFrame(rows, "c string, y int")
    def v(frame):
        return by_feature(scores.cramers_v(scores.contingency_tests(con.contingency_table(frame, ["c"], "y"))), "cramers_v")
    a, b = v(df), v(df.repartition(parts))
    assert a.keys() == b.keys()
    for name in a:
        if a[name][0] is not None:
            assert -1e-9 <= a[name][0] <= 1 + 1e-9
            assert a[name][0] == pytest.approx(b[name][0], abs=1e-9)


def test_ties_go_by_name_and_places_count(spark):
    df = spark.createDataFrame([("b", 1.0), ("a", 1.0), ("c", None), ("d", 2.0)], "feature string, s double")
    assert [r["feature"] for r in rank.head_ranks(df, "s", 10).orderBy("rank").collect()] == ["d", "a", "b", "c"]
    assert rank.top_names(df, "s", 2) == ["d", "a"]


def test_residual_preview_shows_short_tables_whole(spark):
    rows = [(f"v{i:02d}", i % 2) for i in range(20)] + [("v00", 1)]
    assert scores.residual_preview(table(spark, rows), "c").count() == 20
    longer = rows + [("v20", 0)]
    assert scores.residual_preview(table(spark, longer), "c").count() == 10


def test_total_test(spark):
    df = spark.createDataFrame([("a", 1.5), ("b", 2.5), ("c", None)], "feature string, chi2_score double")
    row = scores.total_test(df, 3).first()
    assert (row["n_features"], row["chi2_score"], row["dof"]) == (3, 4.0, 4)
    assert row["p_value"] == pytest.approx(math.exp(-2) * 3)
