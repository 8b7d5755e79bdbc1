"""Encoding, scaling and cleaning on small hand-made tables."""

import pytest
from pyspark.sql import functions as F

from crivo import shared
from crivo.operators import clean, encode
from crivo.sources import sinks


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def codes(labels):
    return {(r["column"], r["value"]): r["code"] for r in labels.frame.collect()}


def test_income_codes(spark):
    texts = [*encode.INCOME_CODES, "xyz", None]
    df = spark.createDataFrame([(t,) for t in texts], "r string")
    assert [r[0] for r in df.select(encode.ordinal(F.col("r"))).collect()] == [0, 1, 2, 3, 4, 5, 6, -1, -1]


@pytest.mark.parametrize("window_values", [encode.WINDOW_VALUES, 0])
def test_codes_follow_code_points(spark, window_values):
    df = spark.createDataFrame([(v, "x") for v in ["b", "á", "Z", "a", "b", None]], "c string, d string")
    labels = encode.fit_labels(df, ["c", "d"], window_values=window_values)
    assert codes(labels) == {("c", "Z"): 0, ("c", "a"): 1, ("c", "b"): 2, ("c", "á"): 3, ("d", "x"): 0}
    assert labels.sizes == {"c": 4, "d": 1}


def test_range_numbering_of_many_values(spark):
    df = spark.range(20_000).select(F.col("id").cast("string").alias("c"))
    got = {v: c for (_, v), c in codes(encode.fit_labels(df, ["c"], window_values=0)).items()}
    assert got == {v: i for i, v in enumerate(sorted(map(str, range(20_000))))}


def test_unseen_and_missing_values(spark):
    fitted = encode.fit_labels(spark.createDataFrame([("a",), ("b",)], "c string"), ["c"])
    df = spark.createDataFrame([("b",), ("q",), (None,)], "c string")
    assert sorted(r[0] for r in encode.encode_labels(df, fitted, ["c"]).collect()) == [-1, -1, 1]
    own = encode.fit_labels(df, ["c"], missing_as=encode.MISSING)
    assert sorted(r[0] for r in encode.encode_labels(df, own, ["c"]).collect()) == [0, 1, 2]


def test_salted_lookup_equals_broadcast(spark, monkeypatch):
    """One value holds most rows; the shuffled join must still find every row its code."""
    df = spark.range(5000).select("id", F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("v"), F.col("id") % 50)).alias("c"))
    labels = encode.fit_labels(df, ["c"])
    wanted = rows(encode.encode_labels(df, labels, ["c"]))
    monkeypatch.setattr(shared, "BROADCAST_BYTES", 0)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        salted = encode.encode_labels(df, labels, ["c"])
        plan = salted._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" not in plan and "_salt" in plan
        assert rows(salted) == wanted
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_codes_by_group(spark):
    df = spark.createDataFrame([("f1", "a"), ("f1", "b"), ("f2", "b")], "g string, c string")
    labels = encode.fit_labels(df, ["c"], by=["g"])
    assert rows(encode.encode_labels(df, labels, ["c"])) == [("f1", 0), ("f1", 1), ("f2", 0)]


def test_one_hot_forms_agree(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (4, "c")], "id long, c string")
    labels = encode.fit_labels(df, ["c"])
    wide = encode.one_hot_wide(df, encode.category_lists(labels, ["c"]))
    assert wide.columns == ["id", "c_b", "c_c"]
    assert rows(wide) == [(1, 0, 0), (2, 1, 0), (3, 0, 0), (4, 0, 1)]
    assert rows(encode.one_hot_long(df, ["id"], labels, ["c"])) == [(2, "c_b", 1), (4, "c_c", 1)]


def test_one_hot_names_that_differ_by_case_fail(spark):
    df = spark.createDataFrame([("x",), ("A",), ("a",)], "c string")
    with pytest.raises(ValueError, match="differ only by case"):
        encode.one_hot_wide(df, {"c": ["", "A", "a"]})


def test_category_lists_are_whole(spark):
    labels = encode.fit_labels(spark.range(30), ["id"])
    assert encode.category_lists(labels, ["id"]) == {"id": sorted(map(str, range(30)))}


def test_scaling_of_constant_and_absent_columns(spark):
    df = spark.createDataFrame([(3.0, 1.0), (3.0, 5.0), (3.0, None)], "a double, b double")
    scaled = rows(encode.scale_min_max(df, ["a", "b", "absent"]).na.fill(-9))
    assert scaled[0] == (0.0, -9.0) and scaled[1] == (0.0, 0.0) and scaled[2][1] == pytest.approx(1.0)


def test_bounds_by_group_without_values(spark):
    df = spark.createDataFrame([("f1", 1.0), ("f1", 4.0), ("f2", None)], "g string, a double")
    assert rows(encode.min_max_by(df, ["a"], "g")) == [("f1", "a", 1.0, 4.0), ("f2", "a", None, None)]
    assert rows(encode.merged_bounds(encode.min_max_by(df, ["a"], "g"))) == [("a", 1.0, 4.0)]


def test_label_report_and_json(spark, tmp_path):
    df = spark.range(20).select(F.format_string("v%02d", "id").alias("c"), F.lit('q"x').alias("d"))
    labels = encode.fit_labels(df, ["c", "d"])
    report = encode.label_report(labels, ["c", "e"]).collect()
    assert len(report) == 16
    assert {r["more"] for r in report if r["column"] == "c"} == {5}
    assert [tuple(r) for r in report if r["column"] == "e"] == [("e", None, None, None)]
    sinks.write_labels(labels, ["c", "d", "e"], str(tmp_path / "one"))
    import json
    text = "".join(p.read_text() for p in (tmp_path / "one").glob("*.txt"))
    assert json.loads(text) == {"c": {f"v{i:02d}": i for i in range(20)}, "d": {'q"x': 0}}
    sinks.write_labels(labels, ["c", "d"], str(tmp_path / "many"), one_object=False)
    assert spark.read.json(str(tmp_path / "many")).count() == 21


def test_names(spark):
    df = spark.createDataFrame([(1, 2)], [" Cor / Raça ", "Matrícula"])
    assert clean.normalize_names(df).columns == ["Cor / Raca", "Matricula"]
    with pytest.raises(ValueError, match="collide"):
        clean.normalize_names(spark.createDataFrame([(1, 2)], ["ação", "acao"]))


def test_target(spark):
    df = spark.createDataFrame([(" Evadidos ",), ("Evadidos",), ("Em Curso",), (None,), ("\tEvadidos\n",)], "s string")
    flagged = clean.binary_target(df, "s", "Evadidos", "y")
    assert [r["y"] for r in flagged.collect()] == [1, 1, 0, 0, 1]
    assert clean.exclude_values(df, "s", ["Em Curso"]).count() == 4
    assert clean.exclude_values(df, "s", []).count() == 5


def test_dropping_columns(spark):
    df = spark.createDataFrame([(1, 2, 3)], ["a", "b.c", "d"])
    assert clean.drop_present(df, ["b.c", "x"]).columns == ["a", "d"]
    with pytest.raises(KeyError, match="x"):
        clean.drop_strict(df, ["a", "x"])


def test_incomplete_rows_and_numbers(spark):
    df = spark.createDataFrame([(1.0, "a"), (float("nan"), "a"), (None, "a"), (-2.0, None)], "x double, s string")
    assert rows(clean.drop_incomplete(df)) == [(1.0, "a")]
    nulls = spark.createDataFrame([(-1, None), (None, 2.5)], "a int, b double")
    assert rows(clean.clip_negative(clean.fill_zero(nulls))) == [(0, 0.0), (0, 2.5)]
    kept = clean.clip_negative(nulls).collect()
    assert [tuple(r) for r in kept] == [(0, None), (None, 2.5)]


def test_profile(spark):
    df = spark.createDataFrame([(1, "a", -0.5), (None, "b", 2.0)], "a int, s string, x double")
    got = {r["column"]: tuple(r)[1:] for r in clean.column_profile(df).collect()}
    assert got == {"a": ("number", 2, 1, True, False), "s": ("text", 2, 0, False, False), "x": ("number", 2, 0, False, True)}


def test_to_numbers(spark):
    df = spark.createDataFrame([("1.5", "NA", True)], "a string, b string, y boolean")
    assert rows(clean.to_numbers(df, "y")) == [(1.5, None, 1)]


def test_clean_text_touches_text_only(spark):
    df = spark.createDataFrame([(1, "ção", "ﬁm"), (2, None, "x")], "n long, a string, b string")
    assert rows(clean.clean_text(df).na.fill("-")) == [(1, "cao", "fim"), (2, "-", "x")]
