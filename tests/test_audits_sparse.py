"""Audits while writing, presence of columns, streamed dictionaries, sparse one-hot rows."""

import json

import pytest
from pyspark.sql import functions as F

from crivo.operators import align, compare, encode, scores
from crivo.operators import contingency as con
from crivo.sources import sinks


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def sourced(spark, n=1000):
    return spark.range(n).select(
        F.when(F.col("id") % 10 > 0, F.concat(F.lit('s "'), F.col("id") % 3)).alias("source_file"), "id",
        F.when(F.col("id") % 4 > 0, F.col("id")).alias("x"))


@pytest.mark.parametrize("most", [1_000, 2])
def test_audit_of_a_write_reads_nothing_again(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(sinks, "MOST_SOURCES", most)
    df = sourced(spark)
    tests = {"incomplete": F.col("x").isNull(), "late": F.col("id") >= 990}
    found = sinks.write_consolidated(df, str(tmp_path / "whole"), tests=tests)
    want = [(r["source_file"], r["n"], 2, r["i"], r["l"]) for r in df.groupBy("source_file").agg(
        F.count("*").alias("n"), F.count_if(F.col("x").isNull()).alias("i"), F.count_if(F.col("id") >= 990).alias("l")).collect()]
    assert rows(found) == sorted([*want, ("(total)", 1000, 2, 250, 10)], key=str)
    assert rows(spark.read.parquet(str(tmp_path / "whole"))) == rows(df)
    none = sinks.write_consolidated(df.limit(0), str(tmp_path / "none"))
    assert rows(none) == [("(total)", 0, 2)]


def test_many_sources_are_counted_exactly(spark, tmp_path):
    df = spark.range(30_000).select(F.concat(F.lit("s"), F.col("id") % 900).alias("source_file"), "id")
    found = dict((r["source_file"], r["n_rows"]) for r in sinks.write_consolidated(df, str(tmp_path / "w")).collect())
    assert found.pop("(total)") == 30_000 and len(found) == 900 and set(found.values()) <= {33, 34}


def test_presence_follows_from_rows(spark):
    df = sourced(spark).withColumn("y", F.lit(None).cast("int"))
    found = align.presence({"one": df, "two": df.select("x"), "none": df.limit(0)})
    assert rows(found) == sorted([("source_file", "one", 1000, 900), ("id", "one", 1000, 1000), ("x", "one", 1000, 750), ("y", "one", 1000, 0), ("x", "two", 1000, 750)], key=str)
    both = compare.column_counts(df.select("x", "y"), df.select("id", "x"))
    assert rows(both) == sorted([("x", 750, 750, None), ("y", 0, None, "a"), ("id", None, 1000, "b")], key=str)


def test_dictionaries_are_one_object_streamed_entry_by_entry(spark, tmp_path):
    df = spark.range(40_000).select(F.concat(F.lit('v"\\'), "id").alias("big"), F.lit("ü").alias("one"), F.lit(None).cast("string").alias("none"))
    labels = encode.fit_labels(df, ["big", "one", "none"])
    sinks.write_labels(labels, ["one", "big", "none", "other"], str(tmp_path / "o"))
    files = list((tmp_path / "o").glob("*.txt"))
    text = files[0].read_text()
    assert len(files) == 1 and text.count("\n") == 40_001 and max(map(len, text.split("\n"))) < 60
    found = json.loads(text)
    assert list(found) == ["big", "one"] and found["one"] == {"ü": 0}
    assert found["big"] == {v: i for i, v in enumerate(sorted(f'v"\\{i}' for i in range(40_000)))}
    sinks.write_labels(labels, ["none"], str(tmp_path / "n"))
    assert json.loads(next((tmp_path / "n").glob("*.txt")).read_text()) == {}


@pytest.mark.parametrize("drop_first", [True, False])
def test_sparse_rows_are_the_wide_table(spark, drop_first):
    df = spark.range(300).select("id", (F.col("id") % 2).alias("y"), F.when(F.col("id") % 7 > 0, F.concat(F.lit("a"), F.col("id") % 5)).alias("a"),
                                 F.concat(F.lit("b"), F.col("id") % 3).alias("b"), F.when(F.col("id") % 3 > 0, F.col("id") / 300).alias("x"))
    labels = encode.fit_labels(df, ["a", "b"])
    layout = encode.SparseLayout.of(labels, ["a", "b"], ["x"], drop_first)
    sparse = encode.one_hot_sparse(df, labels, layout)
    names = {r["index"]: r["feature"] if r["value"] is None else f"{r['feature']}_{r['value']}" for r in layout.names(labels).collect()}
    wide = encode.one_hot_wide(df, encode.category_lists(labels, ["a", "b"]), drop_first)
    assert sorted(names) == list(range(layout.width)) and set(names.values()) == set(wide.columns) - {"id", "y"}
    want = {r["id"]: {c: r[c] for c in names.values() if r[c]} for r in wide.collect()}
    got = {r["id"]: {names[i]: v for i, v in zip(r["indices"], r["values"])} for r in sparse.collect()}
    assert got == want
    assert all(list(r["indices"]) == sorted(r["indices"]) for r in sparse.collect())
    sums = {(names[r["feature"]], r["class"]): (r["o"], r["n_class"], r["total"], r["n"]) for r in con.sparse_class_sums(sparse, "y").collect()}
    plain = {(r["feature"], r["class"]): (r["o"], r["n_class"], r["total"], r["n"]) for r in con.class_sums(wide, list(names.values()), "y").collect()}
    assert sums == {k: tuple(map(pytest.approx, v)) for k, v in plain.items()}


def test_a_column_of_very_many_values_encodes_and_scores(spark):
    df = spark.range(200_000).select(F.concat(F.lit("v"), F.col("id")).alias("c"), (F.col("id") % 2).alias("y"))
    labels = encode.fit_labels(df, ["c"])
    layout = encode.SparseLayout.of(labels, ["c"])
    found = scores.full_scores(con.sparse_class_sums(encode.one_hot_sparse(df, labels, layout), "y"))
    named = found.withColumnRenamed("feature", "index").join(layout.names(labels), "index")
    assert layout.width == 199_999 and named.count() == 199_999
    assert named.agg(F.round(F.max("chi2_score"), 3)).first()[0] == 1.0
