"""Logistic models against plain gradient descent, and the incremental forms."""

import math
import random

import pytest
from pyspark.sql import functions as F

from crivo import shared
from crivo.operators import contingency as con
from crivo.operators import encode, logit, scores
from crivo.streaming import incremental

random.seed(3)
ROWS = [
    (random.choice(["f1", "f1", "f2"]), random.random(), random.random(), random.choice("abc"), int(random.random() < 0.4))
    for _ in range(200)
]
SCHEMA = "g string, x double, z double, c string, y int"
LR, L2 = 0.3, 0.05


def step(rows, w):
    """One full-batch step over (features, label) pairs; the intercept comes last and is not shrunk."""
    k = len(w) - 1
    grads = [0.0] * (k + 1)
    for xs, y in rows:
        e = 1 / (1 + math.exp(-(w[k] + sum(a * b for a, b in zip(w, xs))))) - y
        for i in range(k):
            grads[i] += e * xs[i]
        grads[k] += e
    return [w[i] - LR * (grads[i] / len(rows) + (L2 * w[i] if i < k else 0)) for i in range(k + 1)]


def of(group, features):
    return [(features(r), r[4]) for r in ROWS if group is None or r[0] == group]


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def test_federated(spark, df):
    want = []
    for g in ("f1", "f2"):
        w = [0.0] * 3
        for _ in range(3):
            w = step(of(g, lambda r: (r[1], r[2])), w)
        want.append(w)
    got = {r["feature"]: r["importance"] for r in logit.federated_importance(df, ["x", "z"], "y", "g", lr=LR, l2=L2, epochs=3).collect()}
    for i, name in enumerate(["x", "z"]):
        assert got[name] == pytest.approx(abs((want[0][i] + want[1][i]) / 2), rel=1e-9)


def test_incremental_follows_name_order(spark, df):
    w = [0.0] * 3
    for g in ("f1", "f2"):
        for _ in range(2):
            w = step(of(g, lambda r: (r[1], r[2])), w)
    found = logit.incremental_weights(df, ["x", "z"], "y", "g", lr=LR, l2=L2, epochs=2).first()["w"]
    assert found == pytest.approx(w, rel=1e-9)


def indicators(r):
    return (float(r[3] == "b"), float(r[3] == "c"), r[1])


def test_mixed_features_equal_built_columns(spark, df):
    models = []
    for g in ("f1", "f2"):
        w = [0.0] * 4
        for _ in range(2):
            w = step(of(g, indicators), w)
        models.append(w)
    found = logit.mixed_federated_coefficients(df, ["c"], ["x"], "y", "g", lr=LR, l2=L2, epochs=2)
    got = {r["feature"]: r["coef"] for r in found.collect()}
    assert set(got) == {"c_b", "c_c", "x"}
    for i, name in enumerate(["c_b", "c_c", "x"]):
        assert got[name] == pytest.approx((models[0][i] + models[1][i]) / 2, rel=1e-9)


def test_mixed_incremental(spark, df):
    w = [0.0] * 4
    for g in ("f1", "f2"):
        w = step(of(g, indicators), w)
    got = {r["feature"]: r["coef"] for r in logit.mixed_incremental_coefficients(df, ["c"], ["x"], "y", "g", lr=LR, l2=L2).collect()}
    assert [got[n] for n in ("c_b", "c_c", "x")] == pytest.approx(w[:3], rel=1e-9)


def test_category_absent_in_one_group_counts_as_zero(spark):
    data = [("f1", "a", 1), ("f1", "b", 0), ("f2", "a", 0), ("f2", "a", 1)]
    df = spark.createDataFrame(data, "g string, c string, y int")
    got = logit.mixed_federated_coefficients(df, ["c"], [], "y", "g", lr=1.0, l2=0.0, epochs=1).collect()
    assert [tuple(r) for r in got] == [("c_b", pytest.approx(-0.25 / 2))]


def test_empty_groups_are_skipped_in_the_mean(spark):
    coefs = spark.createDataFrame([("f1", "x", 2.0), ("f2", "x", -4.0)], "g string, feature string, coef double")
    found = logit.importance(logit.averaged(coefs)).first()
    assert (found["feature"], found["importance"]) == ("x", 1.0)


def test_global_model_finds_the_log_odds_ratio(spark, df):
    flagged = df.withColumn("b", (F.col("c") == "b").cast("double"))
    n = {(k, y): sum(1 for r in ROWS if (r[3] == "b") == k and r[4] == y) for k in (True, False) for y in (0, 1)}
    want = math.log(n[True, 1] / n[True, 0]) - math.log(n[False, 1] / n[False, 0])
    assert logit.global_coefficients(flagged, ["b"], "y").first()["coef"] == pytest.approx(want, abs=1e-5)


@pytest.fixture(scope="module")
def file_folder(spark, df, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stream")
    for i, g in enumerate(("f1", "f2")):
        df.where(F.col("g") == g).coalesce(1).write.parquet(str(folder / f"part{i}"))
    return str(folder)


def test_streamed_sums_equal_batch(spark, df, file_folder, tmp_path):
    stream = incremental.file_stream(spark, f"{file_folder}/*", df.schema)
    wide = incremental.run_to_table(incremental.running_class_sums(stream, ["x", "z"], "y"), str(tmp_path / "sums"))
    ours = {r["feature"]: r["chi2_score"] for r in scores.class_sum_scores(incremental.long_class_sums(wide, ["x", "z"])).collect()}
    batch = {r["feature"]: r["chi2_score"] for r in scores.class_sum_scores(con.class_sums(df, ["x", "z"], "y")).collect()}
    assert ours == pytest.approx(batch)
    cells = incremental.run_to_table(incremental.running_cells(stream, ["c"], "y"), str(tmp_path / "cells"))
    assert sorted(map(tuple, cells.collect())) == sorted(map(tuple, con.cell_counts(df, ["c"], "y").collect()))


def test_streamed_model_carries_weights(spark, df, file_folder, tmp_path):
    stream = incremental.file_stream(spark, f"{file_folder}/*", df.schema)
    incremental.train_on_stream(stream, ["x", "z"], "y", str(tmp_path), lr=LR, l2=L2).awaitTermination()
    steps = [p.name for p in tmp_path.glob("step=*")]
    assert sorted(steps) == ["step=0", "step=1"]
    found = incremental.latest_weights(spark, str(tmp_path)).first()["w"]
    orders = []
    for order in (("f1", "f2"), ("f2", "f1")):
        w = [0.0] * 3
        for g in order:
            w = step(of(g, lambda r: (r[1], r[2])), w)
        orders.append(w)
    assert any(found == pytest.approx(w, rel=1e-9) for w in orders)


def test_training_on_scaled_numbers_reads_bounds_once(spark, df):
    bounds = encode.min_max(df, ["x"])
    scaled = encode.scale_by(df, bounds, ["x"])
    lo, hi = scaled.agg(F.min("x"), F.max("x")).first()
    assert lo == 0.0 and hi == pytest.approx(1.0)


def test_rows_without_group_take_no_part_and_numbers_may_name_groups(spark):
    data = [(1, 0.5, 1), (1, 0.1, 0), (2, 0.9, 1), (None, 0.3, 1)]
    df = spark.createDataFrame(data, "g int, x double, y int")
    assert sorted(r["g"] for r in logit.federated_weights(df, ["x"], "y", "g", epochs=2).collect()) == ["1", "2"]
    w = [0.0, 0.0]
    for g in (1, 2):
        w = step([((r[1],), r[2]) for r in data if r[0] == g], w)
    assert logit.incremental_weights(df, ["x"], "y", "g", lr=LR, l2=L2).first()["w"] == pytest.approx(w, rel=1e-9)


def test_streamed_sums_go_on_from_the_state_and_skip_what_is_no_number(spark, tmp_path):
    schema, folder, state = "x double, y int", str(tmp_path / "in"), str(tmp_path / "state")
    days = [[(1.0, 1), (float("nan"), 0)], [(2.0, 0), (None, 1)], [(5.0, 1)]]
    for day in days:
        spark.createDataFrame(day, schema).write.mode("append").parquet(folder)
        stream = incremental.file_stream(spark, folder, spark.createDataFrame([], schema).schema, files_per_step=None)
        wide = incremental.run_to_table(incremental.running_class_sums(stream, ["x"], "y"), state)
    got = {r["class"]: (r["n_class"], r["x"]) for r in wide.collect()}
    batch = spark.createDataFrame([r for day in days for r in day], schema)
    want = {r["class"]: (r["n_class"], r["o"]) for r in con.class_sums(batch, ["x"], "y").collect()}
    assert got == want == {0: (2, 2.0), 1: (3, 6.0)}


def test_global_model_reads_a_missing_value_as_zero(spark):
    data = [(1.0, 1), (1.0, 1), (1.0, 0), (None, 0), (0.0, 0), (None, 1), (float("nan"), 0)]
    df = spark.createDataFrame(data, "x double, y int")
    filled = spark.createDataFrame([(x if x == 1.0 else 0.0, y) for x, y in data], "x double, y int")
    assert logit.global_coefficients(df, ["x"], "y").first()["coef"] == pytest.approx(logit.global_coefficients(filled, ["x"], "y").first()["coef"])


def test_features_of_one_name_stay_apart_in_training(spark):
    data = [("f", a, b, y) for a, b, y in [("b_c", "c", 1), ("b_c", "d", 1), ("a", "c", 0), ("a", "a", 0), ("a", "c", 1)]]
    df = spark.createDataFrame(data, "g string, a string, a_b string, y int")
    found = logit.mixed_federated_coefficients(df, ["a", "a_b"], [], "y", "g", lr=1.0, l2=0.0, epochs=1).collect()
    assert sorted(r["feature"] for r in found) == ["a_b_c", "a_b_c", "a_b_d"]


def test_only_own_intermediates_are_deleted(spark, tmp_path):
    ours = shared.materialize(spark.range(5), "own")
    folder = ours.inputFiles()[0].rsplit("/", 1)[0]
    other = str(tmp_path / "other")
    spark.range(3).write.parquet(other)
    shared.discard(spark, ours, spark.read.parquet(other), spark.range(2))
    assert spark.read.parquet(other).count() == 3
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(folder)


def skewed_rows(spark, n=4000):
    """Categories of very different shares, missing ones, a number, and a target that depends on them."""
    a = F.expr("case when id % 3 = 0 then 'hot' when id % 7 = 0 then null else concat('a', id % 11) end")
    x = F.when(F.col("id") % 5 > 0, (F.col("id") % 97) / 96)
    y = F.expr("cast(pmod(hash(id), 100) < 30 + 40 * int(id % 3 = 0) + int(id % 97 > 50) * 15 as int)")
    return spark.range(n).select(a.alias("a"), F.concat(F.lit("b"), F.col("id") % 4).alias("b"), x.alias("x"), y.alias("y"))


def test_quasi_newton_steps_reach_the_optimum(spark):
    df = skewed_rows(spark)
    labels = encode.fit_labels(df, ["a", "b"])
    wide = encode.one_hot_wide(df, encode.category_lists(labels, ["a", "b"])).fillna(0.0, ["x"])
    features = [c for c in wide.columns if c != "y"]
    want = {r["feature"]: r["coef"] for r in logit.global_coefficients(wide, features, "y", l2=0.01, tol=1e-10, max_iter=200).collect()}
    got = {r["feature"]: r["coef"] for r in logit.mixed_global_coefficients(df, ["a", "b"], ["x"], "y", l2=0.01, tol=1e-5).collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[c] - want[c]) < 2e-3 for c in want)


def test_global_model_of_numbers_or_categories_alone(spark):
    df = skewed_rows(spark, 500).withColumn("zero", F.lit(0.0))
    numbers = {r["feature"]: r["coef"] for r in logit.mixed_global_coefficients(df, [], ["x", "zero"], "y", l2=0.0, tol=1e-6).collect()}
    want = logit.global_coefficients(df, ["x"], "y").first()["coef"]
    assert abs(numbers["x"] - want) < 1e-4 and numbers["zero"] == 0.0
    odds = {r["feature"]: r["coef"] for r in logit.mixed_global_coefficients(df, ["b"], [], "y", l2=0.0, tol=1e-9).collect()}
    share = {r["b"]: r["p"] for r in df.groupBy("b").agg(F.avg("y").alias("p")).collect()}
    logits = {b: math.log(p / (1 - p)) for b, p in share.items()}
    assert odds == {f"b_{b}": pytest.approx(logits[b] - logits["b0"], abs=1e-5) for b in ("b1", "b2", "b3")}
    with pytest.raises(ValueError, match="target"):
        logit.mixed_global_coefficients(df.where("false"), ["b"], ["x"], "y")


def planted_rows(spark, n=20_000):
    """Features whose weight in the target falls from the first to the last; two groups."""
    x = [F.rand(i + 1).alias(f"x{i}") for i in range(4)]
    score = F.expr("4 * (x0 - 0.5) + 2.5 * (x1 - 0.5) - 1.2 * (x2 - 0.5)")
    rows = spark.range(0, n, 1, 6).select("id", *x)
    return rows.select("*", (F.rand(9) < 1 / (1 + F.exp(-score))).cast("int").alias("y"), (F.col("id") % 3).cast("string").alias("g"))


def test_models_of_one_scan_rank_as_full_batches_do(spark):
    features = [f"x{i}" for i in range(4)]
    df = planted_rows(spark).persist()
    full = [r["feature"] for r in logit.federated_importance(df, features, "y", "g", lr=1.0, epochs=12).collect()]
    found = logit.local_importance(df, features, "y", "g", lr=0.2).collect()
    assert [r["feature"] for r in found] == full == features
    best = {r["feature"]: abs(r["coef"]) for r in logit.global_coefficients(df, features, "y").collect()}
    assert sorted(best, key=best.get, reverse=True) == features
    df.unpersist()


def test_models_of_one_scan_weigh_tasks_by_their_rows(spark):
    df = planted_rows(spark, 900)
    found = {r["g"]: r["n"] for r in logit.local_weights(df, ["x0", "x1"], "y", "g").collect()}
    assert found == {"0": 300, "1": 300, "2": 300}
    one = df.coalesce(1).where("g = '0'")
    apart = logit.local_weights(one.union(one), ["x0"], "y", "g", epochs=1, batch_rows=10**6).first()
    alone = logit.local_weights(one, ["x0"], "y", "g", epochs=1, batch_rows=10**6).first()
    assert apart["n"] == 600 and apart["w"] == pytest.approx(alone["w"])
    assert logit.local_weights(df.where("false"), ["x0"], "y", "g").count() == 0
    gaps = df.withColumn("x0", F.lit(None).cast("double")).withColumn("y", F.when(F.col("id") > 5, F.col("y")))
    assert sum(r["n"] for r in logit.local_weights(gaps, ["x0"], "y", "g").collect()) == 894
