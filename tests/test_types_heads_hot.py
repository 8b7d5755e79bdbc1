"""Types that lose nothing, bounded reads of headers, and joins spread by measure."""

import gzip
import math
from fractions import Fraction

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from crivo.functions import numbers
from crivo.operators import encode
from crivo.shared import hot_keys, key_hash, lookup
from crivo.sources import files

CASES = {
    # name: values, type by number, type by text
    "letters": (["1d", "2f", "2d"], "string", "string"),
    "codes": (["12345678901234567890", "12345678901234567891", "12345678901234567892"], "decimal(38,0)", "decimal(38,0)"),
    "zeros": (["007", "7"], "bigint", "string"),
    "whole": (["0", "-12", "9223372036854775807"], "bigint", "bigint"),
    "beyond": (["9223372036854775808", "1"], "decimal(38,0)", "decimal(38,0)"),
    "halves": (["0.5", "2", "1e3", "-3."], "double", "string"),
    "written": (["0.5", "2.0", "-1.25"], "double", "double"),
    "long": (["0.1234567890123456789", "1"], "decimal(38,19)", "string"),
    "money": (["1234567890123456.25", "0.10"], "decimal(38,2)", "decimal(38,2)"),
    "too_long": (["1" * 39, "1"], "string", "string"),
    "too_wide": (["1" * 30, "0." + "1" * 9], "string", "string"),
    "huge": (["1e400", "1"], "string", "string"),
    "tiny": (["1e-400", "1"], "string", "string"),
    "words": (["NaN", "Infinity"], "string", "string"),
    "hex": (["0x1F", "1"], "string", "string"),
    "blanks": ([" 12 ", "3"], "bigint", "string"),
    "shortest": (["0.30000000000000004", "1.7976931348623157E308"], "double", "double"),
    "missing": ([None, None], "string", "string"),
    "comma": (["1,5", "2"], "string", "string"),
    "sign": (["+5", "-0"], "bigint", "string"),
}


def test_types_give_every_number_back(spark):
    length = max(len(v) for v, _, _ in CASES.values())
    lines = [tuple(v[i] if i < len(v) else None for v, _, _ in CASES.values()) for i in range(length)]
    df = spark.createDataFrame(lines, ", ".join(f"{c} string" for c in CASES))
    assert files.infer_types(df, {}) == {c: kind for c, (_, kind, _) in CASES.items()}
    assert files.infer_types(df, {}, exact_text=True) == {c: kind for c, (_, _, kind) in CASES.items()}
    for exact in (False, True):
        types = files.infer_types(df, {}, exact_text=exact)
        assert files.misfits(df, types).agg(F.sum("lost")).first()[0] in (0, 2 if exact else 0)
    typed = files.apply_types(df, files.infer_types(df, {}))
    for name in ("letters", "codes", "beyond", "halves", "long", "money"):
        assert typed.select(name).where(f"{name} is not null").distinct().count() == len(CASES[name][0])


def number_of(text):
    return Fraction(text.strip().rstrip(".")) if text.strip().rstrip(".") else None


@settings(max_examples=25, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.one_of(
    st.floats(allow_nan=False, allow_infinity=False).map(repr), st.integers().map(str),
    st.decimals(allow_nan=False, allow_infinity=False, places=9).map(str), st.from_regex(r"\A[+-]?[0-9]{0,25}\.[0-9]{1,25}(e[+-]?[0-9]{1,3})?\Z")), min_size=1, max_size=40))
def test_what_fits_comes_back_as_the_same_number(spark, texts):
    c = F.col("t")
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(
        "t", numbers.is_whole(c).alias("whole"), numbers.is_double(c).alias("double"), c.try_cast("double").cast("string").alias("s"),
        numbers.is_decimal(c, 38, 9).alias("decimal"), c.try_cast("bigint").alias("b"), c.try_cast("double").alias("d"), c.try_cast("decimal(38,9)").alias("n"))
    for r in df.collect():
        want = number_of(r["t"])
        if r["whole"]:
            assert r["b"] == want
        if r["double"]:
            assert want in (Fraction(r["s"]), Fraction(repr(r["d"]))) and math.isfinite(r["d"])
        if r["decimal"]:
            assert Fraction(r["n"]) == want


def test_declared_types_that_lose_values_are_errors(spark):
    df = spark.createDataFrame([("1d",), ("2",)], "Idade string")
    with pytest.raises(ValueError, match="Idade"):
        files.infer_types(df)
    assert files.misfits(df, {"Idade": "double"}).first()["lost"] == 1


# ---- headers

def bytes_read(spark):
    return sum(s.getBytesRead() for s in spark._jvm.org.apache.hadoop.fs.FileSystem.getAllStatistics())


def read_for_headers(spark, folder):
    listed = files.input_files(spark, f"{folder}/*.csv")
    before = bytes_read(spark)
    found = files.headers(spark, listed)
    return found, bytes_read(spark) - before


def test_headers_cost_bytes_by_file_not_by_size(spark, tmp_path):
    costs = {}
    for name, count, lines in (("few", 4, 10_000), ("long", 4, 200_000), ("many", 16, 10_000)):
        (tmp_path / name).mkdir()
        for i in range(count):
            (tmp_path / name / f"{i}.csv").write_text(f"a;b{i}\n" + "12345;67890\n" * lines)
        found, costs[name] = read_for_headers(spark, tmp_path / name)
        assert sorted(found.values()) == sorted(("a", f"b{i}") for i in range(count))
    # The local store's client reads 64 KB ahead.
    assert costs["long"] == costs["few"] <= 4 * (64 << 10)
    assert costs["many"] == 4 * costs["few"]


def test_headers_of_odd_files(spark, tmp_path):
    wide = ";".join(f"column {i}" for i in range(3000))
    texts = {
        "bom": "﻿x;y\r\n1;2\r\n", "wide": wide + "\n" + "1;" * 2999 + "1\n", "broken": '"a\nb";c\n1;2\n', "blank": "x;y\n\n  \n" + "\n" * 30_000 + "1;2\n",
        "none": "x;y\n\n\n", "empty": "", "no_end": "x;y",
    }
    for name, text in texts.items():
        (tmp_path / f"{name}.csv").write_text(text, encoding="utf-8", newline="")
    with gzip.open(tmp_path / "packed.csv.gz", "wt") as file:
        file.write("p;q\n" + "1;2\n" * 50_000)
    listed = [f"file:{tmp_path}/{name}.csv" for name in texts] + [f"file:{tmp_path}/packed.csv.gz"]
    found = dict(zip([*texts, "packed"], files._first_lines(spark, listed, ";").values()))
    assert found["bom"] == (("x", "y"), True) and found["packed"] == (("p", "q"), True)
    assert found["wide"] == (tuple(wide.split(";")), True)
    assert found["blank"] == (("x", "y"), True) and found["none"] == found["no_end"] == (("x", "y"), False)
    assert found["empty"] == ((), False) and found["broken"][1]
    read = files.read_files(spark, f"{tmp_path}/packed.csv.gz")
    assert read.count() == 50_000


# ---- heavy keys

def skewed(spark, n):
    """A third of the rows has one key, a third a null, the others are apart."""
    key = F.when(F.col("id") % 3 == 0, F.lit(-1)).when(F.col("id") % 3 == 1, F.col("id"))
    return spark.range(0, n, 1, 8).select(key.alias("k"), F.col("id").alias("v"))


@pytest.mark.parametrize("tasks", [12, 48])
@pytest.mark.parametrize("n", [6_000, 60_000])
def test_heavy_keys_get_salts_by_their_share(spark, tasks, n):
    df = skewed(spark, n)
    hot = hot_keys(df, {"k": ["k"]}, tasks)["k"]
    codes = {r["k"]: r["h"] for r in spark.createDataFrame([(-1,), (None,)], "k long").select("k", key_hash(["k"]).alias("h")).collect()}
    assert set(hot) == set(codes.values())
    assert all(tasks / 3 <= salts <= tasks / 3 + 1 for salts in hot.values())


@pytest.mark.parametrize("tasks", [6, 24])
def test_a_heavy_key_is_spread_over_as_many_tasks_as_it_needs(spark, tasks):
    df = skewed(spark, 60_000)
    table = spark.range(-1, 60_000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w"))
    old = {c: spark.conf.get(c) for c in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        for c, v in zip(old, (str(tasks), "false", "-1")):
            spark.conf.set(c, v)
        found = lookup(df, table, ["k"], None, hot=hot_keys(df, {"k": ["k"]})["k"])
        placed = found.select("k", "w", F.spark_partition_id().alias("p")).persist()
        assert placed.count() == 60_000 and placed.where("w is not distinct from k * 2").count() == 60_000
        largest = placed.groupBy("p").count().agg(F.max("count")).first()[0]
        plain = df.join(table, "k", "left").groupBy(F.spark_partition_id().alias("p")).count().agg(F.max("count")).first()[0]
        # A salt is a task's share; hashing may put a few in one task.
        assert largest <= 6 * 60_000 / tasks < plain * (6 if tasks == 6 else 1)
        lines = found.where("k = -1").select(F.spark_partition_id()).distinct().count()
        assert lines >= tasks / 6
        placed.unpersist()
    finally:
        for c, v in old.items():
            spark.conf.set(c, v)


def test_salts_leave_rows_and_columns_as_they_are(spark):
    df = skewed(spark, 3_000).withColumn("m", F.create_map(F.lit("a"), F.col("v")))
    table = spark.createDataFrame([(-1, "x"), (1, "y")], "k long, w string")
    found = lookup(df, table, ["k"], None, hot=hot_keys(df, {"k": ["k"]}, 8)["k"])
    assert found.columns == ["k", "v", "m", "w"]
    assert found.groupBy("w").count().orderBy("w").collect() == [(None, 1999), ("x", 1000), ("y", 1)]
    assert hot_keys(df.limit(0), {"k": ["k"]}) == {"k": {}}


def test_labels_beyond_the_broadcast_bound_are_measured(spark):
    df = skewed(spark, 3_000).withColumn("s", F.concat(F.lit("s"), F.col("k"))).withColumn("g", F.col("v") % 2)
    for by in ([], ["g"]):
        labels = encode.fit_labels(df, ["k", "s"], by=by, missing_as="nan")
        small = encode.encode_labels(df, labels, ["k", "s"])
        large = encode.encode_labels(df, labels, ["k", "s"], most_bytes=0)
        assert "BroadcastHashJoin" not in large._jdf.queryExecution().optimizedPlan().toString()
        assert sorted(small.collect()) == sorted(large.collect())
