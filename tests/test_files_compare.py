"""Reading, uniting, writing and comparing."""

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from crivo import shared
from crivo.operators import align, clean, compare, logit
from crivo.operators.clean import ABSENT
from crivo.plans import batch
from crivo.sources import files, sinks


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture()
def folder(tmp_path):
    (tmp_path / "m_2021.csv").write_text("Código;Situação ;Idade\n1;a;20\n2;NA;x\n", encoding="utf-8")
    (tmp_path / "m_2022.csv").write_text('Idade;Código;Preço\n30;3;"1;5"\n;4;"q""x"\n', encoding="utf-8")
    (tmp_path / "m_2023.csv").write_text("Código;Situação ;Idade\n", encoding="utf-8")
    return str(tmp_path)


def test_files_match_by_name_not_by_position(spark, folder):
    df = files.read_files(spark, f"{folder}/*.csv").select("Codigo", "Situacao", "Idade", "Preco", "source_file")
    assert rows(df.na.fill("-")) == [
        ("1", "a", "20", "-", "m_2021"), ("2", "-", "x", "-", "m_2021"),
        ("3", "-", "30", "1;5", "m_2022"), ("4", "-", "-", 'q"x', "m_2022"),
    ]


def test_fill_does_not_touch_real_missing_values(spark, folder):
    df = files.read_files(spark, f"{folder}/*.csv", fill=0)
    got = {r["Codigo"]: (r["Situacao"], r["Preco"]) for r in df.collect()}
    assert got == {"1": ("a", "0"), "2": (None, "0"), "3": ("0", "1;5"), "4": ("0", 'q"x')}


def test_types_fit_every_value(spark, folder):
    df = files.read_files(spark, f"{folder}/*.csv").drop(ABSENT)
    with pytest.raises(ValueError, match="Idade"):
        files.infer_types(df)
    types = files.infer_types(df, allow_loss=True)
    assert types == {"Codigo": "bigint", "Situacao": "string", "Idade": "double", "Preco": "string"}
    assert rows(files.misfits(df, types)) == [("Codigo", "bigint", 0), ("Idade", "double", 1)]
    typed = files.apply_types(df, types)
    assert sorted((r["Codigo"], r["Idade"]) for r in typed.collect())[:2] == [(1, 20.0), (2, None)]


def test_types_of_values_far_down_and_of_later_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x;y\n" + "1;1\n" * 1500 + "2.5;z\n" * 500)
    (tmp_path / "b.csv").write_text("x;only_z\n7;9\n")
    df = files.read_files(spark, f"{tmp_path}/*.csv")
    types = files.infer_types(df)
    assert types == {"x": "double", "y": "string", "only_z": "bigint"}
    assert files.apply_types(df, types).where("x is null").count() == 0


def test_a_column_that_a_file_lacks_costs_no_rows(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x;y\n" + "1;2\n" * 5)
    (tmp_path / "b.csv").write_text("x;y;z\n" + "1;2;3\n" * 4 + "1;2;\n")
    kept = clean.drop_incomplete(files.read_files(spark, f"{tmp_path}/*.csv"))
    assert rows(kept.groupBy("source_file").count()) == [("a", 5), ("b", 4)]


@pytest.mark.parametrize("line", ["1;2;3;4", "5;6", '7;"a\nb";9'])
def test_malformed_records_fail(spark, tmp_path, line):
    (tmp_path / "a.csv").write_text(f"x;y;z\n1;2;3\n{line}\n")
    df = files.read_files(spark, f"{tmp_path}/*.csv")
    for chosen in (df, df.select("x"), df.groupBy("y").count()):
        with pytest.raises(Exception, match="malformed record"):
            chosen.collect()
    dropped = files.read_files(spark, f"{tmp_path}/*.csv", malformed="drop")
    assert dropped.select("x").collect()[0]["x"] == "1"
    assert files.malformed_records(spark, f"{tmp_path}/*.csv").first()["malformed"] >= 1


def test_quoted_line_breaks(spark, tmp_path):
    (tmp_path / "a.csv").write_text('x;y\n1;"a\nb"\n2;c\n')
    df = files.read_files(spark, f"{tmp_path}/*.csv", multi_line=True)
    assert rows(df.select("x", "y")) == [("1", "a\nb"), ("2", "c")]


def test_files_of_one_name_in_two_folders_are_two_sources(spark, tmp_path):
    for folder in ("one", "two"):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "part.csv").write_text("x\n1\n")
    found = [r[0] for r in files.read_files(spark, f"{tmp_path}/*/*.csv").select("source_file").distinct().collect()]
    assert sorted(f.rsplit("/", 2)[-2:] for f in found) == [["one", "part"], ["two", "part"]]


def test_no_rows_at_all_fail(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x;y\n")
    (tmp_path / "b.csv").write_text("")
    with pytest.raises(ValueError, match="holds data"):
        files.read_files(spark, f"{tmp_path}/*.csv")


def test_missing_input_fails(spark, folder):
    with pytest.raises((AnalysisException, FileNotFoundError)):
        files.read_files(spark, f"{folder}/none_*.csv")


def test_headers_only(spark, folder):
    found = files.headers(spark, files.input_files(spark, f"{folder}/*.csv"))
    assert [f.rsplit("/", 1)[1] for f in found] == ["m_2021.csv", "m_2022.csv", "m_2023.csv"]
    assert list(found.values())[1] == ("Idade", "Código", "Preço")


def test_empty_files_are_named(spark, folder):
    with pytest.warns(UserWarning, match="m_2023"):
        df = files.read_files(spark, f"{folder}/*.csv")
    listed = spark.createDataFrame([(f"m_{y}",) for y in (2021, 2022, 2023)], "source_file string")
    assert rows(align.empty_sources(df, listed)) == [("m_2023",)]
    with pytest.raises(ValueError, match="holds data"):
        align.require_rows(df.where("Codigo = 'none'"))


def test_parts_round_trip(spark, folder, tmp_path):
    df = files.read_files(spark, f"{folder}/*.csv").select("Codigo", "Idade", "source_file")
    sinks.write_partitions(df, str(tmp_path / "parts"))
    back = spark.read.parquet(str(tmp_path / "parts"))
    assert rows(back.na.fill("-")) == rows(df.na.fill("-"))
    audit = sinks.write_consolidated(back, str(tmp_path / "whole"))
    assert rows(audit) == [("(total)", 4, 2), ("m_2021", 2, 2), ("m_2022", 2, 2)]
    sinks.write_delimited_partitions(df, str(tmp_path / "csv"))
    again = files.read_encoded(spark, f"{tmp_path}/csv/*/*.csv", "Codigo")
    assert again.schema["Codigo"].dataType.simpleString() == "int"
    assert rows(again.groupBy("source_file").count()) == [("m_2021", 2), ("m_2022", 2)]


def test_encoded_parts_with_other_columns(spark, tmp_path):
    (tmp_path / "a.csv").write_text("c_1,y\n1,0\nNA,1\n")
    (tmp_path / "b.csv").write_text("y,c_2\n1,1\n")
    df = files.read_encoded(spark, f"{tmp_path}/*.csv", "y").select("c_1", "c_2", "y")
    assert sorted(((r[0], r[1], r[2]) for r in df.collect()), key=str) == sorted([(1.0, 0.0, 0), (None, 0.0, 1), (0.0, 1.0, 1)], key=str)


def test_results_in_one_file_or_several(spark, tmp_path):
    df = spark.range(10).select(F.concat(F.lit("f"), "id").alias("feature"), F.rand(1).alias("s"))
    sinks.write_result(df, str(tmp_path / "one"), [F.col("s").desc()])
    written = list((tmp_path / "one").glob("*.csv"))
    assert len(written) == 1
    values = [float(line.split(",")[1]) for line in written[0].read_text().splitlines()[1:]]
    assert len(values) == 10 and values == sorted(values, reverse=True)
    sinks.write_result(df, str(tmp_path / "many"), single_file=False)
    assert spark.read.csv(str(tmp_path / "many"), header=True).count() == 10


def test_aligned_union_keeps_rows(spark):
    a = spark.createDataFrame([(1, None)], "x int, y int")
    b = spark.createDataFrame([(5,), (6,)], "z int")
    assert align.all_columns([a, b]) == ["x", "y", "z"]
    assert sorted(map(str, align.aligned_union([a, b]).collect())) == sorted(map(str, [
        type(r)(**r.asDict()) for r in spark.createDataFrame([(1, None, 0), (0, 0, 5), (0, 0, 6)], "x int, y int, z int").collect()
    ]))
    assert align.consolidated([a, b]).where("x is null").count() == 2
    assert align.aligned(a, ["y"]).columns == ["y"]
    with pytest.raises(ValueError):
        align.aligned_union([])


SCHEMA = "feature string, chi2_score double, cramers_v double, p_value double"
BASE = [("a", 9.0, 0.9, 0.01), ("b", 5.0, 0.5, 0.1), ("c", 1.0, None, 0.9)]


def verdict(spark, other, schema=SCHEMA, base=BASE):
    return compare.verdict(spark.createDataFrame(base, SCHEMA), spark.createDataFrame(other, schema)).first()[0]


def test_verdicts(spark):
    filled = [r if r[2] else (r[0], r[1], 0.1, r[3]) for r in BASE]
    assert verdict(spark, BASE) == "identical"
    assert verdict(spark, list(reversed(BASE))) == "identical"
    near = [(f, s + 1e-7, v, p) for f, s, v, p in filled]
    assert verdict(spark, near, base=filled) == "equal within tolerance"
    far = [(f, s + 1e-2, v, p) for f, s, v, p in filled]
    assert verdict(spark, far, base=filled) == "different"
    assert verdict(spark, BASE[:2]) == "different"
    assert verdict(spark, [r[:3] for r in BASE], "feature string, chi2_score double, cramers_v double") == "different"
    # A column that is no metric counts too.
    extra = SCHEMA + ", note string"
    noted = [(*r, "n") for r in filled]
    a = spark.createDataFrame(noted, extra)
    assert compare.verdict(a, a).first()[0] == "identical"
    assert compare.verdict(a, a.withColumn("note", F.lit("m"))).first()[0] == "different"
    # Missing on both sides is identical, but not close once anything else differs.
    assert verdict(spark, [("a", 9.0 + 1e-7, 0.9, 0.01), *BASE[1:]]) == "different"


def test_comparison_parts(spark):
    a = spark.createDataFrame(BASE, SCHEMA)
    b = spark.createDataFrame([("a", 5.0, 0.9, 0.01), ("b", 9.0, 0.5, 0.1), ("d", 0.5, 0.2, 0.9)], SCHEMA)
    assert rows(compare.feature_differences(a, b)) == [("c", "a"), ("d", "b")]
    assert rows(compare.rank_differences(a, b, "chi2_score", "chi2_score")) == [(1, "a", "b"), (2, "b", "a"), (3, "c", "d")]
    got = {r["metric"]: tuple(r)[1:] for r in compare.error_metrics(a, b.drop("p_value")).collect()}
    assert got["chi2_score"] == (4.0, 16.0, 4.0) and got["cramers_v"] == (0.0, 0.0, 0.0) and len(got) == 2
    assert compare.shapes(a, b).first()["same_shape"]
    assert not compare.same_columns(a, b.drop("p_value"))
    assert compare.column_differences(a, b.drop("p_value")) == [("p_value", "a")]
    assert compare.error_metrics(a.select("feature"), b).count() == 0


def test_writes_by_source_keep_rows_and_settings(spark, tmp_path):
    keys = ("spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.maxConcurrentOutputFileWriters")
    before = [spark.conf.get(k) for k in keys]
    with pytest.raises(ValueError), shared.spread_writes(spark):
        # Without open files for several sources a task sorts all its rows, in memory that grows with them.
        assert int(spark.conf.get(keys[1])) >= shared.OPEN_FILES and int(spark.conf.get(keys[0])) <= shared.PIECE_BYTES
        raise ValueError
    assert [spark.conf.get(k) for k in keys] == before
    # More sources than open files in a task, with signs in their names.
    n = 3 * shared.OPEN_FILES
    df = spark.range(20 * n).select(F.concat(F.lit("v"), "id").alias("A"), F.concat(F.lit("s +%2B"), F.col("id") % n).alias("source_file")).coalesce(1)
    sinks.write_delimited_partitions(df, f"{tmp_path}/csv")
    again = files.read_files(spark, f"{tmp_path}/csv/*/*.csv", sep=",").select("A", "source_file")
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, df.collect()))
    sinks.write_partitions(df, f"{tmp_path}/parquet")
    assert spark.read.schema(df.schema).parquet(f"{tmp_path}/parquet").exceptAll(df).count() == 0
    assert [spark.conf.get(k) for k in keys] == before


def test_a_large_source_is_written_by_several_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(shared, "PIECE_BYTES", 1_000)
    df = spark.range(100_000).repartition(8).select("id", F.lit("s").alias("source_file"))
    sinks.write_partitions(df, f"{tmp_path}/a")
    sinks.write_delimited_partitions(df, f"{tmp_path}/b")
    logit.write_by(df, f"{tmp_path}/c", "source_file")
    batch._overwrite(df, f"{tmp_path}/d")
    for name in "abcd":
        assert len(list((tmp_path / name / "source_file=s").glob("part-*"))) > 1
