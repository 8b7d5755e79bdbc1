"""Sources processed again only where their files have changed."""

import os
import time

import pytest

from crivo.plans import batch
from crivo.plans import enrolments as en

PRESET = en.Preset(("Turno", "Sexo"))


def write_year(folder, year, n, turno="Manhã", names=("Categoria da Situação", "Turno", "Sexo")):
    values = {"Categoria da Situação": "Evadidos", "Turno": turno, "Sexo": "F", "Idade": "20"}
    lines = [";".join(names)] + [";".join(values[c] for c in names) for _ in range(n)]
    (folder / f"micro_{year}.csv").write_text("\n".join(lines) + "\n", encoding="utf-8")


def listing(out):
    return {str(p.relative_to(out)): p.stat().st_mtime_ns for p in out.rglob("*.parquet") if "_labels" not in str(p)}


def status(df):
    return sorted(tuple(r) for r in df.collect())


def counts(spark, out):
    return {r["source_file"]: r["count"] for r in batch.processed(spark, str(out)).groupBy("source_file").count().collect()}


@pytest.fixture()
def years(tmp_path):
    folder = tmp_path / "raw"
    folder.mkdir()
    for year, n in ((2020, 3), (2021, 4), (2022, 5)):
        write_year(folder, year, n)
    return folder


def test_only_a_changed_year_is_written_again(spark, years, tmp_path):
    out = tmp_path / "out"
    first = batch.process(spark, f"{years}/*.csv", str(out), PRESET)
    assert status(first) == [("micro_2020", "written", 3), ("micro_2021", "written", 4), ("micro_2022", "written", 5)]
    before = listing(out)
    again = batch.process(spark, f"{years}/*.csv", str(out), PRESET)
    assert {s for _, s, _ in status(again)} == {"kept"} and listing(out) == before
    time.sleep(0.01)
    write_year(years, 2021, 6, "Noite")
    write_year(years, 2023, 2)
    third = batch.process(spark, f"{years}/*.csv", str(out), PRESET)
    assert status(third) == [("micro_2020", "kept", 3), ("micro_2021", "written", 6), ("micro_2022", "kept", 5), ("micro_2023", "written", 2)]
    after = listing(out)
    assert {k: v for k, v in after.items() if "2020" in k or "2022" in k} == {k: v for k, v in before.items() if "2021" not in k}
    assert counts(spark, out) == {"micro_2020": 3, "micro_2021": 6, "micro_2022": 5, "micro_2023": 2}
    labels = spark.read.parquet(f"{out}/{batch.LABELS}").where("column = 'Turno'")
    assert {(r["source_file"], r["value"]) for r in labels.collect()} == {("micro_2020", "Manha"), ("micro_2021", "Noite"), ("micro_2022", "Manha"), ("micro_2023", "Manha")}


def test_a_failed_run_leaves_no_half_year(spark, years, tmp_path):
    out = tmp_path / "out"
    batch.process(spark, f"{years}/*.csv", str(out), PRESET).collect()
    before = listing(out)
    write_year(years, 2020, 9)
    with open(years / "micro_2021.csv", "a") as file:
        file.write("one;field;too;many\n")
    with pytest.raises(Exception, match="malformed record"):
        batch.process(spark, f"{years}/*.csv", str(out), PRESET)
    assert listing(out) == before and counts(spark, out) == {"micro_2020": 3, "micro_2021": 4, "micro_2022": 5}
    write_year(years, 2021, 7)
    done = batch.process(spark, f"{years}/*.csv", str(out), PRESET)
    assert status(done) == [("micro_2020", "written", 9), ("micro_2021", "written", 7), ("micro_2022", "kept", 5)]
    assert counts(spark, out) == {"micro_2020": 9, "micro_2021": 7, "micro_2022": 5}


def test_cleared_gone_and_emptied_years(spark, years, tmp_path):
    out = tmp_path / "out"
    batch.process(spark, f"{years}/*.csv", str(out), PRESET).collect()
    batch.clear(spark, str(out), ["micro_2021"])
    assert counts(spark, out) == {"micro_2020": 3, "micro_2022": 5}
    os.unlink(years / "micro_2022.csv")
    write_year(years, 2020, 0)
    found = batch.process(spark, f"{years}/*.csv", str(out), PRESET)
    assert status(found) == [("micro_2020", "written", 0), ("micro_2021", "written", 4), ("micro_2022", "gone", 5)]
    assert counts(spark, out) == {"micro_2021": 4, "micro_2022": 5}


def test_years_of_other_columns_and_one_name_in_two_folders(spark, tmp_path):
    for folder, names in (("a", ("Categoria da Situação", "Turno")), ("b", ("Sexo", "Categoria da Situação"))):
        (tmp_path / folder).mkdir()
        write_year(tmp_path / folder, 2020, 3, names=names)
    out = tmp_path / "out"
    first = batch.process(spark, f"{tmp_path}/[ab]/*.csv", str(out), PRESET)
    assert [n for *_, n in status(first)] == [3, 3]
    write_year(tmp_path / "b", 2020, 5, names=("Sexo", "Categoria da Situação", "Turno"))
    second = batch.process(spark, f"{tmp_path}/[ab]/*.csv", str(out), PRESET)
    assert [s for _, s, _ in status(second)] == ["kept", "written"]
    assert sorted(counts(spark, out).values()) == [3, 5]
    assert {c for c in batch.processed(spark, str(out)).columns} >= {"Turno", "Sexo", "source_file"}
