"""The whole screening on generated files, and the shape of the physical plans."""

import pytest
from pyspark.sql import functions as F

from crivo import shared
from crivo.operators import contingency as con
from crivo.operators import encode, logit, scores
from crivo.plans import enrolments as en
from crivo.plans import screening_queries
from crivo.plans.tables import numeric_items, returned_items
from crivo.sources import files

BANDS = ["Não declarada", "0<RFP<=0,5", "RFP>3,5", "outra"]


@pytest.fixture(scope="module")
def raw(spark, tmp_path_factory):
    """Two yearly files with other column orders; all columns of the strict preset."""
    folder = tmp_path_factory.mktemp("raw")
    names = list(dict.fromkeys([*en.UNUSED, *en.NOMINAL, en.INCOME]))
    for year in (2021, 2022):
        order = names if year == 2021 else names[::-1]
        lines = [";".join(order).replace("Matricula", "Matrícula")]
        for i in range(40):
            row = {c: f"{c[:3]}ã{i % (2 + len(c) % 3)}" for c in names}
            row["Categoria da Situacao"] = " Evadidos " if (i * 7 + year) % 3 == 0 else "Em Curso"
            row[en.INCOME] = BANDS[i % 4]
            row["Turno"] = "" if i == 5 else row["Turno"]
            lines.append(";".join(row[c] for c in order))
        (folder / f"microdados_matriculas_{year}.csv").write_text("\n".join(lines) + "\n", encoding="utf-8")
    return files.read_files(spark, f"{folder}/*.csv")


def test_label_codes_keep_incomplete_rows_in_the_strict_preset(raw):
    prepared = en.prepare(raw, en.LABELS_WITH_MISSING)
    assert prepared.table.count() == 80
    assert set(prepared.table.columns) == {*en.NOMINAL, en.INCOME, en.TARGET, "source_file"}
    missing = prepared.labels.frame.where("column = 'Turno' and value = 'nan'").count()
    assert missing == 1
    assert {r[0] for r in prepared.table.select(F.col(f"`{en.INCOME}`")).distinct().collect()} == {0, 1, 6, -1}


def test_incomplete_rows_go_in_the_other_presets(raw):
    prepared = en.prepare(raw, en.LABELS)
    assert prepared.table.count() == 78
    assert "Matricula Atendida" not in prepared.table.columns
    values = [r["value"] for r in prepared.labels.frame.collect()]
    assert all(v.isascii() for v in values)


def test_optional_exclusion(raw):
    preset = en.Preset((), exclude_situations=(en.IN_PROGRESS,))
    table = en.prepare(raw, preset).table
    assert {r[0] for r in table.select(en.TARGET).distinct().collect()} == {1}


def test_fused_and_wide_rankings_agree(spark, raw):
    fused = en.rank_full(en.store(en.prepare(raw, en.ONE_HOT)))
    wide = en.rank_wide(en.store(en.prepare(raw, en.ONE_HOT, wide=True)).table)
    a = {r["feature"]: r["chi2_score"] for r in fused.collect()}
    b = {r["feature"]: r["chi2_score"] for r in wide.collect()}
    assert a.keys() == b.keys() and len(a) > 20
    for name in a:
        assert a[name] == pytest.approx(b[name], abs=1e-9)


def test_rankings_run_from_the_written_table(spark, raw, tmp_path):
    prepared = en.store(en.prepare(raw, en.LABELS), str(tmp_path / "prepared"))
    assert en.rank_by_class_sums(prepared.table).count() == 14
    assert en.rank_by_association(prepared.table).columns == ["feature", "cramers_v"]
    assert {p.name for p in (tmp_path / "prepared").glob("source_file=*")} == {
        "source_file=microdados_matriculas_2021", "source_file=microdados_matriculas_2022"}
    assert en.rank_by_model(prepared, epochs=1).count() == 14
    assert en.rank_by_model(prepared, incremental=True).count() == 14


def executed_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_counting_reads_the_data_once_and_tests_never(spark, small_dir):
    features = ["l_linestatus", "l_linenumber", "o_orderpriority"]
    counting = executed_plan(con.cell_counts(returned_items(spark, small_dir), features, "y"))
    assert counting.split("== Initial Plan ==")[0].count("lineitem.parquet") == 1
    cross = con.contingency_table(returned_items(spark, small_dir), features, "y", n_classes=2)
    plan = executed_plan(scores.strongest_residuals(cross))
    assert "lineitem" not in plan
    for unwanted in ("CartesianProduct", "BroadcastNestedLoopJoin", "ArrowEvalPython", "BatchEvalPython"):
        assert unwanted not in counting + plan


def test_unknown_classes_join_by_feature_and_salt(spark, small_dir, monkeypatch):
    monkeypatch.setattr(shared, "BROADCAST_BYTES", 0)
    cells = con.cell_counts(returned_items(spark, small_dir), ["l_linestatus", "o_orderpriority"], "y")
    plan = con.table_of(cells, 2)._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line and "feature#" in line]
    assert joins and all("_salt" in line for line in joins)


def test_wide_class_sums_read_the_data_once(spark, small_dir):
    items = numeric_items(spark, small_dir)
    wide = con.class_sums(items, ["l_quantity", "l_tax", "l_discount"], "y", width=2)
    assert executed_plan(wide).split("== Initial Plan ==")[0].count("lineitem.parquet") == 1
    want = con.class_sums(items, ["l_quantity", "l_tax", "l_discount"], "y")
    key = lambda r: (r["feature"], r["class"])
    for a, b in zip(sorted(wide.collect(), key=key), sorted(want.collect(), key=key)):
        assert a["o"] == pytest.approx(b["o"]) and a["n_class"] == b["n_class"] and a["n"] == b["n"]


def test_training_sorts_nothing_below_the_sums(spark, small_dir):
    design = logit._design(returned_items(spark, small_dir), ["l_quantity", "l_tax"], "y", "l_linestatus")
    rows = design.withColumn("w", logit._zeros(2))
    plan = logit._sums(rows, 2, ["g"])._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "Sort [" not in plan.split("Exchange hashpartitioning(g")[0]


def test_text_features_are_encoded_before_ranking(spark):
    df = spark.createDataFrame([("a", 1.0, 1), ("b", None, 0), (None, 2.0, 1)], f"c string, x double, {en.TARGET} int")
    assert en.rank_by_class_sums(df).count() == 2


def test_class_sums_widen_nothing_before_the_shuffle(spark, small_dir):
    plan = con.class_sums(numeric_items(spark, small_dir), ["l_quantity", "l_tax"], "y")._jdf.queryExecution().executedPlan().toString()
    scan = plan[plan.rindex("HashAggregate"):]
    assert "Expand" not in scan
    assert "ReadSchema: struct<l_quantity:double,l_tax:double,l_returnflag:string>" in scan


def test_label_lookup_is_a_broadcast_join(spark, small_dir):
    parts = spark.read.parquet(f"{small_dir}/part.parquet")
    coded = encode.encode_labels(parts, encode.fit_labels(parts, ["p_brand"]), ["p_brand"])
    plan = coded._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_scaling_finds_all_bounds_in_one_subquery(spark, small_dir):
    items = numeric_items(spark, small_dir)
    scaled = encode.scale_min_max(items, ["l_quantity", "l_tax", "l_discount"])
    plan = executed_plan(scaled.select("l_quantity", "l_tax", "l_discount"))
    final = plan.split("\n+- == Initial Plan ==")[0]
    lines = [line.strip(" :+-") for line in final.splitlines()]
    assert sum(line.startswith("Subquery") for line in lines) == 1
    assert any(line.startswith("ReusedSubquery") for line in lines)


def test_global_ranking_equals_newton_steps(spark, small_dir):
    """One model over scaled label codes, against plain Newton steps in numpy."""
    import numpy as np

    prepared = en.prepare(screening_queries.raw_enrolments(spark, small_dir), en.LABELS)
    got = {r["feature"]: r["importance"] for r in en.rank_by_global_model(prepared, l2=0.01, tol=1e-6).collect()}
    table = prepared.table.drop("source_file").toPandas().astype(float)
    y = table.pop(en.TARGET).to_numpy()
    x = ((table - table.min()) / (table.max() - table.min() + 1e-12)).to_numpy()
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    penalty = np.append(np.full(x.shape[1] - 1, 0.01 * len(x)), 0.0)
    for _ in range(30):
        p = 1 / (1 + np.exp(-x @ w))
        w += np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + np.diag(penalty), x.T @ (y - p) - penalty * w)
    assert got.keys() == set(table.columns)
    for name, want in zip(table.columns, np.abs(w)):
        assert got[name] == pytest.approx(want, abs=1e-3)


def test_a_wide_table_is_stored_from_narrow_rows(spark, small_dir):
    prepared = en.prepare(screening_queries.raw_enrolments(spark, small_dir), en.ONE_HOT, wide=True)
    assert set(prepared.one_hot_columns) <= set(prepared.narrow.columns) and len(prepared.narrow.columns) < len(prepared.table.columns)
    stored = en.store(prepared)
    assert stored.narrow is None and stored.table.schema.names == prepared.table.schema.names
    assert stored.table.exceptAll(prepared.table).count() == 0 == prepared.table.exceptAll(stored.table).count()


def test_the_raw_files_come_from_one_join(spark, small_dir, monkeypatch):
    raw = screening_queries.raw_enrolments(spark, small_dir)
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    monkeypatch.setattr(screening_queries, "raw_enrolments", lambda *_: raw.mapInArrow(count, raw.schema))
    folder = screening_queries.raw_folder(spark, small_dir)
    assert spark.read.csv(folder, sep=";", header=True).count() == raw.count() == seen.value
