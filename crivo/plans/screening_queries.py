"""Registered queries: the whole screening, on line items dressed as enrolments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crivo.operators import contingency as con
from crivo.operators import scores
from crivo.plans import batch, sql
from crivo.plans import enrolments as en
from crivo.plans.model_queries import mixed_steps_sql, quasi_newton_sql
from crivo.plans.registry import query, rounded
from crivo.plans.tables import table
from crivo.shared import materialize, work_path
from crivo.sources import files

# Raw texts carry accents and outer space, and some incomes are missing.
RAW = {
    "Categoria da Situação": "case l_returnflag when 'R' then ' Evadidos ' when 'A' then 'Em Curso' else 'Concluídos' end",
    "Renda Familiar": """case when o_orderkey % 50 = 0 then null when o_orderpriority = '1-URGENT' then 'RFP>3,5'
        when o_orderpriority = '2-HIGH' then '1,5<RFP<=2,5' when o_orderpriority = '3-MEDIUM' then '0<RFP<=0,5'
        when o_orderpriority = '5-LOW' then 'Não declarada' else 'outra' end""",
    "Nome de Curso": "p_name",
    "Instituição": "p_brand",
    "Turno": "case p_type when 'ECONOMY' then 'Manhã' when 'STANDARD' then 'Integral Ímpar' else p_type end",
    "Sexo": "o_orderstatus",
    "Fonte de Financiamento": "concat('Fonte ', l_linenumber)",
    "Faixa Etária": "concat('faixa ', cast(floor(p_size / 10) as int))",
    "Matrícula Atendida": "l_linestatus",
    "Ano": "cast(l_linenumber % 4 + 2019 as string)",
    "Idade": "cast(p_size as string)",
    "Código da Matrícula": "cast(l_orderkey as string)",
}


def raw_enrolments(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_returnflag", "l_linestatus")
    orders = table(spark, sf_dir, "orders")
    parts = table(spark, sf_dir, "part")
    joined = items.join(orders, items.l_orderkey == orders.o_orderkey).join(parts, items.l_partkey == parts.p_partkey)
    return joined.select(
        *[F.expr(e).alias(c) for c, e in RAW.items()],
        F.expr("concat('microdados_', l_linenumber % 4 + 2019)").alias("source_file"),
    )


CLEAN = """select (l_returnflag = 'R')::integer as y, 'microdados_' || (l_linenumber % 4 + 2019) as source_file,
case o_orderpriority when '1-URGENT' then 6 when '2-HIGH' then 4 when '3-MEDIUM' then 1 when '5-LOW' then 0 else -1 end as "Renda Familiar",
p_name as "Nome de Curso", p_brand as "Instituicao",
case p_type when 'ECONOMY' then 'Manha' when 'STANDARD' then 'Integral Impar' else p_type end as "Turno",
o_orderstatus as "Sexo", 'Fonte ' || l_linenumber as "Fonte de Financiamento", 'faixa ' || (p_size // 10) as "Faixa Etaria",
l_linestatus as "Matricula Atendida"
from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey where o_orderkey % 50 <> 0"""

CODED = ["Nome de Curso", "Instituicao", "Turno", "Sexo", "Fonte de Financiamento", "Faixa Etaria"]
CODES = ", ".join(f'(dense_rank() over (order by "{c}") - 1)::integer as "{c}"' for c in CODED)
CODED_TABLE = f'select "Renda Familiar", {CODES}, y as "Alvo_Evadido", source_file from ({CLEAN})'


@query(CODED_TABLE)
def prepare_label_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw rows to label codes over all files."""
    return en.prepare(raw_enrolments(spark, sf_dir), en.LABELS).table


CODES_BY_FILE = CODES.replace("over (order", "over (partition by source_file order")


@query(f'select "Renda Familiar", {CODES_BY_FILE}, y as "Alvo_Evadido", source_file from ({CLEAN})')
def prepare_codes_by_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw rows to label codes of each file."""
    preset = en.Preset(en.LABELS.label_columns, also_dropped=en.LABELS.also_dropped, by_file=True)
    return en.prepare(raw_enrolments(spark, sf_dir), preset).table


HOT = ["Turno", "Sexo", "Faixa Etaria", "Matricula Atendida"]
def sums_sql(numbers: list[str]) -> str:
    """Class sums over the coded table, with missing and negative numbers as 0."""
    base = f'select *, "Alvo_Evadido" as y from ({CODED_TABLE})'
    long = " union all ".join(
        f"""select '{c}' as feature, y as class, sum(greatest("{c}", 0))::double as o, count(*) as n_class from base group by y"""
        for c in numbers
    )
    return (
        f"base as ({base}), long as ({long}), totals as (select *, sum(o) over (partition by feature) as total,"
        " sum(n_class) over (partition by feature) as n from long),"
        " sums as (select *, n_class::double / n * total as expected from totals)"
    )


SCORED = "sc as (select feature, sum(power(o - expected, 2) / expected) as chi2_score, count(*) - 1 as dof from sums group by feature)"


@query(f"""with {sums_sql(['Renda Familiar', *CODED])}, {SCORED}
select feature, round(chi2_score, 6) as chi2_score, round({sql.chi2_tail('chi2_score', 'dof')}, 8) as p_value
from sc order by chi2_score desc, feature limit 30""")
def screen_by_class_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best features by the class-sum score of their codes."""
    found = en.rank_by_class_sums(en.prepare(raw_enrolments(spark, sf_dir), en.LABELS).table.drop("source_file"))
    return rounded(rounded(found, "chi2_score"), "p_value", digits=8)


TEXT_FEATURES = ["Renda Familiar", *CODED]
TEXT_CODES = ", ".join(
    f'(dense_rank() over (order by coalesce("{c}", \'nan\')) - 1)::integer as "{c}"' for c in CODED)


@query(f"""with {sums_sql(TEXT_FEATURES).replace(CODED_TABLE, f'select "Renda Familiar", {TEXT_CODES}, y as "Alvo_Evadido" from ({CLEAN})')}, {SCORED}
select feature, round(chi2_score, 6) as chi2_score, round({sql.chi2_tail('chi2_score', 'dof')}, 8) as p_value
from sc order by chi2_score desc, feature limit 30""")
def screen_late_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ranking of a table whose categories are still text: they are encoded on the way."""
    preset = en.Preset((), also_dropped=("Matricula Atendida",))
    found = en.rank_by_class_sums(en.prepare(raw_enrolments(spark, sf_dir), preset).table)
    return rounded(rounded(found, "chi2_score"), "p_value", digits=8)


def raw_folder(spark: SparkSession, sf_dir: str) -> str:
    """The raw enrolments as delimited files: one header per year, and the first year lacks a column.

    Every fiftieth order has no income, and every seventh row of the other years no vacancy.
    """
    # The joins are done once, not for every year.
    raw = materialize(raw_enrolments(spark, sf_dir), "raw").withColumn("Vagas Regulares l14", F.expr("if(`Código da Matrícula` % 7 = 0, null, 'v')"))
    folder = work_path(spark, "raw-years")
    for year in range(2019, 2023):
        own = raw.where(F.col("source_file") == f"microdados_{year}").drop("source_file")
        own = own.drop("Vagas Regulares l14") if year == 2019 else own.select(*sorted(own.columns, reverse=year % 2 == 0))
        # Parts of one year lie in its folder, as a sink by source would leave them.
        own.write.csv(f"{folder}/source_file=microdados_{year}", sep=";", header=True)
    return f"{folder}/*/*.csv"


FROM_FILES = CLEAN.replace("where o_orderkey % 50 <> 0", "where o_orderkey % 50 <> 0 and (l_linenumber % 4 = 0 or l_orderkey % 7 <> 0)")


@query(f"""with base as ({FROM_FILES}) select 'labels' as preset, source_file, count(*) as n_rows, sum(y)::bigint as dropped_out, sum("Renda Familiar")::bigint as income
from base group by source_file union all
select 'one-hot', source_file, count(*), sum(y)::bigint, sum("Renda Familiar")::bigint from base group by source_file""")
def prepare_from_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files whose headers differ to analysis tables: a column that one file lacks costs none of its rows."""
    folder = raw_folder(spark, sf_dir)
    counts = []
    for name, preset in (("labels", en.LABELS), ("one-hot", en.ONE_HOT)):
        found = en.store(en.prepare(files.read_files(spark, folder), preset)).table
        counts.append(found.groupBy("source_file").agg(
            F.count(F.lit(1)).alias("n_rows"), F.sum(en.TARGET).alias("dropped_out"), F.sum(con.quoted(en.INCOME)).alias("income"),
        ).select(F.lit(name).alias("preset"), "*"))
    return counts[0].unionByName(counts[1])


@query(f"""with {sums_sql(TEXT_FEATURES).replace(CLEAN, FROM_FILES)}, {SCORED}
select feature, round(chi2_score, 6) as chi2_score, round({sql.chi2_tail('chi2_score', 'dof')}, 8) as p_value
from sc order by chi2_score desc, feature limit 30""")
def screen_from_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From raw files to ranked features."""
    found = en.rank_by_class_sums(en.prepare(files.read_files(spark, raw_folder(spark, sf_dir)), en.LABELS).table)
    return rounded(rounded(found, "chi2_score"), "p_value", digits=8)


@query(f"""with base as ({FROM_FILES}), n as (select source_file, count(*) as n_rows, sum("Renda Familiar")::bigint as income from base group by source_file)
select 1 as run, source_file, 'written' as status, n_rows, income from n union all
select 2, source_file, case when source_file = 'microdados_2021' then 'written' else 'kept' end,
case when source_file = 'microdados_2021' then (select count(*) from base where source_file = 'microdados_2021' and "Sexo" <> 'F') else n_rows end,
case when source_file = 'microdados_2021' then (select sum("Renda Familiar")::bigint from base where source_file = 'microdados_2021' and "Sexo" <> 'F') else income end
from n""")
def process_changed_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All years processed, then one again whose file has changed; the others are not touched."""
    folder, out = raw_folder(spark, sf_dir), work_path(spark, "years")
    runs = []
    for run in (1, 2):
        if run == 2:
            year = folder.replace("/*/", "/source_file=microdados_2021/")
            rows = materialize(spark.read.csv(year, sep=";", header=True).where("`Sexo` <> 'F'"), "year")
            rows.write.mode("overwrite").csv(year.removesuffix("/*.csv"), sep=";", header=True)
        status = batch.process(spark, folder, out, en.LABELS)
        income = batch.processed(spark, out).groupBy("source_file").agg(F.sum(con.quoted(en.INCOME)).alias("income"))
        # The next run replaces what this one has written.
        runs.append(materialize(status.join(income, "source_file").select(F.lit(run).alias("run"), "source_file", "status", "n_rows", "income"), "run"))
    return runs[0].unionByName(runs[1])


def quoted_cells(columns: list[str], base: str, keep_missing: bool = False) -> str:
    """The contingency table CTEs for columns whose names hold blanks."""
    renamed = f"select y, {', '.join(f'\"{c}\" as c{i}' for i, c in enumerate(columns))} from ({base})"
    names = " ".join(f"when 'c{i}' then '{c}'" for i, c in enumerate(columns))
    ctes = sql.table(renamed, [f"c{i}" for i in range(len(columns))], keep_missing)
    return ctes.replace("cells as (", "cells0 as (", 1).replace(
        ",\n    r as (", f", cells as (select case feature {names} end as feature, value, class, o from cells0),\n    r as (", 1
    )


@query(f"""with {quoted_cells(['Renda Familiar', *CODED], CLEAN)} {sql.TESTS}
select feature, round({sql.corrected_v('chi2')}, 8) as cramers_v from tests""")
def screen_by_association(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bias-corrected V of the features that the class sums put first."""
    table_ = en.store(en.prepare(raw_enrolments(spark, sf_dir), en.LABELS)).table
    return rounded(en.rank_by_association(table_), "cramers_v", digits=8)


@query(f"""with {quoted_cells(['Renda Familiar', *CODED], CLEAN)} {sql.TESTS},
best as (select feature from tests order by {sql.corrected_v('chi2')} desc nulls last, feature limit 5),
z as (select feature, value, class, {sql.RESIDUAL} as z from tab where feature in (select feature from best)),
placed as (select *, row_number() over (partition by feature order by round(abs(z), 9) desc, value, class) as place
from z where abs(z) > 1.96)
select feature, value, class, round(z, 6) as z, case when z > 0 then 'attraction' else 'repulsion' end as direction
from placed where place <= 5""")
def screen_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strongest categories of the strongest features, straight from the cleaned texts."""
    preset = en.Preset((), also_dropped=("Matricula Atendida",))
    table_ = en.prepare(raw_enrolments(spark, sf_dir), preset).table.drop("source_file")
    cross = con.contingency_table(table_, en.feature_columns(table_), en.TARGET, n_classes=2)
    found = scores.strongest_residuals(cross).select("feature", "value", "class", "z", "direction")
    return rounded(found, "z")


FULL_NUMBERS = f"""base2 as ({CLEAN}),
coded as (select y, ("Renda Familiar" - min("Renda Familiar") over ()) / (max("Renda Familiar") over () - min("Renda Familiar") over () + 1e-12) as a,
(dense_rank() over (order by "Fonte de Financiamento") - 1) as f from base2),
scaled as (select y, a, f / (max(f) over () + 1e-12) as f from coded),
nlong as (select 'Renda Familiar' as feature, y as class, sum(a) as o, count(*) as n_class from scaled group by y
union all select 'Fonte de Financiamento', y, sum(f), count(*) from scaled group by y),
ntot as (select *, sum(o) over (partition by feature) as total, sum(n_class) over (partition by feature) as n from nlong)"""


ALL_HOT = ["Nome de Curso", "Instituicao", *HOT]


@query(f"""with {quoted_cells(ALL_HOT, CLEAN, keep_missing=True)}, {FULL_NUMBERS},
firsts as (select feature, min(value) as first from tab group by feature),
sums as (select t.feature || '_' || value as feature, o::double as o, col_total as n_class, n, expected
from tab t join firsts f on t.feature = f.feature where value <> first
union all select feature, o, n_class, n, n_class::double / n * total from ntot),
scored as (select feature, sum({sql.FULL_TERM}) as chi2_score, any_value(n) as n, count(*) - 1 as dof from sums group by feature)
select feature, round(chi2_score, 6) as chi2_score, round(sqrt(chi2_score / n), 7) as cramers_v,
round({sql.chi2_tail('chi2_score', 'dof')}, 7) as p_value from scored""")
def screen_one_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Presence-and-absence scores over scaled numbers and one-hot columns that are never built."""
    prepared = en.store(en.prepare(raw_enrolments(spark, sf_dir), en.ONE_HOT))
    found = en.rank_full(prepared)
    return rounded(rounded(found, "chi2_score"), "cramers_v", "p_value", digits=7)


@query(f"""with {quoted_cells(ALL_HOT, CLEAN, keep_missing=True)}, {FULL_NUMBERS},
firsts as (select feature, min(value) as first from tab group by feature),
sums as (select t.feature || '_' || value as feature, o::double as o, col_total as n_class, n, expected
from tab t join firsts f on t.feature = f.feature where value <> first
union all select feature, o, n_class, n, n_class::double / n * total from ntot),
scored as (select feature, sum({sql.FULL_TERM}) as chi2_score, any_value(n) as n, count(*) - 1 as dof from sums group by feature)
select feature, round(chi2_score, 6) as chi2_score, round(sqrt(chi2_score / n), 7) as cramers_v,
round({sql.chi2_tail('chi2_score', 'dof')}, 7) as p_value from scored""")
def screen_wide_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same scores over a wide table of all six columns, one 0/1 column per category."""
    prepared = en.store(en.prepare(raw_enrolments(spark, sf_dir), en.ONE_HOT, wide=True))
    found = en.rank_wide(prepared.table)
    return rounded(rounded(found, "chi2_score"), "cramers_v", "p_value", digits=7)


MODEL_BASE = f"""select source_file as g, y, {', '.join(f'"{c}"' for c in ALL_HOT)},
("Renda Familiar" - min("Renda Familiar") over ()) / (max("Renda Familiar") over () - min("Renda Familiar") over () + 1e-12) as "Renda Familiar",
f / (max(f) over () + 1e-12) as "Fonte de Financiamento"
from (select *, (dense_rank() over (order by "Fonte de Financiamento") - 1) as f from ({CLEAN}))"""


@query(f"""with {mixed_steps_sql(MODEL_BASE.replace('select source_file', 'select source_file', 1).replace('(select *, (dense', '(select * exclude ("Fonte de Financiamento"), (dense', 1), ALL_HOT, ['Renda Familiar', 'Fonte de Financiamento'], [None] * 5, True, 0.5, 0.001)}
select feature, round(abs(sum(w) / (select count(distinct g) from base)), 8) as importance from last group by feature""")
def screen_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Importance by averaged logistic models, one per file."""
    prepared = en.store(en.prepare(raw_enrolments(spark, sf_dir), en.ONE_HOT))
    return rounded(en.rank_by_model(prepared, lr=0.5, l2=0.001), "importance", digits=8)


GLOBAL_ROUNDS = 10


@query(f"""with {quasi_newton_sql(MODEL_BASE.replace('(select *, (dense', '(select * exclude ("Fonte de Financiamento"), (dense', 1), ALL_HOT, ['Renda Familiar', 'Fonte de Financiamento'], GLOBAL_ROUNDS, 0.001)}
select feature, round(abs(w), 6) as importance from last""")
def screen_by_global_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Importance by one logistic model over all rows and files, after ten quasi-Newton steps."""
    prepared = en.store(en.prepare(raw_enrolments(spark, sf_dir), en.ONE_HOT))
    return rounded(en.rank_by_global_model(prepared, l2=0.001, rounds=GLOBAL_ROUNDS, tol=0.0), "importance", digits=6)
