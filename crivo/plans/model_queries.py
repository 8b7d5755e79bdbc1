"""Registered queries: logistic rankings and incremental sums."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crivo.operators import contingency as con
from crivo.operators import encode, logit, scores
from crivo.plans import sql
from crivo.plans.registry import query, rounded
from crivo.plans.tables import numeric_items, returned, returned_items, table
from crivo.shared import materialize, work_path
from crivo.streaming import incremental

NUMBERS = ["l_quantity", "l_extendedprice", "l_discount"]
HOT = ["o_orderpriority", "o_orderstatus"]
RATE, PENALTY = 0.5, 0.01


def scaled_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with features in [0, 1]; the bounds come from a first pass by group."""
    items = numeric_items(spark, sf_dir)
    bounds = materialize(encode.merged_bounds(encode.min_max_by(items, NUMBERS, "l_linestatus")), "bounds")
    return encode.scale_by(items, bounds, NUMBERS)


SCALED = "base as (select l_linestatus as g, (l_returnflag = 'R')::integer as y, " + ", ".join(
    f"({c} - min({c}) over ()) / (max({c}) over () - min({c}) over () + 1e-12) as x{i}" for i, c in enumerate(NUMBERS)
) + " from lineitem)"


def step_sql(name: str, before: str, rows: str, by_group: bool) -> str:
    """One gradient step as a CTE over weights ``w0 .. w3`` (intercept last)."""
    k = len(NUMBERS)
    join = f"{rows} b join {before} w on b.g = w.g" if by_group else f"{rows} b, {before} w"
    score = " + ".join([f"w{k}", *[f"w{i} * x{i}" for i in range(k)]])
    scored = f"select b.*, {', '.join(f'w{i}' for i in range(k + 1))}, 1 / (1 + exp(-({score}))) - y as e from {join}"
    moved = [f"any_value(w{i}) - {RATE} * (sum(e * x{i}) / count(*) + {PENALTY} * any_value(w{i})) as w{i}" for i in range(k)]
    moved.append(f"any_value(w{k}) - {RATE} * sum(e) / count(*) as w{k}")
    keys = "g, " if by_group else ""
    return f"{name} as (select {keys}{', '.join(moved)} from ({scored}){' group by g' if by_group else ''})"


ZEROS = ", ".join(f"0.0::double as w{i}" for i in range(len(NUMBERS) + 1))
FEDERATED = ", ".join(
    [SCALED, f"s0 as (select distinct g, {ZEROS} from base)"]
    + [step_sql(f"s{i + 1}", f"s{i}", "base", True) for i in range(5)]
)
INCREMENTAL = ", ".join(
    [SCALED, f"s0 as (select {ZEROS})",
     step_sql("s1", "s0", "(select * from base where g = 'F')", False),
     step_sql("s2", "s1", "(select * from base where g = 'O')", False)]
)


@query(f"with {FEDERATED} " + " union all ".join(
    f"select '{c}' as feature, round(abs(avg(w{i})), 8) as importance from s5" for i, c in enumerate(NUMBERS)))
def fedavg_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Absolute mean coefficient of one model per group."""
    found = logit.federated_importance(
        scaled_items(spark, sf_dir), NUMBERS, "y", "l_linestatus", lr=RATE, l2=PENALTY
    )
    return rounded(found, "importance", digits=8)


@query(f"with {FEDERATED} " + " union all ".join(
    f"select g, '{c}' as feature, round(w{i}, 8) as coef from s5" for i, c in enumerate(NUMBERS)))
def coefficients_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = logit.federated_weights(scaled_items(spark, sf_dir), NUMBERS, "y", "l_linestatus", lr=RATE, l2=PENALTY)
    return rounded(logit.coefficients(weights, NUMBERS, ["g"]), "coef", digits=8)


@query(f"with {INCREMENTAL} " + " union all ".join(
    f"select '{c}' as feature, round(abs(w{i}), 8) as importance from s2" for i, c in enumerate(NUMBERS)))
def incremental_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Absolute coefficient of a model carried from group to group."""
    found = logit.incremental_importance(scaled_items(spark, sf_dir), NUMBERS, "y", "l_linestatus", lr=RATE, l2=PENALTY)
    return rounded(found, "importance", digits=8)


def mixed_steps_sql(
    base: str, columns: list[str], numbers: list[str], steps: list[str | None], by_group: bool, rate: float, penalty: float
) -> str:
    """CTEs up to ``last``: gradient steps over one-hot features (first category dropped) and numbers.

    ``base`` has ``g``, ``y`` and the features. A step names the group it visits, or None for all.
    """
    g, names = ("g, " if by_group else ""), [*columns, *numbers, "1"]
    value = {c: f'b."{c}"' if c in columns else "''" for c in names}
    amount = {c: f' * b."{c}"' if c in numbers else "" for c in names}
    values = " union all ".join(f"select distinct '{c}' as c, cast(\"{c}\" as varchar) as v from base" for c in columns)
    others = " ".join(f"union all select '{c}', ''" for c in [*numbers, "1"])
    ctes = [
        f"base as ({base})",
        f"vals as ({values})",
        f"keys as (select c, v from vals where (c, v) not in (select (c, min(v)) from vals group by c) {others})",
        "s0 as (select distinct g, c, v, 0.0::double as w from base, keys)" if by_group else "s0 as (select c, v, 0.0::double as w from keys)",
    ]
    for i, group in enumerate(steps):
        rows = "base" if group is None else f"(select * from base where g = '{group}')"
        same_group = " and w{0}.g = b.g" if by_group else ""
        joins = " ".join(
            f"left join s{i} w{j} on w{j}.c = '{c}' and w{j}.v = {value[c]}{same_group.format(j)}" for j, c in enumerate(names)
        )
        score = " + ".join(f"coalesce(w{j}.w, 0){amount[c]}" for j, c in enumerate(names))
        grads = " union all ".join(
            f"select {g}'{c}' as c, {value[c]} as v, sum(e{amount[c]}) as s from e{i} b group by all" for c in names
        )
        ctes += [
            f"e{i} as (select b.*, 1 / (1 + exp(-({score}))) - y as e from {rows} b {joins})",
            f"d{i} as ({grads})",
            f"t{i} as (select {g}count(*) as n from e{i} group by all)",
            f"s{i + 1} as (select {'w.g, ' if by_group else ''}w.c, w.v, w.w - {rate} * (coalesce(d.s, 0) / t.n"
            f" + case when w.c = '1' then 0 else {penalty} * w.w end) as w"
            f" from s{i} w left join d{i} d on w.c = d.c and w.v = d.v{' and w.g = d.g' if by_group else ''}"
            f" {f'join t{i} t on t.g = w.g' if by_group else f'cross join t{i} t'})",
        ]
    listed = ", ".join(f"'{c}'" for c in numbers)
    ctes.append(
        f"last as (select case when c in ({listed}) then c else c || '_' || v end as feature, w from s{len(steps)} where c <> '1')"
    )
    return ", ".join(ctes)


def quasi_newton_sql(base: str, columns: list[str], numbers: list[str], rounds: int, penalty: float) -> str:
    """CTEs up to ``last (feature, w)``: quasi-Newton steps of one model over one-hot features and numbers.

    ``base`` has ``y`` and the features. The curvature is a diagonal times a factor from the step before.
    """
    names = [*columns, *numbers, "1"]
    value = {c: f'coalesce(cast(b."{c}" as varchar), chr(0))' if c in columns else "''" for c in names}
    amount = {c: f' * coalesce(b."{c}", 0)' if c in numbers else "" for c in names}
    squares = {c: f'sum(power(coalesce(b."{c}", 0), 2))' if c in numbers else "count(*)" for c in names}
    values = " union all ".join(
        f"select '{c}' as c, {value[c]} as v, 0.25 * {squares[c]} / (select count(*) from base) + {0 if c == '1' else penalty} as h from base b"
        f"{f' where b.\"{c}\" is not null' if c in columns else ''} group by all" for c in names)
    listed = ", ".join(f"'{c}'" for c in [*numbers, "1"])
    ctes = [
        f"base as materialized ({base})",
        f"vals as materialized ({values})",
        f"s0 as materialized (select c, v, h, 0.0::double as w, 0.0::double as pw, 0.0::double as pg from vals"
        f" where c in ({listed}) or (c, v) not in (select (c, min(v)) from vals group by c))",
    ]
    for t in range(rounds):
        joins = " ".join(f"left join s{t} w{j} on w{j}.c = '{c}' and w{j}.v = {value[c]}" for j, c in enumerate(names))
        score = " + ".join(f"coalesce(w{j}.w, 0){amount[c]}" for j, c in enumerate(names))
        grads = " union all ".join(f"select '{c}' as c, {value[c]} as v, sum(e{amount[c]}) as s from e{t} b group by all" for c in names)
        length = "1.0 / " + str(len(names)) if t == 0 else f"(select sum(power(w - pw, 2) * h) / sum((w - pw) * (g - pg)) from g{t})"
        ctes += [
            f"e{t} as materialized (select b.*, 1 / (1 + exp(-({score}))) - y as e from base b {joins})",
            f"d{t} as materialized ({grads})",
            f"g{t} as materialized (select w.*, coalesce(d.s, 0) / (select count(*) from base) + case when w.c = '1' then 0 else {penalty} * w.w end as g"
            f" from s{t} w left join d{t} d on w.c = d.c and w.v = d.v)",
            f"s{t + 1} as materialized (select c, v, h, case when h > 0 then w - {length} * g / h else w end as w, w as pw, g as pg from g{t})",
        ]
    plain = ", ".join(f"'{c}'" for c in numbers) or "''"
    ctes.append(f"last as (select case when c in ({plain}) then c else c || '_' || v end as feature, w from s{rounds} where c <> '1')")
    return ", ".join(ctes)


def training_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The joined rows, written down once since every epoch reads them."""
    columns = ["l_linestatus", "l_discount", *HOT, "y"]
    return materialize(returned_items(spark, sf_dir).select(*columns), "training")


HOT_BASE = f"select l_linestatus as g, {', '.join(HOT)}, l_discount, y from ({sql.RETURNED})"


@query(f"""with {mixed_steps_sql(HOT_BASE, HOT, ['l_discount'], [None] * 3, True, RATE, PENALTY)}
select feature, round(abs(sum(w) / (select count(distinct g) from base)), 8) as importance from last group by feature""")
def one_hot_fedavg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models by group over one-hot columns that are never built, with one number."""
    items = training_items(spark, sf_dir)
    found = logit.mixed_federated_coefficients(items, HOT, ["l_discount"], "y", "l_linestatus", lr=RATE, l2=PENALTY, epochs=3)
    return rounded(logit.importance(found), "importance", digits=8)


@query(f"""with {mixed_steps_sql(HOT_BASE, HOT, ['l_discount'], ['F', 'O'], False, RATE, PENALTY)}
select feature, round(abs(w), 8) as importance from last""")
def one_hot_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A carried model over one-hot columns that are never built, with one number."""
    items = training_items(spark, sf_dir)
    found = logit.mixed_incremental_coefficients(items, HOT, ["l_discount"], "y", "l_linestatus", lr=RATE, l2=PENALTY)
    return rounded(logit.importance(found), "importance", digits=8)


NULLED = f"""select y, o_orderstatus, nullif(o_orderpriority, '3-MEDIUM') as o_orderpriority, case when l_linenumber = 2 then null else l_discount end as l_discount
from ({sql.RETURNED})"""


@query(f"""with {quasi_newton_sql(NULLED, HOT, ['l_discount'], 8, PENALTY)}
select feature, round(abs(w), 7) as importance from last""")
def one_hot_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One model over all rows, with missing categories and numbers, after eight quasi-Newton steps."""
    priority = F.expr("nullif(o_orderpriority, '3-MEDIUM')").alias("o_orderpriority")
    discount = F.expr("case when l_linenumber = 2 then null else l_discount end").alias("l_discount")
    items = returned_items(spark, sf_dir).select("y", "o_orderstatus", priority, discount)
    found = logit.mixed_global_coefficients(items, HOT, ["l_discount"], "y", l2=PENALTY, rounds=8, tol=0.0)
    return rounded(logit.importance(found), "importance", digits=7)


@query(f"""with c as (select o_orderstatus as v, sum(y) as a, count(*) - sum(y) as b from ({sql.RETURNED}) group by o_orderstatus),
f as (select min(v) as v from c)
select 'o_orderstatus_' || c.v as feature, round(ln(c.a / c.b) - (select ln(a / b) from c where v = (select v from f)), 5) as coef
from c, f where c.v <> f.v""")
def global_logit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One model over all rows; on the indicators of one column its coefficients are log odds ratios."""
    items = returned_items(spark, sf_dir).select("o_orderstatus", "y")
    values = encode.category_lists(encode.fit_labels(items, ["o_orderstatus"]), ["o_orderstatus"])
    wide = encode.one_hot_wide(items, values)
    features = [c for c in wide.columns if c != "y"]
    return rounded(logit.global_coefficients(wide, features, "y"), "coef", digits=5)


@query(f"""with r as (select y, coalesce(case when o_orderkey % 7 = 0 then null else (o_orderpriority < '3')::integer end, 0) as x from ({sql.RETURNED})),
c as (select x, sum(y) as a, count(*) - sum(y) as b from r group by x)
select 'urgent' as feature, round(ln((select a / b from c where x = 1)) - ln((select a / b from c where x = 0)), 5) as coef""")
def global_logit_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A missing feature value counts as 0, as in the models by group."""
    flag = F.expr("case when o_orderkey % 7 = 0 then null else cast(o_orderpriority < '3' as double) end").alias("urgent")
    return rounded(logit.global_coefficients(returned_items(spark, sf_dir).select(flag, "y"), ["urgent"], "y"), "coef", digits=5)


STREAMED = ["l_quantity", "l_discount", "l_tax"]
DAYS = 3


def days(spark: SparkSession, sf_dir: str, folder: str) -> Iterator[DataFrame]:
    """Line items that arrive in a folder on three days: each time the rows of one more day are there.

    A quantity that is not a number stands for a broken reading.
    """
    items = table(spark, sf_dir, "lineitem").withColumns({
        "y": returned(), "l_quantity": F.when(F.col("l_orderkey") % 11 == 0, F.lit(float("nan"))).otherwise(F.col("l_quantity"))})
    for day in range(DAYS):
        items.where(F.col("l_linenumber") % DAYS == day).write.mode("append").parquet(folder)
        yield items


def watched(spark: SparkSession, folder: str, like: DataFrame) -> DataFrame:
    """The folder as a stream; whatever is new makes one step."""
    return incremental.file_stream(spark, folder, like.schema, files_per_step=None)


BROKEN = f"select * replace (case when l_orderkey % 11 = 0 then null else l_quantity end as l_quantity) from ({sql.ITEMS})"


@query(f"""with {sql.sums(BROKEN, STREAMED)},
s as (select feature, sum(power(o - expected, 2) / expected) as chi2_score from sums group by feature)
select feature, round(chi2_score, 6) as chi2_score from s""")
def stream_class_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class-sum score from sums carried over three days of files."""
    folder, state = work_path(spark, "days"), work_path(spark, "state")
    for items in days(spark, sf_dir, folder):
        final = incremental.run_to_table(incremental.running_class_sums(watched(spark, folder, items), STREAMED, "y"), state)
    return rounded(scores.class_sum_scores(incremental.long_class_sums(final, STREAMED)).drop("p_value"), "chi2_score")


@query(f"""with {sql.table(sql.ITEMS, ['l_linenumber', 'l_linestatus'])} {sql.TESTS}
select feature, round({sql.corrected_v('chi2')}, 8) as cramers_v, round(chi2, 6) as chi2 from tests""")
def stream_contingency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Independence tests from counts carried over three days of files."""
    folder, state = work_path(spark, "days"), work_path(spark, "state")
    for items in days(spark, sf_dir, folder):
        cells = incremental.run_to_table(incremental.running_cells(watched(spark, folder, items), ["l_linenumber", "l_linestatus"], "y"), state)
    tests = scores.contingency_tests(con.table_of(cells, 2, 2))
    found = tests.join(scores.cramers_v(tests), "feature").select("feature", "cramers_v", "chi2")
    return rounded(rounded(found, "cramers_v", digits=8), "chi2")


BY_DAY = SCALED.replace("select l_linestatus as g", f"select l_linenumber % {DAYS} as g")


@query(f"""with {BY_DAY}, s0 as (select {ZEROS}), """ + ", ".join(
    step_sql(f"s{d + 1}", f"s{d}", f"(select * from base where g = {d})", False) for d in range(DAYS)) + " " + " union all ".join(
    f"select '{c}' as feature, round(abs(w{i}), 8) as importance from s{DAYS}" for i, c in enumerate(NUMBERS)))
def stream_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model carried over three days of files, a step for each."""
    items = table(spark, sf_dir, "lineitem")
    bounds = materialize(encode.min_max(items, NUMBERS), "bounds")
    folder, path = work_path(spark, "days"), work_path(spark, "model")
    for day in range(DAYS):
        items.withColumn("y", returned()).where(F.col("l_linenumber") % DAYS == day).write.mode("append").parquet(folder)
        stream = incremental.file_stream(spark, folder, items.withColumn("y", returned()).schema, files_per_step=None)
        incremental.train_on_stream(encode.scale_by(stream, bounds, NUMBERS), NUMBERS, "y", path, lr=RATE, l2=PENALTY).awaitTermination()
    found = logit.importance(logit.coefficients(incremental.latest_weights(spark, path), NUMBERS))
    return rounded(found, "importance", digits=8)
