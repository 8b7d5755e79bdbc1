"""Registered queries: class sums, contingency tables, scores, residuals, rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crivo.functions import stats
from crivo.operators import contingency as con
from crivo.operators import rank, scores
from crivo.plans import sql
from crivo.plans.registry import query, rounded
from crivo.plans.tables import items_of_parts, numeric_items, returned_items, table

ORDER_FEATURES = ["l_linestatus", "l_linenumber", "o_orderpriority", "o_orderstatus"]
PART_FEATURES = ["p_brand", "p_type", "p_name", "p_size"]
NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]
UNIT_NUMBERS = ["l_discount", "l_tax", "l_linenumber", "l_quantity"]


@query(f"""with {sql.table(sql.RETURNED, ORDER_FEATURES)} {sql.TESTS}
select feature, round({sql.corrected_v('chi2_plain')}, 8) as cramers_v from tests""")
def cramers_v_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which order attributes go with returned items?"""
    cross = con.contingency_table(returned_items(spark, sf_dir), ORDER_FEATURES, "y", n_classes=2)
    tests = scores.contingency_tests(cross, yates=False)
    return rounded(rank.ranked(scores.cramers_v(tests), "cramers_v"), "cramers_v", digits=8)


@query("""select l_returnflag as class, count(*) as n_class, (sum(count(*)) over ())::bigint as n,
round(count(*) / sum(count(*)) over (), 8) as prob from lineitem group by l_returnflag""")
def class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(con.class_counts(table(spark, sf_dir, "lineitem"), "l_returnflag"), "prob", digits=8)


@query(f"""with {sql.sums(sql.ITEMS, NUMBERS)}
select feature, class, round(o, 2) as o, n_class, round(total, 2) as total, n::bigint as n,
round(expected, 2) as expected from sums""")
def class_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = con.with_expected(con.class_sums(numeric_items(spark, sf_dir), NUMBERS, "y"))
    return rounded(sums, "o", "total", "expected", digits=2)


@query(f"""with {sql.sums(sql.ITEMS, NUMBERS)},
s as (select feature, sum(power(o - expected, 2) / expected) as chi2_score, count(*) - 1 as dof from sums group by feature)
select feature, round(chi2_score, 6) as chi2_score, round({sql.chi2_tail('chi2_score', 'dof')}, 8) as p_value from s""")
def chi2_class_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scores.class_sum_scores(con.class_sums(numeric_items(spark, sf_dir), NUMBERS, "y"))
    return rounded(rounded(rank.ranked(found, "chi2_score"), "chi2_score"), "p_value", digits=8)


@query(f"""with {sql.sums(sql.ITEMS, UNIT_NUMBERS)},
s as (select feature, sum({sql.FULL_TERM}) as chi2_score, any_value(n) as n, count(*) - 1 as dof from sums group by feature)
select feature, round(chi2_score, 6) as chi2_score,
case when chi2_score >= 0 then round(sqrt(chi2_score / n), 8) end as cramers_v,
round({sql.chi2_tail('chi2_score', 'dof')}, 8) as p_value from s""")
def chi2_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Presence and absence form; features above 1 can score below zero and then have no V."""
    found = scores.full_scores(con.class_sums(numeric_items(spark, sf_dir), UNIT_NUMBERS, "y"))
    return rounded(rounded(rank.ranked(found, "chi2_score"), "chi2_score"), "cramers_v", "p_value", digits=8)


@query(f"""with {sql.sums(sql.ITEMS.replace('as y', 'as y0').replace('select *', "select *, ascii(l_returnflag) as y"), NUMBERS)},
s as (select feature, sum(power(o - expected, 2) / expected) as chi2_score, count(*) - 1 as dof from sums group by feature)
select feature, round(chi2_score, 6) as chi2_score, round({sql.chi2_tail('chi2_score', 'dof')}, 8) as p_value from s""")
def chi2_three_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class-sum score against a target of three classes."""
    found = scores.class_sum_scores(con.class_sums(numeric_items(spark, sf_dir), NUMBERS, "l_returnflag"))
    return rounded(rounded(found, "chi2_score"), "p_value", digits=8)


@query(f"""with {sql.sums(sql.ITEMS, NUMBERS)},
s as (select feature, sum(power(o - expected, 2) / expected) as chi2_score from sums group by feature)
select feature, round(chi2_score, 6) as chi2_score from s order by chi2_score desc, feature limit 3""")
def topk_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scores.class_sum_scores(con.class_sums(numeric_items(spark, sf_dir), NUMBERS, "y"))
    return rounded(rank.top_k(found.drop("p_value"), "chi2_score", 3), "chi2_score")


@query(f"""with {sql.sums(sql.ITEMS, NUMBERS)},
s as (select feature, sum(power(o - expected, 2) / expected) as chi2_score from sums group by feature)
select feature, row_number() over (order by chi2_score desc, feature) as rank from s""")
def feature_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of the best thirty; all of them when there are fewer."""
    found = scores.class_sum_scores(con.class_sums(numeric_items(spark, sf_dir), NUMBERS, "y"))
    return rank.head_ranks(found, "chi2_score").select("feature", F.col("rank").cast("long").alias("rank"))


@query("select l_extendedprice, l_quantity, case when l_returnflag = 'R' then 1 else 0 end as y from lineitem")
def project_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows, with only the two best features and the target."""
    items = numeric_items(spark, sf_dir)
    found = scores.class_sum_scores(con.class_sums(items, ["l_extendedprice", "l_quantity", "l_discount", "l_tax"], "y"))
    return rank.project_top(items, found, "chi2_score", "y", 2)


@query(f"""with {sql.cells(sql.RETURNED, ORDER_FEATURES)} select feature, value, class, o from cells""")
def cell_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return con.cell_counts(returned_items(spark, sf_dir), ORDER_FEATURES, "y")


@query(f"""with {sql.table(sql.PART_ITEMS, ['p_brand', 'p_type'])}
select feature, value, class, o, row_total::bigint as row_total, col_total::bigint as col_total, n::bigint as n,
n_classes, round(expected, 6) as expected from tab""")
def expected_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    cross = con.contingency_table(items_of_parts(spark, sf_dir), ["p_brand", "p_type"], "y", n_classes=2)
    return rounded(cross, "expected")


@query("""select o_orderpriority as value, count(*) filter (l_returnflag = 'A') as "A",
count(*) filter (l_returnflag = 'N') as "N", count(*) filter (l_returnflag = 'R') as "R"
from lineitem join orders on l_orderkey = o_orderkey group by o_orderpriority""")
def crosstab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return con.cross_tab(returned_items(spark, sf_dir), "o_orderpriority", "l_returnflag")


@query(f"""with {sql.table(sql.RETURNED, ORDER_FEATURES)} {sql.TESTS}
select feature, n::bigint as n, n_rows::bigint as n_rows, n_cols::bigint as n_cols, round(chi2, 6) as chi2,
dof::bigint as dof, round({sql.chi2_tail('chi2', 'dof')}, 8) as p_value from tests""")
def contingency_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Independence tests; the two-by-two table is corrected for continuity."""
    tests = scores.contingency_tests(con.contingency_table(returned_items(spark, sf_dir), ORDER_FEATURES, "y", n_classes=2))
    return rounded(rounded(tests, "chi2"), "p_value", digits=8)


EVENTS = "select *, case when value > 60 then 'high' when value > 30 then 'middle' else 'low' end as y from events"


@query(f"""with {sql.table(EVENTS, ['event_type', 'user_id'])} {sql.TESTS}
select feature, n::bigint as n, n_rows::bigint as n_rows, n_cols::bigint as n_cols, round(chi2, 6) as chi2,
dof::bigint as dof, round({sql.chi2_tail('chi2', 'dof')}, 8) as p_value from tests""")
def contingency_many_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A target of three classes against a column with many values; class count not given."""
    level = F.when(F.col("value") > 60, "high").when(F.col("value") > 30, "middle").otherwise("low")
    events = table(spark, sf_dir, "events").withColumn("y", level)
    tests = scores.contingency_tests(con.contingency_table(events, ["event_type", "user_id"], "y"))
    return rounded(rounded(tests, "chi2"), "p_value", digits=8)


LABELED = "select d.*, l.quality as y from documents d join labels l on d.doc_id = l.doc_id"


@query(f"""with {sql.table(LABELED, ['lang', 'source'])} {sql.TESTS}
select feature, round({sql.corrected_v('chi2')}, 8) as cramers_v from tests""")
def cramers_v_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Do language and source go with the quality label?"""
    documents = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    cross = con.contingency_table(documents, ["lang", "source"], "quality", n_classes=2)
    return rounded(scores.cramers_v(scores.contingency_tests(cross)), "cramers_v", digits=8)


@query(f"""with {sql.table(sql.PART_ITEMS, ['p_brand', 'p_type'])}
select feature, value, class, round({sql.RESIDUAL}, 6) as z, round(abs({sql.RESIDUAL}), 6) as abs_z from tab""")
def adjusted_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    cross = con.contingency_table(items_of_parts(spark, sf_dir), ["p_brand", "p_type"], "y", n_classes=2)
    return rounded(scores.adjusted_residuals(cross), "z", "abs_z")


@query(f"""with {sql.table(sql.PART_ITEMS, PART_FEATURES)},
z as (select feature, value, class, {sql.RESIDUAL} as z from tab)
select feature, value, class, round(z, 6) as z,
case when z > 0 then 'attraction' else 'repulsion' end as direction from z where abs(z) > 1.96""")
def significant_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    cross = con.contingency_table(items_of_parts(spark, sf_dir), PART_FEATURES, "y", n_classes=2)
    found = scores.significant(scores.adjusted_residuals(cross))
    return rounded(found.select("feature", "value", "class", "z", stats.direction(F.col("z")).alias("direction")), "z")


RESIDUAL_FEATURES = [*PART_FEATURES, "l_linenumber", "l_linestatus"]


@query(f"""with {sql.table(sql.PART_ITEMS, RESIDUAL_FEATURES)} {sql.TESTS},
best as (select feature from tests order by {sql.corrected_v('chi2')} desc nulls last, feature limit 5),
z as (select feature, value, class, {sql.RESIDUAL} as z from tab where feature in (select feature from best)),
placed as (select *, row_number() over (partition by feature order by round(abs(z), 9) desc, value, class) as place
from z where abs(z) > 1.96)
select feature, value, class, round(z, 6) as z, place,
case when z > 0 then 'attraction' else 'repulsion' end as direction from placed where place <= 5""")
def top_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five strongest cells of the five features with the highest V."""
    cross = con.contingency_table(items_of_parts(spark, sf_dir), RESIDUAL_FEATURES, "y", n_classes=2)
    found = scores.strongest_residuals(cross)
    return rounded(found.select("feature", "value", "class", "z", F.col("rank").cast("long").alias("place"), "direction"), "z")


@query(f"""with {sql.table(sql.PART_ITEMS, ['p_brand'])},
z as (select value, class, {sql.RESIDUAL} as z from tab),
lines as (select value, max(z) filter (class = 0) as z0, max(z) filter (class = 1) as z1,
row_number() over (order by value) as line, count(*) over () as lines from z group by value)
select line, value, round(z0, 6) as z0, round(z1, 6) as z1 from lines where lines <= 20 or line <= 10""")
def residual_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The residuals of one feature as printed: ten lines of a long table."""
    cross = con.contingency_table(items_of_parts(spark, sf_dir), ["p_brand"], "y", n_classes=2)
    lines = scores.residual_preview(cross, "p_brand")
    return lines.select(
        F.col("line").cast("long").alias("line"), "value",
        *[F.round(F.col("z_by_class")[F.lit(c)], 6).alias(f"z{c}") for c in (0, 1)],
    )


@query(f"""with {sql.sums(sql.ITEMS, NUMBERS)},
s as (select feature, sum(power(o - expected, 2) / expected) as chi2_score from sums group by feature),
t as (select count(*) as n_features, sum(chi2_score) as chi2_score, (count(*) - 1) * 1 as dof from s)
select n_features, round(chi2_score, 6) as chi2_score, dof, round({sql.chi2_tail('chi2_score', 'dof')}, 8) as p_value from t""")
def chi2_total_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scores.class_sum_scores(con.class_sums(numeric_items(spark, sf_dir), NUMBERS, "y"))
    return rounded(rounded(scores.total_test(found, 2), "chi2_score"), "p_value", digits=8)


@query(f"""with g as (select event_type, sum(value) as score, count(*) as dof from events group by event_type),
s as (select event_type, score / avg_score * dof / 20 as x, (dof / 20)::bigint as d from g, (select avg(value) as avg_score from events)),
u as (select event_type, x / 100 as x, d // 100 + 1 as d from s)
select event_type, d, round({sql.chi2_tail('x', 'd')}, 8) as p_value from u""")
def chi2_tail_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tail function at scores and degrees of freedom taken from the events."""
    events = table(spark, sf_dir, "events")
    grouped = events.groupBy("event_type").agg(F.sum("value").alias("score"), F.count(F.lit(1)).alias("n"))
    mean = events.agg(F.avg("value").alias("m")).select("m").scalar()
    placed = grouped.select(
        "event_type",
        (F.col("score") / mean * F.col("n") / 20 / 100).alias("x"),
        (F.floor(F.round(F.col("n") / 20) / 100) + 1).alias("d"),
    )
    return placed.select("event_type", "d", F.round(stats.chi2_sf("x", "d"), 8).alias("p_value"))


@query(f"""with {sql.sums(sql.ITEMS, NUMBERS)},
s as (select feature, sum(power(o - expected, 2) / expected) as chi2_score from sums group by feature)
select feature, round(chi2_score, 6) as chi2_score from s where feature not in ('l_tax', 'l_linenumber')""")
def exclude_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scores.class_sum_scores(con.class_sums(numeric_items(spark, sf_dir), NUMBERS, "y"))
    return rounded(scores.without_features(found.drop("p_value"), ["l_tax", "l_linenumber"]), "chi2_score")


@query(f"""with {sql.sums(sql.ITEMS, NUMBERS)},
s as (select feature, sum(power(o - expected, 2) / expected) as chi2_score, count(*) - 1 as dof from sums group by feature),
p as (select *, {sql.chi2_tail('chi2_score', 'dof')} as p from s)
select printf('%-40s | %12.4f', feature, chi2_score) as line, printf('%.4f', p) as p_text from p""")
def score_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ranking as report lines."""
    found = scores.class_sum_scores(con.class_sums(numeric_items(spark, sf_dir), NUMBERS, "y"))
    line = F.format_string("%-40s | %12.4f", "feature", "chi2_score")
    return rank.ranked(found, "chi2_score").select(line.alias("line"), stats.number_text(F.col("p_value")).alias("p_text"))
