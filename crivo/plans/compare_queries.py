"""Registered queries: agreement of two score tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crivo.functions.stats import ABS_TOLERANCE, REL_TOLERANCE
from crivo.operators import compare
from crivo.operators import contingency as con
from crivo.operators import scores
from crivo.plans import sql
from crivo.plans.registry import query, rounded
from crivo.plans.tables import numeric_items, table
from crivo.shared import materialize

A_FEATURES = ["l_discount", "l_tax", "l_quantity"]
B_FEATURES = ["l_discount", "l_tax", "l_linenumber"]


def full(spark: SparkSession, sf_dir: str, features: list[str]) -> DataFrame:
    """A score table, written down since a comparison reads it several times."""
    return materialize(scores.full_scores(con.class_sums(numeric_items(spark, sf_dir), features, "y")), "scores")


def by_class_sums(spark: SparkSession, sf_dir: str, features: list[str]) -> DataFrame:
    sums = con.class_sums(numeric_items(spark, sf_dir), features, "y")
    n = sums.groupBy("feature").agg(F.first("n").alias("n"))
    found = scores.class_sum_scores(sums).join(n, "feature")
    v = F.sqrt(F.col("chi2_score") / F.col("n"))
    return materialize(found.select("feature", "chi2_score", v.alias("cramers_v"), "p_value"), "scores")


def two_tables(a: list[str], b: list[str], b_term: str = "power(o - expected, 2) / expected") -> str:
    """CTEs ``a`` (full form) and ``b`` with the result columns."""
    def scored(name: str, features: list[str], term: str) -> str:
        listed = ", ".join(f"'{f}'" for f in features)
        return (
            f"{name}0 as (select feature, sum({term}) as chi2_score, any_value(n) as n, count(*) - 1 as dof"
            f" from sums where feature in ({listed}) group by feature),"
            f" {name} as (select feature, chi2_score, case when chi2_score >= 0 then sqrt(chi2_score / n) end as cramers_v,"
            f" {sql.chi2_tail('chi2_score', 'dof')} as p_value from {name}0)"
        )
    features = list(dict.fromkeys([*a, *b]))
    return f"{sql.sums(sql.ITEMS, features)}, {scored('a', a, sql.FULL_TERM)}, {scored('b', b, b_term)}"


@query(f"""with {two_tables(A_FEATURES, B_FEATURES[:2])}
select (select count(*) from a) as rows_a, 4 as columns_a, (select count(*) from b) as rows_b, 4 as columns_b, false as same_shape""")
def compare_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.shapes(full(spark, sf_dir, A_FEATURES), by_class_sums(spark, sf_dir, B_FEATURES[:2]))


@query(f"""with {two_tables(A_FEATURES, B_FEATURES)}
select 'feature' as "column", (select count(*) from a) as filled_a, (select count(*) from b) as filled_b, null::varchar as only_in
union all select 'chi2_score', (select count(*) from a), (select count(chi2_score) from b), null
union all select 'cramers_v', (select count(cramers_v) from a), null, 'a'
union all select 'p_value', (select count(p_value) from a), (select count(*) filter (p_value < 0.5) from b), null
union all select 'strong', null, (select count(*) from b), 'b'""")
def compare_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of two score tables, with the values they hold and the table that alone has them."""
    b = by_class_sums(spark, sf_dir, B_FEATURES).drop("cramers_v").withColumn("strong", F.coalesce(F.col("p_value") < 0.01, F.lit(False)))
    return compare.column_counts(full(spark, sf_dir, A_FEATURES), b.withColumn("p_value", F.when(F.col("p_value") < 0.5, F.col("p_value"))))


@query(f"""with {two_tables(A_FEATURES, B_FEATURES)}
select feature, 'a' as only_in from a where feature not in (select feature from b)
union all select feature, 'b' from b where feature not in (select feature from a)""")
def compare_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.feature_differences(full(spark, sf_dir, A_FEATURES), by_class_sums(spark, sf_dir, B_FEATURES))


@query(f"""with {two_tables(A_FEATURES, B_FEATURES)}, j as (select abs(a.chi2_score - b.chi2_score) as c,
abs(a.cramers_v - b.cramers_v) as v, abs(a.p_value - b.p_value) as p from a join b on a.feature = b.feature)
select 'chi2_score' as metric, round(avg(c), 8) as mae, round(avg(c * c), 8) as mse, round(max(c), 8) as max_diff from j
union all select 'cramers_v', round(avg(v), 8), round(avg(v * v), 8), round(max(v), 8) from j
union all select 'p_value', round(avg(p), 8), round(avg(p * p), 8), round(max(p), 8) from j""")
def compare_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = compare.error_metrics(full(spark, sf_dir, A_FEATURES), by_class_sums(spark, sf_dir, B_FEATURES))
    return rounded(found, "mae", "mse", "max_diff", digits=8)


@query(f"""with {two_tables(A_FEATURES, B_FEATURES)}
select feature, round(a.chi2_score, 8) as chi2_score_a, round(b.chi2_score, 8) as chi2_score_b,
case when a.feature is null then 'b' when b.feature is null then 'a' end as only_in from a full join b using (feature)""")
def compare_matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = compare.matched(full(spark, sf_dir, A_FEATURES), by_class_sums(spark, sf_dir, B_FEATURES), ["chi2_score"])
    return rounded(found, "chi2_score_a", "chi2_score_b", digits=8)


RANKED = [*A_FEATURES, "l_linenumber"]


@query(f"""with {two_tables(RANKED, RANKED)},
ra as (select feature, row_number() over (order by chi2_score desc, feature) as rank from a),
rb as (select feature, row_number() over (order by chi2_score desc, feature) as rank from b)
select ra.rank::integer as rank, ra.feature as feature_a, rb.feature as feature_b from ra join rb on ra.rank = rb.rank
where ra.rank <= 30 and ra.feature <> rb.feature""")
def compare_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = full(spark, sf_dir, RANKED), by_class_sums(spark, sf_dir, RANKED)
    return compare.rank_differences(a, b, "chi2_score", "chi2_score")


METRICS = ("chi2_score", "cramers_v", "p_value")


def verdict_sql(pair: str, other: str) -> str:
    """The verdict on table ``a`` with a note per feature, and another."""
    exact = " and ".join(f"a.{m} is not distinct from o.{m}" for m in (*METRICS, "note"))
    close = " and ".join(f"coalesce(abs(a.{m} - o.{m}) <= {ABS_TOLERANCE} + {REL_TOLERANCE} * abs(o.{m}), false)" for m in METRICS)
    both = "a.feature is not null and o.feature is not null"
    return f"""select '{pair}' as pair, case when bool_and({both} and {exact}) then 'identical'
    when bool_and({both} and {close} and a.note is not distinct from o.note) then 'equal within tolerance' else 'different' end as verdict
    from noted a full join ({other}) o on a.feature = o.feature"""


@query(f"""with {two_tables(A_FEATURES[:2], A_FEATURES[:2])},
noted as (select *, 'n' || round(chi2_score) as note from a),
b_noted as (select *, 'n' || round(chi2_score) as note from b)
{verdict_sql('same', 'select * from noted')} union all
{verdict_sql('noise', 'select * replace (chi2_score + 1e-7 as chi2_score) from noted')} union all
{verdict_sql('formula', 'select * from b_noted')} union all
{verdict_sql('features', "select * from noted where feature <> 'l_tax'")} union all
{verdict_sql('note', "select * replace (note || '!' as note) from noted")}""")
def compare_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on the same table, on noise below the tolerance, and on tables that differ.

    The last differs in a column that is no metric.
    """
    def noted(df: DataFrame) -> DataFrame:
        return df.withColumn("note", F.concat(F.lit("n"), F.format_string("%.1f", F.round("chi2_score"))))

    a = materialize(noted(full(spark, sf_dir, A_FEATURES[:2])), "scores")
    others = {
        "same": a, "noise": a.withColumn("chi2_score", F.col("chi2_score") + 1e-7),
        "formula": noted(by_class_sums(spark, sf_dir, A_FEATURES[:2])), "features": a.where(F.col("feature") != "l_tax"),
        "note": a.withColumn("note", F.concat("note", F.lit("!"))),
    }
    lines = [compare.verdict(a, b).select(F.lit(name).alias("pair"), "verdict") for name, b in others.items()]
    return reduce(DataFrame.unionByName, lines)
