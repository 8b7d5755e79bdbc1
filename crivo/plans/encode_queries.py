"""Registered queries: encoding and scaling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crivo.operators import contingency as con
from crivo.operators import encode, rank, scores
from crivo.plans import sql
from crivo.plans.registry import query, rounded
from crivo.plans.tables import items_of_parts, numeric_items, returned_items, table
from crivo.shared import materialize
from crivo.sources import sinks

PRIORITY_CODES = {"1-URGENT": 4, "2-HIGH": 3, "3-MEDIUM": 2, "4-NOT SPECIFIED": 1}


@query("""select o_orderkey, case o_orderpriority when '1-URGENT' then 4 when '2-HIGH' then 3 when '3-MEDIUM' then 2
when '4-NOT SPECIFIED' then 1 else -1 end as o_orderpriority from orders""")
def ordinal_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fixed order of priorities; the one without code gives -1."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    return encode.ordinal_encode(orders, "o_orderpriority", PRIORITY_CODES)


BANDS = """case o_orderpriority when '1-URGENT' then 'RFP>3,5' when '2-HIGH' then '0<RFP<=0,5'
when '3-MEDIUM' then 'Nao declarada' when '4-NOT SPECIFIED' then 'xyz' end"""


@query(f"""select o_orderkey, case {BANDS} when 'RFP>3,5' then 6 when '0<RFP<=0,5' then 1
when 'Nao declarada' then 0 else -1 end as income from orders""")
def income_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Income bands; unknown and missing text both give -1."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.expr(BANDS).alias("income"))
    return encode.ordinal_encode(orders, "income")


LABEL_COLUMNS = ["p_brand", "p_type", "p_name"]
LABEL_VALUES = " union all ".join(f"select '{c}' as \"column\", {c} as value from part" for c in LABEL_COLUMNS)
LABEL_FIT = f"""select "column", value, (dense_rank() over (partition by "column" order by value) - 1)::integer as code
from (select distinct * from ({LABEL_VALUES}))"""


@query(LABEL_FIT)
def label_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode.fit_labels(table(spark, sf_dir, "part"), LABEL_COLUMNS).frame


@query("""select 'l_partkey' as "column", value, (row_number() over (order by value) - 1)::integer as code
from (select distinct cast(l_partkey as varchar) as value from lineitem)""")
def label_fit_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of a column with many values, numbered range by range."""
    return encode.fit_labels(table(spark, sf_dir, "lineitem"), ["l_partkey"], window_values=0).frame


@query("""select l_linestatus, 'o_orderpriority' as "column", value,
(row_number() over (partition by l_linestatus order by value) - 1)::integer as code
from (select distinct l_linestatus, o_orderpriority as value from lineitem join orders on l_orderkey = o_orderkey)""")
def label_fit_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every group has codes of its own."""
    items = returned_items(spark, sf_dir)
    return encode.fit_labels(items, ["o_orderpriority"], by=["l_linestatus"]).frame


CODES = ", ".join(f"(dense_rank() over (order by {c}) - 1)::integer as {c}" for c in LABEL_COLUMNS)


@query(f"select p_partkey, {CODES} from part")
def label_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select("p_partkey", *LABEL_COLUMNS)
    return encode.encode_labels(parts, encode.fit_labels(parts, LABEL_COLUMNS), LABEL_COLUMNS)


HOT = "if(l_orderkey % 3 = 0, 'hot', case when l_orderkey % 3 = 1 then 'p' || l_partkey end)"


@query(f"""with t as (select l_orderkey, l_linenumber, {HOT} as item from lineitem)
select l_orderkey, l_linenumber, (dense_rank() over (order by coalesce(item, 'nan')) - 1)::integer as item from t""")
def label_encode_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of all rows have one value and a third none; the dictionary is not broadcast."""
    part = F.when(F.col("l_orderkey") % 3 == 1, F.concat(F.lit("p"), F.col("l_partkey")))
    item = F.when(F.col("l_orderkey") % 3 == 0, "hot").otherwise(part).alias("item")
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", item)
    labels = encode.fit_labels(items, ["item"], missing_as=encode.MISSING)
    return encode.encode_labels(items, labels, ["item"], most_bytes=0)


@query("""with v as (select distinct p_brand as b from part where p_size <= 5 and p_brand <> 'Brand#7'),
c as (select b, (row_number() over (order by b) - 1)::integer as code from v)
select p_partkey, coalesce(code, -1)::integer as p_brand from part left join c on p_brand = b""")
def label_unseen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fitted on some parts, applied to all: a brand the fit missed gives -1."""
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size")
    labels = encode.fit_labels(parts.where("p_size <= 5 and p_brand <> 'Brand#7'"), ["p_brand"])
    return encode.encode_labels(parts.drop("p_size"), labels, ["p_brand"])


@query("""select p_partkey, (dense_rank() over (order by case when p_type = 'ECONOMY' then 'nan' else p_type end) - 1)::integer
as p_type from part""")
def label_missing_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A missing value is a category of its own."""
    parts = table(spark, sf_dir, "part").select("p_partkey", F.expr("nullif(p_type, 'ECONOMY')").alias("p_type"))
    labels = encode.fit_labels(parts, ["p_type"], missing_as=encode.MISSING)
    return encode.encode_labels(parts, labels, ["p_type"])


@query("""select c_custkey::double as c_custkey, (dense_rank() over (order by c_mktsegment) - 1)::integer as c_mktsegment, c_nationkey
from customer""")
def label_remaining_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whatever feature is still text gets codes."""
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("double").alias("c_custkey"), "c_mktsegment", "c_nationkey")
    return encode.encode_remaining_text(customers, "c_nationkey")


@query(f"""with f as ({LABEL_FIT}), m as (select "column", greatest(count(*) - 15, 0) as more from f group by all)
select f."column", code, value, more from f join m on f."column" = m."column" where code < 15
union all select 'p_color', null, null, null""")
def label_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First fifteen codes per column, and a line for a column that has none."""
    labels = encode.fit_labels(table(spark, sf_dir, "part"), LABEL_COLUMNS)
    return encode.label_report(labels, [*LABEL_COLUMNS, "p_color"])


@query(f"""select "column", '{{' || string_agg('"' || value || '":' || code, ',' order by code) || '}}' as mapping
from ({LABEL_FIT}) group by "column" """)
def label_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dictionaries as JSON objects."""
    labels = encode.fit_labels(table(spark, sf_dir, "part"), LABEL_COLUMNS)
    return sinks.label_mapping(labels, LABEL_COLUMNS)


@query("""select distinct 'c_mktsegment' as "column", c_mktsegment as value from customer
union all select distinct 'c_nationkey', cast(c_nationkey as varchar) from customer""")
def category_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode.categories(table(spark, sf_dir, "customer"), ["c_mktsegment", "c_nationkey"])


SEGMENTS = ["BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
FLAGS = ", ".join(f"(c_mktsegment = '{s}')::integer as \"c_mktsegment_{s}\"" for s in SEGMENTS)


@query(f"select c_custkey, {FLAGS} from customer")
def one_hot_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    labels = encode.fit_labels(customers, ["c_mktsegment"])
    return encode.one_hot_wide(customers, encode.category_lists(labels, ["c_mktsegment"]))


@query("""select p_partkey, 'p_brand_' || p_brand as feature, 1 as value from part where p_brand <> (select min(p_brand) from part)
union all select p_partkey, 'p_type_' || p_type, 1 from part where p_type <> (select min(p_type) from part)""")
def one_hot_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    labels = encode.fit_labels(parts, ["p_brand", "p_type"])
    return encode.one_hot_long(parts, ["p_partkey"], labels, ["p_brand", "p_type"])


HOT = ["p_brand", "p_type", "l_linestatus"]


@query(f"""with {sql.table(sql.PART_ITEMS, HOT, keep_missing=True)},
firsts as (select feature, min(value) as first from tab group by feature),
sums as (select t.feature || '_' || value as feature, o::double as o, col_total as n_class, n, expected
from tab t join firsts f on t.feature = f.feature where value <> first),
scored as (select feature, sum({sql.FULL_TERM}) as chi2_score, any_value(n) as n, count(*) - 1 as dof from sums group by feature)
select feature, round(chi2_score, 6) as chi2_score, round(sqrt(chi2_score / n), 8) as cramers_v,
round({sql.chi2_tail('chi2_score', 'dof')}, 8) as p_value from scored""")
def one_hot_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all one-hot columns, from the contingency counts alone."""
    cross = con.contingency_table(items_of_parts(spark, sf_dir), HOT, "y", keep_missing=True, n_classes=2)
    found = scores.full_scores(con.one_hot_sums(cross))
    return rounded(rounded(rank.ranked(found, "chi2_score"), "chi2_score"), "cramers_v", "p_value", digits=8)


@query(f"""with {sql.table(sql.PART_ITEMS, HOT, keep_missing=True)},
firsts as (select feature, min(value) as first from tab group by feature),
sums as (select t.feature || '_' || value as feature, o::double as o, col_total as n_class, n, expected
from tab t join firsts f on t.feature = f.feature where value <> first),
scored as (select feature, sum({sql.FULL_TERM}) as chi2_score, any_value(n) as n, count(*) - 1 as dof from sums group by feature)
select feature, round(chi2_score, 6) as chi2_score, round(sqrt(chi2_score / n), 8) as cramers_v,
round({sql.chi2_tail('chi2_score', 'dof')}, 8) as p_value from scored""")
def one_hot_sparse_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same scores from sparse rows; names join the scores at the end."""
    items = items_of_parts(spark, sf_dir).select("y", *HOT)
    labels = encode.fit_labels(items, HOT)
    layout = encode.SparseLayout.of(labels, HOT)
    found = scores.full_scores(con.sparse_class_sums(encode.one_hot_sparse(items, labels, layout), "y"))
    named = found.withColumnRenamed("feature", "index").join(layout.names(labels), "index")
    lines = named.select(con.feature_name(F.col("feature"), F.col("value")).alias("feature"), "chi2_score", "cramers_v", "p_value")
    return rounded(rounded(lines, "chi2_score"), "cramers_v", "p_value", digits=8)


@query("""with c as (select *, dense_rank() over (order by p_brand) - 1 as b, dense_rank() over (order by t) - 1 as k
from (select p_partkey, p_brand, p_size % 5 as s, nullif(p_type, 'PROMO') as t from part)),
n as (select count(distinct p_brand) - 1 as n from part)
select p_partkey, concat_ws(',', if(s <> 0, '0', null), if(b > 0, cast(b as varchar), null), if(t is not null and k > 0, cast(n + k as varchar), null)) as indices,
concat_ws(',', if(s <> 0, cast(s as varchar), null), if(b > 0, '1', null), if(t is not null and k > 0, '1', null)) as amounts from c, n""")
def one_hot_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places and values of what is not zero in a one-hot table, with a number ahead and missing categories."""
    parts = table(spark, sf_dir, "part").select(
        "p_partkey", "p_brand", (F.col("p_size") % 5).alias("size"), F.expr("nullif(p_type, 'PROMO')").alias("p_type"))
    labels = encode.fit_labels(parts, ["p_brand", "p_type"])
    found = encode.one_hot_sparse(parts, labels, encode.SparseLayout.of(labels, ["p_brand", "p_type"], ["size"]))
    amounts = F.transform("values", lambda v: v.cast("int").cast("string"))
    return found.select("p_partkey", F.array_join(F.col("indices").cast("array<string>"), ",").alias("indices"), F.array_join(amounts, ",").alias("amounts"))


@query(f"""with {sql.table("select y, 'c_' || (l_linenumber % 2) as a_b, 'b_c_' || (l_linenumber % 3) as a from (" + sql.ITEMS + ")", ['a', 'a_b'], keep_missing=True)},
firsts as (select feature, min(value) as first from tab group by feature),
sums as (select t.feature, value, o::double as o, col_total as n_class, n, expected
from tab t join firsts f on t.feature = f.feature where value <> first),
scored as (select feature, value, sum({sql.FULL_TERM}) as chi2_score from sums group by feature, value)
select feature as "column", value, feature || '_' || value as feature, round(chi2_score, 6) as chi2_score from scored""")
def one_hot_same_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Column ``a`` with value ``b_c_1`` and column ``a_b`` with ``c_1`` have one name and two scores."""
    items = numeric_items(spark, sf_dir).select(
        "y", F.concat(F.lit("c_"), F.col("l_linenumber") % 2).alias("a_b"), F.concat(F.lit("b_c_"), F.col("l_linenumber") % 3).alias("a"))
    cross = con.contingency_table(items, ["a", "a_b"], "y", keep_missing=True)
    found = scores.full_scores(con.one_hot_sums(cross), keep_value=True)
    named = found.select(F.col("feature").alias("column"), "value", con.feature_name(F.col("feature"), F.col("value")).alias("feature"), "chi2_score")
    return rounded(named, "chi2_score")


@query("""with b as (select min(c_acctbal) as lo, max(c_acctbal) as hi, min(c_nationkey) as lo2, max(c_nationkey) as hi2 from customer)
select c_custkey, round((c_acctbal - lo) / (hi - lo + 1e-12), 8) as c_acctbal,
round((c_nationkey - lo2) / (hi2 - lo2 + 1e-12), 8) as c_nationkey from customer, b""")
def minmax_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_nationkey")
    scaled = encode.scale_min_max(customers, ["c_acctbal", "c_nationkey", "c_absent"])
    return rounded(scaled, "c_acctbal", "c_nationkey", digits=8)


BOUNDS = " union all ".join(
    f"select l_linestatus, '{c}' as feature, min({c}::double) as min, max({c}::double) as max from lineitem group by l_linestatus"
    for c in ("l_quantity", "l_extendedprice")
)


@query(f"select * from ({BOUNDS})")
def minmax_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode.min_max_by(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice"], "l_linestatus")


@query(f"select feature, min(min) as min, max(max) as max from ({BOUNDS}) group by feature")
def minmax_two_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds per group first, then over all groups."""
    items = table(spark, sf_dir, "lineitem")
    return encode.merged_bounds(encode.min_max_by(items, ["l_quantity", "l_extendedprice"], "l_linestatus"))


@query("""with b as (select min(l_extendedprice) as lo, max(l_extendedprice) as hi from lineitem)
select l_returnflag, round(sum((l_extendedprice - lo) / (hi - lo + 1e-12)), 4) as scaled_sum from lineitem, b group by l_returnflag""")
def scale_by_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scaling by bounds that were written down."""
    items = numeric_items(spark, sf_dir)
    bounds = materialize(encode.min_max(items, ["l_extendedprice"]), "bounds")
    scaled = encode.scale_by(items, bounds, ["l_extendedprice"])
    return scaled.groupBy("l_returnflag").agg(F.round(F.sum("l_extendedprice"), 4).alias("scaled_sum"))
