"""Registered queries: names, text, target, filters, numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crivo.functions import stats, text
from crivo.operators import clean
from crivo.plans.registry import query, rounded
from crivo.plans.tables import table


@query("select c_custkey as \"Codigo\", c_mktsegment as \"Cor / Raca\", c_nationkey as \"Regiao\" from customer")
def normalize_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer")
    raw = customers.select(
        F.col("c_custkey").alias(" Código "), F.col("c_mktsegment").alias("Cor / Raça"), F.col("c_nationkey").alias("Região")
    )
    return clean.normalize_names(raw)


PLAIN = "replace(replace(strip_accents(text), 'º', 'o'), 'ª', 'a')"


@query(f"select doc_id, {PLAIN} as text, length({PLAIN}) as n_plain from documents")
def strip_accents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts without accents."""
    documents = clean.clean_text(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return documents.withColumn("n_plain", F.char_length("text").cast("long"))


MARKED = "case when c_nationkey % 3 = 0 then chr(9) || '  ' || c_mktsegment || ' ' || chr(10) when c_nationkey % 3 = 1 then ' ' || c_mktsegment end"


@query("select c_custkey, case when c_nationkey % 3 < 2 then c_mktsegment end as segment, case when c_nationkey % 3 < 2 then length(c_mktsegment) end as n from customer")
def trim_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").withColumn("segment", F.expr(MARKED))
    trimmed = customers.select("c_custkey", text.trim_all(F.col("segment")).alias("segment"))
    return trimmed.withColumn("n", F.char_length("segment").cast("long"))


SITUATION = "case l_returnflag when 'R' then ' Evadidos ' when 'A' then 'Em Curso' end"


@query("select l_orderkey, l_linenumber, case when l_returnflag = 'R' then 1 else 0 end as y from lineitem")
def derive_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text is trimmed before the comparison; missing text counts as 0."""
    items = table(spark, sf_dir, "lineitem").withColumn("situation", F.expr(SITUATION))
    return clean.binary_target(items, "situation", "Evadidos", "y").select("l_orderkey", "l_linenumber", "y")


@query("select l_orderkey, l_linenumber from lineitem where l_returnflag <> 'A'")
def exclude_in_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").withColumn("situation", F.expr(SITUATION))
    return clean.exclude_values(items, "situation", ["Em Curso"]).select("l_orderkey", "l_linenumber")


@query("select c_custkey, c_acctbal from customer")
def drop_columns_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.drop_strict(table(spark, sf_dir, "customer"), ["c_name", "c_nationkey", "c_mktsegment"])


@query("select c_custkey, c_acctbal from customer")
def drop_columns_present(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.drop_present(table(spark, sf_dir, "customer"), ["c_name", "c_nationkey", "c_mktsegment", "c_absent"])


@query("""select c_custkey, c_mktsegment, c_acctbal from customer where c_mktsegment <> 'BUILDING' and c_acctbal >= 0""")
def drop_null_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null text and not-a-number both make a row incomplete."""
    customers = table(spark, sf_dir, "customer").select(
        "c_custkey", F.expr("nullif(c_mktsegment, 'BUILDING')").alias("c_mktsegment"),
        F.expr("if(c_acctbal < 0, double('NaN'), c_acctbal)").alias("c_acctbal"),
    )
    return clean.drop_incomplete(customers)


@query("select c_custkey, coalesce(case when c_mktsegment <> 'BUILDING' then c_acctbal end, 0) as c_acctbal, c_mktsegment from customer")
def fill_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select(
        "c_custkey", F.expr("if(c_mktsegment <> 'BUILDING', c_acctbal, null)").alias("c_acctbal"), "c_mktsegment"
    )
    return clean.fill_zero(customers)


@query("select c_custkey, greatest(c_acctbal, 0) as c_acctbal, c_nationkey from customer")
def clip_negative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.clip_negative(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_nationkey"))


@query("""select o_orderkey::double as o_orderkey, try_cast(o_orderpriority[1] || '.5' as double) as digit,
case when o_orderstatus = 'P' then null else o_totalprice end as price, (o_orderstatus = 'F')::integer as y from orders""")
def cast_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text that is no number becomes missing."""
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("o_orderkey"),
        F.concat(F.substring("o_orderpriority", 1, 1), F.lit(".5")).alias("digit"),
        F.when(F.col("o_orderstatus") == "P", F.lit("NA")).otherwise(F.col("o_totalprice").cast("string")).alias("price"),
        (F.col("o_orderstatus") == "F").alias("y"),
    )
    return clean.to_numbers(orders, "y")


@query("select l_orderkey, l_linenumber::varchar as l_linenumber, l_quantity::varchar as l_quantity from lineitem")
def cast_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers as category text; whole floating numbers keep their ``.0``."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return clean.to_categories(items, ["l_linenumber", "l_quantity"])


@query("""select o_orderkey, case when o_orderstatus = 'P' then 0 else epoch(o_orderdate)::bigint end as day_timestamp,
case when o_orderstatus = 'F' then epoch(o_orderdate)::bigint + 11045 else 0 end as second_timestamp from orders""")
def date_epoch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Day-first dates as epoch seconds; unreadable text and null give 0."""
    day = F.date_format(F.col("o_orderdate").cast("date"), "dd/MM/yyyy")
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderstatus") == "P", F.lit("sem data")).otherwise(day).alias("day"),
        F.when(F.col("o_orderstatus") == "F", F.concat(day, F.lit(" 03:04:05"))).alias("second"),
    )
    return clean.day_first_epochs(orders, ["day", "second"]).drop("day", "second")


PROFILED = {"c_custkey": "number", "c_mktsegment": "text", "c_acctbal": "number"}
PROFILE_BASE = "select c_custkey, nullif(c_mktsegment, 'BUILDING') as c_mktsegment, c_acctbal from customer"


@query(" union all ".join(
    f"""select '{c}' as "column", '{kind}' as kind, count(*) as rows, count(*) - count({c}) as missing,
    count(*) > count({c}) as any_missing, {f'bool_or({c} < 0)' if kind == 'number' else 'false'} as any_negative
    from ({PROFILE_BASE})"""
    for c, kind in PROFILED.items()
))
def column_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").selectExpr(
        "c_custkey", "nullif(c_mktsegment, 'BUILDING') as c_mktsegment", "c_acctbal"
    )
    return clean.column_profile(customers)


@query("""select l_returnflag, round(sum(1 / (1 + exp(-(l_discount * 20 - 1)))), 4) as sigmoid_sum,
round(sum(ln(1 + exp(l_discount * 20 - 1)) - (l_discount * 20 - 1) * (l_returnflag = 'R')::integer), 4) as loss_sum
from lineitem group by l_returnflag""")
def sigmoid_log_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = F.col("l_discount") * 20 - 1
    y = (F.col("l_returnflag") == "R").cast("int")
    sums = table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(
        F.sum(stats.sigmoid(z)).alias("sigmoid_sum"), F.sum(stats.log_loss(z, y)).alias("loss_sum")
    )
    return rounded(sums, "sigmoid_sum", "loss_sum", digits=4)


@query("""select o_orderstatus, strftime(max(o_orderdate), '%d/%m/%Y %H:%M:%S') as latest,
printf('%.2f', max(o_totalprice)) as dearest from orders group by o_orderstatus""")
def report_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(
        F.max(F.col("o_orderdate").cast("timestamp_ntz")).alias("d"), F.max("o_totalprice").alias("p")
    )
    return grouped.select("o_orderstatus", stats.time_text(F.col("d")).alias("latest"), stats.number_text(F.col("p"), 2).alias("dearest"))


@query("""select page_id, case when length(name) > 1 and strpos(name[2:], '.') > 0 then regexp_replace(name, '\\.[^.]*$', '') else name end as base
from (select page_id, regexp_replace(url, '^.*/', '') as name from pages)""")
def base_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.base_name(F.col("url")).alias("base"))


@query("""select item_id, case when text in ('', 'NA', 'nan', 'null') or item_id % 3 = 0 then null else text end as text from benchmark""")
def na_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens that mean missing become null."""
    token = F.element_at(F.array(*[F.lit(v) for v in text.NA_VALUES]), (F.col("item_id") % len(text.NA_VALUES) + 1).cast("int"))
    items = table(spark, sf_dir, "benchmark").withColumn("text", F.when(F.col("item_id") % 3 == 0, token).otherwise(F.col("text")))
    return items.select("item_id", text.na_to_null(F.col("text")).alias("text"))
