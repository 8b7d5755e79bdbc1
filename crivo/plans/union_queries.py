"""Registered queries: unions of differing tables, files, audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crivo.operators import align
from crivo.operators.clean import ABSENT
from crivo.plans.registry import query
from crivo.plans.tables import table
from crivo.shared import work_path
from crivo.sources import files, sinks


def halves(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Two years of orders whose columns differ, and a third without rows."""
    orders = table(spark, sf_dir, "orders")
    status = F.expr("nullif(o_orderstatus, 'P')").alias("o_orderstatus")
    even = orders.where("o_orderkey % 2 = 0").select("o_orderkey", "o_totalprice", "o_orderpriority")
    odd = orders.where("o_orderkey % 2 = 1").select("o_custkey", "o_orderkey", F.when(F.col("o_custkey") % 5 > 0, F.col("o_totalprice")).alias("o_totalprice"), status)
    return {"even": even, "odd": odd, "none": even.where("o_orderkey < 0")}


@query("""select 0::bigint as o_custkey, o_orderkey, o_orderpriority, '0' as o_orderstatus, o_totalprice from orders where o_orderkey % 2 = 0
union all select o_custkey, o_orderkey, '0', nullif(o_orderstatus, 'P'), case when o_custkey % 5 > 0 then o_totalprice end
from orders where o_orderkey % 2 = 1""")
def aligned_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Absent columns hold 0; missing values of present columns stay missing."""
    frames = halves(spark, sf_dir)
    columns = align.all_columns(list(frames.values()))
    texts = {"o_orderpriority", "o_orderstatus"}
    parts = [
        align.aligned(df, columns, 0).select(*[F.col(c).cast("string") if c in texts else F.col(c).cast("bigint") if c.endswith("key") else F.col(c) for c in columns])
        for df in frames.values()
    ]
    return align.aligned_union(parts)


@query("""select l_orderkey::double as l_orderkey, l_quantity, 0.0::double as l_tax, (l_returnflag = 'R')::integer as y from lineitem where l_linestatus = 'F'
union all select l_orderkey::double, 0.0::double, l_tax, (l_returnflag = 'R')::integer from lineitem where l_linestatus <> 'F'""")
def aligned_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts with differing columns as one numeric table."""
    items = table(spark, sf_dir, "lineitem").withColumn("y", F.col("l_returnflag") == "R")
    frames = [
        items.where("l_linestatus = 'F'").select("l_orderkey", "l_quantity", "y"),
        items.where("l_linestatus <> 'F'").select("y", "l_tax", "l_orderkey"),
    ]
    columns = align.all_columns(frames)
    return align.aligned_union([align.numbers_aligned(df, columns, "y") for df in frames])


@query("""select o_orderkey, o_totalprice, o_orderpriority, null::bigint as o_custkey, null::varchar as o_orderstatus from orders where o_orderkey % 2 = 0
union all select o_orderkey, case when o_custkey % 5 > 0 then o_totalprice end, null, o_custkey, nullif(o_orderstatus, 'P') from orders where o_orderkey % 2 = 1""")
def consolidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Absent columns are missing."""
    return align.consolidated(list(halves(spark, sf_dir).values()))


@query("""select coalesce(l_linestatus, '(total)') as l_linestatus, count(*) as n_rows, 10 as n_columns
from lineitem group by rollup (l_linestatus)""")
def row_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.row_audit(table(spark, sf_dir, "lineitem"), "l_linestatus")


HEADERS = {"documents": ["doc_id", "text", "lang", "source", "n_chars"], "labels": ["doc_id", "quality", "toxic"], "benchmark": ["item_id", "text"],
           "pages": ["page_id", "url", "html"]}
SPARSE = {"documents": {"lang": "nullif(lang, 'de')"}, "labels": {"toxic": "nullif(toxic, 0)"}}
FILLED = " union all ".join(
    f"""select '{c}' as "column", '{t}' as source, count(*) as n_rows, count({SPARSE.get(t, {}).get(c, c)}) as n_filled from {t}"""
    for t, columns in HEADERS.items() for c in columns)


@query(FILLED)
def column_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The union of all columns, with the tables that have each and how many values they hold."""
    frames = {t: table(spark, sf_dir, t).withColumns({c: F.expr(e) for c, e in SPARSE.get(t, {}).items()}) for t in HEADERS}
    return align.presence(frames)


@query("""with even as (select count(*) as n from orders where o_orderkey % 2 = 0), odd as (select count(*) as n from orders where o_orderkey % 2 = 1),
priced as (select count(*) as n from orders where o_orderkey % 2 = 0 and o_custkey % 5 > 0)
select 'a' as source, 'Codigo' as "column", n as n_rows, n as n_filled from even union all select 'a', 'Preco', even.n, priced.n from even, priced
union all select 'a', 'Situacao', n, n from even union all select 'b', 'Codigo', n, n from odd union all select 'b', 'Prioridade', n, n from odd
union all select 'b', 'Situacao', n, n from odd""")
def columns_of_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which file has which column, and how many values it holds there."""
    texts = files.read_files(spark, raw_files(spark, sf_dir, f"{files.SOURCE}="))
    return align.filled_counts(texts, files.SOURCE, ABSENT)


@query("select 'none' as source_file union all select n_name from nation where n_nationkey not in (select c_nationkey from customer where c_nationkey % 4 > 0)")
def empty_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listed sources without any row."""
    nations = table(spark, sf_dir, "nation").select(F.col("n_name").alias("source_file"), "n_nationkey")
    customers = table(spark, sf_dir, "customer").where("c_nationkey % 4 > 0")
    # AQE decides: a few nations here, whatever a caller has elsewhere.
    rows = customers.join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    listed = nations.select("source_file").unionByName(spark.createDataFrame([("none",)], "source_file string"))
    return align.empty_sources(rows, listed)


def raw_files(spark: SparkSession, sf_dir: str, prefix: str = "") -> list[str]:
    """Orders written as delimited files with accented headers in differing order, in folders ``a`` and ``b``."""
    orders = table(spark, sf_dir, "orders")
    folder = work_path(spark, "raw")
    price = F.when(F.col("o_custkey") % 5 > 0, F.col("o_totalprice").cast("string")).otherwise("NA").alias("Preço")
    first = orders.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("Código"), price, F.col("o_orderstatus").alias(" Situação "))
    second = orders.where("o_orderkey % 2 = 1").select(F.col("o_orderstatus").alias(" Situação "), F.col("o_orderkey").alias("Código"), F.col("o_orderpriority").alias("Prioridade"))
    for name, df in (("a", first), ("b", second)):
        df.write.csv(f"{folder}/{prefix}{name}", sep=";", header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return [f"{folder}/{prefix}{name}/*.csv" for name in "ab"]


@query("""select o_orderkey as "Codigo", case when o_custkey % 5 > 0 then o_totalprice end as "Preco", o_orderstatus as "Situacao", null::varchar as "Prioridade" from orders where o_orderkey % 2 = 0
union all select o_orderkey, null, o_orderstatus, o_orderpriority from orders where o_orderkey % 2 = 1""")
def read_differing_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with other headers, read by name, typed by all their values, missing tokens as null."""
    texts = files.read_files(spark, raw_files(spark, sf_dir)).drop(ABSENT)
    return files.apply_types(texts, files.infer_types(texts)).drop(files.SOURCE)


@query("""select o_orderkey as "Codigo", case when o_orderkey > (select max(o_orderkey) - 5 from orders) then o_orderkey + 0.5 else o_orderkey end::double as "Valor",
case when o_orderkey = (select max(o_orderkey) from orders) then 'x' else cast(o_orderkey as varchar) end as "Texto",
cast(12345678901234567890::hugeint + o_orderkey as varchar) as "Matricula", o_orderkey || (case when o_orderkey % 2 = 0 then 'd' else 'f' end) as "Turma",
'1234567890123456.' || lpad(cast(o_orderkey % 1000 as varchar), 3, '0') as "Saldo",
'Codigo bigint, Matricula decimal(38,0), Saldo decimal(38,3), Texto string, Turma string, Valor double' as types from orders""")
def types_of_late_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole numbers with a few fractions, or one text, far down, long codes, and text that casts take for numbers: no value is lost."""
    orders = table(spark, sf_dir, "orders")
    last = orders.agg(F.max("o_orderkey").alias("m")).scalar()
    key, whole = F.col("o_orderkey"), F.col("o_orderkey").cast("string")
    columns = {
        "Codigo": key, "Valor": F.when(key > last - 5, (key + 0.5).cast("string")).otherwise(whole),
        "Texto": F.when(key == last, F.lit("x")).otherwise(whole), "Matricula": F.expr("12345678901234567890BD + o_orderkey").cast("string"),
        "Turma": F.concat(whole, F.when(key % 2 == 0, "d").otherwise("f")), "Saldo": F.concat(F.lit("1234567890123456."), F.lpad((key % 1000).cast("string"), 3, "0")),
    }
    folder = work_path(spark, "late")
    orders.select(*[c.alias(name) for name, c in columns.items()]).write.csv(folder, sep=";", header=True)
    texts = files.read_files(spark, f"{folder}/*.csv").drop(files.SOURCE)
    types = files.infer_types(texts)
    typed = files.apply_types(texts, types)
    spelled = [F.col(c).cast("string").alias(c) if types[c].startswith("decimal") else F.col(c) for c in columns]
    return typed.select(*spelled, F.lit(", ".join(f"{c} {types[c]}" for c in sorted(types))).alias("types"))


@query("""select 'Codigo' as "column", 'bigint' as type, 0::bigint as lost union all
select 'Preco', 'bigint', count(*) from orders where o_orderkey % 2 = 0 and o_custkey % 5 > 0 and o_totalprice <> trunc(o_totalprice)""")
def type_misfits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that a declared type would lose."""
    texts = files.read_files(spark, raw_files(spark, sf_dir)).drop(ABSENT)
    whole = texts.withColumn("Preco", F.expr("if(`Preco` like '%.0', substring_index(`Preco`, '.', 1), `Preco`)"))
    return files.misfits(whole, {"Codigo": "bigint", "Preco": "bigint", "Situacao": "string"})


@query("""select l_linestatus as source_file, count(*) as n_rows, 3 as n_columns from lineitem group by l_linestatus
union all select '(total)', count(*), 3 from lineitem""")
def consolidate_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partitioned write, read back, consolidated write, and the audit of the result."""
    items = table(spark, sf_dir, "lineitem").select("l_quantity", "l_tax", "l_returnflag", F.col("l_linestatus").alias("source_file"))
    parts, whole = work_path(spark, "parts"), work_path(spark, "whole")
    sinks.write_partitions(items, parts)
    return sinks.write_consolidated(spark.read.schema(items.schema).parquet(parts), whole)


@query("""select l_linestatus as source_file, count(*) as n_rows, 3 as n_columns, count(*) filter (l_tax = 0) as untaxed,
count(*) filter (l_quantity % 7 = 0) as incomplete from lineitem group by l_linestatus
union all select '(total)', count(*), 3, count(*) filter (l_tax = 0), count(*) filter (l_quantity % 7 = 0) from lineitem""")
def audit_while_writing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, and those that meet a condition, counted by source in the write itself."""
    quantity = F.when(F.col("l_quantity") % 7 != 0, F.col("l_quantity")).alias("l_quantity")
    items = table(spark, sf_dir, "lineitem").select(quantity, "l_tax", "l_returnflag", F.col("l_linestatus").alias("source_file"))
    tests = {"untaxed": F.col("l_tax") == 0, "incomplete": F.col("l_quantity").isNull()}
    return sinks.write_consolidated(items, work_path(spark, "whole"), tests=tests)


@query("""select 'one' as layout, l_shipmode as mode, sum(l_quantity)::double as quantity from (select *, 'm' || l_linenumber as l_shipmode from lineitem) group by all
union all select 'many', 'm' || l_linenumber, sum(l_quantity)::double from lineitem group by all""")
def result_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A result written as one sorted file, and as a folder of files, and read again."""
    mode = F.concat(F.lit("m"), F.col("l_linenumber")).alias("mode")
    found = table(spark, sf_dir, "lineitem").groupBy(mode).agg(F.sum("l_quantity").alias("quantity"))
    parts = []
    for layout in ("one", "many"):
        path = work_path(spark, "result")
        sinks.write_result(found, path, [F.desc("quantity"), "mode"], single_file=layout == "one")
        again = spark.read.csv(path, header=True, schema="mode string, quantity double")
        parts.append(again.select(F.lit(layout).alias("layout"), "mode", "quantity"))
    return parts[0].unionByName(parts[1])


@query("""select '0' || (l_linenumber % 4) || '/a b+c' as source_file, count(*) as n_rows, sum(l_quantity)::double as quantity
from lineitem group by all""")
def parts_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delimited parts keep their source through two rewrites, whatever signs its name holds."""
    source = F.concat(F.lit("0"), F.col("l_linenumber") % 4, F.lit("/a b+c")).alias(files.SOURCE)
    items = table(spark, sf_dir, "lineitem").select("l_quantity", "l_linenumber", source)
    first, second = work_path(spark, "parts"), work_path(spark, "parts")
    sinks.write_delimited_partitions(items, first)
    once = files.read_files(spark, f"{first}/*/*.csv", sep=",")
    sinks.write_delimited_partitions(once, second)
    again = files.read_files(spark, f"{second}/*/*.csv", sep=",")
    typed = files.apply_types(again, files.infer_types(again))
    return typed.groupBy(files.SOURCE).agg(F.count(F.lit(1)).alias("n_rows"), F.sum("l_quantity").alias("quantity"))
