"""The given tables as inputs of the registered queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def returned() -> Column:
    """The binary target: was the item returned?"""
    return (F.col("l_returnflag") == "R").cast("int")


def returned_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with the attributes of their order and the target ``y``."""
    items = table(spark, sf_dir, "lineitem")
    orders = table(spark, sf_dir, "orders")
    return items.join(orders, items.l_orderkey == orders.o_orderkey).withColumn("y", returned())


def items_of_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with the attributes of their part and the target ``y``."""
    items = table(spark, sf_dir, "lineitem")
    parts = table(spark, sf_dir, "part")
    return items.join(parts, items.l_partkey == parts.p_partkey).withColumn("y", returned())


def numeric_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with the target ``y``."""
    return table(spark, sf_dir, "lineitem").withColumn("y", returned())
