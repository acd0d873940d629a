"""The record tables of the library as views of the driver tables: orders are documents, customers are cases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.storage import read_table

NAMES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def read_tables(spark: SparkSession, sf_dir: str, names: tuple[str, ...] = NAMES) -> dict[str, DataFrame]:
    return {n: read_table(spark, sf_dir, n) for n in names}


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_table(spark, sf_dir, "customer")
    return c.select(F.col("c_nationkey").alias("company_id"), F.col("c_custkey").alias("case_id"), F.col("c_name").alias("case_name"), F.col("c_mktsegment").alias("case_type"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_custkey").alias("case_id"),
        F.col("o_orderkey").alias("document_id"),
        F.col("o_totalprice").alias("total_amount"),
        F.col("o_orderdate").alias("document_date"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_orderpriority").alias("document_type"),
    )


def lines(spark: SparkSession, sf_dir: str, how: str = "inner") -> DataFrame:
    li, p = read_table(spark, sf_dir, "lineitem"), read_table(spark, sf_dir, "part")
    return li.join(p.select("p_partkey", "p_retailprice"), li["l_partkey"] == p["p_partkey"], how).select(
        F.col("l_orderkey").alias("document_id"),
        F.col("l_linenumber").alias("line_no"),
        F.col("l_quantity").alias("quantity"),
        F.col("p_retailprice").alias("unit_price"),
        F.lit(0.0).alias("discount"),
        F.col("l_extendedprice").alias("total"),
        F.col("l_tax").alias("tax_rate"),
        F.col("l_shipdate").alias("line_date"),
    )


def plain_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_orderkey").alias("document_id"), F.col("l_extendedprice").alias("total"), F.col("l_tax").alias("tax_rate"), F.col("l_shipdate").alias("line_date"))
