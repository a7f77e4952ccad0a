"""The driver's tables in the roles of the catalogue: figures, sales, listings, holdings, rates.

The data are analogies; only the semantics are the catalogue's. Each view has its SQL twin in ``WITH``.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NOW = datetime(2001, 11, 4)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def condition():
    flag = F.col("l_returnflag")
    return F.when(flag == "N", "NEW_SEALED").when(flag == "R", "USED_COMPLETE").otherwise("DAMAGED")


def sales(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").select(F.col("l_partkey").alias("figure_id"), F.col("l_suppkey").alias("source_id"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("external_id"), condition().alias("condition"), F.col("l_extendedprice").alias("amount_usd"), F.col("l_shipdate").alias("sold_at"))


def brand_sales(spark: SparkSession, folder: str) -> DataFrame:
    """Sales by brand: groups are dense enough for a median to be one."""
    parts = table(spark, folder, "part").select(F.col("p_partkey").alias("figure_id"), F.col("p_brand").alias("brand"))
    return sales(spark, folder).join(parts, "figure_id").drop("figure_id").withColumnRenamed("brand", "figure_id")


def listings(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "lineitem")
    active = (F.col("l_linestatus") == "O") & (F.col("l_shipdate") >= F.lit("2001-01-01").cast("timestamp_ntz"))
    return rows.select(F.col("l_partkey").alias("figure_id"), condition().alias("condition"), F.col("l_extendedprice").alias("amount_usd"), active.alias("is_active"), F.round(1 - 4 * F.col("l_discount"), 4).alias("match_score"), F.col("l_shipdate").alias("last_seen_at"))


def figures(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select(F.col("p_partkey").alias("figure_id"), F.col("p_name").alias("name"), F.col("p_brand").alias("manufacturer"), F.col("p_type").alias("category"), F.col("p_retailprice").alias("msrp_usd"), F.col("p_size").alias("size"))


SALES = """sales AS (SELECT l_partkey AS figure_id, l_suppkey AS source_id, l_orderkey || '-' || l_linenumber AS external_id,
    CASE l_returnflag WHEN 'N' THEN 'NEW_SEALED' WHEN 'R' THEN 'USED_COMPLETE' ELSE 'DAMAGED' END AS condition, l_extendedprice AS amount_usd, l_shipdate AS sold_at FROM lineitem)"""
BRAND_SALES = f"""{SALES}, brand_sales AS (SELECT p_brand AS figure_id, condition, amount_usd, sold_at FROM sales JOIN part ON figure_id = p_partkey)"""
LISTINGS = """listings AS (SELECT l_partkey AS figure_id, CASE l_returnflag WHEN 'N' THEN 'NEW_SEALED' WHEN 'R' THEN 'USED_COMPLETE' ELSE 'DAMAGED' END AS condition,
    l_extendedprice AS amount_usd, l_linestatus = 'O' AND l_shipdate >= TIMESTAMP '2001-01-01' AS is_active, round(1 - 4 * l_discount, 4) AS match_score, l_shipdate AS last_seen_at FROM lineitem)"""
FIGURES = """figures AS (SELECT p_partkey AS figure_id, p_name AS name, p_brand AS manufacturer, p_type AS category, p_retailprice AS msrp_usd, p_size AS size FROM part)"""
STATS = """stats AS (SELECT figure_id, floor(coalesce(cur, al) * 100 + 0.5) / 100 AS market_value_usd, floor((cur - pri) / nullif(pri, 0) * 100 * 100 + 0.5) / 100 AS change_30d_pct, volume_90d FROM (
    SELECT figure_id, median(amount_usd) FILTER (sold_at >= TIMESTAMP '2001-10-05') AS cur, median(amount_usd) FILTER (sold_at >= TIMESTAMP '2001-09-05' AND sold_at < TIMESTAMP '2001-10-05') AS pri,
    median(amount_usd) AS al, count(*) AS volume_90d FROM sales WHERE condition = 'NEW_SEALED' AND sold_at >= TIMESTAMP '2001-08-06' GROUP BY figure_id))"""
ASKS = """asks AS (SELECT figure_id, CAST(round(CAST(median(amount_usd) AS DECIMAL(20,8)), 2) AS DOUBLE) AS ask_median_usd, count(*) AS ask_listings FROM listings
    WHERE is_active AND condition = 'NEW_SEALED' AND match_score >= 0.72 GROUP BY figure_id HAVING count(*) >= 3)"""
