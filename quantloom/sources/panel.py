"""Panels derived from the driver tables.

A security panel is long: one row per date and ticker.  Here a supplier is a
ticker and an ISO week a date; the price is built from average tax and discount,
so that returns stay moderate.  Prices are rounded, which makes ranks and ties
independent of summation order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _week():
    return F.date_trunc("week", F.col("l_shipdate").cast("date")).cast("date").alias("date")


def _price():
    return F.round(100 * (1 + F.avg("l_tax") - F.avg("l_discount")), 6).alias("adj_close")


def security_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """date, ticker, adj_close, close, volume, dollar_volume."""
    lines = table(spark, sf_dir, "lineitem")
    return (
        lines.groupBy(_week(), F.concat(F.lit("S"), F.col("l_suppkey")).alias("ticker"))
        .agg(
            _price(),
            F.sum("l_quantity").alias("volume"),
            F.round(F.sum("l_extendedprice"), 2).alias("dollar_volume"),
        )
        .withColumn("close", F.col("adj_close"))
    )


def sectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ticker, sector: the region of the supplier's nation."""
    nation, region = (table(spark, sf_dir, t) for t in ("nation", "region"))
    return (
        table(spark, sf_dir, "supplier")
        .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(F.concat(F.lit("S"), F.col("s_suppkey")).alias("ticker"), F.col("r_name").alias("sector"))
    )


def universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ticker, name, sector of every supplier."""
    names = table(spark, sf_dir, "supplier").select(F.concat(F.lit("S"), F.col("s_suppkey")).alias("ticker"), F.col("s_name").alias("name"))
    return names.join(sectors(spark, sf_dir), "ticker", "left")


def market_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """date, adj_close of all suppliers together."""
    return table(spark, sf_dir, "lineitem").groupBy(_week()).agg(_price())
