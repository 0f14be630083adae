"""Data-quality tables of a price panel."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.operators.features import prepare_ohlcv

PRICES = ("open", "high", "low", "close", "adj_close")


def panel_summary(prices: DataFrame) -> DataFrame:
    """One row: rows, tickers, dates, first and last date, repeated keys, nulls per column."""
    keys = prices.groupBy("date", "ticker").agg(
        F.count("*").alias("n"),
        *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in prices.columns if c not in ("date", "ticker")],
    )
    return keys.agg(
        F.sum("n").alias("rows"),
        F.countDistinct("ticker").alias("tickers"),
        F.countDistinct("date").alias("dates"),
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
        F.sum(F.col("n") - 1).alias("repeated_keys"),
        *[F.sum(f"null_{c}").alias(f"null_{c}") for c in prices.columns if c not in ("date", "ticker")],
    )


def non_positive_prices(prices: DataFrame) -> DataFrame:
    there = [c for c in PRICES if c in prices.columns]
    return prices.filter(reduce(lambda a, b: a | b, [F.col(c) <= 0 for c in there]))


def extreme_returns(prices: DataFrame, threshold: float = 0.25) -> DataFrame:
    out = prepare_ohlcv(prices).filter(F.abs("ret_1d") >= threshold)
    return out.orderBy(F.desc(F.abs("ret_1d")), "date", "ticker")


def price_gaps(prices: DataFrame, threshold: float = 0.15) -> DataFrame:
    out = prepare_ohlcv(prices).filter(F.abs("open_gap") >= threshold)
    return out.orderBy(F.desc(F.abs("open_gap")), "date", "ticker")


def missing_dates(prices: DataFrame, calendar: DataFrame | None = None) -> DataFrame:
    """Per ticker: its dates, those of the calendar it lacks, and coverage (its dates over the calendar's)."""
    dates = (prices if calendar is None else calendar).select("date").distinct()
    total = dates.agg(F.count("*").alias("calendar_dates"))
    known = prices.select("ticker", "date").distinct().join(dates.withColumn("_in", F.lit(1)), "date", "left")
    return (
        known.groupBy("ticker")
        .agg(F.count("*").alias("available_dates"), F.count("_in").alias("_matched"))
        .crossJoin(F.broadcast(total))
        .select(
            "ticker",
            "available_dates",
            (F.col("calendar_dates") - F.col("_matched")).alias("missing_dates"),
            F.try_divide(F.col("available_dates"), F.col("calendar_dates")).alias("coverage_ratio"),
        )
    )


def missing_tickers(prices: DataFrame) -> DataFrame:
    total = prices.agg(F.countDistinct("ticker").alias("tickers"))
    return (
        prices.groupBy("date")
        .agg(F.countDistinct("ticker").alias("available_tickers"))
        .crossJoin(F.broadcast(total))
        .select("date", "available_tickers", (F.col("tickers") - F.col("available_tickers")).alias("missing_tickers"))
    )


def ticker_history(prices: DataFrame) -> DataFrame:
    return prices.groupBy("ticker").agg(
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
        F.count("*").alias("observations"),
        F.count_if(F.col("adj_close").isNull()).alias("null_adj_close"),
        F.count_if(F.col("volume").isNull()).alias("null_volume"),
    )


def sector_coverage(prices: DataFrame, universe: DataFrame) -> DataFrame:
    """Tickers of the universe and how many have prices, per sector."""
    seen = prices.select("ticker").distinct().withColumn("_seen", F.lit(1))
    return (
        universe.join(seen, "ticker", "left")
        .groupBy("sector")
        .agg(F.count("ticker").alias("universe_tickers"), F.count("_seen").alias("available_tickers"))
        .withColumn("coverage_ratio", F.try_divide(F.col("available_tickers"), F.col("universe_tickers")))
    )


def calendar_alignment(prices: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row: common dates, dates on one side only, and the share of the panel's dates that match."""
    a = prices.select("date").distinct().withColumn("_a", F.lit(1))
    b = benchmark.select("date").distinct().withColumn("_b", F.lit(1))
    both = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    out = a.join(b, "date", "full").agg(
        F.count_if(both).alias("common_dates"),
        F.count_if(F.col("_b").isNull()).alias("panel_only_dates"),
        F.count_if(F.col("_a").isNull()).alias("benchmark_only_dates"),
        F.count("_a").alias("_panel"),
    )
    return out.withColumn("alignment_ratio", F.try_divide(F.col("common_dates"), F.col("_panel"))).drop("_panel")


def quality_report(prices: DataFrame, benchmark: DataFrame, universe: DataFrame) -> dict[str, DataFrame]:
    return {
        "summary": panel_summary(prices),
        "non_positive_prices": non_positive_prices(prices),
        "missing_dates": missing_dates(prices),
        "missing_tickers": missing_tickers(prices),
        "history": ticker_history(prices),
        "extreme_returns": extreme_returns(prices),
        **({"price_gaps": price_gaps(prices)} if "open" in prices.columns else {}),
        "sector_coverage": sector_coverage(prices, universe),
        "calendar_alignment": calendar_alignment(prices, benchmark),
    }
