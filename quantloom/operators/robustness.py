"""Summaries of robustness studies: distributions, regimes, winners, holding periods, passive benchmarks."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions import stats
from quantloom.functions.windows import ordered, upto
from quantloom.operators.costs import linear_cost


def describe(df: DataFrame, value: str, keys: Sequence[str] = (), shares: Sequence[float] = (0.05, 0.25, 0.5, 0.75, 0.95)) -> DataFrame:
    """Count, mean, deviation, extremes, percentiles and the sample skewness of a column."""
    n = F.count(value)
    skew = F.when((n > 2) & (F.stddev_pop(value) > 0), F.skewness(value) * F.sqrt(n * (n - 1.0)) / (n - 2))
    return df.groupBy(*keys).agg(
        n.alias("observations"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("deviation"),
        F.min(value).alias("minimum"),
        *[stats.middle(value, q).alias(f"p{round(100 * q)}") for q in shares],
        F.max(value).alias("maximum"),
        skew.alias("skewness"),
    )


def range_summary(df: DataFrame, value: str, variant: str, keys: Sequence[str] = ()) -> DataFrame:
    """Spread of a metric over the variants of each key."""
    return df.groupBy(*keys).agg(
        F.countDistinct(variant).alias("variants"),
        F.avg(value).alias("mean"),
        stats.middle(value).alias("median"),
        F.min(value).alias("minimum"),
        F.max(value).alias("maximum"),
        (F.max(value) - F.min(value)).alias("range"),
    )


def frequency_table(df: DataFrame, label: str, keys: Sequence[str] = ()) -> DataFrame:
    """Rows per label and their share of the key's labelled rows."""
    counted = df.filter(F.col(label).isNotNull()).groupBy(*keys, label).agg(F.count("*").alias("rows"))
    return counted.withColumn("share", F.col("rows") / F.sum("rows").over(Window.partitionBy(*(keys or [F.lit(0)]))))


def change_summary(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Mean and largest absolute first difference in date order."""
    step = df.withColumn("_step", F.abs(F.col(value) - F.lag(value).over(ordered(keys))))
    return step.groupBy(*keys).agg(
        F.count("_step").alias("changes"), F.avg("_step").alias("mean_absolute_change"), F.max("_step").alias("largest_absolute_change")
    )


def regimes(df: DataFrame, value: str, names: Sequence[str], output: str = "regime") -> DataFrame:
    """Bins by equally spaced quantiles of the whole sample; the outer edges are open, a value on an edge is in the lower bin."""
    cuts = [(k + 1) / len(names) for k in range(len(names) - 1)]
    edges = df.agg(*[stats.middle(value, q).alias(f"_edge{k}") for k, q in enumerate(cuts)])
    label = F.lit(names[-1])
    for k in reversed(range(len(cuts))):
        label = F.when(F.col(value) <= F.col(f"_edge{k}"), names[k]).otherwise(label)
    binned = df.crossJoin(edges).withColumn(output, F.when(F.col(value).isNotNull(), label))
    return binned.drop(*[f"_edge{k}" for k in range(len(cuts))])


def winners(df: DataFrame, value: str, entity: str = "portfolio") -> DataFrame:
    """How often each entity has the day's largest value (ties: first by name), over days on which anyone has one."""
    best = df.filter(F.col(value).isNotNull()).groupBy("date").agg(F.max(F.struct(F.col(value).alias("v"), F.lit(0).alias("z"))).alias("_m"))
    tied = df.join(best, "date").filter(F.col(value) == F.col("_m.v")).groupBy("date").agg(F.min(entity).alias(entity))
    wins = tied.groupBy(entity).agg(F.count("*").alias("wins"))
    return wins.withColumn("win_fraction", F.col("wins") / F.sum("wins").over(Window.partitionBy(F.lit(0))))


def period_returns(daily: DataFrame, rebalances: DataFrame, returns: str, keys: Sequence[str] = ()) -> DataFrame:
    """Daily returns compounded over each holding period, from a rebalance up to the day before the next."""
    starts = rebalances.select(*keys, "date").distinct().withColumn("_start", F.col("date"))
    held = daily.join(starts, [*keys, "date"], "left")
    held = held.withColumn("period_start", F.last("_start", ignorenulls=True).over(upto(ordered(keys)))).filter("period_start is not null")
    return held.groupBy(*keys, "period_start").agg(
        F.max("date").alias("period_end"), F.count(returns).alias("days"), stats.compound(returns).alias("period_return")
    )


def buy_and_hold(market: DataFrame, returns: str, bps: float) -> DataFrame:
    """A passive holding with one entry trade: its cost falls on the first day with a return."""
    first = F.row_number().over(Window.partitionBy(F.col(returns).isNull()).orderBy("date")) == 1
    trade = F.when(first & F.col(returns).isNotNull(), 1.0).otherwise(0.0)
    out = market.withColumn("turnover", trade).withColumn("transaction_cost", linear_cost("turnover", bps))
    return out.withColumn("net_return", F.col(returns) - F.col("transaction_cost"))


def downside_fit(df: DataFrame, y: str, m: str, keys: Sequence[str] = ()) -> DataFrame:
    """y on the market and its negative part: alpha, beta, extra downside beta, and their sum."""
    low = F.least(F.col(m), F.lit(0.0))
    rows = df.filter(F.col(y).isNotNull() & F.col(m).isNotNull()).withColumn("_low", low)
    sums = rows.groupBy(*keys).agg(
        F.count("*").alias("observations"),
        *[F.avg(c).alias(f"_m{i}") for i, c in enumerate((y, m, "_low"))],
        F.var_pop(m).alias("_v1"),
        F.var_pop("_low").alias("_v2"),
        F.covar_pop(m, "_low").alias("_c12"),
        F.covar_pop(y, m).alias("_c1"),
        F.covar_pop(y, "_low").alias("_c2"),
    )
    det = F.col("_v1") * F.col("_v2") - F.col("_c12") * F.col("_c12")
    det = F.when(det > 0, det)
    beta = (F.col("_c1") * F.col("_v2") - F.col("_c2") * F.col("_c12")) / det
    extra = (F.col("_c2") * F.col("_v1") - F.col("_c1") * F.col("_c12")) / det
    return sums.select(
        *keys,
        "observations",
        (F.col("_m0") - beta * F.col("_m1") - extra * F.col("_m2")).alias("alpha"),
        beta.alias("beta"),
        extra.alias("downside_extra"),
        (beta + extra).alias("downside_beta"),
    )


def hedge_comparison(daily: DataFrame, market: DataFrame, keys: Sequence[str] = ("portfolio",), periods: int = stats.PERIODS) -> DataFrame:
    """The short book against a passive short of the market with the same exposure."""
    passive: Column = -F.col("short_exposure") * F.col("market_return")
    rows = daily.join(market, "date").filter("market_return is not null").withColumn("_passive", passive)
    gap = F.col("short_return") - F.col("_passive")
    return rows.groupBy(*keys).agg(
        F.count("*").alias("days"),
        F.sum("short_return").alias("short_total"),
        F.sum("_passive").alias("passive_total"),
        (F.avg(gap) * periods).alias("annualised_difference"),
        (F.stddev_samp(gap) * math.sqrt(periods)).alias("difference_volatility"),
        F.avg((gap > 0).cast("int")).alias("positive_fraction"),
    )
