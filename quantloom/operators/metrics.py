"""Return and concentration metrics, per key."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.functions import stats
from quantloom.functions.stats import PERIODS, TOLERANCE
from quantloom.functions.windows import frame, ordered, rolling, upto


def add_wealth(df: DataFrame, returns: str = "return", keys: Sequence[str] = (), initial: float = 1.0) -> DataFrame:
    """wealth and drawdown; the initial wealth counts as a peak, null returns give null rows."""
    spec = upto(ordered(keys))
    r = F.col(returns)
    out = df.withColumn("wealth", F.when(r.isNotNull(), initial * F.product(1 + r).over(spec)))
    return out.withColumn("drawdown", F.col("wealth") / F.greatest(F.lit(initial), F.max("wealth").over(spec)) - 1)


def add_drawdown_duration(df: DataFrame, keys: Sequence[str] = (), drawdown: str = "drawdown") -> DataFrame:
    """Rows under water in a row; a row at the peak or without a value starts anew, the latter has none."""
    under = F.col(drawdown) < 0
    island = F.sum(F.when(under, 0).otherwise(1)).over(upto(ordered(keys)))
    staged = df.withColumn("_island", island)
    run = F.sum(F.when(under, 1).otherwise(0)).over(upto(ordered((*keys, "_island"))))
    return staged.withColumn("drawdown_duration", F.when(F.col(drawdown).isNotNull(), run)).drop("_island")


def summarise_returns(df: DataFrame, returns: str = "return", keys: Sequence[str] = (), periods: int = PERIODS) -> DataFrame:
    """Observations, total and annual return, volatility, Sharpe, downside, maximum drawdown, positive share."""
    staged = add_wealth(df.filter(F.col(returns).isNotNull()), returns, keys)
    return staged.groupBy(*keys).agg(
        F.count(returns).alias("observations"),
        stats.compound(returns).alias("total_return"),
        stats.annual_return(returns, periods).alias("annualised_return"),
        stats.annual_volatility(returns, periods).alias("annualised_volatility"),
        stats.sharpe(returns, periods).alias("sharpe_ratio"),
        stats.downside(returns, periods).alias("downside_deviation"),
        F.min("drawdown").alias("maximum_drawdown"),
        F.avg((F.col(returns) > 0).cast("int")).alias("positive_day_fraction"),
    )


def window_drawdown(returns: Column) -> Column:
    """Largest fall from a peak (1 at the start) within an array of returns."""
    start = F.struct(F.lit(1.0).alias("w"), F.lit(1.0).alias("p"), F.lit(0.0).alias("m"))

    def step(a, r):
        w = a["w"] * (1 + r)
        p = F.greatest(a["p"], w)
        return F.struct(w.alias("w"), p.alias("p"), F.least(a["m"], w / p - 1).alias("m"))

    return F.aggregate(returns, start, step, lambda a: a["m"])


def rolling_return_state(
    df: DataFrame, returns: str = "return", keys: Sequence[str] = (), long: int = 252, short: int = 126, periods: int = PERIODS
) -> DataFrame:
    """Wealth, drawdown and its duration, trailing return, Sharpe, volatility, downside, drawdown in full windows."""
    out = add_drawdown_duration(add_wealth(df, returns, keys), keys)
    spec = ordered(keys)
    low = F.when(F.col(returns).isNotNull(), F.least(F.col(returns), F.lit(0.0)))
    sd = rolling(F.stddev_samp, returns, spec, long)
    root = math.sqrt(periods)
    full = F.count(returns).over(frame(spec, long)) >= long
    held = F.collect_list(returns).over(frame(spec, long))
    return out.withColumns(
        {
            f"trailing_return_{long}": rolling(lambda c: F.product(1 + c), returns, spec, long) - 1,
            f"rolling_sharpe_{long}": rolling(F.avg, returns, spec, long) / F.when(sd > TOLERANCE, sd) * root,
            f"annualised_volatility_{short}": rolling(F.stddev_samp, returns, spec, short) * root,
            f"annualised_downside_deviation_{short}": F.sqrt(rolling(F.avg, low * low, spec, short) * periods),
            f"maximum_drawdown_{long}": F.when(full, window_drawdown(held)),
        }
    )


def concentration(value: str, prefix: str, tolerance: float = TOLERANCE) -> list[Column]:
    """Aggregates over values above the tolerance: count, effective count, largest, top-3 and top-5 shares."""
    v = F.when(F.col(value) > tolerance, F.col(value))
    return [
        F.count(v).alias(f"{prefix}_count"),
        stats.effective_count(v).alias(f"effective_{prefix}_count"),
        F.try_divide(F.max(v), F.sum(v)).alias(f"largest_{prefix}_share"),
        stats.top_share(v, 3).alias(f"top_three_{prefix}_share"),
        stats.top_share(v, 5).alias(f"top_five_{prefix}_share"),
    ]


def drawdown_episodes(df: DataFrame, returns: str = "return", keys: Sequence[str] = ()) -> DataFrame:
    """Per time under water: peak, trough and recovery dates, depth and length."""
    staged = add_wealth(df, returns, keys)
    under = F.col("drawdown") < 0
    spec = ordered(keys)
    staged = staged.withColumns(
        {
            "_island": F.sum(F.when(under, 0).otherwise(1)).over(upto(spec)),
            "_before": F.lag("date").over(spec),
            "_after": F.lead("date").over(spec),
        }
    )
    return (
        staged.filter(under)
        .groupBy(*keys, "_island")
        .agg(
            F.coalesce(F.min_by("_before", "date"), F.min("date")).alias("peak_date"),
            F.min(F.struct("drawdown", "date"))["date"].alias("trough_date"),
            F.max_by("_after", "date").alias("recovery_date"),
            F.min("drawdown").alias("depth"),
            F.count("*").alias("rows_under_water"),
        )
        .drop("_island")
    )
