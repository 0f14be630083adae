"""Turnover, liquidity and capacity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions import stats
from quantloom.functions.stats import PERIODS, TOLERANCE
from quantloom.functions.windows import frame, ordered
from quantloom.operators.constraints import at_least, enforce, finite
from quantloom.operators.contracts import require_rate


def linear_cost(turnover: Column | str, bps: float) -> Column:
    turnover = F.col(turnover) if isinstance(turnover, str) else turnover
    return turnover * (require_rate(bps, "bps") / 10_000)


def apply_linear_cost(daily: DataFrame, bps: float) -> DataFrame:
    """Cost and net return; turnover that is missing, negative or not finite stops the job."""
    cost = linear_cost("turnover", bps)
    sound = finite("turnover", False) & at_least("turnover", 0.0)
    return enforce(daily, {"turnover is missing, negative or not finite": sound}, "daily").withColumn("transaction_cost", cost).withColumn("net_return", F.col("gross_return") - F.col("transaction_cost"))


def top_n_turnover_share(n: int, turnover: str = "turnover", tolerance: float = TOLERANCE) -> Column:
    value = F.greatest(F.col(turnover), F.lit(0.0))
    return F.when(F.sum(value) > tolerance, stats.top_share(value, n))


def summarise_turnover(
    daily: DataFrame, keys: Sequence[str] = (), window: int = 21, periods: int = PERIODS, tolerance: float = TOLERANCE
) -> DataFrame:
    """Fifteen statistics of turnover; percentiles are over trading days."""
    rows = ordered(keys).rowsBetween(-(window - 1), 0)
    value = F.greatest(F.col("turnover"), F.lit(0.0))
    staged = daily.withColumn("turnover", value).withColumn("_recent", F.sum("turnover").over(rows))
    active = F.when(F.col("turnover") > tolerance, F.col("turnover"))
    return staged.groupBy(*keys).agg(
        F.count("*").alias("observations"),
        F.count(active).alias("trading_days"),
        F.avg(F.when(active.isNotNull(), 1.0).otherwise(0.0)).alias("trading_day_fraction"),
        F.avg("turnover").alias("mean_daily_turnover"),
        (F.sum("turnover") * periods / F.count("*")).alias("annualised_turnover"),
        F.avg(active).alias("mean_rebalance_turnover"),
        stats.middle(active).alias("median_rebalance_turnover"),
        *[stats.middle(active, q / 100).alias(f"p{q}_rebalance_turnover") for q in (90, 95, 99)],
        F.max("turnover").alias("maximum_daily_turnover"),
        F.max("_recent").alias(f"maximum_{window}_day_turnover"),
        *[top_n_turnover_share(n).alias(f"top_{n}_day_turnover_share") for n in (1, 5, 10)],
    )


def add_lagged_dollar_volume(
    panel: DataFrame, window: int = 21, least: int | None = None, aggregation: str = "mean", output: str | None = None
) -> DataFrame:
    """Mean or median dollar volume of the rows before the current one."""
    if aggregation not in ("mean", "median"):
        raise ValueError("aggregation must be mean or median")
    rows = frame(ordered(("ticker",)), window, 1)
    need = window if least is None else least
    value = F.avg("dollar_volume") if aggregation == "mean" else stats.middle("dollar_volume")
    column = F.when(F.count("dollar_volume").over(rows) >= need, value.over(rows))
    return panel.withColumn(output or f"lagged_{aggregation}_dollar_volume_{window}", column)


def trade_capacity(rate: float, weight: str = "absolute_trade_weight", liquidity: str = "lagged_adv_21") -> Column:
    """Capital at which the trade takes ``rate`` of the liquidity; null without a trade or liquidity."""
    if not 0 < rate <= 1:
        raise ValueError("rate must lie in (0, 1]")
    traded = (F.col(weight) > TOLERANCE) & (F.col(liquidity) > 0)
    return F.when(traded, rate * F.col(liquidity) / F.col(weight))


def daily_capacity(
    trades: DataFrame,
    limits: Sequence[float] = (0.01, 0.05, 0.1),
    keys: Sequence[str] = ("portfolio", "rebalance_frequency", "rebalance_offset", "date"),
    weight: str = "absolute_trade_weight",
    liquidity: str = "lagged_adv_21",
) -> DataFrame:
    """Per group and limit: capacity of the tightest trade and its ticker, if every trade has liquidity."""
    active = trades.filter(F.col(weight) > TOLERANCE)
    covered = F.col(liquidity) > 0
    ratio = F.when(covered, F.col(liquidity) / F.col(weight))
    base = active.groupBy(*keys).agg(
        F.count("*").alias("traded_security_count"),
        F.bool_and(F.coalesce(covered, F.lit(False))).alias("fully_covered"),
        F.try_divide(F.max(weight), F.sum(weight)).alias("largest_security_trade_share"),
        stats.top_share(weight, 5).alias("top_5_security_trade_share"),
        stats.effective_count(weight).alias("effective_traded_security_count"),
        F.min(F.when(ratio.isNotNull(), F.struct(ratio.alias("ratio"), F.col("ticker")))).alias("_least"),
    )
    out = base.withColumn("participation_limit", F.explode(F.array(*[F.lit(float(x)) for x in limits])))
    return out.withColumns(
        {
            "capacity_usd": F.when(F.col("fully_covered"), F.col("participation_limit") * F.col("_least.ratio")),
            "bottleneck_ticker": F.when(F.col("fully_covered"), F.col("_least.ticker")),
        }
    ).drop("_least")


def capacity_by_offset(
    capacity: DataFrame, keys: Sequence[str] = ("portfolio", "rebalance_frequency", "rebalance_offset", "participation_limit")
) -> DataFrame:
    value = "capacity_usd"
    return capacity.groupBy(*keys).agg(
        F.countDistinct("date").alias("rebalance_days"),
        F.avg(F.col("fully_covered").cast("int")).alias("fully_covered_fraction"),
        F.min(value).alias("minimum_capacity_usd"),
        stats.middle(value, 0.05).alias("fifth_percentile_capacity_usd"),
        stats.middle(value, 0.1).alias("tenth_percentile_capacity_usd"),
        stats.middle(value).alias("median_capacity_usd"),
        stats.middle("effective_traded_security_count").alias("median_effective_traded_names"),
        F.max("largest_security_trade_share").alias("maximum_largest_security_trade_share"),
        F.max("top_5_security_trade_share").alias("maximum_top_5_security_trade_share"),
    )


def capacity_across_offsets(
    by_offset: DataFrame, keys: Sequence[str] = ("portfolio", "rebalance_frequency", "participation_limit")
) -> DataFrame:
    fifth = "fifth_percentile_capacity_usd"
    return by_offset.groupBy(*keys).agg(
        F.countDistinct("rebalance_offset").alias("offset_count"),
        F.min("fully_covered_fraction").alias("minimum_adv_coverage"),
        stats.middle(fifth).alias(f"median_{fifth}"),
        F.min(fifth).alias(f"worst_phase_{fifth}"),
        stats.middle("median_capacity_usd").alias("median_capacity_usd"),
        F.min("minimum_capacity_usd").alias("worst_historical_capacity_usd"),
    )
