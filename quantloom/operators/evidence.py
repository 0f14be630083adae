"""Evidence on candidates: capacity by period, rolling growth, chosen schedules, scorecards, interactions, snapshots."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.functions import stats
from quantloom.functions.stats import PERIODS
from quantloom.functions.windows import ordered, rolling
from quantloom.operators import cross_section, dashboard, features
from quantloom.operators.constraints import enforce
from quantloom.operators.contracts import require_columns, require_positive
from quantloom.operators.validation import in_periods


def capacity_by_subperiod(
    capacity: DataFrame, periods: Mapping[str, tuple[str, str]], keys: Sequence[str] = ("portfolio", "rebalance_frequency", "rebalance_offset", "participation_limit")
) -> DataFrame:
    """Quantiles of daily capacity per period (both ends included) and offset; periods may overlap."""
    value = "capacity_usd"
    return in_periods(capacity, periods).groupBy(*keys, F.col("period").alias("subperiod")).agg(
        F.count("*").alias("rebalance_observations"),
        stats.middle(value, 0.05).alias("fifth_percentile_capacity_usd"),
        stats.middle(value, 0.1).alias("tenth_percentile_capacity_usd"),
        stats.middle(value).alias("median_capacity_usd"),
        F.min(value).alias("minimum_capacity_usd"),
    )


def rolling_growth(daily: DataFrame, returns: str = "net_return", keys: Sequence[str] = (), window: int = 252, periods: int = PERIODS) -> DataFrame:
    """Annual growth and volatility over full windows, and growth over volatility.

    Growth is that of the window's compounded returns, so this ratio is not the
    Sharpe ratio of ``metrics``; a return of -100 % or less has no growth.
    """
    require_positive(periods, "periods")
    require_positive(window, "window")
    spec = ordered(keys)
    logged = F.when(F.col(returns) > -1, F.log1p(returns))
    growth = F.expm1(rolling(F.sum, logged, spec, window) * (periods / window))
    volatility = rolling(F.stddev_samp, returns, spec, window) * math.sqrt(periods)
    out = daily.withColumns({f"annualised_return_{window}": growth, f"annualised_volatility_{window}": volatility})
    ratio = F.try_divide(F.col(f"annualised_return_{window}"), F.when(F.col(f"annualised_volatility_{window}") > 0, F.col(f"annualised_volatility_{window}")))
    return out.withColumn(f"growth_ratio_{window}", ratio)


def chosen_schedules(rows: DataFrame, chosen: Mapping[str, int], entity: str = "portfolio", frequency: str = "frequency") -> DataFrame:
    """Rows of each entity at its own chosen frequency; entities that are not named go."""
    if not chosen:
        raise ValueError("no schedule is chosen")
    pairs = F.create_map(*[F.lit(x) for kv in chosen.items() for x in kv])
    return rows.filter(F.try_element_at(pairs, F.col(entity)) == F.col(frequency))


def one_to_one(left: DataFrame, right: DataFrame, keys: Sequence[str], name: str = "right") -> DataFrame:
    """Left join of two tables in which a key occurs once; a repeated key on either side stops the job."""
    clash = sorted((set(left.columns) & set(right.columns)) - set(keys))
    if clash:
        raise ValueError(f"both sides have {clash}")

    def single(df: DataFrame, side: str) -> DataFrame:
        others = [c for c in df.columns if c not in keys]
        rows = df.groupBy(*keys).agg(F.count("*").alias("_n"), *[F.first(c).alias(c) for c in others])
        return enforce(rows, {"a key occurs twice": F.col("_n") == 1}, side, keys).drop("_n")

    return single(left, "left").join(single(right, name), list(keys), "left")


def scorecard(headline: DataFrame, evidence: DataFrame, keys: Sequence[str] = ("portfolio",), headline_return: str = "annualised_return", mean_return: str = "mean_annualised_return") -> DataFrame:
    """Headline figures beside those over all offsets, and what the headline gains by its own offset."""
    require_columns(headline, [*keys, headline_return], "headline")
    require_columns(evidence, [*keys, mean_return], "evidence")
    out = one_to_one(headline, evidence, keys, "evidence")
    return out.withColumn("headline_minus_mean_return", F.round(F.col(headline_return) - F.col(mean_return), 12))


def volume_momentum(panel: DataFrame, momentum: str = "mom_12_1m_z") -> DataFrame:
    """Scores of momentum times abnormal volume, the product processed like any raw factor."""
    scored = cross_section.process_factors(features.add_liquidity_factors(panel), {"abnormal_volume_raw": "abnormal_volume"})
    product = scored.withColumn("volume_momentum_raw", F.col(momentum) * F.col("abnormal_volume_z"))
    return cross_section.process_factors(product, {"volume_momentum_raw": "volume_momentum"})


def long_series(df: DataFrame, columns: Mapping[str, str], ids: Sequence[str] = ("date",), name: str = "series", value: str = "value") -> DataFrame:
    """Columns as rows of labelled series."""
    return df.select(*ids, *[F.col(c).cast("double").alias(label) for label, c in columns.items()]).unpivot(list(ids), list(columns), name, value)


def risk_snapshot(beta: DataFrame, concentration: DataFrame) -> DataFrame:
    """The latest beta and concentration rows of each portfolio side by side; different dates stop the job."""
    a = dashboard.latest_rows(beta).withColumnRenamed("date", "latest_date")
    b = dashboard.latest_rows(concentration).withColumnRenamed("date", "_date")
    out = a.join(b, "portfolio")
    return enforce(out, {"latest dates differ": F.col("latest_date") == F.col("_date")}, "snapshot", ["portfolio", "latest_date", "_date"]).drop("_date")


def overview_tables(snapshot: DataFrame, overview: DataFrame, flags: DataFrame, portfolios: Sequence[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Snapshot of the chosen portfolios, statuses of them and of all factors, and their flags that do not pass."""
    shown = (F.col("entity_type") == "Factor") | F.col("entity").isin(list(portfolios))
    return (
        snapshot.filter(F.col("portfolio").isin(list(portfolios))),
        dashboard.checked_overview(overview).filter(shown),
        dashboard.diagnostic_table(flags.filter(shown), status=["WARNING", "BREACH", "UNAVAILABLE"]),
    )
