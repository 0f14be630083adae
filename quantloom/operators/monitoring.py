"""Monitoring states, calibrated flags and their overview."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions import stats
from quantloom.functions.stats import PERIODS, TOLERANCE
from quantloom.functions.windows import frame, ordered, rolling
from quantloom.operators.constraints import enforce, one_of, present
from quantloom.operators.costs import add_lagged_dollar_volume, trade_capacity
from quantloom.operators.metrics import rolling_return_state

#: Fixed order of statuses, from harmless to severe.
SEVERITY = {"PASS": 0, "WARNING": 1, "UNAVAILABLE": 2, "BREACH": 3}
CATEGORIES = ("Signal", "Market risk", "Concentration", "Implementation")
KEY = ("entity_type", "entity", "category", "diagnostic")


def performance_risk(daily: DataFrame, market: DataFrame, name: str = "MARKET", returns: str = "net_return", **windows) -> DataFrame:
    """Rolling return state of every portfolio and of the market as one more portfolio."""
    rows = daily.select("portfolio", "date", F.col(returns).alias("return"))
    extra = market.select(F.lit(name).alias("portfolio"), "date", F.col("market_return").alias("return"))
    return rolling_return_state(rows.unionByName(extra), "return", ("portfolio",), **windows)


def liquidity_coverage(security: DataFrame, panel: DataFrame, window=21, least=10, keys=("portfolio",)) -> DataFrame:
    """Share of each day's traded weight with lagged liquidity; days without trades are covered."""
    rows = _with_liquidity(security, panel, window, least)
    out = rows.groupBy(*keys, "date").agg(
        F.sum("absolute_trade_weight").alias("turnover"),
        F.sum(F.when(F.col("_liquidity") > 0, F.col("absolute_trade_weight")).otherwise(0.0)).alias("liquidity_covered_turnover"),
    )
    share = F.col("liquidity_covered_turnover") / F.when(F.col("turnover") > TOLERANCE, F.col("turnover"))
    return out.withColumn("liquidity_coverage", F.coalesce(share, F.lit(1.0)))


def traded_liquidity(security: DataFrame, panel: DataFrame, window=21, least=10, keys=("portfolio",)) -> DataFrame:
    """What implementation and coverage read of each security day, with its lagged liquidity, for tables that serve both."""
    read = ("absolute_trade_weight", "transaction_cost_contribution", "missing_return_weight_contribution", "_liquidity")
    return _with_liquidity(security, panel, window, least).select(*keys, "date", "ticker", *read)


def _with_liquidity(security: DataFrame, panel: DataFrame, window: int, least: int) -> DataFrame:
    if "_liquidity" in security.columns:
        return security
    known = add_lagged_dollar_volume(panel.select("date", "ticker", "dollar_volume"), window, least, "median", "_liquidity")
    return security.join(known.select("date", "ticker", "_liquidity"), ["date", "ticker"], "left")


def implementation_state(security: DataFrame, panel: DataFrame, window=63, rate=0.01, keys=("portfolio",), periods=PERIODS) -> DataFrame:
    """Turnover, cost, trade size and capacity per day, with rolling sums (full window) and extremes (any)."""
    rows = _with_liquidity(security, panel, 21, 10)
    rows = rows.withColumn("_capacity", trade_capacity(rate, "absolute_trade_weight", "_liquidity"))
    tag = f"{rate:.0%}".replace("%", "pct")
    daily = rows.groupBy(*keys, "date").agg(
        F.sum("absolute_trade_weight").alias("turnover"),
        F.sum("transaction_cost_contribution").alias("transaction_cost"),
        F.count_if(F.col("absolute_trade_weight") > TOLERANCE).alias("trade_count"),
        F.max("absolute_trade_weight").alias("largest_trade_weight"),
        F.sum("missing_return_weight_contribution").alias("missing_return_weight"),
        F.min("_capacity").alias(f"bottleneck_capacity_{tag}_usd"),
        stats.middle("_capacity", 0.05).alias(f"fifth_percentile_capacity_{tag}_usd"),
        stats.middle("_capacity").alias(f"median_capacity_{tag}_usd"),
    )
    spec = ordered(keys)
    traded = F.when(F.col("turnover") > TOLERANCE, F.col("turnover"))
    staged = daily.withColumns(
        {
            "transaction_cost_bps_per_turnover": F.col("transaction_cost") / traded * 10_000,
            "trade_day": F.col("turnover") > TOLERANCE,
            f"turnover_{window}": rolling(F.sum, "turnover", spec, window),
            f"transaction_cost_{window}": rolling(F.sum, "transaction_cost", spec, window),
        }
    )
    rows_ = frame(spec, window)
    total = F.col(f"turnover_{window}")
    return staged.withColumns(
        {
            f"annualised_turnover_{window}": total * periods / window,
            f"annualised_transaction_cost_{window}": F.col(f"transaction_cost_{window}") * periods / window,
            f"transaction_cost_bps_per_turnover_{window}": F.col(f"transaction_cost_{window}") / F.when(total > TOLERANCE, total) * 10_000,
            f"trade_days_{window}": F.count_if(F.col("trade_day")).over(rows_),
            f"largest_trade_weight_{window}": F.max("largest_trade_weight").over(rows_),
            f"minimum_trade_capacity_{tag}_usd_{window}": F.min(f"bottleneck_capacity_{tag}_usd").over(rows_),
            f"maximum_missing_return_weight_{window}": F.max("missing_return_weight").over(rows_),
        }
    )


def status_severity(status: Column) -> Column:
    out = F.lit(None).cast("int")
    for name, level in SEVERITY.items():
        out = F.when(status == name, level).otherwise(out)
    return out


def historical_flags(state: DataFrame, entity: str, metrics: Mapping[str, tuple[str, str, str]], kind: str, low=0.1, high=0.9) -> DataFrame:
    """A flag per entity and metric, calibrated on the metric's own history.

    ``metrics`` maps a column to (category, diagnostic, adverse direction).  The
    latest value warns if it is strictly beyond the tail; without a value or with
    a history of fewer than two values the flag is unavailable.
    """
    packed = F.array(
        *[
            F.struct(
                F.lit(c).alias("category"), F.lit(d).alias("diagnostic"), F.lit(a).alias("adverse_direction"), F.expr(m).cast("double").alias("value")
            )
            for m, (c, d, a) in metrics.items()
        ]
    )
    rows = state.select(F.col(entity).alias("entity"), "date", F.explode(packed).alias("m")).select("entity", "date", "m.*")
    keys = ("entity", "category", "diagnostic", "adverse_direction")
    latest = rows.groupBy(*keys).agg(F.max("date").alias("latest_date"), F.max(F.struct("date", "value"))["value"].alias("latest_value"))
    both = rows.join(latest, list(keys))
    out = both.groupBy(*keys, "latest_date", "latest_value").agg(
        F.countDistinct("value").alias("_distinct"),
        stats.middle("value", high).alias("_high"),
        stats.middle("value", low).alias("_low"),
        F.avg(F.when(F.col("value").isNotNull(), (F.col("value") <= F.col("latest_value")).cast("int"))).alias("_share"),
    )
    usable = F.col("_distinct") > 1
    higher = F.col("adverse_direction") == "Higher"
    threshold = F.when(usable, F.when(higher, F.col("_high")).otherwise(F.col("_low")))
    warns = F.when(higher, F.col("latest_value") > threshold).otherwise(F.col("latest_value") < threshold)
    tail = F.when(higher, F.lit(f"Historical upper {1 - high:.0%} tail")).otherwise(F.lit(f"Historical lower {low:.0%} tail"))
    return out.select(
        F.lit(kind).alias("entity_type"),
        *keys[:3],
        "latest_date",
        "latest_value",
        "adverse_direction",
        F.when(usable, tail).otherwise("Historical calibration unavailable").alias("calibration"),
        threshold.alias("threshold_value"),
        F.when(usable, F.col("_share")).alias("historical_percentile"),
        F.when(~usable | F.col("latest_value").isNull(), "UNAVAILABLE").when(warns, "WARNING").otherwise("PASS").alias("status"),
    )


def structural_flags(
    state: DataFrame, entity: str, metric: str, passes: Column, labels: tuple[str, str], kind: str, calibration: str, threshold: Column
) -> DataFrame:
    """PASS or BREACH on the latest row of each entity; UNAVAILABLE if the test is null."""
    latest = state.withColumns({"_passes": passes, "_threshold": threshold.cast("double")})
    latest = latest.groupBy(F.col(entity).alias("entity")).agg(
        F.max(F.struct("date", F.col(metric).alias("value"), "_passes", "_threshold")).alias("r")
    )
    ok = F.col("r._passes")
    return latest.select(
        F.lit(kind).alias("entity_type"),
        "entity",
        F.lit(labels[0]).alias("category"),
        F.lit(labels[1]).alias("diagnostic"),
        F.col("r.date").alias("latest_date"),
        F.col("r.value").cast("double").alias("latest_value"),
        F.lit("Structural").alias("adverse_direction"),
        F.lit(calibration).alias("calibration"),
        F.col("r._threshold").alias("threshold_value"),
        F.lit(None).cast("double").alias("historical_percentile"),
        F.when(ok.isNull() | F.col("r.value").isNull(), "UNAVAILABLE").when(ok, "PASS").otherwise("BREACH").alias("status"),
    )


#: Fixed diagnostics of a portfolio: column or expression -> (category, name, adverse direction).
RISK_METRICS = {
    "annualised_volatility_126": ("Market risk", "Annualised volatility (126 days)", "Higher"),
    "-drawdown": ("Market risk", "Current drawdown severity", "Higher"),
}
BETA_METRICS = {"abs(holdings_market_beta)": ("Market risk", "Absolute holdings-implied beta", "Higher")}
CONCENTRATION_METRICS = {
    "largest_absolute_sector_net_exposure": ("Concentration", "Largest absolute sector net exposure", "Higher"),
    "top_five_absolute_beta_contribution_share": ("Concentration", "Top-five absolute beta-contribution share", "Higher"),
    "top_five_contributor_share_63": ("Concentration", "Top-five 63-day security-contribution share", "Higher"),
    "effective_contribution_sector_count_63": ("Concentration", "Effective 63-day contribution sectors", "Lower"),
}
IMPLEMENTATION_METRICS = {
    "annualised_turnover_63": ("Implementation", "Annualised trailing turnover", "Higher"),
    "largest_trade_weight_63": ("Implementation", "Largest trailing trade weight", "Higher"),
    "minimum_trade_capacity_1pct_usd_63": ("Implementation", "Minimum trailing capacity at 1%", "Lower"),
}


def portfolio_flags(performance: DataFrame, betas: DataFrame, concentrations: DataFrame, implementation: DataFrame, liquidity: DataFrame, tolerance: float = 1e-8) -> DataFrame:
    """The thirteen diagnostics of every portfolio."""
    kind = "Portfolio"
    parts = [
        structural_flags(betas, "portfolio", "beta_coverage", F.col("beta_coverage") >= 1 - tolerance, ("Market risk", "Holdings beta coverage"), kind, "Complete beta coverage", F.lit(1.0)),
        structural_flags(liquidity, "portfolio", "liquidity_coverage", F.col("liquidity_coverage") >= 1 - tolerance, ("Implementation", "Liquidity coverage"), kind, "Complete traded-weight coverage", F.lit(1.0)),
        structural_flags(implementation, "portfolio", "maximum_missing_return_weight_63", F.col("maximum_missing_return_weight_63") <= tolerance, ("Implementation", "Trailing missing-return weight"), kind, "No missing-return exposure", F.lit(0.0)),
        historical_flags(performance, "portfolio", RISK_METRICS, kind),
        historical_flags(betas, "portfolio", BETA_METRICS, kind),
        historical_flags(concentrations, "portfolio", CONCENTRATION_METRICS, kind),
        historical_flags(implementation, "portfolio", IMPLEMENTATION_METRICS, kind),
    ]
    return reduce(DataFrame.unionByName, parts)


def signal_flags(health: DataFrame, least: int = 30, window: int = 252) -> DataFrame:
    """Coverage on each factor's latest date, and its rolling IC on the latest date that has one."""
    column = f"rolling_mean_ic_{window}"
    coverage = structural_flags(
        health,
        "factor",
        "signal_coverage",
        F.col("signal_observations") >= least,
        ("Signal", "Signal coverage"),
        "Factor",
        f"At least {least} cross-sectional observations",
        F.try_divide(F.lit(float(least)), F.col("universe_observations")),
    )
    # A factor without any rolling IC keeps its rows, and its flag is unavailable.
    some = F.count(column).over(Window.partitionBy("factor"))
    known = health.withColumn("_some", some).filter(F.col(column).isNotNull() | (F.col("_some") == 0))
    predictive = historical_flags(known, "factor", {column: ("Signal", f"{window}-observation rolling mean IC", "Lower")}, "Factor")
    return coverage.unionByName(predictive)


def checked_flags(flags: DataFrame) -> DataFrame:
    """``flags``; a label that is missing or not one of the fixed ones stops the job."""
    rules = {
        "an entity or a diagnostic is missing": present("entity_type", "entity", "diagnostic"),
        "no such status": one_of("status", list(SEVERITY)),
        "no such category": one_of("category", CATEGORIES),
    }
    return enforce(flags, rules, "flags", ["entity_type", "entity", "category", "diagnostic", "status"])


def summarise_flags(flags: DataFrame) -> DataFrame:
    """Counts per status and the worst status of every entity."""
    flags = checked_flags(flags)
    level = status_severity(F.col("status"))
    names = F.array(*[F.lit(k) for k in SEVERITY])
    return flags.groupBy("entity_type", "entity").agg(
        F.count("*").alias("diagnostic_count"),
        *[F.count_if(F.col("status") == k).alias(f"{k.lower()}_count") for k in SEVERITY],
        F.get(names, F.max(level)).alias("overall_status"),
    )


def flag_matrix(flags: DataFrame) -> DataFrame:
    """Worst status per entity and category, one column each; N/A without diagnostics."""
    names = F.array(*[F.lit(k) for k in SEVERITY])
    level = status_severity(F.col("status"))
    columns = [
        F.coalesce(F.get(names, F.max(F.when(F.col("category") == c, level))), F.lit("N/A")).alias(
            f"{c.lower().replace(' ', '_')}_status"
        )
        for c in CATEGORIES
    ]
    return flags.groupBy("entity_type", "entity").agg(*columns)


def overview(flags: DataFrame) -> DataFrame:
    return summarise_flags(flags).join(flag_matrix(flags), ["entity_type", "entity"])


def active_flags(flags: DataFrame) -> DataFrame:
    """Flags that do not pass, the most severe first."""
    staged = checked_flags(flags).filter("status <> 'PASS'").withColumn("status_severity", status_severity(F.col("status")))
    return staged.orderBy(F.desc("status_severity"), *KEY)
