"""End-to-end workflows: factor panel, strategy books, attribution and monitoring datasets."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.operators import attribution, backtest, cross_section, features, monitoring, portfolio, risk, validation
from quantloom.operators.contracts import largest_differences, require_unique, same_keys
from quantloom.operators.reconcile import require_equal
from quantloom.sources.shared import kept

#: Fixed raw factor -> prefix of the factor panel.
PANEL_FACTORS = {
    "mom_12_1m_raw": "mom_12_1m",
    "mom_3m_raw": "mom_3m",
    "reversal_1m_raw": "reversal_1m",
    "realised_vol_63_raw": "realised_vol_63",
    "market_model_idio_vol": "idio_vol_63",
}


@dataclass(frozen=True)
class Strategy:
    """A frozen implementation: its sleeves, how they are allocated, and its rebalances."""

    name: str
    allocation: str
    frequency: int
    offset: int = 0
    role: str = "candidate"


#: Fixed strategies.
STRATEGIES = (
    Strategy("Composite", "score", 21, role="primary"),
    Strategy("Fixed", "fixed", 10),
    Strategy("Inverse-Vol", "inverse_volatility", 10),
)
SLEEVES = {"Momentum": "mom_12_1m_z", "Volatility": "realised_vol_63_z"}


def strategies_frame(spark) -> DataFrame:
    rows = [(s.name, s.allocation, s.frequency, s.offset, s.role) for s in STRATEGIES]
    return spark.createDataFrame(rows, "portfolio string, allocation string, rebalance_frequency int, rebalance_offset int, role string")


def require_frozen(strategies: DataFrame) -> None:
    """Raise with the first difference if the given strategies are not the fixed ones."""
    require_equal(strategies_frame(strategies.sparkSession), strategies, ["portfolio"], "strategies")


def processed_panel(prices: DataFrame, universe: DataFrame) -> DataFrame:
    """Returns with the universe's name and sector; tickers outside it keep nulls."""
    meta = universe.select("ticker", *[c for c in ("name", "sector") if c in universe.columns])
    return features.return_features(prices).join(meta, "ticker", "left")


def factor_panel(panel: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Raw, winsorised, standardised, ranked and sector-neutral factors, and the rolling beta.

    Two shuffles carry it: by ticker for lags and rolling windows, by date for
    cross-sections.
    """
    market = risk.market_returns(benchmark)
    raw = risk.add_market_model(risk.add_stock_beta(features.add_raw_factors(panel), market))
    out = cross_section.process_factors(raw, PANEL_FACTORS)
    for prefix in PANEL_FACTORS.values():
        out = cross_section.add_sector_neutral(out, f"{prefix}_winsorised", f"{prefix}_sector_neutral_z")
    return out.drop("market_return")


def strategy_targets(panel: DataFrame, returns: str = "forward_ret_1d", least: int = 30) -> DataFrame:
    """Targets of all strategies with ``portfolio`` as a key.

    The composite is a book on the mean of both scores; the others blend the two
    sleeves' books, with fixed halves or by inverse trailing volatility.
    """
    score = portfolio.composite_score({c: 0.5 for c in SLEEVES.values()})
    first = STRATEGIES[0]
    composite = portfolio.factor_targets(panel.withColumn("composite", score), "composite", returns, first.frequency, first.offset, least=least)
    frequency = STRATEGIES[1].frequency
    sleeves = {k: kept(portfolio.factor_targets(panel, c, returns, frequency, least=least)) for k, c in SLEEVES.items()}
    fixed = portfolio.combine_sleeves(sleeves, dict.fromkeys(SLEEVES, 0.5))
    keyed = kept(reduce(DataFrame.unionByName, [t.withColumn("portfolio", F.lit(k)) for k, t in sleeves.items()]))
    daily = backtest.target_weight_backtest(panel, keyed, returns, 0.0, ("portfolio",))
    history = daily.select("date", F.col("portfolio").alias("sleeve"), F.when(F.col("gross_exposure") > 1e-12, F.col("gross_return")).alias("value"))
    rebalances = portfolio.rebalance_dates(portfolio.usable_dates(panel, returns), frequency)
    allocations = portfolio.inverse_volatility_allocations(kept(history), rebalances)
    dynamic = portfolio.combine_dated_sleeves(sleeves, kept(allocations))
    parts = zip(STRATEGIES, (composite, fixed, dynamic), strict=True)
    return kept(reduce(DataFrame.unionByName, [t.withColumn("portfolio", F.lit(s.name)) for s, t in parts]))


def analysis_start(daily: DataFrame, earliest: str | None = None):
    """The first date on which every portfolio has exposure, not before ``earliest``."""
    first = daily.filter("gross_exposure > 0").groupBy("portfolio").agg(F.min("date").alias("d")).agg(F.max("d")).first()[0]
    return max(str(first), earliest) if earliest and first else (str(first) if first else earliest)


def attribution_datasets(panel: DataFrame, targets: DataFrame, returns: str = "forward_ret_1d", cost_bps: float = 10.0, start=None) -> dict[str, DataFrame]:
    """Daily results, holdings, security attribution and its reconciliation of every portfolio."""
    keys = ("portfolio",)
    holdings = kept(backtest.drifted_weights(panel, targets, returns, keys))
    daily = kept(backtest.daily_results(holdings, panel, targets, returns, cost_bps, keys))
    if start is not None:
        # Wealth starts anew where the window starts.
        holdings, daily = (df.filter(F.col("date") >= F.lit(start).cast("date")) for df in (holdings, daily))
        daily = backtest.with_wealth(daily.drop("gross_cumulative_return", "net_cumulative_return"), keys)
    security = kept(attribution.security_attribution(holdings, panel, returns, cost_bps))
    return {
        "portfolio_daily": daily,
        "security_holdings": holdings,
        "security_daily": security,
        "reconciliation": attribution.reconcile(daily, security),
        "summary": backtest.summarise_backtest(daily, "net_return", keys),
    }


#: What flags read of each state.
FLAG_COLUMNS = {
    "performance": ("annualised_volatility_126", "drawdown"),
    "beta": ("beta_coverage", "holdings_market_beta"),
    "states": tuple(monitoring.CONCENTRATION_METRICS),
    "implementation": ("annualised_turnover_63", "largest_trade_weight_63", "minimum_trade_capacity_1pct_usd_63", "maximum_missing_return_weight_63"),
    "liquidity": ("liquidity_coverage",),
    "health": ("universe_observations", "signal_observations", "signal_coverage", "rolling_mean_ic_252"),
}


def concentration_states(security: DataFrame, holdings: DataFrame, sectors: DataFrame, detail: DataFrame) -> DataFrame:
    """All concentration measures per portfolio and date."""
    keys = ["portfolio", "date"]
    own = risk.contribution_concentration(security, "ticker", "net_return_contribution", "contributor")
    by_sector = security.join(sectors.select("ticker", "sector"), "ticker", "left")
    shared = risk.contribution_concentration(by_sector, "sector", "net_return_contribution", "contribution_sector")
    return (
        risk.position_concentration(holdings)
        .join(risk.sector_concentration(holdings, sectors), keys, "left")
        .join(risk.beta_concentration(detail), keys, "left")
        .join(own, keys, "left")
        .join(shared, keys, "left")
    )


def all_flags(performance: DataFrame, beta: DataFrame, states: DataFrame, implementation: DataFrame, liquidity: DataFrame, health: DataFrame) -> DataFrame:
    """Flags of all portfolios and factors; of each state only the columns that a flag reads are made, and once."""
    from_books = {"performance": performance.filter("portfolio <> 'MARKET'"), "beta": beta, "states": states, "implementation": implementation, "liquidity": liquidity}
    read = [kept(df.select("portfolio", "date", *FLAG_COLUMNS[k])) for k, df in from_books.items()]
    signals = kept(health.select("factor", "date", *FLAG_COLUMNS["health"]))
    return monitoring.portfolio_flags(*read).unionByName(monitoring.signal_flags(signals))


def monitoring_datasets(panel: DataFrame, benchmark: DataFrame, sectors: DataFrame, data: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """Signal health, dependence, performance, beta, concentration, implementation, liquidity, flags and overview."""
    market = risk.market_returns(benchmark, forward=True)
    detail = kept(risk.holdings_beta_detail(data["security_holdings"], panel))
    factors = {c.removesuffix("_z"): (c, c.removesuffix("_z") + "_raw") for c in SLEEVES.values()}
    health = kept(validation.signal_health(panel, factors, "forward_ret_5d"))
    performance = kept(monitoring.performance_risk(data["portfolio_daily"], market))
    beta = kept(risk.beta_state(data["portfolio_daily"], market, detail))
    states = kept(concentration_states(data["security_daily"], data["security_holdings"], sectors, detail))
    implementation = kept(monitoring.implementation_state(data["security_daily"], panel))
    liquidity = kept(monitoring.liquidity_coverage(data["security_daily"], panel))
    flags = kept(all_flags(performance, beta, states, implementation, liquidity, health))
    return {
        "signal_health": health,
        "factor_dependence": validation.factor_dependence(panel, *SLEEVES.values()),
        "performance_risk": performance,
        "beta_state": beta,
        "concentration_state": states,
        "implementation_state": implementation,
        "liquidity_coverage": liquidity,
        "diagnostic_flags": flags,
        "latest_overview": monitoring.overview(flags),
    }


def complete_refresh(prices: DataFrame, benchmark: DataFrame, universe: DataFrame, least: int = 30) -> dict[str, DataFrame]:
    """Everything from prices to the overview; dates with fewer than ``least`` scores have no book."""
    panel = kept(factor_panel(processed_panel(prices, universe), benchmark))
    targets = strategy_targets(panel, least=least)
    data = {"target_weights": targets} | attribution_datasets(panel, targets)
    return data | monitoring_datasets(panel, benchmark, universe, data)


def validate_monitoring(data: Mapping[str, DataFrame]) -> None:
    """Portfolio-date keys must agree between states, entities between flags and overview."""
    for name in ("beta_state", "concentration_state", "implementation_state"):
        require_unique(data[name], ("portfolio", "date"), name)
    if not same_keys(data["beta_state"], data["concentration_state"], ("portfolio", "date")):
        raise ValueError("beta and concentration states cover different days")
    if not same_keys(data["diagnostic_flags"].select("entity").distinct(), data["latest_overview"], ("entity",)):
        raise ValueError("overview and flags cover different entities")


def accounting_residuals(daily: DataFrame, cost_bps: float = 10.0) -> DataFrame:
    """One row: the largest residual of each identity that daily results must keep."""
    identities = {
        "gross_return": F.col("gross_return") - F.col("long_return") - F.col("short_return"),
        "net_return": F.col("net_return") - F.col("gross_return") + F.col("transaction_cost"),
        "net_exposure": F.col("net_exposure") - F.col("long_exposure") + F.col("short_exposure"),
        "gross_exposure": F.col("gross_exposure") - F.col("long_exposure") - F.col("short_exposure"),
        "transaction_cost": F.col("transaction_cost") - F.col("turnover") * (cost_bps / 10_000),
    }
    return daily.agg(*[F.max(F.abs(e)).alias(f"residual_{k}") for k, e in identities.items()])


def compare_runs(old: Mapping[str, DataFrame], new: Mapping[str, DataFrame], keys: Mapping[str, tuple[str, ...]]) -> DataFrame:
    """Dry-run comparison: unmatched rows and the largest difference over all numbers, per dataset."""
    parts = []
    for name, own in keys.items():
        numbers = [c for c, t in new[name].dtypes if t in ("double", "bigint", "int") and c not in own]
        gaps = largest_differences(old[name], new[name], own, numbers)
        worst = F.greatest(*[F.coalesce(f"diff_{c}", F.lit(0.0)).cast("double") for c in numbers], F.lit(0.0))
        parts.append(gaps.select(F.lit(name).alias("dataset"), "unmatched", worst.alias("largest_difference")))
    return reduce(DataFrame.unionByName, parts)

