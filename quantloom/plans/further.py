"""More queries over the driver tables: adjustments, snapshots, histories, audits and robustness tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantloom.operators import attribution, backtest, contracts, costs, dashboard, monitoring, portfolio, quality, regression, risk, robustness, validation
from quantloom.plans import registry as base
from quantloom.plans.registry import CTES, entry, r, rs
from quantloom.sources import panel as sources

_KP = "PARTITION BY portfolio ORDER BY date"


def _sleeves(spark, d):
    value = F.when(F.col("gross_exposure") > 1e-12, F.col("gross_return")).alias("value")
    return base._daily(spark, d).select("date", F.col("portfolio").alias("sleeve"), value)


# --- allocations ------------------------------------------------------------------------

_VOL = "CASE WHEN count(value) OVER k >= 42 THEN stddev_samp(value) OVER k * sqrt(252) END"
CTES["sleeve_vol"] = ("sleeves", f"SELECT sleeve, date, {_VOL} AS volatility FROM sleeves WINDOW k AS (PARTITION BY sleeve ORDER BY date ROWS BETWEEN 63 PRECEDING AND 1 PRECEDING)")


@entry("trailing_volatility", f"SELECT sleeve, date, {rs('volatility')} FROM sleeve_vol", "sleeve_vol")
def _(spark, d):
    return portfolio.trailing_volatility(_sleeves(spark, d)).select("sleeve", "date", "volatility")


@entry(
    "floored_inverse_volatility",
    "SELECT date, " + ", ".join(r(f"CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN 0.2::DOUBLE + 0.6::DOUBLE * (1 / greatest({x}, 1e-8)) / (1 / greatest(a, 1e-8) + 1 / greatest(b, 1e-8)) END", f"weight_{x}") for x in "ab")
    + " FROM (SELECT date, max(volatility) FILTER (WHERE sleeve = 'Momentum') AS a, max(volatility) FILTER (WHERE sleeve = 'Volatility') AS b FROM sleeve_vol GROUP BY date)",
    "sleeve_vol",
)
def _(spark, d):
    vols = portfolio.trailing_volatility(_sleeves(spark, d))
    wide = vols.groupBy("date").agg(*[F.max(F.when(F.col("sleeve") == s, F.col("volatility"))).alias(n) for s, n in (("Momentum", "a"), ("Volatility", "b"))])
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    a, b = portfolio.floored_inverse_volatility(["a", "b"], 0.2)
    return wide.select("date", F.when(both, a).alias("weight_a"), F.when(both, b).alias("weight_b"))


_K = "WINDOW k AS (ORDER BY date ROWS BETWEEN 252 PRECEDING AND 1 PRECEDING)"
_MOMENTS = ", ".join(f"CASE WHEN count(a) OVER k >= 126 THEN {f} OVER k END AS {n}" for f, n in (("avg(a)", "ma"), ("avg(b)", "mb"), ("var_samp(a)", "va"), ("var_samp(b)", "vb"), ("covar_samp(a, b)", "c")))
CTES["moments"] = ("joint", f"SELECT date, {_MOMENTS} FROM joint {_K}")
CTES["pairs"] = ("moments", "SELECT *, CASE WHEN va + vb - 2 * c > 1e-12 THEN least(1, greatest(0, (vb - c) / (va + vb - 2 * c))) ELSE 0.5 END AS w FROM moments")
_TOTAL = "(w * w * va + (1 - w) * (1 - w) * vb + 2 * w * (1 - w) * c)"


def _moments(spark, d):
    wide = _sleeves(spark, d).groupBy("date").agg(*[F.max(F.when(F.col("sleeve") == s, F.col("value"))).alias(n) for s, n in (("Momentum", "a"), ("Volatility", "b"))])
    return portfolio.pair_moments(wide.filter("a is not null and b is not null"), "a", "b")


@entry(
    "allocation_adjustments",
    "SELECT date, " + ", ".join((
        r("w", "minimum_variance"),
        r(f"CASE WHEN {_TOTAL} > 1e-12 THEN w * (w * va + (1 - w) * c) / {_TOTAL} END", "risk_share_a"),
        r(f"CASE WHEN {_TOTAL} > 1e-12 THEN (1 - w) * ((1 - w) * vb + w * c) / {_TOTAL} END", "risk_share_b"),
        r("0.5 + 0.5 * (w - 0.5)", "shrunk"),
        r("CASE WHEN w < 0.2 THEN 0.2 WHEN 1 - w < 0.2 THEN 0.8 ELSE w END", "floored"),
    )) + " FROM pairs",
    "pairs",
)
def _(spark, d):
    moments = _moments(spark, d)
    va, vb, cov = F.col("var_a"), F.col("var_b"), F.col("cov")
    moments = moments.withColumn("w", portfolio.minimum_variance_pair(va, vb, cov))
    w = F.col("w")
    share_a, share_b = portfolio.risk_shares(w, 1 - w, va, vb, cov)
    floored = portfolio.floored([w, 1 - w], 0.2)[0]
    return moments.select("date", w.alias("minimum_variance"), share_a.alias("risk_share_a"), share_b.alias("risk_share_b"), portfolio.shrunk(w, 0.5).alias("shrunk"), floored.alias("floored"))


# --- exposures, costs, diagnostics --------------------------------------------------------


@entry(
    "sector_exposure_summary",
    "SELECT sector, " + ", ".join(r(f"avg({k})", f"mean_{k}_exposure") for k in ("long", "short", "net", "gross")) + ", " + r("max(abs(net))", "maximum_absolute_net_exposure")
    + " FROM (SELECT portfolio, date, coalesce(sector, 'Unknown') AS sector, sum(greatest(weight, 0)) AS long, sum(greatest(-weight, 0)) AS short, sum(weight) AS net, sum(abs(weight)) AS gross FROM holdings h LEFT JOIN sector s ON h.ticker = s.ticker GROUP BY 1, 2, 3) GROUP BY sector",
    "holdings sector",
)
def _(spark, d):
    return risk.summarise_sector_exposure(risk.sector_exposure(base._holdings(spark, d), sources.sectors(spark, d), ("portfolio",)))


@entry(
    "capacity_across_offsets",
    "SELECT portfolio, rebalance_frequency, " + rs("participation_limit") + ", count(DISTINCT rebalance_offset) AS offset_count, " + ", ".join((
        r("min(f)", "minimum_adv_coverage"), r("quantile_cont(q, 0.5)", "median_fifth_percentile_capacity_usd"), r("min(q)", "worst_phase_fifth_percentile_capacity_usd"),
        r("quantile_cont(m, 0.5)", "median_capacity_usd"), r("min(l)", "worst_historical_capacity_usd"),
    )) + " FROM (SELECT portfolio, rebalance_frequency, rebalance_offset, participation_limit, avg(CAST(fully_covered AS INT)) AS f, quantile_cont(capacity_usd, 0.05) AS q, quantile_cont(capacity_usd, 0.5) AS m, min(capacity_usd) AS l FROM capacity GROUP BY 1, 2, 3, 4) t GROUP BY portfolio, rebalance_frequency, t.participation_limit",
    "capacity",
)
def _(spark, d):
    return costs.capacity_across_offsets(costs.capacity_by_offset(costs.daily_capacity(base._trades(spark, d))))


@entry("linear_costs", f"SELECT portfolio, date, {r('turnover * 0.0025::DOUBLE', 'transaction_cost')}, {r('gross_return - turnover * 0.0025::DOUBLE', 'net_return')} FROM daily", "daily")
def _(spark, d):
    return costs.apply_linear_cost(base._daily(spark, d), 25.0).select("portfolio", "date", "transaction_cost", "net_return")


@entry("active_gross", f"SELECT date, {r('value', 'value')} FROM sleeves WHERE sleeve = 'Momentum'", "sleeves")
def _(spark, d):
    return backtest.active_gross(base._daily(spark, d).filter("portfolio = 'Momentum'"))


CTES["against"] = ("daily forward_market", "SELECT d.portfolio, d.date, d.short_return, d.short_exposure, d.net_return AS y, m.market_return AS x FROM daily d JOIN forward_market m ON m.date = d.date")
_K63 = f"({_KP} ROWS BETWEEN 62 PRECEDING AND CURRENT ROW)"


def _against(spark, d):
    return base._daily(spark, d).join(base._market(spark, d, True), "date")


@entry(
    "tracking_state",
    "SELECT portfolio, date, " + r(f"CASE WHEN count(y - x) OVER {_K63} >= 63 THEN stddev_samp(y - x) OVER {_K63} * sqrt(252) END", "tracking_error") + ", "
    + r(f"CASE WHEN count(b) OVER {_K63} >= 63 AND stddev_pop(a) OVER {_K63} * stddev_pop(b) OVER {_K63} > 1e-24 THEN covar_pop(a, b) OVER {_K63} / (stddev_pop(a) OVER {_K63} * stddev_pop(b) OVER {_K63}) END", "correlation")
    + " FROM (SELECT *, CASE WHEN x IS NOT NULL THEN y END AS a, CASE WHEN y IS NOT NULL THEN x END AS b FROM against)",
    "against",
)
def _(spark, d):
    return risk.tracking_state(_against(spark, d), "net_return", "market_return", ("portfolio",)).select("portfolio", "date", "tracking_error", "correlation")


@entry(
    "market_diagnostics",
    "SELECT portfolio, count(*) AS observations, " + ", ".join((
        r("avg(y) - covar_pop(y, x) / var_pop(x) * avg(x)", "alpha"), r("covar_pop(y, x) / var_pop(x)", "beta"), r("covar_pop(y, x) * covar_pop(y, x) / (var_pop(x) * var_pop(y))", "r_squared"),
        r("stddev_samp(y - x) * sqrt(252)", "tracking_error"), r("(avg(y) - covar_pop(y, x) / var_pop(x) * avg(x)) * 252", "annualised_alpha"), r("avg(y - x) / stddev_samp(y - x) * sqrt(252)", "information_ratio"),
    )) + " FROM against WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY portfolio",
    "against",
)
def _(spark, d):
    return regression.market_diagnostics(_against(spark, d), "net_return", "market_return", ("portfolio",))


@entry(
    "downside_fit",
    "SELECT portfolio, n AS observations, " + ", ".join((r("my - b * mx - e * ml", "alpha"), r("b", "beta"), r("e", "downside_extra"), r("b + e", "downside_beta"))) + " FROM (SELECT *, (c1 * v2 - c2 * c12) / (v1 * v2 - c12 * c12) AS b, (c2 * v1 - c1 * c12) / (v1 * v2 - c12 * c12) AS e FROM ("
    "SELECT portfolio, count(*) AS n, avg(y) AS my, avg(x) AS mx, avg(l) AS ml, var_pop(x) AS v1, var_pop(l) AS v2, covar_pop(x, l) AS c12, covar_pop(y, x) AS c1, covar_pop(y, l) AS c2 FROM (SELECT *, least(x, 0) AS l FROM against WHERE x IS NOT NULL AND y IS NOT NULL) GROUP BY portfolio))",
    "against",
)
def _(spark, d):
    return robustness.downside_fit(_against(spark, d), "net_return", "market_return", ("portfolio",))


@entry(
    "hedge_comparison",
    "SELECT portfolio, count(*) AS days, " + ", ".join((
        r("sum(short_return)", "short_total"), r("sum(-short_exposure * x)", "passive_total"), r("avg(short_return + short_exposure * x) * 252", "annualised_difference"),
        r("stddev_samp(short_return + short_exposure * x) * sqrt(252)", "difference_volatility"), r("avg(CAST(short_return + short_exposure * x > 0 AS INT))", "positive_fraction"),
    )) + " FROM against WHERE x IS NOT NULL GROUP BY portfolio",
    "against",
)
def _(spark, d):
    return robustness.hedge_comparison(base._daily(spark, d), base._market(spark, d, True))


# --- attribution and snapshots --------------------------------------------------------------

CTES["contributed"] = ("security", "SELECT portfolio, ticker, sum(net_return_contribution) AS v FROM security GROUP BY 1, 2")


@entry(
    "top_contributors",
    "SELECT portfolio, ticker, " + r("v", "net_contribution") + ", CASE WHEN v > 0 THEN best ELSE -worst END AS place FROM (SELECT *, row_number() OVER (PARTITION BY portfolio ORDER BY v DESC, ticker) AS best, row_number() OVER (PARTITION BY portfolio ORDER BY v, ticker) AS worst FROM contributed) "
    "WHERE (best <= 10 AND v > 0) OR (worst <= 10 AND v < 0)",
    "contributed",
)
def _(spark, d):
    summary = attribution.security_contributions(base._security(spark, d))
    return attribution.top_contributors(summary, 10).select("portfolio", "ticker", "net_contribution", F.col("place").cast("long").alias("place"))


CTES["coverage"] = ("implementation", "SELECT portfolio, date, turnover, covered, CASE WHEN turnover > 1e-12 THEN covered / turnover ELSE 1 END AS c FROM implementation")


@entry("coverage_snapshot", f"SELECT portfolio, {r('min(c)', 'minimum_coverage')}, count(*) FILTER (WHERE c < 1 - 1e-8) AS incomplete_days FROM coverage GROUP BY portfolio", "coverage")
def _(spark, d):
    return dashboard.coverage_snapshot(monitoring.liquidity_coverage(base._liquid(spark, d), base._prices(spark, d)))


_FROM, _TO = "1995-01-01", "1998-12-31"
_IN = f"date BETWEEN DATE '{_FROM}' AND DATE '{_TO}'"


@entry("liquidity_history", f"SELECT portfolio, date, {r('c', 'liquidity_coverage')} FROM coverage WHERE portfolio = 'Volatility' AND {_IN}", "coverage")
def _(spark, d):
    rows = monitoring.liquidity_coverage(base._liquid(spark, d), base._prices(spark, d))
    return dashboard.history(rows, ["liquidity_coverage"], entities=["Volatility"], start=_FROM, end=_TO)


@entry("implementation_history", f"SELECT portfolio, date, {rs('turnover_63', 'bottleneck_capacity_1pct_usd')}, {r('bottleneck_capacity_1pct_usd / 1000000', 'bottleneck_capacity_1pct_usd_millions')} FROM impl_state WHERE {_IN}", "impl_state")
def _(spark, d):
    return dashboard.implementation_history(base._implementation(spark, d), ["turnover_63", "bottleneck_capacity_1pct_usd"], start=_FROM, end=_TO)


@entry("signal_history", f"SELECT factor, date, {rs('signal_coverage', 'daily_ic')} FROM health WHERE factor = 'mom_12_1m' AND {_IN}", "health")
def _(spark, d):
    return dashboard.history(base._signal_health(spark, d), ["signal_coverage", "daily_ic"], "factor", ["mom_12_1m"], _FROM, _TO)


@entry("beta_history", "SELECT portfolio, date, " + r("sum(market_beta_contribution)", "holdings_beta") + f" FROM detail WHERE {_IN} GROUP BY portfolio, date", "detail")
def _(spark, d):
    sums = base._beta_detail(spark, d).groupBy("portfolio", "date").agg(F.sum("market_beta_contribution").alias("holdings_beta"))
    return dashboard.history(sums, ["holdings_beta"], start=_FROM, end=_TO)


@entry("concentration_history", f"SELECT portfolio, date, {r('g * g / q', 'effective_gross_position_count')} FROM (SELECT portfolio, date, sum(abs(weight)) AS g, sum(weight * weight) AS q FROM holdings WHERE abs(weight) > 1e-12 GROUP BY 1, 2) WHERE {_IN}", "holdings")
def _(spark, d):
    states = risk.position_concentration(base._holdings(spark, d)).filter("gross_position_count > 0")
    return dashboard.history(states, ["effective_gross_position_count"], start=_FROM, end=_TO)


@entry(
    "portfolio_snapshot",
    "SELECT s.portfolio, s.date AS as_of, " + r("s.wealth", "wealth") + ", " + r("s.drawdown", "drawdown") + ", " + r("i.turnover_63", "turnover_63") + " FROM (SELECT * FROM risk_state WHERE portfolio <> 'MARKET' QUALIFY row_number() OVER (PARTITION BY portfolio ORDER BY date DESC) = 1) s "
    "JOIN (SELECT * FROM impl_state QUALIFY row_number() OVER (PARTITION BY portfolio ORDER BY date DESC) = 1) i ON i.portfolio = s.portfolio AND i.date = s.date",
    "risk_state impl_state",
)
def _(spark, d):
    risks, impl = base._performance(spark, d).filter("portfolio <> 'MARKET'"), base._implementation(spark, d)
    common = risks.join(impl.select("portfolio", "date"), ["portfolio", "date"], "left_semi")
    own = impl.join(risks.select("portfolio", "date"), ["portfolio", "date"], "left_semi")
    none = spark.createDataFrame([], "entity_type string, entity string, overall_status string")
    out = dashboard.portfolio_snapshot({"risk": (common, ["wealth", "drawdown"]), "impl": (own, ["turnover_63"])}, none)
    return out.select("portfolio", "as_of", "wealth", "drawdown", "turnover_63")


# --- checks and audits ------------------------------------------------------------------------


@entry("ohlcv_contract", "SELECT count(*) FILTER (WHERE date IS NULL OR ticker IS NULL) AS null_keys, CAST(sum(n - 1) AS BIGINT) AS repeated_keys, CAST(sum(p) AS BIGINT) AS bad_prices, CAST(sum(v) AS BIGINT) AS bad_volumes FROM (SELECT date, ticker, count(*) AS n, count(*) FILTER (WHERE NOT adj_close - 100 > 0) AS p, count(*) FILTER (WHERE volume < 0) AS v FROM panel GROUP BY 1, 2)", "panel")
def _(spark, d):
    # Prices over 100 make some of them negative, so that there is something to find.
    return contracts.ohlcv_violations(base._prices(spark, d).withColumn("adj_close", F.col("adj_close") - 100))


@entry("non_positive_prices", f"SELECT date, ticker, {r('close - 100', 'close')} FROM panel WHERE close - 100 <= 0", "panel")
def _(spark, d):
    return quality.non_positive_prices(base._prices(spark, d).withColumn("close", F.col("close") - 100)).select("date", "ticker", "close")


@entry("price_gaps", f"SELECT date, ticker, {r('open / p - 1', 'open_gap')} FROM (SELECT *, (close + adj_close * 1.02::DOUBLE) / 2 AS open, lag(close) OVER (PARTITION BY ticker ORDER BY date) AS p FROM panel) WHERE abs(open / p - 1) >= 0.05", "panel")
def _(spark, d):
    rows = base._prices(spark, d).withColumn("open", (F.col("close") + F.col("adj_close") * 1.02) / 2)
    return quality.price_gaps(rows, 0.05).select("date", "ticker", "open_gap")


@entry("every_nth_date", f"SELECT date, ticker, {rs('adj_close')} FROM panel WHERE date IN (SELECT date FROM (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i FROM (SELECT DISTINCT date FROM panel)) WHERE i >= 2 AND (i - 2) % 5 = 0)", "panel")
def _(spark, d):
    return validation.every_nth_date(base._prices(spark, d), 5, 2).select("date", "ticker", "adj_close")


@entry("panel_audit", "SELECT count(*) FILTER (WHERE a.date IS NULL OR b.date IS NULL) AS unmatched, " + r("max(abs(a.volume - b.volume))", "diff_volume") + " FROM panel a FULL JOIN (SELECT date, ticker, volume + 0.5 AS volume FROM panel WHERE ticker <> 'S1') b ON a.date = b.date AND a.ticker = b.ticker", "panel")
def _(spark, d):
    rows = base._prices(spark, d)
    other = rows.filter("ticker <> 'S1'").withColumn("volume", F.col("volume") + 0.5)
    return contracts.largest_differences(rows, other, ("date", "ticker"), ["volume"])


# --- robustness --------------------------------------------------------------------------------


@entry(
    "return_distribution",
    "SELECT portfolio, count(net_return) AS observations, " + ", ".join((
        r("avg(net_return)", "mean"), r("stddev_samp(net_return)", "deviation"), r("min(net_return)", "minimum"),
        *(r(f"quantile_cont(net_return, {q})", f"p{round(100 * q)}") for q in (0.05, 0.25, 0.5, 0.75, 0.95)),
        r("max(net_return)", "maximum"), r("CASE WHEN stddev_pop(net_return) > 0 THEN skewness(net_return) END", "skewness"),
    )) + " FROM daily GROUP BY portfolio",
    "daily",
)
def _(spark, d):
    return robustness.describe(base._daily(spark, d), "net_return", ("portfolio",))


CTES["annual"] = ("daily", "SELECT portfolio, date_part('year', date) AS year, sum(net_return) AS v FROM daily GROUP BY 1, 2")


@entry("annual_range", f"SELECT portfolio, count(DISTINCT year) AS variants, {r('avg(v)', 'mean')}, {r('quantile_cont(v, 0.5)', 'median')}, {r('min(v)', 'minimum')}, {r('max(v)', 'maximum')}, {r('max(v) - min(v)', 'range')} FROM annual GROUP BY portfolio", "annual")
def _(spark, d):
    years = base._daily(spark, d).groupBy("portfolio", F.year("date").alias("year")).agg(F.sum("net_return").alias("v"))
    return robustness.range_summary(years, "v", "year", ("portfolio",))


@entry("change_summary", f"SELECT sleeve, count(s) AS changes, {r('avg(s)', 'mean_absolute_change')}, {r('max(s)', 'largest_absolute_change')} FROM (SELECT sleeve, abs(volatility - lag(volatility) OVER (PARTITION BY sleeve ORDER BY date)) AS s FROM sleeve_vol) GROUP BY sleeve", "sleeve_vol")
def _(spark, d):
    return robustness.change_summary(portfolio.trailing_volatility(_sleeves(spark, d)), "volatility", ("sleeve",))


CTES["regime"] = ("forward_market", "SELECT date, CASE WHEN market_return IS NOT NULL THEN CASE WHEN market_return <= a THEN 'Low' WHEN market_return <= b THEN 'Middle' ELSE 'High' END END AS regime FROM forward_market CROSS JOIN (SELECT quantile_cont(market_return, 1.0 / 3) AS a, quantile_cont(market_return, 2.0 / 3) AS b FROM forward_market)")


def _regimes(spark, d):
    return robustness.regimes(base._market(spark, d, True), "market_return", ("Low", "Middle", "High")).select("date", "regime")


@entry("market_regimes", "SELECT date, regime FROM regime", "regime")
def _(spark, d):
    return _regimes(spark, d)


@entry("regime_frequencies", "SELECT year, regime, count(*) AS rows, " + r("count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY year)", "share") + " FROM (SELECT CAST(date_part('year', date) AS INT) AS year, regime FROM regime WHERE regime IS NOT NULL) GROUP BY year, regime", "regime")
def _(spark, d):
    return robustness.frequency_table(_regimes(spark, d).withColumn("year", F.year("date")), "regime", ("year",))


@entry("daily_winners", "SELECT portfolio, count(*) AS wins, " + r("count(*)::DOUBLE / sum(count(*)) OVER ()", "win_fraction") + " FROM (SELECT date, min(portfolio) AS portfolio FROM (SELECT * FROM daily QUALIFY net_return = max(net_return) OVER (PARTITION BY date)) GROUP BY date) GROUP BY portfolio", "daily")
def _(spark, d):
    return robustness.winners(base._daily(spark, d), "net_return")


@entry("period_returns", "SELECT portfolio, seg AS period_start, max(date) AS period_end, count(net_return) AS days, " + r("product(1 + net_return) - 1", "period_return") + " FROM (SELECT d.*, s.seg FROM daily d JOIN seg s ON s.portfolio = d.portfolio AND s.date = d.date) WHERE seg IS NOT NULL GROUP BY portfolio, seg", "daily seg")
def _(spark, d):
    return robustness.period_returns(base._daily(spark, d), base._targets(spark, d), "net_return", ("portfolio",))


@entry("buy_and_hold", f"SELECT date, {r('market_return', 'market_return')}, {r('c', 'transaction_cost')}, {r('market_return - c', 'net_return')} FROM (SELECT *, CASE WHEN market_return IS NOT NULL AND row_number() OVER (PARTITION BY market_return IS NULL ORDER BY date) = 1 THEN 0.001::DOUBLE ELSE 0 END AS c FROM forward_market)", "forward_market")
def _(spark, d):
    return robustness.buy_and_hold(base._market(spark, d, True), "market_return", 10.0).select("date", "market_return", "transaction_cost", "net_return")


@entry(
    "cost_sensitivity",
    "SELECT portfolio, " + ", ".join(r(f"product(1 + gross_return - turnover * {c}.0 / 10000) - 1", f"net_{c}bps") for c in (0, 5, 10, 20, 50)) + " FROM daily GROUP BY portfolio",
    "daily",
)
def _(spark, d):
    grid = backtest.cost_grid(base._daily(spark, d), (0, 5, 10, 20, 50), ("portfolio",))
    levels = (0, 5, 10, 20, 50)
    total = F.product(F.when(F.col("cost_bps") == 0, 1 + F.col("net_return")))
    return grid.groupBy("portfolio").agg(
        *[(F.product(F.when(F.col("cost_bps") == c, 1 + F.col("net_return"))) - 1).alias(f"net_{c}bps") if c else (total - 1).alias("net_0bps") for c in levels]
    )
