"""Queries over the driver tables, each with its DuckDB equivalent.

``entry(name, rounds)`` registers a Spark query; ``sql(name, ctes, select)`` its
equivalent.  Columns in ``rounds`` are rounded on both sides, so that the order
in which an engine sums does not show.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.operators import attribution, backtest, costs, cross_section, dashboard, features, metrics, monitoring
from quantloom.operators import portfolio, quality, regression, risk, validation
from quantloom.plans import workflow
from quantloom.sources import panel as sources
from quantloom.sources.shared import once

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}
_DIGITS = 6
LEAST = 30
BOOKS = {"Momentum": ("mom_12_1m_z", 21), "Volatility": ("realised_vol_63_z", 10)}
PERIODS = {"early": ("1992-01-01", "1995-06-30"), "late": ("1995-07-01", "1999-12-31")}
FACTORS = {"mom_12_1m_raw": "mom_12_1m", "realised_vol_63_raw": "realised_vol_63"}
HEALTH = {"mom_12_1m": ("mom_12_1m_z", "mom_12_1m_raw"), "realised_vol_63": ("realised_vol_63_z", "realised_vol_63_raw")}


def entry(name: str, select: str = "", ctes: str = ""):
    """Register a query and, if given, its SQL: named CTEs and a final select."""

    def register(make):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = make(spark, sf_dir)
            rounded = {c: F.round(c, _DIGITS) + F.lit(0.0) for c, t in df.dtypes if t == "double"}
            return df.withColumns(rounded) if rounded else df

        _QUERIES[name] = run
        if select:
            _SQL[name] = _compose(ctes.split(), select)
        return make

    return register


def _compose(names: list[str], select: str) -> str:
    order, seen = [], set()

    def need(name):
        if name in seen:
            return
        seen.add(name)
        deps, body = CTES[name]
        for d in deps.split():
            need(d)
        order.append(f"{name} AS MATERIALIZED ({body})")

    for name in names:
        need(name)
    inner = f"WITH {', '.join(order)} {select}" if order else select
    # Only columns of type double change; rounding leaves the others as they are.
    return f"SELECT COLUMNS(*) FROM ({inner})"


def r(expression: str, name: str) -> str:
    """A rounded, named SQL expression."""
    return f"round(CAST({expression} AS DOUBLE), {_DIGITS}) + CAST(0 AS DOUBLE) AS {name}"


def rs(*names: str) -> str:
    return ", ".join(r(n, n) for n in names)


_W = "PARTITION BY ticker ORDER BY date"


def _roll(fn: str, value: str, window: int, need: int, skip: int = 0, by: str = _W) -> str:
    rows = f"({by} ROWS BETWEEN {window - 1 + skip} PRECEDING AND {skip} PRECEDING)" if skip else f"({by} ROWS BETWEEN {window - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({value}) OVER {rows} >= {need} THEN {fn.format(value)} OVER {rows} END"


def _rank(value: str, by: str) -> str:
    return f"CASE WHEN {value} IS NOT NULL THEN rank() OVER (PARTITION BY {by}, {value} IS NULL ORDER BY {value}) + (count(*) OVER (PARTITION BY {by}, {value}) - 1) / 2.0 END"


def _corr(x: str, y: str) -> str:
    """Guarded correlation as an aggregate over joint rows."""
    return f"CASE WHEN stddev_pop({x}) * stddev_pop({y}) > 0 THEN covar_pop({x}, {y}) / (stddev_pop({x}) * stddev_pop({y})) END"


def _ic(source: str, x: str, y: str, by: str, least: int, spearman: bool = True) -> str:
    """Per-key IC of two columns of a source."""
    both = f"({x} IS NOT NULL AND {y} IS NOT NULL)"
    pairs = f"SELECT {by}, CASE WHEN {both} THEN {x} END AS x, CASE WHEN {both} THEN {y} END AS y FROM {source}"
    if spearman:
        pairs = f"SELECT {by}, {_rank('x', by)} AS x, {_rank('y', by)} AS y FROM ({pairs})"
    return f"SELECT {by}, CASE WHEN count(x) >= {least} THEN {_corr('x', 'y')} END AS ic, count(x) AS observations FROM ({pairs}) GROUP BY {by}"


def _ic_summary(source: str, by: str = "") -> str:
    keys = f"{by}, " if by else ""
    varies = "count(ic) > 1 AND stddev_samp(ic) > 0"
    tail = f" GROUP BY {by}" if by else ""
    return (
        f"SELECT {keys}count(ic) AS observations, {r('avg(ic)', 'mean_ic')}, {r('stddev_samp(ic)', 'std_ic')}, "
        f"{r(f'CASE WHEN {varies} THEN avg(ic) / stddev_samp(ic) END', 'information_ratio')}, "
        f"{r(f'CASE WHEN {varies} THEN avg(ic) / (stddev_samp(ic) / sqrt(count(ic))) END', 't_statistic')}, "
        f"{r('avg(CAST(ic > 0 AS INT))', 'positive_fraction')} FROM {source}{tail}"
    )


def _return_summary(source: str, value: str, by: str = "") -> str:
    """The return summary without turnover columns; rows in date order per key."""
    keys = f"{by}, " if by else ""
    part = f"PARTITION BY {by} " if by else ""
    path = f"OVER ({part}ORDER BY date ROWS UNBOUNDED PRECEDING)"
    wealth = f"SELECT *, {value} AS v, product(1 + {value}) {path} AS wealth FROM {source} WHERE {value} IS NOT NULL"
    down = f"SELECT *, wealth / greatest(1.0, max(wealth) {path}) - 1 AS dd FROM ({wealth})"
    tail = f" GROUP BY {by}" if by else ""
    return (
        f"SELECT {keys}count(v) AS observations, {r('product(1 + v) - 1', 'total_return')}, "
        f"{r('CASE WHEN product(1 + v) > 0 THEN pow(product(1 + v), 252.0 / count(v)) - 1 END', 'annualised_return')}, "
        f"{r('stddev_samp(v) * sqrt(252)', 'annualised_volatility')}, "
        f"{r('CASE WHEN stddev_samp(v) > 1e-12 THEN avg(v) / stddev_samp(v) * sqrt(252) END', 'sharpe_ratio')}, "
        f"{r('sqrt(avg(least(v, 0) * least(v, 0)) * 252)', 'downside_deviation')}, "
        f"{r('min(dd)', 'maximum_drawdown')}, {r('avg(CAST(v > 0 AS INT))', 'positive_day_fraction')} FROM ({down}){tail}"
    )


#: name -> (names it needs, body)
CTES: dict[str, tuple[str, str]] = {
    "panel": (
        "",
        "SELECT CAST(date_trunc('week', l_shipdate) AS DATE) AS date, 'S' || l_suppkey AS ticker, "
        "round(100 * (1 + avg(l_tax) - avg(l_discount)), 6) AS adj_close, sum(l_quantity) AS volume, "
        "round(sum(l_extendedprice), 2) AS dollar_volume, round(100 * (1 + avg(l_tax) - avg(l_discount)), 6) AS close FROM lineitem GROUP BY 1, 2",
    ),
    "sector": (
        "",
        "SELECT 'S' || s_suppkey AS ticker, s_name AS name, r_name AS sector FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
    ),
    "bench": (
        "",
        "SELECT CAST(date_trunc('week', l_shipdate) AS DATE) AS date, round(100 * (1 + avg(l_tax) - avg(l_discount)), 6) AS adj_close FROM lineitem GROUP BY 1",
    ),
    "market": ("bench", "SELECT date, adj_close / lag(adj_close) OVER (ORDER BY date) - 1 AS market_return FROM bench"),
    "forward_market": ("bench", "SELECT date, lead(adj_close) OVER (ORDER BY date) / adj_close - 1 AS market_return FROM bench"),
    "feat": (
        "panel",
        f"SELECT *, {', '.join(f'adj_close / lag(adj_close, {n}) OVER ({_W}) - 1 AS ret_{n}d' for n in (1, 5, 21))}, "
        f"{', '.join(f'lead(adj_close, {n}) OVER ({_W}) / adj_close - 1 AS forward_ret_{n}d' for n in (1, 5))}, ln(1 + dollar_volume) AS log_dollar_volume FROM panel",
    ),
    "raw": (
        "feat",
        f"SELECT *, lag(adj_close, 21) OVER ({_W}) / lag(adj_close, 252) OVER ({_W}) - 1 AS mom_12_1m_raw, "
        f"adj_close / lag(adj_close, 63) OVER ({_W}) - 1 AS mom_3m_raw, -(adj_close / lag(adj_close, 21) OVER ({_W}) - 1) AS reversal_1m_raw, "
        f"({_roll('stddev_samp({})', 'ret_1d', 63, 63)}) * sqrt(252) AS realised_vol_63_raw FROM feat",
    ),
    "wins": (
        "raw",
        "SELECT raw.*, "
        + ", ".join(
            f"CASE WHEN {c} IS NOT NULL THEN least(greatest({c}, q.{p}_lo), q.{p}_hi) END AS {p}_winsorised" for c, p in FACTORS.items()
        )
        + " FROM raw JOIN (SELECT date, "
        + ", ".join(f"quantile_cont({c}, 0.01) AS {p}_lo, quantile_cont({c}, 0.99) AS {p}_hi" for c, p in FACTORS.items())
        + " FROM raw GROUP BY date) q USING (date)",
    ),
    "proc": (
        "wins",
        "SELECT *, "
        + ", ".join(
            f"CASE WHEN stddev_pop({p}_winsorised) OVER d > 0 THEN ({p}_winsorised - avg({p}_winsorised) OVER d) / stddev_pop({p}_winsorised) OVER d END AS {p}_z, "
            f"({_rank(f'{p}_winsorised', 'date')}) / count({p}_winsorised) OVER d AS {p}_rank"
            for p in FACTORS.values()
        )
        + " FROM wins WINDOW d AS (PARTITION BY date)",
    ),
    "ic5": ("proc", _ic("proc", "mom_12_1m_z", "forward_ret_5d", "date", 20)),
    "dates": ("feat", "SELECT date, row_number() OVER (ORDER BY date) - 1 AS idx FROM (SELECT DISTINCT date FROM feat WHERE forward_ret_1d IS NOT NULL)"),
    "qret": (
        "proc",
        "SELECT date, quantile, avg(forward_ret_5d) AS mean_return, count(*) AS observations FROM ("
        "SELECT *, CASE WHEN x IS NOT NULL AND n >= 10 THEN CAST(greatest(1, ((rn - 1) * 5 + n - 2) // greatest(n - 1, 1)) AS INT) END AS quantile FROM ("
        "SELECT *, mom_12_1m_z AS x, row_number() OVER (PARTITION BY date, mom_12_1m_z IS NULL ORDER BY mom_12_1m_z, ticker) AS rn, count(mom_12_1m_z) OVER (PARTITION BY date) AS n FROM proc)) "
        "WHERE quantile IS NOT NULL AND forward_ret_5d IS NOT NULL GROUP BY date, quantile",
    ),
    "picks": (
        "proc dates",
        " UNION ALL ".join(
            f"SELECT '{b}' AS portfolio, {freq} AS freq, CAST(idx % {freq} AS INT) AS phase, p.date, ticker, p.{f} AS x FROM proc p JOIN dates d ON p.date = d.date"
            for b, (f, freq) in BOOKS.items()
        ),
    ),
    "books": (
        "picks",
        "SELECT portfolio, freq, phase, date, ticker, CASE WHEN nl > 0 AND ns > 0 AND q = 5 THEN 1.0::DOUBLE / nl WHEN nl > 0 AND ns > 0 AND q = 1 THEN -1.0::DOUBLE / ns ELSE 0::DOUBLE END AS weight FROM ("
        "SELECT *, count(*) FILTER (WHERE q = 5) OVER k AS nl, count(*) FILTER (WHERE q = 1) OVER k AS ns FROM ("
        f"SELECT *, CASE WHEN x IS NOT NULL AND n >= {LEAST} THEN greatest(1, ((rn - 1) * 5 + n - 2) // greatest(n - 1, 1)) END AS q FROM ("
        "SELECT *, row_number() OVER (PARTITION BY portfolio, date, x IS NULL ORDER BY x, ticker) AS rn, count(x) OVER (PARTITION BY portfolio, date) AS n FROM picks)) "
        "WINDOW k AS (PARTITION BY portfolio, date))",
    ),
    "targets": ("books", "SELECT portfolio, date, ticker, weight FROM books WHERE phase = 0"),
    "seg": (
        "targets dates",
        "SELECT *, last_value(own IGNORE NULLS) OVER (PARTITION BY portfolio ORDER BY date ROWS UNBOUNDED PRECEDING) AS seg, "
        "CASE WHEN own IS NOT NULL THEN last_value(own IGNORE NULLS) OVER (PARTITION BY portfolio ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS ending FROM ("
        "SELECT p.portfolio, d.date, s.date AS own FROM (SELECT DISTINCT portfolio FROM targets) p CROSS JOIN dates d "
        "LEFT JOIN (SELECT DISTINCT portfolio, date FROM targets) s ON s.portfolio = p.portfolio AND s.date = d.date)",
    ),
    "dense": (
        "seg targets feat",
        "SELECT s.portfolio, s.seg, s.date, s.closing, t.ticker, t.weight AS w0, f.forward_ret_1d AS asset_return FROM ("
        "SELECT portfolio, date, seg, false AS closing FROM seg WHERE seg IS NOT NULL UNION ALL SELECT portfolio, date, ending, true FROM seg WHERE ending IS NOT NULL) s "
        "JOIN targets t ON t.portfolio = s.portfolio AND t.date = s.seg AND t.weight <> 0 LEFT JOIN feat f ON f.date = s.date AND f.ticker = t.ticker",
    ),
    "weighed": (
        "dense",
        "SELECT *, v / (1 - sum(w0) OVER k + sum(v) OVER k) AS w FROM (SELECT *, w0 * coalesce(product(1 + coalesce(asset_return, 0)) OVER "
        "(PARTITION BY portfolio, seg, ticker ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS v FROM dense) "
        "WINDOW k AS (PARTITION BY portfolio, seg, date, closing)",
    ),
    "holdings": (
        "weighed",
        "SELECT *, weight - pre_trade_weight AS trade FROM (SELECT portfolio, date, ticker, coalesce(max(w) FILTER (WHERE NOT closing), 0) AS weight, "
        "CASE WHEN bool_or(closing OR date = seg) THEN coalesce(max(w) FILTER (WHERE closing), 0) ELSE coalesce(max(w) FILTER (WHERE NOT closing), 0) END AS pre_trade_weight, "
        "max(asset_return) AS asset_return FROM weighed GROUP BY portfolio, date, ticker)",
    ),
    "daily0": (
        "holdings seg",
        "SELECT g.portfolio, g.date, g.own IS NOT NULL AS is_rebalance, coalesce(lr, 0) AS long_return, coalesce(sr, 0) AS short_return, coalesce(t, 0) AS turnover, "
        "coalesce(le, 0) AS long_exposure, coalesce(se, 0) AS short_exposure, coalesce(m, 0) AS missing_return_weight FROM seg g LEFT JOIN ("
        "SELECT portfolio, date, sum(greatest(weight, 0) * coalesce(asset_return, 0)) AS lr, sum(least(weight, 0) * coalesce(asset_return, 0)) AS sr, sum(abs(trade)) AS t, "
        "sum(greatest(weight, 0)) AS le, sum(greatest(-weight, 0)) AS se, sum(CASE WHEN asset_return IS NULL THEN abs(weight) ELSE 0 END) AS m FROM holdings GROUP BY portfolio, date) h "
        "ON h.portfolio = g.portfolio AND h.date = g.date",
    ),
    "daily": (
        "daily0",
        "SELECT *, long_return + short_return AS gross_return, turnover * 0.001::DOUBLE AS transaction_cost, long_exposure - short_exposure AS net_exposure, "
        "long_exposure + short_exposure AS gross_exposure, long_return + short_return - turnover * 0.001::DOUBLE AS net_return FROM daily0",
    ),
    "adv": ("panel", f"SELECT date, ticker, dollar_volume, {_roll('avg({})', 'dollar_volume', 21, 21, 1)} AS mean_21, {_roll('quantile_cont({}, 0.5)', 'dollar_volume', 21, 10, 1)} AS median_21 FROM panel"),
    "security": (
        "holdings",
        "SELECT portfolio, date, ticker, weight, pre_trade_weight, trade, asset_return, abs(trade) AS absolute_trade_weight, abs(trade) * 0.001::DOUBLE AS transaction_cost_contribution, "
        "CASE WHEN asset_return IS NULL AND weight <> 0 THEN abs(weight) ELSE 0 END AS missing_return_weight_contribution, greatest(weight, 0) * coalesce(asset_return, 0) AS long_return_contribution, "
        "least(weight, 0) * coalesce(asset_return, 0) AS short_return_contribution, weight * coalesce(asset_return, 0) AS gross_return_contribution, "
        "weight * coalesce(asset_return, 0) - abs(trade) * 0.001::DOUBLE AS net_return_contribution FROM holdings WHERE pre_trade_weight <> 0 OR weight <> 0 OR trade <> 0",
    ),
    "beta": (
        "feat market",
        "SELECT f.date, f.ticker, CASE WHEN count(CASE WHEN ret_1d IS NOT NULL AND market_return IS NOT NULL THEN 1 END) OVER k >= 63 AND count(market_return) OVER k >= 63 AND var_samp(market_return) OVER k > 0 "
        "THEN covar_samp(ret_1d, market_return) OVER k / var_samp(market_return) OVER k END AS beta_126 FROM feat f LEFT JOIN market m ON f.date = m.date "
        "WINDOW k AS (PARTITION BY f.ticker ORDER BY f.date ROWS BETWEEN 125 PRECEDING AND CURRENT ROW)",
    ),
    "detail": (
        "holdings beta",
        "SELECT h.*, b.beta_126, greatest(weight, 0) AS long_weight, greatest(-weight, 0) AS short_weight, abs(weight) AS absolute_weight, CASE WHEN beta_126 IS NOT NULL THEN abs(weight) ELSE 0 END AS beta_covered_gross_weight, "
        "greatest(weight, 0) * beta_126 AS long_beta_contribution, least(weight, 0) * beta_126 AS short_beta_contribution, weight * beta_126 AS market_beta_contribution FROM holdings h LEFT JOIN beta b ON h.date = b.date AND h.ticker = b.ticker",
    ),
    "sleeves": ("daily", "SELECT date, portfolio AS sleeve, CASE WHEN gross_exposure > 1e-12 THEN gross_return END AS value FROM daily"),
    "risk": (
        "daily forward_market",
        "SELECT *, CASE WHEN wealth IS NOT NULL THEN wealth / greatest(1.0::DOUBLE, max(wealth) OVER (PARTITION BY portfolio ORDER BY date ROWS UNBOUNDED PRECEDING)) - 1 END AS drawdown FROM ("
        "SELECT *, CASE WHEN ret IS NOT NULL THEN product(1 + ret) OVER (PARTITION BY portfolio ORDER BY date ROWS UNBOUNDED PRECEDING) END AS wealth FROM ("
        "SELECT portfolio, date, net_return AS ret FROM daily UNION ALL SELECT 'MARKET', date, market_return FROM forward_market))",
    ),
    "implementation": (
        "security adv",
        "SELECT portfolio, date, sum(absolute_trade_weight) AS turnover, sum(transaction_cost_contribution) AS transaction_cost, count(*) FILTER (WHERE absolute_trade_weight > 1e-12) AS trade_count, "
        "max(absolute_trade_weight) AS largest_trade_weight, sum(missing_return_weight_contribution) AS missing_return_weight, min(cap) AS bottleneck, quantile_cont(cap, 0.05) AS fifth, quantile_cont(cap, 0.5) AS middle, "
        "sum(CASE WHEN median_21 > 0 THEN absolute_trade_weight ELSE 0 END) AS covered FROM ("
        "SELECT s.*, a.median_21, CASE WHEN absolute_trade_weight > 1e-12 AND median_21 > 0 THEN 0.01::DOUBLE * median_21 / absolute_trade_weight END AS cap FROM security s LEFT JOIN adv a ON s.date = a.date AND s.ticker = a.ticker) GROUP BY portfolio, date",
    ),
}


# --- Spark frames shared by queries -------------------------------------------------
# Each is written once an application and read by all queries that need it.


def shared(make: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    def table(spark: SparkSession, sf_dir: str, *choice) -> DataFrame:
        name = "-".join([make.__name__, *map(str, choice)])
        return once(spark, sf_dir, name, lambda: make(spark, sf_dir, *choice))

    return table


@shared
def _prices(spark, sf_dir):
    return sources.security_panel(spark, sf_dir)



def _returns(spark, sf_dir):
    return features.return_features(_prices(spark, sf_dir))


def _processing(spark, sf_dir):
    return cross_section.process_factors(features.add_raw_factors(_returns(spark, sf_dir)), FACTORS)


@shared
def _processed(spark, sf_dir):
    return _processing(spark, sf_dir)


@shared
def _scores(spark, sf_dir):
    """What strategies read of the processed table; the plan carries and writes nothing else."""
    return _processing(spark, sf_dir).select("date", "ticker", "forward_ret_1d", *workflow.SLEEVES.values())


@shared
def _targets(spark, sf_dir, offsets: bool = False):
    panel = _processed(spark, sf_dir)
    parts = []
    for book, (factor, frequency) in BOOKS.items():
        if offsets:
            part = backtest.offset_targets(panel, factor, "forward_ret_1d", frequency, least=LEAST)
        else:
            part = portfolio.factor_targets(panel, factor, "forward_ret_1d", frequency, least=LEAST)
        parts.append(part.withColumns({"portfolio": F.lit(book)}))
    return parts[0].unionByName(parts[1])


# Targets need the processed table anyway; returns are read from it, not made anew from prices.


@shared
def _holdings(spark, sf_dir):
    return backtest.drifted_weights(_processed(spark, sf_dir), _targets(spark, sf_dir), "forward_ret_1d", ("portfolio",))


@shared
def _daily(spark, sf_dir):
    return backtest.daily_results(_holdings(spark, sf_dir), _processed(spark, sf_dir), _targets(spark, sf_dir), "forward_ret_1d", 10.0, ("portfolio",))


@shared
def _security(spark, sf_dir):
    return attribution.security_attribution(_holdings(spark, sf_dir), _processed(spark, sf_dir), "forward_ret_1d", 10.0)


@shared
def _market(spark, sf_dir, forward=False):
    return risk.market_returns(sources.market_series(spark, sf_dir), forward)


@shared
def _beta_detail(spark, sf_dir):
    betas = risk.add_stock_beta(_returns(spark, sf_dir), _market(spark, sf_dir))
    return risk.holdings_beta_detail(_holdings(spark, sf_dir), betas)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.summarise_ic(validation.daily_ic(_processed(spark, sf_dir), "mom_12_1m_z", "forward_ret_5d", least=4))


#: Modules that register more queries.
_MORE = ("quantloom.plans.further", "quantloom.plans.research")


def queries():
    for module in _MORE:
        importlib.import_module(module)
    return dict(_QUERIES)


def oracle_sql():
    for module in _MORE:
        importlib.import_module(module)
    return dict(_SQL)


# --- features and cross-section -----------------------------------------------------


@entry("return_features", f"SELECT date, ticker, {rs('adj_close', 'ret_1d', 'ret_5d', 'ret_21d', 'forward_ret_1d', 'forward_ret_5d', 'log_dollar_volume')} FROM feat", "feat")
def _(spark, d):
    return _returns(spark, d).drop("close", "volume", "dollar_volume")


@entry("raw_factors", f"SELECT date, ticker, {rs('mom_12_1m_raw', 'mom_3m_raw', 'reversal_1m_raw', 'realised_vol_63_raw')} FROM raw", "raw")
def _(spark, d):
    return features.add_raw_factors(_returns(spark, d)).select("date", "ticker", "mom_12_1m_raw", "mom_3m_raw", "reversal_1m_raw", "realised_vol_63_raw")


_PROCESSED = [f"{p}_{k}" for p in FACTORS.values() for k in ("winsorised", "z", "rank")]


@entry("processed_factors", f"SELECT date, ticker, {rs(*_PROCESSED)} FROM proc", "proc")
def _(spark, d):
    return _processed(spark, d).select("date", "ticker", *_PROCESSED)


@entry(
    "sector_neutral",
    "SELECT p.date, p.ticker, s.sector, " + r("CASE WHEN s.sector IS NOT NULL AND count(mom_12_1m_z) OVER k >= 3 AND stddev_pop(mom_12_1m_z) OVER k > 0 THEN (mom_12_1m_z - avg(mom_12_1m_z) OVER k) / stddev_pop(mom_12_1m_z) OVER k END", "mom_12_1m_sector_neutral_z")
    + " FROM proc p LEFT JOIN sector s ON p.ticker = s.ticker WINDOW k AS (PARTITION BY p.date, s.sector)",
    "proc sector",
)
def _(spark, d):
    panel = _processed(spark, d).join(sources.sectors(spark, d), "ticker", "left")
    return cross_section.add_sector_neutral(panel, "mom_12_1m_z", "mom_12_1m_sector_neutral_z").select("date", "ticker", "sector", "mom_12_1m_sector_neutral_z")


@entry(
    "rank_buckets",
    f"SELECT date, ticker, CASE WHEN s IS NOT NULL THEN CAST(CASE WHEN s <= 1.0::DOUBLE / 3 THEN 1 WHEN s <= 2.0::DOUBLE / 3 THEN 2 ELSE 3 END AS DOUBLE) END AS tercile, "
    f"CASE WHEN s IS NOT NULL THEN CAST(least(5, greatest(1, ceil(s * 5))) AS DOUBLE) END AS quintile FROM (SELECT date, ticker, ({_rank('mom_3m_raw', 'date')}) / count(mom_3m_raw) OVER (PARTITION BY date) AS s FROM raw)",
    "raw",
)
def _(spark, d):
    panel = features.add_raw_factors(_returns(spark, d))
    share_missing = F.col("mom_3m_raw").isNull()
    return panel.select(
        "date", "ticker", cross_section.tercile("mom_3m_raw").cast("double").alias("tercile"),
        F.when(~share_missing, cross_section.ceiling_quintile("mom_3m_raw")).cast("double").alias("quintile"),
    )


@entry(
    "residualised_factor",
    "SELECT date, ticker, " + r("CASE WHEN stddev_samp(e) OVER d > 0 THEN (e - avg(e) OVER d) / stddev_samp(e) OVER d END", "residual_z") + " FROM (SELECT date, ticker, "
    "y - avg(y) OVER d - CASE WHEN count(x) OVER d >= 30 AND var_pop(x) OVER d > 0 THEN covar_pop(y, x) OVER d / var_pop(x) OVER d END * (x - avg(x) OVER d) AS e FROM ("
    "SELECT date, ticker, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN a END AS y, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN b END AS x FROM (SELECT date, ticker, mom_12_1m_z AS a, realised_vol_63_z AS b FROM proc)) "
    "WINDOW d AS (PARTITION BY date)) WINDOW d AS (PARTITION BY date)",
    "proc",
)
def _(spark, d):
    return cross_section.residualised(_processed(spark, d), "mom_12_1m_z", "realised_vol_63_z", "residual_z").select("date", "ticker", "residual_z")


_LIQUIDITY = ("amihud_21_raw", "amihud_63_raw", "log_adv_21_raw", "abnormal_volume_raw")


@entry(
    "liquidity_factors",
    f"SELECT date, ticker, {r(_roll('avg({})', 'i', 21, 15), 'amihud_21_raw')}, {r(_roll('avg({})', 'i', 63, 42), 'amihud_63_raw')}, "
    f"{r('ln(' + _roll('avg({})', 'dollar_volume', 21, 15) + ')', 'log_adv_21_raw')}, {r('lv - (' + _roll('avg({})', 'lv', 21, 21, 1) + ')', 'abnormal_volume_raw')} "
    "FROM (SELECT *, abs(ret_1d) / dollar_volume * 1e6 AS i, ln(dollar_volume) AS lv FROM feat)",
    "feat",
)
def _(spark, d):
    return features.add_liquidity_factors(_returns(spark, d)).select("date", "ticker", *_LIQUIDITY)


@entry(
    "risk_adjusted_momentum",
    f"SELECT date, ticker, {r('formation_vol', 'formation_vol')}, {r('CASE WHEN formation_vol > 1e-12 THEN m / formation_vol END', 'risk_adjusted_mom_raw')} FROM (SELECT date, ticker, "
    f"({_roll('stddev_samp({})', 'ret_1d', 231, 189, 21)}) * sqrt(252) AS formation_vol, lag(adj_close, 21) OVER ({_W}) / lag(adj_close, 252) OVER ({_W}) - 1 AS m FROM feat)",
    "feat",
)
def _(spark, d):
    return features.add_risk_adjusted_momentum(_returns(spark, d)).select("date", "ticker", "formation_vol", "risk_adjusted_mom_raw")


@entry(
    "residual_momentum",
    f"SELECT date, ticker, {r('b', 'beta_before')}, {r('e', 'residual')}, {r(_roll('sum({})', 'e', 231, 200, 21), 'residual_mom_raw')} FROM (SELECT *, ret_1d - (mr - b * mm) - b * market_return AS e FROM ("
    "SELECT *, avg(pr) OVER k AS mr, avg(pm) OVER k AS mm, CASE WHEN count(pm) OVER k >= 63 AND var_samp(pm) OVER k > 0 THEN covar_samp(pr, pm) OVER k / var_samp(pm) OVER k END AS b FROM ("
    "SELECT f.*, m.market_return, CASE WHEN m.market_return IS NOT NULL THEN ret_1d END AS pr, CASE WHEN ret_1d IS NOT NULL THEN m.market_return END AS pm FROM feat f LEFT JOIN market m ON f.date = m.date) "
    "WINDOW k AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 63 PRECEDING AND 1 PRECEDING)))",
    "feat market",
)
def _(spark, d):
    panel = _returns(spark, d).join(_market(spark, d), "date", "left")
    return features.add_residual_momentum(panel).select("date", "ticker", "beta_before", "residual", "residual_mom_raw")


# --- validation -----------------------------------------------------------------------


@entry("momentum_ic_summary", _ic_summary("ic5"), "ic5")
def _(spark, d):
    return validation.summarise_ic(validation.daily_ic(_processed(spark, d), "mom_12_1m_z", "forward_ret_5d"))


@entry("daily_ic_spearman", f"SELECT date, {rs('ic')}, observations FROM ic5", "ic5")
def _(spark, d):
    return validation.daily_ic(_processed(spark, d), "mom_12_1m_z", "forward_ret_5d")


@entry("daily_ic_pearson", f"SELECT date, {rs('ic')}, observations FROM ({_ic('proc', 'mom_12_1m_z', 'forward_ret_5d', 'date', 20, False)})", "proc")
def _(spark, d):
    return validation.daily_ic(_processed(spark, d), "mom_12_1m_z", "forward_ret_5d", "pearson")


@entry("quantile_returns", f"SELECT date, quantile, {rs('mean_return')}, observations FROM qret", "qret")
def _(spark, d):
    return validation.quantile_returns(_processed(spark, d), "mom_12_1m_z", "forward_ret_5d")


@entry("long_short_spread", f"SELECT date, {r('max(mean_return) FILTER (WHERE quantile = 5) - max(mean_return) FILTER (WHERE quantile = 1)', 'spread')} FROM qret GROUP BY date", "qret")
def _(spark, d):
    return validation.long_short_spread(validation.quantile_returns(_processed(spark, d), "mom_12_1m_z", "forward_ret_5d"))


_HORIZONS = "SELECT 'forward_ret_1d' AS horizon, date, mom_12_1m_z AS x, forward_ret_1d AS y FROM proc UNION ALL SELECT 'forward_ret_5d', date, mom_12_1m_z, forward_ret_5d FROM proc"


@entry("ic_by_horizon", _ic_summary(f"({_ic(f'({_HORIZONS})', 'x', 'y', 'horizon, date', 20)})", "horizon"), "proc")
def _(spark, d):
    return validation.ic_by_horizon(_processed(spark, d), "mom_12_1m_z", ["forward_ret_1d", "forward_ret_5d"])


_IN_PERIOD = "(SELECT ic5.*, p.period FROM ic5 JOIN (VALUES " + ", ".join(f"('{k}', DATE '{a}', DATE '{b}')" for k, (a, b) in PERIODS.items()) + ") AS p(period, a, b) ON date BETWEEN a AND b)"


@entry("subperiod_ic", _ic_summary(_IN_PERIOD, "period"), "ic5")
def _(spark, d):
    return validation.subperiod_ic(_processed(spark, d), "mom_12_1m_z", "forward_ret_5d", PERIODS)


@entry("non_overlapping_ic", _ic_summary('(SELECT *, CAST((row_number() OVER (ORDER BY date) - 1) % 5 AS INT) AS "offset" FROM ic5)', '"offset"'), "ic5")
def _(spark, d):
    return validation.non_overlapping_ic(_processed(spark, d), "mom_12_1m_z", "forward_ret_5d", 5)


@entry("rolling_ic", f"SELECT date, {rs('ic')}, observations, {r(_roll('avg({})', 'ic', 63, 31, 0, 'ORDER BY date'), 'rolling_ic')} FROM ic5", "ic5")
def _(spark, d):
    return validation.rolling_ic(validation.daily_ic(_processed(spark, d), "mom_12_1m_z", "forward_ret_5d"))


@entry(
    "factor_dependence",
    f"SELECT date, {r('ic', 'rank_correlation')}, observations, {r(_roll('avg({})', 'ic', 252, 126, 0, 'ORDER BY date'), 'rolling_correlation_252')} FROM ({_ic('proc', 'mom_12_1m_z', 'realised_vol_63_z', 'date', 30)})",
    "proc",
)
def _(spark, d):
    return validation.factor_dependence(_processed(spark, d), "mom_12_1m_z", "realised_vol_63_z")


_STABLE = (
    "SELECT a.date, l.lag, a.x AS x, b.x AS y FROM (SELECT p.date, ticker, mom_12_1m_z AS x, i FROM proc p JOIN di ON p.date = di.date) a CROSS JOIN (VALUES (1), (21)) AS l(lag) "
    "LEFT JOIN (SELECT ticker, mom_12_1m_z AS x, i FROM proc p JOIN di ON p.date = di.date) b ON b.ticker = a.ticker AND b.i = a.i - l.lag"
)
CTES["di"] = ("proc", "SELECT date, row_number() OVER (ORDER BY date) - 1 AS i FROM (SELECT DISTINCT date FROM proc)")


@entry("rank_stability", f"SELECT lag, date, {r('ic', 'rank_stability')}, observations AS overlap FROM ({_ic(f'({_STABLE})', 'x', 'y', 'lag, date', 30)})", "proc di")
def _(spark, d):
    return validation.rank_stability(_processed(spark, d), "mom_12_1m_z")


CTES["long_factors"] = (
    "proc",
    " UNION ALL ".join(f"SELECT '{k}' AS factor, date, ticker, forward_ret_5d AS forward, {s} AS score, {w} AS raw FROM proc" for k, (s, w) in HEALTH.items()),
)
CTES["state"] = (
    "long_factors",
    "SELECT factor, date, count(DISTINCT ticker) AS universe_observations, count(score) AS signal_observations, count(CASE WHEN score IS NOT NULL AND forward IS NOT NULL THEN 1 END) AS paired_observations, "
    "quantile_cont(raw, 0.25) AS q25_raw, quantile_cont(raw, 0.5) AS median_raw, quantile_cont(raw, 0.75) AS q75_raw FROM long_factors GROUP BY factor, date",
)
CTES["factor_ic"] = ("long_factors", _ic("long_factors", "score", "forward", "factor, date", 30))
_STABLE2 = (
    "SELECT a.factor, a.date, l.lag, a.score AS x, b.score AS y FROM (SELECT p.*, i FROM long_factors p JOIN di ON p.date = di.date) a CROSS JOIN (VALUES (1), (21)) AS l(lag) "
    "LEFT JOIN (SELECT p.*, i FROM long_factors p JOIN di ON p.date = di.date) b ON b.ticker = a.ticker AND b.factor = a.factor AND b.i = a.i - l.lag"
)
CTES["factor_stability"] = ("long_factors di", _ic(f"({_STABLE2})", "x", "y", "factor, lag, date", 30))
CTES["health"] = (
    "state factor_ic factor_stability",
    "SELECT s.*, s.q75_raw - s.q25_raw AS iqr_raw, CAST(signal_observations AS DOUBLE) / universe_observations AS signal_coverage, i.ic AS daily_ic, v.m AS rolling_mean_ic_252, r1.ic AS rank_stability_1, r21.ic AS rank_stability_21, "
    "(s.q75_raw - s.q25_raw) / CASE WHEN (" + _roll("quantile_cont({}, 0.5)", "(s.q75_raw - s.q25_raw)", 252, 126, 1, "PARTITION BY s.factor ORDER BY s.date") + ") > 1e-12 THEN ("
    + _roll("quantile_cont({}, 0.5)", "(s.q75_raw - s.q25_raw)", 252, 126, 1, "PARTITION BY s.factor ORDER BY s.date") + ") END AS dispersion_ratio FROM state s JOIN factor_ic i ON s.factor = i.factor AND s.date = i.date "
    f"LEFT JOIN (SELECT factor, date, {_roll('avg({})', 'ic', 252, 126, 0, 'PARTITION BY factor ORDER BY date')} AS m FROM factor_ic WHERE ic IS NOT NULL) v ON v.factor = s.factor AND v.date = s.date "
    "LEFT JOIN factor_stability r1 ON r1.factor = s.factor AND r1.date = s.date AND r1.lag = 1 LEFT JOIN factor_stability r21 ON r21.factor = s.factor AND r21.date = s.date AND r21.lag = 21",
)
_HEALTH = ("q25_raw", "median_raw", "q75_raw", "iqr_raw", "signal_coverage", "daily_ic", "rolling_mean_ic_252", "rank_stability_1", "rank_stability_21", "dispersion_ratio")


@shared
def _signal_health(spark, d):
    return validation.signal_health(_processed(spark, d), HEALTH, "forward_ret_5d")


@entry("signal_health", f"SELECT factor, date, universe_observations, signal_observations, paired_observations, {rs(*_HEALTH)} FROM health", "health")
def _(spark, d):
    return _signal_health(spark, d)


# --- market model and exposures -------------------------------------------------------


@entry("stock_beta", f"SELECT date, ticker, {rs('beta_126')} FROM beta", "beta")
def _(spark, d):
    return risk.add_stock_beta(_returns(spark, d), _market(spark, d)).select("date", "ticker", "beta_126")


@entry(
    "market_model",
    f"SELECT date, ticker, {r('mr - b * mm', 'market_model_alpha')}, {r('b', 'market_model_beta')}, {r('pr - (mr - b * mm) - b * pm', 'market_model_residual')}, {r('CASE WHEN b IS NOT NULL THEN sqrt(greatest(vr - b * c, 0)) * sqrt(252) END', 'market_model_idio_vol')} FROM ("
    "SELECT *, CASE WHEN n >= 63 AND vm > 0 THEN c / vm END AS b FROM (SELECT *, count(pm) OVER k AS n, avg(pm) OVER k AS mm, avg(pr) OVER k AS mr, var_samp(pm) OVER k AS vm, var_samp(pr) OVER k AS vr, covar_samp(pr, pm) OVER k AS c FROM ("
    "SELECT f.date, f.ticker, CASE WHEN m.market_return IS NOT NULL THEN ret_1d END AS pr, CASE WHEN ret_1d IS NOT NULL THEN m.market_return END AS pm FROM feat f LEFT JOIN market m ON f.date = m.date) "
    "WINDOW k AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 62 PRECEDING AND CURRENT ROW)))",
    "feat market",
)
def _(spark, d):
    panel = _returns(spark, d).join(_market(spark, d), "date", "left")
    return risk.add_market_model(panel).select("date", "ticker", *[f"market_model_{k}" for k in ("alpha", "beta", "residual", "idio_vol")])


CTES["streams"] = (
    "daily forward_market",
    " UNION ALL ".join(f"SELECT portfolio, '{k}' AS stream, d.date, {c} AS value, m.market_return FROM daily d JOIN forward_market m ON d.date = m.date" for k, c in risk.STREAMS.items()),
)


@entry(
    "market_exposure",
    f"SELECT portfolio, stream, n AS observations, {r('c / vx', 'beta')}, {r('(y - c / vx * x) * 252', 'annualised_alpha')}, {r('CASE WHEN sqrt(vx * vy) > 0 THEN c / sqrt(vx * vy) END', 'correlation')}, "
    f"{r('sqrt(greatest(vy - 2 * c / vx * c + c / vx * c / vx * vx, 0)) * sqrt(252)', 'residual_volatility')}, {r('CASE WHEN sqrt(vx * vy) > 0 THEN c * c / (vx * vy) END', 'r_squared')} FROM ("
    "SELECT portfolio, stream, count(*) AS n, avg(value) AS y, avg(market_return) AS x, var_samp(value) AS vy, var_samp(market_return) AS vx, covar_samp(value, market_return) AS c FROM streams WHERE market_return IS NOT NULL GROUP BY portfolio, stream)",
    "streams",
)
def _(spark, d):
    rows = risk.unpivot_streams(_daily(spark, d), risk.STREAMS, ["portfolio", "date"]).join(_market(spark, d, True), "date")
    return risk.market_exposure(rows, "value", "market_return", ("portfolio", "stream"))


@entry(
    "hac_regression",
    f"SELECT portfolio, observations, {rs('alpha', 'beta', 'r_squared')}, {r('sqrt(va)', 'alpha_error')}, {r('sqrt(vb)', 'beta_error')}, {r('alpha / sqrt(va)', 'alpha_t')}, {r('beta / sqrt(vb)', 'beta_t')} FROM ("
    "SELECT *, (sxx * sxx * a - 2 * sxx * sx * b + sx * sx * c) / ((observations * sxx - sx * sx) * (observations * sxx - sx * sx)) AS va, "
    "(sx * sx * a - 2 * sx * observations * b + observations * observations * c) / ((observations * sxx - sx * sx) * (observations * sxx - sx * sx)) AS vb FROM ("
    "SELECT portfolio, observations, alpha, beta, r_squared, sum(x) AS sx, sum(x * x) AS sxx, "
    + ", ".join(
        [
            "sum(u * u" + "".join(f" + 2 * {1 - k / 6}::DOUBLE * u * coalesce(lu{k}, 0)" for k in range(1, 6)) + ") AS a",
            "sum(u * v" + "".join(f" + {1 - k / 6}::DOUBLE * (u * coalesce(lv{k}, 0) + v * coalesce(lu{k}, 0))" for k in range(1, 6)) + ") AS b",
            "sum(v * v" + "".join(f" + 2 * {1 - k / 6}::DOUBLE * v * coalesce(lv{k}, 0)" for k in range(1, 6)) + ") AS c",
        ]
    )
    + " FROM (SELECT *, " + ", ".join(f"lag(u, {k}) OVER p AS lu{k}, lag(v, {k}) OVER p AS lv{k}" for k in range(1, 6))
    + " FROM (SELECT *, y - alpha - beta * x AS u, (y - alpha - beta * x) * x AS v FROM (SELECT s.portfolio, s.date, s.value AS y, s.market_return AS x, f.* EXCLUDE (portfolio) FROM streams s JOIN ("
    "SELECT portfolio, count(*) AS observations, avg(value) - covar_pop(value, market_return) / var_pop(market_return) * avg(market_return) AS alpha, covar_pop(value, market_return) / var_pop(market_return) AS beta, "
    "covar_pop(value, market_return) * covar_pop(value, market_return) / (var_pop(value) * var_pop(market_return)) AS r_squared FROM streams WHERE stream = 'net' AND market_return IS NOT NULL GROUP BY portfolio) f ON f.portfolio = s.portfolio "
    "WHERE s.stream = 'net' AND s.market_return IS NOT NULL)) WINDOW p AS (PARTITION BY portfolio ORDER BY date)) GROUP BY ALL))",
    "streams",
)
def _(spark, d):
    rows = _daily(spark, d).join(_market(spark, d, True), "date")
    return regression.hac_ols(rows, "net_return", "market_return", 5, ("portfolio",))


@entry(
    "sector_exposure",
    f"SELECT portfolio, date, coalesce(sector, 'Unknown') AS sector, {r('sum(greatest(weight, 0))', 'long_exposure')}, {r('sum(greatest(-weight, 0))', 'short_exposure')}, {r('sum(weight)', 'net_exposure')}, {r('sum(abs(weight))', 'gross_exposure')} "
    "FROM holdings h LEFT JOIN sector s ON h.ticker = s.ticker GROUP BY 1, 2, 3",
    "holdings sector",
)
def _(spark, d):
    return risk.sector_exposure(_holdings(spark, d), sources.sectors(spark, d), ("portfolio",))


# --- portfolios and backtests ---------------------------------------------------------


@entry("target_weights", f"SELECT portfolio, date, ticker, {rs('weight')} FROM targets", "targets")
def _(spark, d):
    return _targets(spark, d)


@entry("drifted_holdings", f"SELECT portfolio, date, ticker, {rs('weight', 'pre_trade_weight', 'trade')} FROM holdings", "holdings")
def _(spark, d):
    return _holdings(spark, d).select("portfolio", "date", "ticker", "weight", "pre_trade_weight", "trade")


_DAILY = ("long_return", "short_return", "gross_return", "turnover", "transaction_cost", "net_return", "long_exposure", "short_exposure", "net_exposure", "gross_exposure", "missing_return_weight")
_CUM = ", ".join(r(f"product(1 + {k}_return) OVER (PARTITION BY portfolio ORDER BY date ROWS UNBOUNDED PRECEDING)", f"{k}_cumulative_return") for k in ("gross", "net"))


@entry("target_weight_backtest", f"SELECT portfolio, date, is_rebalance, {rs(*_DAILY)}, {_CUM} FROM daily", "daily")
def _(spark, d):
    return _daily(spark, d)


_COSTS = (
    f"SELECT portfolio, {r('avg(turnover)', 'average_daily_turnover')}, {r('avg(turnover) FILTER (WHERE is_rebalance)', 'average_rebalance_turnover')}, "
    f"{r('sum(transaction_cost)', 'total_transaction_cost')}, {r('max(missing_return_weight)', 'maximum_missing_return_weight')} FROM daily GROUP BY portfolio"
)


@entry("backtest_summary", f"SELECT s.* EXCLUDE (downside_deviation), c.* EXCLUDE (portfolio) FROM ({_return_summary('daily', 'net_return', 'portfolio')}) s JOIN ({_COSTS}) c ON s.portfolio = c.portfolio", "daily")
def _(spark, d):
    return backtest.summarise_backtest(_daily(spark, d), "net_return", ("portfolio",))


_LEGS = " UNION ALL ".join(f"SELECT portfolio AS book, '{k}' AS portfolio, date, {c} AS ret FROM daily" for k, c in backtest.LEGS.items())


@entry("backtest_legs", _return_summary(f"({_LEGS})", "ret", "book, portfolio"), "daily")
def _(spark, d):
    daily = _daily(spark, d)
    rows = risk.unpivot_streams(daily, backtest.LEGS, ["portfolio", "date"])
    rows = rows.select(F.col("portfolio").alias("book"), F.col("stream").alias("portfolio"), "date", F.col("value").alias("return"))
    return metrics.summarise_returns(rows, "return", ("book", "portfolio"))


_PERIOD_DAILY = "(SELECT daily.*, p.period FROM daily JOIN (VALUES " + ", ".join(f"('{k}', DATE '{a}', DATE '{b}')" for k, (a, b) in PERIODS.items()) + ") AS p(period, a, b) ON date BETWEEN a AND b)"


@entry("backtest_subperiods", f"SELECT * EXCLUDE (downside_deviation) FROM ({_return_summary(_PERIOD_DAILY, 'net_return', 'portfolio, period')})", "daily")
def _(spark, d):
    rows = validation.in_periods(_daily(spark, d), PERIODS)
    return metrics.summarise_returns(rows, "net_return", ("portfolio", "period")).drop("downside_deviation")


@entry(
    "cost_grid",
    "SELECT portfolio, cost_bps, count(*) AS days, " + r("product(1 + net) - 1", "net_total_return") + ", " + r("sum(turnover * cost_bps / 10000)", "total_cost")
    + " FROM (SELECT *, gross_return - turnover * cost_bps / 10000 AS net FROM daily CROSS JOIN (SELECT unnest([0.0, 5.0, 10.0, 20.0, 50.0])::DOUBLE AS cost_bps)) GROUP BY portfolio, cost_bps",
    "daily",
)
def _(spark, d):
    grid = backtest.cost_grid(_daily(spark, d), (0, 5, 10, 20, 50), ("portfolio",))
    return grid.groupBy("portfolio", "cost_bps").agg(
        F.count("*").alias("days"), (F.product(1 + F.col("net_return")) - 1).alias("net_total_return"), F.sum("transaction_cost").alias("total_cost")
    )


CTES["constant"] = (
    "books dates feat",
    "SELECT g.portfolio, g.phase, g.date, g.own, coalesce(lr, 0) AS long_return, coalesce(sr, 0) AS short_return, coalesce(t, 0) AS turnover, coalesce(lr, 0) + coalesce(sr, 0) AS gross_return FROM ("
    "SELECT p.portfolio, p.phase, d.date, s.date AS own, last_value(s.date IGNORE NULLS) OVER (PARTITION BY p.portfolio, p.phase ORDER BY d.date ROWS UNBOUNDED PRECEDING) AS seg FROM (SELECT DISTINCT portfolio, phase FROM books) p CROSS JOIN dates d "
    "LEFT JOIN (SELECT DISTINCT portfolio, phase, date FROM books) s ON s.portfolio = p.portfolio AND s.phase = p.phase AND s.date = d.date) g "
    "LEFT JOIN (SELECT q.portfolio, q.phase, q.date, sum(greatest(b.weight, 0) * coalesce(f.forward_ret_1d, 0)) AS lr, sum(least(b.weight, 0) * coalesce(f.forward_ret_1d, 0)) AS sr FROM ("
    "SELECT p.portfolio, p.phase, d.date, max(s.date) AS seg FROM (SELECT DISTINCT portfolio, phase FROM books) p CROSS JOIN dates d JOIN (SELECT DISTINCT portfolio, phase, date FROM books) s ON s.portfolio = p.portfolio AND s.phase = p.phase AND s.date <= d.date GROUP BY 1, 2, 3) q "
    "JOIN books b ON b.portfolio = q.portfolio AND b.phase = q.phase AND b.date = q.seg AND b.weight <> 0 LEFT JOIN feat f ON f.date = q.date AND f.ticker = b.ticker GROUP BY 1, 2, 3) h ON h.portfolio = g.portfolio AND h.phase = g.phase AND h.date = g.date "
    "LEFT JOIN (SELECT portfolio, phase, date, sum(abs(m)) AS t FROM (SELECT portfolio, phase, date, ticker, sum(w) AS m FROM ("
    "SELECT portfolio, phase, date, ticker, weight AS w FROM books WHERE weight <> 0 UNION ALL SELECT b.portfolio, b.phase, n.date, b.ticker, -b.weight FROM books b JOIN ("
    "SELECT portfolio, phase, date, lag(date) OVER (PARTITION BY portfolio, phase ORDER BY date) AS previous FROM (SELECT DISTINCT portfolio, phase, date FROM books)) n ON n.portfolio = b.portfolio AND n.phase = b.phase AND n.previous = b.date WHERE b.weight <> 0) "
    "GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3) t ON t.portfolio = g.portfolio AND t.phase = g.phase AND t.date = g.date",
)


@entry(
    "offset_backtests",
    "SELECT portfolio, phase AS \"offset\", count(*) AS days, count(own) AS rebalances, " + r("product(1 + gross_return) - 1", "gross_total_return") + ", " + r("product(1 + gross_return - turnover * 0.001::DOUBLE) - 1", "net_total_return") + ", " + r("sum(turnover)", "total_turnover") + " FROM constant GROUP BY 1, 2",
    "constant",
)
def _(spark, d):
    daily = backtest.long_short_backtest(_processed(spark, d), _targets(spark, d, True), "forward_ret_1d", 10.0, ("portfolio", "offset"))
    return daily.groupBy("portfolio", "offset").agg(
        F.count("*").alias("days"),
        F.count_if("is_rebalance").alias("rebalances"),
        (F.product(1 + F.col("gross_return")) - 1).alias("gross_total_return"),
        (F.product(1 + F.col("net_return")) - 1).alias("net_total_return"),
        F.sum("turnover").alias("total_turnover"),
    )


@entry(
    "long_short_backtest",
    f"SELECT portfolio, date, own IS NOT NULL AS is_rebalance, {rs('long_return', 'short_return', 'gross_return', 'turnover')}, {r('gross_return - turnover * 0.001::DOUBLE', 'net_return')} FROM constant WHERE phase = 0",
    "constant",
)
def _(spark, d):
    out = backtest.long_short_backtest(_processed(spark, d), _targets(spark, d), "forward_ret_1d", 10.0, ("portfolio",))
    return out.select("portfolio", "date", "is_rebalance", "long_return", "short_return", "gross_return", "turnover", "net_return")


@entry(
    "beta_hedged_backtest",
    "SELECT c.portfolio, c.date, " + r("coalesce(h.bw, 0)", "benchmark_weight") + ", " + r("c.gross_return + coalesce(coalesce(h.bw, 0) * m.market_return, 0)", "gross_return") + ", "
    + r("c.turnover + CASE WHEN c.own IS NOT NULL THEN coalesce(h.step, 0) ELSE 0 END", "turnover") + " FROM constant c LEFT JOIN ("
    "SELECT *, abs(bw - coalesce(lag(bw) OVER (PARTITION BY portfolio ORDER BY seg), 0)) AS step, lead(seg, 1, DATE '9999-01-01') OVER (PARTITION BY portfolio ORDER BY seg) AS upto FROM ("
    "SELECT t.portfolio, t.date AS seg, -coalesce(sum(t.weight * b.beta_126), 0) AS bw FROM targets t LEFT JOIN beta b ON b.date = t.date AND b.ticker = t.ticker GROUP BY 1, 2)) h "
    "ON h.portfolio = c.portfolio AND c.date >= h.seg AND c.date < h.upto LEFT JOIN forward_market m ON m.date = c.date WHERE c.phase = 0",
    "constant targets beta forward_market",
)
def _(spark, d):
    panel = risk.add_stock_beta(_returns(spark, d), _market(spark, d)).drop("market_return")
    out = backtest.long_short_backtest(panel, _targets(spark, d), "forward_ret_1d", 10.0, ("portfolio",), "beta_126", _market(spark, d, True))
    return out.select("portfolio", "date", "benchmark_weight", "gross_return", "turnover")


@entry(
    "composite_targets",
    "SELECT date, ticker, " + r("CASE WHEN s = 0 THEN 0 ELSE w / s END", "weight") + " FROM (SELECT *, sum(abs(w)) OVER (PARTITION BY date) AS s FROM (SELECT date, ticker, sum(weight * 0.5::DOUBLE) AS w FROM books WHERE phase = 0 GROUP BY date, ticker))",
    "books",
)
def _(spark, d):
    targets = _targets(spark, d)
    sleeves = {k: targets.filter(F.col("portfolio") == k) for k in BOOKS}
    return portfolio.rescale_gross(portfolio.combine_sleeves(sleeves, dict.fromkeys(BOOKS, 0.5)), 1.0)


@entry("composite_score", f"SELECT date, ticker, {r('0.5::DOUBLE * mom_12_1m_z + 0.5::DOUBLE * realised_vol_63_z', 'score')} FROM proc", "proc")
def _(spark, d):
    return _processed(spark, d).select("date", "ticker", portfolio.composite_score({"mom_12_1m_z": 0.5, "realised_vol_63_z": 0.5}).alias("score"))


CTES["joint"] = ("sleeves", "SELECT date, max(value) FILTER (WHERE sleeve = 'Momentum') AS a, max(value) FILTER (WHERE sleeve = 'Volatility') AS b FROM sleeves GROUP BY date HAVING count(value) = 2")


@entry(
    "inverse_vol_allocations",
    "SELECT date, sleeve, " + r("CASE WHEN n >= 42 AND sa > 0 AND sb > 0 THEN CASE WHEN sleeve = 'Momentum' THEN (1 / sa) / (1 / sa + 1 / sb) ELSE (1 / sb) / (1 / sa + 1 / sb) END ELSE 0.5::DOUBLE END", "allocation") + " FROM ("
    "SELECT q.date, count(j.a) AS n, stddev_samp(j.a) AS sa, stddev_samp(j.b) AS sb FROM (SELECT date FROM dates WHERE idx % 10 = 0) q LEFT JOIN (SELECT *, row_number() OVER (ORDER BY date) AS k FROM joint) j ON j.date < q.date "
    "AND j.k > (SELECT count(*) FROM joint z WHERE z.date < q.date) - 63 GROUP BY q.date) CROSS JOIN (VALUES ('Momentum'), ('Volatility')) AS s(sleeve)",
    "joint dates",
)
def _(spark, d):
    sleeves = _daily(spark, d).select("date", F.col("portfolio").alias("sleeve"), F.when(F.col("gross_exposure") > 1e-12, F.col("gross_return")).alias("value"))
    dates = portfolio.rebalance_dates(portfolio.usable_dates(_processed(spark, d), "forward_ret_1d"), 10)
    return portfolio.inverse_volatility_allocations(sleeves, dates)


@entry(
    "pair_allocations",
    "SELECT date, " + r("CASE WHEN va + vb - 2 * c > 1e-12 THEN least(1, greatest(0, (vb - c) / (va + vb - 2 * c))) ELSE 0.5 END", "minimum_variance") + " FROM (SELECT date, "
    + ", ".join(f"CASE WHEN count(a) OVER k >= 126 THEN {f} OVER k END AS {n}" for f, n in (("var_samp(a)", "va"), ("var_samp(b)", "vb"), ("covar_samp(a, b)", "c")))
    + " FROM joint WINDOW k AS (ORDER BY date ROWS BETWEEN 252 PRECEDING AND 1 PRECEDING))",
    "joint",
)
def _(spark, d):
    wide = _daily(spark, d).filter("gross_exposure > 1e-12").groupBy("date").agg(
        *[F.max(F.when(F.col("portfolio") == k, F.col("gross_return"))).alias(n) for k, n in (("Momentum", "a"), ("Volatility", "b"))]
    )
    moments = portfolio.pair_moments(wide.filter("a is not null and b is not null"), "a", "b")
    return moments.select("date", portfolio.minimum_variance_pair(F.col("var_a"), F.col("var_b"), F.col("cov")).alias("minimum_variance"))


# --- costs and capacity ---------------------------------------------------------------

_Q = lambda q: r(f"quantile_cont(turnover, {q}) FILTER (WHERE turnover > 1e-12)", f"p{int(q * 100)}_rebalance_turnover")


def _top_sql(n: int) -> str:
    return r(f"sum(turnover) FILTER (WHERE rn <= {n}) / CASE WHEN sum(turnover) > 1e-12 THEN sum(turnover) END", f"top_{n}_day_turnover_share")


@entry(
    "turnover_summary",
    "SELECT portfolio, count(*) AS observations, count(*) FILTER (WHERE turnover > 1e-12) AS trading_days, " + r("avg(CASE WHEN turnover > 1e-12 THEN 1.0 ELSE 0.0 END)", "trading_day_fraction") + ", "
    + r("avg(turnover)", "mean_daily_turnover") + ", " + r("sum(turnover) * 252 / count(*)", "annualised_turnover") + ", " + r("avg(turnover) FILTER (WHERE turnover > 1e-12)", "mean_rebalance_turnover") + ", "
    + r("quantile_cont(turnover, 0.5) FILTER (WHERE turnover > 1e-12)", "median_rebalance_turnover") + ", " + ", ".join(_Q(q) for q in (0.9, 0.95, 0.99)) + ", " + r("max(turnover)", "maximum_daily_turnover") + ", "
    + r("max(recent)", "maximum_21_day_turnover") + ", " + ", ".join(_top_sql(n) for n in (1, 5, 10))
    + " FROM (SELECT *, sum(turnover) OVER (PARTITION BY portfolio ORDER BY date ROWS BETWEEN 20 PRECEDING AND CURRENT ROW) AS recent, row_number() OVER (PARTITION BY portfolio ORDER BY turnover DESC) AS rn FROM daily) GROUP BY portfolio",
    "daily",
)
def _(spark, d):
    return costs.summarise_turnover(_daily(spark, d), ("portfolio",))


@entry("lagged_adv", f"SELECT date, ticker, {r('mean_21', 'lagged_adv_21')}, {r('median_21', 'lagged_median_dollar_volume_21')} FROM adv", "adv")
def _(spark, d):
    panel = costs.add_lagged_dollar_volume(_prices(spark, d), 21, output="lagged_adv_21")
    return costs.add_lagged_dollar_volume(panel, 21, 10, "median").select("date", "ticker", "lagged_adv_21", "lagged_median_dollar_volume_21")


CTES["trades"] = (
    "holdings adv",
    "SELECT portfolio, CASE portfolio WHEN 'Momentum' THEN 21 ELSE 10 END AS rebalance_frequency, 0 AS rebalance_offset, h.date, h.ticker, abs(trade) AS x, mean_21 AS l, row_number() OVER (PARTITION BY portfolio, h.date ORDER BY abs(trade) DESC) AS rn "
    "FROM holdings h LEFT JOIN adv a ON a.date = h.date AND a.ticker = h.ticker WHERE abs(trade) > 1e-12",
)
CTES["capacity"] = (
    "trades",
    "SELECT *, CASE WHEN fully_covered THEN participation_limit * ratio END AS capacity_usd, CASE WHEN fully_covered THEN who END AS bottleneck_ticker FROM ("
    "SELECT portfolio, rebalance_frequency, rebalance_offset, date, count(*) AS traded_security_count, bool_and(coalesce(l > 0, false)) AS fully_covered, max(x) / sum(x) AS largest_security_trade_share, sum(x) FILTER (WHERE rn <= 5) / sum(x) AS top_5_security_trade_share, "
    "sum(x) * sum(x) / sum(x * x) AS effective_traded_security_count, min(l / x) AS ratio, arg_min(ticker, (l / x, ticker)) FILTER (WHERE l / x IS NOT NULL) AS who FROM trades GROUP BY 1, 2, 3, 4) CROSS JOIN (SELECT unnest([0.01, 0.05, 0.1])::DOUBLE AS participation_limit)",
)


@shared
def _trades(spark, d):
    adv = costs.add_lagged_dollar_volume(_prices(spark, d), 21, output="lagged_adv_21").select("date", "ticker", "lagged_adv_21")
    frequency = F.when(F.col("portfolio") == "Momentum", BOOKS["Momentum"][1]).otherwise(BOOKS["Volatility"][1])
    return _holdings(spark, d).join(adv, ["date", "ticker"], "left").withColumns(
        {"absolute_trade_weight": F.abs("trade"), "rebalance_frequency": frequency, "rebalance_offset": F.lit(0)}
    )


@entry(
    "daily_capacity",
    f"SELECT portfolio, rebalance_frequency, rebalance_offset, date, traded_security_count, fully_covered, {rs('largest_security_trade_share', 'top_5_security_trade_share', 'effective_traded_security_count', 'participation_limit', 'capacity_usd')}, bottleneck_ticker FROM capacity",
    "capacity",
)
def _(spark, d):
    return costs.daily_capacity(_trades(spark, d))


@entry(
    "capacity_by_offset",
    "SELECT portfolio, rebalance_frequency, rebalance_offset, " + rs("participation_limit") + ", count(DISTINCT date) AS rebalance_days, " + r("avg(CAST(fully_covered AS INT))", "fully_covered_fraction") + ", " + r("min(capacity_usd)", "minimum_capacity_usd") + ", "
    + r("quantile_cont(capacity_usd, 0.05)", "fifth_percentile_capacity_usd") + ", " + r("quantile_cont(capacity_usd, 0.1)", "tenth_percentile_capacity_usd") + ", " + r("quantile_cont(capacity_usd, 0.5)", "median_capacity_usd") + ", "
    + r("quantile_cont(effective_traded_security_count, 0.5)", "median_effective_traded_names") + ", " + r("max(largest_security_trade_share)", "maximum_largest_security_trade_share") + ", " + r("max(top_5_security_trade_share)", "maximum_top_5_security_trade_share")
    + " FROM capacity GROUP BY portfolio, rebalance_frequency, rebalance_offset, capacity.participation_limit",
    "capacity",
)
def _(spark, d):
    return costs.capacity_by_offset(costs.daily_capacity(_trades(spark, d)))


# --- attribution ------------------------------------------------------------------------

_CONTRIB = ("weight", "pre_trade_weight", "trade", "long_return_contribution", "short_return_contribution", "gross_return_contribution", "net_return_contribution", "transaction_cost_contribution", "missing_return_weight_contribution")


@entry("security_attribution", f"SELECT portfolio, date, ticker, {rs(*_CONTRIB)} FROM security", "security")
def _(spark, d):
    return _security(spark, d).select("portfolio", "date", "ticker", *_CONTRIB)


#: Audited column -> the securities' column that sums to it.
_AUDITED = {
    "long_return": "long_return_contribution",
    "short_return": "short_return_contribution",
    "gross_return": "gross_return_contribution",
    "turnover": "absolute_trade_weight",
    "transaction_cost": "transaction_cost_contribution",
    "net_return": "net_return_contribution",
    "missing_return_weight": "missing_return_weight_contribution",
}


@entry(
    "attribution_reconcile",
    "SELECT portfolio, count(*) AS days, count(*) FILTER (WHERE x.date IS NULL OR y.date IS NULL) AS unmatched_days, " + ", ".join(r(f"max(abs(x.{c} - y.{c}))", f"difference_{c}") for c in _AUDITED) + ", "
    "count(*) FILTER (WHERE x.date IS NULL OR y.date IS NULL) = 0 AND " + " AND ".join(f"coalesce(max(abs(x.{c} - y.{c})), 0) < 1e-12" for c in _AUDITED) + " AS passes FROM "
    "(SELECT * FROM daily WHERE gross_exposure > 0 OR turnover > 0) x FULL JOIN (SELECT portfolio, date, " + ", ".join(f"sum({e}) AS {c}" for c, e in _AUDITED.items()) + " FROM security GROUP BY portfolio, date) y USING (portfolio, date) GROUP BY portfolio",
    "daily security",
)
def _(spark, d):
    return attribution.reconcile(_daily(spark, d), _security(spark, d))


@entry(
    "security_contributions",
    "SELECT portfolio, ticker, " + rs("long_contribution", "short_contribution", "gross_contribution", "transaction_cost", "net_contribution") + ", held_days, traded_days, " + r("abs(net_contribution) / sum(abs(net_contribution)) OVER (PARTITION BY portfolio)", "absolute_share") + " FROM ("
    "SELECT portfolio, ticker, sum(long_return_contribution) AS long_contribution, sum(short_return_contribution) AS short_contribution, sum(gross_return_contribution) AS gross_contribution, sum(transaction_cost_contribution) AS transaction_cost, sum(net_return_contribution) AS net_contribution, "
    "count(*) FILTER (WHERE weight <> 0) AS held_days, count(*) FILTER (WHERE trade <> 0) AS traded_days FROM security GROUP BY portfolio, ticker)",
    "security",
)
def _(spark, d):
    return attribution.security_contributions(_security(spark, d))


_SIDES = ("long_return", "short_return", "gross_return", "transaction_cost", "net_return")


@entry(
    "side_cost_summary",
    "SELECT portfolio, count(*) AS observations, " + ", ".join(r(f"sum({c})", f"total_{c}") for c in _SIDES) + ", " + ", ".join(r(f"avg({c}) * 252", f"annualised_{c}") for c in _SIDES)
    + ", count(*) FILTER (WHERE is_rebalance) AS rebalance_days, " + r("avg(turnover) FILTER (WHERE is_rebalance)", "average_rebalance_turnover") + ", " + r("avg(transaction_cost) FILTER (WHERE is_rebalance)", "average_rebalance_cost") + " FROM daily GROUP BY portfolio",
    "daily",
)
def _(spark, d):
    return attribution.side_cost_summary(_daily(spark, d))


@entry("attribution_history", "SELECT portfolio, date, " + ", ".join(r(f"sum({c}) OVER (PARTITION BY portfolio ORDER BY date ROWS UNBOUNDED PRECEDING)", f"cumulative_{c}") for c in _SIDES) + " FROM daily", "daily")
def _(spark, d):
    return attribution.attribution_history(_daily(spark, d))


# --- risk state ----------------------------------------------------------------------

CTES["beta_sums"] = (
    "detail",
    "SELECT portfolio, date, sum(long_weight) AS holdings_long_exposure, sum(short_weight) AS holdings_short_exposure, sum(absolute_weight) AS holdings_gross_exposure, sum(weight) AS holdings_net_exposure, sum(beta_covered_gross_weight) AS beta_covered_gross_weight, "
    "sum(long_beta_contribution) AS holdings_long_beta_contribution, sum(short_beta_contribution) AS holdings_short_beta_contribution, sum(market_beta_contribution) AS holdings_market_beta FROM detail GROUP BY portfolio, date",
)
_BETA = ("holdings_long_exposure", "holdings_short_exposure", "holdings_gross_exposure", "holdings_net_exposure", "beta_covered_gross_weight", "holdings_long_beta_contribution", "holdings_short_beta_contribution", "holdings_market_beta")


@entry(
    "holdings_beta_state",
    f"SELECT portfolio, date, {rs(*_BETA)}, " + r("holdings_long_beta_contribution / CASE WHEN holdings_long_exposure > 0 THEN holdings_long_exposure END", "long_basket_beta") + ", "
    + r("-holdings_short_beta_contribution / CASE WHEN holdings_short_exposure > 0 THEN holdings_short_exposure END", "short_basket_beta") + ", " + r("beta_covered_gross_weight / CASE WHEN holdings_gross_exposure > 0 THEN holdings_gross_exposure END", "beta_coverage") + " FROM beta_sums",
    "beta_sums",
)
def _(spark, d):
    return risk.holdings_beta_state(_beta_detail(spark, d))


_KB = "(PARTITION BY portfolio, stream ORDER BY date ROWS BETWEEN 125 PRECEDING AND CURRENT ROW)"


@entry(
    "realised_beta",
    "SELECT portfolio, stream, date, " + r(f"CASE WHEN count(m) OVER {_KB} >= 126 AND var_samp(m) OVER {_KB} > 0 THEN covar_samp(y, m) OVER {_KB} / var_samp(m) OVER {_KB} END", "realised_beta_126") + ", "
    + r(f"CASE WHEN count(m) OVER {_KB} >= 126 AND stddev_pop(y) OVER {_KB} * stddev_pop(m) OVER {_KB} > 1e-24 THEN covar_pop(y, m) OVER {_KB} / (stddev_pop(y) OVER {_KB} * stddev_pop(m) OVER {_KB}) END", "market_correlation_126")
    + " FROM (SELECT portfolio, stream, date, value AS y, market_return AS m FROM streams)",
    "streams",
)
def _(spark, d):
    return risk.realised_beta_state(_daily(spark, d), _market(spark, d, True))


def _conc(value: str, prefix: str, suffix: str = "") -> str:
    v = f"({value}) FILTER (WHERE {value} > 1e-12)"

    def f(name, e):
        return r(e, name + suffix)

    return (
        f"count{v} AS {prefix}_count{suffix}, " + f(f"effective_{prefix}_count", f"sum{v} * sum{v} / sum({value} * {value}) FILTER (WHERE {value} > 1e-12)") + ", "
        + f(f"largest_{prefix}_share", f"max{v} / sum{v}") + ", "
        + ", ".join(f(f"top_{n}_{prefix}_share", f"list_sum(list_slice(list_reverse_sort(list{v}), 1, {k})) / sum{v}") for n, k in (("three", 3), ("five", 5)))
    )


@entry(
    "position_concentration",
    f"SELECT portfolio, date, {_conc('g', 'gross_position')}, {_conc('l', 'long_position')}, {_conc('s', 'short_position')} FROM (SELECT portfolio, date, abs(weight) AS g, greatest(weight, 0) AS l, greatest(-weight, 0) AS s FROM holdings) GROUP BY portfolio, date",
    "holdings",
)
def _(spark, d):
    return risk.position_concentration(_holdings(spark, d))


@entry(
    "sector_concentration",
    f"SELECT portfolio, date, {_conc('g', 'gross_sector')}, {r('max(abs(n))', 'largest_absolute_sector_net_exposure')} FROM (SELECT portfolio, date, sector, sum(abs(weight)) AS g, sum(weight) AS n FROM holdings h JOIN sector s ON s.ticker = h.ticker WHERE sector IS NOT NULL GROUP BY 1, 2, 3) GROUP BY portfolio, date",
    "holdings sector",
)
def _(spark, d):
    return risk.sector_concentration(_holdings(spark, d), sources.sectors(spark, d))


@entry("beta_concentration", f"SELECT portfolio, date, {_conc('g', 'absolute_beta_contribution')} FROM (SELECT portfolio, date, abs(market_beta_contribution) AS g FROM detail) GROUP BY portfolio, date", "detail")
def _(spark, d):
    return risk.beta_concentration(_beta_detail(spark, d))


_DENSE63 = (
    "SELECT portfolio, date, ticker, sum(v) OVER k AS c, row_number() OVER (PARTITION BY portfolio, ticker ORDER BY date) AS n FROM (SELECT a.portfolio, a.date, b.ticker, coalesce(s.v, 0) AS v FROM (SELECT DISTINCT portfolio, date FROM security) a JOIN (SELECT DISTINCT portfolio, ticker FROM security) b ON a.portfolio = b.portfolio "
    "LEFT JOIN (SELECT portfolio, date, ticker, sum(net_return_contribution) AS v FROM security GROUP BY 1, 2, 3) s ON s.portfolio = a.portfolio AND s.date = a.date AND s.ticker = b.ticker) WINDOW k AS (PARTITION BY portfolio, ticker ORDER BY date ROWS BETWEEN 62 PRECEDING AND CURRENT ROW)"
)


@entry(
    "contribution_concentration",
    f"SELECT portfolio, date, {_conc('g', 'contributor', '_63')} FROM (SELECT portfolio, date, abs(c) AS g FROM ({_DENSE63}) WHERE n >= 63) GROUP BY portfolio, date",
    "security",
)
def _(spark, d):
    return risk.contribution_concentration(_security(spark, d), "ticker", "net_return_contribution", "contributor").drop("largest_contributor_63")


# --- monitoring -----------------------------------------------------------------------


def _rr(fn: str, window: int) -> str:
    return _roll(fn, "ret", window, window, 0, "PARTITION BY portfolio ORDER BY date")


_HELD = "(PARTITION BY portfolio ORDER BY date ROWS BETWEEN 251 PRECEDING AND CURRENT ROW)"
CTES["risk_state"] = (
    "risk",
    "SELECT portfolio, date, ret, wealth, drawdown, CASE WHEN drawdown IS NOT NULL THEN sum(CASE WHEN drawdown < 0 THEN 1 ELSE 0 END) OVER (PARTITION BY portfolio, island ORDER BY date ROWS UNBOUNDED PRECEDING) END AS drawdown_duration, "
    f"({_rr('product(1 + {})', 252)}) - 1 AS trailing_return_252, ({_rr('avg({})', 252)}) / CASE WHEN ({_rr('stddev_samp({})', 252)}) > 1e-12 THEN ({_rr('stddev_samp({})', 252)}) END * sqrt(252) AS rolling_sharpe_252, "
    f"({_rr('stddev_samp({})', 126)}) * sqrt(252) AS annualised_volatility_126, sqrt(({_roll('avg({})', 'low', 126, 126, 0, 'PARTITION BY portfolio ORDER BY date')}) * 252) AS annualised_downside_deviation_126 FROM ("
    "SELECT *, CASE WHEN ret IS NOT NULL THEN least(ret, 0) * least(ret, 0) END AS low, sum(CASE WHEN drawdown < 0 THEN 0 ELSE 1 END) OVER (PARTITION BY portfolio ORDER BY date ROWS UNBOUNDED PRECEDING) AS island FROM risk)",
)
_RISK = ("wealth", "drawdown", "trailing_return_252", "rolling_sharpe_252", "annualised_volatility_126", "annualised_downside_deviation_126")


@shared
def _performance(spark, d):
    return monitoring.performance_risk(_daily(spark, d), _market(spark, d, True))


@entry("performance_risk", f"SELECT portfolio, date, {r('ret', 'return')}, CAST(drawdown_duration AS DOUBLE) AS drawdown_duration, {rs(*_RISK)} FROM risk_state", "risk_state")
def _(spark, d):
    return _performance(spark, d).drop("maximum_drawdown_252").withColumn("drawdown_duration", F.col("drawdown_duration").cast("double"))


_NUMBERED = "(SELECT portfolio, date, ret, row_number() OVER (PARTITION BY portfolio ORDER BY date) AS k FROM risk)"
#: Every full window on its own: wealth from 1 on, its running peak, and the deepest fall.
_DRAWDOWN_SQL = (
    "SELECT portfolio, date, " + r("CASE WHEN n >= 252 THEN dd END", "maximum_drawdown_252") + " FROM (SELECT portfolio, date, count(*) AS n, least(0, min(v / greatest(1, peak) - 1)) AS dd FROM ("
    "SELECT *, max(v) OVER (PARTITION BY portfolio, date ORDER BY k ROWS UNBOUNDED PRECEDING) AS peak FROM ("
    f"SELECT e.portfolio, e.date, j.k, product(1 + j.ret) OVER (PARTITION BY e.portfolio, e.date ORDER BY j.k ROWS UNBOUNDED PRECEDING) AS v FROM {_NUMBERED} e JOIN {_NUMBERED} j "
    "ON j.portfolio = e.portfolio AND j.k BETWEEN e.k - 251 AND e.k AND j.ret IS NOT NULL)) GROUP BY portfolio, date "
    f"UNION ALL SELECT portfolio, date, 0, 0 FROM {_NUMBERED} WHERE k = 1 AND ret IS NULL)"
)


@entry("rolling_drawdown", _DRAWDOWN_SQL, "risk")
def _(spark, d):
    return _performance(spark, d).select("portfolio", "date", "maximum_drawdown_252")


@entry(
    "drawdown_episodes",
    "SELECT portfolio, coalesce(arg_min(b, date) FILTER (WHERE b IS NOT NULL AND date = first), min(date)) AS peak_date, arg_min(date, (drawdown, date)) AS trough_date, arg_max_null(a, date) AS recovery_date, " + r("min(drawdown)", "depth") + ", count(*) AS rows_under_water FROM ("
    "SELECT *, min(date) OVER (PARTITION BY portfolio, island) AS first FROM (SELECT portfolio, date, drawdown, b, a, island FROM (SELECT *, lag(date) OVER w AS b, lead(date) OVER w AS a, sum(CASE WHEN drawdown < 0 THEN 0 ELSE 1 END) OVER (PARTITION BY portfolio ORDER BY date ROWS UNBOUNDED PRECEDING) AS island FROM risk WHERE portfolio <> 'MARKET' WINDOW w AS (PARTITION BY portfolio ORDER BY date)) WHERE drawdown < 0)) GROUP BY portfolio, island",
    "risk",
)
def _(spark, d):
    return metrics.drawdown_episodes(_daily(spark, d), "net_return", ("portfolio",))


_I63 = "(PARTITION BY portfolio ORDER BY date ROWS BETWEEN 62 PRECEDING AND CURRENT ROW)"
CTES["impl_state"] = (
    "implementation",
    "SELECT portfolio, date, turnover, transaction_cost, trade_count, largest_trade_weight, missing_return_weight, bottleneck AS bottleneck_capacity_1pct_usd, fifth AS fifth_percentile_capacity_1pct_usd, middle AS median_capacity_1pct_usd, "
    f"CASE WHEN count(*) OVER {_I63} >= 63 THEN sum(turnover) OVER {_I63} END AS turnover_63, CASE WHEN count(*) OVER {_I63} >= 63 THEN sum(turnover) OVER {_I63} * 252 / 63 END AS annualised_turnover_63, CASE WHEN count(*) OVER {_I63} >= 63 THEN sum(transaction_cost) OVER {_I63} END AS transaction_cost_63, "
    f"count(*) FILTER (WHERE turnover > 1e-12) OVER {_I63} AS trade_days_63, max(largest_trade_weight) OVER {_I63} AS largest_trade_weight_63, min(bottleneck) OVER {_I63} AS minimum_trade_capacity_1pct_usd_63, max(missing_return_weight) OVER {_I63} AS maximum_missing_return_weight_63 FROM implementation",
)
_IMPL = ("turnover", "transaction_cost", "largest_trade_weight", "missing_return_weight", "bottleneck_capacity_1pct_usd", "fifth_percentile_capacity_1pct_usd", "median_capacity_1pct_usd", "turnover_63", "annualised_turnover_63", "transaction_cost_63", "largest_trade_weight_63", "minimum_trade_capacity_1pct_usd_63", "maximum_missing_return_weight_63")


@shared
def _liquid(spark, d):
    return monitoring.traded_liquidity(_security(spark, d), _prices(spark, d))


@shared
def _implementation(spark, d):
    return monitoring.implementation_state(_liquid(spark, d), _prices(spark, d))


@entry("implementation_state", f"SELECT portfolio, date, trade_count, trade_days_63, {rs(*_IMPL)} FROM impl_state", "impl_state")
def _(spark, d):
    return _implementation(spark, d).select("portfolio", "date", "trade_count", "trade_days_63", *_IMPL)


@entry("liquidity_coverage", f"SELECT portfolio, date, {rs('turnover')}, {r('covered', 'liquidity_covered_turnover')}, {r('CASE WHEN turnover > 1e-12 THEN covered / turnover ELSE 1 END', 'liquidity_coverage')} FROM implementation", "implementation")
def _(spark, d):
    return monitoring.liquidity_coverage(_liquid(spark, d), _prices(spark, d))


def _flags_sql(source: str, value: str, category: str, diagnostic: str, direction: str) -> str:
    higher = direction == "Higher"
    tail = "Historical upper 10% tail" if higher else "Historical lower 10% tail"
    q, sign = ("0.9", ">") if higher else ("0.1", "<")
    return (
        f"SELECT 'Portfolio' AS entity_type, portfolio AS entity, '{category}' AS category, '{diagnostic}' AS diagnostic, max(date) AS latest_date, {r('max(lv)', 'latest_value')}, '{direction}' AS adverse_direction, "
        f"CASE WHEN count(DISTINCT v) > 1 THEN '{tail}' ELSE 'Historical calibration unavailable' END AS calibration, {r(f'CASE WHEN count(DISTINCT v) > 1 THEN quantile_cont(v, {q}) END', 'threshold_value')}, "
        f"{r('CASE WHEN count(DISTINCT v) > 1 THEN avg(CASE WHEN v IS NOT NULL THEN CAST(v <= lv AS INT) END) END', 'historical_percentile')}, "
        f"CASE WHEN count(DISTINCT v) <= 1 OR max(lv) IS NULL THEN 'UNAVAILABLE' WHEN max(lv) {sign} quantile_cont(v, {q}) THEN 'WARNING' ELSE 'PASS' END AS status FROM ("
        f"SELECT *, arg_max_null(v, date) OVER (PARTITION BY portfolio) AS lv FROM (SELECT portfolio, date, {value} AS v FROM {source})) GROUP BY portfolio"
    )


_HISTORY = [("risk_state", "annualised_volatility_126", *monitoring.RISK_METRICS["annualised_volatility_126"]), ("risk_state", "-drawdown", *monitoring.RISK_METRICS["-drawdown"])]
_HISTORY += [("impl_state", k, *v) for k, v in monitoring.IMPLEMENTATION_METRICS.items()]


@entry("historical_flags", " UNION ALL ".join(f"({_flags_sql(*x)})" for x in _HISTORY), "risk_state impl_state")
def _(spark, d):
    a = monitoring.historical_flags(_performance(spark, d), "portfolio", monitoring.RISK_METRICS, "Portfolio")
    return a.unionByName(monitoring.historical_flags(_implementation(spark, d), "portfolio", monitoring.IMPLEMENTATION_METRICS, "Portfolio"))


@shared
def _flags(spark, d):
    """All flags of both books and factors, from the tables that other queries share."""
    detail, security = _beta_detail(spark, d), _security(spark, d)
    return workflow.all_flags(
        _performance(spark, d),
        risk.beta_state(_daily(spark, d), _market(spark, d, True), detail),
        workflow.concentration_states(security, _holdings(spark, d), sources.sectors(spark, d), detail),
        _implementation(spark, d),
        monitoring.liquidity_coverage(_liquid(spark, d), _prices(spark, d)),
        # No flag reads how stable ranks are.
        validation.signal_health(_processed(spark, d), HEALTH, "forward_ret_5d", lags=()),
    )


@entry("diagnostic_flags")
def _(spark, d):
    return _flags(spark, d)


@entry("monitoring_overview")
def _(spark, d):
    return monitoring.overview(_flags(spark, d))


# --- data quality ---------------------------------------------------------------------


@entry(
    "panel_summary",
    "SELECT count(*) AS rows, count(DISTINCT ticker) AS tickers, count(DISTINCT date) AS dates, min(date) AS first_date, max(date) AS last_date, count(*) - count(DISTINCT (date, ticker)) AS repeated_keys, "
    + ", ".join(f"count(*) FILTER (WHERE {c} IS NULL) AS null_{c}" for c in ("adj_close", "volume", "dollar_volume", "close")) + " FROM panel",
    "panel",
)
def _(spark, d):
    return quality.panel_summary(_prices(spark, d))


@entry(
    "missing_dates",
    "SELECT ticker, count(*) AS available_dates, (SELECT count(DISTINCT date) FROM panel) - count(*) AS missing_dates, " + r("count(*)::DOUBLE / (SELECT count(DISTINCT date) FROM panel)", "coverage_ratio") + " FROM (SELECT DISTINCT ticker, date FROM panel) GROUP BY ticker",
    "panel",
)
def _(spark, d):
    return quality.missing_dates(_prices(spark, d))


@entry("missing_tickers", "SELECT date, count(DISTINCT ticker) AS available_tickers, (SELECT count(DISTINCT ticker) FROM panel) - count(DISTINCT ticker) AS missing_tickers FROM panel GROUP BY date", "panel")
def _(spark, d):
    return quality.missing_tickers(_prices(spark, d))


@entry("ticker_history", "SELECT ticker, min(date) AS first_date, max(date) AS last_date, count(*) AS observations, count(*) FILTER (WHERE adj_close IS NULL) AS null_adj_close, count(*) FILTER (WHERE volume IS NULL) AS null_volume FROM panel GROUP BY ticker", "panel")
def _(spark, d):
    return quality.ticker_history(_prices(spark, d))


@entry("extreme_returns", f"SELECT date, ticker, {rs('adj_close', 'ret_1d')} FROM feat WHERE abs(ret_1d) >= 0.1", "feat")
def _(spark, d):
    return quality.extreme_returns(_prices(spark, d), 0.1).select("date", "ticker", "adj_close", "ret_1d")


@entry(
    "sector_coverage",
    "SELECT sector, count(s.ticker) AS universe_tickers, count(p.ticker) AS available_tickers, " + r("count(p.ticker)::DOUBLE / count(s.ticker)", "coverage_ratio") + " FROM sector s LEFT JOIN (SELECT DISTINCT ticker FROM panel) p ON p.ticker = s.ticker GROUP BY sector",
    "panel sector",
)
def _(spark, d):
    return quality.sector_coverage(_prices(spark, d), sources.universe(spark, d))


@entry(
    "calendar_alignment",
    "SELECT count(*) FILTER (WHERE a AND b) AS common_dates, count(*) FILTER (WHERE b IS NULL) AS panel_only_dates, count(*) FILTER (WHERE a IS NULL) AS benchmark_only_dates, " + r("count(*) FILTER (WHERE a AND b)::DOUBLE / count(a)", "alignment_ratio")
    + " FROM (SELECT DISTINCT date, true AS a FROM panel) FULL JOIN (SELECT DISTINCT date, true AS b FROM bench) USING (date)",
    "panel bench",
)
def _(spark, d):
    return quality.calendar_alignment(_prices(spark, d), sources.market_series(spark, d))


# --- dashboard tables and workflow ----------------------------------------------------

_WINDOW = ("1996-01-01", "1999-12-31")


@entry(
    "performance_history",
    f"SELECT portfolio, date, {rs('wealth', 'drawdown')}, {r('wealth / first_value(wealth) OVER (PARTITION BY portfolio ORDER BY date)', 'indexed_wealth')} FROM risk_state WHERE date BETWEEN DATE '{_WINDOW[0]}' AND DATE '{_WINDOW[1]}'",
    "risk_state",
)
def _(spark, d):
    return dashboard.performance_history(_performance(spark, d), None, *_WINDOW).select("portfolio", "date", "wealth", "drawdown", "indexed_wealth")


@entry("latest_performance", f"SELECT portfolio, date, {rs('wealth', 'drawdown', 'annualised_volatility_126')} FROM risk_state QUALIFY row_number() OVER (PARTITION BY portfolio ORDER BY date DESC) = 1", "risk_state")
def _(spark, d):
    return dashboard.latest_rows(_performance(spark, d).select("portfolio", "date", "wealth", "drawdown", "annualised_volatility_126"))


@entry(
    "latest_signal_health",
    "SELECT factor, " + ", ".join(f"{r(f'arg_max({m}, date) FILTER (WHERE {m} IS NOT NULL)', m)}, max(date) FILTER (WHERE {m} IS NOT NULL) AS {m}_date" for m in ("signal_coverage", "daily_ic", "rolling_mean_ic_252", "rank_stability_21")) + " FROM health GROUP BY factor",
    "health",
)
def _(spark, d):
    return dashboard.latest_known(_signal_health(spark, d), ("factor",), ("signal_coverage", "daily_ic", "rolling_mean_ic_252", "rank_stability_21"))


@entry(
    "filter_options",
    "SELECT string_agg(portfolio, ',' ORDER BY portfolio) AS portfolios, max(a) AS first_date, min(b) AS last_date FROM (SELECT portfolio, min(date) AS a, max(date) AS b FROM risk_state GROUP BY portfolio)",
    "risk_state",
)
def _(spark, d):
    return dashboard.filter_options(_performance(spark, d)).withColumn("portfolios", F.array_join("portfolios", ","))


@entry(
    "business_day_age",
    "SELECT day, (SELECT count(*) FROM range(CAST(day AS TIMESTAMP), TIMESTAMP '2002-01-01', INTERVAL 1 DAY) AS t(x) WHERE isodow(x) < 6) AS age FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders WHERE o_orderdate < TIMESTAMP '2002-01-01')",
)
def _(spark, d):
    days = sources.table(spark, d, "orders").select(F.col("o_orderdate").cast("date").alias("day")).distinct().filter("day < date '2002-01-01'")
    return days.withColumn("age", dashboard.business_days(F.col("day"), F.lit("2002-01-01").cast("date")))


@shared
def _factor_panel(spark, d):
    panel = workflow.processed_panel(_prices(spark, d), sources.universe(spark, d))
    return workflow.factor_panel(panel, sources.market_series(spark, d))


@entry(
    "factor_panel",
    f"SELECT p.date, p.ticker, s.name, s.sector, {rs('mom_12_1m_raw', 'mom_12_1m_z', 'mom_12_1m_rank', 'realised_vol_63_z')}, {r('b.beta_126', 'beta_126')} FROM proc p LEFT JOIN sector s ON s.ticker = p.ticker LEFT JOIN beta b ON b.date = p.date AND b.ticker = p.ticker",
    "proc sector beta",
)
def _(spark, d):
    return _factor_panel(spark, d).select("date", "ticker", "name", "sector", "mom_12_1m_raw", "mom_12_1m_z", "mom_12_1m_rank", "realised_vol_63_z", "beta_126")


@entry("strategy_targets")
def _(spark, d):
    return workflow.strategy_targets(_scores(spark, d)).select("portfolio", "date", "ticker", "weight")


@entry(
    "accounting_residuals",
    "SELECT " + ", ".join(
        r(f"max(abs({e}))", f"residual_{k}")
        for k, e in (
            ("gross_return", "gross_return - long_return - short_return"),
            ("net_return", "net_return - gross_return + transaction_cost"),
            ("net_exposure", "net_exposure - long_exposure + short_exposure"),
            ("gross_exposure", "gross_exposure - long_exposure - short_exposure"),
            ("transaction_cost", "transaction_cost - turnover * 0.001::DOUBLE"),
        )
    ) + " FROM daily",
    "daily",
)
def _(spark, d):
    return workflow.accounting_residuals(_daily(spark, d))
