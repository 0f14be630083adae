"""Queries over the driver tables: as-of alignment, stress, robust regressions, grids, beta books, reconciliation, loading."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantloom.operators import alignment, attribution, beta_books, costs, dashboard, evidence, grid, linear, portfolio, reconcile, risk, stress
from quantloom.operators.contracts import Contract
from quantloom.plans import further
from quantloom.plans import registry as base
from quantloom.plans.registry import CTES, _return_summary, _roll, entry, r, rs
from quantloom.sources import files, loader
from quantloom.sources import panel as sources
from quantloom.sources.shared import kept, once

# --- as-of alignment ----------------------------------------------------------------------

CTES["share"] = (
    "sleeve_vol",
    "SELECT date, CASE WHEN a > 0 AND b > 0 THEN (1 / a) / (1 / a + 1 / b) END AS a, CASE WHEN a > 0 AND b > 0 THEN (1 / b) / (1 / a + 1 / b) END AS b FROM ("
    "SELECT date, max(volatility) FILTER (WHERE sleeve = 'Momentum') AS a, max(volatility) FILTER (WHERE sleeve = 'Volatility') AS b FROM sleeve_vol GROUP BY date)",
)
CTES["months"] = ("dates", "SELECT DISTINCT CAST(date_trunc('month', date) AS DATE) AS date FROM dates")


def _shares(spark, d):
    """Inverse-volatility shares of both sleeves on every date."""
    vols = portfolio.trailing_volatility(further._sleeves(spark, d))
    a, b = (F.max(F.when(F.col("sleeve") == s, F.col("volatility"))) for s in ("Momentum", "Volatility"))
    wide = vols.groupBy("date").agg(a.alias("va"), b.alias("vb"))
    both = (F.col("va") > 0) & (F.col("vb") > 0)
    total = 1 / F.col("va") + 1 / F.col("vb")
    return wide.select("date", *[F.when(both, 1 / F.col(f"v{x}") / total).alias(x) for x in "ab"])


@entry(
    "asof_allocations",
    f"SELECT date, {rs('a', 'b')}, allocation_date, coalesce(abs(a + b - 1) <= 1e-12, false) AS complete, {r('a - lag(a) OVER (ORDER BY date)', 'change_a')}, {r('b - lag(b) OVER (ORDER BY date)', 'change_b')} FROM ("
    "SELECT m.date, s.a, s.b, s.date AS allocation_date FROM months m ASOF LEFT JOIN share s ON m.date >= s.date)",
    "months share",
)
def _(spark, d):
    dates = portfolio.usable_dates(base._processed(spark, d), "forward_ret_1d")
    months = dates.select(F.trunc("date", "month").alias("date")).distinct()
    return alignment.dated_allocations(_shares(spark, d), months, ["a", "b"])


@entry(
    "asof_prices",
    f"SELECT l_orderkey, l_linenumber, {r('p.adj_close', 'price')}, p.date AS price_date FROM (SELECT l_orderkey, l_linenumber, 'S' || l_suppkey AS ticker, CAST(o_orderdate AS DATE) AS day FROM lineitem JOIN orders ON l_orderkey = o_orderkey) q "
    "ASOF LEFT JOIN panel p ON p.ticker = q.ticker AND q.day > p.date",
    "panel",
)
def _(spark, d):
    """The supplier's last price before the day of the order, for every line of it."""
    lines = sources.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.lit("S"), F.col("l_suppkey")).alias("ticker"))
    orders = sources.table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderdate").cast("date").alias("date"))
    prices = base._prices(spark, d).select("date", "ticker", F.col("adj_close").alias("price"))
    return alignment.asof_join(lines.join(orders, "l_orderkey"), prices, keys=["ticker"], strict=True, matched="price_date").drop("ticker", "date")


CTES["yield"] = ("", "SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS date, round(100 * avg(l_discount), 6) AS irx FROM lineitem GROUP BY 1")
CTES["rate"] = ("yield dates", "SELECT d.date, pow(1 + y.irx / 100.0::DOUBLE, 1.0::DOUBLE / 252) - 1 AS rate FROM dates d ASOF LEFT JOIN yield y ON d.date >= y.date")


def _rates(spark, d):
    """Daily rates from a monthly series: the mean discount in per cent."""
    lines = sources.table(spark, d, "lineitem")
    yields = lines.groupBy(F.trunc(F.col("l_shipdate").cast("date"), "month").alias("date")).agg(F.round(100 * F.avg("l_discount"), 6).alias("irx"))
    dates = portfolio.usable_dates(base._processed(spark, d), "forward_ret_1d")
    return alignment.daily_risk_free(yields, "irx", dates, outside=True)


@entry("risk_free_rates", "SELECT date, round(rate * 1e6, 6) + CAST(0 AS DOUBLE) AS rate_ppm FROM rate", "rate")
def _(spark, d):
    return _rates(spark, d).select("date", (F.col("risk_free_rate") * 1e6).alias("rate_ppm"))


# --- stress -------------------------------------------------------------------------------


def _events_sql(source: str, value: str, key: str, count: int) -> str:
    part, group = (f"PARTITION BY {key} ", f"{key}, ") if key else ("", "")
    path = f"OVER ({part}ORDER BY date ROWS UNBOUNDED PRECEDING)"
    order = f"OVER ({part}ORDER BY date)"
    wealth = f"SELECT {group}date, product(1 + {value}) {path} AS wealth FROM {source} WHERE {value} IS NOT NULL"
    down = f"SELECT *, wealth / greatest(1.0::DOUBLE, max(wealth) {path}) - 1 AS drawdown, lag(date) {order} AS b, lead(date) {order} AS a FROM ({wealth})"
    islands = f"SELECT *, sum(CASE WHEN drawdown < 0 THEN 0 ELSE 1 END) {path} AS island FROM ({down})"
    found = (
        f"SELECT {group}first(b ORDER BY date) AS peak_date, min(date) AS stress_start_date, arg_min(date, (drawdown, date)) AS trough_date, last(a ORDER BY date) AS recovery_date, min(drawdown) AS drawdown, "
        f"list(date) AS days FROM ({islands}) WHERE drawdown < 0 GROUP BY {group}island"
    )
    deep = f"SELECT * EXCLUDE (days), len(list_filter(days, lambda x: x <= trough_date)) AS rows_to_trough FROM ({found}) QUALIFY row_number() OVER ({part}ORDER BY drawdown, trough_date) <= {count}"
    return f"SELECT *, CAST(row_number() OVER ({part}ORDER BY trough_date) AS INT) AS event FROM ({deep})"


CTES["events5"] = ("forward_market", _events_sql("forward_market", "market_return", "", 5))
CTES["events3"] = ("daily", _events_sql("daily", "net_return", "portfolio", 3))
_LEGS = ("long", "short", "gross", "net")
CTES["stressed"] = (
    "events5 daily forward_market",
    "SELECT *, exp_net - exp_market AS gap FROM (SELECT e.event, e.peak_date, e.stress_start_date, e.trough_date, e.drawdown, d.portfolio, count(*) AS n, "
    + ", ".join(f"sum({k}_return) AS {k}" for k in _LEGS)
    + ", sum(transaction_cost) AS cost, product(1 + net_return) - 1 AS exp_net, product(1 + m.market_return) - 1 AS exp_market "
    "FROM daily d JOIN events5 e ON d.date BETWEEN e.stress_start_date AND e.trough_date LEFT JOIN forward_market m ON m.date = d.date GROUP BY ALL)",
)


def _events(spark, d):
    return stress.drawdown_events(base._market(spark, d, True), "market_return", count=5)


def _stressed(spark, d):
    return stress.stress_attribution(base._daily(spark, d), base._market(spark, d, True), _events(spark, d))


@entry("drawdown_events", f"SELECT event, peak_date, stress_start_date, trough_date, recovery_date, {r('drawdown', 'drawdown')}, rows_to_trough, recovery_date IS NOT NULL AS recovered FROM events5", "events5")
def _(spark, d):
    return _events(spark, d)


@entry(
    "stress_attribution",
    f"SELECT event, peak_date, stress_start_date, trough_date, portfolio, n AS observations, {r('drawdown', 'benchmark_drawdown')}, "
    + ", ".join(r(k, f"cumulative_{k}_contribution") for k in _LEGS)
    + f", {r('cost', 'cumulative_transaction_cost')}, {r('exp_net', 'compounded_net_return')}, {r('gap', 'net_minus_benchmark_return')}, short > 0 AS short_side_profitable, exp_net > exp_market AS outperformed_benchmark, abs(long + short - cost - net) < 1e-9 AS reconciles FROM stressed",
    "stressed",
)
def _(spark, d):
    return _stressed(spark, d)


@entry(
    "stress_summary",
    f"SELECT portfolio, count(DISTINCT event) AS event_count, {r('avg(drawdown)', 'average_benchmark_drawdown')}, {r('avg(exp_net)', 'average_net_return')}, {r('avg(gap)', 'average_net_minus_benchmark_return')}, {r('avg(long)', 'average_long_contribution')}, "
    f"{r('avg(short)', 'average_short_contribution')}, {r('avg(cost)', 'average_transaction_cost')}, {r('avg(CAST(short > 0 AS INT))', 'short_profitable_event_fraction')}, {r('avg(CAST(exp_net > exp_market AS INT))', 'outperformance_fraction')}, {r('min(exp_net)', 'worst_event_net_return')} FROM stressed GROUP BY portfolio",
    "stressed",
)
def _(spark, d):
    return stress.summarise_stress(_stressed(spark, d))


@entry(
    "security_stress",
    f"SELECT portfolio, event, ticker, days, short_days, {rs('gross_contribution', 'transaction_cost', 'net_contribution')}, {r('CASE WHEN sum(loss) OVER k > 0 THEN loss / sum(loss) OVER k END', 'loss_share')} FROM ("
    "SELECT *, greatest(-net_contribution, 0) AS loss FROM (SELECT s.portfolio, e.event, s.ticker, count(*) AS days, count(*) FILTER (WHERE s.weight < 0) AS short_days, sum(gross_return_contribution) AS gross_contribution, "
    "sum(transaction_cost_contribution) AS transaction_cost, sum(net_return_contribution) AS net_contribution FROM security s JOIN events3 e ON e.portfolio = s.portfolio AND s.date BETWEEN e.stress_start_date AND e.trough_date GROUP BY ALL)) WINDOW k AS (PARTITION BY portfolio, event)",
    "security events3",
)
def _(spark, d):
    events = stress.drawdown_events(base._daily(spark, d), "net_return", ("portfolio",), count=3)
    return stress.security_stress(base._security(spark, d), events)


# --- regressions with robust errors -----------------------------------------------------------


def _hac_sql(source: str, y: str, features: list[str], key: str, lags: int = 5) -> str:
    """key, n, b0.., v00.. and r2 of a fit with up to three columns, by cofactors."""
    k = len(features)
    f = lambda i: f"f{i}"
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    m = lambda i, j: f"m{min(i, j)}{max(i, j)}"
    rows = f"SELECT {key}, date, {y} AS y, " + ", ".join(f"CAST({e} AS DOUBLE) AS {f(i)}" for i, e in enumerate(features)) + f" FROM {source}"
    rows = f"SELECT * FROM ({rows}) WHERE y IS NOT NULL AND " + " AND ".join(f"{f(i)} IS NOT NULL" for i in range(k))
    sums = f"SELECT {key}, count(*) AS n, var_pop(y) AS vy, " + ", ".join(f"sum({f(i)} * {f(j)}) AS {m(i, j)}" for i, j in pairs) + ", " + ", ".join(f"sum({f(i)} * y) AS c{i}" for i in range(k)) + f" FROM ({rows}) GROUP BY {key}"

    def minor(i, j):
        a, b = [x for x in range(k) if x != i], [x for x in range(k) if x != j]
        inner = m(a[0], b[0]) if k == 2 else f"({m(a[0], b[0])} * {m(a[1], b[1])} - {m(a[0], b[1])} * {m(a[1], b[0])})"
        return inner if (i + j) % 2 == 0 else f"(-{inner})"

    det = " + ".join(f"{m(0, j)} * {minor(0, j)}" for j in range(k))
    inv = "SELECT *, " + ", ".join(f"{minor(i, j)} / ({det}) AS i{i}{j}" for i, j in pairs) + f" FROM ({sums})"
    iv = lambda i, j: f"i{min(i, j)}{max(i, j)}"
    fit = "SELECT *, " + ", ".join("(" + " + ".join(f"{iv(i, j)} * c{j}" for j in range(k)) + f") AS b{i}" for i in range(k)) + f" FROM ({inv})"
    scored = "SELECT r.*, y - " + " - ".join(f"b{i} * {f(i)}" for i in range(k)) + f" AS u FROM ({rows}) r JOIN ({fit}) q USING ({key})"
    scored = "SELECT *, " + ", ".join(f"u * {f(i)} AS s{i}" for i in range(k)) + f" FROM ({scored})"
    lagged = "SELECT *, " + ", ".join(f"lag(s{i}, {q}) OVER p AS s{i}_{q}" for i in range(k) for q in range(1, lags + 1)) + f" FROM ({scored}) WINDOW p AS (PARTITION BY {key} ORDER BY date)"
    cross = lambda i, j: f"s{i} * s{j}" + "".join(f" + {1 - q / (lags + 1)}::DOUBLE * coalesce(s{i} * s{j}_{q} + s{j} * s{i}_{q}, 0)" for q in range(1, lags + 1))
    meat = f"SELECT {key}, sum(u * u) AS ssr, " + ", ".join(f"sum({cross(i, j)}) AS w{i}{j}" for i, j in pairs) + f" FROM ({lagged}) GROUP BY {key}"
    w = lambda i, j: f"w{min(i, j)}{max(i, j)}"
    v = lambda i, j: " + ".join(f"{iv(i, a)} * {w(a, b)} * {iv(b, j)}" for a in range(k) for b in range(k))
    return "SELECT *, 1 - ssr / (vy * n) AS r2, " + ", ".join(f"({v(i, j)}) AS v{i}{j}" for i, j in pairs) + f" FROM ({fit}) JOIN ({meat}) USING ({key})"


CTES["basket"] = ("daily forward_market", "SELECT d.portfolio, d.date, CASE WHEN short_exposure > 0 THEN -short_return / short_exposure END AS y, m.market_return AS x FROM daily d JOIN forward_market m ON m.date = d.date")
CTES["asym"] = ("basket", _hac_sql("basket", "y", ["1", "x", "CASE WHEN x < 0 THEN x WHEN x IS NOT NULL THEN 0 END"], "portfolio"))


@entry(
    "asymmetric_beta",
    f"SELECT portfolio, n AS observations, {r('b0', 'alpha')}, {r('b0 / sqrt(v00)', 'alpha_hac_t_stat')}, {r('b1', 'upside_market_beta')}, {r('b1 + b2', 'downside_market_beta')}, {r('b2', 'downside_minus_upside_beta')}, {r('b2 / sqrt(v22)', 'beta_asymmetry_hac_t_stat')}, "
    f"{r('(b1 - 1) / sqrt(v11)', 'upside_beta_minus_one_hac_t_stat')}, {r('(b1 + b2 - 1) / sqrt(v11 + v22 + 2 * v12)', 'downside_beta_minus_one_hac_t_stat')}, {r('r2', 'r_squared')} FROM asym",
    "asym",
)
def _(spark, d):
    rows = linear.short_basket_returns(base._daily(spark, d), base._market(spark, d, True))
    return linear.asymmetric_beta(rows, "basket_return", "market_return", 5, ("portfolio",))


# --- schedules, costs and intensities ------------------------------------------------------------

FREQUENCIES, COSTS, INTENSITIES = (1, 5, 10, 21), (0.0, 5.0, 10.0, 20.0, 50.0), (0.0, 0.25, 0.5, 0.75, 1.0)
_G = 'book, frequency, "offset"'


def _grid_ctes(prefix: str, books: str, needs: str, frequencies, costs, offsets: str) -> None:
    """CTEs of every schedule on its own: the literal way, densified per schedule."""
    p = prefix
    CTES[f"{p}var"] = ("", f"SELECT f AS frequency, CAST(o AS INT) AS \"offset\" FROM (SELECT unnest({list(frequencies)}) AS f) t, LATERAL (SELECT unnest(range(f)) AS o) u WHERE {offsets}")
    CTES[f"{p}date"] = (
        f"{p}var dates {needs}",
        f"SELECT b.book, v.*, d.date, d.idx, d.idx >= v.\"offset\" AND (d.idx - v.\"offset\") % v.frequency = 0 AS is_rebalance, CASE WHEN d.idx >= v.\"offset\" THEN d.idx - (d.idx - v.\"offset\") % v.frequency END AS s FROM {p}var v CROSS JOIN dates d CROSS JOIN (SELECT DISTINCT book FROM {books}) b",
    )
    CTES[f"{p}span"] = (f"{p}date", f"SELECT book, frequency, \"offset\", date, idx, s, false AS closing FROM {p}date WHERE s IS NOT NULL UNION ALL SELECT book, frequency, \"offset\", date, idx, idx - frequency, true FROM {p}date WHERE is_rebalance AND idx >= \"offset\" + frequency")
    CTES[f"{p}dense"] = (
        f"{p}span dates feat {needs}",
        f"SELECT g.*, b.ticker, b.weight AS w0, f.forward_ret_1d AS r FROM {p}span g JOIN dates ds ON ds.idx = g.s JOIN {books} b ON b.book = g.book AND b.date = ds.date AND b.weight <> 0 LEFT JOIN feat f ON f.date = g.date AND f.ticker = b.ticker",
    )
    CTES[f"{p}w"] = (
        f"{p}dense",
        f"SELECT *, v / (1 - sum(w0) OVER k + sum(v) OVER k) AS w FROM (SELECT *, w0 * coalesce(product(1 + coalesce(r, 0)) OVER (PARTITION BY {_G}, s, ticker ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS v FROM {p}dense) WINDOW k AS (PARTITION BY {_G}, s, idx)",
    )
    CTES[f"{p}hold"] = (
        f"{p}w",
        f"SELECT {_G}, date, ticker, coalesce(max(w) FILTER (WHERE NOT closing), 0) AS weight, coalesce(max(w) FILTER (WHERE closing), 0) AS pre, bool_or(closing OR idx = s) AS traded, max(r) FILTER (WHERE NOT closing) AS r FROM {p}w GROUP BY {_G}, date, ticker",
    )
    CTES[f"{p}daily"] = (
        f"{p}hold {p}date",
        f"SELECT *, gross_return - turnover * cost_bps / 10000 AS net_return, turnover * cost_bps / 10000 AS transaction_cost FROM (SELECT g.book, g.frequency, g.\"offset\", g.date, g.is_rebalance, coalesce(x.gross_return, 0) AS gross_return, coalesce(x.turnover, 0) AS turnover, coalesce(x.gross_exposure, 0) AS gross_exposure FROM {p}date g LEFT JOIN ("
        f"SELECT {_G}, date, sum(weight * coalesce(r, 0)) AS gross_return, sum(CASE WHEN traded THEN abs(weight - pre) ELSE 0 END) AS turnover, sum(abs(weight)) AS gross_exposure FROM {p}hold GROUP BY {_G}, date) x USING ({_G}, date)) CROSS JOIN (SELECT unnest({[float(c) for c in costs]}::DOUBLE[]) AS cost_bps)",
    )
    keys = f"{_G}, cost_bps"
    CTES[f"{p}sum"] = (
        f"{p}daily",
        f"SELECT * FROM ({_return_summary(f'{p}daily', 'net_return', keys)}) JOIN (SELECT {keys}, avg(turnover) AS average_daily_turnover, avg(turnover) FILTER (WHERE is_rebalance) AS average_rebalance_turnover, sum(transaction_cost) AS total_transaction_cost FROM {p}daily GROUP BY {keys}) USING ({keys})",
    )


CTES["gbooks"] = ("books", "SELECT portfolio AS book, date, ticker, weight FROM books")
CTES["ibooks"] = (
    "gbooks share dates",
    f"SELECT printf('intensity %g', x) AS book, date, ticker, sum(weight * CASE WHEN book = 'Momentum' THEN c ELSE 1 - c END) AS weight FROM (SELECT g.*, x, 0.5::DOUBLE + x * (coalesce(s.a, 0.5) - 0.5) AS c FROM gbooks g LEFT JOIN share s ON s.date = g.date CROSS JOIN (SELECT unnest({list(INTENSITIES)}::DOUBLE[]) AS x)) GROUP BY 1, 2, 3",
)
_grid_ctes("g", "gbooks", "gbooks", FREQUENCIES, COSTS, "true")
_grid_ctes("i", "ibooks", "ibooks", (10,), (10.0,), "o IN (0, 5)")
_MEASURES = ("total_return", "annualised_return", "annualised_volatility", "sharpe_ratio", "maximum_drawdown", "average_daily_turnover", "average_rebalance_turnover", "total_transaction_cost")


def _every_date(spark, d):
    """Targets of both books on every usable date: what any schedule may buy."""
    return base._targets(spark, d, True).select(F.col("portfolio").alias("book"), "date", "ticker", "weight")


def published(summary, digits: int = base._DIGITS):
    """The return figures as a summary shows them: tables over schedules are made from these, as their SQL does."""
    return summary.withColumns({m: F.round(m, digits) for m in _MEASURES[:5]})


def _grid(spark, d):
    made = lambda: published(grid.grid_summary(grid.grid_backtests(base._processed(spark, d), _every_date(spark, d), "forward_ret_1d", FREQUENCIES, COSTS)))
    return once(spark, d, "_grid", made)


@entry("robustness_grid", f"SELECT {_G}, {rs('cost_bps')}, observations, {', '.join(r(m, m) for m in _MEASURES)} FROM gsum", "gsum")
def _(spark, d):
    return _grid(spark, d).select(*grid.VARIANT, "cost_bps", "observations", *_MEASURES)


_ACROSS = ("annualised_return", "sharpe_ratio", "maximum_drawdown")


@entry(
    "offset_sensitivity",
    f"SELECT book, frequency, {rs('cost_bps')}, count(*) AS offsets, " + ", ".join(r(f"{f}({m})", f"{n}_{m}") for m in _ACROSS for f, n in (("avg", "mean"), ("min", "min"), ("max", "max"), ("stddev_samp", "std"))) + " FROM gsum t GROUP BY book, frequency, t.cost_bps",
    "gsum",
)
def _(spark, d):
    return grid.across_offsets(_grid(spark, d), _ACROSS)


@entry("intensity_grid", f"SELECT {_G}, {rs('cost_bps')}, observations, {', '.join(r(m, m) for m in _MEASURES)} FROM isum", "isum")
def _(spark, d):
    sleeves = _every_date(spark, d).withColumnRenamed("book", "sleeve")
    shares = _shares(spark, d).select("date", F.col("a").alias("allocation"))
    # Written once: the grid reads its targets four times.
    blends = kept(grid.intensity_blends(sleeves, shares, INTENSITIES, "Momentum", "Volatility"))
    daily = grid.grid_backtests(base._processed(spark, d), blends, "forward_ret_1d", (10,), (10.0,), offsets=(0, 5))
    return grid.grid_summary(daily).select(*grid.VARIANT, "cost_bps", "observations", *_MEASURES)


# --- betting against beta, diagnosis of allocations -------------------------------------------------

CTES["fifths"] = (
    "feat beta",
    "SELECT date, ticker, beta_126, forward_ret_1d, least(5, greatest(1, ceil((rank() OVER (PARTITION BY date ORDER BY beta_126) + (count(*) OVER (PARTITION BY date, beta_126) - 1) / 2.0) / count(*) OVER (PARTITION BY date) * 5))) AS q FROM ("
    "SELECT f.date, f.ticker, b.beta_126, f.forward_ret_1d FROM feat f JOIN beta b ON b.date = f.date AND b.ticker = f.ticker WHERE b.beta_126 IS NOT NULL)",
)
_LEG = ", ".join(f"avg(forward_ret_1d) FILTER (WHERE q = {q}) AS {n}_return, avg(beta_126) FILTER (WHERE q = {q}) AS {n}_beta, count(*) FILTER (WHERE q = {q}) AS {n}_count" for q, n in ((1, "low"), (5, "high")))
CTES["bab"] = (
    "fifths rate",
    "SELECT *, lm * le - hm * he AS bab_return, lu * le - hu * he AS bab_uncapped_return FROM (SELECT *, lu * scale AS lm, hu * scale AS hm, low_return - rate AS le, high_return - rate AS he FROM (SELECT *, CASE WHEN lu + hu IS NOT NULL THEN least(1.0::DOUBLE, 3.0 / (lu + hu)) END AS scale FROM ("
    "SELECT l.*, rate, CASE WHEN 0.6::DOUBLE * low_beta + 0.4::DOUBLE > 0 THEN 1 / (0.6::DOUBLE * low_beta + 0.4::DOUBLE) END AS lu, CASE WHEN 0.6::DOUBLE * high_beta + 0.4::DOUBLE > 0 THEN 1 / (0.6::DOUBLE * high_beta + 0.4::DOUBLE) END AS hu FROM ("
    f"SELECT date, {_LEG} FROM fifths WHERE forward_ret_1d IS NOT NULL GROUP BY date) l LEFT JOIN rate USING (date) WHERE low_count > 0 AND high_count > 0)))",
)


def _bab(spark, d):
    panel = risk.add_stock_beta(base._returns(spark, d), base._market(spark, d))
    return beta_books.betting_against_beta(beta_books.beta_legs(panel), _rates(spark, d))


@entry(
    "bab",
    f"SELECT date, low_count, high_count, {rs('low_beta', 'high_beta')}, {r('lm', 'low_multiplier')}, {r('hm', 'high_multiplier')}, {r('lm + hm', 'gross_exposure')}, {r('lm * low_beta - hm * high_beta', 'estimated_net_beta')}, {rs('bab_return', 'bab_uncapped_return')}, scale < 1 AS is_capped FROM bab",
    "bab",
)
def _(spark, d):
    return _bab(spark, d).select("date", "low_count", "high_count", "low_beta", "high_beta", "low_multiplier", "high_multiplier", "gross_exposure", "estimated_net_beta", "bab_return", "bab_uncapped_return", "is_capped")


@entry(
    "bab_cap_effect",
    f"SELECT count(bab_return) AS dates, {r('avg(CAST(scale < 1 AS INT))', 'capped_fraction')}, {r('corr(bab_return, bab_uncapped_return)', 'return_correlation')}, {r('avg(bab_return)', 'mean_capped')}, {r('avg(bab_uncapped_return)', 'mean_uncapped')}, {r('avg(abs(bab_return - bab_uncapped_return))', 'mean_absolute_cap_effect')}, {r('max(lm + hm)', 'largest_gross_exposure')} FROM bab",
    "bab",
)
def _(spark, d):
    return beta_books.cap_effect(_bab(spark, d)).drop("largest_shrunk_net_beta")


CTES["bab_market"] = ("bab forward_market", "SELECT 'BAB' AS book, b.date, b.bab_return AS y, m.market_return - b.rate AS x FROM bab b JOIN forward_market m ON m.date = b.date")
CTES["bab_fit"] = ("bab_market", _hac_sql("bab_market", "y", ["1", "x"], "book"))


@entry("bab_market_model", f"SELECT t.term, n AS observations, {r('r2', 'r_squared')}, {r('e', 'estimate')}, {r('sqrt(v)', 'error')}, {r('e / sqrt(v)', 't')} FROM (SELECT 'const' AS term, n, r2, b0 AS e, v00 AS v FROM bab_fit UNION ALL SELECT 'market_excess', n, r2, b1, v11 FROM bab_fit) t", "bab_fit")
def _(spark, d):
    rows = _bab(spark, d).join(base._market(spark, d, True), "date").withColumn("market_excess", F.col("market_return") - F.col("risk_free_rate"))
    return linear.hac_fit(rows.withColumn("book", F.lit("BAB")), "bab_return", ["market_excess"], 5, ("book",)).drop("book", "null_value")


_K40 = "WINDOW k AS (ORDER BY date ROWS BETWEEN 40 PRECEDING AND 1 PRECEDING)"
_MOMENTS = ", ".join(f"CASE WHEN count(a) OVER k >= 20 THEN {f} OVER k END AS {n}" for f, n in (("avg(a)", "ma"), ("avg(b)", "mb"), ("var_samp(a)", "va"), ("var_samp(b)", "vb"), ("covar_samp(a, b)", "c")))
CTES["alloc"] = (
    "joint dates",
    "SELECT date, w AS wa, 1 - w AS wb, ma, mb FROM (SELECT p.*, CASE WHEN va + vb - 2 * c > 1e-12 THEN least(1, greatest(0, (vb - c) / (va + vb - 2 * c))) ELSE 0.5 END AS w "
    f"FROM (SELECT date, {_MOMENTS} FROM joint {_K40}) p JOIN dates d ON d.date = p.date WHERE ma IS NOT NULL AND d.idx % 5 = 0)",
)
CTES["diag"] = (
    "alloc joint",
    "SELECT *, pr - er AS diff, ma - mb AS es, ra - rb AS rs, wa - wb AS ws, least(wa, wb) <= 1e-12 AS edge, abs(wa - lag(wa) OVER (ORDER BY date)) AS moved, "
    "CASE WHEN abs(ma - mb) > 1e-12 AND abs(ra - rb) > 1e-12 THEN CAST((ma - mb) * (ra - rb) > 0 AS INT) END AS hit, CASE WHEN abs(wa - wb) > 1e-12 AND abs(ra - rb) > 1e-12 THEN CAST((wa - wb) * (ra - rb) > 0 AS INT) END AS won FROM ("
    "SELECT q.*, count(j.a) AS n, CASE WHEN count(j.a) > 0 THEN product(1 + j.a) - 1 END AS ra, CASE WHEN count(j.a) > 0 THEN product(1 + j.b) - 1 END AS rb, CASE WHEN count(j.a) > 0 THEN product(1 + wa * j.a + wb * j.b) - 1 END AS pr, "
    "CASE WHEN count(j.a) > 0 THEN product(1 + (j.a + j.b) / 2) - 1 END AS er FROM (SELECT *, lead(date) OVER (ORDER BY date) AS until FROM alloc) q LEFT JOIN joint j ON j.date >= q.date AND (q.until IS NULL OR j.date < q.until) GROUP BY ALL)",
)


def _diagnosis(spark, d):
    wide = further._sleeves(spark, d).groupBy("date").agg(*[F.max(F.when(F.col("sleeve") == s, F.col("value"))).alias(n) for s, n in (("Momentum", "a"), ("Volatility", "b"))])
    moments = portfolio.pair_moments(wide.filter("a is not null and b is not null"), "a", "b", 40, 20)
    weight = portfolio.minimum_variance_pair(F.col("var_a"), F.col("var_b"), F.col("cov"))
    chosen = portfolio.rebalance_dates(portfolio.usable_dates(base._processed(spark, d), "forward_ret_1d"), 5)
    rows = moments.filter("mean_a is not null").join(chosen.select("date"), "date", "left_semi")
    allocations = rows.select("date", weight.alias("weight_a"), (1 - weight).alias("weight_b"), F.col("mean_a").alias("estimate_a"), F.col("mean_b").alias("estimate_b"))
    return beta_books.forward_diagnosis(allocations, moments.select("date", "a", "b"))


@entry(
    "allocation_diagnosis",
    f"SELECT date, n AS forward_observations, {r('wa', 'weight_a')}, {r('ra', 'realised_a')}, {r('rb', 'realised_b')}, {r('pr', 'period_return')}, {r('er', 'equal_weight_period_return')}, {r('es', 'estimated_spread')}, {r('rs', 'realised_spread')}, {r('diff', 'return_difference')}, hit AS rank_hit, won AS allocated_sleeve_won, edge AS is_boundary FROM diag",
    "diag",
)
def _(spark, d):
    return _diagnosis(spark, d).select("date", "forward_observations", "weight_a", "realised_a", "realised_b", "period_return", "equal_weight_period_return", "estimated_spread", "realised_spread", "return_difference", "rank_hit", "allocated_sleeve_won", "is_boundary")


@entry(
    "allocation_diagnosis_summary",
    f"SELECT count(*) AS allocations, {r('avg(CAST(edge AS INT))', 'boundary_fraction')}, {r('corr(es, rs)', 'spread_pearson')}, {r('corr(CASE WHEN j THEN k1 END, CASE WHEN j THEN k2 END)', 'spread_spearman')}, {r('avg(hit)', 'rank_hit_rate')}, {r('avg(won)', 'higher_weight_win_rate')}, {r('avg(CAST(diff > 0 AS INT))', 'positive_difference_fraction')}, {r('avg(diff) * 10000', 'mean_difference_bps')}, "
    f"{r('pow(product(1 + pr), 252.0::DOUBLE / sum(n)) - 1', 'annualised_return')}, {r('pow(product(1 + er), 252.0::DOUBLE / sum(n)) - 1', 'equal_weight_annualised_return')} FROM ("
    "SELECT *, rank() OVER (PARTITION BY j ORDER BY es) + (count(*) OVER (PARTITION BY j, es) - 1) / 2.0 AS k1, rank() OVER (PARTITION BY j ORDER BY rs) + (count(*) OVER (PARTITION BY j, rs) - 1) / 2.0 AS k2 FROM (SELECT *, es IS NOT NULL AND rs IS NOT NULL AS j FROM diag))",
    "diag",
)
def _(spark, d):
    return beta_books.summarise_diagnosis(_diagnosis(spark, d)).drop("boundary_change", "interior_change")


# --- reconciliation and loading ------------------------------------------------------------------

CTES["vintage"] = (
    "",
    "SELECT CAST(date_trunc('week', l_shipdate) AS DATE) AS date, 'S' || l_suppkey AS ticker, round(100 * (1 + avg(l_tax) - avg(l_discount)), 6) AS adj_close, sum(l_quantity) AS volume FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1, 2",
)


CTES["both_sides"] = (
    "panel vintage",
    "SELECT coalesce(a.date, b.date) AS date, coalesce(a.ticker, b.ticker) AS ticker, a.date IS NULL AS no_a, b.date IS NULL AS no_b, a.adj_close AS pa, b.adj_close AS pb, a.volume AS va, b.volume AS vb FROM panel a FULL JOIN vintage b ON a.date = b.date AND a.ticker = b.ticker",
)


@entry(
    "price_revisions",
    "SELECT '{\"date\":\"' || strftime(date, '%Y-%m-%d') || '\",\"ticker\":\"' || ticker || '\"}' AS key, c AS \"column\", kind, " + r("gap", "gap") + " FROM ("
    "SELECT date, ticker, CAST(NULL AS VARCHAR) AS c, CASE WHEN no_a THEN 'extra_row' ELSE 'missing_row' END AS kind, CAST(NULL AS DOUBLE) AS gap FROM both_sides WHERE no_a OR no_b "
    "UNION ALL SELECT date, ticker, 'adj_close', 'value', abs(pa - pb) FROM both_sides WHERE abs(pa - pb) > 0.5 UNION ALL SELECT date, ticker, 'volume', 'value', abs(va - vb) FROM both_sides WHERE va <> vb)",
    "both_sides",
)
def _(spark, d):
    """Cells in which the panel differs from one without returned lines."""
    lines = sources.table(spark, d, "lineitem").filter("l_returnflag <> 'R'")
    week = F.date_trunc("week", F.col("l_shipdate").cast("date")).cast("date").alias("date")
    later = lines.groupBy(week, F.concat(F.lit("S"), F.col("l_suppkey")).alias("ticker")).agg(sources._price(), F.sum("l_quantity").alias("volume"))
    prices = base._prices(spark, d).select("date", "ticker", "adj_close", "volume")
    return reconcile.row_differences(prices, later, ["date", "ticker"], {"adj_close": 0.5}).select("key", "column", "kind", "gap")


#: Securities without one region: what a reconciliation must find.
_LEFT_OUT = "ASIA"


@entry(
    "attribution_gaps",
    "SELECT portfolio, count(*) AS days, count(*) FILTER (WHERE x.date IS NULL OR y.date IS NULL) AS unmatched_days, " + ", ".join(r(f"max(abs(x.{c} - y.{c}))", f"difference_{c}") for c in base._AUDITED) + ", "
    "count(*) FILTER (WHERE x.date IS NULL OR y.date IS NULL) = 0 AND " + " AND ".join(f"coalesce(max(abs(x.{c} - y.{c})), 0) < 1e-12" for c in base._AUDITED) + " AS passes FROM "
    "(SELECT * FROM daily WHERE gross_exposure > 0 OR turnover > 0) x FULL JOIN (SELECT portfolio, date, " + ", ".join(f"sum({e}) AS {c}" for c, e in base._AUDITED.items()) + " FROM security WHERE ticker NOT IN (SELECT ticker FROM sector WHERE sector = '" + _LEFT_OUT + "') GROUP BY portfolio, date) y USING (portfolio, date) GROUP BY portfolio",
    "daily security sector",
)
def _(spark, d):
    """The audit on securities of which one region's are left out: every difference that it must show."""
    gone = sources.sectors(spark, d).filter(F.col("sector") == _LEFT_OUT).select("ticker")
    return attribution.reconcile(base._daily(spark, d), base._security(spark, d).join(gone, "ticker", "left_anti"))


#: Fixed contracts of the driver tables; the last three are broken on purpose, each in its own way.
TABLES = {
    "region": Contract("region.parquet", ("r_regionkey",), ("r_name",), None),
    "nation": Contract("nation.parquet", ("n_nationkey",), ("n_name", "n_regionkey"), None),
    "customer": Contract("customer.parquet", ("c_custkey",), ("c_nationkey",), None),
    "supplier": Contract("supplier.parquet", ("s_suppkey",), ("s_nationkey",), None),
    "part": Contract("part.parquet", ("p_partkey",), ("p_name",), None),
    "orders": Contract("orders.parquet", ("o_orderkey",), ("o_custkey",), "o_orderdate"),
    "events": Contract("events.parquet", ("event_id",), ("user_id",), "ts"),
}
BROKEN = {
    "orders_by_customer": Contract("orders.parquet", ("o_custkey",), (), "o_orderdate"),
    "lines_with_a_receipt": Contract("lineitem.parquet", ("l_orderkey",), ("l_receiptdate",), "l_shipdate"),
    "returns": Contract("returns.parquet", ("r_key",), ()),
}
_AS_OF = "2002-01-01"


def _profile_sql(name: str, contract: Contract) -> str:
    day = f"CAST({contract.date} AS DATE)" if contract.date else "CAST(NULL AS DATE)"
    return f"SELECT 'tables' AS \"group\", '{name}' AS dataset, count(*) AS rows, min({day}) AS start_date, max({day}) AS end_date FROM {contract.filename.removesuffix('.parquet')}"


@entry(
    "dataset_status",
    "SELECT \"group\", dataset, true AS loaded, true AS artifact_valid, true AS group_valid, rows, start_date, end_date, coalesce(end_date, proxy) AS freshness_reference_date, "
    f"CASE WHEN coalesce(end_date, proxy) IS NULL THEN 'UNDATED' WHEN (SELECT count(*) FROM range(CAST(coalesce(end_date, proxy) AS TIMESTAMP), TIMESTAMP '{_AS_OF}', INTERVAL 1 DAY) AS t(x) WHERE isodow(x) < 6) > 500 THEN 'STALE' ELSE 'READY' END AS status FROM ("
    "SELECT *, CASE WHEN dataset = 'customer' THEN max(end_date) FILTER (WHERE dataset = 'orders') OVER () END AS proxy FROM (" + " UNION ALL ".join(_profile_sql(n, c) for n, c in TABLES.items()) + ")) "
    "UNION ALL SELECT 'broken', 'orders_by_customer', true, false, false, NULL, NULL, NULL, NULL, CASE WHEN (SELECT max(n) FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey)) > 1 THEN 'INVALID' ELSE 'UNDATED' END "
    "UNION ALL SELECT 'broken', 'lines_with_a_receipt', true, false, false, NULL, NULL, NULL, NULL, 'INVALID' UNION ALL SELECT 'broken', 'returns', false, false, false, NULL, NULL, NULL, NULL, 'MISSING'",
)
def _(spark, d):
    groups = [loader.Group("tables", d, TABLES), loader.Group("broken", d, BROKEN)]
    proxies = {("tables", "customer"): ("tables", "orders")}
    bundle = loader.load_groups(spark, groups, _AS_OF, 500, proxies, strict=False)
    return bundle.status.select("group", "dataset", "loaded", "artifact_valid", "group_valid", "rows", "start_date", "end_date", "freshness_reference_date", "status")


# --- evidence on candidates -------------------------------------------------------------------------

CTES["spans"] = ("", "SELECT * FROM (VALUES " + ", ".join(f"('{k}', DATE '{a}', DATE '{b}')" for k, (a, b) in base.PERIODS.items()) + ") AS t(subperiod, first, last)")


@entry(
    "capacity_by_subperiod",
    f"SELECT portfolio, rebalance_frequency, rebalance_offset, {rs('participation_limit')}, subperiod, count(*) AS rebalance_observations, {r('quantile_cont(capacity_usd, 0.05)', 'fifth_percentile_capacity_usd')}, {r('quantile_cont(capacity_usd, 0.1)', 'tenth_percentile_capacity_usd')}, "
    f"{r('quantile_cont(capacity_usd, 0.5)', 'median_capacity_usd')}, {r('min(capacity_usd)', 'minimum_capacity_usd')} FROM capacity t JOIN spans ON date BETWEEN first AND last GROUP BY portfolio, rebalance_frequency, rebalance_offset, t.participation_limit, subperiod",
    "capacity spans",
)
def _(spark, d):
    return evidence.capacity_by_subperiod(costs.daily_capacity(base._trades(spark, d)), base.PERIODS)


_R63 = "(PARTITION BY portfolio ORDER BY date ROWS BETWEEN 62 PRECEDING AND CURRENT ROW)"
CTES["growth63"] = (
    "daily",
    f"SELECT portfolio, date, CASE WHEN count(l) OVER {_R63} >= 63 THEN exp(sum(l) OVER {_R63} * 4) - 1 END AS g, CASE WHEN count(net_return) OVER {_R63} >= 63 THEN stddev_samp(net_return) OVER {_R63} * sqrt(252) END AS v FROM (SELECT *, CASE WHEN net_return > -1 THEN ln(1 + net_return) END AS l FROM daily)",
)


@entry("rolling_growth", f"SELECT portfolio, date, {r('g', 'annualised_return_63')}, {r('v', 'annualised_volatility_63')}, {r('CASE WHEN v > 0 THEN g / v END', 'growth_ratio_63')} FROM growth63", "growth63")
def _(spark, d):
    rows = base._daily(spark, d).select("portfolio", "date", "net_return")
    return evidence.rolling_growth(rows, "net_return", ("portfolio",), 63).drop("net_return")


CTES["chosen"] = ("gsum", "SELECT * FROM gsum WHERE (book = 'Momentum' AND frequency = 21) OR (book = 'Volatility' AND frequency = 10)")
_CHOSEN = {book: frequency for book, (_, frequency) in base.BOOKS.items()}


@entry("chosen_schedules", f"SELECT {_G}, {rs('cost_bps')}, {', '.join(r(m, m) for m in _ACROSS)} FROM chosen", "chosen")
def _(spark, d):
    return evidence.chosen_schedules(_grid(spark, d), _CHOSEN, "book").select(*grid.VARIANT, "cost_bps", *_ACROSS)


@entry(
    "candidate_scorecard",
    "SELECT book, " + ", ".join(r(f"max({m}) FILTER (WHERE \"offset\" = 0)", m) for m in _ACROSS) + ", count(*) AS offsets, "
    + ", ".join(r(f"{f}({m})", f"{n}_{m}") for m in _ACROSS for f, n in (("avg", "mean"), ("min", "min"), ("max", "max"), ("stddev_samp", "std")))
    + ", " + r("max(annualised_return) FILTER (WHERE \"offset\" = 0) - avg(annualised_return)", "headline_minus_mean_return") + " FROM chosen WHERE cost_bps = 10 GROUP BY book",
    "chosen",
)
def _(spark, d):
    rows = evidence.chosen_schedules(_grid(spark, d), _CHOSEN, "book").filter("cost_bps = 10")
    headline = rows.filter("offset = 0").select("book", *_ACROSS)
    across = grid.across_offsets(rows, _ACROSS).drop("frequency", "cost_bps")
    return evidence.scorecard(headline, across, ("book",))


def _processed_sql(source: str, raw: str, prefix: str) -> str:
    wins = f"SELECT s.*, CASE WHEN {raw} IS NOT NULL THEN least(greatest({raw}, lo), hi) END AS {prefix}_w FROM {source} s JOIN (SELECT date, quantile_cont({raw}, 0.01) AS lo, quantile_cont({raw}, 0.99) AS hi FROM {source} GROUP BY date) USING (date)"
    return f"SELECT *, CASE WHEN stddev_pop({prefix}_w) OVER q > 0 THEN ({prefix}_w - avg({prefix}_w) OVER q) / stddev_pop({prefix}_w) OVER q END AS {prefix}_z FROM ({wins}) WINDOW q AS (PARTITION BY date)"


CTES["abnormal"] = ("proc", f"SELECT date, ticker, mom_12_1m_z, lv - {_roll('avg({})', 'lv', 21, 21, 1)} AS raw FROM (SELECT *, CASE WHEN dollar_volume > 0 THEN ln(dollar_volume) END AS lv FROM proc)")
CTES["abnormal_z"] = ("abnormal", _processed_sql("abnormal", "raw", "a"))
CTES["crossed"] = ("abnormal_z", "SELECT date, ticker, mom_12_1m_z * a_z AS x FROM abnormal_z")
CTES["crossed_z"] = ("crossed", _processed_sql("crossed", "x", "i"))


@entry("volume_momentum", f"SELECT date, ticker, {r('x', 'volume_momentum_raw')}, {r('i_z', 'volume_momentum_z')} FROM crossed_z", "crossed_z")
def _(spark, d):
    return evidence.volume_momentum(base._processed(spark, d)).select("date", "ticker", "volume_momentum_raw", "volume_momentum_z")


@entry("return_series", f"SELECT date, 'Book' AS series, {r('net_return', 'value')} FROM daily WHERE portfolio = 'Momentum' UNION ALL SELECT d.date, 'Market', {r('m.market_return', 'value')} FROM daily d LEFT JOIN forward_market m ON m.date = d.date WHERE portfolio = 'Momentum'", "daily forward_market")
def _(spark, d):
    rows = base._daily(spark, d).filter("portfolio = 'Momentum'").select("date", "net_return").join(base._market(spark, d, True), "date", "left")
    return evidence.long_series(rows, {"Book": "net_return", "Market": "market_return"})


@entry(
    "risk_snapshot",
    f"SELECT portfolio, date AS latest_date, {r('mb', 'holdings_market_beta')}, {r('gc', 'effective_gross_position_count')} FROM (SELECT portfolio, date, sum(market_beta_contribution) AS mb, pow(sum(a), 2) / sum(a * a) AS gc FROM (SELECT *, CASE WHEN abs(weight) > 1e-12 THEN abs(weight) END AS a FROM detail) GROUP BY portfolio, date) QUALIFY row_number() OVER (PARTITION BY portfolio ORDER BY date DESC) = 1",
    "detail",
)
def _(spark, d):
    beta = risk.holdings_beta_state(base._beta_detail(spark, d)).select("portfolio", "date", "holdings_market_beta")
    spread = risk.position_concentration(base._holdings(spark, d)).select("portfolio", "date", "effective_gross_position_count")
    return evidence.risk_snapshot(beta, spread)


@entry(
    "risk_free_on_calendar",
    "SELECT date, round(1e6 * last_value(rate IGNORE NULLS) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING), 6) + CAST(0 AS DOUBLE) AS rate_ppm FROM dates LEFT JOIN (SELECT CAST(l_shipdate AS DATE) AS date, pow(1 + round(100 * avg(l_discount), 6) / 100.0::DOUBLE, 1.0::DOUBLE / 252) - 1 AS rate FROM lineitem GROUP BY 1 HAVING count(*) >= 25) USING (date)",
    "dates",
)
def _(spark, d):
    """Yields of single days with enough lines; days outside the weekly calendar count for nothing."""
    lines = sources.table(spark, d, "lineitem").groupBy(F.col("l_shipdate").cast("date").alias("date"))
    yields = lines.agg(F.round(100 * F.avg("l_discount"), 6).alias("irx"), F.count("*").alias("n")).filter("n >= 25").drop("n")
    dates = portfolio.usable_dates(base._returns(spark, d), "forward_ret_1d")
    return alignment.daily_risk_free(yields, "irx", dates).select("date", (F.col("risk_free_rate") * 1e6).alias("rate_ppm"))


# --- SQL of the composed queries ---------------------------------------------------------------------


def _share5(value: str) -> str:
    kept = f"({value}) FILTER (WHERE {value} > 1e-12)"
    return f"list_sum(list_slice(list_reverse_sort(list{kept}), 1, 5)) / sum{kept}"


def _rolled63(entity: str, source: str) -> str:
    """Sums of an entity's net contributions over 63 dates of its portfolio, dates without it as 0."""
    return (
        f"SELECT portfolio, date, {entity}, sum(v) OVER k AS c, row_number() OVER (PARTITION BY portfolio, {entity} ORDER BY date) AS n FROM (SELECT a.portfolio, a.date, b.{entity}, coalesce(s.v, 0) AS v FROM (SELECT DISTINCT portfolio, date FROM security) a "
        f"JOIN (SELECT DISTINCT portfolio, {entity} FROM {source}) b ON a.portfolio = b.portfolio LEFT JOIN (SELECT portfolio, date, {entity}, sum(net_return_contribution) AS v FROM {source} GROUP BY 1, 2, 3) s ON s.portfolio = a.portfolio AND s.date = a.date AND s.{entity} = b.{entity}) "
        f"WINDOW k AS (PARTITION BY portfolio, {entity} ORDER BY date ROWS BETWEEN 62 PRECEDING AND CURRENT ROW)"
    )


_BY_SECTOR = "(SELECT s.*, x.sector FROM security s JOIN sector x ON x.ticker = s.ticker WHERE x.sector IS NOT NULL)"
CTES["conc"] = (
    "holdings sector detail security",
    "SELECT h.portfolio, h.date, a.v AS sector_net, b.v AS beta5, c.v AS contributor5, e.v AS sectors63 FROM (SELECT DISTINCT portfolio, date FROM holdings) h "
    "LEFT JOIN (SELECT portfolio, date, max(abs(n)) AS v FROM (SELECT portfolio, date, sector, sum(weight) AS n FROM holdings h JOIN sector s ON s.ticker = h.ticker WHERE sector IS NOT NULL GROUP BY 1, 2, 3) GROUP BY 1, 2) a ON a.portfolio = h.portfolio AND a.date = h.date "
    f"LEFT JOIN (SELECT portfolio, date, {_share5('g')} AS v FROM (SELECT portfolio, date, abs(market_beta_contribution) AS g FROM detail) GROUP BY 1, 2) b ON b.portfolio = h.portfolio AND b.date = h.date "
    f"LEFT JOIN (SELECT portfolio, date, {_share5('g')} AS v FROM (SELECT portfolio, date, abs(c) AS g FROM ({_rolled63('ticker', 'security')}) WHERE n >= 63) GROUP BY 1, 2) c ON c.portfolio = h.portfolio AND c.date = h.date "
    f"LEFT JOIN (SELECT portfolio, date, pow(sum(g) FILTER (WHERE g > 1e-12), 2) / sum(g * g) FILTER (WHERE g > 1e-12) AS v FROM (SELECT portfolio, date, abs(c) AS g FROM ({_rolled63('sector', _BY_SECTOR)}) WHERE n >= 63) GROUP BY 1, 2) e ON e.portfolio = h.portfolio AND e.date = h.date",
)


def _structural_sql(source: str, entity: str, kind: str, value: str, passes: str, threshold: str, category: str, diagnostic: str, calibration: str) -> str:
    return (
        f"SELECT '{kind}' AS entity_type, entity, '{category}' AS category, '{diagnostic}' AS diagnostic, date AS latest_date, {r('v', 'latest_value')}, 'Structural' AS adverse_direction, '{calibration}' AS calibration, {r('t', 'threshold_value')}, "
        f"CAST(NULL AS DOUBLE) AS historical_percentile, CASE WHEN p IS NULL OR v IS NULL THEN 'UNAVAILABLE' WHEN p THEN 'PASS' ELSE 'BREACH' END AS status FROM (SELECT {entity} AS entity, date, {value} AS v, {passes} AS p, {threshold} AS t FROM {source} QUALIFY row_number() OVER (PARTITION BY {entity} ORDER BY date DESC) = 1)"
    )


CTES["betas"] = ("beta_sums", "SELECT portfolio, date, abs(holdings_market_beta) AS beta, CASE WHEN holdings_gross_exposure > 0 THEN beta_covered_gross_weight / holdings_gross_exposure END AS covered FROM beta_sums")
CTES["known_ic"] = ("health", "SELECT factor AS portfolio, date, rolling_mean_ic_252 AS v FROM health QUALIFY rolling_mean_ic_252 IS NOT NULL OR count(rolling_mean_ic_252) OVER (PARTITION BY factor) = 0")
_BOOKS_RISK = "(SELECT * FROM risk_state WHERE portfolio <> 'MARKET')"
_FLAG_PARTS = [
    _structural_sql("betas", "portfolio", "Portfolio", "covered", "covered >= 1 - 1e-8", "1.0", "Market risk", "Holdings beta coverage", "Complete beta coverage"),
    _structural_sql("coverage", "portfolio", "Portfolio", "c", "c >= 1 - 1e-8", "1.0", "Implementation", "Liquidity coverage", "Complete traded-weight coverage"),
    _structural_sql("impl_state", "portfolio", "Portfolio", "maximum_missing_return_weight_63", "maximum_missing_return_weight_63 <= 1e-8", "0.0", "Implementation", "Trailing missing-return weight", "No missing-return exposure"),
    _structural_sql("health", "factor", "Factor", "signal_coverage", "signal_observations >= 30", "30.0::DOUBLE / universe_observations", "Signal", "Signal coverage", "At least 30 cross-sectional observations"),
    *[base._flags_sql(_BOOKS_RISK, k, *v) for k, v in base.monitoring.RISK_METRICS.items()],
    base._flags_sql("betas", "beta", *base.monitoring.BETA_METRICS["abs(holdings_market_beta)"]),
    *[base._flags_sql("conc", c, *v) for c, v in zip(("sector_net", "beta5", "contributor5", "sectors63"), base.monitoring.CONCENTRATION_METRICS.values(), strict=True)],
    *[base._flags_sql("impl_state", k, *v) for k, v in base.monitoring.IMPLEMENTATION_METRICS.items()],
    "SELECT 'Factor' AS entity_type, * EXCLUDE (entity_type) FROM (" + base._flags_sql("known_ic", "v", "Signal", "252-observation rolling mean IC", "Lower") + ")",
]
CTES["flags"] = ("betas coverage impl_state health risk_state conc known_ic", " UNION ALL ".join(f"SELECT * FROM ({p})" for p in _FLAG_PARTS))
base._SQL["diagnostic_flags"] = base._compose(["flags"], "SELECT * FROM flags")
_LEVEL = "CASE {} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in base.monitoring.SEVERITY.items()) + " END"
_WORST = "list_extract(" + str(list(base.monitoring.SEVERITY)) + ", 1 + max(" + _LEVEL.format("status") + "){})"
base._SQL["monitoring_overview"] = base._compose(
    ["flags"],
    "SELECT entity_type, entity, count(*) AS diagnostic_count, " + ", ".join(f"count(*) FILTER (WHERE status = '{k}') AS {k.lower()}_count" for k in base.monitoring.SEVERITY) + f", {_WORST.format('')} AS overall_status, "
    + ", ".join("coalesce(" + _WORST.format(f" FILTER (WHERE category = '{c}')") + f", 'N/A') AS {c.lower().replace(' ', '_')}_status" for c in base.monitoring.CATEGORIES) + " FROM flags GROUP BY entity_type, entity",
)


def _book_sql(score: str) -> str:
    return (
        "SELECT date, ticker, CASE WHEN nl > 0 AND ns > 0 AND q = 5 THEN 1.0::DOUBLE / nl WHEN nl > 0 AND ns > 0 AND q = 1 THEN -1.0::DOUBLE / ns ELSE 0::DOUBLE END AS weight FROM ("
        "SELECT *, count(*) FILTER (WHERE q = 5) OVER k AS nl, count(*) FILTER (WHERE q = 1) OVER k AS ns FROM ("
        f"SELECT *, CASE WHEN x IS NOT NULL AND n >= {base.LEAST} THEN greatest(1, ((rn - 1) * 5 + n - 2) // greatest(n - 1, 1)) END AS q FROM ("
        f"SELECT *, row_number() OVER (PARTITION BY date, x IS NULL ORDER BY x, ticker) AS rn, count(x) OVER (PARTITION BY date) AS n FROM (SELECT date, ticker, {score} AS x FROM proc))) WINDOW k AS (PARTITION BY date))"
    )


CTES["score_book"] = ("proc", _book_sql("0.5::DOUBLE * mom_12_1m_z + 0.5::DOUBLE * realised_vol_63_z"))
CTES["joint10"] = (
    "gdaily",
    "SELECT date, max(v) FILTER (WHERE book = 'Momentum') AS a, max(v) FILTER (WHERE book = 'Volatility') AS b FROM (SELECT book, date, CASE WHEN gross_exposure > 1e-12 THEN gross_return END AS v FROM gdaily WHERE frequency = 10 AND \"offset\" = 0 AND cost_bps = 0) GROUP BY date HAVING count(v) = 2",
)
CTES["alloc10"] = (
    "joint10 dates",
    "SELECT date, CASE WHEN n >= 42 AND sa > 0 AND sb > 0 THEN (1 / sa) / (1 / sa + 1 / sb) ELSE 0.5::DOUBLE END AS a FROM (SELECT q.date, count(j.a) AS n, stddev_samp(j.a) AS sa, stddev_samp(j.b) AS sb FROM (SELECT date FROM dates WHERE idx % 10 = 0) q "
    "LEFT JOIN (SELECT *, row_number() OVER (ORDER BY date) AS k FROM joint10) j ON j.date < q.date AND j.k > (SELECT count(*) FROM joint10 z WHERE z.date < q.date) - 63 GROUP BY q.date)",
)
base._SQL["strategy_targets"] = base._compose(
    ["score_book", "gbooks", "alloc10", "dates"],
    f"SELECT portfolio, date, ticker, {r('weight', 'weight')} FROM (SELECT 'Composite' AS portfolio, s.* FROM score_book s JOIN dates USING (date) WHERE idx % 21 = 0 "
    "UNION ALL SELECT 'Fixed', date, ticker, sum(weight * 0.5::DOUBLE) FROM gbooks JOIN dates USING (date) WHERE idx % 10 = 0 GROUP BY date, ticker "
    "UNION ALL SELECT 'Inverse-Vol', g.date, ticker, sum(weight * CASE WHEN book = 'Momentum' THEN a ELSE 1 - a END) FROM gbooks g JOIN alloc10 q ON q.date = g.date GROUP BY g.date, ticker) x",
)


# --- tables behind the monitoring pages ----------------------------------------------------------------

@entry("active_flags", "SELECT entity_type, entity, category, diagnostic, status, " + _LEVEL.format("status") + " AS status_severity FROM flags WHERE status <> 'PASS'", "flags")
def _(spark, d):
    return base.monitoring.active_flags(base._flags(spark, d)).select("entity_type", "entity", "category", "diagnostic", "status", "status_severity")


@entry("diagnostic_table", f"SELECT entity_type, entity, category, diagnostic, status, {r('latest_value', 'latest_value')} FROM flags WHERE entity_type = 'Portfolio' AND category IN ('Market risk', 'Concentration')", "flags")
def _(spark, d):
    chosen = dashboard.diagnostic_table(base._flags(spark, d), entity_type=["Portfolio"], category=["Market risk", "Concentration"])
    return chosen.select("entity_type", "entity", "category", "diagnostic", "status", "latest_value")


@entry("universe_symbols", "SELECT s_name || '.' || n_name AS ticker, replace(s_name || '.' || n_name, '.', '-') AS vendor_ticker, s_name AS name, r_name AS sector FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def _(spark, d):
    """A listing with headers of any capitalisation as a universe."""
    supplier, nation, region = (sources.table(spark, d, t) for t in ("supplier", "nation", "region"))
    rows = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    listing = rows.select(F.concat(F.lit(" "), "s_name", F.lit("."), "n_name").alias("Symbol"), F.col("s_name").alias("NAME "), F.col("r_name").alias("Sector"))
    return files.get_universe("default", listing)
