"""Operators against hand calculations and literal loops on small panels."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom.functions import stats
from quantloom.operators import attribution, backtest, contracts, costs, cross_section, features, metrics, monitoring, portfolio
from quantloom.operators import quality, regression, risk, validation
from quantloom.sources import files

DAY = dt.date(2020, 1, 1)


def days(n):
    return [DAY + dt.timedelta(days=i) for i in range(n)]


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_momentum_and_volatility_of_constant_growth(spark):
    rows = [(d, t, 100 * g**i, 10.0) for t, g in (("A", 1.01), ("B", 0.99)) for i, d in enumerate(days(300))]
    panel = features.add_raw_factors(frame(spark, rows, "date date, ticker string, adj_close double, volume double"))
    last = {r.ticker: r for r in panel.filter(F.col("date") == days(300)[-1]).collect()}
    assert last["A"].mom_12_1m_raw == pytest.approx(1.01**231 - 1)
    assert last["B"].reversal_1m_raw == pytest.approx(1 - 0.99**21)
    assert last["A"].realised_vol_63_raw == pytest.approx(0, abs=1e-9)
    assert panel.filter("mom_12_1m_raw is not null").count() == 2 * (300 - 252)


def test_lags_do_not_cross_tickers_or_look_ahead(spark):
    rows = [(d, t, 100.0 + i * k) for t, k in (("A", 1), ("B", 2)) for i, d in enumerate(days(30))]
    schema = "date date, ticker string, adj_close double"
    before = features.add_raw_factors(frame(spark, rows, schema)).filter(F.col("date") < days(30)[25])
    changed = [(d, t, p * (3 if d >= days(30)[25] else 1)) for d, t, p in rows]
    after = features.add_raw_factors(frame(spark, changed, schema)).filter(F.col("date") < days(30)[25])
    assert before.exceptAll(after).count() == 0
    assert before.filter("ret_1d is null").count() == 2


def test_bucket_matches_equally_spaced_cuts(spark):
    for n in (10, 11, 23, 37):
        df = frame(spark, [(DAY, f"T{i:03d}", float(i)) for i in range(n)], "date date, ticker string, x double")
        got = [r.quantile for r in cross_section.add_quantiles(df, "x").orderBy("x").collect()]
        edges = [1 + (n - 1) * k / 5 for k in range(6)]
        want = [max(1, next(k for k in range(1, 6) if r <= edges[k] + 1e-9)) for r in range(1, n + 1)]
        assert got == want


def test_bucket_is_null_for_few_values_and_nulls(spark):
    df = frame(spark, [(DAY, f"T{i}", None if i == 0 else float(i)) for i in range(10)], "date date, ticker string, x double")
    assert cross_section.add_quantiles(df, "x").filter("quantile is not null").count() == 0


def test_winsor_keeps_nulls_and_zscore_needs_spread(spark):
    rows = [(DAY, str(i), v) for i, v in enumerate([1.0, 2.0, 3.0, 100.0, None])] + [(days(2)[1], str(i), 5.0) for i in range(3)]
    df = frame(spark, rows, "date date, ticker string, x double")
    out = cross_section.process_factors(df, {"x": "f"}).collect()
    assert [r.f_winsorised for r in out if r.x is None] == [None]
    assert all(r.f_z is None for r in out if r.date != DAY)
    assert max(r.f_winsorised for r in out if r.f_winsorised is not None) == pytest.approx(np.quantile([1, 2, 3, 100], 0.99))


def test_ic_is_one_then_minus_one(spark):
    rows = [(d, f"T{i}", float(i), float(i if k == 0 else -i)) for k, d in enumerate(days(2)) for i in range(30)]
    ics = validation.daily_ic(frame(spark, rows, "date date, ticker string, f double, y double"), "f", "y")
    assert [round(r.ic, 12) for r in ics.orderBy("date").collect()] == [1.0, -1.0]
    summary = validation.summarise_ic(ics).first()
    assert summary.observations == 2 and summary.mean_ic == pytest.approx(0)


def test_constant_side_gives_null_correlation(spark):
    df = frame(spark, [(1.0, float(i)) for i in range(5)], "x double, y double")
    assert df.agg(stats.pearson("x", "y").alias("c")).first().c is None


def _literal_backtest(returns, targets, dates, names):
    """The drift written as a loop."""
    weights, out = dict.fromkeys(names, 0.0), []
    for d in dates:
        turnover = 0.0
        if d in targets:
            turnover = sum(abs(targets[d].get(n, 0.0) - weights[n]) for n in names)
            weights = {n: targets[d].get(n, 0.0) for n in names}
        r = {n: returns.get((d, n)) or 0.0 for n in names}
        gross = sum(weights[n] * r[n] for n in names)
        out.append((d, gross, turnover))
        weights = {n: weights[n] * (1 + r[n]) / (1 + gross) for n in names}
    return out


def test_drift_matches_a_literal_loop(spark):
    rng = np.random.default_rng(5)
    names, dates = list("ABCDEF"), days(40)
    returns = {(d, n): None if rng.random() < 0.05 else float(rng.normal(0, 0.02)) for d in dates for n in names}
    targets = {d: dict(zip(names, rng.permutation([0.5, 0.5, 0.0, 0.0, -0.5, -0.5]).tolist(), strict=True)) for d in dates[3::9]}
    panel = frame(spark, [(d, n, r) for (d, n), r in returns.items()], "date date, ticker string, r double")
    wanted = frame(spark, [(d, n, w) for d, t in targets.items() for n, w in t.items()], "date date, ticker string, weight double")
    got = backtest.target_weight_backtest(panel, wanted, "r", 10.0).orderBy("date").collect()
    for row, (d, gross, turnover) in zip(got, _literal_backtest(returns, targets, dates, names), strict=True):
        assert row.date == d
        assert row.gross_return == pytest.approx(gross, abs=1e-12)
        assert row.turnover == pytest.approx(turnover, abs=1e-12)
        assert row.net_return == pytest.approx(gross - turnover * 0.001, abs=1e-12)


def test_drift_turnover_on_two_names(spark):
    d = days(3)
    panel = frame(spark, [(x, t, 0.1 if (x, t) == (d[0], "AAA") else 0.0) for x in d for t in ("AAA", "BBB")], "date date, ticker string, r double")
    targets = frame(spark, [(x, t, w) for x in (d[0], d[2]) for t, w in (("AAA", 0.5), ("BBB", -0.5))], "date date, ticker string, weight double")
    got = {r.date: r.turnover for r in backtest.target_weight_backtest(panel, targets, "r").collect()}
    assert got[d[0]] == pytest.approx(1.0)
    assert got[d[2]] == pytest.approx(abs(0.5 - 0.55 / 1.05) + abs(-0.5 + 0.5 / 1.05))


def test_attribution_reconciles_and_marks_missing(spark):
    d = days(3)
    panel = frame(spark, [(d[0], "A", 0.1), (d[0], "B", None), (d[1], "A", -0.1), (d[2], "A", 0.0), (d[2], "B", 0.0)], "date date, ticker string, r double")
    targets = frame(spark, [("P", d[0], "A", 0.5), ("P", d[0], "B", -0.5)], "portfolio string, date date, ticker string, weight double")
    held = backtest.drifted_weights(panel, targets, "r", ("portfolio",))
    security = attribution.security_attribution(held, panel, "r")
    marks = {(r.date, r.ticker): (r.return_record_missing, r.return_value_missing) for r in security.collect()}
    assert marks[d[0], "B"] == (False, True) and marks[d[1], "B"] == (True, False) and marks[d[0], "A"] == (False, False)
    daily = backtest.target_weight_backtest(panel, targets, "r", 10.0, ("portfolio",))
    assert attribution.reconcile(daily, security).first().passes


def test_long_short_uses_previous_target_for_turnover(spark):
    d = days(4)
    panel = frame(spark, [(x, t, 0.1) for x in d for t in "AB"], "date date, ticker string, r double")
    targets = frame(spark, [(d[0], "A", 1.0), (d[0], "B", -1.0), (d[2], "A", 1.0), (d[2], "B", -1.0)], "date date, ticker string, weight double")
    rows = backtest.long_short_backtest(panel, targets, "r").orderBy("date").collect()
    assert [r.turnover for r in rows] == [2.0, 0.0, 0.0, 0.0]
    assert all(abs(r.gross_return) < 1e-12 for r in rows)


def test_drawdown_duration_resets_and_skips_nulls(spark):
    values = [0.0, -0.1, -0.2, 0.0, -0.1, None, -0.3]
    df = frame(spark, list(zip(days(7), values, strict=True)), "date date, drawdown double")
    got = [r.drawdown_duration for r in metrics.add_drawdown_duration(df).orderBy("date").collect()]
    assert got == [0, 1, 2, 0, 1, None, 1]


def test_window_drawdown_starts_at_one(spark):
    df = frame(spark, [([-0.5, 0.5, 0.1],)], "r array<double>")
    assert df.select(metrics.window_drawdown(F.col("r")).alias("m")).first().m == pytest.approx(-0.5)


def test_concentration(spark):
    df = frame(spark, [("P", v) for v in (0.4, 0.3, 0.2, 0.1, 0.0)], "p string, v double")
    r = df.groupBy("p").agg(*metrics.concentration("v", "x")).first()
    assert r.x_count == 4
    assert r.effective_x_count == pytest.approx(1 / (0.16 + 0.09 + 0.04 + 0.01))
    assert r.largest_x_share == pytest.approx(0.4) and r.top_three_x_share == pytest.approx(0.9)


def test_capacity_is_strict_and_ties_go_to_the_first_ticker(spark):
    rows = [("P", 1, 0, DAY, "B", 0.1, 100.0), ("P", 1, 0, DAY, "A", 0.1, 100.0), ("P", 1, 0, days(2)[1], "A", 0.1, None)]
    schema = "portfolio string, rebalance_frequency int, rebalance_offset int, date date, ticker string, absolute_trade_weight double, lagged_adv_21 double"
    out = {r.date: r for r in costs.daily_capacity(frame(spark, rows, schema), (0.01,)).collect()}
    assert out[DAY].capacity_usd == pytest.approx(10.0) and out[DAY].bottleneck_ticker == "A"
    assert out[days(2)[1]].capacity_usd is None and not out[days(2)[1]].fully_covered


def test_market_model_against_least_squares(spark):
    rng = np.random.default_rng(1)
    m = rng.normal(0, 0.01, 80)
    y = 0.0005 + 1.4 * m + rng.normal(0, 0.002, 80)
    df = frame(spark, [(d, "A", float(a), float(b)) for d, a, b in zip(days(80), y, m, strict=True)], "date date, ticker string, ret_1d double, market_return double")
    last = risk.add_market_model(df, 63).orderBy(F.desc("date")).first()
    x = np.column_stack([np.ones(63), m[-63:]])
    coef = np.linalg.lstsq(x, y[-63:], rcond=None)[0]
    assert last.market_model_alpha == pytest.approx(coef[0]) and last.market_model_beta == pytest.approx(coef[1])
    residual = y[-63:] - x @ coef
    assert last.market_model_idio_vol == pytest.approx(residual.std(ddof=1) * math.sqrt(252))


def test_hac_errors_against_matrix_form(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(0, 1, 60)
    y = 1 + 2 * x + rng.normal(0, 1, 60)
    df = frame(spark, [(d, float(a), float(b)) for d, a, b in zip(days(60), y, x, strict=True)], "date date, y double, x double")
    got = regression.hac_ols(df, "y", "x", 5).first()
    design = np.column_stack([np.ones(60), x])
    coef = np.linalg.lstsq(design, y, rcond=None)[0]
    z = design * (y - design @ coef)[:, None]
    s = z.T @ z
    for k in range(1, 6):
        g = z[k:].T @ z[:-k]
        s += (1 - k / 6) * (g + g.T)
    inv = np.linalg.inv(design.T @ design)
    cov = inv @ s @ inv
    assert got.beta == pytest.approx(coef[1]) and got.beta_error == pytest.approx(math.sqrt(cov[1, 1]))
    assert got.alpha_error == pytest.approx(math.sqrt(cov[0, 0]))


def test_flags_warn_strictly_beyond_the_tail(spark):
    rows = [("P", d, float(i)) for i, d in enumerate(days(11))] + [("Q", d, 1.0) for d in days(11)]
    flags = monitoring.historical_flags(frame(spark, rows, "portfolio string, date date, v double"), "portfolio", {"v": ("Market risk", "V", "Higher")}, "Portfolio")
    got = {r.entity: r for r in flags.collect()}
    assert got["P"].status == "WARNING" and got["P"].threshold_value == pytest.approx(9.0)
    assert got["Q"].status == "UNAVAILABLE" and got["Q"].threshold_value is None
    table = {r.entity: r for r in monitoring.overview(flags).collect()}
    assert table["P"].overall_status == "WARNING" and table["P"].market_risk_status == "WARNING" and table["P"].signal_status == "N/A"


def test_inverse_volatility_ignores_the_same_day(spark):
    rng = np.random.default_rng(3)
    rows = [(d, s, float(rng.normal(0, k))) for s, k in (("a", 0.01), ("b", 0.03)) for d in days(60)]
    schema = "date date, sleeve string, value double"
    asked = frame(spark, [(days(60)[50],)], "date date")
    a = portfolio.inverse_volatility_allocations(frame(spark, rows, schema), asked, 30, 20)
    wild = [(d, s, v * (100 if d >= days(60)[50] else 1)) for d, s, v in rows]
    b = portfolio.inverse_volatility_allocations(frame(spark, wild, schema), asked, 30, 20)
    assert a.exceptAll(b).count() == 0
    past = {s: np.std([v for d, x, v in rows if x == s and d < days(60)[50]][-30:], ddof=1) for s in "ab"}
    want = (1 / past["a"]) / (1 / past["a"] + 1 / past["b"])
    assert {r.sleeve: r.allocation for r in a.collect()}["a"] == pytest.approx(want)


def test_pair_weights(spark):
    df = frame(spark, [(0.04, 0.01, 0.0, 0.1, 0.05), (0.01, 0.01, 0.01, 0.0, 0.0)], "va double, vb double, c double, ma double, mb double")
    got = df.select(
        portfolio.minimum_variance_pair(F.col("va"), F.col("vb"), F.col("c")).alias("g"),
        portfolio.maximum_sharpe_pair(F.col("ma"), F.col("mb"), F.col("va"), F.col("vb"), F.col("c")).alias("s"),
        *[x.alias(f"f{i}") for i, x in enumerate(portfolio.floored([F.lit(0.95), F.lit(0.05)], 0.2))],
    ).collect()
    assert got[0].g == pytest.approx(0.2) and got[1].g == 0.5
    assert got[0].s == pytest.approx((0.1 * 0.01) / (0.1 * 0.01 + 0.05 * 0.04))
    assert (got[0].f0, got[0].f1) == (pytest.approx(0.8), pytest.approx(0.2))


def test_quality_tables(spark):
    d = days(2)
    rows = [(d[0], "A", 10.0, 10.0, 5.0), (d[1], "A", 20.0, 11.0, 5.0), (d[0], "B", 10.0, -1.0, 5.0)]
    prices = frame(spark, rows, "date date, ticker string, open double, adj_close double, volume double").withColumn("close", F.col("adj_close"))
    assert quality.non_positive_prices(prices).count() == 1
    assert quality.price_gaps(prices).first().open_gap == pytest.approx(1.0)
    gaps = {r.ticker: r.missing_dates for r in quality.missing_dates(prices).collect()}
    assert gaps == {"A": 0, "B": 1}
    with pytest.raises(ValueError):
        contracts.validate_ohlcv(prices)
    contracts.validate_ohlcv(prices.filter("ticker = 'A'"))


def test_empty_panel(spark):
    empty = frame(spark, [], "date date, ticker string, adj_close double, close double, volume double")
    out = cross_section.process_factors(features.add_raw_factors(features.return_features(empty)), {"mom_3m_raw": "m"})
    assert out.count() == 0
    assert validation.summarise_ic(validation.daily_ic(out, "m_z", "forward_ret_1d")).first().observations == 0


def test_checked_write_and_wide_layout(spark, tmp_path):
    wide = frame(spark, [(DAY, 1.0, 2.0, None, 4.0)], "date date, `adj_close|A` double, `volume|A` double, `adj_close|B` double, `volume|B` double")
    tidy = files.tidy_wide(wide, ["A", "B"], ["adj_close", "volume"])
    assert [tuple(r) for r in tidy.collect()] == [(DAY, "A", 1.0, 2.0)]
    manifest = files.write_checked(tidy, str(tmp_path / "tidy"), ["date", "ticker"]).first()
    assert manifest.rows == 1
    universe = files.normalise_universe(frame(spark, [("BRK.B", "Berk", "Fin")], "Symbol string, Name string, Sector string")).first()
    assert universe.vendor_ticker == "BRK-B"
