"""Interval joins against pairs by hand, events and attribution by loops, robust errors against matrices."""

import datetime as dt
import random

import numpy as np
import pytest

from quantloom.operators import linear, stress

DAY = dt.date(2020, 1, 1)


def day(n):
    return None if n is None else DAY + dt.timedelta(days=n)


@pytest.mark.parametrize("bin", ["week", "month", "quarter", "year"])
def test_interval_join(spark, bin):
    rng = random.Random(4)
    rows = [(i, rng.choice("ab"), day(rng.choice([None, *range(800)]))) for i in range(200)]
    spans = [(k, rng.choice("ab"), day(rng.choice([None, *range(800)])), day(rng.choice([None, *range(800)]))) for k in range(40)]
    last = max(d for *_, d in rows if d)
    want = sorted((i, n) for i, k, d in rows for n, q, a, b in spans if k == q and d and a and a <= d <= (b or last))
    got = stress.interval_join(spark.createDataFrame(rows, "i int, k string, date date"), spark.createDataFrame(spans, "n int, k string, a date, b date"), "a", "b", keys=["k"], bin=bin)
    assert sorted((r.i, r.n) for r in got.collect()) == want and "Cartesian" not in got._jdf.queryExecution().toString()


def test_interval_join_arguments(spark):
    a = spark.createDataFrame([], "date date, n int")
    for bad in ({"bin": "day"}, {"on": "x"}, {}):
        with pytest.raises(ValueError):
            stress.interval_join(a, spark.createDataFrame([], "a date, b date, n int"), "a", "b", **bad)


def literal_events(returns):
    wealth = peak = 1.0
    out, run = [], []
    for d, r in returns:
        before = d - dt.timedelta(days=1)
        wealth *= 1 + r
        peak = max(peak, wealth)
        if wealth / peak - 1 < 0:
            run.append((wealth / peak - 1, d, before))
        elif run:
            out.append((run, d))
            run = []
    if run:
        out.append((run, None))
    return [(r[0][2] if r[0][2] >= returns[0][0] else None, r[0][1], min(r)[1], after, min(r)[0], sum(x[1] <= min(r)[1] for x in r)) for r, after in out]


def test_events(spark):
    rng = random.Random(9)
    returns = [(day(i), rng.gauss(-0.001, 0.02)) for i in range(300)]
    df = spark.createDataFrame(returns, "date date, r double")
    got = stress.drawdown_events(df, "r").orderBy("event").collect()
    want = sorted(literal_events(returns), key=lambda e: e[2])
    assert [(r.peak_date, r.stress_start_date, r.trough_date, r.recovery_date, r.rows_to_trough) for r in got] == [(a, b, c, d, n) for a, b, c, d, _, n in want]
    assert np.allclose([r.drawdown for r in got], [e[4] for e in want]) and [r.recovered for r in got] == [e[3] is not None for e in want]
    deep = stress.drawdown_events(df, "r", count=3).collect()
    assert {r.trough_date for r in deep} == {e[2] for e in sorted(want, key=lambda e: e[4])[:3]} and sorted(r.event for r in deep) == [1, 2, 3]
    assert stress.drawdown_events(df.limit(0), "r").count() == 0


def test_attribution_of_overlapping_events(spark):
    rng = random.Random(2)
    days = [(p, day(i), *(x := [rng.gauss(0, 0.01) for _ in range(2)]), sum(x), 0.001, sum(x) - 0.001) for p in "AB" for i in range(100)]
    daily = spark.createDataFrame(days, "portfolio string, date date, long_return double, short_return double, gross_return double, transaction_cost double, net_return double")
    market = spark.createDataFrame([(day(i), rng.gauss(0, 0.01)) for i in range(100)], "date date, market_return double")
    spans = [(1, None, day(5), day(40), -0.1), (2, day(4), day(30), day(35), -0.2), (3, day(98), day(99), day(120), -0.05)]
    events = spark.createDataFrame(spans, "event int, peak_date date, stress_start_date date, trough_date date, drawdown double")
    out = stress.stress_attribution(daily, market, events)
    got = {(r.event, r.portfolio): r for r in out.collect()}
    m = {r.date: r.market_return for r in market.collect()}
    for e, _, a, b, _ in spans:
        for p in "AB":
            own = [d for d in days if d[0] == p and a <= d[1] <= b]
            r = got[e, p]
            net, bench = np.prod([1 + d[6] for d in own]) - 1, np.prod([1 + m[d[1]] for d in own]) - 1
            assert r.observations == len(own) and r.reconciles
            assert np.allclose([r.cumulative_long_contribution, r.cumulative_transaction_cost, r.compounded_net_return, r.net_minus_benchmark_return], [sum(d[2] for d in own), 0.001 * len(own), net, net - bench])
            assert r.outperformed_benchmark == (net > bench) and r.short_side_profitable == (sum(d[3] for d in own) > 0)
    total = {r.portfolio: r for r in stress.summarise_stress(out).collect()}
    assert total["A"].event_count == 3 and np.isclose(total["A"].average_benchmark_drawdown, -0.35 / 3)


def test_security_stress_shares(spark):
    rows = [("A", day(i), t, s, v, 0.0, v) for i in range(10) for t, s, v in (("x", "Long", -0.02), ("y", "Short", -0.01), ("z", "Long", 0.05))]
    security = spark.createDataFrame(rows, "portfolio string, date date, ticker string, side string, gross_return_contribution double, transaction_cost_contribution double, net_return_contribution double")
    events = spark.createDataFrame([("A", 1, day(2), day(4)), ("A", 2, day(4), day(5)), ("B", 1, day(0), day(9))], "portfolio string, event int, stress_start_date date, trough_date date")
    got = {(r.event, r.ticker): (r.days, r.short_days, round(r.net_contribution, 9), round(r.loss_share, 9)) for r in stress.security_stress(security, events).collect()}
    assert got == {(e, t): (n, n if t == "y" else 0, round(v * n, 9), s) for e, n in ((1, 3), (2, 2)) for t, v, s in (("x", -0.02, round(2 / 3, 9)), ("y", -0.01, round(1 / 3, 9)), ("z", 0.05, 0.0))}


# --- regressions ------------------------------------------------------------------------


def by_matrices(y, x, lags):
    """Estimates, covariance and R squared in matrix form."""
    x = np.column_stack([np.ones(len(y)), x])
    inv = np.linalg.inv(x.T @ x)
    b = inv @ x.T @ y
    u = y - x @ b
    s = x * u[:, None]
    middle = s.T @ s
    for k in range(1, lags + 1):
        g = s[k:].T @ s[:-k]
        middle += (1 - k / (lags + 1)) * (g + g.T)
    return b, inv @ middle @ inv, 1 - (u @ u) / ((y - y.mean()) ** 2).sum()


@pytest.mark.parametrize(("k", "lags"), [(1, 5), (2, 5), (3, 0), (4, 8)])
def test_hac_against_matrices(spark, k, lags):
    rng = np.random.default_rng(k)
    data, want = [], {}
    for key in ("a", "b", None)[: 2 + (k == 2)]:
        x = rng.normal(0, 0.01, (120, k))
        y = x @ rng.normal(1, 1, k) + np.convolve(rng.normal(0, 0.01, 124), np.ones(5) / 5, "valid")
        data += [(key, day(i), float(y[i]), *map(float, x[i])) for i in range(120)]
        want[key] = by_matrices(y, x, lags)
    data += [("a", day(200), None, *[0.0] * k), ("a", day(60), 9.0, *[None] * k)]
    xs = [f"x{i}" for i in range(k)]
    df = spark.createDataFrame(data, "key string, date date, y double, " + ", ".join(f"{x} double" for x in xs))
    contrast = {"sum": dict.fromkeys(xs, 1.0)}
    rows = linear.hac_fit(df, "y", xs, lags, ["key"], contrast, {"sum": 1.0, "x0": 1.0}).collect()
    for key, (b, v, r2) in want.items():
        if key is None:
            continue
        own = {r.term: r for r in rows if r.key == key}
        ones = np.array([0.0] + [1.0] * k)
        for name, w, null in [("const", np.eye(k + 1)[0], 0.0), *[(x, np.eye(k + 1)[i + 1], float(i == 0)) for i, x in enumerate(xs)], ("sum", ones, 1.0)]:
            error = np.sqrt(w @ v @ w)
            assert np.allclose([own[name].estimate, own[name].error, own[name].t], [w @ b, error, (w @ b - null) / error])
        assert np.isclose(own["const"].r_squared, r2) and own["const"].observations == 120


def test_dependent_columns_give_nulls(spark):
    df = spark.createDataFrame([(day(i), float(i), float(i % 7), 2.0 * (i % 7)) for i in range(30)], "date date, y double, a double, b double")
    assert {(r.estimate, r.error, r.t) for r in linear.hac_fit(df, "y", ["a", "b"]).collect()} == {(None, None, None)}
    assert linear.hac_fit(df.limit(0), "y", ["a"]).filter("estimate is not null").count() == 0
    for bad in ({"lags": -1}, {"nulls": {"c": 1.0}}, {"contrasts": {"s": {"c": 1.0}}}):
        with pytest.raises(ValueError):
            linear.hac_fit(df, "y", ["a"], **bad)


def test_asymmetric_beta(spark):
    rng = np.random.default_rng(7)
    m = rng.normal(0, 0.01, 200)
    y = 0.5 * m + 0.4 * np.minimum(m, 0) + rng.normal(0, 0.002, 200)
    b, v, r2 = by_matrices(y, np.column_stack([m, np.minimum(m, 0)]), 5)
    df = spark.createDataFrame([("P", day(i), float(y[i]), float(m[i])) for i in range(200)], "portfolio string, date date, y double, m double")
    r = linear.asymmetric_beta(df, "y", "m", 5, ["portfolio"]).first()
    down = v[1, 1] + v[2, 2] + 2 * v[1, 2]
    want = [b[1], b[1] + b[2], b[2], b[2] / v[2, 2] ** 0.5, (b[1] - 1) / v[1, 1] ** 0.5, (b[1] + b[2] - 1) / down**0.5, r2, b[0] / v[0, 0] ** 0.5]
    got = [r.upside_market_beta, r.downside_market_beta, r.downside_minus_upside_beta, r.beta_asymmetry_hac_t_stat, r.upside_beta_minus_one_hac_t_stat, r.downside_beta_minus_one_hac_t_stat, r.r_squared, r.alpha_hac_t_stat]
    assert np.allclose(got, want)
