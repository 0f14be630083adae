"""The grid against one backtest per schedule, betting against beta and diagnoses by hand."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom.operators import backtest, beta_books, grid

DAY = dt.date(2020, 1, 1)


def day(n):
    return DAY + dt.timedelta(days=n)


@pytest.fixture(scope="module")
def market(spark):
    rng = random.Random(17)
    rows = []
    for t in range(12):
        for i in range(60):
            if rng.random() < 0.93:
                rows.append((day(i), f"T{t}", None if rng.random() < 0.05 else -1.0 if (t, i) == (3, 20) else rng.gauss(0.001, 0.03)))
    rows.append((day(60), "T1", None))  # Not a usable date.
    targets = []
    for i in range(60):
        if i in (7, 30):
            continue  # Rebalances into cash.
        for book in ("A", "B"):
            names = rng.sample(range(12), 6)
            weights = [0.4, 0.3, 0.3, -0.4, -0.3, -0.3] if book == "A" else [0.3, 0.1, 0.1, 0.0, -0.05, -0.05]
            targets += [(book, day(i), f"T{n}", w) for n, w in zip(names, weights, strict=True)]
    panel = spark.createDataFrame(rows, "date date, ticker string, r double").cache()
    return panel, spark.createDataFrame(targets, "book string, date date, ticker string, weight double").cache()


def test_grid_equals_single_backtests(spark, market):
    panel, targets = market
    frequencies, costs = (1, 4, 7), (0.0, 25.0)
    got = {}
    for r in grid.grid_backtests(panel, targets, "r", frequencies, costs).collect():
        got[r.book, r.frequency, r.offset, r.cost_bps, r.date] = r
    dates = sorted({r.date for r in panel.filter("r is not null").select("date").collect()})
    columns = ["long_return", "short_return", "gross_return", "net_return", "turnover", "transaction_cost", "long_exposure", "short_exposure", "missing_return_weight", "net_cumulative_return"]
    seen = 0
    for f in frequencies:
        for o in {0, f - 1, f // 2}:
            chosen = spark.createDataFrame([(d,) for i, d in enumerate(dates) if i >= o and (i - o) % f == 0], "date date")
            # The single backtest knows a rebalance into cash by a row of weight 0.
            cash = chosen.crossJoin(targets.select("book").distinct()).select("book", "date", F.lit("T0").alias("ticker"), F.lit(0.0).alias("weight"))
            own = targets.join(chosen, "date").select("book", "date", "ticker", "weight").unionByName(cash)
            want = backtest.target_weight_backtest(panel, own, "r", 25.0, ("book",)).collect()
            for w in want:
                g = got[w.book, f, o, 25.0, w.date]
                assert np.allclose([g[c] for c in columns], [w[c] for c in columns], atol=1e-12), (f, o, w, g)
                assert g.is_rebalance == w.is_rebalance
                seen += 1
    assert seen == 2 * 60 * (1 + 3 + 3) and len(got) == 2 * 2 * 60 * (1 + 4 + 7)


def test_a_worthless_book_stops_the_run(spark):
    panel = spark.createDataFrame([(day(i), t, -0.9 if t == "x" else 1.5) for i in range(4) for t in "xy"], "date date, ticker string, r double")
    targets = spark.createDataFrame([("A", day(0), "x", 1.0), ("A", day(0), "y", -1.0)], "book string, date date, ticker string, weight double")
    with pytest.raises(Exception, match="is worth nothing"):
        grid.grid_backtests(panel, targets, "r", [4]).collect()


def test_schedules_do_not_multiply_the_names(market):
    """Rows of names do not grow with the number of schedules: one expansion feeds all of them."""
    panel, targets = market
    plan = grid.grid_backtests(panel, targets, "r", (1, 5, 10, 21), (0, 5, 10))._jdf.queryExecution().optimizedPlan().toString()
    assert "Cartesian" not in plan
    held = grid._held(targets, grid.usable_dates(panel, "r"), grid.growth_paths(panel, "r", 21))
    assert grid.segment_sums(held).count() <= 2 * 60 * 22


@pytest.mark.parametrize("bad", [{"frequencies": []}, {"frequencies": [0]}, {"frequencies": [5], "costs": [-1]}])
def test_bad_grids(market, bad):
    with pytest.raises(ValueError):
        grid.grid_backtests(*market, "r", **bad)


def test_summaries(market):
    panel, targets = market
    rows = grid.grid_summary(grid.grid_backtests(panel, targets, "r", (1, 3), (0.0, 10.0), offsets=(0, 1)))
    assert rows.count() == 2 * 3 * 2
    spread = grid.across_offsets(rows).filter("frequency = 3 and cost_bps = 0").collect()
    assert all(r.offsets == 2 and r.min_sharpe_ratio <= r.mean_sharpe_ratio <= r.max_sharpe_ratio for r in spread)


def test_blends(spark):
    sleeves = spark.createDataFrame([("M", day(0), "x", 1.0), ("V", day(0), "x", 0.5), ("V", day(1), "y", 1.0)], "sleeve string, date date, ticker string, weight double")
    shares = spark.createDataFrame([(day(0), 0.8)], "date date, allocation double")
    got = {(r.book, r.ticker): round(r.weight, 9) for r in grid.intensity_blends(sleeves, shares, (0, 0.5, 1), "M", "V").collect()}
    assert got == {("intensity 0", "x"): 0.75, ("intensity 0.5", "x"): 0.825, ("intensity 1", "x"): 0.9, ("intensity 0", "y"): 0.5, ("intensity 0.5", "y"): 0.5, ("intensity 1", "y"): 0.5}


# --- betting against beta -------------------------------------------------------------------


def test_legs_and_multipliers(spark):
    rows = [(day(0), f"T{i}", 0.1 * i, 0.01 * i) for i in range(1, 11)] + [(day(1), "T1", 0.5, None), (day(1), "T2", 1.5, 0.1), (day(2), "T1", None, 0.1)]
    legs = beta_books.beta_legs(spark.createDataFrame(rows, "date date, ticker string, beta_126 double, forward_ret_1d double"))
    r = legs.collect()
    assert len(r) == 1 and np.allclose([r[0].low_beta, r[0].high_beta, r[0].low_return, r[0].high_return], [0.15, 0.95, 0.015, 0.095]) and (r[0].low_count, r[0].high_count) == (2, 2)
    rf = spark.createDataFrame([(day(0), 0.001)], "date date, risk_free_rate double")
    b = beta_books.betting_against_beta(legs, rf).first()
    low, high = 1 / (0.6 * 0.15 + 0.4), 1 / (0.6 * 0.95 + 0.4)
    scale = 3 / (low + high)
    assert b.is_capped and np.isclose(b.gross_exposure, 3.0) and abs(b.shrunk_net_beta) < 1e-12
    assert np.isclose(b.bab_return, scale * (low * 0.014 - high * 0.094)) and np.isclose(b.bab_uncapped_return, low * 0.014 - high * 0.094)
    assert np.isclose(b.estimated_net_beta, scale * (low * 0.15 - high * 0.95))
    wide = beta_books.betting_against_beta(legs, rf, largest=10).first()
    assert not wide.is_capped and wide.bab_return == wide.bab_uncapped_return
    assert beta_books.cap_effect(beta_books.betting_against_beta(legs, rf)).first().capped_fraction == 1.0


def test_betas_that_stay_negative_have_no_return(spark):
    legs = spark.createDataFrame([(day(0), 0.01, -2.0, 1, 0.02, 1.0, 1)], "date date, low_return double, low_beta double, low_count long, high_return double, high_beta double, high_count long")
    b = beta_books.betting_against_beta(legs, spark.createDataFrame([(day(0), 0.0)], "date date, risk_free_rate double")).first()
    assert b.bab_return is None and b.gross_exposure is None


# --- diagnosis ----------------------------------------------------------------------------


def test_forward_diagnosis(spark):
    rng = random.Random(6)
    days = [(day(i), None if i == 4 else rng.gauss(0, 0.01), rng.gauss(0, 0.01)) for i in range(30)]
    allocations = [(day(2), 0.7, 0.3, 0.02, 0.01), (day(9), 1.0, 0.0, 0.01, 0.03), (day(20), 0.5, 0.5, 0.0, 0.0), (day(40), 0.2, 0.8, 0.1, 0.2)]
    a = spark.createDataFrame(allocations, "date date, weight_a double, weight_b double, estimate_a double, estimate_b double")
    detail = beta_books.forward_diagnosis(a, spark.createDataFrame(days, "date date, a double, b double"))
    got = {r.date: r for r in detail.collect()}
    edges = [x[0] for x in allocations] + [day(99)]
    hits, wins, total, n = [], [], [], 0
    for (d, wa, wb, ea, eb), end in zip(allocations, edges[1:], strict=True):
        own = [x for x in days if d <= x[0] < end and None not in x]
        r = got[d]
        assert r.forward_observations == len(own)
        if not own:
            assert r.period_return is None and r.rank_hit is None
            continue
        ra, rb = (np.prod([1 + x[k] for x in own]) - 1 for k in (1, 2))
        mix = np.prod([1 + wa * x[1] + wb * x[2] for x in own]) - 1
        even = np.prod([1 + (x[1] + x[2]) / 2 for x in own]) - 1
        assert np.allclose([r.realised_a, r.realised_b, r.period_return, r.return_difference], [ra, rb, mix, mix - even])
        hit = None if abs(ea - eb) <= 1e-12 else int((ea - eb) * (ra - rb) > 0)
        win = None if abs(wa - wb) <= 1e-12 else int((wa - wb) * (ra - rb) > 0)
        assert (r.rank_hit, r.allocated_sleeve_won, r.is_boundary) == (hit, win, min(wa, wb) == 0)
        hits, wins, total, n = hits + [hit] * (hit is not None), wins + [win] * (win is not None), [*total, mix], n + len(own)
    s = beta_books.summarise_diagnosis(detail).first()
    assert np.isclose(s.rank_hit_rate, np.mean(hits)) and np.isclose(s.higher_weight_win_rate, np.mean(wins)) and s.allocations == 4 and s.boundary_fraction == 0.25
    assert np.isclose(s.annualised_return, np.prod([1 + x for x in total]) ** (252 / n) - 1)
