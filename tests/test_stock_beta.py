"""The rolling beta in blocks against a literal loop, and how its plan gets its sums."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest

from quantloom.operators import risk

START = dt.date(2020, 1, 6)


def _tables(spark):
    dates = [START + dt.timedelta(days=i) for i in range(23)]
    market = {d: None if i in (3, 11) else 0.25 if 14 <= i < 20 else ((i * 7) % 5 - 2) / 64 for i, d in enumerate(dates)}
    rows = []
    for t in range(3):
        for i, d in enumerate(dates):
            if (i + t) % 6 == 5:
                continue
            rows.append((d, f"T{t}", None if (i * t) % 5 == 4 else 1e6 if i == 1 else ((i * 5 + t) % 7 - 3) / 32))
    return rows, market, spark.createDataFrame(rows, "date date, ticker string, ret_1d double"), spark.createDataFrame(list(market.items()), "date date, market_return double")


def test_beta_is_that_of_every_frame_on_its_own(spark):
    rows, market, panel, series = _tables(spark)
    got = {(r.ticker, r.date): r.beta for r in risk.add_stock_beta(panel, series, window=5, least=3, output="beta").collect()}
    assert len(got) == len(rows)
    known = 0
    for ticker in ("T0", "T1", "T2"):
        own = sorted(r for r in rows if r[1] == ticker)
        for i, (date, _, _) in enumerate(own):
            cells = [(r[2], market[r[0]]) for r in own[max(0, i - 4) : i + 1]]
            pairs = [(y, x) for y, x in cells if y is not None and x is not None]
            ms = [x for _, x in cells if x is not None]
            if len(pairs) < 3 or len(ms) < 3 or len(set(ms)) == 1:
                assert got[ticker, date] is None
                continue
            expected = np.cov(*zip(*pairs, strict=True))[0, 1] / np.var(ms, ddof=1)
            assert got[ticker, date] == pytest.approx(expected, rel=1e-9, abs=1e-9)
            known += 1
    assert known > 20


def test_beta_has_no_frame_of_its_own_for_every_row(spark):
    _, _, panel, series = _tables(spark)
    plan = risk.add_stock_beta(panel, series)._jdf.queryExecution().optimizedPlan().toString()
    assert "RowFrame, -125, currentrow" not in plan
