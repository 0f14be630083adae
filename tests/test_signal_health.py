"""Signal health against a literal loop, and how often its plan moves the rows."""

from __future__ import annotations

import datetime as dt
import re

import numpy as np
import pytest

from quantloom.operators import validation

START = dt.date(2020, 1, 6)
FACTORS = {"a": ("a_z", "a_raw"), "b": ("b_z", "b_raw")}


def _panel(spark):
    """12 dates of 8 tickers with gaps, ties and nulls."""
    rows = []
    for day in range(12):
        for t in range(8):
            if (day * 5 + t * 3) % 11 == 0:
                continue
            a = None if (day + t) % 7 == 0 else float((day * t * 13 + t) % 5)
            forward = None if (day * t) % 9 == 4 else float((day + 7 * t) % 6)
            rows.append((START + dt.timedelta(days=7 * day), f"T{t}", forward, a, None if a is None else a * 10, float((t * day) % 4), float(t)))
    schema = "date date, ticker string, fwd double, a_z double, a_raw double, b_z double, b_raw double"
    return rows, spark.createDataFrame(rows, schema).repartition(5)


def _ranks(values):
    return [sum(v < x for v in values) + (sum(v == x for v in values) + 1) / 2 for x in values]


def _spearman(pairs, least):
    pairs = [(x, y) for x, y in pairs if x is not None and y is not None]
    if len(pairs) < least:
        return None
    x, y = (np.array(_ranks(side)) for side in zip(*pairs, strict=True))
    return float(np.corrcoef(x, y)[0, 1]) if x.std() > 0 and y.std() > 0 else None


def test_signal_health_is_that_of_a_literal_loop(spark):
    rows, panel = _panel(spark)
    got = {(r.factor, r.date): r for r in validation.signal_health(panel, FACTORS, "fwd", least=3, window=4, need=2, lags=(1, 3)).collect()}
    dates = sorted({r[0] for r in rows})
    assert len(got) == 2 * len(dates)
    for factor, at in (("a", 3), ("b", 5)):
        score = {(r[0], r[1]): r[at] for r in rows}
        valid = []
        for i, date in enumerate(dates):
            own, r = [x for x in rows if x[0] == date], got[factor, date]
            assert (r.universe_observations, r.signal_observations) == (len(own), sum(x[at] is not None for x in own))
            assert r.paired_observations == sum(x[at] is not None and x[2] is not None for x in own)
            raw = [x[at + 1] for x in own if x[at + 1] is not None]
            assert [r.q25_raw, r.median_raw, r.q75_raw] == pytest.approx(np.quantile(raw, [0.25, 0.5, 0.75]).tolist())
            ic = _spearman([(x[at], x[2]) for x in own], 3)
            valid += [] if ic is None else [ic]
            assert r.daily_ic == (None if ic is None else pytest.approx(ic))
            mean = None if ic is None or len(valid) < 2 else pytest.approx(np.mean(valid[-4:]))
            assert r.rolling_mean_ic_4 == mean
            for lag in (1, 3):
                past = [(x[at], score.get((dates[i - lag], x[1])) if i >= lag else None) for x in own]
                known = _spearman(past, 3)
                assert r[f"rank_stability_{lag}"] == (None if known is None else pytest.approx(known))


def test_signal_health_moves_rows_by_ticker_once_and_by_date_once(spark):
    """Rows of all factors and lags share one shuffle each way; the rest moves a row per date.

    Counted without the broadcast of small tables, which would hide joins of large ones.
    """
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = validation.signal_health(_panel(spark)[1], FACTORS, "fwd")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
    assert len(re.findall(r"Exchange hashpartitioning\(ticker", plan)) == 1
    assert len(re.findall(r"Exchange \S*\(_slot", plan)) == 1
