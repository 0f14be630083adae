"""Targets of the strategies carry only what they read, and dates are no reason to shuffle a panel."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quantloom.operators import portfolio
from quantloom.plans import registry as base
from quantloom.plans import workflow

SOURCE = "/root/testdata/sf0.01"
READ = {"date", "ticker", "forward_ret_1d", "mom_12_1m_z", "realised_vol_63_z"}


def test_no_factor_panel_is_made_for_the_strategies(spark, monkeypatch):
    seen, real = [], workflow.strategy_targets

    def again(*_):
        pytest.fail("made, though no strategy reads it")

    monkeypatch.setattr(base, "_factor_panel", again)
    monkeypatch.setattr(workflow, "factor_panel", again)
    monkeypatch.setattr(workflow, "strategy_targets", lambda panel, *a, **k: seen.append(set(panel.columns)) or real(panel, *a, **k))
    got = base.queries()["strategy_targets"](spark, SOURCE)
    assert seen == [READ]
    assert {r.portfolio for r in got.select("portfolio").distinct().collect()} == {s.name for s in workflow.STRATEGIES}


def test_targets_are_those_of_the_factor_panel(spark):
    got = base.queries()["strategy_targets"](spark, SOURCE)
    panel = base._factor_panel(spark, SOURCE)
    whole = workflow.strategy_targets(panel).select("portfolio", "date", "ticker", (F.round("weight", 6) + F.lit(0.0)).alias("weight"))
    assert got.count() == whole.count() > 0
    assert got.exceptAll(whole).isEmpty() and got.filter("weight <> 0").count() > 0


def test_other_columns_are_not_carried(spark, monkeypatch):
    monkeypatch.setattr(base, "once", lambda *args: args[-1]())  # the plan itself, nothing written
    scores = base._scores(spark, SOURCE)
    plan = scores._jdf.queryExecution().optimizedPlan().toString()
    assert set(scores.columns) == READ
    assert not [c for c in ("rank(", "sum(l_quantity", "sum(l_extendedprice", "mom_3m_raw", "ret_5d") if c in plan]


def test_rebalance_dates_are_sent_to_the_panel(spark):
    rows = [(dt.date(2020, 1, 6) + dt.timedelta(weeks=w), f"T{t}", float(t), 0.01) for w in range(6) for t in range(10)]
    panel = spark.createDataFrame(rows, "date date, ticker string, f double, r double")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for a table above the broadcast size
    try:
        targets = portfolio.factor_targets(panel, "f", "r", 2, least=10)
        plan = targets._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        dates = {r.date for r in targets.select("date").distinct().collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert dates == {dt.date(2020, 1, 6) + dt.timedelta(weeks=w) for w in (0, 2, 4)}
