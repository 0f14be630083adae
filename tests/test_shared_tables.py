"""Tables that are made from other shared ones, and what the flags of all portfolios read."""

import pytest

from quantloom.functions.stats import average_rank
from quantloom.operators import backtest, monitoring
from quantloom.plans import registry as base
from quantloom.plans import workflow

DIR = "/root/testdata/sf0.001"


def test_holdings_read_returns_from_the_processed_table(spark, monkeypatch):
    base._targets(spark, DIR)

    def again(*_):
        pytest.fail("made anew from prices or targets")

    monkeypatch.setattr(base, "_returns", again)
    monkeypatch.setattr(backtest, "target_weight_backtest", again)
    for make in (base._holdings, base._daily, base._security):
        assert make(spark, DIR).columns


def test_flags_of_all_portfolios_read_the_shared_tables(spark, monkeypatch):
    """One processed table and one set of targets serve them; what no flag reads is not made."""

    def again(*_, **__):
        pytest.fail("made, though no flag reads it or a shared table has it")

    for module, name in ((base, "_factor_panel"), (workflow, "factor_panel"), (workflow, "attribution_datasets"), (workflow, "monitoring_datasets")):
        monkeypatch.setattr(module, name, again)
    flags = base._flags(spark, DIR)
    assert {r.entity for r in flags.select("entity").distinct().collect()} >= set(base.HEALTH)
    assert flags.count() == flags.select(*monitoring.KEY).distinct().count()


def test_liquidity_is_looked_up_once(spark, monkeypatch):
    calls, real = [], monitoring.add_lagged_dollar_volume
    monkeypatch.setattr(monitoring, "add_lagged_dollar_volume", lambda *a, **k: calls.append(1) or real(*a, **k))
    folder = f"{DIR}/."  # a folder of its own name, whose tables are not there yet
    assert base.queries()["liquidity_coverage"](spark, folder).count() == base.queries()["implementation_state"](spark, folder).count()
    assert len(calls) == 1


def test_a_rank_needs_one_window(spark):
    rows = [("a", 1.0), ("a", 3.0), ("a", 3.0), ("a", None), ("b", 2.0), ("b", 2.0), ("b", 2.0), ("a", 5.0)]
    df = spark.createDataFrame(rows, "k string, v double").withColumn("rank", average_rank("v", ("k",)))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("Window [") == 1
    assert sorted((r.k, r.v or 0.0, r.rank) for r in df.collect()) == [
        ("a", 0.0, None), ("a", 1.0, 1.0), ("a", 3.0, 2.5), ("a", 3.0, 2.5), ("a", 5.0, 4.0), ("b", 2.0, 2.0), ("b", 2.0, 2.0), ("b", 2.0, 2.0),
    ]
