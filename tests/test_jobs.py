"""Jobs from a CSV of prices to committed groups, and evidence operators by hand."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom import jobs
from quantloom.operators import evidence
from quantloom.plans import workflow
from quantloom.sources.group_commit import read_group, versions

DAY = dt.date(2020, 1, 1)


def day(n):
    return DAY + dt.timedelta(days=n)


@pytest.fixture(scope="module")
def home(spark, tmp_path_factory):
    """Raw prices (CSV), a benchmark and a universe of 12 names over 320 days."""
    folder = tmp_path_factory.mktemp("jobs")
    rng = random.Random(11)
    level, lines = {f"T{i:02d}": 100.0 for i in range(12)}, ["date,ticker,open,close,adj_close,volume"]
    market, price = [], 100.0
    for d in range(320):
        for t in level:
            level[t] *= 1 + rng.gauss(0.0003, 0.02)
            lines.append(f"{day(d)},{t},{level[t]:.6f},{level[t]:.6f},{level[t]:.6f},{rng.randint(1000, 9000)}")
        price *= 1 + rng.gauss(0.0003, 0.01)
        market.append((day(d), price))
    (folder / "prices.csv").write_text("\n".join(lines) + "\n")
    spark.createDataFrame(market, "date date, adj_close double").write.parquet(f"file://{folder}/benchmark")
    names = [(t, t, ("A", "B", "C")[i % 3]) for i, t in enumerate(level)]
    spark.createDataFrame(names, "ticker string, name string, sector string").write.parquet(f"file://{folder}/universe")
    jobs.ingest(spark, f"file://{folder}/prices.csv", f"file://{folder}/prices")
    return f"file://{folder}", folder


def test_ingest(spark, home):
    path, folder = home
    prices = spark.read.parquet(f"{path}/prices")
    assert prices.count() == 12 * 320 and dict(prices.dtypes)["volume"] == "double"
    text = (folder / "prices.csv").read_text().splitlines()
    for bad, why in (("2020-01-01,T99,1,1,-5,1", "adj_close is not above 0"), ("2020-01-01,T99,1,1,x,1", "adj_close is no number"), ("2020-01-01,,1,1,1,1", "a key is missing")):
        (folder / "bad.csv").write_text("\n".join([text[0], bad]) + "\n")
        with pytest.raises(Exception, match=why):
            jobs.ingest(spark, f"{path}/bad.csv", f"{path}/bad")


def test_panels_and_backtests(spark, home):
    path, _ = home
    assert jobs.build_returns(spark, f"{path}/prices", f"{path}/returns").first()["rows"] == 12 * 320
    jobs.build_processed(spark, f"{path}/prices", f"{path}/universe", f"{path}/processed")
    coverage = {r.factor: r.coverage for r in jobs.build_factors(spark, f"{path}/processed", f"{path}/benchmark", f"{path}/factors").collect()}
    assert math.isclose(coverage["mom_12_1m_raw"], (320 - 252) / 320) and math.isclose(coverage["mom_3m_raw"], (320 - 63) / 320)
    out = jobs.run_backtests(spark, f"{path}/factors", f"{path}/runs", {"Mom 3M": "mom_3m_z", "rev-1m": "reversal_1m_z"}, least=10)
    assert {r.factor for r in out.collect()} == {"mom_3m", "rev_1m"}
    daily = spark.read.parquet(f"{path}/runs/daily")
    assert daily.filter("factor = 'mom_3m' and gross_exposure > 1.9").count() > 200 and spark.read.parquet(f"{path}/runs/holdings").count() > 0


def test_report(spark, home, tmp_path):
    names = jobs.dump_report(spark, f"{home[0]}/prices", f"{home[0]}/benchmark", f"{home[0]}/universe", f"file://{tmp_path}")
    assert len(names) >= 8 and all(any((tmp_path / n).glob("*.csv")) for n in names)


def test_refresh_is_dry_and_then_writes_both_groups(spark, home, monkeypatch):
    path, _ = home
    args = [spark, f"{path}/prices", f"{path}/benchmark", f"{path}/universe", f"{path}/groups"]
    made = workflow.complete_refresh(*[spark.read.parquet(p) for p in args[1:4]], least=10)
    monkeypatch.setattr(workflow, "complete_refresh", lambda *_, **__: made)
    first = jobs.refresh(*args, least=10)
    assert {(r.group, r.kind) for r in first.collect()} == {("attribution", "new_group"), ("monitoring", "new_group")}
    assert not versions(spark, f"{path}/groups/attribution")
    jobs.refresh(*args, write=True, least=10)
    assert jobs.refresh(*args, write=True, least=10, tolerance=1e-9).count() == 0
    assert [v.number for v in versions(spark, f"{path}/groups/attribution")] == [1]
    data = read_group(spark, f"{path}/groups/monitoring")
    assert set(data) == set(jobs.MONITORING) and data["latest_overview"].filter("entity_type = 'Portfolio'").count() == 3
    # The monitoring group can be made again from the attribution group alone.
    out = jobs.rebuild_monitoring(spark, f"{path}/factors", f"{path}/benchmark", f"{path}/universe", f"{path}/groups")
    assert out.count() == len(jobs.MONITORING) and versions(spark, f"{path}/groups/monitoring")[-1].number == 2


def test_a_group_that_does_not_reconcile_is_not_committed(spark):
    with pytest.raises(ValueError, match="does not reconcile"):
        jobs.check_attribution({"reconciliation": spark.createDataFrame([("P", False), ("Q", True)], "portfolio string, passes boolean")})


def test_arguments():
    for bad in ([], ["refresh"], ["nothing"]):
        with pytest.raises(SystemExit):
            jobs.main(bad)


def test_frozen_strategies(spark):
    fixed = workflow.strategies_frame(spark)
    workflow.require_frozen(fixed.orderBy(F.desc("portfolio")))
    with pytest.raises(ValueError, match="rebalance_frequency"):
        workflow.require_frozen(fixed.withColumn("rebalance_frequency", F.col("rebalance_frequency") + 1))


# --- evidence -----------------------------------------------------------------------------


def test_rolling_growth(spark):
    rng = random.Random(1)
    values = [rng.gauss(0, 0.01) for _ in range(40)]
    out = evidence.rolling_growth(spark.createDataFrame([(day(i), v) for i, v in enumerate(values)], "date date, r double"), "r", (), 10).orderBy("date").collect()
    assert out[8].annualised_return_10 is None
    growth = np.prod([1 + v for v in values[5:15]]) ** (252 / 10) - 1
    sd = np.std(values[5:15], ddof=1) * 252**0.5
    assert np.allclose([out[14].annualised_return_10, out[14].growth_ratio_10], [growth, growth / sd])
    for bad in ({"window": 0}, {"periods": -1}):
        with pytest.raises(ValueError):
            evidence.rolling_growth(spark.createDataFrame([], "date date, r double"), "r", **bad)


def test_one_to_one_and_scorecard(spark):
    a = spark.createDataFrame([("P", 0.2), ("Q", 0.1)], "portfolio string, annualised_return double")
    b = spark.createDataFrame([("P", 0.15)], "portfolio string, mean_annualised_return double")
    got = {r.portfolio: r.headline_minus_mean_return for r in evidence.scorecard(a, b).collect()}
    assert math.isclose(got["P"], 0.05) and got["Q"] is None
    for x, y in ((a.unionByName(a), b), (a, b.unionByName(b))):
        with pytest.raises(Exception, match="a key occurs twice"):
            evidence.scorecard(x, y).collect()


def test_chosen_schedules_and_snapshots(spark):
    rows = spark.createDataFrame([(p, f) for p in "ABC" for f in (5, 10)], "portfolio string, frequency int")
    assert {(r.portfolio, r.frequency) for r in evidence.chosen_schedules(rows, {"A": 5, "B": 10}).collect()} == {("A", 5), ("B", 10)}
    beta = spark.createDataFrame([("A", day(0), 1.0), ("A", day(1), 2.0)], "portfolio string, date date, beta double")
    assert evidence.risk_snapshot(beta, beta.withColumnRenamed("beta", "x")).first().latest_date == day(1)
    with pytest.raises(Exception, match="latest dates differ"):
        evidence.risk_snapshot(beta, beta.withColumnRenamed("beta", "x").filter("x < 2")).collect()
