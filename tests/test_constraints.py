"""Constraints ride on the plan: bad input stops each operator's own job, and plans have no more scans or shuffles."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quantloom.operators import backtest, constraints, costs, features, monitoring, portfolio, risk

DAY = dt.date(2020, 1, 1)


def day(n):
    return DAY + dt.timedelta(days=n)


@pytest.fixture
def panel(spark):
    rows = [(day(i), t, 100.0 + i, 100.0, 10.0, 0.01 * (i % 3 - 1)) for i in range(8) for t in "xyz"]
    return spark.createDataFrame(rows, "date date, ticker string, adj_close double, close double, volume double, r double")


@pytest.fixture
def targets(spark):
    return spark.createDataFrame([(day(i), t, w) for i in (0, 4) for t, w in (("x", 0.6), ("y", 0.4), ("z", -0.5))], "date date, ticker string, weight double")


def stops(df, message):
    with pytest.raises(Exception, match=message):
        df.collect()


def test_enforce_names_rule_and_row(spark, panel):
    bad = panel.withColumn("r", F.when((F.col("ticker") == "y") & (F.col("date") == day(3)), float("nan")).otherwise(F.col("r")))
    rules = {"r is finite": constraints.finite("r"), "r is small": F.col("r") < 5}
    stops(constraints.enforce(bad, rules, "returns", ["ticker", "date"]), r'returns: r is finite.*"ticker":"y","date":"2020-01-04"')
    assert constraints.enforce(panel, rules, "returns").count() == panel.count() and constraints.enforce(panel, {}) is panel


def test_null_rules_are_broken_and_nulls_are_a_choice(spark):
    df = spark.createDataFrame([(None,), (1.0,)], "v double")
    stops(constraints.enforce(df, {"positive": F.col("v") > 0}), "positive")
    stops(constraints.enforce(df, {"there": constraints.present("v")}), "there")
    stops(constraints.enforce(df, {"finite": constraints.finite("v", allow_null=False)}), "finite")
    fine = {"a": constraints.finite("v"), "b": constraints.at_least("v", 1.0), "c": constraints.above("v", 0.5)}
    assert constraints.enforce(df, fine).count() == 2
    stops(constraints.enforce(df, {"b": constraints.at_least("v", 1.5)}), "b")


def test_numbers_from_text(spark):
    good, bad = (spark.createDataFrame([("1.5",), (None,), (x,)], "v string") for x in ("-2e3", "two"))
    assert [r[0] for r in good.select(constraints.numeric("v")).collect()] == [1.5, None, -2000.0]
    stops(bad.select(constraints.numeric("v")), "v is no number: two")


def test_watched_metrics_ride_on_the_action(spark, panel, tmp_path):
    ok = constraints.Watched(panel, {"has rows": F.count(F.lit(1)) > 0}, "panel")
    ok.frame.write.parquet(f"file://{tmp_path}/w")
    ok.verify()
    bad = constraints.Watched(panel, {"has rows": F.count(F.lit(1)) > 0, "weights sum to one": F.abs(F.sum("r") - 1) < 1e-9}, "panel")
    bad.frame.count()
    with pytest.raises(ValueError, match="panel: weights sum to one"):
        bad.verify()


def test_prices(spark, panel):
    make = features.return_features
    assert make(panel).count() == 24 and features.prepare_ohlcv(panel.unionByName(panel.limit(1))).count() == 25
    stops(make(panel.unionByName(panel.limit(1))), "prices: a key occurs twice")
    stops(make(panel.withColumn("ticker", F.when(F.col("ticker") != "x", F.col("ticker")))), "prices: a key is missing")
    stops(make(panel.withColumn("date", F.lit(None).cast("date"))), "prices: a key is missing")


BAD_RETURNS = [("a return is under -1", lambda p: p.withColumn("r", F.when(F.col("date") == day(2), -1.5).otherwise(F.col("r")))), ("a return is under -1 or not finite", lambda p: p.withColumn("r", F.lit(float("inf"))))]
BAD_TARGETS = [
    ("a weight is missing or not finite", lambda t: t.withColumn("weight", F.when(F.col("ticker") != "z", F.col("weight")))),
    ("a weight is missing or not finite", lambda t: t.withColumn("weight", F.col("weight") * float("nan"))),
    ("a key is missing", lambda t: t.withColumn("ticker", F.lit(None).cast("string"))),
]


@pytest.mark.parametrize("run", [backtest.target_weight_backtest, backtest.long_short_backtest])
def test_backtests(panel, targets, run):
    assert run(panel, targets, "r").count() == 8
    for message, make in BAD_RETURNS:
        stops(run(make(panel), targets, "r"), message)
    for message, make in BAD_TARGETS:
        stops(run(panel, make(targets), "r"), message)


def test_repeated_keys_in_a_backtest(panel, targets):
    for p, t in ((panel.unionByName(panel.filter(F.col("date") == day(1))), targets), (panel, targets.unionByName(targets.limit(1)))):
        stops(backtest.target_weight_backtest(p, t, "r"), "a target or a return occurs twice")


def test_a_book_that_is_worth_nothing(spark, panel):
    ruin = panel.withColumn("r", F.when(F.col("ticker") == "x", -0.9).otherwise(2.0))
    book = spark.createDataFrame([(day(0), "x", 1.0), (day(0), "y", -1.0)], "date date, ticker string, weight double")
    stops(backtest.target_weight_backtest(ruin, book, "r"), "net asset value is not positive")


def test_sectors(spark, targets):
    held = targets.withColumn("portfolio", F.lit("P"))
    sectors = [("x", "A"), ("y", "B"), ("z", "B")]
    make = lambda rows: risk.sector_concentration(held, spark.createDataFrame(rows, "ticker string, sector string"))
    assert make([*sectors, ("z", "B"), ("z", None)]).count() == 2
    stops(make(sectors[:2]), 'a held name has no sector.*"ticker":"z"')
    stops(make([*sectors, ("x", "C")]), "two values of sector")
    flat = held.withColumn("weight", F.when(F.col("ticker") == "z", 0.0).otherwise(F.col("weight")))
    assert risk.sector_concentration(flat, spark.createDataFrame(sectors[:2], "ticker string, sector string")).count() == 2


def test_allocations_and_costs(spark, targets):
    sleeves = {"M": targets, "V": targets}
    shares = [(day(i), s, 0.5) for i in (0, 4) for s in "MV"]
    make = lambda rows: portfolio.combine_dated_sleeves(sleeves, spark.createDataFrame(rows, "date date, sleeve string, allocation double"))
    assert make(shares).count() == 6
    stops(make(shares[:3]), 'an allocation is missing.*"sleeve":"V"')
    daily = lambda v: spark.createDataFrame([(v, 0.1)], "turnover double, gross_return double")
    assert costs.apply_linear_cost(daily(2.0), 10.0).first().transaction_cost == 0.002
    for v in (None, -1.0, float("nan"), float("inf")):
        stops(costs.apply_linear_cost(daily(v), 10.0), "turnover is missing")


def test_flags(spark):
    columns = "entity_type string, entity string, category string, diagnostic string, status string"
    good = ("Portfolio", "P", "Signal", "d", "PASS")
    assert monitoring.summarise_flags(spark.createDataFrame([good], columns)).count() == 1
    for i, value, message in ((4, "FINE", "no such status"), (2, "Other", "no such category"), (3, None, "an entity or a diagnostic is missing"), (4, None, "no such status")):
        bad = spark.createDataFrame([good, (*good[:i], value, *good[i + 1 :])], columns)
        for make in (monitoring.summarise_flags, monitoring.active_flags, monitoring.overview):
            stops(make(bad), message)


def shape(df):
    plan = df._jdf.queryExecution().sparkPlan().toString() + df._jdf.queryExecution().executedPlan().toString()
    return [plan.count(x) for x in ("FileScan", "Exchange hashpartitioning", "Exchange SinglePartition", "BroadcastExchange")]


@pytest.mark.parametrize("name", ["features", "backtest", "long_short", "costs", "allocations"])
def test_no_scan_or_shuffle_of_their_own(spark, panel, targets, tmp_path, monkeypatch, name):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        panel.write.parquet(f"file://{tmp_path}/p")
        targets.write.parquet(f"file://{tmp_path}/t")
        p, t = spark.read.parquet(f"file://{tmp_path}/p"), spark.read.parquet(f"file://{tmp_path}/t")
        shares = t.select("date", F.lit("M").alias("sleeve"), F.lit(1.0).alias("allocation")).distinct()
        run = {
            "features": lambda: features.return_features(p),
            "backtest": lambda: backtest.target_weight_backtest(p, t, "r"),
            "long_short": lambda: backtest.long_short_backtest(p, t, "r"),
            "costs": lambda: costs.apply_linear_cost(p.select(F.abs("r").alias("turnover"), F.col("r").alias("gross_return")), 1.0),
            "allocations": lambda: portfolio.combine_dated_sleeves({"M": t}, shares),
        }[name]
        checked = shape(run())
        for module in (features, backtest, costs, portfolio):
            if hasattr(module, "enforce"):
                monkeypatch.setattr(module, "enforce", lambda df, *_: df)
            if hasattr(module, "unique_rows"):
                monkeypatch.setattr(module, "unique_rows", lambda df, *_, **__: df)
        assert checked == shape(run())
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
