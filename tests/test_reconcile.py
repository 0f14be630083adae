"""Cell-by-cell differences: planted errors are found, equal tables give nothing."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from quantloom.operators import reconcile as R

SCHEMA = "portfolio string, day int, x double, n bigint, name string, tags array<int>"


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def rows(n=60):
    rng = random.Random(3)
    return [(rng.choice(["A", "B", None]) if i > 40 else "A", i, rng.choice([None, float("nan"), rng.random()]), i, rng.choice([None, "u"]), [i]) for i in range(n)]


def found(df):
    return sorted((r.kind, r.column, r.key, r.expected, r.actual) for r in df.collect())


def test_equal_tables_in_any_order(spark):
    data = rows()
    shuffled = table(spark, data[::-1]).select("tags", "name", "n", "x", "day", "portfolio")
    assert found(R.row_differences(table(spark, data), shuffled, ["portfolio", "day"])) == []
    R.require_equal(table(spark, data), shuffled, ["portfolio", "day"])


@pytest.mark.parametrize("column", ["x", "n", "name", "tags"])
def test_one_planted_cell(spark, column):
    data = rows()
    other = [list(r) for r in data]
    at = next(i for i, r in enumerate(data) if r[2] == r[2] and r[2] is not None)
    other[at][SCHEMA.split(", ").index(next(s for s in SCHEMA.split(", ") if s.startswith(column + " ")))] = {"x": data[at][2] + 1e-6, "n": -1, "name": "planted", "tags": [1, 2]}[column]
    got = R.row_differences(table(spark, data), table(spark, [tuple(r) for r in other]), ["portfolio", "day"]).collect()
    assert [(r.kind, r.column) for r in got] == [("value", column)] and f'"day":{at}' in got[0].key
    with pytest.raises(ValueError, match=f"value {column}"):
        R.require_equal(table(spark, data), table(spark, [tuple(r) for r in other]), ["portfolio", "day"])


def test_tolerances(spark):
    a, b = table(spark, [("A", 1, 1.0, 100, None, None), ("A", 2, None, 1, None, None)]), table(spark, [("A", 1, 1.01, 101, None, None), ("A", 2, 0.0, 1, None, None)])
    keys = ["portfolio", "day"]
    assert [(r.column, r.key) for r in R.row_differences(a, b, keys, {"x": 0.1, "n": 1.0}).collect()] == [("x", '{"portfolio":"A","day":2}')]
    assert R.row_differences(a, b, keys, relative=0.02).count() == 1 and R.row_differences(a, b, keys, tolerance=0.02).count() == 2
    with pytest.raises(ValueError, match="not compared"):
        R.row_differences(a, b, keys, {"day": 1.0})


def test_rows_keys_and_schemas(spark):
    a = table(spark, [("A", 1, 1.0, 1, "a", None), (None, 2, 1.0, 1, "a", None), ("A", 3, 1.0, 1, "a", None), ("A", 3, 2.0, 1, "a", None)])
    b = table(spark, [("A", 1, 1.0, 1, "a", None), ("A", 3, 1.0, 1, "a", None), ("B", None, 1.0, 1, "a", None)])
    b = b.drop("tags").withColumn("n", F.col("n").cast("int")).withColumn("more", F.lit(1))
    got = found(R.row_differences(a, b, ["portfolio", "day"]))
    assert [(k, c) for k, c, *_ in got] == [("extra_column", "more"), ("extra_row", None), ("missing_column", "tags"), ("missing_row", None), ("repeated_key", None)]
    assert found(R.row_differences(a, a.withColumn("x", F.lit("t")), ["day", "portfolio"]))[-1][:2] == ("value", "x")
    assert {r.kind for r in R.summarise_differences(R.row_differences(a, b, ["portfolio", "day"])).collect()} <= set(R.KINDS)


def test_big_numbers_are_told_apart(spark):
    a, b = (spark.createDataFrame([(1, 2**60 + i)], "k int, v bigint") for i in (0, 1))
    assert R.row_differences(a, b, ["k"]).first().kind == "value"


def daily(spark, n=30):
    out, wealth = [], {"gross": 1.0, "net": 1.0}
    rng = random.Random(5)
    for i in range(n):
        long, short, turnover = rng.gauss(0, 0.01), rng.gauss(0, 0.01), rng.random()
        gross, cost = long + short, turnover / 1000
        wealth = {"gross": wealth["gross"] * (1 + gross), "net": wealth["net"] * (1 + gross - cost)}
        out.append(("P", dt.date(2020, 1, 1) + dt.timedelta(days=i), long, short, gross, turnover, cost, gross - cost, 1.0, 0.5, 1.5, 0.5, 0.0, wealth["gross"], wealth["net"]))
    names = "portfolio string, date date, " + ", ".join(f"{c} double" for c in "long_return short_return gross_return turnover transaction_cost net_return long_exposure short_exposure gross_exposure net_exposure missing_return_weight gross_cumulative_return net_cumulative_return".split())
    return spark.createDataFrame(out, names)


def securities(days):
    pairs = {"long_return_contribution": "long_return", "short_return_contribution": "short_return", "gross_return_contribution": "gross_return", "absolute_trade_weight": "turnover",
             "transaction_cost_contribution": "transaction_cost", "net_return_contribution": "net_return", "long_weight": "long_exposure", "short_weight": "short_exposure", "missing_return_weight_contribution": "missing_return_weight"}
    return days.select("portfolio", "date", *[F.col(v).alias(k) for k, v in pairs.items()])


@pytest.mark.parametrize(("change", "checks"), [
    ({}, set()),
    ({"gross_return": "gross_return + 1e-4"}, {"long_short_return", "net_return", "gross_cumulative_return", "security_sums:value:gross_return"}),
    ({"net_cumulative_return": "net_cumulative_return * 1.01"}, {"net_cumulative_return"}),
    ({"gross_exposure": "CAST(NULL AS DOUBLE)"}, {"gross_exposure"}),
])
def test_attribution_group(spark, change, checks):
    good = daily(spark)
    hit = F.col("date") == "2020-01-10"
    bad = good.withColumns({k: F.when(hit, F.expr(v)).otherwise(F.col(k)) for k, v in change.items()})
    out = R.attribution_group_violations({"portfolio_daily": bad, "benchmark_daily": good, "security_daily": securities(good)}, 10.0).collect()
    assert {r.check for r in out} >= checks and all("2020-01-" in r.key for r in out) and bool(out) == bool(checks)


def test_calendars(spark):
    good = daily(spark)
    out = R.calendar_violations(good.filter("date <> '2020-01-03'"), good.select("date").filter("date <> '2020-01-05'"), ["portfolio"]).collect()
    assert sorted((str(r.date), r.kind) for r in out) == [("2020-01-03", "missing"), ("2020-01-05", "extra")]
