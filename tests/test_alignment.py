"""As-of alignment against a literal search, over random tables with null keys, ties and hot keys."""

import datetime as dt
import random

import pytest

from quantloom.operators.alignment import asof_join, daily_risk_free, dated_allocations, filled_forward

DAY = dt.date(2020, 1, 1)


def day(n):
    return None if n is None else DAY + dt.timedelta(days=n)


def tables(seed):
    rng = random.Random(seed)
    some = lambda: rng.choice([None, *range(0, 400, rng.choice([1, 7, 30]))])
    key = lambda: rng.choice(["hot"] * 6 + ["a", "b", None])
    left = [(i, key(), day(some())) for i in range(150)] + [(7, "hot", day(30))] * 3
    right = [(key(), day(some()), rng.choice([None, 1, 2, 3]), rng.choice([None, "x", "y"])) for _ in range(rng.choice([0, 5, 120]))]
    return left, right


def literal(left, right, strict, skip_null, tolerance):
    order = lambda v: tuple((x is not None, x if x is not None else 0) for x in v[:1]) + tuple((x is not None, x or "") for x in v[1:])
    out = []
    for i, k, d in left:
        known = sorted([r for r in right if r[0] == k and r[1] is not None and d is not None and (r[1] < d if strict else r[1] <= d)], key=lambda r: (r[1], order(r[2:])))
        if skip_null:
            pick = [next((r[c] for r in reversed(known) if r[c] is not None), None) for c in (2, 3)]
            out.append((i, k, d, *pick))
        else:
            r = known[-1] if known else (None, None, None, None)
            if r[1] is not None and tolerance is not None and (d - r[1]).days > tolerance:
                r = (None, None, None, None)
            out.append((i, k, d, r[2], r[3], r[1]))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize(("strict", "skip_null", "tolerance"), [(False, False, None), (True, False, None), (False, True, None), (False, False, 20), (True, True, None)])
def test_against_literal_search(spark, seed, strict, skip_null, tolerance):
    left, right = tables(seed)
    a = spark.createDataFrame(left, "row int, key string, date date")
    b = spark.createDataFrame(right, "key string, date date, x int, y string")
    extra = {} if skip_null else {"matched": "seen"}
    got = asof_join(a, b, keys=["key"], strict=strict, skip_null=skip_null, tolerance_days=tolerance, span=["week", "month", "quarter", "year"][seed], **extra)
    assert sorted((tuple(r) for r in got.collect()), key=str) == literal(left, right, strict, skip_null, tolerance)


def test_no_keys_timestamps_and_other_names(spark):
    left = spark.createDataFrame([(dt.datetime(2020, 1, 1, 10),), (dt.datetime(2020, 3, 1, 9),)], "at timestamp")
    right = spark.createDataFrame([(dt.datetime(2020, 1, 1, 9), 1), (dt.datetime(2020, 1, 1, 11), 2)], "time timestamp, v int")
    assert [r.v for r in asof_join(left, right, "at", right_on="time").orderBy("at").collect()] == [1, 2]


def test_no_range_join_in_the_plan(spark):
    left, right = tables(3)
    a, b = spark.createDataFrame(left, "row int, key string, date date"), spark.createDataFrame(right, "key string, date date, x int, y string")
    plan = asof_join(a, b, keys=["key"])._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Inner" not in plan and "Cross" not in plan and plan.count("Join ") == 1


def test_bad_arguments(spark):
    a = spark.createDataFrame([], "date date, v int")
    for bad in ({"span": "day"}, {"keys": ["k"]}, {}, {"skip_null": True, "matched": "m", "values": []}):
        with pytest.raises(ValueError):
            asof_join(a, a, **bad)


def test_filled_forward_ignores_dates_outside_the_calendar(spark):
    calendar = spark.createDataFrame([(day(n),) for n in (0, 1, 4, 5, 400)], "date date")
    series = spark.createDataFrame([(day(1), 1.0), (day(2), 9.0), (day(5), None), (day(300), 8.0)], "date date, v double")
    assert [r.v for r in filled_forward(calendar, series).orderBy("date").collect()] == [None, 1.0, 1.0, 1.0, 1.0]


def test_risk_free_rate(spark):
    calendar = spark.createDataFrame([(day(n),) for n in range(3)], "date date")
    out = daily_risk_free(spark.createDataFrame([(day(0), 5.0)], "date date, irx double"), "irx", calendar).orderBy("date").collect()
    assert [round(r.risk_free_rate, 12) for r in out] == [round(1.05 ** (1 / 252) - 1, 12)] * 3


def test_dated_allocations(spark):
    daily = spark.createDataFrame([(day(0), 0.4, 0.6), (day(3), 0.5, 0.5), (day(6), None, None)], "date date, a double, b double")
    asked = spark.createDataFrame([(day(n),) for n in (-1, 2, 3, 5, 7)], "date date")
    out = dated_allocations(daily, asked, ["a", "b"]).orderBy("date").collect()
    assert [r.a for r in out] == [None, 0.4, 0.5, 0.5, None] and [r.complete for r in out] == [False, True, True, True, False]
    assert [r.allocation_date for r in out] == [None, day(0), day(3), day(3), day(6)]
    assert [r.change_a is not None and round(r.change_a, 9) for r in out] == [False, False, 0.1, 0.0, False]
