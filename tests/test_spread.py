"""Cross-sections of many dates are not the work of few tasks."""

import datetime as dt
import random

from pyspark.sql import functions as F

from quantloom.operators import cross_section, grid, portfolio


def _panel(spark):
    rng = random.Random(5)
    rows = [(dt.date(2020, 1, 6) + dt.timedelta(weeks=w), f"T{t}", rng.gauss(0, 1)) for w in range(60) for t in range(40)]
    return spark.createDataFrame(rows, "date date, ticker string, raw double")


def _most_dates_of_a_task(df):
    tasks = df.groupBy(F.spark_partition_id().alias("task")).agg(F.countDistinct("date").alias("dates"))
    return tasks.agg(F.max("dates")).first()[0]


def test_a_task_gets_one_date(spark):
    panel = _panel(spark)
    assert _most_dates_of_a_task(cross_section.process_factors(panel, {"raw": "f"})) == 1
    assert _most_dates_of_a_task(portfolio.book_weights(panel, "raw")) == 1


def test_one_shuffle_serves_all_windows_of_a_date(spark):
    plan = cross_section.process_factors(_panel(spark), {"raw": "f"})._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("Sort [") <= 3


def test_a_missing_date_has_no_score(spark):
    rows = [(None, "T1", 1.0), (None, "T2", 2.0), (dt.date(2020, 1, 6), "T1", 1.0), (dt.date(2020, 1, 6), "T2", 3.0)]
    got = cross_section.process_factors(spark.createDataFrame(rows, "date date, ticker string, raw double"), {"raw": "f"}).collect()
    assert len(got) == 4 and all((r.f_z is None) == (r.date is None) for r in got)


def test_paths_are_one_row_a_ticker(spark):
    """A row for each date, with the path after it, would be shuffled to the targets: as many paths as names and dates."""
    panel = _panel(spark).withColumn("r", F.col("raw") / 100)
    paths = grid.growth_paths(panel, "r", 21).collect()
    assert len(paths) == 40 and all([x.idx for x in p.steps] == list(range(60)) for p in paths)


def test_both_bounds_of_a_factor_come_from_one_percentile(spark):
    plan = cross_section.process_factors(_panel(spark), {"raw": "f"})._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("percentile(") == 1
