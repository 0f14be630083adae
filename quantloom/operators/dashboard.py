"""Tables behind a dashboard: filtered histories, snapshots, options, freshness."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.windows import ordered
from quantloom.operators.contracts import require_columns, require_labels
from quantloom.operators.monitoring import CATEGORIES, SEVERITY, status_severity

DATASET_STATES = ("MISSING", "READ_ERROR", "INVALID", "READY", "STALE", "UNDATED", "INVALID_GROUP")


def within(df: DataFrame, start: dt.date | str | None = None, end: dt.date | str | None = None) -> DataFrame:
    """Rows of an inclusive date window; a missing bound is open."""
    if start is not None and end is not None and str(start) > str(end):
        raise ValueError("start must not be after end")
    if start is not None:
        df = df.filter(F.col("date") >= F.lit(str(start)).cast("date"))
    if end is not None:
        df = df.filter(F.col("date") <= F.lit(str(end)).cast("date"))
    return df


def labelled(df: DataFrame, column: str, labels: Sequence[str] | None) -> DataFrame:
    """Rows with one of the labels, in their order by ``_place``; None keeps all, in order of label."""
    if labels is None:
        known = df.select(column).distinct()
        places = known.select(F.col(column).alias("_label"), F.dense_rank().over(Window.orderBy(column)).alias("_place"))
        return df.join(places, F.col(column).eqNullSafe(F.col("_label")), "left").drop("_label")
    wanted = require_labels(labels, column)
    known = {r[0] for r in df.select(column).filter(F.col(column).isin(wanted)).distinct().collect()}
    if set(wanted) - known:
        raise ValueError(f"unknown {column}: {sorted(set(wanted) - known)}")
    return df.filter(F.col(column).isin(wanted)).withColumn("_place", F.array_position(F.array(*[F.lit(x) for x in wanted]), F.col(column)))


def history(
    df: DataFrame, columns: Sequence[str], entity: str = "portfolio", entities=None, start=None, end=None, name: str = "history"
) -> DataFrame:
    """Columns of the chosen entities and dates, ordered by entity as asked and date."""
    require_columns(df, [entity, "date", *columns], name)
    chosen = labelled(within(df, start, end), entity, entities)
    return chosen.orderBy("_place", "date").select(entity, "date", *columns)


def implementation_history(df: DataFrame, columns: Sequence[str], **choice) -> DataFrame:
    """A history with every column of dollars also in millions."""
    out = history(df, columns, **choice)
    return out.withColumns({c.replace("_usd", "_usd_millions"): F.col(c) / 1_000_000 for c in columns if "_usd" in c})


def performance_history(risk: DataFrame, entities=None, start=None, end=None) -> DataFrame:
    """Wealth over the first wealth in the window, with drawdown and rolling measures."""
    chosen = labelled(within(risk, start, end), "portfolio", entities)
    first = F.first("wealth", ignorenulls=True).over(ordered(("portfolio",)).rowsBetween(Window.unboundedPreceding, 0))
    indexed = F.try_divide(F.col("wealth"), first)
    return chosen.withColumn("indexed_wealth", indexed).drop("_place")


def latest_rows(df: DataFrame, keys: Sequence[str] = ("portfolio",)) -> DataFrame:
    """The row with the last date of each key."""
    others = [c for c in df.columns if c not in keys]
    packed = F.max_by(F.struct(*others), "date").alias("_r")
    return df.groupBy(*keys).agg(packed).select(*keys, "_r.*")


def latest_known(df: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Per key and metric: the last non-null value and its own date."""
    columns = []
    for m in metrics:
        known = F.when(F.col(m).isNotNull(), F.col("date"))
        columns += [F.max_by(m, known).alias(m), F.max(known).alias(f"{m}_date")]
    return df.groupBy(*keys).agg(*columns)


def portfolio_snapshot(states: Mapping[str, tuple[DataFrame, Sequence[str]]], overview: DataFrame) -> DataFrame:
    """Latest rows of several states side by side, with the monitoring status; their dates must agree."""
    parts = [
        latest_rows(df.select("portfolio", "date", *columns)).withColumnRenamed("date", f"{name}_date")
        for name, (df, columns) in states.items()
    ]
    out = reduce(lambda a, b: a.join(b, "portfolio"), parts)
    dates = [F.col(f"{name}_date") for name in states]
    agree = reduce(lambda a, b: a & b, [x == dates[0] for x in dates])
    if out.filter(~agree).limit(1).count():
        raise ValueError("states end on different dates")
    status = overview.filter("entity_type = 'Portfolio'").drop("entity_type").withColumnRenamed("entity", "portfolio")
    return out.withColumn("as_of", dates[0]).drop(*[f"{n}_date" for n in states]).join(status, "portfolio", "left")


def coverage_snapshot(coverage: DataFrame, tolerance: float = 1e-8) -> DataFrame:
    """Per portfolio: the least coverage of the window and the days it was incomplete."""
    return coverage.groupBy("portfolio").agg(
        F.min("liquidity_coverage").alias("minimum_coverage"),
        F.count_if(F.col("liquidity_coverage") < 1 - tolerance).alias("incomplete_days"),
    )


def diagnostic_table(flags: DataFrame, **choices) -> DataFrame:
    """Flags filtered by entity_type, entity, category or status, in the fixed order of categories."""
    for column, wanted in choices.items():
        if wanted is not None:
            flags = flags.filter(F.col(column).isin(require_labels(wanted, column)))
    place = F.array_position(F.array(*[F.lit(c) for c in CATEGORIES]), F.col("category"))
    return flags.orderBy(F.desc(status_severity(F.col("status"))), "entity_type", "entity", place, "diagnostic")


def checked_overview(overview: DataFrame) -> DataFrame:
    """The overview with its status worked out again; raises where counts and status disagree."""
    counted = reduce(lambda a, b: a + b, [F.col(f"{k.lower()}_count") for k in SEVERITY])
    status = F.lit("PASS")
    for name in sorted(SEVERITY, key=SEVERITY.get)[1:]:
        status = F.when(F.col(f"{name.lower()}_count") > 0, name).otherwise(status)
    wrong = (counted != F.col("diagnostic_count")) | (status != F.col("overall_status"))
    if overview.filter(wrong).limit(1).count():
        raise ValueError("overview counts disagree with its statuses")
    return overview


def filter_options(risk: DataFrame) -> DataFrame:
    """One row: portfolios in order, and the window of dates that all of them cover."""
    spans = risk.groupBy("portfolio").agg(F.min("date").alias("a"), F.max("date").alias("b"))
    return spans.agg(
        F.sort_array(F.collect_list("portfolio")).alias("portfolios"), F.max("a").alias("first_date"), F.min("b").alias("last_date")
    )


def business_days(since: Column, until: Column) -> Column:
    """Mondays to Fridays in [since, until), by whole weeks and the rest; negative if until is earlier."""

    def index(day):
        # Weekdays since Monday 1970-01-05.
        n = F.datediff(day, F.lit("1970-01-05").cast("date"))
        return 5 * F.floor(n / 7) + F.least(F.pmod(n, F.lit(7)), F.lit(5))

    return index(until) - index(since)


def freshness(metadata: DataFrame, as_of: Column, stale_after: int = 5) -> DataFrame:
    """Datasets (dataset, status, latest_date) with their age in business days and READY turned STALE or UNDATED."""
    age = F.when(F.col("latest_date").isNotNull(), business_days(F.col("latest_date"), as_of))
    status = (
        F.when((F.col("status") == "READY") & F.col("latest_date").isNull(), "UNDATED")
        .when((F.col("status") == "READY") & (F.col("age") > stale_after), "STALE")
        .otherwise(F.col("status"))
    )
    place = F.array_position(F.array(*[F.lit(s) for s in DATASET_STATES]), F.col("status"))
    return metadata.withColumn("age", age).withColumn("status", status).orderBy(place, F.desc("age"), "dataset")


def with_proxies(metadata: DataFrame, proxies: Mapping[str, str]) -> DataFrame:
    """Datasets without a date of their own take that of their proxy."""
    if not proxies:
        return metadata
    pairs = F.create_map(*[F.lit(x) for kv in proxies.items() for x in kv])
    other = metadata.select(F.col("dataset").alias("_of"), F.col("latest_date").alias("_date"))
    joined = metadata.withColumn("_proxy", F.try_element_at(pairs, F.col("dataset"))).join(other, F.col("_proxy") == F.col("_of"), "left")
    return joined.withColumn("latest_date", F.coalesce("latest_date", "_date")).drop("_proxy", "_of", "_date")
