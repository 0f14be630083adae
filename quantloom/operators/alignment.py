"""As-of alignment: the last row on or before a date, without a range join.

Questions and answers are one union, sorted by date within a key; an answer is
carried forward to the questions after it.  So that a key with most of the rows
(or no key at all) is no single task, the sort runs within *spans* of time:
every span carries its own answers, and what it starts with comes from one row
per key and span, the last answer of each, carried over the spans.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.operators.contracts import require_columns

SPANS = ("week", "month", "quarter", "year")


def _span(on: str, span: str) -> Column:
    return F.date_trunc(span, F.col(on).cast("timestamp"))


def asof_join(
    left: DataFrame,
    right: DataFrame,
    on: str = "date",
    keys: Sequence[str] = (),
    values: Sequence[str] | None = None,
    *,
    strict: bool = False,
    skip_null: bool = False,
    tolerance_days: int | None = None,
    right_on: str | None = None,
    matched: str | None = None,
    span: str = "month",
) -> DataFrame:
    """``left`` with ``values`` of the last row of ``right`` on or before its date, under equal keys.

    ``strict`` takes only rows before the date.  By default a right row whose
    values are null is an answer like any other; with ``skip_null`` each value is
    the last one that is not null.  An answer older than ``tolerance_days`` is
    none.  ``matched`` names a column for the answer's date.  All left rows stay,
    repeated ones too; without an answer the values are null.  Null keys are
    equal; a null date has no answer and is none.  Of right rows with equal keys
    and date the one with the largest values counts.
    """
    right_on = right_on or on
    values = [c for c in right.columns if c not in (*keys, right_on)] if values is None else list(values)
    require_columns(left, [*keys, on], "left")
    require_columns(right, [*keys, right_on, *values], "right")
    if span not in SPANS:
        raise ValueError(f"span must be one of {SPANS}")
    if skip_null and (tolerance_days is not None or matched):
        raise ValueError("with skip_null values may come from different dates, so there is no date to show or to limit")
    clash = sorted(({*values, matched} - {None}) & set(left.columns))
    if clash:
        raise ValueError(f"left already has {clash}")

    key = F.struct(*[F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(keys)]) if keys else F.lit(0)
    at = {"left": F.col(f"`{on}`"), "right": F.col(f"`{right_on}`")}
    # Answers sort before questions of the same date, or after them where they must lie before.
    side = {"left": F.lit(1), "right": F.lit(2 if strict else 0)}
    answer = F.struct(F.col(f"`{right_on}`").alias("at"), *[F.col(f"`{v}`").alias(f"v{i}") for i, v in enumerate(values)])
    nothing = right.limit(0).select(answer.alias("a")).schema["a"].dataType
    row = F.struct(*[F.col(f"`{c}`") for c in left.columns])
    questions = left.select(
        key.alias("key"), at["left"].alias("at"), side["left"].alias("side"), row.alias("row"), F.lit(None).cast(nothing).alias("answer"), _span(on, span).alias("span")
    )
    answers = right.filter(at["right"].isNotNull()).select(
        key.alias("key"), at["right"].alias("at"), side["right"].alias("side"), F.lit(None).cast(left.select(row.alias("r")).schema["r"].dataType).alias("row"), answer.alias("answer"), _span(right_on, span).alias("span")
    )
    fields = [f"v{i}" for i in range(len(values))]
    order = Window.partitionBy("key", "span").orderBy("at", "side", "answer").rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def carried(over, source):
        """The last answer, or the last that is not null of each of its fields."""
        if not skip_null:
            return F.last(source, ignorenulls=True).over(over)
        return F.struct(*[F.last(source[f], ignorenulls=True).over(over).alias(f) for f in fields])

    ends = answers.groupBy("key", "span").agg(
        F.max("answer").alias("end")
        if not skip_null
        else F.struct(*[F.max_by(F.col("answer")[f], F.when(F.col("answer")[f].isNotNull(), F.struct("at", F.col("answer")))).alias(f) for f in fields]).alias("end")
    )
    # One row per key and span, of questions too, so that spans without answers carry on.
    asked = questions.filter(F.col("span").isNotNull()).select("key", "span", F.lit(None).cast(ends.schema["end"].dataType).alias("end"))
    every = ends.unionByName(asked).groupBy("key", "span").agg(F.max("end").alias("end"))
    earlier = Window.partitionBy("key").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    starts = every.select("key", "span", carried(earlier, F.col("end")).alias("start"))
    told = questions.unionByName(answers).withColumn("own", carried(order, F.col("answer"))).filter(F.col("row").isNotNull())
    same = F.struct("key", "span")
    joined = told.withColumn("join", same).join(starts.select(same.alias("join"), "start"), "join", "left")
    if skip_null:
        out = [F.coalesce(F.col("own")[f], F.col("start")[f]).alias(v) for f, v in zip(fields, values, strict=True)]
        return joined.select("row.*", *out)
    found = F.coalesce("own", "start")
    if tolerance_days is not None:
        found = F.when(F.datediff(F.col("at"), found["at"]) <= tolerance_days, found)
    found = F.when(F.col("at").isNotNull(), found)
    shown = [found["at"].alias(matched)] if matched else []
    return joined.select("row.*", *[found[f].alias(v) for f, v in zip(fields, values, strict=True)], *shown)


def filled_forward(calendar: DataFrame, series: DataFrame, on: str = "date", keys: Sequence[str] = (), span: str = "year") -> DataFrame:
    """``series`` on the dates of ``calendar``: its value there, else the last one on an earlier date of the calendar.

    Unlike an as-of join, dates of the series that the calendar lacks count for nothing.
    """
    values = [c for c in series.columns if c not in (*keys, on)]
    exact = calendar.join(series, [*keys, on], "left")
    known = exact.select(*keys, on, *values)
    return asof_join(exact.select(*[c for c in exact.columns if c not in values]).distinct(), known, on, keys, values, skip_null=True, span=span)


def daily_risk_free(yields: DataFrame, rate: str, calendar: DataFrame, periods: int = 252, outside: bool = False) -> DataFrame:
    """date, risk_free_rate: an annual percentage as a compounding daily rate, carried along the calendar.

    With ``outside`` yields on dates that the calendar lacks count as well.
    """
    daily = yields.select("date", (F.pow(1 + F.col(rate) / 100.0, F.lit(1.0 / periods)) - 1).alias("risk_free_rate"))
    dates = calendar.select("date").distinct()
    return asof_join(dates, daily, skip_null=True, span="year") if outside else filled_forward(dates, daily)


def dated_allocations(allocations: DataFrame, rebalances: DataFrame, sleeves: Sequence[str], tolerance: float = 1e-12) -> DataFrame:
    """The sleeve columns of daily ``allocations`` as of each rebalance date, with their change since the last one.

    ``complete`` says whether every sleeve has an allocation and they sum to one.
    """
    dates = rebalances.select("date").distinct()
    out = asof_join(dates, allocations.select("date", *sleeves), matched="allocation_date", span="year")
    total = sum((F.col(s) for s in sleeves[1:]), F.col(sleeves[0]))
    order = Window.orderBy("date")
    return out.withColumns(
        {"complete": F.coalesce(F.abs(total - 1) <= tolerance, F.lit(False))}
        | {f"change_{s}": F.col(s) - F.lag(s).over(order) for s in sleeves}
    )
