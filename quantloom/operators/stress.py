"""Stress episodes and what portfolios and securities earned in them.

Episodes are date intervals and may overlap.  Rows meet them through bins of
time: an episode is listed once for every bin that it touches, a row has one
bin, so an equi-join on the bin finds every pair once and its size is that of
the answer.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions import stats
from quantloom.functions.windows import ordered, upto
from quantloom.operators.contracts import require_columns
from quantloom.operators.metrics import add_wealth

_BINS = {"week": "interval 7 days", "month": "interval 1 month", "quarter": "interval 3 months", "year": "interval 1 year"}


def interval_join(
    rows: DataFrame, intervals: DataFrame, start: str, end: str, on: str = "date", keys: Sequence[str] = (), bin: str = "month"
) -> DataFrame:
    """Every row with every interval that holds its date (both ends included), under equal keys.

    Columns of the interval other than the keys are added.  An open (null) end
    reaches to the last row; rows without a date and intervals without a start
    meet nothing.
    """
    if bin not in _BINS:
        raise ValueError(f"bin must be one of {sorted(_BINS)}")
    require_columns(rows, [on, *keys], "rows")
    require_columns(intervals, [start, end, *keys], "intervals")
    clash = sorted((set(rows.columns) & set(intervals.columns)) - set(keys))
    if clash:
        raise ValueError(f"both sides have {clash}")
    last = rows.agg(F.max(on).alias("_last"))
    known = intervals.filter(F.col(start).isNotNull()).crossJoin(F.broadcast(last))
    until = F.coalesce(F.col(end), F.col("_last")).cast("date")
    cut = lambda c: F.date_trunc(bin, c.cast("timestamp")).cast("date")
    bins = F.when(until >= F.col(start).cast("date"), F.sequence(cut(F.col(start)), cut(until), F.expr(_BINS[bin])))
    listed = known.withColumn("_until", until).withColumn("_bin", F.explode(bins)).drop("_last")
    placed = rows.withColumn("_bin", cut(F.col(on)))
    joined = placed.join(listed, [*keys, "_bin"])
    return joined.filter(F.col(on).between(F.col(start), F.col("_until"))).drop("_bin", "_until")


def drawdown_events(returns: DataFrame, value: str, keys: Sequence[str] = (), count: int | None = None) -> DataFrame:
    """Times under water: peak_date, stress_start_date, trough_date, recovery_date, drawdown, rows_to_trough, recovered, event.

    ``count`` keeps the deepest ones of each key (ties: the earlier trough);
    ``event`` numbers them by trough.  A time that begins with the first return
    has no peak date, one that has not ended no recovery date.
    """
    staged = add_wealth(returns.filter(F.col(value).isNotNull()).select(*keys, "date", value), value, keys)
    under, spec = F.col("drawdown") < 0, ordered(keys)
    staged = staged.withColumns(
        {"_island": F.sum(F.when(under, 0).otherwise(1)).over(upto(spec)), "_before": F.lag("date").over(spec), "_after": F.lead("date").over(spec)}
    )
    trough = F.min(F.struct("drawdown", "date"))
    found = (
        staged.filter(under)
        .groupBy(*keys, "_island")
        .agg(
            F.min(F.struct("date", "_before")).alias("_first"),
            F.max(F.struct("date", "_after")).alias("_last"),
            trough.alias("_trough"),
            F.collect_list(F.struct("date")).alias("_rows"),
        )
        .select(
            *keys,
            F.col("_first._before").alias("peak_date"),
            F.col("_first.date").alias("stress_start_date"),
            F.col("_trough.date").alias("trough_date"),
            F.col("_last._after").alias("recovery_date"),
            F.col("_trough.drawdown").alias("drawdown"),
            F.size(F.filter("_rows", lambda r: r["date"] <= F.col("_trough.date"))).cast("long").alias("rows_to_trough"),
        )
        .withColumn("recovered", F.col("recovery_date").isNotNull())
    )
    if count is not None:
        depth = Window.partitionBy(*keys).orderBy("drawdown", "trough_date")
        found = found.withColumn("_rank", F.row_number().over(depth)).filter(F.col("_rank") <= count).drop("_rank")
    order = Window.partitionBy(*keys).orderBy("trough_date")
    return found.withColumn("event", F.row_number().over(order))


def stress_attribution(daily: DataFrame, market: DataFrame, events: DataFrame, keys: Sequence[str] = ("portfolio",), tolerance: float = 1e-9) -> DataFrame:
    """Per event and portfolio, from its start to its trough: contributions, compounded and relative returns.

    ``market`` has date and market_return, ``events`` comes from
    ``drawdown_events`` of one series.  ``reconciles`` says whether legs less
    costs give the net sum.
    """
    columns = ["long_return", "short_return", "gross_return", "transaction_cost", "net_return"]
    rows = daily.select(*keys, "date", *columns).join(market.select("date", "market_return"), "date", "left")
    spans = events.select("event", "peak_date", "stress_start_date", "trough_date", "drawdown")
    met = interval_join(rows, spans, "stress_start_date", "trough_date")
    out = met.groupBy("event", "peak_date", "stress_start_date", "trough_date", F.col("drawdown").alias("benchmark_drawdown"), *keys).agg(
        F.count("*").alias("observations"),
        *[F.sum(c).alias(f"cumulative_{n}") for c, n in zip(columns, ("long_contribution", "short_contribution", "gross_contribution", "transaction_cost", "net_contribution"), strict=True)],
        stats.compound("net_return").alias("compounded_net_return"),
        stats.compound("market_return").alias("_market"),
    )
    gap = F.abs(F.col("cumulative_long_contribution") + F.col("cumulative_short_contribution") - F.col("cumulative_transaction_cost") - F.col("cumulative_net_contribution"))
    return out.withColumns(
        {
            "net_minus_benchmark_return": F.col("compounded_net_return") - F.col("_market"),
            "short_side_profitable": F.col("cumulative_short_contribution") > 0,
            "outperformed_benchmark": F.col("compounded_net_return") > F.col("_market"),
            "reconciles": gap < tolerance,
        }
    ).drop("_market")


def summarise_stress(detail: DataFrame, keys: Sequence[str] = ("portfolio",)) -> DataFrame:
    """Per portfolio: events, average drawdown, returns and contributions, shares of good events, worst return."""
    share = lambda c: F.avg(F.col(c).cast("int"))
    return detail.groupBy(*keys).agg(
        F.count_distinct("event").alias("event_count"),
        F.avg("benchmark_drawdown").alias("average_benchmark_drawdown"),
        F.avg("compounded_net_return").alias("average_net_return"),
        F.avg("net_minus_benchmark_return").alias("average_net_minus_benchmark_return"),
        F.avg("cumulative_long_contribution").alias("average_long_contribution"),
        F.avg("cumulative_short_contribution").alias("average_short_contribution"),
        F.avg("cumulative_transaction_cost").alias("average_transaction_cost"),
        share("short_side_profitable").alias("short_profitable_event_fraction"),
        share("outperformed_benchmark").alias("outperformance_fraction"),
        F.min("compounded_net_return").alias("worst_event_net_return"),
    )


def security_stress(security: DataFrame, events: DataFrame, keys: Sequence[str] = ("portfolio",)) -> DataFrame:
    """Per event of a portfolio and security: days, contributions, and its share of all losses of the event.

    ``events`` may hold each portfolio's own episodes (then they have its keys)
    or one list for all; overlapping ones count a day in each.
    """
    own = [k for k in keys if k in events.columns]
    rows = security.select(*keys, "date", "ticker", "side", "gross_return_contribution", "transaction_cost_contribution", "net_return_contribution")
    spans = events.select(*own, "event", "stress_start_date", "trough_date")
    met = interval_join(rows, spans, "stress_start_date", "trough_date", keys=own)
    sums = met.groupBy(*keys, "event", "ticker").agg(
        F.count("*").alias("days"),
        F.count_if(F.col("side") == "Short").alias("short_days"),
        F.sum("gross_return_contribution").alias("gross_contribution"),
        F.sum("transaction_cost_contribution").alias("transaction_cost"),
        F.sum("net_return_contribution").alias("net_contribution"),
    )
    loss = F.greatest(-F.col("net_contribution"), F.lit(0.0))
    total = F.sum(loss).over(Window.partitionBy(*keys, "event"))
    return sums.withColumn("loss_share", F.try_divide(loss, F.when(total > 0, total)))
