"""Backtests of one set of daily targets over many rebalance schedules and costs.

A schedule (frequency f, offset o) rebalances on the dates o, o + f, o + 2 f, ...
Whatever the schedule, a date t at h rows after its last rebalance s holds what
was bought at s; so all schedules read from one table of segments (s, h), h below
the largest frequency.  Growth from s to t is a quotient of running products per
ticker, cut from one row of a ticker; nothing is densified per schedule, and costs
and schedules multiply only rows of a few numbers per date.

Turnover at t is the distance from the target to what a segment of f rows has
become: one row per (s, f) and name, shared by all offsets of f.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.operators import backtest
from quantloom.operators.contracts import require_columns, require_rate
from quantloom.operators.portfolio import usable_dates
from quantloom.sources.shared import kept

#: Rows that a schedule of the grid is known by.
VARIANT = ("book", "frequency", "offset")
_SUMS = ("total", "long_return", "short_return", "long_exposure", "short_exposure", "missing_return_weight")


def growth_paths(panel: DataFrame, returns: str, longest: int) -> DataFrame:
    """ticker, steps and longest: one row per ticker with growth up to and return on each usable date, in order.

    A date without a return leaves the value as it is.  A return of -100 % ends
    it, for good: products leave such factors out and their number is compared.
    """
    dates = F.broadcast(usable_dates(panel, returns).select("date", F.col("idx").cast("int").alias("idx")))
    values = panel.join(dates, "date").select("ticker", "idx", F.col(returns).cast("double").alias("r"))
    cells = panel.select("ticker").distinct().crossJoin(dates).select("ticker", "idx", F.lit(None).cast("double").alias("r"))
    # Dealt by ticker once: cells, windows and series need no other shuffle.
    grid = cells.unionByName(values).repartition("ticker").groupBy("ticker", "idx").agg(F.max("r").alias("r"))
    before = Window.partitionBy("ticker").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    factor = 1 + F.coalesce("r", F.lit(0.0))
    staged = grid.withColumns(
        {
            "p": F.coalesce(F.product(F.when(factor != 0, factor).otherwise(1.0)).over(before), F.lit(1.0)),
            "z": F.coalesce(F.sum(F.when(factor == 0, 1).otherwise(0)).over(before), F.lit(0)).cast("int"),
        }
    )
    return staged.groupBy("ticker").agg(F.sort_array(F.collect_list(F.struct("idx", "p", "z", "r"))).alias("steps"), F.lit(longest).alias("longest"))


def _held(targets: DataFrame, dates: DataFrame, paths: DataFrame) -> DataFrame:
    """book, s, ticker, w0 and path of every name held from s on: growth up to and return on each of the next dates.

    Targets meet one row per ticker, from which they cut their path, so that paths are never shuffled.
    """
    placed = targets.filter("weight <> 0").join(F.broadcast(dates.select("date", F.col("idx").cast("int").alias("s"))), "date")
    rows = placed.select("book", "s", "ticker", F.col("weight").cast("double").alias("w0")).join(paths, "ticker")
    start = F.element_at("steps", F.col("s") + 1)
    ahead = F.slice("steps", F.col("s") + 1, F.col("longest") + 1)
    path = F.transform(ahead, lambda x: F.struct(F.when(x["z"] > start["z"], 0.0).otherwise(x["p"] / start["p"]).alias("g"), x["r"].alias("r")))
    return rows.select("book", "s", "ticker", "w0", path.alias("path"))


def segment_sums(held: DataFrame) -> DataFrame:
    """book, s, h: sums over the names of a segment, h rows after its rebalance, as shares of its value."""
    rows = held.select("book", "s", "w0", F.posexplode("path").alias("h", "step"))
    value, r = F.col("w0") * F.col("step.g"), F.col("step.r")
    earned = value * F.coalesce(r, F.lit(0.0))
    up = F.col("w0") > 0
    sums = rows.groupBy("book", "s", "h").agg(
        (1 - F.sum("w0") + F.sum(value)).alias("nav"),
        F.sum(value).alias("total"),
        F.sum(F.when(up, earned).otherwise(0.0)).alias("long_return"),
        F.sum(F.when(up, 0.0).otherwise(earned)).alias("short_return"),
        F.sum(F.when(up, value).otherwise(0.0)).alias("long_exposure"),
        F.sum(F.when(up, 0.0).otherwise(-value)).alias("short_exposure"),
        F.sum(F.when(r.isNull(), F.abs(value)).otherwise(0.0)).alias("missing_return_weight"),
    )
    # A book that has lost everything has no weights; the run stops there instead of going on with nonsense.
    nav = F.when(F.col("nav") > 0, F.col("nav")).otherwise(F.raise_error(F.format_string("book %s is worth nothing %s rows after date %s", "book", "h", "s")))
    return sums.withColumn("nav", nav.cast("double")).withColumns({c: F.col(c) / F.col("nav") for c in _SUMS})


def segment_turnover(held: DataFrame, sums: DataFrame, targets: DataFrame, dates: DataFrame, frequencies: Sequence[int]) -> DataFrame:
    """book, frequency, t: sum of |target - weight before the trade| where a segment of that length ends; first for those without one."""
    steps = F.array(*[F.lit(f) for f in frequencies])
    ending = held.withColumn("frequency", F.explode(steps)).filter(F.size("path") > F.col("frequency"))
    ending = ending.withColumn("value", F.col("w0") * F.element_at("path", F.col("frequency") + 1)["g"])
    navs = sums.select("book", "s", F.col("h").alias("frequency"), "nav")
    sold = ending.join(navs, ["book", "s", "frequency"]).select(
        "book", "frequency", (F.col("s") + F.col("frequency")).alias("t"), "ticker", (-F.col("value") / F.col("nav")).alias("move")
    )
    bought = targets.filter("weight <> 0").join(F.broadcast(dates.select("date", F.col("idx").alias("t"))), "date")
    bought = bought.select("book", F.explode(steps).alias("frequency"), "t", "ticker", F.col("weight").cast("double").alias("move"))
    # Rebalances before the first full segment trade from cash.
    first = bought.filter(F.col("t") < F.col("frequency"))
    later = bought.filter(F.col("t") >= F.col("frequency")).unionByName(sold)
    moves = first.unionByName(later).groupBy("book", "frequency", "t", "ticker").agg(F.sum("move").alias("move"))
    return moves.groupBy("book", "frequency", "t").agg(F.sum(F.abs("move")).alias("turnover"))


def schedules(dates: DataFrame, frequencies: Sequence[int], offsets: Sequence[int] | None = None) -> DataFrame:
    """date, idx, frequency, offset, s and h of every date of every schedule; s and h are null before its first rebalance."""
    pairs = [(f, o) for f in frequencies for o in range(f) if offsets is None or o in offsets]
    listed = F.explode(F.array(*[F.struct(F.lit(f).alias("frequency"), F.lit(o).alias("offset")) for f, o in pairs]))
    rows = dates.select("date", "idx", listed.alias("v")).select("date", "idx", "v.*")
    h = F.when(F.col("idx") >= F.col("offset"), F.pmod(F.col("idx") - F.col("offset"), F.col("frequency")))
    return rows.withColumn("h", h.cast("int")).withColumn("s", (F.col("idx") - F.col("h")).cast("int"))


def grid_backtests(
    panel: DataFrame, targets: DataFrame, returns: str, frequencies: Sequence[int], costs: Sequence[float] = (10.0,), offsets: Sequence[int] | None = None
) -> DataFrame:
    """Daily results of every (book, frequency, offset, cost_bps), as ``target_weight_backtest`` gives for one.

    ``targets`` has book, date, ticker and weight for every usable date on which
    any schedule may rebalance; a date without rows is a rebalance into cash.
    ``offsets`` keeps some offsets of each frequency.
    """
    require_columns(panel, ["date", "ticker", returns], "panel")
    require_columns(targets, ["book", "date", "ticker", "weight"], "targets")
    frequencies = sorted({int(f) for f in frequencies})
    if not frequencies or frequencies[0] < 1:
        raise ValueError("frequencies must be positive")
    costs = [require_rate(c, "cost") for c in costs]
    dates = usable_dates(panel, returns).withColumn("idx", F.col("idx").cast("int"))
    held = _held(targets, dates, kept(growth_paths(panel, returns, frequencies[-1])))
    sums = kept(segment_sums(held))
    turnover = segment_turnover(held, sums, targets, dates, frequencies)
    grid = schedules(dates, frequencies, offsets).crossJoin(F.broadcast(targets.select("book").distinct()))
    rebalanced = F.coalesce(F.col("h") == 0, F.lit(False))
    out = (
        grid.withColumn("is_rebalance", rebalanced)
        .join(sums, ["book", "s", "h"], "left")
        .join(turnover.withColumnRenamed("t", "idx").withColumn("is_rebalance", F.lit(True)), ["book", "frequency", "idx", "is_rebalance"], "left")
    )
    measures = (*_SUMS[1:], "turnover")
    out = out.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in measures})
    out = out.withColumns(
        {
            "gross_return": F.col("long_return") + F.col("short_return"),
            "net_exposure": F.col("long_exposure") - F.col("short_exposure"),
            "gross_exposure": F.col("long_exposure") + F.col("short_exposure"),
        }
    )
    shown = [*VARIANT, "date", "is_rebalance", *measures, "gross_return", "net_exposure", "gross_exposure"]
    return backtest.cost_grid(out.select(*shown), costs, VARIANT)


def grid_summary(daily: DataFrame) -> DataFrame:
    """One row per (book, frequency, offset, cost_bps): return summary with turnover and costs."""
    return backtest.summarise_backtest(daily, "net_return", (*VARIANT, "cost_bps"))


def across_offsets(summary: DataFrame, values: Sequence[str] = ("annualised_return", "sharpe_ratio", "maximum_drawdown")) -> DataFrame:
    """Per book, frequency and cost: how much the choice of the offset matters.

    Means keep 12 digits, so that the order of summation does not decide a tie of later rounding.
    """
    aggregates = [F.count("*").alias("offsets")]
    for v in values:
        aggregates += [F.round(F.avg(v), 12).alias(f"mean_{v}"), F.min(v).alias(f"min_{v}"), F.max(v).alias(f"max_{v}"), F.stddev_samp(v).alias(f"std_{v}")]
    return summary.groupBy("book", "frequency", "cost_bps").agg(*aggregates)


def intensity_blends(sleeves: DataFrame, allocations: DataFrame, intensities: Sequence[float], first: str, second: str) -> DataFrame:
    """Targets of two sleeves blended at 0.5 + intensity * (allocation - 0.5), one book per intensity.

    ``sleeves`` has sleeve, date, ticker and weight, ``allocations`` date and
    allocation (of the first sleeve); a date without an allocation is split evenly.
    """
    label = lambda x: f"intensity {x:g}"
    listed = F.explode(F.array(*[F.struct(F.lit(label(x)).alias("book"), F.lit(float(x)).alias("x")) for x in intensities]))
    rows = sleeves.join(allocations.select("date", "allocation"), "date", "left").withColumn("v", listed)
    share: Column = 0.5 + F.col("v.x") * (F.coalesce("allocation", F.lit(0.5)) - 0.5)
    part = F.when(F.col("sleeve") == first, share).when(F.col("sleeve") == second, 1 - share)
    return rows.groupBy(F.col("v.book").alias("book"), "date", "ticker").agg(F.sum(F.col("weight") * part).alias("weight"))
