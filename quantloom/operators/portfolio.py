"""Target weights: quantile books, composites, sleeve blends, allocations."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.stats import PERIODS, TOLERANCE
from quantloom.functions.windows import frame, ordered
from quantloom.operators.constraints import enforce, finite
from quantloom.operators.cross_section import DATE, SLOT, add_quantiles, spread_dates
from quantloom.operators.validation import date_index


def usable_dates(panel: DataFrame, returns: str) -> DataFrame:
    """Dates with any return, with idx."""
    return date_index(panel.filter(F.col(returns).isNotNull()))


def rebalance_dates(dates: DataFrame, frequency: int, offset: int = 0) -> DataFrame:
    """Every ``frequency``-th date from ``offset`` (dates with idx)."""
    if frequency < 1 or not 0 <= offset < frequency:
        raise ValueError("offset must lie in [0, frequency)")
    return dates.filter((F.col("idx") >= offset) & ((F.col("idx") - offset) % frequency == 0))


def book_weights(
    panel: DataFrame, factor: str, quantiles=5, long=5, short=1, long_gross=1.0, short_gross=1.0, least=30
) -> DataFrame:
    """date, ticker, weight: equal weights in the long and short buckets, 0 elsewhere and on thin dates."""
    keys = (SLOT, *DATE)
    by = Window.partitionBy(*keys)
    q = F.col("quantile")
    longs, shorts = F.count_if(q == long).over(by), F.count_if(q == short).over(by)
    both = (longs > 0) & (shorts > 0)
    weight = F.when(both & (q == long), long_gross / longs).when(both & (q == short), -short_gross / shorts).otherwise(0.0)
    return add_quantiles(spread_dates(panel.select("date", "ticker", factor)), factor, quantiles, least, keys=keys).select(
        "date", "ticker", weight.alias("weight")
    )


def factor_targets(panel: DataFrame, factor: str, returns: str, frequency: int, offset: int = 0, **book) -> DataFrame:
    """Target weights of a factor book on its rebalance dates."""
    chosen = rebalance_dates(usable_dates(panel, returns), frequency, offset)
    # Their number is that of dates; left to estimates, a large panel is shuffled to meet them.
    return book_weights(panel.join(F.broadcast(chosen.select("date")), "date", "left_semi"), factor, **book)


def composite_score(weights: Mapping[str, float]) -> Column:
    """Weighted sum of factor columns; null unless all are there."""
    if any(w < 0 for w in weights.values()) or not math.isclose(sum(weights.values()), 1.0):
        raise ValueError("factor weights must not be negative and must sum to 1")
    return reduce(lambda a, b: a + b, [F.lit(float(w)) * F.col(c) for c, w in weights.items()])


def combine_sleeves(sleeves: Mapping[str, DataFrame], allocations: Mapping[str, float]) -> DataFrame:
    """Sum of allocation times weight per date and ticker."""
    if set(sleeves) != set(allocations) or not math.isclose(sum(allocations.values()), 1.0):
        raise ValueError("allocations must name every sleeve and sum to 1")
    parts = [df.select("date", "ticker", (F.col("weight") * allocations[k]).alias("weight")) for k, df in sleeves.items()]
    return reduce(DataFrame.unionByName, parts).groupBy("date", "ticker").agg(F.sum("weight").alias("weight"))


def combine_dated_sleeves(sleeves: Mapping[str, DataFrame], allocations: DataFrame) -> DataFrame:
    """The same with allocations (date, sleeve, allocation) that change; a date without one stops the job."""
    parts = [df.select("date", "ticker", "weight", F.lit(k).alias("sleeve")) for k, df in sleeves.items()]
    rows = reduce(DataFrame.unionByName, parts).join(allocations.select("date", "sleeve", "allocation"), ["date", "sleeve"], "left")
    rows = enforce(rows, {"an allocation is missing or not finite": finite("allocation", False)}, "allocations", ["date", "sleeve"])
    return rows.groupBy("date", "ticker").agg(F.sum(F.col("weight") * F.col("allocation")).alias("weight"))


def rescale_gross(targets: DataFrame, gross: float | str, tolerance: float = TOLERANCE) -> DataFrame:
    """Scale each date to a gross exposure; dates without exposure stay flat."""
    total = F.sum(F.abs("weight")).over(Window.partitionBy("date"))
    wanted = F.col(gross) if isinstance(gross, str) else F.lit(float(gross))
    return targets.withColumn("weight", F.when(total > tolerance, F.col("weight") * wanted / total).otherwise(0.0))


def trailing_volatility(sleeves: DataFrame, lookback=63, least=42, periods: int = PERIODS) -> DataFrame:
    """Volatility of each sleeve's rows before the current one (date, sleeve, value)."""
    rows = frame(ordered(("sleeve",)), lookback, 1)
    value = F.when(F.count("value").over(rows) >= least, F.stddev_samp("value").over(rows) * math.sqrt(periods))
    return sleeves.withColumn("volatility", value)


def inverse_volatility_allocations(
    sleeves: DataFrame, rebalances: DataFrame, lookback=63, least=42, periods: int = PERIODS
) -> DataFrame:
    """date, sleeve, allocation on rebalance dates, from joint history strictly before each date.

    Returns and rebalance dates share a timeline; the frame counts only dates on
    which every sleeve has a return.  Too little history or no variation gives
    equal weights.
    """
    names = Window.partitionBy("date")
    count = sleeves.select("sleeve").distinct().count()
    joint = (
        sleeves.withColumn("_n", F.count("value").over(names))
        .filter(F.col("_n") == count)
        .select("date", "sleeve", "value", F.lit(False).alias("asked"))
    )
    asked = rebalances.select("date").distinct().crossJoin(sleeves.select("sleeve").distinct())
    timeline = joint.unionByName(asked.select("date", "sleeve", F.lit(None).cast("double").alias("value"), F.lit(True).alias("asked")))
    # A question sorts before the same date's return, so only earlier returns count.
    order = Window.partitionBy("sleeve").orderBy("date", F.desc("asked"))
    seen = F.sum(F.when(F.col("asked"), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    placed = timeline.withColumn("k", seen)
    history = Window.partitionBy("sleeve").orderBy("k").rangeBetween(-(lookback - 1), 0)
    returned = F.when(~F.col("asked"), F.col("value"))
    measured = placed.withColumns({"n": F.count(returned).over(history), "sd": F.stddev_samp(returned).over(history)})
    rows = measured.filter("asked").withColumn(
        "inverse", F.when((F.col("n") >= least) & (F.col("sd") > 0), 1 / (F.col("sd") * math.sqrt(periods)))
    )
    usable = F.count("inverse").over(names) == count
    return rows.select(
        "date", "sleeve", F.when(usable, F.col("inverse") / F.sum("inverse").over(names)).otherwise(1.0 / count).alias("allocation")
    )


def floored_inverse_volatility(volatilities: Sequence[str], floor: float = 0.2, least: float = 1e-8) -> list[Column]:
    """floor + (1 - k floor) times the inverse-volatility share of each column."""
    k = len(volatilities)
    if not 0 <= floor <= 1 / k:
        raise ValueError("floor must lie in [0, 1/k]")
    inverse = [1 / F.greatest(F.col(c), F.lit(least)) for c in volatilities]
    total = reduce(lambda a, b: a + b, inverse)
    return [F.lit(floor) + (1 - k * floor) * x / total for x in inverse]


def minimum_variance_pair(va: Column, vb: Column, cov: Column) -> Column:
    """Long-only weight of the first of two assets with the least variance; 1/2 if it is undefined."""
    spread = va + vb - 2 * cov
    weight = F.try_divide(vb - cov, F.when(spread > TOLERANCE, spread))
    return F.when(weight.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), weight))).otherwise(0.5)


def maximum_sharpe_pair(ma: Column, mb: Column, va: Column, vb: Column, cov: Column) -> Column:
    """Long-only weight of the first asset with the best Sharpe among both ends and the tangency."""
    top, bottom = ma * vb - mb * cov, mb * va - ma * cov
    tangency = F.try_divide(top, F.when(F.abs(top + bottom) > TOLERANCE, top + bottom))
    tangency = F.when((tangency >= 0) & (tangency <= 1), tangency)

    def ratio(w):
        variance = w * w * va + (1 - w) * (1 - w) * vb + 2 * w * (1 - w) * cov
        return F.try_divide(w * ma + (1 - w) * mb, F.when(variance > TOLERANCE, F.sqrt(variance)))

    options = [(F.lit(0.0), ratio(F.lit(0.0))), (F.lit(1.0), ratio(F.lit(1.0))), (tangency, ratio(tangency))]
    best = F.greatest(*[s for _, s in options])
    out = F.lit(0.5)
    for w, s in options:
        out = F.when(s == best, w).otherwise(out)
    return out


def pair_moments(pairs: DataFrame, a: str, b: str, lookback: int = 252, least: int = 126) -> DataFrame:
    """mean_a, mean_b, var_a, var_b, cov over joint rows before each date."""
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    rows = frame(Window.orderBy("date"), lookback, 1)
    x, y = F.when(both, F.col(a)), F.when(both, F.col(b))
    enough = F.count(x).over(rows) >= least
    columns = {
        "mean_a": F.avg(x),
        "mean_b": F.avg(y),
        "var_a": F.var_samp(x),
        "var_b": F.var_samp(y),
        "cov": F.covar_samp(x, y),
    }
    return pairs.withColumns({k: F.when(enough, v.over(rows)) for k, v in columns.items()})


def risk_shares(wa: Column, wb: Column, va: Column, vb: Column, cov: Column) -> tuple[Column, Column]:
    """Shares of a two-asset portfolio's variance."""
    total = wa * wa * va + wb * wb * vb + 2 * wa * wb * cov
    total = F.when(total > TOLERANCE, total)
    return F.try_divide(wa * (wa * va + wb * cov), total), F.try_divide(wb * (wb * vb + wa * cov), total)


def shrunk(weight: Column, intensity: float) -> Column:
    """A two-asset weight pulled towards one half."""
    return 0.5 + intensity * (weight - 0.5)


def floored(weights: Sequence[Column], floor: float) -> list[Column]:
    """Raise weights to the floor and scale the others down, as often as there are weights."""
    current = [w / reduce(lambda a, b: a + b, weights) for w in weights]
    fixed = [F.lit(False)] * len(current)
    for _ in current:
        fixed = [f | (w < floor) for f, w in zip(fixed, current, strict=True)]
        free = reduce(lambda a, b: a + b, [F.when(f, 0.0).otherwise(w) for f, w in zip(fixed, current, strict=True)])
        room = 1 - floor * reduce(lambda a, b: a + b, [f.cast("int") for f in fixed])
        current = [F.when(f, F.lit(floor)).otherwise(F.try_divide(w * room, free)) for f, w in zip(fixed, current, strict=True)]
    return current
