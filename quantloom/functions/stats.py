"""Cross-sectional and summary statistics as column expressions."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

TOLERANCE = 1e-12
PERIODS = 252


def average_rank(value: str, keys: Sequence[str]) -> Column:
    """Rank from 1 with ties averaged; null for a null value."""
    by = Window.partitionBy(*keys, F.col(value).isNull()).orderBy(value)
    # First and last place among ties come from one window.
    last = F.count("*").over(by.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    return F.when(F.col(value).isNotNull(), (F.rank().over(by) + last) / 2)


def rank_share(value: str, keys: Sequence[str]) -> Column:
    """Average rank over the number of values present."""
    return average_rank(value, keys) / F.count(value).over(Window.partitionBy(*keys))


def equal_bucket(value: str, keys: Sequence[str], buckets: int, tie: Sequence[str], least: int) -> Column:
    """Bucket 1..buckets by cutting first-come ranks at equally spaced quantiles; null below ``least`` values.

    Rank r of n falls in bucket ceil((r - 1) * buckets / (n - 1)), at least 1,
    which is where right-closed cuts at 1 + (n - 1) k / buckets put it.
    """
    present = F.col(value).isNull()
    place = F.row_number().over(Window.partitionBy(*keys, present).orderBy(value, *tie))
    n = F.count(value).over(Window.partitionBy(*keys))
    cut = F.floor(((place - 1) * buckets + n - 2) / F.greatest(n - 1, F.lit(1)))
    return F.when(F.col(value).isNotNull() & (n >= least), F.greatest(F.lit(1), cut).cast("int"))


def pearson(x: Column | str, y: Column | str) -> Column:
    """Correlation; null instead of an error when a side does not vary."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (x, y))
    both = x.isNotNull() & y.isNotNull()
    sd = F.stddev_pop(F.when(both, x)) * F.stddev_pop(F.when(both, y))
    return F.try_divide(F.covar_pop(x, y), F.when(sd > 0, sd))


def pearson_over(x: Column, y: Column, rows, need: int) -> Column:
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    sd = F.stddev_pop(a).over(rows) * F.stddev_pop(b).over(rows)
    return F.when(F.count(a).over(rows) >= need, F.try_divide(F.covar_pop(a, b).over(rows), F.when(sd > TOLERANCE**2, sd)))


def middle(value: Column | str, share: float = 0.5) -> Column:
    """Exact percentile with linear interpolation."""
    return F.percentile(value, F.lit(share))


def clipped(value: Column, low: Column | None = None, high: Column | None = None) -> Column:
    """Value within bounds; a null value stays null."""
    out = value
    if low is not None:
        out = F.greatest(out, low)
    if high is not None:
        out = F.least(out, high)
    return F.when(value.isNotNull(), out)


def compound(returns: Column | str) -> Column:
    returns = F.col(returns) if isinstance(returns, str) else returns
    return F.product(1 + returns) - 1


def annual_return(returns: Column | str, periods: int = PERIODS) -> Column:
    returns = F.col(returns) if isinstance(returns, str) else returns
    growth = F.product(1 + returns)
    return F.when(growth > 0, F.pow(growth, F.lit(float(periods)) / F.count(returns)) - 1)


def annual_volatility(returns: Column | str, periods: int = PERIODS) -> Column:
    return F.stddev_samp(returns) * math.sqrt(periods)


def sharpe(returns: Column | str, periods: int = PERIODS) -> Column:
    sd = F.stddev_samp(returns)
    return F.avg(returns) / F.when(sd > TOLERANCE, sd) * math.sqrt(periods)


def downside(returns: Column | str, periods: int = PERIODS) -> Column:
    returns = F.col(returns) if isinstance(returns, str) else returns
    low = F.when(returns.isNotNull(), F.least(returns, F.lit(0.0)))
    return F.sqrt(F.avg(low * low) * periods)


def top_share(value: Column | str, k: int, where: Column | None = None) -> Column:
    """Share of the k largest values in their sum."""
    value = F.col(value) if isinstance(value, str) else value
    if where is not None:
        value = F.when(where, value)
    ranked = F.slice(F.sort_array(F.collect_list(value), asc=False), 1, k)
    total = F.sum(value)
    return F.try_divide(F.aggregate(ranked, F.lit(0.0), lambda a, x: a + x), total)


def effective_count(value: Column | str) -> Column:
    """1 / sum of squared shares."""
    value = F.col(value) if isinstance(value, str) else value
    return F.try_divide(F.pow(F.sum(value), 2), F.sum(value * value))
