"""Per-date operators: winsorise, standardise, rank, neutralise, bucket, residualise."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.stats import average_rank, clipped, equal_bucket, rank_share

DATE = ("date",)
#: Tasks that dates are dealt to, a prime: dates that are weeks or months apart get different numbers.
SLOTS = 211
SLOT = "_slot"


def add_winsorised(panel: DataFrame, factors: Mapping[str, str], low: float = 0.01, high: float = 0.99, keys: Sequence[str] = DATE) -> DataFrame:
    """For raw -> prefix: <prefix>_winsorised, the raw value held between two of its date's percentiles."""
    by = Window.partitionBy(*keys)
    # Both bounds of a factor come from one pass over its values.
    bounds = {f"_{p}_bounds": F.percentile(raw, F.array(F.lit(low), F.lit(high))).over(by) for raw, p in factors.items()}
    panel = panel.withColumns(bounds)
    ends = {p: [F.get(f"_{p}_bounds", F.lit(i)) for i in (0, 1)] for p in factors.values()}
    return panel.withColumns({f"{p}_winsorised": clipped(F.col(raw), *ends[p]) for raw, p in factors.items()}).drop(*bounds)


def zscore(value: str, keys: Sequence[str] = DATE, sample: bool = False, least: int = 1) -> Column:
    """Deviation from the mean in standard deviations; null where they are 0 or values are few."""
    by = Window.partitionBy(*keys)
    sd = (F.stddev_samp if sample else F.stddev_pop)(value).over(by)
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    return F.when(known & (F.count(value).over(by) >= least) & (sd > 0), (F.col(value) - F.avg(value).over(by)) / sd)


def spread_dates(panel: DataFrame) -> DataFrame:
    """``panel`` dealt to tasks by ``SLOT``, a number of the date: a task gets about one date of a year of them.

    Hashed dates collide, and small shuffles are merged to a task a core; sorted
    cross-sections of many dates would then be in one task's memory.  Windows
    over (SLOT, date) need no other shuffle.
    """
    number = F.coalesce(F.pmod(F.unix_date(F.col("date").cast("date")), F.lit(SLOTS)), F.lit(0))
    return panel.withColumn(SLOT, number).repartitionById(SLOTS, F.col(SLOT))


def process_factors(panel: DataFrame, factors: Mapping[str, str], low: float = 0.01, high: float = 0.99) -> DataFrame:
    """For raw -> prefix: <prefix>_winsorised, <prefix>_z and <prefix>_rank (share of average rank)."""
    keys = (SLOT, *DATE)
    panel = spread_dates(panel)
    panel = add_winsorised(panel, factors, low, high, keys)
    panel = panel.withColumns({f"{p}_z": zscore(f"{p}_winsorised", keys) for p in factors.values()})
    # One factor after the other: the windows of a rank then share one sort.
    for p in factors.values():
        panel = panel.withColumn(f"{p}_rank", rank_share(f"{p}_winsorised", keys))
    return panel.drop(SLOT)


def add_sector_neutral(panel: DataFrame, factor: str, output: str, sector: str = "sector", least: int = 3) -> DataFrame:
    return panel.withColumn(output, zscore(factor, ("date", sector), least=least))


def add_quantiles(panel: DataFrame, factor: str, quantiles: int = 5, least: int | None = None, output="quantile", keys: Sequence[str] = DATE) -> DataFrame:
    """Bucket 1..quantiles per date, ties by ticker; null with fewer than ``least`` (2 per bucket) values."""
    least = 2 * quantiles if least is None else least
    return panel.withColumn(output, equal_bucket(factor, keys, quantiles, ("ticker",), least))


def tercile(value: str) -> Column:
    """1..3 by right-closed thirds of the rank share."""
    share = rank_share(value, DATE)
    return F.when(share.isNotNull(), F.when(share <= 1 / 3, 1).when(share <= 2 / 3, 2).otherwise(3))


def ceiling_quintile(value: str) -> Column:
    """1..5 as the ceiling of five times the rank share, another bucketing than ``add_quantiles``."""
    return F.least(F.lit(5), F.greatest(F.lit(1), F.ceil(rank_share(value, DATE) * 5))).cast("int")


def residualised(panel: DataFrame, target: str, control: str, output: str, least: int = 30, ranks: bool = False) -> DataFrame:
    """Residual of a per-date regression of target on control, standardised (sample deviation).

    With ``ranks`` both sides are first replaced by standardised rank shares.
    """
    both = F.col(target).isNotNull() & F.col(control).isNotNull()
    staged = panel.withColumns({"_y": F.when(both, F.col(target)), "_x": F.when(both, F.col(control))})
    if ranks:
        staged = staged.withColumns({"_yr": average_rank("_y", DATE), "_xr": average_rank("_x", DATE)})
        staged = staged.withColumns({"_y": zscore("_yr"), "_x": zscore("_xr")}).drop("_yr", "_xr")
    by = Window.partitionBy(*DATE)
    var = F.var_pop("_x").over(by)
    slope = F.when((F.count("_x").over(by) >= least) & (var > 0), F.covar_pop("_y", "_x").over(by) / var)
    staged = staged.withColumn("_slope", slope)
    centred = F.col("_y") - F.avg("_y").over(by) - F.col("_slope") * (F.col("_x") - F.avg("_x").over(by))
    staged = staged.withColumn("_residual", centred)
    value = F.col("_residual") if ranks else zscore("_residual", sample=True)
    return staged.withColumn(output, value).drop("_x", "_y", "_slope", "_residual")
