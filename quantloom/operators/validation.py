"""Signal validation: information coefficients, quantile returns, stability and health."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.stats import TOLERANCE, average_rank, middle, pearson
from quantloom.functions.windows import ordered, rolling
from quantloom.operators.cross_section import SLOT, add_quantiles, spread_dates


def date_index(df: DataFrame, keys: Sequence[str] = (), date: str = "date") -> DataFrame:
    """Distinct dates with ``idx`` from 0 in order (per key): a small dimension."""
    return df.select(*keys, date).distinct().withColumn("idx", F.row_number().over(Window.partitionBy(*keys).orderBy(date)) - 1)


def daily_ic(
    panel: DataFrame,
    factor: str,
    forward: str,
    method: str = "spearman",
    least: int = 20,
    keys: Sequence[str] = ("date",),
) -> DataFrame:
    """Per date: ic over rows with both values (null below ``least`` of them) and observations."""
    both = F.col(factor).isNotNull() & F.col(forward).isNotNull()
    pairs = panel.select(*keys, F.when(both, F.col(factor)).alias("x"), F.when(both, F.col(forward)).alias("y"))
    if method == "spearman":
        pairs = pairs.withColumns({"xr": average_rank("x", keys), "yr": average_rank("y", keys)})
        pairs = pairs.select(*keys, F.col("xr").alias("x"), F.col("yr").alias("y"))
    elif method != "pearson":
        raise ValueError("method must be spearman or pearson")
    n = F.count("x")
    return pairs.groupBy(*keys).agg(F.when(n >= least, pearson("x", "y")).alias("ic"), n.alias("observations"))


def summarise_ic(ics: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Count, mean, deviation, information ratio, t statistic and positive share of ICs."""
    n, mean, sd = F.count("ic"), F.avg("ic"), F.stddev_samp("ic")
    varies = (n > 1) & (sd > 0)
    return ics.groupBy(*keys).agg(
        n.alias("observations"),
        mean.alias("mean_ic"),
        sd.alias("std_ic"),
        F.when(varies, F.try_divide(mean, sd)).alias("information_ratio"),
        F.when(varies, F.try_divide(mean, sd / F.sqrt(n))).alias("t_statistic"),
        F.avg((F.col("ic") > 0).cast("int")).alias("positive_fraction"),
    )


def quantile_returns(panel: DataFrame, factor: str, forward: str, quantiles: int = 5, least: int | None = None) -> DataFrame:
    """Mean forward return and count per date and bucket."""
    return (
        add_quantiles(panel, factor, quantiles, least)
        .filter(F.col("quantile").isNotNull() & F.col(forward).isNotNull())
        .groupBy("date", "quantile")
        .agg(F.avg(forward).alias("mean_return"), F.count("*").alias("observations"))
    )


def long_short_spread(returns: DataFrame, top: int = 5, bottom: int = 1) -> DataFrame:
    """Top bucket's return less the bottom's per date; null where one is missing."""
    return returns.groupBy("date").agg(
        (
            F.max(F.when(F.col("quantile") == top, F.col("mean_return")))
            - F.max(F.when(F.col("quantile") == bottom, F.col("mean_return")))
        ).alias("spread")
    )


def _unpivot(panel: DataFrame, ids: Sequence[str], columns: Mapping[str, str], name: str, value: str) -> DataFrame:
    """Columns label -> column as rows (name, value)."""
    packed = F.array(*[F.struct(F.lit(k).alias(name), F.col(c).cast("double").alias(value)) for k, c in columns.items()])
    return panel.select(*ids, F.explode(packed).alias("_r")).select(*ids, f"_r.{name}", f"_r.{value}")


def ic_by_horizon(panel: DataFrame, factor: str, forwards: Sequence[str], method="spearman", least=20) -> DataFrame:
    rows = _unpivot(panel, ["date", factor], {f: f for f in forwards}, "horizon", "forward")
    return summarise_ic(daily_ic(rows, factor, "forward", method, least, ("horizon", "date")), ("horizon",))


def _periods(spark, periods: Mapping[str, tuple[str, str]]) -> DataFrame:
    rows = [(k, a, b) for k, (a, b) in periods.items()]
    return spark.createDataFrame(rows, "period string, first string, last string").select(
        "period", F.col("first").cast("date").alias("first"), F.col("last").cast("date").alias("last")
    )


def in_periods(df: DataFrame, periods: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Rows with each period (both ends included) that holds their date.  The periods are a caller's short list."""
    named = F.filter(
        F.array(*[F.when(F.col("date").between(F.lit(a).cast("date"), F.lit(b).cast("date")), F.lit(k)) for k, (a, b) in periods.items()]),
        lambda x: x.isNotNull(),
    )
    return df.withColumn("period", F.explode(named))


def subperiod_ic(panel: DataFrame, factor: str, forward: str, periods, method="spearman", least=20) -> DataFrame:
    return summarise_ic(in_periods(daily_ic(panel, factor, forward, method, least), periods), ("period",))


def every_nth_date(df: DataFrame, step: int, offset: int = 0) -> DataFrame:
    """Rows on every ``step``-th distinct date from ``offset``."""
    dates = date_index(df).filter((F.col("idx") >= offset) & ((F.col("idx") - offset) % step == 0))
    return df.join(dates.select("date"), "date", "left_semi")


def non_overlapping_ic(panel: DataFrame, factor: str, forward: str, horizon: int, method="spearman", least=20) -> DataFrame:
    """IC summaries of the ``horizon`` samples of every horizon-th date, one per offset, in one pass."""
    ics = daily_ic(panel, factor, forward, method, least).join(date_index(panel), "date")
    return summarise_ic(ics.withColumn("offset", F.col("idx") % horizon), ("offset",))


def rolling_ic(ics: DataFrame, window: int = 63, least: int | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """Rolling mean over all IC rows; null ICs count as missing."""
    need = window // 2 if least is None else least
    return ics.withColumn("rolling_ic", rolling(F.avg, "ic", ordered(keys), window, need))


def _past(score: str, lag: int, keys: Sequence[str] = ()) -> Column:
    """The score of the same ticker ``lag`` dates before (rows with idx); null without that row."""
    rows = Window.partitionBy(*keys, "ticker").orderBy("idx").rangeBetween(-lag, -lag)
    return F.when(F.col("ticker").isNotNull(), F.max(score).over(rows))


def rank_stability(panel: DataFrame, score: str, lags: Sequence[int] = (1, 21), least: int = 30, keys: Sequence[str] = ()) -> DataFrame:
    """Spearman correlation of scores with those ``lag`` dates before, over tickers that have both; one row per date and ticker."""
    base = panel.select(*keys, "date", "ticker", score).join(F.broadcast(date_index(panel, keys)), [*keys, "date"])
    packed = F.array(*[F.struct(F.lit(x).alias("lag"), _past(score, x, keys).alias("past")) for x in lags])
    pairs = base.withColumn("_p", packed).select(*keys, "date", score, F.explode("_p").alias("_p")).select(*keys, "date", score, "_p.*")
    by = (*keys, "lag", "date")
    return daily_ic(pairs, score, "past", "spearman", least, by).select(
        *by, F.col("ic").alias("rank_stability"), F.col("observations").alias("overlap")
    )


def factor_dependence(panel: DataFrame, a: str, b: str, least=30, window=252, need=126) -> DataFrame:
    """Daily rank correlation of two factors and its rolling mean over all rows."""
    daily = daily_ic(panel, a, b, "spearman", least).select("date", F.col("ic").alias("rank_correlation"), "observations")
    return daily.withColumn(f"rolling_correlation_{window}", rolling(F.avg, "rank_correlation", ordered(()), window, need))


def signal_health(
    panel: DataFrame,
    factors: Mapping[str, tuple[str, str]],
    forward: str,
    least: int = 30,
    window: int = 252,
    need: int = 126,
    lags: Sequence[int] = (1, 21),
) -> DataFrame:
    """Per factor and date: coverage, IC, rolling IC over valid ICs, rank stability, dispersion ratio.

    ``factors`` maps a name to its score and raw columns.  All factors go through
    the same stages with the factor as a key.
    """
    names = {k: (f"_s{i}", f"_r{i}") for i, k in enumerate(factors)}
    columns = [F.col(c).cast("double").alias(n) for k in factors for c, n in zip(factors[k], names[k], strict=True)]
    wide = panel.select("date", "ticker", F.col(forward).alias("forward"), *columns).join(F.broadcast(date_index(panel)), "date")
    # Rows of a ticker lie together once for all scores and lags, and rows of a date once for all ranks and counts.
    again = F.lag("idx").over(Window.partitionBy("ticker").orderBy("idx")) == F.col("idx")
    entry = F.col("ticker").isNotNull() & ~F.coalesce(again, F.lit(False))
    wide = wide.withColumns({"_entry": entry} | {f"{s}_{x}": _past(s, x) for s, _ in names.values() for x in lags})
    packed = F.array(
        *[
            F.struct(F.lit(k).alias("factor"), F.col(s).alias("score"), F.col(r).alias("raw"), *[F.col(f"{s}_{x}").alias(f"past_{x}") for x in lags])
            for k, (s, r) in names.items()
        ]
    )
    rows = spread_dates(wide).select(SLOT, "date", "_entry", "forward", F.explode(packed).alias("f")).select(SLOT, "date", "_entry", "forward", "f.*")
    by = (SLOT, "factor", "date")
    others = {"daily_ic": "forward"} | {f"rank_stability_{x}": f"past_{x}" for x in lags}
    for name, other in others.items():
        both = F.col("score").isNotNull() & F.col(other).isNotNull()
        rows = rows.withColumns({f"{name}_x": F.when(both, F.col("score")), f"{name}_y": F.when(both, F.col(other))})
        rows = rows.withColumns({f"{name}_{side}r": average_rank(f"{name}_{side}", by) for side in "xy"})
    out = rows.groupBy(*by).agg(
        F.count_if("_entry").alias("universe_observations"),
        F.count("score").alias("signal_observations"),
        F.count("daily_ic_x").alias("paired_observations"),
        F.percentile("raw", F.array(*[F.lit(q) for q in (0.25, 0.5, 0.75)])).alias("_q"),
        *[F.when(F.count(f"{n}_x") >= least, pearson(f"{n}_xr", f"{n}_yr")).alias(n) for n in others],
    )
    out = out.withColumns({f"{n}_raw": F.get("_q", F.lit(i)) for i, n in enumerate(("q25", "median", "q75"))})
    out = out.withColumns(
        {
            "signal_coverage": F.try_divide(F.col("signal_observations"), F.col("universe_observations")),
            "iqr_raw": F.col("q75_raw") - F.col("q25_raw"),
        }
    )
    # The rolling mean is over valid ICs only, which lie in a partition of their own.
    valid = F.col("daily_ic").isNotNull()
    mean = F.when(valid, rolling(F.avg, "daily_ic", Window.partitionBy("factor", valid).orderBy("date"), window, need))
    usual = rolling(middle, "iqr_raw", ordered(("factor",)), window, need, skip=1)
    out = out.withColumns({f"rolling_mean_ic_{window}": mean, "_usual": usual})
    out = out.withColumn("dispersion_ratio", F.when(F.col("_usual") > TOLERANCE, F.col("iqr_raw") / F.col("_usual")))
    counts = [f"{n}_observations" for n in ("universe", "signal", "paired")]
    stable = [f"rank_stability_{x}" for x in lags]
    return out.select(
        "factor", "date", *counts, "q25_raw", "median_raw", "q75_raw", "signal_coverage", "iqr_raw", "daily_ic", f"rolling_mean_ic_{window}", *stable, "dispersion_ratio"
    )
