"""Ordinary least squares by moments, with heteroskedasticity- and autocorrelation-robust errors."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.functions.stats import PERIODS
from quantloom.functions.windows import ordered


def ols(df: DataFrame, y: str, x: str, keys: Sequence[str] = ()) -> DataFrame:
    """alpha, beta, r_squared and observations over joint rows."""
    both = df.filter(F.col(y).isNotNull() & F.col(x).isNotNull())
    sums = both.groupBy(*keys).agg(
        F.count("*").alias("observations"), F.avg(y).alias("_y"), F.avg(x).alias("_x"),
        F.var_pop(y).alias("_vy"), F.var_pop(x).alias("_vx"), F.covar_pop(y, x).alias("_c"),
    )
    beta = F.try_divide(F.col("_c"), F.when(F.col("_vx") > 0, F.col("_vx")))
    spread = F.col("_vx") * F.col("_vy")
    return sums.select(
        *keys,
        "observations",
        (F.col("_y") - beta * F.col("_x")).alias("alpha"),
        beta.alias("beta"),
        F.try_divide(F.col("_c") * F.col("_c"), F.when(spread > 0, spread)).alias("r_squared"),
    )


def hac_ols(df: DataFrame, y: str, x: str, lags: int = 5, keys: Sequence[str] = ()) -> DataFrame:
    """OLS with Newey-West errors: Bartlett weights 1 - l / (lags + 1), no small-sample factor.

    With z = (u, x u) per row, the middle of the sandwich is the weighted sum of
    the products of z with its lags; all of it is sums of columns.
    """
    rows = df.filter(F.col(y).isNotNull() & F.col(x).isNotNull())
    fit = ols(rows, y, x, keys)
    joined = rows.join(fit, list(keys)) if keys else rows.crossJoin(F.broadcast(fit))
    u = F.col(y) - F.col("alpha") - F.col("beta") * F.col(x)
    staged = joined.withColumns({"_u": u, "_v": u * F.col(x)})
    spec = ordered(keys)
    terms = {"_s00": F.col("_u") * F.col("_u"), "_s01": F.col("_u") * F.col("_v"), "_s11": F.col("_v") * F.col("_v")}
    for k in range(1, lags + 1):
        weight = 1 - k / (lags + 1)
        pu, pv = F.coalesce(F.lag("_u", k).over(spec), F.lit(0.0)), F.coalesce(F.lag("_v", k).over(spec), F.lit(0.0))
        terms["_s00"] = terms["_s00"] + 2 * weight * F.col("_u") * pu
        terms["_s01"] = terms["_s01"] + weight * (F.col("_u") * pv + F.col("_v") * pu)
        terms["_s11"] = terms["_s11"] + 2 * weight * F.col("_v") * pv
    staged = staged.withColumns(terms)
    group = (*keys, "observations", "alpha", "beta", "r_squared")
    sums = staged.groupBy(*group).agg(
        F.sum("_s00").alias("a"), F.sum("_s01").alias("b"), F.sum("_s11").alias("c"), F.sum(x).alias("sx"), F.sum(F.col(x) * F.col(x)).alias("sxx")
    )
    n, sx, sxx = F.col("observations").cast("double"), F.col("sx"), F.col("sxx")
    det = n * sxx - sx * sx
    # Rows of the inverse of X'X times the middle times its columns.
    va = (sxx * sxx * F.col("a") - 2 * sxx * sx * F.col("b") + sx * sx * F.col("c")) / (det * det)
    vb = (sx * sx * F.col("a") - 2 * sx * n * F.col("b") + n * n * F.col("c")) / (det * det)
    return sums.select(
        *group,
        F.sqrt(va).alias("alpha_error"),
        F.sqrt(vb).alias("beta_error"),
        F.try_divide(F.col("alpha"), F.sqrt(va)).alias("alpha_t"),
        F.try_divide(F.col("beta"), F.sqrt(vb)).alias("beta_t"),
    )


def market_diagnostics(df: DataFrame, y: str, x: str, keys: Sequence[str] = (), periods: int = PERIODS) -> DataFrame:
    """OLS with annualised alpha, tracking error and information ratio of y against x."""
    gap = F.col(y) - F.col(x)
    active = df.filter(F.col(y).isNotNull() & F.col(x).isNotNull()).groupBy(*keys).agg(
        (F.stddev_samp(gap) * math.sqrt(periods)).alias("tracking_error"),
        F.try_divide(F.avg(gap), F.when(F.stddev_samp(gap) > 0, F.stddev_samp(gap))).alias("_ratio"),
    )
    fit = ols(df, y, x, keys)
    out = fit.join(active, list(keys)) if keys else fit.crossJoin(F.broadcast(active))
    return out.withColumn("annualised_alpha", F.col("alpha") * periods).withColumn("information_ratio", F.col("_ratio") * math.sqrt(periods)).drop("_ratio")
