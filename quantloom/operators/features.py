"""Returns and raw factors: lag, lead and rolling columns over each ticker's rows."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.functions.stats import PERIODS, TOLERANCE
from quantloom.functions.windows import change, frame, lag, ordered, rolling
from quantloom.operators.constraints import unique_rows

TICKER = ("ticker",)


def return_features(prices: DataFrame) -> DataFrame:
    """ret_1d/5d/21d, forward_ret_1d/5d, dollar_volume and its log, by row lags; a repeated or missing key stops the job."""
    prices = unique_rows(prices, TICKER, name="prices")
    spec = ordered(TICKER)
    out = prices.withColumns(
        {f"ret_{n}d": change("adj_close", n, TICKER) for n in (1, 5, 21)}
        | {f"forward_ret_{n}d": F.try_divide(F.lead("adj_close", n).over(spec), F.col("adj_close")) - 1 for n in (1, 5)}
    )
    if "dollar_volume" not in prices.columns:
        out = out.withColumn("dollar_volume", F.col("close") * F.col("volume"))
    return out.withColumn("log_dollar_volume", F.log1p("dollar_volume"))


def prepare_ohlcv(prices: DataFrame) -> DataFrame:
    """ret_1d, prev_close and open_gap for quality checks, also of prices that break their contract."""
    out = prices.withColumns({"ret_1d": change("adj_close", 1, TICKER), "prev_close": lag("close", 1, TICKER)})
    return out.withColumn("open_gap", F.try_divide(F.col("open"), F.col("prev_close")) - 1) if "open" in prices.columns else out


def momentum(long_lag: int = 252, skip: int = 21):
    """Price ``skip`` rows ago over price ``long_lag`` rows ago, less 1."""
    return F.try_divide(lag("adj_close", skip, TICKER), lag("adj_close", long_lag, TICKER)) - 1


def reversal(rows: int = 21):
    return -change("adj_close", rows, TICKER)


def realised_volatility(window: int = 63, periods: int = PERIODS):
    return rolling(F.stddev_samp, "ret_1d", ordered(TICKER), window) * math.sqrt(periods)


def add_raw_factors(panel: DataFrame, long_lag=252, skip=21, quarter=63, month=21, window=63) -> DataFrame:
    """mom_12_1m_raw, mom_3m_raw, reversal_1m_raw, realised_vol_<window>_raw in one pass per ticker."""
    if "ret_1d" not in panel.columns:
        panel = panel.withColumn("ret_1d", change("adj_close", 1, TICKER))
    return panel.withColumns(
        {
            "mom_12_1m_raw": momentum(long_lag, skip),
            "mom_3m_raw": change("adj_close", quarter, TICKER),
            "reversal_1m_raw": reversal(month),
            f"realised_vol_{window}_raw": realised_volatility(window),
        }
    )


def add_liquidity_factors(panel: DataFrame) -> DataFrame:
    """Amihud illiquidity (21 and 63 rows), log average dollar volume, abnormal volume."""
    spec = ordered(TICKER)
    daily = F.try_divide(F.abs("ret_1d"), F.when(F.col("dollar_volume") > 0, F.col("dollar_volume"))) * 1e6
    logged = F.when(F.col("dollar_volume") > 0, F.log("dollar_volume"))
    staged = panel.withColumns({"illiquidity_1d": daily, "log_volume": logged})
    adv = rolling(F.avg, "dollar_volume", spec, 21, 15)
    return staged.withColumns(
        {
            "amihud_21_raw": rolling(F.avg, "illiquidity_1d", spec, 21, 15),
            "amihud_63_raw": rolling(F.avg, "illiquidity_1d", spec, 63, 42),
            "log_adv_21_raw": F.when(adv > 0, F.log(adv)),
            "abnormal_volume_raw": F.col("log_volume") - rolling(F.avg, "log_volume", spec, 21, 21, skip=1),
        }
    )


def add_risk_adjusted_momentum(panel: DataFrame, window: int = 231, skip: int = 21, least: int = 189) -> DataFrame:
    """12-1 momentum over the volatility of the formation window."""
    spec = ordered(TICKER)
    volatility = rolling(F.stddev_samp, "ret_1d", spec, window, least, skip=skip) * math.sqrt(PERIODS)
    return panel.withColumn("formation_vol", volatility).withColumn(
        "risk_adjusted_mom_raw",
        F.when(F.col("formation_vol") > TOLERANCE, momentum(window + skip, skip) / F.col("formation_vol")),
    )


def add_residual_momentum(panel: DataFrame, market: str = "market_return", window=63, long=231, skip=21, least=200) -> DataFrame:
    """Sum of market-model residuals over a skipped window; coefficients are those of the row before."""
    rows = frame(ordered(TICKER), window, 1)
    m, r = F.col(market), F.col("ret_1d")
    both = m.isNotNull() & r.isNotNull()
    pm, pr = F.when(both, m), F.when(both, r)
    enough = F.count(pm).over(rows) >= window
    variance = F.var_samp(pm).over(rows)
    beta = F.when(enough & (variance > 0), F.covar_samp(pr, pm).over(rows) / variance)
    staged = panel.withColumns({"beta_before": beta, "mean_r": F.avg(pr).over(rows), "mean_m": F.avg(pm).over(rows)})
    staged = staged.withColumn(
        "residual", r - (F.col("mean_r") - F.col("beta_before") * F.col("mean_m")) - F.col("beta_before") * m
    )
    total = rolling(F.sum, "residual", ordered(TICKER), long, least, skip=skip)
    return staged.withColumn("residual_mom_raw", total).drop("mean_r", "mean_m")
