"""Market models, betas, exposures and concentration states."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions import stats
from quantloom.functions.stats import PERIODS, TOLERANCE
from quantloom.functions.windows import frame, ordered
from quantloom.operators.constraints import enforce, one_label
from quantloom.operators.metrics import concentration

STREAMS = {"gross": "gross_return", "net": "net_return", "long": "long_return", "short": "short_return"}


def market_returns(benchmark: DataFrame, forward: bool = False, output: str = "market_return") -> DataFrame:
    """date and the benchmark's one-row return, back or forward; one price per date (the least, if repeated)."""
    daily = benchmark.groupBy("date").agg(F.min("adj_close").alias("p"))
    order = Window.orderBy("date")
    value = F.try_divide(F.lead("p").over(order), F.col("p")) if forward else F.try_divide(F.col("p"), F.lag("p").over(order))
    return daily.select("date", (value - 1).alias(output))


def rolling_beta(y: Column, m: Column, spec, window: int, least: int) -> Column:
    """Covariance over pairs, divided by the variance of all market rows in the frame."""
    rows = frame(spec, window)
    pair = F.count(F.when(y.isNotNull() & m.isNotNull(), 1)).over(rows)
    variance = F.var_samp(m).over(rows)
    enough = (pair >= least) & (F.count(m).over(rows) >= least) & (variance > 0)
    return F.when(enough, F.covar_samp(y, m).over(rows) / variance)


def add_stock_beta(panel: DataFrame, market: DataFrame, window=126, least=63, output="beta_126") -> DataFrame:
    """Rolling beta of each ticker; ``market`` has date and market_return.

    The rows of a ticker lie in blocks of ``window`` rows.  A frame is the start of
    its own block and the end of the one before, so its sums are those of two
    running ones, at a cost that does not grow with the window, and nothing is
    subtracted that would carry an outlier's error along.
    """
    joined = panel.join(market.select("date", "market_return"), "date", "left")
    y, m = F.col("ret_1d"), F.col("market_return")
    both = y.isNotNull() & m.isNotNull()
    moments = {
        "n": (F.count, F.when(both, 1)),
        "y": (F.sum, F.when(both, y)),
        "x": (F.sum, F.when(both, m)),
        "yx": (F.sum, y * m),
        "k": (F.count, m),
        "m": (F.sum, m),
        "mm": (F.sum, m * m),
        "low": (F.min, m),
        "high": (F.max, m),
    }
    spec = ordered(("ticker",))
    staged = joined.withColumn("_at", F.row_number().over(spec) - 1).withColumn("_block", F.floor(F.col("_at") / window))
    own = Window.partitionBy("ticker", "_block").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    rest = Window.partitionBy("ticker", "_block").orderBy(F.desc("date")).rowsBetween(Window.unboundedPreceding, 0)
    staged = staged.withColumns({f"_b_{k}": f(v).over(rest) for k, (f, v) in moments.items()})
    staged = staged.withColumns({f"_a_{k}": f(v).over(own) for k, (f, v) in moments.items()})
    # A frame that ends with its block has no part in the one before.
    ended = F.pmod(F.col("_at"), F.lit(window)) == window - 1
    ends = F.struct(*[F.col(f"_b_{k}").alias(k) for k in moments])
    staged = staged.withColumn("_b", F.when(~ended, F.lag(ends, window - 1).over(spec)))
    pair = {F.min: F.least, F.max: F.greatest}
    zero = F.lit(0.0)
    frame_of = {
        k: pair[f](F.col(f"_a_{k}"), F.col(f"_b.{k}")) if f in pair else F.coalesce(F.col(f"_a_{k}"), zero) + F.coalesce(F.col(f"_b.{k}"), zero)
        for k, (f, _) in moments.items()
    }
    n, k = frame_of["n"], frame_of["k"]
    variance = F.try_divide(frame_of["mm"] - frame_of["m"] * frame_of["m"] / k, k - 1)
    covariance = F.try_divide(frame_of["yx"] - frame_of["y"] * frame_of["x"] / n, n - 1)
    enough = (n >= least) & (k >= least) & (frame_of["high"] > frame_of["low"]) & (variance > 0)
    return staged.select(*joined.columns, F.when(enough, F.try_divide(covariance, variance)).alias(output))


def add_market_model(panel: DataFrame, window=63, least: int | None = None, prefix="market_model", periods=PERIODS) -> DataFrame:
    """Alpha, beta, residual and idiosyncratic volatility over joint rows; needs market_return."""
    need = window if least is None else least
    m, r = F.col("market_return"), F.col("ret_1d")
    both = m.isNotNull() & r.isNotNull()
    pm, pr = F.when(both, m), F.when(both, r)
    rows = frame(ordered(("ticker",)), window)
    moments = {
        "_n": F.count(pm),
        "_mm": F.avg(pm),
        "_mr": F.avg(pr),
        "_vm": F.var_samp(pm),
        "_vr": F.var_samp(pr),
        "_cov": F.covar_samp(pr, pm),
    }
    staged = panel.withColumns({k: v.over(rows) for k, v in moments.items()})
    ok = (F.col("_n") >= need) & (F.col("_vm") > 0)
    beta = F.when(ok, F.col("_cov") / F.col("_vm"))
    staged = staged.withColumn(f"{prefix}_beta", beta)
    beta = F.col(f"{prefix}_beta")
    alpha = F.col("_mr") - beta * F.col("_mm")
    left = F.greatest(F.col("_vr") - beta * F.col("_cov"), F.lit(0.0))
    return staged.withColumns(
        {
            f"{prefix}_alpha": alpha,
            f"{prefix}_residual": F.when(both, r - alpha - beta * m),
            f"{prefix}_idio_vol": F.when(ok, F.sqrt(left) * math.sqrt(periods)),
        }
    ).drop(*moments)


def market_exposure(daily: DataFrame, returns: str, market: str = "market_return", keys: Sequence[str] = ()) -> DataFrame:
    """Full-sample beta, alpha, correlation, residual volatility and R squared over joint rows."""
    both = daily.filter(F.col(returns).isNotNull() & F.col(market).isNotNull())
    sums = both.groupBy(*keys).agg(
        F.count("*").alias("observations"),
        F.avg(returns).alias("_y"),
        F.avg(market).alias("_x"),
        F.var_samp(returns).alias("_vy"),
        F.var_samp(market).alias("_vx"),
        F.covar_samp(returns, market).alias("_c"),
    )
    beta = F.try_divide(F.col("_c"), F.when(F.col("_vx") > 0, F.col("_vx")))
    spread = F.sqrt(F.col("_vy") * F.col("_vx"))
    correlation = F.try_divide(F.col("_c"), F.when(spread > 0, spread))
    residual = F.greatest(F.col("_vy") - 2 * beta * F.col("_c") + beta * beta * F.col("_vx"), F.lit(0.0))
    return sums.select(
        *keys,
        "observations",
        beta.alias("beta"),
        ((F.col("_y") - beta * F.col("_x")) * PERIODS).alias("annualised_alpha"),
        correlation.alias("correlation"),
        (F.sqrt(residual) * math.sqrt(PERIODS)).alias("residual_volatility"),
        (correlation * correlation).alias("r_squared"),
    )


def unpivot_streams(daily: DataFrame, streams: Mapping[str, str], ids: Sequence[str]) -> DataFrame:
    packed = F.array(*[F.struct(F.lit(k).alias("stream"), F.col(c).alias("value")) for k, c in streams.items()])
    return daily.select(*ids, F.explode(packed).alias("_s")).select(*ids, "_s.stream", "_s.value")


def strategy_exposures(daily: DataFrame, market: DataFrame, streams: Mapping[str, str] = STREAMS) -> DataFrame:
    rows = unpivot_streams(daily, streams, ["date"]).join(market, "date")
    return market_exposure(rows, "value", "market_return", ("stream",))


def realised_beta_state(daily: DataFrame, market: DataFrame, keys=("portfolio",), window=126, least: int | None = None) -> DataFrame:
    """Rolling beta and correlation with the market of every return stream."""
    need = window if least is None else least
    rows = unpivot_streams(daily, STREAMS, [*keys, "date"]).join(market, "date", "left")
    spec = ordered((*keys, "stream"))
    y, m = F.col("value"), F.col("market_return")
    return rows.withColumns(
        {
            f"realised_beta_{window}": rolling_beta(y, m, spec, window, need),
            f"market_correlation_{window}": stats.pearson_over(y, m, frame(spec, window), need),
        }
    ).drop("value", "market_return")


def sector_exposure(holdings: DataFrame, sectors: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Long, short, net and gross weight per date and sector; no sector counts as Unknown."""
    w = F.col("weight")
    return (
        holdings.join(sectors.select("ticker", "sector"), "ticker", "left")
        .withColumn("sector", F.coalesce("sector", F.lit("Unknown")))
        .groupBy(*keys, "date", "sector")
        .agg(
            F.sum(F.greatest(w, F.lit(0.0))).alias("long_exposure"),
            F.sum(F.greatest(-w, F.lit(0.0))).alias("short_exposure"),
            F.sum(w).alias("net_exposure"),
            F.sum(F.abs(w)).alias("gross_exposure"),
        )
    )


def summarise_sector_exposure(exposure: DataFrame) -> DataFrame:
    kinds = ("long", "short", "net", "gross")
    return exposure.groupBy("sector").agg(
        *[F.avg(f"{k}_exposure").alias(f"mean_{k}_exposure") for k in kinds],
        F.max(F.abs("net_exposure")).alias("maximum_absolute_net_exposure"),
    )


def holdings_beta_detail(holdings: DataFrame, betas: DataFrame, beta: str = "beta_126") -> DataFrame:
    """Holdings with the same date's beta, its coverage and contributions."""
    w, b = F.col("weight"), F.col(beta)
    return holdings.join(betas.select("date", "ticker", beta), ["date", "ticker"], "left").withColumns(
        {
            "long_weight": F.greatest(w, F.lit(0.0)),
            "short_weight": F.greatest(-w, F.lit(0.0)),
            "absolute_weight": F.abs(w),
            "beta_covered_gross_weight": F.when(b.isNotNull(), F.abs(w)).otherwise(0.0),
            "long_beta_contribution": F.greatest(w, F.lit(0.0)) * b,
            "short_beta_contribution": F.least(w, F.lit(0.0)) * b,
            "market_beta_contribution": w * b,
        }
    )


def holdings_beta_state(detail: DataFrame, keys: Sequence[str] = ("portfolio",)) -> DataFrame:
    """Exposures, basket betas and beta coverage per date; betas are null if none is known."""
    out = detail.groupBy(*keys, "date").agg(
        F.sum("long_weight").alias("holdings_long_exposure"),
        F.sum("short_weight").alias("holdings_short_exposure"),
        F.sum("absolute_weight").alias("holdings_gross_exposure"),
        F.sum("weight").alias("holdings_net_exposure"),
        F.sum("beta_covered_gross_weight").alias("beta_covered_gross_weight"),
        F.sum("long_beta_contribution").alias("holdings_long_beta_contribution"),
        F.sum("short_beta_contribution").alias("holdings_short_beta_contribution"),
        F.sum("market_beta_contribution").alias("holdings_market_beta"),
    )

    def over(a, b, sign=1):
        return sign * F.try_divide(F.col(a), F.when(F.col(b) > 0, F.col(b)))

    return out.withColumns(
        {
            "long_basket_beta": over("holdings_long_beta_contribution", "holdings_long_exposure"),
            "short_basket_beta": over("holdings_short_beta_contribution", "holdings_short_exposure", -1),
            "beta_coverage": over("beta_covered_gross_weight", "holdings_gross_exposure"),
        }
    )


def beta_state(daily: DataFrame, market: DataFrame, detail: DataFrame, keys=("portfolio",), window: int = 126) -> DataFrame:
    """Holdings betas beside realised ones and their gap."""
    realised = realised_beta_state(daily, market, keys, window)
    wide = realised.groupBy(*keys, "date").agg(
        *[F.max(F.when(F.col("stream") == s, F.col(f"realised_beta_{window}"))).alias(f"realised_{s}_beta_{window}") for s in STREAMS],
        F.max(F.when(F.col("stream") == "net", F.col(f"market_correlation_{window}"))).alias(f"net_market_correlation_{window}"),
    )
    out = holdings_beta_state(detail, keys).join(wide, [*keys, "date"], "left")
    return out.withColumn("beta_gap", F.col("holdings_market_beta") - F.col(f"realised_net_beta_{window}"))


def position_concentration(holdings: DataFrame, keys: Sequence[str] = ("portfolio",)) -> DataFrame:
    """Concentration of the gross, long and short books per date."""
    w = F.col("weight")
    staged = holdings.withColumns({"_gross": F.abs(w), "_long": F.greatest(w, F.lit(0.0)), "_short": F.greatest(-w, F.lit(0.0))})
    columns = [c for book in ("gross", "long", "short") for c in concentration(f"_{book}", f"{book}_position")]
    return staged.groupBy(*keys, "date").agg(*columns)


def sector_concentration(holdings: DataFrame, sectors: DataFrame, keys: Sequence[str] = ("portfolio",)) -> DataFrame:
    """Concentration of gross sector exposure and the largest absolute net one.

    A ticker with two sectors, and a name held without one, stop the job.
    """
    labels = one_label(sectors, "ticker", "sector", "sectors")
    known = enforce(
        holdings.join(labels, "ticker", "left"),
        {"a held name has no sector": (F.col("weight") == 0) | F.col("sector").isNotNull()},
        "holdings",
        [*keys, "date", "ticker"],
    )
    w = F.col("weight")
    exposure = (
        known.filter("sector is not null")
        .groupBy(*keys, "date", "sector")
        .agg(F.sum(w).alias("net_exposure"), F.sum(F.abs(w)).alias("gross_exposure"))
    )
    return (
        exposure.groupBy(*keys, "date")
        .agg(
            *concentration("gross_exposure", "gross_sector"),
            F.max(F.abs("net_exposure")).alias("largest_absolute_sector_net_exposure"),
        )
    )


def beta_concentration(detail: DataFrame, keys: Sequence[str] = ("portfolio",)) -> DataFrame:
    staged = detail.withColumn("_abs", F.abs("market_beta_contribution"))
    return staged.groupBy(*keys, "date").agg(*concentration("_abs", "absolute_beta_contribution"))


def rolling_contributions(security: DataFrame, entity: str, value: str, keys=("portfolio",), window: int = 63) -> DataFrame:
    """Sums over the last ``window`` portfolio dates of each entity; dates without the entity count as 0."""
    dates = security.select(*keys, "date").distinct()
    entities = security.filter(F.col(entity).isNotNull()).select(*keys, entity).distinct()
    daily = security.groupBy(*keys, "date", entity).agg(F.sum(value).alias("_v"))
    dense = dates.join(entities, list(keys)).join(daily, [*keys, "date", entity], "left")
    spec = ordered((*keys, entity))
    total = F.sum(F.coalesce("_v", F.lit(0.0))).over(frame(spec, window))
    return dense.withColumn("contribution", F.when(F.row_number().over(spec) >= window, total)).drop("_v")


def contribution_concentration(security: DataFrame, entity: str, value: str, prefix: str, keys=("portfolio",), window=63) -> DataFrame:
    """Concentration of absolute rolling contributions and the entity with the largest (ties: first by name)."""
    rolled = rolling_contributions(security, entity, value, keys, window).filter("contribution is not null")
    staged = rolled.withColumn("_abs", F.abs("contribution"))
    label = F.min(F.when(F.col("_abs") > TOLERANCE, F.struct(-F.col("_abs"), F.col(entity))))
    return staged.groupBy(*keys, "date").agg(
        *[c.alias(f"{n}_{window}") for c, n in zip(concentration("_abs", prefix), _names(prefix), strict=True)],
        label[entity].alias(f"largest_{prefix}_{window}"),
    )


def _names(prefix: str) -> list[str]:
    return [
        f"{prefix}_count",
        f"effective_{prefix}_count",
        f"largest_{prefix}_share",
        f"top_three_{prefix}_share",
        f"top_five_{prefix}_share",
    ]


def tracking_state(daily: DataFrame, a: str, b: str, keys: Sequence[str] = (), window: int = 63) -> DataFrame:
    """Rolling tracking error and correlation of two return columns."""
    rows = frame(ordered(keys), window)
    gap = F.col(a) - F.col(b)
    error = F.when(F.count(gap).over(rows) >= window, F.stddev_samp(gap).over(rows) * math.sqrt(PERIODS))
    return daily.withColumns({"tracking_error": error, "correlation": stats.pearson_over(F.col(a), F.col(b), rows, window)})
