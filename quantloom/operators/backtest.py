"""Backtests without a loop over dates.

Weights drift between rebalances.  With target w at the last rebalance and G the
product of (1 + r) since then, the weight held on a date is w G / (1 - sum w +
sum w G): cash earns nothing, a missing return counts as 0.  So each segment
between rebalances is a window over (segment, ticker), and costs, which never
feed back into weights, are added at the end.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.stats import TOLERANCE
from quantloom.functions.windows import before, carried, ordered, upto
from quantloom.operators import metrics
from quantloom.operators.constraints import at_least, enforce, finite, once_in_order, present
from quantloom.operators.portfolio import usable_dates
from quantloom.operators.validation import in_periods

LEGS = {
    "long_leg": "long_return",
    "short_leg": "short_return",
    "gross_portfolio": "gross_return",
    "net_portfolio": "net_return",
}


def _segments(dates: DataFrame, targets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every date of a key with ``seg``, the rebalance it belongs to, and ``ending``, the one that it ends."""
    schedule = targets.select(*keys, "date").distinct().withColumn("own", F.col("date"))
    grid = targets.select(*keys).distinct().crossJoin(dates.select("date")) if keys else dates.select("date")
    staged = grid.join(schedule, [*keys, "date"], "left")
    spec = ordered(keys)
    return staged.withColumns(
        {
            "seg": carried("own", spec),
            "ending": F.when(F.col("own").isNotNull(), F.last("own", ignorenulls=True).over(before(spec))),
        }
    )


def _sound(column: str) -> Column:
    return finite(column) & at_least(column, -1.0)


def _checked_targets(targets: DataFrame, keys: Sequence[str]) -> DataFrame:
    own = [*keys, "date", "ticker"]
    return enforce(targets, {"a key is missing": present(*own), "a weight is missing or not finite": finite("weight", False)}, "targets", own)


def drifted_weights(returns: DataFrame, targets: DataFrame, return_column: str, keys: Sequence[str] = ()) -> DataFrame:
    """date, ticker, weight, pre_trade_weight, trade, asset_return of every held or traded name.

    Weights that are missing or not finite, returns under -1, repeated keys on
    either side and a book that is worth nothing stop the job.
    """
    return _drifted(returns, _checked_targets(targets, keys), return_column, keys)


def _drifted(returns: DataFrame, targets: DataFrame, return_column: str, keys: Sequence[str]) -> DataFrame:
    dates = usable_dates(returns, return_column)
    marked = _segments(dates, targets, keys)
    spans = marked.filter("seg is not null").select(*keys, "date", "seg", F.lit(False).alias("closing")).unionByName(
        marked.filter("ending is not null").select(*keys, "date", F.col("ending").alias("seg"), F.lit(True).alias("closing"))
    )
    held = targets.filter(F.col("weight") != 0).select(*keys, F.col("date").alias("seg"), "ticker", F.col("weight").alias("w0"))
    dense = held.join(spans, [*keys, "seg"]).join(
        returns.select("date", "ticker", F.col(return_column).cast("double").alias("asset_return")), ["date", "ticker"], "left"
    )
    own = (*keys, "seg", "ticker")
    sound = {"a return is under -1 or not finite": _sound("asset_return"), "a target or a return occurs twice": F.col("_once")}
    dense = enforce(dense.withColumn("_once", once_in_order(own)), sound, "holdings", [*keys, "ticker", "date"]).drop("_once")
    path = before(ordered(own))
    growth = F.coalesce(F.product(1 + F.coalesce("asset_return", F.lit(0.0))).over(path), F.lit(1.0))
    by = Window.partitionBy(*keys, "seg", "date", "closing")
    grown = dense.withColumn("value", F.col("w0") * growth)
    nav = 1 - F.sum("w0").over(by) + F.sum("value").over(by)
    valued = enforce(grown.withColumn("_nav", nav), {"net asset value is not positive": F.col("_nav") > 0}, "holdings", [*keys, "date"])
    weighed = valued.withColumn("w", F.col("value") / F.col("_nav"))
    # A closing row is the weight before the trade of the next rebalance.
    return (
        weighed.withColumn("_rebalance", F.col("closing") | (F.col("date") == F.col("seg")))
        .groupBy(*keys, "date", "ticker")
        .agg(
            F.coalesce(F.max(F.when(~F.col("closing"), F.col("w"))), F.lit(0.0)).alias("weight"),
            F.max(F.when(F.col("closing"), F.col("w"))).alias("_pre"),
            F.max("_rebalance").alias("_rebalance"),
            F.max("asset_return").alias("asset_return"),
        )
        .withColumn("pre_trade_weight", F.when(F.col("_rebalance"), F.coalesce("_pre", F.lit(0.0))).otherwise(F.col("weight")))
        .withColumn("trade", F.col("weight") - F.col("pre_trade_weight"))
        .drop("_pre", "_rebalance")
    )


def target_weight_backtest(
    returns: DataFrame, targets: DataFrame, return_column: str, cost_bps: float = 10.0, keys: Sequence[str] = ()
) -> DataFrame:
    """Daily results per key: leg returns, turnover, costs, exposures and running wealth."""
    targets = _checked_targets(targets, keys)
    holdings = _drifted(returns, targets, return_column, keys)
    return daily_results(holdings, returns, targets, return_column, cost_bps, keys)


def daily_results(holdings, returns, targets, return_column, cost_bps=10.0, keys: Sequence[str] = ()) -> DataFrame:
    """Fold holdings to one row per date; dates before the first rebalance are flat."""
    dates = usable_dates(returns, return_column).select("date")
    grid = targets.select(*keys).distinct().crossJoin(dates) if keys else dates
    schedule = targets.select(*keys, "date").distinct().withColumn("is_rebalance", F.lit(True))
    w, r = F.col("weight"), F.coalesce("asset_return", F.lit(0.0))
    sums = holdings.groupBy(*keys, "date").agg(
        F.sum(F.greatest(w, F.lit(0.0)) * r).alias("long_return"),
        F.sum(F.least(w, F.lit(0.0)) * r).alias("short_return"),
        F.sum(F.abs("trade")).alias("turnover"),
        F.sum(F.greatest(w, F.lit(0.0))).alias("long_exposure"),
        F.sum(F.greatest(-w, F.lit(0.0))).alias("short_exposure"),
        F.sum(F.when(F.col("asset_return").isNull(), F.abs(w)).otherwise(0.0)).alias("missing_return_weight"),
    )
    measures = ("long_return", "short_return", "turnover", "long_exposure", "short_exposure", "missing_return_weight")
    out = grid.join(sums, [*keys, "date"], "left").join(schedule, [*keys, "date"], "left")
    out = out.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in measures} | {"is_rebalance": F.coalesce("is_rebalance", F.lit(False))})
    out = out.withColumns(
        {
            "gross_return": F.col("long_return") + F.col("short_return"),
            "transaction_cost": F.col("turnover") * (cost_bps / 10_000),
            "net_exposure": F.col("long_exposure") - F.col("short_exposure"),
            "gross_exposure": F.col("long_exposure") + F.col("short_exposure"),
        }
    ).withColumn("net_return", F.col("gross_return") - F.col("transaction_cost"))
    return with_wealth(out, keys)


def with_wealth(daily: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    spec = upto(ordered(keys))
    return daily.withColumns(
        {f"{k}_cumulative_return": F.product(1 + F.col(f"{k}_return")).over(spec) for k in ("gross", "net")}
    )


def long_short_backtest(
    panel: DataFrame,
    targets: DataFrame,
    return_column: str,
    cost_bps: float = 10.0,
    keys: Sequence[str] = (),
    beta_column: str | None = None,
    market: DataFrame | None = None,
    hedge_bps: float = 1.0,
) -> DataFrame:
    """Constant weights between rebalances; turnover is against the previous target.

    With ``beta_column`` and ``market`` (date, market_return) the book's beta at
    each rebalance is hedged with the market, at its own cost.  Weights that are
    missing or not finite and returns under -1 stop the job.
    """
    targets = _checked_targets(targets, keys)
    panel = enforce(panel, {"a return is under -1 or not finite": _sound(return_column)}, "panel", ["date", "ticker"])
    dates = usable_dates(panel, return_column)
    marked = _segments(dates, targets, keys)
    held = targets.select(*keys, F.col("date").alias("seg"), "ticker", "weight")
    values = panel.select("date", "ticker", F.col(return_column).cast("double").alias("asset_return"))
    rows = marked.filter("seg is not null").select(*keys, "date", "seg").join(held.filter("weight <> 0"), [*keys, "seg"])
    rows = rows.join(values, ["date", "ticker"], "left")
    w, r = F.col("weight"), F.coalesce("asset_return", F.lit(0.0))
    daily = rows.groupBy(*keys, "date").agg(
        F.sum(F.greatest(w, F.lit(0.0)) * r).alias("long_return"),
        F.sum(F.least(w, F.lit(0.0)) * r).alias("short_return"),
        F.sum(F.greatest(w, F.lit(0.0))).alias("long_exposure"),
        F.sum(F.greatest(-w, F.lit(0.0))).alias("short_exposure"),
        F.sum(F.when(F.col("asset_return").isNull(), F.abs(w)).otherwise(0.0)).alias("missing_return_weight"),
    )
    order = Window.partitionBy(*keys).orderBy("date")
    schedule = targets.select(*keys, "date").distinct().withColumn("previous", F.lag("date").over(order))
    now = targets.filter("weight <> 0").select(*keys, "date", "ticker", F.col("weight").alias("signed"))
    # Each target also counts against the next schedule date, with the opposite sign.
    then = (
        targets.filter("weight <> 0")
        .select(*keys, F.col("date").alias("previous"), "ticker", (-F.col("weight")).alias("signed"))
        .join(schedule, [*keys, "previous"])
        .select(*keys, "date", "ticker", "signed")
    )
    moves = now.unionByName(then).groupBy(*keys, "date", "ticker").agg(F.sum("signed").alias("move"))
    turnover = moves.groupBy(*keys, "date").agg(F.sum(F.abs("move")).alias("stock_turnover"))
    grid = marked.select(*keys, "date", "seg", F.col("own").isNotNull().alias("is_rebalance"))
    out = grid.join(daily, [*keys, "date"], "left").join(turnover, [*keys, "date"], "left")
    measures = ("long_return", "short_return", "long_exposure", "short_exposure", "missing_return_weight", "stock_turnover")
    out = out.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in measures})
    out = out.withColumn("gross_return_before_hedge", F.col("long_return") + F.col("short_return"))
    if beta_column is None:
        hedged = out.withColumns(
            {
                "benchmark_weight": F.lit(0.0),
                "benchmark_turnover": F.lit(0.0),
                "benchmark_hedge_return": F.lit(0.0),
                "estimated_stock_beta": F.lit(None).cast("double"),
                "missing_beta_weight": F.lit(0.0),
            }
        )
    else:
        betas = held.join(panel.select(F.col("date").alias("seg"), "ticker", F.col(beta_column).alias("beta")), ["seg", "ticker"], "left")
        book = betas.groupBy(*keys, "seg").agg(
            F.coalesce(F.sum(F.col("weight") * F.col("beta")), F.lit(0.0)).alias("estimated_stock_beta"),
            F.sum(F.when(F.col("beta").isNull(), F.abs("weight")).otherwise(0.0)).alias("missing_beta_weight"),
        )
        book = book.withColumn("benchmark_weight", -F.col("estimated_stock_beta"))
        step = F.abs(
            F.col("benchmark_weight") - F.coalesce(F.lag("benchmark_weight").over(Window.partitionBy(*keys).orderBy("seg")), F.lit(0.0))
        )
        book = book.withColumn("_step", step)
        hedged = out.join(book, [*keys, "seg"], "left").join(market.select("date", "market_return"), "date", "left")
        hedged = hedged.withColumns(
            {
                "benchmark_weight": F.coalesce("benchmark_weight", F.lit(0.0)),
                "missing_beta_weight": F.coalesce("missing_beta_weight", F.lit(0.0)),
                "benchmark_turnover": F.when(F.col("is_rebalance"), F.coalesce("_step", F.lit(0.0))).otherwise(0.0),
            }
        ).withColumn("benchmark_hedge_return", F.coalesce(F.col("benchmark_weight") * F.col("market_return"), F.lit(0.0)))
        hedged = hedged.drop("_step", "market_return")
    hedged = hedged.withColumns(
        {
            "gross_return": F.col("gross_return_before_hedge") + F.col("benchmark_hedge_return"),
            "turnover": F.col("stock_turnover") + F.col("benchmark_turnover"),
            "transaction_cost": F.col("stock_turnover") * (cost_bps / 10_000) + F.col("benchmark_turnover") * (hedge_bps / 10_000),
            "net_exposure": F.col("long_exposure") - F.col("short_exposure"),
            "gross_exposure": F.col("long_exposure") + F.col("short_exposure"),
        }
    ).withColumn("net_return", F.col("gross_return") - F.col("transaction_cost"))
    return with_wealth(hedged.drop("seg"), keys)


def summarise_backtest(daily: DataFrame, returns: str = "net_return", keys: Sequence[str] = ()) -> DataFrame:
    """Return summary with turnover, cost and missing-return columns."""
    summary = metrics.summarise_returns(daily, returns, keys).drop("downside_deviation")
    costs = daily.groupBy(*keys).agg(
        F.avg("turnover").alias("average_daily_turnover"),
        F.avg(F.when(F.col("is_rebalance"), F.col("turnover"))).alias("average_rebalance_turnover"),
        F.sum("transaction_cost").alias("total_transaction_cost"),
        F.max("missing_return_weight").alias("maximum_missing_return_weight"),
    )
    return summary.join(costs, list(keys)) if keys else summary.crossJoin(F.broadcast(costs))


def summarise_legs(daily: DataFrame, legs: Mapping[str, str] = LEGS) -> DataFrame:
    """Return summary of each return stream."""
    rows = [
        daily.select("date", F.lit(name).alias("portfolio"), F.col(c).alias("return")) for name, c in legs.items() if c in daily.columns
    ]
    return metrics.summarise_returns(reduce(DataFrame.unionByName, rows), "return", ("portfolio",))


def summarise_subperiods(daily: DataFrame, periods, returns: str = "net_return") -> DataFrame:
    return summarise_backtest(in_periods(daily, periods), returns, ("period",))


def offset_targets(panel: DataFrame, factor: str, returns: str, frequency: int, **book) -> DataFrame:
    """Targets of every rebalance offset in one frame, with ``offset`` as a key."""
    from quantloom.operators.portfolio import book_weights

    dates = usable_dates(panel, returns).withColumn("offset", (F.col("idx") % frequency).cast("int")).select("date", "offset")
    return book_weights(panel.join(dates.select("date"), "date", "left_semi"), factor, **book).join(dates, "date")


def cost_grid(daily: DataFrame, levels: Sequence[float], keys: Sequence[str] = ()) -> DataFrame:
    """The same gross path under several linear costs, as a key ``cost_bps``."""
    packed = F.explode(F.array(*[F.lit(float(x)) for x in levels]))
    out = daily.drop("gross_cumulative_return", "net_cumulative_return").withColumn("cost_bps", packed)
    out = out.withColumn("transaction_cost", F.col("turnover") * F.col("cost_bps") / 10_000)
    return with_wealth(out.withColumn("net_return", F.col("gross_return") - F.col("transaction_cost")), (*keys, "cost_bps"))


def active_gross(daily: DataFrame) -> DataFrame:
    """date, value: gross return where there is exposure."""
    return daily.select("date", F.when(F.col("gross_exposure") > TOLERANCE, F.col("gross_return")).alias("value"))
