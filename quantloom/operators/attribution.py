"""Security attribution of backtest returns and its reconciliation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.stats import PERIODS, TOLERANCE
from quantloom.functions.windows import ordered, upto


def security_attribution(holdings: DataFrame, returns: DataFrame, return_column: str, cost_bps: float = 10.0) -> DataFrame:
    """Active security-days with contributions, costs and missing-return marks.

    A return that is missing earns nothing; a missing record and a missing value
    are told apart.
    """
    active = holdings.filter("pre_trade_weight <> 0 or weight <> 0 or trade <> 0").drop("asset_return")
    values = returns.select("date", "ticker", F.col(return_column).alias("asset_return"), F.lit(True).alias("_record"))
    joined = active.join(values, ["date", "ticker"], "left")
    w, r = F.col("weight"), F.col("asset_return")
    missing = r.isNull() & (w != 0)
    earned = F.coalesce(r, F.lit(0.0))
    long, short = F.greatest(w, F.lit(0.0)), F.greatest(-w, F.lit(0.0))
    return joined.withColumns(
        {
            "return_record_missing": F.col("_record").isNull(),
            "return_value_missing": F.col("_record").isNotNull() & r.isNull(),
            "missing_return_weight_contribution": F.when(missing, F.abs(w)).otherwise(0.0),
            "long_weight": long,
            "short_weight": short,
            "side": F.when(w > 0, "Long").when(w < 0, "Short").otherwise("Flat"),
            "long_return_contribution": long * earned,
            "short_return_contribution": -short * earned,
            "gross_return_contribution": w * earned,
            "absolute_trade_weight": F.abs("trade"),
            "transaction_cost_contribution": F.abs("trade") * (cost_bps / 10_000),
        }
    ).withColumn("net_return_contribution", F.col("gross_return_contribution") - F.col("transaction_cost_contribution")).drop("_record")


def portfolio_attribution(security: DataFrame, keys: Sequence[str] = ("portfolio",)) -> DataFrame:
    """Security contributions summed to portfolio days."""
    sums = {
        "long_return": "long_return_contribution",
        "short_return": "short_return_contribution",
        "gross_return": "gross_return_contribution",
        "turnover": "absolute_trade_weight",
        "transaction_cost": "transaction_cost_contribution",
        "net_return": "net_return_contribution",
        "long_exposure": "long_weight",
        "short_exposure": "short_weight",
        "missing_return_weight": "missing_return_weight_contribution",
    }
    return security.groupBy(*keys, "date").agg(*[F.sum(c).alias(k) for k, c in sums.items()])


AUDITED = ("long_return", "short_return", "gross_return", "turnover", "transaction_cost", "net_return", "missing_return_weight")


def reconcile(daily: DataFrame, security: DataFrame, keys: Sequence[str] = ("portfolio",), tolerance: float = TOLERANCE) -> DataFrame:
    """Per portfolio: days on one side only, the largest differences, and whether all stay under the tolerance."""
    a = daily.filter("gross_exposure > 0 or turnover > 0").select(*keys, "date", *AUDITED)
    b = portfolio_attribution(security, keys).select(*keys, "date", *[F.col(c).alias(f"b_{c}") for c in AUDITED])
    joined = a.withColumn("_a", F.lit(1)).join(b.withColumn("_b", F.lit(1)), [*keys, "date"], "full")
    gaps = [F.max(F.abs(F.col(c) - F.col(f"b_{c}"))).alias(f"difference_{c}") for c in AUDITED]
    out = joined.groupBy(*keys).agg(
        F.count("*").alias("days"), F.count_if(F.col("_a").isNull() | F.col("_b").isNull()).alias("unmatched_days"), *gaps
    )
    worst = F.greatest(*[F.coalesce(f"difference_{c}", F.lit(0.0)) for c in AUDITED])
    return out.withColumn("passes", (F.col("unmatched_days") == 0) & (worst < tolerance))


def attribution_history(daily: DataFrame, keys: Sequence[str] = ("portfolio",)) -> DataFrame:
    """Running sums of the contribution columns from the first row given."""
    spec = upto(ordered(keys))
    columns = ("long_return", "short_return", "gross_return", "transaction_cost", "net_return")
    return daily.select(*keys, "date", *[F.sum(c).over(spec).alias(f"cumulative_{c}") for c in columns])


def side_cost_summary(daily: DataFrame, keys: Sequence[str] = ("portfolio",), periods: int = PERIODS) -> DataFrame:
    """Sums and annualised means of leg returns and costs, and averages on rebalances."""
    columns = ("long_return", "short_return", "gross_return", "transaction_cost", "net_return")
    on = F.col("is_rebalance")
    return daily.groupBy(*keys).agg(
        F.count("*").alias("observations"),
        *[F.sum(c).alias(f"total_{c}") for c in columns],
        *[(F.avg(c) * periods).alias(f"annualised_{c}") for c in columns],
        F.count_if(on).alias("rebalance_days"),
        F.avg(F.when(on, F.col("turnover"))).alias("average_rebalance_turnover"),
        F.avg(F.when(on, F.col("transaction_cost"))).alias("average_rebalance_cost"),
    )


def security_contributions(security: DataFrame, keys: Sequence[str] = ("portfolio",)) -> DataFrame:
    """Totals per security and its share of all absolute net contributions."""
    out = security.groupBy(*keys, "ticker").agg(
        F.sum("long_return_contribution").alias("long_contribution"),
        F.sum("short_return_contribution").alias("short_contribution"),
        F.sum("gross_return_contribution").alias("gross_contribution"),
        F.sum("transaction_cost_contribution").alias("transaction_cost"),
        F.sum("net_return_contribution").alias("net_contribution"),
        F.count_if(F.col("weight") != 0).alias("held_days"),
        F.count_if(F.col("trade") != 0).alias("traded_days"),
    )
    total = F.sum(F.abs("net_contribution")).over(Window.partitionBy(*keys))
    return out.withColumn("absolute_share", F.try_divide(F.abs("net_contribution"), F.when(total > TOLERANCE, total)))


def top_contributors(summary: DataFrame, n: int = 10, keys: Sequence[str] = ("portfolio",)) -> DataFrame:
    """The n largest positive and the n most negative securities, with their place."""
    by = Window.partitionBy(*keys)
    value = F.col("net_contribution")
    best = F.row_number().over(by.orderBy(F.desc("net_contribution"), "ticker"))
    worst = F.row_number().over(by.orderBy("net_contribution", "ticker"))
    ranked = summary.withColumns({"_best": best, "_worst": worst})
    return (
        ranked.filter(((F.col("_best") <= n) & (value > 0)) | ((F.col("_worst") <= n) & (value < 0)))
        .withColumn("place", F.when(value > 0, F.col("_best")).otherwise(-F.col("_worst")))
        .drop("_best", "_worst")
    )
