"""Betting against beta, and what allocations earned in the period after they were made."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions import stats
from quantloom.functions.stats import PERIODS, TOLERANCE
from quantloom.operators.cross_section import ceiling_quintile

#: Fixed weight of an estimated beta against the market's, and the largest gross exposure.
BETA_WEIGHT = 0.6
LARGEST_GROSS = 3.0


def beta_legs(panel: DataFrame, beta: str = "beta_126", forward: str = "forward_ret_1d", low: int = 1, high: int = 5) -> DataFrame:
    """date and, for the lowest and highest fifth by beta, the mean return, mean beta and number of names.

    Only dates on which both legs have a name with beta and return are there.
    """
    rows = panel.select("date", "ticker", beta, forward).withColumn("quintile", ceiling_quintile(beta))
    rows = rows.filter(F.col("quintile").isin(low, high) & F.col(beta).isNotNull() & F.col(forward).isNotNull())
    aggregates = []
    for q, n in ((low, "low"), (high, "high")):
        inside = F.col("quintile") == q
        aggregates += [
            F.avg(F.when(inside, F.col(forward))).alias(f"{n}_return"),
            F.avg(F.when(inside, F.col(beta))).alias(f"{n}_beta"),
            F.count_if(inside).alias(f"{n}_count"),
        ]
    return rows.groupBy("date").agg(*aggregates).filter("low_count > 0 and high_count > 0")


def betting_against_beta(
    legs: DataFrame, risk_free: DataFrame, weight: float = BETA_WEIGHT, largest: float = LARGEST_GROSS
) -> DataFrame:
    """Low beta held against high beta, each lifted or lowered to a beta of one.

    Betas are shrunk towards one first; multipliers are one over the shrunk beta,
    scaled down together where their sum exceeds ``largest``.  Both legs earn
    their excess over the risk-free rate (date, risk_free_rate).  A date whose
    shrunk beta is not positive has no multipliers and no return.
    """
    out = legs.join(risk_free.select("date", "risk_free_rate"), "date", "left")
    for n in ("low", "high"):
        shrunk = weight * F.col(f"{n}_beta") + (1 - weight)
        out = out.withColumn(f"{n}_shrunk_beta", shrunk).withColumn(f"{n}_uncapped", F.try_divide(F.lit(1.0), F.when(shrunk > 0, shrunk)))
    gross = F.col("low_uncapped") + F.col("high_uncapped")
    scale = F.when(gross.isNotNull(), F.least(F.lit(1.0), largest / gross))
    out = out.withColumns({"uncapped_gross_exposure": gross, "gross_scaling_factor": scale})
    out = out.withColumns({f"{n}_multiplier": F.col(f"{n}_uncapped") * F.col("gross_scaling_factor") for n in ("low", "high")})
    low, high = (F.col(f"{n}_return") - F.col("risk_free_rate") for n in ("low", "high"))
    return out.withColumns(
        {
            "gross_exposure": F.col("low_multiplier") + F.col("high_multiplier"),
            "net_dollar_exposure": F.col("low_multiplier") - F.col("high_multiplier"),
            "shrunk_net_beta": F.col("low_multiplier") * F.col("low_shrunk_beta") - F.col("high_multiplier") * F.col("high_shrunk_beta"),
            "estimated_net_beta": F.col("low_multiplier") * F.col("low_beta") - F.col("high_multiplier") * F.col("high_beta"),
            "low_excess_return": low,
            "high_excess_return": high,
            "low_minus_high_return": F.col("low_return") - F.col("high_return"),
            "bab_return": F.col("low_multiplier") * low - F.col("high_multiplier") * high,
            "bab_uncapped_return": F.col("low_uncapped") * low - F.col("high_uncapped") * high,
            "is_capped": F.col("gross_scaling_factor") < 1,
        }
    )


def cap_effect(bab: DataFrame) -> DataFrame:
    """One row: how often the cap binds, and what it does to returns."""
    gap = F.abs(F.col("bab_return") - F.col("bab_uncapped_return"))
    return bab.agg(
        F.count("bab_return").alias("dates"),
        F.avg(F.col("is_capped").cast("int")).alias("capped_fraction"),
        F.corr("bab_return", "bab_uncapped_return").alias("return_correlation"),
        F.avg("bab_return").alias("mean_capped"),
        F.avg("bab_uncapped_return").alias("mean_uncapped"),
        F.avg(gap).alias("mean_absolute_cap_effect"),
        F.max("gross_exposure").alias("largest_gross_exposure"),
        F.max(F.abs("shrunk_net_beta")).alias("largest_shrunk_net_beta"),
    )


# --- what an allocation earned ------------------------------------------------------------


def _hit(a: Column, b: Column) -> Column:
    """1 if both spreads have one sign, 0 if not, null where either is a tie."""
    return F.when((F.abs(a) > TOLERANCE) & (F.abs(b) > TOLERANCE), (a * b > 0).cast("int"))


def forward_diagnosis(allocations: DataFrame, sleeves: DataFrame) -> DataFrame:
    """Each allocation of two sleeves against their returns from its date up to the day before the next one.

    ``allocations``: date, weight_a, weight_b, estimate_a, estimate_b (expected
    returns).  ``sleeves``: date, a, b; dates without both returns are left out.
    A period without any has null returns.  ``is_boundary`` marks allocations of
    one sleeve only.
    """
    starts = allocations.select("date", "weight_a", "weight_b", "estimate_a", "estimate_b").withColumn("_own", F.col("date"))
    days = sleeves.filter("a is not null and b is not null").select("date", "a", "b")
    # Allocations and returns share a timeline; an allocation counts from its own date on.
    marks = starts.select("date", F.lit(0).alias("_side"), F.col("_own").alias("period_start"), F.lit(None).cast("double").alias("a"), F.lit(None).cast("double").alias("b"))
    line = marks.unionByName(days.select("date", F.lit(1).alias("_side"), F.lit(None).cast("date").alias("period_start"), "a", "b"))
    spec = Window.orderBy("date", "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = line.withColumn("period_start", F.last("period_start", ignorenulls=True).over(spec)).filter("_side = 1 and period_start is not null")
    joined = held.drop("date").join(starts.withColumnRenamed("date", "period_start").drop("_own"), "period_start")
    mixed = F.col("weight_a") * F.col("a") + F.col("weight_b") * F.col("b")
    sums = (
        joined.withColumns({"_mix": mixed, "_even": (F.col("a") + F.col("b")) / 2})
        .groupBy("period_start")
        .agg(
            F.count("*").alias("forward_observations"),
            stats.compound("a").alias("realised_a"),
            stats.compound("b").alias("realised_b"),
            stats.compound("_mix").alias("period_return"),
            stats.compound("_even").alias("equal_weight_period_return"),
        )
    )
    out = starts.drop("_own").join(sums.withColumnRenamed("period_start", "date"), "date", "left")
    estimated, realised = F.col("estimate_a") - F.col("estimate_b"), F.col("realised_a") - F.col("realised_b")
    spread = F.col("weight_a") - F.col("weight_b")
    edge = F.least("weight_a", "weight_b") <= TOLERANCE
    return out.withColumns(
        {
            "forward_observations": F.coalesce("forward_observations", F.lit(0)),
            "estimated_spread": estimated,
            "realised_spread": realised,
            "allocation_spread": spread,
            "return_difference": F.col("period_return") - F.col("equal_weight_period_return"),
            "rank_hit": _hit(estimated, realised),
            "allocated_sleeve_won": _hit(spread, realised),
            "is_boundary": edge,
            "allocation_change": F.abs(F.col("weight_a") - F.lag("weight_a").over(Window.orderBy("date"))),
        }
    )


def summarise_diagnosis(detail: DataFrame, periods: int = PERIODS) -> DataFrame:
    """One row: hit rates, correlations of spreads, and annual returns of the allocations and of equal weights."""
    both = F.col("estimated_spread").isNotNull() & F.col("realised_spread").isNotNull()
    order = Window.partitionBy("_both")
    staged = detail.withColumn("_both", both)
    for c in ("estimated_spread", "realised_spread"):
        rank = F.rank().over(order.orderBy(c)) + (F.count("*").over(Window.partitionBy("_both", c)) - 1) / 2
        staged = staged.withColumn(f"_rank_{c}", F.when(F.col("_both"), rank))
    days = F.sum("forward_observations")
    annual = lambda c: F.pow(F.product(1 + F.col(c)), F.lit(float(periods)) / F.when(days > 0, days)) - 1
    return staged.agg(
        F.count("*").alias("allocations"),
        F.avg(F.col("is_boundary").cast("int")).alias("boundary_fraction"),
        F.corr(F.when(both, F.col("estimated_spread")), F.when(both, F.col("realised_spread"))).alias("spread_pearson"),
        F.corr("_rank_estimated_spread", "_rank_realised_spread").alias("spread_spearman"),
        F.avg("rank_hit").alias("rank_hit_rate"),
        F.avg("allocated_sleeve_won").alias("higher_weight_win_rate"),
        F.avg((F.col("return_difference") > 0).cast("int")).alias("positive_difference_fraction"),
        (F.avg("return_difference") * 10_000).alias("mean_difference_bps"),
        annual("period_return").alias("annualised_return"),
        annual("equal_weight_period_return").alias("equal_weight_annualised_return"),
        F.avg(F.when(F.col("is_boundary"), F.col("allocation_change"))).alias("boundary_change"),
        F.avg(F.when(~F.col("is_boundary"), F.col("allocation_change"))).alias("interior_change"),
    )
