"""Batch jobs: ingest, panels, backtests, monitoring, refresh, reports.

    python -m quantloom.jobs ingest --source prices.csv --out prices.parquet
    python -m quantloom.jobs refresh --prices ... --benchmark ... --universe ... --root ... [--write]

Panels are single datasets, written aside and moved into place; the datasets of a
refresh are two groups, attribution and monitoring, each visible as a whole
(``sources/group_commit.py``).  A refresh without ``--write`` only reports what
would change.
"""

from __future__ import annotations

import argparse
import sys
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.operators import backtest, features, portfolio, quality
from quantloom.operators.constraints import enforce, finite, numeric, present
from quantloom.operators.contracts import Contract, require_columns
from quantloom.plans import workflow
from quantloom.sources import files
from quantloom.sources.group_commit import commit_group, compare_group, current, read_group

_PD = ("portfolio", "date")
_FLAG = ("entity_type", "entity", "category", "diagnostic")
#: Datasets of the two groups.
ATTRIBUTION = {
    "target_weights": Contract("target_weights", (*_PD, "ticker"), ("weight",)),
    "portfolio_daily": Contract("portfolio_daily", _PD, ("gross_return", "net_return", "turnover", "transaction_cost")),
    "security_holdings": Contract("security_holdings", (*_PD, "ticker"), ("weight", "trade")),
    "security_daily": Contract("security_daily", (*_PD, "ticker"), ("net_return_contribution",)),
    "reconciliation": Contract("reconciliation", ("portfolio",), ("passes",), None),
    "summary": Contract("summary", ("portfolio",), ("total_return",), None),
}
MONITORING = {
    "signal_health": Contract("signal_health", ("factor", "date")),
    "factor_dependence": Contract("factor_dependence", ("date",)),
    "performance_risk": Contract("performance_risk", _PD, ("wealth", "drawdown")),
    "beta_state": Contract("beta_state", _PD, ("holdings_market_beta", "beta_coverage")),
    "concentration_state": Contract("concentration_state", _PD),
    "implementation_state": Contract("implementation_state", _PD),
    "liquidity_coverage": Contract("liquidity_coverage", _PD, ("liquidity_coverage",)),
    "diagnostic_flags": Contract("diagnostic_flags", _FLAG, ("status",), None),
    "latest_overview": Contract("latest_overview", ("entity_type", "entity"), ("overall_status",), None),
}
FACTORS = {"mom_12_1m": "mom_12_1m_z", "mom_3m": "mom_3m_z", "reversal_1m": "reversal_1m_z", "realised_vol_63": "realised_vol_63_z"}


def ingest(spark: SparkSession, source: str, out: str) -> DataFrame:
    """Prices from CSV or Parquet as typed columns; text that is no number and rows that break the contract stop the job."""
    raw = spark.read.option("header", True).csv(source) if source.endswith(".csv") else spark.read.parquet(source)
    require_columns(raw, ["date", "ticker", "close", "adj_close", "volume"], "prices")
    fields = [f.name for f in files.OHLCV.fields[2:] if f.name in raw.columns]
    typed = raw.select(F.col("date").cast("date").alias("date"), "ticker", *[numeric(c).alias(c) for c in fields])
    rules = {
        "a key is missing": present("date", "ticker"),
        "adj_close is not above 0": F.coalesce(F.col("adj_close") > 0, F.lit(False)) & finite("adj_close"),
        "volume is negative": F.coalesce(F.col("volume") >= 0, F.lit(True)),
    }
    return files.write_checked(enforce(typed, rules, "prices", ["date", "ticker"]), out, ("date", "ticker"))


def build_returns(spark: SparkSession, prices: str, out: str) -> DataFrame:
    return files.write_checked(features.return_features(spark.read.parquet(prices)), out, ("date", "ticker"))


def build_processed(spark: SparkSession, prices: str, universe: str, out: str) -> DataFrame:
    panel = workflow.processed_panel(spark.read.parquet(prices), spark.read.parquet(universe))
    return files.write_checked(panel, out, ("date", "ticker"))


def build_factors(spark: SparkSession, panel: str, benchmark: str, out: str) -> DataFrame:
    """Write the factor panel; returns how much of each raw factor is there."""
    files.write_checked(workflow.factor_panel(spark.read.parquet(panel), spark.read.parquet(benchmark)), out, ("date", "ticker"))
    written = spark.read.parquet(out)
    raw = [c for c in written.columns if c.endswith("_raw")]
    coverage = written.agg(*[F.avg(F.col(c).isNotNull().cast("int")).alias(c) for c in raw])
    return coverage.unpivot([], raw, "factor", "coverage")


def run_backtests(
    spark: SparkSession, panel: str, out: str, factors: Mapping[str, str] | None = None, frequency: int = 21, cost_bps: float = 10.0, returns: str = "forward_ret_1d", least: int = 30
) -> DataFrame:
    """Daily results, holdings and summary of a book per factor: three datasets, one folder per factor in each."""
    rows = spark.read.parquet(panel)
    targets = None
    for name, column in (FACTORS if factors is None else factors).items():
        part = portfolio.factor_targets(rows, column, returns, frequency, least=least).withColumn("factor", F.lit(files.file_stem(name)))
        targets = part if targets is None else targets.unionByName(part)
    targets = workflow.kept(targets)
    holdings = workflow.kept(backtest.drifted_weights(rows, targets, returns, ("factor",)))
    daily = workflow.kept(backtest.daily_results(holdings, rows, targets, returns, cost_bps, ("factor",)))
    summary = backtest.summarise_backtest(daily, "net_return", ("factor",))
    for name, df in {"daily": daily, "holdings": holdings, "summary": summary}.items():
        df.write.mode("overwrite").partitionBy("factor").parquet(f"{out}/{name}")
    return spark.read.parquet(f"{out}/summary")


def check_attribution(data: Mapping[str, DataFrame]) -> None:
    bad = data["reconciliation"].filter("NOT passes").select("portfolio").limit(5).collect()
    if bad:
        raise ValueError(f"attribution does not reconcile: {[r.portfolio for r in bad]}")


def rebuild_monitoring(spark: SparkSession, panel: str, benchmark: str, universe: str, root: str) -> DataFrame:
    """Monitoring datasets of the current attribution group, committed as a group."""
    data = read_group(spark, f"{root}/attribution")
    made = workflow.monitoring_datasets(spark.read.parquet(panel), spark.read.parquet(benchmark), spark.read.parquet(universe), data)
    return commit_group(spark, f"{root}/monitoring", made, MONITORING, workflow.validate_monitoring, note="monitoring rebuilt")


def refresh(spark: SparkSession, prices: str, benchmark: str, universe: str, root: str, write: bool = False, least: int = 30, tolerance: float = 1e-12) -> DataFrame:
    """Everything from prices to the overview; returns what changes against the current groups.

    One row per group, dataset, column and kind of difference; a group that is
    not there yet is one row.  With ``write`` groups that change are committed.
    """
    made = workflow.complete_refresh(*[spark.read.parquet(p) for p in (prices, benchmark, universe)], least=least)
    rows = []
    for group, contracts, check in (("attribution", ATTRIBUTION, check_attribution), ("monitoring", MONITORING, workflow.validate_monitoring)):
        place, data = f"{root}/{group}", {n: made[n] for n in contracts}
        there = current(spark, place)
        changes = compare_group(spark, place, data, contracts, tolerance).collect() if there else [(None, None, "new_group", None, None)]
        rows += [(group, *r) for r in changes]
        if write and changes:
            commit_group(spark, place, data, contracts, check, there.number if there else 0, "refresh")
    return spark.createDataFrame(rows, "group string, dataset string, column string, kind string, count bigint, largest_gap double")


def dump_report(spark: SparkSession, prices: str, benchmark: str, universe: str, folder: str) -> list[str]:
    """The tables of the quality report as CSV, one folder each."""
    tables = quality.quality_report(*[spark.read.parquet(p) for p in (prices, benchmark, universe)])
    for name, df in tables.items():
        files.write_csv(df, f"{folder}/{files.file_stem(name)}")
    return sorted(tables)


def main(arguments: Sequence[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="quantloom.jobs")
    jobs = parser.add_subparsers(dest="job", required=True)
    wanted = {
        "ingest": ("source", "out"),
        "returns": ("prices", "out"),
        "processed": ("prices", "universe", "out"),
        "factors": ("panel", "benchmark", "out"),
        "backtests": ("panel", "out"),
        "monitoring": ("panel", "benchmark", "universe", "root"),
        "refresh": ("prices", "benchmark", "universe", "root"),
        "report": ("prices", "benchmark", "universe", "folder"),
    }
    for name, paths in wanted.items():
        job = jobs.add_parser(name)
        for path in paths:
            job.add_argument(f"--{path}", required=True)
        if name == "refresh":
            job.add_argument("--write", action="store_true")
        if name in ("refresh", "backtests"):
            job.add_argument("--least", type=int, default=30)
    given = vars(parser.parse_args(arguments))
    run = {"ingest": ingest, "returns": build_returns, "processed": build_processed, "factors": build_factors, "backtests": run_backtests, "monitoring": rebuild_monitoring, "refresh": refresh, "report": dump_report}[given.pop("job")]
    spark = SparkSession.builder.appName("quantloom").getOrCreate()
    out = run(spark, **given)
    if isinstance(out, DataFrame):
        out.show(100, truncate=False)
    else:
        print(*out, sep="\n")
    return 0


if __name__ == "__main__":
    sys.exit(main())
