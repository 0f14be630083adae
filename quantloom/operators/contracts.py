"""Checks of columns, keys and values, run only when asked for."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def require_columns(df: DataFrame, columns: Sequence[str], name: str = "table") -> None:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"{name} lacks columns {missing}")


def require_positive(value: float, name: str) -> None:
    if not math.isfinite(value) or value <= 0:
        raise ValueError(f"{name} must be positive")


def require_rate(value: float, name: str) -> float:
    value = float(value)
    if not math.isfinite(value) or value < 0:
        raise ValueError(f"{name} must be finite and not negative")
    return value


def require_labels(values: Sequence[str], name: str) -> list[str]:
    """A non-empty list of different, non-empty strings."""
    if isinstance(values, str):
        raise TypeError(f"{name} must be a list of labels")
    values = list(values)
    if not values or len(set(values)) != len(values) or not all(isinstance(v, str) and v for v in values):
        raise ValueError(f"{name} must hold different labels")
    return values


def require_unique(df: DataFrame, keys: Sequence[str], name: str = "table") -> None:
    bad = df.groupBy(*keys).count().filter("count > 1").limit(1).count()
    missing = df.filter(" or ".join(f"`{k}` is null" for k in keys)).limit(1).count()
    if bad or missing:
        raise ValueError(f"{name} has repeated or null keys {list(keys)}")


def require_finite(df: DataFrame, columns: Sequence[str], name: str = "table", allow_missing: bool = True) -> None:
    for c in columns:
        value = F.col(c).cast("double")
        bad = F.isnan(value) | (F.abs(value) == float("inf"))
        if not allow_missing:
            bad = bad | value.isNull()
        if df.filter(bad).limit(1).count():
            raise ValueError(f"{name}.{c} must be finite")


def require_returns(df: DataFrame, column: str) -> None:
    if df.filter(F.col(column) < -1).limit(1).count():
        raise ValueError(f"{column} has returns under -1")


def ohlcv_violations(prices: DataFrame) -> DataFrame:
    """One row: null keys, repeated keys, prices not above 0, negative volumes."""
    rows = prices.groupBy("date", "ticker").agg(
        F.count("*").alias("n"),
        F.count_if(~(F.col("adj_close") > 0)).alias("bad_price"),
        F.count_if(F.col("volume") < 0).alias("bad_volume"),
    )
    return rows.agg(
        F.count_if(F.col("date").isNull() | F.col("ticker").isNull()).alias("null_keys"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("repeated_keys"),
        F.coalesce(F.sum("bad_price"), F.lit(0)).alias("bad_prices"),
        F.coalesce(F.sum("bad_volume"), F.lit(0)).alias("bad_volumes"),
    )


def validate_ohlcv(prices: DataFrame) -> None:
    require_columns(prices, ["date", "ticker", "adj_close", "volume"], "prices")
    found = ohlcv_violations(prices).first().asDict()
    bad = {k: v for k, v in found.items() if v}
    if bad:
        raise ValueError(f"prices break their contract: {bad}")


@dataclass(frozen=True)
class Contract:
    """A persisted dataset: file, keys, required columns and date column."""

    filename: str
    keys: tuple[str, ...]
    columns: tuple[str, ...] = field(default_factory=tuple)
    date: str | None = "date"


def validate_dataset(df: DataFrame, contract: Contract) -> None:
    require_columns(df, [*contract.keys, *contract.columns], contract.filename)
    if not df.limit(1).count():
        raise ValueError(f"{contract.filename} is empty")
    require_unique(df, contract.keys, contract.filename)
    if contract.date and df.filter(F.try_to_timestamp(F.col(contract.date).cast("string")).isNull()).limit(1).count():
        raise ValueError(f"{contract.filename} has rows without a date")


def same_keys(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> bool:
    """Equal key sets, compared as text."""
    x, y = (d.select(*[F.col(k).cast("string") for k in keys]) for d in (a, b))
    return not x.exceptAll(y).limit(1).count() and not y.exceptAll(x).limit(1).count()


def largest_differences(a: DataFrame, b: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Rows in one table only, and the largest absolute difference of each value column."""
    left = a.select(*keys, *[F.col(v).alias(f"a_{v}") for v in values], F.lit(1).alias("in_a"))
    right = b.select(*keys, *[F.col(v).alias(f"b_{v}") for v in values], F.lit(1).alias("in_b"))
    return left.join(right, list(keys), "full").agg(
        F.count_if(F.col("in_a").isNull() | F.col("in_b").isNull()).alias("unmatched"),
        *[F.max(F.abs(F.col(f"a_{v}") - F.col(f"b_{v}"))).alias(f"diff_{v}") for v in values],
    )
