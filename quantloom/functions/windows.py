"""Ordered-row window helpers: lags, guarded rolling aggregates, carry-forward.

Frames are row frames inside an ordered partition; a rolling value is null until
the frame holds ``min_periods`` non-null inputs.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def ordered(keys: Sequence[str], order: str = "date") -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(order)


def clean(value: Column | str) -> Column:
    """NaN and infinities as null."""
    value = F.col(value) if isinstance(value, str) else value
    value = value.cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)


def lag(value: str, rows: int, keys: Sequence[str], order: str = "date") -> Column:
    return F.lag(value, rows).over(ordered(keys, order))


def change(value: str, rows: int, keys: Sequence[str], order: str = "date") -> Column:
    """value / lagged value - 1; null where the lagged value is 0 or missing."""
    return F.try_divide(F.col(value), lag(value, rows, keys, order)) - 1


def frame(spec: WindowSpec, window: int, skip: int = 0) -> WindowSpec:
    """The ``window`` rows that end ``skip`` rows before the current one."""
    return spec.rowsBetween(-(window - 1) - skip, -skip)


def rolling(
    aggregate: Callable[[Column], Column],
    value: Column | str,
    spec: WindowSpec,
    window: int,
    min_periods: int | None = None,
    skip: int = 0,
) -> Column:
    value = F.col(value) if isinstance(value, str) else value
    rows = frame(spec, window, skip)
    need = window if min_periods is None else min_periods
    return F.when(F.count(value).over(rows) >= need, aggregate(value).over(rows))


def upto(spec: WindowSpec) -> WindowSpec:
    return spec.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def before(spec: WindowSpec) -> WindowSpec:
    return spec.rowsBetween(Window.unboundedPreceding, -1)


def carried(value: Column | str, spec: WindowSpec) -> Column:
    """The last non-null value on or before the row."""
    return F.last(value, ignorenulls=True).over(upto(spec))
