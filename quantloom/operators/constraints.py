"""Constraints that ride on the plan.

A rule is a column that must be true; the first row that breaks one stops the job
that reads it, with the rule's name and the row's key.  Rules are filters over
columns that the plan reads anyway, and keys are checked in the windows that it
sorts anyway, so there is no job, scan or shuffle of their own.  Rules over a
whole table (counts, sums) are metrics of the job that writes or collects it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from quantloom.functions.windows import ordered

_INFINITE = float("inf")


def enforce(df: DataFrame, rules: Mapping[str, Column], name: str = "table", key: Sequence[str] = ()) -> DataFrame:
    """``df``, whose rows must all keep the rules; a null rule is broken.

    The test counts as not deterministic, so that no later filter is moved below
    it and no outer join turned into an inner one: rows that a later step would
    drop must keep the rules, too.
    """
    if not rules:
        return df
    broken = F.concat_ws(", ", *[F.when(~F.coalesce(rule, F.lit(False)), F.lit(label)) for label, rule in rules.items()])
    where = F.to_json(F.struct(*key)) if key else F.lit("")
    message = F.concat(F.lit(f"{name}: "), broken, F.lit(" "), F.coalesce(where, F.lit("")))
    return df.filter(F.when(broken == "", F.spark_partition_id() >= 0).otherwise(F.raise_error(message).cast("boolean")))


def finite(column: str, allow_null: bool = True) -> Column:
    """Neither NaN nor infinite."""
    value = F.col(column).cast("double")
    fine = ~F.isnan(value) & (F.abs(value) < _INFINITE)
    return F.coalesce(fine, F.lit(allow_null))


def at_least(column: str, least: float, allow_null: bool = True) -> Column:
    return F.coalesce(F.col(column) >= least, F.lit(allow_null))


def above(column: str, bound: float, allow_null: bool = True) -> Column:
    return F.coalesce(F.col(column) > bound, F.lit(allow_null))


def present(*columns: str) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & F.col(c).isNotNull()
    return out


def one_of(column: str, values: Sequence[str]) -> Column:
    return F.coalesce(F.col(column).isin(list(values)), F.lit(False))


def numeric(column: str) -> Column:
    """The column as double; text that is no number stops the job, null stays null."""
    value = F.col(column)
    number = value.try_cast("double")
    return F.when(value.isNull() | number.isNotNull(), number).otherwise(F.raise_error(F.concat(F.lit(f"{column} is no number: "), value.cast("string"))).cast("double"))


def once_in_order(keys: Sequence[str], order: str = "date") -> Column:
    """True where no row before, in the order of the window over ``keys``, has the same key and order value."""
    return ~F.coalesce(F.lag(order).over(ordered(keys, order)).eqNullSafe(F.col(order)) & (F.row_number().over(ordered(keys, order)) > 1), F.lit(False))


def unique_rows(df: DataFrame, keys: Sequence[str], order: str = "date", name: str = "table") -> DataFrame:
    """``df``, whose keys and order value must be there and occur once; for plans that sort by them anyway."""
    staged = df.withColumn("_once", once_in_order(keys, order))
    rules = {"a key is missing": present(*keys, order), "a key occurs twice": F.col("_once")}
    return enforce(staged, rules, name, [*keys, order]).drop("_once")


def one_label(df: DataFrame, key: str, label: str, name: str = "table") -> DataFrame:
    """key and label, one row per key; a key with two labels stops the job, labels that are null do not count."""
    ends = df.groupBy(key).agg(F.min(label).alias(label), F.max(label).alias("_other"))
    return enforce(ends, {f"two values of {label}": F.col(label).eqNullSafe(F.col("_other"))}, name, [key, label, "_other"]).drop("_other")


class Watched:
    """A frame whose next action also computes aggregates; ``verify`` then raises for each rule that is not true.

    ``rules`` maps a name to an aggregate that must be true, for example
    ``F.count(F.lit(1)) > 0``.
    """

    def __init__(self, df: DataFrame, rules: Mapping[str, Column], name: str = "table"):
        self._seen, self._name, self._rules = Observation(), name, list(rules)
        self.frame = df.observe(self._seen, *[rule.alias(f"r{i}") for i, rule in enumerate(rules.values())])

    def verify(self) -> None:
        """To be called after the action; blocks until its metrics are there."""
        found = self._seen.get
        broken = [label for i, label in enumerate(self._rules) if found.get(f"r{i}") is not True]
        if broken:
            raise ValueError(f"{self._name}: {', '.join(broken)}")
