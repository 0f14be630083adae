"""Scan of a group of persisted datasets into one status table.

Every dataset is looked at on its own: a missing or damaged one leaves its mark
in its row and the others load.  One job per dataset counts rows, keys and dates
(a grouping by its keys); the data stay where they are.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.operators.contracts import Contract
from quantloom.sources.store import Store

STALE_AFTER = 5
#: Fixed states of a dataset.
STATES = ("MISSING", "READ_ERROR", "INVALID", "INVALID_GROUP", "STALE", "UNDATED", "READY")
#: Fixed columns of the status table.
STATUS = (
    "group string, dataset string, file string, path string, exists boolean, loaded boolean, artifact_valid boolean, group_valid boolean, "
    "rows bigint, columns int, start_date date, end_date date, latest_observation_date date, freshness_reference_date date, "
    "file_modified_at_utc timestamp, age_business_days int, is_stale boolean, status string, error string"
)
_NAMES = [c.split(" ")[0] for c in STATUS.split(", ")]


class LoadError(RuntimeError):
    """What a strict load found wrong, all of it."""

    def __init__(self, errors: list[str]):
        self.errors = tuple(errors)
        super().__init__("datasets cannot be loaded:\n" + "\n".join(f"- {e}" for e in errors))


@dataclass(frozen=True)
class Group:
    """Datasets that belong together: where they are, what each must be, and what must hold between them."""

    name: str
    folder: str
    contracts: Mapping[str, Contract]
    check: Callable[[Mapping[str, DataFrame]], None] | None = None


@dataclass(frozen=True)
class Bundle:
    """Loaded datasets by group, and the status of all."""

    datasets: Mapping[str, Mapping[str, DataFrame]]
    status: DataFrame
    errors: tuple[str, ...]
    as_of: dt.date

    @property
    def ready(self) -> bool:
        return not self.errors

    @property
    def stale(self) -> bool:
        return bool(self.status.filter("is_stale").limit(1).count())


def as_of_date(value: dt.date | dt.datetime | str | None = None) -> dt.date:
    """A day: today if nothing is given; times and time zones are cut off."""
    if value is None:
        return dt.date.today()
    if isinstance(value, str):
        value = dt.datetime.fromisoformat(value)
    return value.date() if isinstance(value, dt.datetime) else value


def business_age(since: dt.date, until: dt.date) -> int:
    """Mondays to Fridays in [since, until)."""

    def index(day: dt.date) -> int:
        weeks, rest = divmod(day.toordinal() - 1, 7)
        return 5 * weeks + min(rest, 5)

    return index(until) - index(since)


def blank_status(group: str, name: str, contract: Contract, store: Store) -> dict:
    """The row of a dataset that nothing is known of but whether it is there."""
    there = store.exists(contract.filename)
    modified = store.modified(contract.filename) if there else None
    row = dict.fromkeys(_NAMES) | {"loaded": False, "artifact_valid": False, "group_valid": False}
    return row | {
        "group": group,
        "dataset": name,
        "file": contract.filename,
        "path": store.path(contract.filename),
        "exists": there,
        "file_modified_at_utc": modified,
        "status": "NOT_LOADED" if there else "MISSING",
    }


def dataset_profile(df: DataFrame, contract: Contract) -> dict:
    """rows, rows with a null key, keys that occur again, rows without a date, first and last date: one job."""
    date = F.try_to_timestamp(F.col(f"`{contract.date}`").cast("string")).cast("date") if contract.date else F.lit(None).cast("date")
    missing = F.lit(False)
    for k in contract.keys:
        missing = missing | F.col(f"`{k}`").isNull()
    groups = df.groupBy(*[F.col(f"`{k}`") for k in contract.keys]).agg(
        F.count("*").alias("_n"),
        F.count_if(missing).alias("_null_keys"),
        F.count_if(date.isNull()).alias("_undated"),
        F.min(date).alias("_first"),
        F.max(date).alias("_last"),
    )
    out = groups.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum("_null_keys"), F.lit(0)).alias("null_keys"),
        F.count_if((F.col("_n") > 1) & (F.col("_null_keys") == 0)).alias("repeated_keys"),
        F.coalesce(F.sum("_undated"), F.lit(0)).alias("undated"),
        F.min("_first").alias("first"),
        F.max("_last").alias("last"),
    )
    return out.first().asDict()


def profile_faults(columns: list[str], profile: dict | None, contract: Contract) -> list[str]:
    """What a dataset breaks of its contract; without a profile only its columns are looked at."""
    missing = sorted({*contract.keys, *contract.columns, *([contract.date] if contract.date else [])} - set(columns))
    if missing:
        return [f"lacks columns {missing}"]
    if profile is None:
        return []
    faults = []
    if not profile["rows"]:
        faults.append("is empty")
    if profile["null_keys"]:
        faults.append(f"has {profile['null_keys']} rows with null keys")
    if profile["repeated_keys"]:
        faults.append(f"has {profile['repeated_keys']} repeated keys")
    if contract.date and profile["undated"]:
        faults.append(f"has {profile['undated']} rows without a date")
    return faults


def _freshness(row: dict, reference: dt.date | None, as_of: dt.date, stale_after: int) -> None:
    row["freshness_reference_date"] = reference
    if reference is None:
        row["status"] = "UNDATED"
        return
    row["age_business_days"] = business_age(reference, as_of)
    row["is_stale"] = row["age_business_days"] > stale_after
    row["status"] = "STALE" if row["is_stale"] else "READY"


def _first_line(error: Exception) -> str:
    return (str(error).splitlines() or [type(error).__name__])[0]


def scan_group(spark: SparkSession, group: Group, as_of: dt.date, stale_after: int) -> tuple[dict[str, DataFrame], list[dict], list[str]]:
    """Datasets that are valid, a status row for each of the group, and the errors."""
    store, datasets, rows, errors = Store(spark, group.folder), {}, [], []

    def fail(row: dict, status: str, message: str) -> None:
        row["status"], row["error"] = status, message
        errors.append(message)

    for name, contract in group.contracts.items():
        row = blank_status(group.name, name, contract, store)
        rows.append(row)
        if not row["exists"]:
            fail(row, "MISSING", f"{group.name}.{name} is missing: {row['path']}")
            continue
        try:
            df = spark.read.parquet(row["path"])
            faults = profile_faults(df.columns, None, contract)
            profile = None if faults else dataset_profile(df, contract)
        except Exception as error:  # whatever a reader finds wrong is the dataset's state
            fail(row, "READ_ERROR", f"{group.name}.{name} could not be read: {_first_line(error)}")
            continue
        row["loaded"] = True
        faults = faults or profile_faults(df.columns, profile, contract)
        if faults:
            fail(row, "INVALID", f"{group.name}.{name} is invalid: {'; '.join(faults)}")
            continue
        datasets[name] = df
        row |= {"artifact_valid": True, "rows": profile["rows"], "columns": len(df.columns)}
        if contract.date:
            row |= {"start_date": profile["first"], "end_date": profile["last"], "latest_observation_date": profile["last"]}
        _freshness(row, row["latest_observation_date"], as_of, stale_after)
    if len(datasets) == len(group.contracts):
        try:
            if group.check:
                group.check(datasets)
        except Exception as error:
            message = f"{group.name} is invalid as a group: {_first_line(error)}"
            errors.append(message)
            for row in rows:
                row["status"], row["error"] = "INVALID_GROUP", message
        else:
            for row in rows:
                row["group_valid"] = True
    return datasets, rows, errors


def _apply_proxies(rows: list[dict], proxies: Mapping[tuple[str, str], tuple[str, str]], as_of: dt.date, stale_after: int) -> None:
    """Datasets without a date of their own are as fresh as their proxies; only in groups that are valid."""
    found = {(r["group"], r["dataset"]): r for r in rows}
    for target, source in proxies.items():
        row, proxy = found.get(target), found.get(source)
        if row and proxy and row["group_valid"] and proxy["latest_observation_date"] is not None:
            _freshness(row, proxy["latest_observation_date"], as_of, stale_after)


def load_groups(
    spark: SparkSession,
    groups: list[Group],
    as_of: dt.date | dt.datetime | str | None = None,
    stale_after: int = STALE_AFTER,
    proxies: Mapping[tuple[str, str], tuple[str, str]] | None = None,
    strict: bool = True,
) -> Bundle:
    """Load what can be loaded of all groups.

    Stale datasets are loaded and are no error.  ``strict`` raises ``LoadError``
    with all errors; otherwise they are in the bundle and its status.
    """
    if isinstance(stale_after, bool) or not isinstance(stale_after, int) or stale_after < 0:
        raise ValueError("stale_after must be a whole number of days, not negative")
    day = as_of_date(as_of)
    datasets, rows, errors = {}, [], []
    for group in groups:
        datasets[group.name], own, wrong = scan_group(spark, group, day, stale_after)
        rows, errors = rows + own, errors + wrong
    _apply_proxies(rows, proxies or {}, day, stale_after)
    if strict and errors:
        raise LoadError(errors)
    status = spark.createDataFrame([tuple(r[c] for c in _NAMES) for r in rows], STATUS)
    return Bundle(datasets, status, tuple(errors), day)
