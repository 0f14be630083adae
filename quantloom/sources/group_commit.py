"""Several datasets that become visible together.

A group lives under one root.  ``data/`` holds a new folder for every dataset
written, ``versions/`` one small manifest for every version.  A version exists
once its manifest is there whole (its last line is a checksum of the others), and
manifests are only ever added; so a reader sees all datasets of one version or
all of another, and whatever stops a writer before its manifest leaves the old
version as it was.  A manifest's number can be created once only: of two writers
who started from the same version one fails.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import time
import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quantloom.operators.contracts import Contract
from quantloom.operators.reconcile import row_differences, summarise_differences
from quantloom.sources.files import row_checksum
from quantloom.sources.loader import dataset_profile, profile_faults
from quantloom.sources.store import Store

MANIFEST = "dataset string, file string, rows bigint, columns int, start_date date, end_date date, read_back_passes boolean, version int"


class Conflict(RuntimeError):
    """Another writer committed first."""


@dataclass(frozen=True)
class Version:
    number: int
    created: float
    note: str = ""
    datasets: Mapping[str, dict] = field(default_factory=dict)


def _text(version: Version) -> str:
    body = json.dumps({"number": version.number, "created": version.created, "note": version.note, "datasets": version.datasets}, default=str)
    return f"{body}\n{hashlib.sha256(body.encode()).hexdigest()}\n"


def _file(number: int) -> str:
    return f"versions/{number:010d}.json"


def _parsed(text: str) -> Version | None:
    body, _, rest = text.partition("\n")
    if hashlib.sha256(body.encode()).hexdigest() != rest.strip():
        return None
    return Version(**json.loads(body))


def _numbers(store: Store) -> list[int]:
    return [int(n.removesuffix(".json")) for n in store.names("versions") if n.endswith(".json")]


def versions(spark: SparkSession, root: str) -> list[Version]:
    """All whole versions, oldest first; what a stopped writer left behind is passed over."""
    store = Store(spark, root)
    found = [_parsed(store.read(_file(n))) for n in _numbers(store)]
    return [v for v in found if v]


def current(spark: SparkSession, root: str) -> Version | None:
    found = versions(spark, root)
    return found[-1] if found else None


def _write(df: DataFrame, store: Store, name: str, contract: Contract) -> dict:
    """Write a dataset beside the others and read it back: row count, checksum, keys and dates must be right."""
    folder = f"data/{name}/{uuid.uuid4().hex}"
    seen = Observation()
    # The sums of what was given ride on the write, so the plan runs once.
    df.observe(seen, F.count(F.lit(1)).alias("rows"), row_checksum(df).alias("checksum")).write.parquet(store.path(folder))
    given = seen.get
    back = df.sparkSession.read.schema(df.schema).parquet(store.path(folder))
    read = back.agg(F.count(F.lit(1)).alias("rows"), row_checksum(back).alias("checksum")).first().asDict()
    if read != given:
        raise ValueError(f"{name}: {given} was given, {read} can be read back")
    faults = profile_faults(df.columns, None, contract) or profile_faults(df.columns, profile := dataset_profile(back, contract), contract)
    if faults:
        raise ValueError(f"{name}: {'; '.join(faults)}")
    return {
        "folder": folder,
        "rows": given["rows"],
        "checksum": given["checksum"],
        "schema": df.schema.jsonValue(),
        "first": profile["first"],
        "last": profile["last"],
    }


def commit_group(
    spark: SparkSession,
    root: str,
    datasets: Mapping[str, DataFrame],
    contracts: Mapping[str, Contract],
    check: Callable[[Mapping[str, DataFrame]], None] | None = None,
    base: int | None = None,
    note: str = "",
) -> DataFrame:
    """Make ``datasets`` the group's new version; returns its manifest.

    ``base`` is the version that they were made from (default: the current one);
    if another has been committed since, ``Conflict`` is raised.  ``check`` gets
    the datasets as written, before they become visible.
    """
    if set(datasets) != set(contracts):
        raise ValueError(f"datasets and contracts differ: {sorted(set(datasets) ^ set(contracts))}")
    store = Store(spark, root)
    before = current(spark, root)
    base = (before.number if before else 0) if base is None else base
    if base != (before.number if before else 0):
        raise Conflict(f"version {base} is no longer the current one")
    entries: dict[str, dict] = {}
    try:
        for name, df in datasets.items():
            entries[name] = _write(df, store, name, contracts[name])
        if check:
            check({n: _dataset(spark, store, e) for n, e in entries.items()})
        _publish(spark, root, base, note, entries)
    except BaseException:
        for entry in entries.values():
            store.delete(entry["folder"])
        raise
    return manifest(spark, root, contracts)


def _publish(spark: SparkSession, root: str, base: int, note: str, entries: Mapping[str, dict]) -> None:
    """Add the manifest that makes a version visible: the one step that readers notice."""
    store = Store(spark, root)
    newest = current(spark, root)
    if (newest.number if newest else 0) != base:
        raise Conflict(f"version {base} is no longer the current one")
    # Numbers of damaged manifests are passed over, not used again.
    number = max([*_numbers(store), base]) + 1
    if not store.create(_file(number), _text(Version(number, time.time(), note, dict(entries)))):
        raise Conflict(f"version {number} has been committed by another writer")


def _dataset(spark: SparkSession, store: Store, entry: dict) -> DataFrame:
    return spark.read.schema(T.StructType.fromJson(entry["schema"])).parquet(store.path(entry["folder"]))


def read_group(spark: SparkSession, root: str, version: int | None = None) -> dict[str, DataFrame]:
    """All datasets of one version (default: the current one); later commits do not change them."""
    found = {v.number: v for v in versions(spark, root)}
    if not found or (version is not None and version not in found):
        raise FileNotFoundError(f"{root} has no version {version or ''}".rstrip())
    chosen = found[max(found) if version is None else version]
    store = Store(spark, root)
    return {n: _dataset(spark, store, e) for n, e in chosen.datasets.items()}


def manifest(spark: SparkSession, root: str, contracts: Mapping[str, Contract]) -> DataFrame:
    """dataset, file, rows, columns, first and last date of the current version."""
    version = current(spark, root)
    day = lambda x: dt.date.fromisoformat(x) if isinstance(x, str) else x
    rows = [
        (n, contracts[n].filename if n in contracts else n, e["rows"], len(e["schema"]["fields"]), day(e["first"]), day(e["last"]), True, version.number)
        for n, e in (version.datasets if version else {}).items()
    ]
    return spark.createDataFrame(rows, MANIFEST)


def roll_back(spark: SparkSession, root: str, version: int) -> int:
    """Make an earlier version the newest again; returns its new number."""
    found = {v.number: v for v in versions(spark, root)}
    if version not in found:
        raise FileNotFoundError(f"{root} has no version {version}")
    _publish(spark, root, max(found), f"as version {version}", found[version].datasets)
    return current(spark, root).number


def expire(spark: SparkSession, root: str, keep: int = 2, older_than_hours: float = 24.0) -> list[str]:
    """Delete data folders that none of the last ``keep`` versions names and that no writer can still be filling."""
    if keep < 1:
        raise ValueError("at least the current version stays")
    store, known = Store(spark, root), versions(spark, root)
    named = {e["folder"] for v in known[-keep:] for e in v.datasets.values()}
    limit, gone = time.time() - older_than_hours * 3600, []
    for name in store.names("data"):
        for folder in store.names(f"data/{name}"):
            path = f"data/{name}/{folder}"
            if path not in named and store.modified(path).timestamp() <= limit:
                gone.append(path)
    for version in known[:-keep]:
        if any(e["folder"] in gone for e in version.datasets.values()):
            store.delete(_file(version.number))
    for path in gone:
        store.delete(path)
    return gone


def compare_group(
    spark: SparkSession, root: str, datasets: Mapping[str, DataFrame], contracts: Mapping[str, Contract], tolerance: float = 1e-12
) -> DataFrame:
    """dataset, column, kind, count and largest gap of what ``datasets`` would change; no row if nothing."""
    old, parts = read_group(spark, root), []
    for name, df in datasets.items():
        if name not in old:
            parts.append(spark.createDataFrame([(name, None, "new_dataset", None, None)], "dataset string, column string, kind string, count bigint, largest_gap double"))
            continue
        gaps = summarise_differences(row_differences(old[name], df, contracts[name].keys, tolerance=tolerance))
        parts.append(gaps.select(F.lit(name).alias("dataset"), "column", "kind", "count", "largest_gap"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def refresh_group(
    spark: SparkSession,
    root: str,
    make: Callable[[], Mapping[str, DataFrame]],
    contracts: Mapping[str, Contract],
    check: Callable[[Mapping[str, DataFrame]], None] | None = None,
    write: bool = False,
    tolerance: float = 1e-12,
) -> tuple[Sequence, int | None]:
    """Make the datasets anew and compare them with the current version; commit them only if ``write`` and something changed.

    Returns the rows of the comparison (none for a first version) and the number
    of the version that is current afterwards.
    """
    before = current(spark, root)
    datasets = make()
    changes = compare_group(spark, root, datasets, contracts, tolerance).collect() if before else []
    if write and (changes or not before):
        commit_group(spark, root, datasets, contracts, check, before.number if before else 0)
    after = current(spark, root)
    return changes, after.number if after else None
