"""Loader with a status per dataset, and commits of whole groups with failures planted between the steps."""

import datetime as dt
import pathlib
import shutil

import pytest
from pyspark.sql import functions as F

from quantloom.operators.contracts import Contract
from quantloom.sources import group_commit as G
from quantloom.sources import loader as L

CONTRACTS = {
    "daily": Contract("daily.parquet", ("portfolio", "date"), ("net_return",)),
    "flags": Contract("flags.parquet", ("entity",), ("status",), None),
}
AS_OF = dt.date(2024, 1, 12)


def daily(spark, last="2024-01-10", n=3):
    day = dt.date.fromisoformat(last)
    return spark.createDataFrame([("P", day - dt.timedelta(days=i), 0.01 * i) for i in range(n)], "portfolio string, date date, net_return double")


def flags(spark, status="PASS"):
    return spark.createDataFrame([("P", status), ("Q", status)], "entity string, status string")


@pytest.fixture
def group(spark, tmp_path):
    daily(spark).write.parquet(f"file://{tmp_path}/daily.parquet")
    flags(spark).coalesce(1).write.parquet(f"file://{tmp_path}/flags.parquet")
    return L.Group("attribution", f"file://{tmp_path}", CONTRACTS), tmp_path


def states(bundle):
    return {r.dataset: r.status for r in bundle.status.collect()}


def test_ready_and_undated(spark, group):
    bundle = L.load_groups(spark, [group[0]], AS_OF)
    assert states(bundle) == {"daily": "READY", "flags": "UNDATED"} and bundle.ready and not bundle.stale
    row = bundle.status.filter("dataset = 'daily'").first()
    assert (row.rows, row.columns, row.start_date, row.end_date, row.age_business_days, row.is_stale, row.group_valid) == (3, 3, dt.date(2024, 1, 8), dt.date(2024, 1, 10), 2, False, True)
    assert row.file_modified_at_utc is not None and bundle.datasets["attribution"]["daily"].count() == 3


def test_stale_and_proxy(spark, group):
    proxies = {("attribution", "flags"): ("attribution", "daily"), ("attribution", "nothing"): ("attribution", "daily")}
    bundle = L.load_groups(spark, [group[0]], "2024-03-01T13:00:00+02:00", proxies=proxies)
    assert states(bundle) == {"daily": "STALE", "flags": "STALE"} and bundle.ready and bundle.stale
    assert states(L.load_groups(spark, [group[0]], AS_OF, proxies=proxies))["flags"] == "READY"


def test_missing(spark, group):
    shutil.rmtree(group[1] / "flags.parquet")
    bundle = L.load_groups(spark, [group[0]], AS_OF, strict=False)
    assert states(bundle) == {"daily": "READY", "flags": "MISSING"} and not bundle.ready
    assert not bundle.status.filter("group_valid").count() and list(bundle.datasets["attribution"]) == ["daily"]
    with pytest.raises(L.LoadError, match="flags is missing"):
        L.load_groups(spark, [group[0]], AS_OF)


@pytest.mark.parametrize("damage", ["footer", "pages", "empty"])
def test_read_error(spark, group, damage):
    part = next((group[1] / "flags.parquet").glob("*.parquet"))
    raw = part.read_bytes()
    # Broken footers fail when the schema is read, broken pages when the rows are.
    part.write_bytes({"footer": raw[:-8] + b"\xff" * 8, "pages": b"PAR1" + b"\xff" * 60 + raw[64:], "empty": b""}[damage])
    pathlib.Path(part.parent / f".{part.name}.crc").unlink(missing_ok=True)
    bundle = L.load_groups(spark, [group[0]], AS_OF, strict=False)
    assert states(bundle) == {"daily": "READY", "flags": "READ_ERROR"}
    assert "could not be read" in bundle.errors[0] and "\n" not in bundle.errors[0]


@pytest.mark.parametrize(("make", "why"), [
    (lambda s: daily(s).drop("net_return"), "lacks columns"),
    (lambda s: daily(s).limit(0), "is empty"),
    (lambda s: daily(s).unionByName(daily(s, n=1)), "1 repeated keys"),
    (lambda s: daily(s).withColumn("portfolio", F.lit(None).cast("string")), "3 rows with null keys"),
    (lambda s: daily(s).withColumn("date", F.lit("no day")), "rows without a date"),
])
def test_invalid(spark, tmp_path, make, why):
    make(spark).write.parquet(f"file://{tmp_path}/daily.parquet")
    flags(spark).write.parquet(f"file://{tmp_path}/flags.parquet")
    bundle = L.load_groups(spark, [L.Group("g", f"file://{tmp_path}", CONTRACTS)], AS_OF, strict=False)
    row = bundle.status.filter("dataset = 'daily'").first()
    assert row.status == "INVALID" and why in row.error and row.loaded and not row.artifact_valid and states(bundle)["flags"] == "UNDATED"


def test_invalid_group(spark, group):
    def check(data):
        raise ValueError("entities differ\nand more")

    bad = L.Group("attribution", group[0].folder, CONTRACTS, check)
    bundle = L.load_groups(spark, [bad], AS_OF, strict=False, proxies={("attribution", "flags"): ("attribution", "daily")})
    assert set(states(bundle).values()) == {"INVALID_GROUP"} and len(bundle.errors) == 1 and len(bundle.datasets["attribution"]) == 2


def test_dates_and_arguments(spark, group):
    assert L.as_of_date(dt.datetime(2024, 1, 2, 23, 59)) == dt.date(2024, 1, 2) and L.as_of_date() == dt.date.today()
    assert [L.business_age(dt.date(2024, 1, 5), dt.date(2024, 1, d)) for d in (5, 6, 8, 9, 4)] == [0, 1, 1, 2, -1]
    for bad in (-1, True, 1.5):
        with pytest.raises(ValueError):
            L.load_groups(spark, [], stale_after=bad)


# --- commits ----------------------------------------------------------------------------


def contents(spark, root):
    data = G.read_group(spark, root)
    return data["daily"].count(), {r.status for r in data["flags"].collect()}


@pytest.fixture
def root(spark, tmp_path):
    root = f"file://{tmp_path}/group"
    G.commit_group(spark, root, {"daily": daily(spark), "flags": flags(spark)}, CONTRACTS)
    return root


def new(spark):
    return {"daily": daily(spark, n=5), "flags": flags(spark, "WARN")}


def test_commit_and_read(spark, root):
    out = G.commit_group(spark, root, new(spark), CONTRACTS, note="second").collect()
    assert contents(spark, root) == (5, {"WARN"}) and {(r.dataset, r.rows, r.version, r.read_back_passes) for r in out} == {("daily", 5, 2, True), ("flags", 2, 2, True)}
    assert G.read_group(spark, root, 1)["daily"].count() == 3 and [v.note for v in G.versions(spark, root)] == ["", "second"]
    with pytest.raises(FileNotFoundError):
        G.read_group(spark, root, 9)


@pytest.mark.parametrize("step", ["first write", "second write", "read back", "group check", "publish", "half a manifest"])
def test_whatever_fails_leaves_the_old_group(spark, root, step, monkeypatch):
    held = G.read_group(spark, root)
    data, check = new(spark), None
    boom = RuntimeError("planted")

    def fail(*_, **__):
        raise boom

    if step in ("first write", "second write"):
        name = "daily" if step == "first write" else "flags"
        data[name] = data[name].withColumn("x", F.when(F.rand() >= 0, F.raise_error(F.lit("planted"))).cast("int"))
    elif step == "read back":
        other = iter(range(9))
        monkeypatch.setattr(G, "row_checksum", lambda df: F.lit(str(next(other))) if next(other) > 0 else F.max(F.lit("x")))
    elif step == "group check":
        check = fail
    elif step == "publish":
        monkeypatch.setattr(G.Store, "create", fail)
    else:
        whole = G.Store.create

        def half(self, name, text):
            whole(self, name, text[: len(text) // 2])
            raise boom

        monkeypatch.setattr(G.Store, "create", half)
    with pytest.raises(Exception):
        G.commit_group(spark, root, data, CONTRACTS, check)
    monkeypatch.undo()
    assert contents(spark, root) == (3, {"PASS"}) and G.current(spark, root).number == 1 and held["daily"].count() == 3
    # The next writer is not held up by what the last one left.
    G.commit_group(spark, root, new(spark), CONTRACTS)
    assert contents(spark, root) == (5, {"WARN"})


def test_a_broken_contract_is_not_committed(spark, root):
    for bad in (daily(spark).unionByName(daily(spark)), daily(spark).limit(0), daily(spark).drop("net_return")):
        with pytest.raises(ValueError):
            G.commit_group(spark, root, new(spark) | {"daily": bad}, CONTRACTS)
    with pytest.raises(ValueError, match="differ"):
        G.commit_group(spark, root, {"daily": daily(spark)}, CONTRACTS)
    assert G.current(spark, root).number == 1


def test_one_of_two_writers_fails(spark, root):
    def meanwhile(data):
        G.commit_group(spark, root, {"daily": daily(spark, n=4), "flags": flags(spark)}, CONTRACTS)

    with pytest.raises(G.Conflict):
        G.commit_group(spark, root, new(spark), CONTRACTS, meanwhile)
    assert contents(spark, root) == (4, {"PASS"})
    with pytest.raises(G.Conflict):
        G.commit_group(spark, root, new(spark), CONTRACTS, base=1)


def test_checksum_sees_cells_and_not_order(spark):
    a = spark.createDataFrame([(1, None), (None, 1), (2, 2)], "a int, b int")
    total = lambda df: df.agg(G.row_checksum(df)).first()[0]
    assert total(a) == total(a.orderBy(F.desc("a")).repartition(3)) != total(a.selectExpr("b AS a", "a + 0 AS b").filter("a IS NULL OR b IS NULL OR true").limit(2))
    assert total(a.filter("a = 1")) != total(a.filter("b = 1")) and total(a.limit(0)) == "0"


def test_rollback_and_expiry(spark, root):
    G.commit_group(spark, root, new(spark), CONTRACTS)
    assert G.roll_back(spark, root, 1) == 3 and contents(spark, root) == (3, {"PASS"})
    assert G.expire(spark, root, keep=1) == []
    gone = G.expire(spark, root, keep=1, older_than_hours=0)
    assert len(gone) == 2 and contents(spark, root) == (3, {"PASS"}) and [v.number for v in G.versions(spark, root)] == [1, 3]
    with pytest.raises(ValueError):
        G.expire(spark, root, keep=0)


def test_refresh_is_a_dry_run_unless_told(spark, root):
    changes, number = G.refresh_group(spark, root, lambda: new(spark), CONTRACTS)
    assert number == 1 and {(r.dataset, r.kind) for r in changes} == {("daily", "extra_row"), ("flags", "value")} and contents(spark, root) == (3, {"PASS"})
    assert G.refresh_group(spark, root, lambda: new(spark), CONTRACTS, write=True)[1] == 2
    assert G.refresh_group(spark, root, lambda: new(spark), CONTRACTS, write=True) == ([], 2)


def test_first_refresh(spark, tmp_path):
    assert G.refresh_group(spark, f"file://{tmp_path}/fresh", lambda: new(spark), CONTRACTS) == ([], None)
    assert G.refresh_group(spark, f"file://{tmp_path}/fresh", lambda: new(spark), CONTRACTS, write=True) == ([], 1)


def test_checked_write_puts_the_old_data_back(spark, tmp_path, monkeypatch):
    from quantloom.sources import files

    path = f"file://{tmp_path}/one"
    assert files.write_checked(daily(spark), path, ("date",)).first()["rows"] == 3
    assert files.write_checked(daily(spark, n=5), path, ("date",)).first()["rows"] == 5
    other = iter(["a", "b"])
    monkeypatch.setattr(files, "row_checksum", lambda df: F.max(F.lit(next(other))))
    with pytest.raises(ValueError, match="differs"):
        files.write_checked(daily(spark), path, ("date",))
    assert spark.read.parquet(path).count() == 5 and [p.name for p in tmp_path.iterdir()] == ["one"]


def test_shared_tables_follow_their_source(spark, tmp_path):
    from quantloom.sources.shared import once

    source = f"file://{tmp_path}/source"
    daily(spark).write.parquet(f"{source}/daily.parquet")
    read = lambda: once(spark, source, "count", lambda: spark.read.parquet(f"{source}/daily.parquet").groupBy().count()).first()[0]
    assert read() == 3 and read() == 3
    daily(spark, n=5).write.parquet(f"{source}/more.parquet")
    spark.read.parquet(f"{source}/more.parquet").write.mode("append").parquet(f"{source}/daily.parquet")
    assert read() == 8
