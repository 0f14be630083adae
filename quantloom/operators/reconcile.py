"""Differences between two versions of a table, cell by cell, and rows that break an identity.

Both versions go through one grouping by key (null keys are equal), so there is
one shuffle and no join; what comes out are the violations, not the data.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quantloom.functions.stats import TOLERANCE
from quantloom.functions.windows import ordered, upto
from quantloom.operators.contracts import require_columns

#: Kinds of differences: of schemas, of keys, of cells.
KINDS = ("missing_column", "extra_column", "type", "missing_row", "extra_row", "repeated_key", "value")
DIFFERENCE = "key string, column string, kind string, expected string, actual string, gap double"


def _numeric(kind: T.DataType) -> bool:
    return isinstance(kind, T.NumericType)


def _differs(a: Column, b: Column, kind: T.DataType, other: T.DataType, absolute: float, relative: float) -> tuple[Column, Column]:
    """Whether two cells differ, and by how much if they are numbers.  Null equals null, NaN equals NaN."""
    if not (_numeric(kind) and _numeric(other)):
        same_type = kind == other
        left, right = (a, b) if same_type else (a.cast("string"), b.cast("string"))
        return ~left.eqNullSafe(right), F.lit(None).cast("double")
    x, y = a.cast("double"), b.cast("double")
    gap = F.abs(x - y)
    # Without a tolerance numbers are compared as they are, also those that doubles do not tell apart.
    near = F.coalesce(gap <= absolute + relative * F.abs(x), F.lit(False)) if absolute or relative else F.lit(False)
    return ~(a.eqNullSafe(b) | near), gap


def schema_differences(expected: DataFrame, actual: DataFrame, ignore: Sequence[str] = ()) -> DataFrame:
    """Columns of one side only, and columns whose types differ (numbers with numbers are alike)."""
    a, b = ({f.name: f.dataType for f in d.schema.fields if f.name not in ignore} for d in (expected, actual))
    rows = [(None, c, "missing_column", a[c].simpleString(), None, None) for c in a if c not in b]
    rows += [(None, c, "extra_column", None, b[c].simpleString(), None) for c in b if c not in a]
    rows += [
        (None, c, "type", a[c].simpleString(), b[c].simpleString(), None) for c in a if c in b and a[c] != b[c] and not (_numeric(a[c]) and _numeric(b[c]))
    ]
    return expected.sparkSession.createDataFrame(rows, DIFFERENCE)


def row_differences(
    expected: DataFrame,
    actual: DataFrame,
    keys: Sequence[str],
    tolerances: Mapping[str, float] | None = None,
    tolerance: float = 0.0,
    relative: float = 0.0,
    ignore: Sequence[str] = (),
) -> DataFrame:
    """key, column, kind, expected, actual and gap of every difference; no row if both are equal.

    Cells differ when |expected - actual| > tolerance + relative * |expected|;
    ``tolerances`` sets it for single columns.  ``key`` is the key as JSON.  A key
    that occurs more than once on a side is named once and its cells are not
    compared.  Order of rows and columns counts for nothing.
    """
    require_columns(expected, keys, "expected")
    require_columns(actual, keys, "actual")
    tolerances = tolerances or {}
    kinds, others = ({f.name: f.dataType for f in d.schema.fields} for d in (expected, actual))
    both = [c for c in expected.columns if c in others and c not in keys and c not in ignore]
    unknown = sorted(set(tolerances) - set(both))
    if unknown:
        raise ValueError(f"tolerances for columns that are not compared: {unknown}")

    def side(df: DataFrame, name: str) -> DataFrame:
        row = F.struct(F.lit(True).alias("there"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(both)])
        key = F.struct(*[F.col(f"`{k}`").cast(kinds[k]).alias(k) for k in keys])
        return df.select(key.alias("key"), F.lit(name).alias("side"), row.alias(name))

    a, b = side(expected, "a"), side(actual, "b")
    union = a.unionByName(b, allowMissingColumns=True)
    grouped = union.groupBy("key").agg(
        *[F.count_if(F.col("side") == s).alias(f"n_{s}") for s in "ab"], *[F.first(s, ignorenulls=True).alias(s) for s in "ab"]
    )

    def found(kind: str, column: Column | None = None, x: Column | None = None, y: Column | None = None, gap: Column | None = None) -> Column:
        text = lambda c: F.lit(None).cast("string") if c is None else c.cast("string")
        return F.struct(
            text(column).alias("column"), F.lit(kind).alias("kind"), text(x).alias("expected"), text(y).alias("actual"),
            (F.lit(None) if gap is None else gap).cast("double").alias("gap"),
        )

    cells = []
    for i, c in enumerate(both):
        x, y = F.col("a")[f"c{i}"], F.col("b")[f"c{i}"]
        differs, gap = _differs(x, y, kinds[c], others[c], tolerances.get(c, tolerance), relative)
        show = lambda v, k: v if isinstance(k, T.AtomicType) else F.to_json(F.struct(v.alias("v")))
        cells.append(F.when(differs, found("value", F.lit(c), show(x, kinds[c]), show(y, others[c]), gap)))
    counts = F.col("n_a"), F.col("n_b")
    shape = (
        F.when((counts[0] > 1) | (counts[1] > 1), F.array(found("repeated_key", None, *counts)))
        .when(counts[1] == 0, F.array(found("missing_row")))
        .when(counts[0] == 0, F.array(found("extra_row")))
    )
    listed = F.filter(F.array(*cells), lambda v: v.isNotNull()) if cells else F.array().cast(grouped.select(F.array(found("value")).alias("x")).schema["x"].dataType)
    rows = grouped.select(F.to_json("key", {"ignoreNullFields": "false"}).alias("key"), F.explode(F.coalesce(shape, listed)).alias("d")).select("key", "d.*")
    return schema_differences(expected, actual, ignore).unionByName(rows)


def summarise_differences(differences: DataFrame) -> DataFrame:
    """column, kind, count and largest gap."""
    return differences.groupBy("column", "kind").agg(F.count("*").alias("count"), F.max("gap").alias("largest_gap"))


def require_equal(expected: DataFrame, actual: DataFrame, keys: Sequence[str], name: str = "table", **options) -> None:
    """Raise with the first differences, if there are any."""
    found = row_differences(expected, actual, keys, **options).limit(5).collect()
    if found:
        raise ValueError(f"{name} differs: " + "; ".join(f"{r.kind} {r.column or ''} at {r.key}: {r.expected} -> {r.actual}" for r in found))


def identity_violations(df: DataFrame, identities: Mapping[str, Column], keys: Sequence[str], tolerance: float = TOLERANCE) -> DataFrame:
    """keys, check and residual of every row whose residual is not within the tolerance; a null residual is none."""
    found = F.array(*[F.when(~F.coalesce(F.abs(r) < tolerance, F.lit(False)), F.struct(F.lit(k).alias("check"), r.cast("double").alias("residual"))) for k, r in identities.items()])
    return df.select(*keys, F.explode(F.filter(found, lambda v: v.isNotNull())).alias("v")).select(*keys, "v.*")


def accounting_identities(cost: Column | float) -> dict[str, Column]:
    """Residuals that daily results must keep; ``cost`` in basis points."""
    cost = F.lit(float(cost)) if not isinstance(cost, Column) else cost
    return {
        "long_short_return": F.col("long_return") + F.col("short_return") - F.col("gross_return"),
        "net_return": F.col("gross_return") - F.col("transaction_cost") - F.col("net_return"),
        "transaction_cost": F.col("turnover") * cost / 10_000 - F.col("transaction_cost"),
        "gross_exposure": F.col("long_exposure") + F.col("short_exposure") - F.col("gross_exposure"),
        "net_exposure": F.col("long_exposure") - F.col("short_exposure") - F.col("net_exposure"),
    }


def cumulative_residuals(daily: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``daily`` with the difference of its running wealth columns from the product of its returns."""
    spec = upto(ordered(keys))
    return daily.withColumns({f"residual_{k}": F.product(1 + F.col(f"{k}_return")).over(spec) - F.col(f"{k}_cumulative_return") for k in ("gross", "net")})


def calendar_violations(daily: DataFrame, calendar: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, date and kind: dates of the calendar that a key lacks, and dates that the calendar lacks.

    The calendar is a table of dates; its distinct dates meet each key's set of
    dates, so nothing is paired that is not missing.
    """
    dates = calendar.select("date").distinct().agg(F.collect_set("date").alias("all"))
    own = daily.groupBy(*keys).agg(F.collect_set("date").alias("own"))
    gaps = own.crossJoin(F.broadcast(dates)).select(
        *keys,
        F.explode(
            F.concat(
                F.transform(F.array_except("all", "own"), lambda d: F.struct(d.alias("date"), F.lit("missing").alias("kind"))),
                F.transform(F.array_except("own", "all"), lambda d: F.struct(d.alias("date"), F.lit("extra").alias("kind"))),
            )
        ).alias("v"),
    )
    return gaps.select(*keys, "v.*")


def attribution_group_violations(data: Mapping[str, DataFrame], cost: float, keys: Sequence[str] = ("portfolio",), tolerance: float = 1e-9) -> DataFrame:
    """check, key and detail of everything that an attribution group breaks.

    ``data`` holds portfolio_daily, benchmark_daily, security_daily and
    strategies; checked are the accounting identities, running wealth, each
    portfolio's calendar, and the sums of the securities.
    """
    from quantloom.operators.attribution import AUDITED, portfolio_attribution

    daily = data["portfolio_daily"]
    staged = cumulative_residuals(daily, keys)
    identities = accounting_identities(cost) | {f"{k}_cumulative_return": F.col(f"residual_{k}") for k in ("gross", "net")}
    broken = identity_violations(staged, identities, [*keys, "date"], tolerance)
    row = F.to_json(F.struct(*keys, "date"))
    parts = [broken.select("check", row.alias("key"), F.col("residual").cast("string").alias("detail"))]
    off = calendar_violations(daily, data["benchmark_daily"], keys)
    parts.append(off.select(F.lit("calendar").alias("check"), row.alias("key"), F.col("kind").alias("detail")))
    traded = daily.filter("gross_exposure > 0 or turnover > 0").select(*keys, "date", *AUDITED)
    sums = portfolio_attribution(data["security_daily"], keys).select(*keys, "date", *AUDITED)
    gaps = row_differences(traded, sums, [*keys, "date"], tolerance=tolerance)
    parts.append(gaps.select(F.concat_ws(":", F.lit("security_sums"), "kind", "column").alias("check"), "key", F.col("gap").cast("string").alias("detail")))
    return reduce(DataFrame.unionByName, parts)
