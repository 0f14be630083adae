"""Regressions on any number of columns, with errors robust to heteroskedasticity and autocorrelation.

Moments are sums of columns; what is left per key is a matrix of a few numbers,
inverted by elimination in array columns.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.functions.windows import ordered

#: A pivot below this share of its diagonal entry means that the columns depend on each other.
SINGULAR = 1e-12


def _let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def _range(n: int) -> Column:
    return F.sequence(F.lit(0), F.lit(n - 1))


def inverse(matrix: Column, n: int) -> Column:
    """Inverse of a symmetric positive definite n x n matrix (an array of rows); null if it is singular."""
    wide = F.transform(matrix, lambda row, i: F.concat(row, F.transform(_range(n), lambda j: (i == j).cast("double"))))

    def step(state, p):
        def eliminate(lead):
            return F.transform(state, lambda row, i: F.when(i == p, lead).otherwise(F.zip_with(row, lead, lambda x, y: x - row[p] * y)))

        pivot = F.when(F.abs(state[p][p]) > SINGULAR * F.abs(matrix[p][p]), state[p][p])
        return _let(F.transform(state[p], lambda x: x / pivot), eliminate)

    done = F.aggregate(_range(n), wide, step)
    out = F.transform(done, lambda row: F.slice(row, n + 1, n))
    return F.when(F.forall(F.flatten(out), lambda x: x.isNotNull()), out)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def matrix_vector(matrix: Column, vector: Column) -> Column:
    return F.transform(matrix, lambda row: dot(row, vector))


def product(a: Column, b: Column, n: int) -> Column:
    """a times b, both n x n."""
    return F.transform(a, lambda row: F.transform(_range(n), lambda j: dot(row, F.transform(b, lambda r: r[j]))))


def _symmetric(terms: Mapping[tuple[int, int], Column], n: int) -> Column:
    return F.array(*[F.array(*[terms[min(i, j), max(i, j)] for j in range(n)]) for i in range(n)])


def hac_fit(
    df: DataFrame,
    y: str,
    xs: Sequence[str],
    lags: int = 5,
    keys: Sequence[str] = (),
    contrasts: Mapping[str, Mapping[str, float]] | None = None,
    nulls: Mapping[str, float] | None = None,
    order: str = "date",
) -> DataFrame:
    """One row per key and term: estimate, error and t of an ordinary least squares fit with a constant.

    Errors are Newey-West with Bartlett weights 1 - l / (lags + 1) and no
    small-sample factor; ``lags`` 0 gives White's.  ``contrasts`` adds terms that
    are weighted sums of others, with the covariance between them; ``nulls`` are
    values that t is measured from (0 otherwise).  Rows with a null in any column
    are left out and do not count as lags.  If the columns depend on each other
    all numbers of the key are null.
    """
    if lags < 0:
        raise ValueError("lags must not be negative")
    contrasts, nulls = contrasts or {}, nulls or {}
    names = ["const", *xs]
    unknown = sorted({t for c in contrasts.values() for t in c} - set(names)) + sorted(set(nulls) - set(names) - set(contrasts))
    if unknown:
        raise ValueError(f"no such terms: {unknown}")
    n = len(names)
    there = F.lit(True)
    for c in (y, *xs):
        there = there & F.col(c).isNotNull()
    rows = df.filter(there).select(*keys, order, F.col(y).cast("double").alias("_y"), F.array(F.lit(1.0), *[F.col(x).cast("double") for x in xs]).alias("_x"))
    pairs = [(i, j) for i in range(n) for j in range(i, n)]
    sums = rows.groupBy(*keys).agg(
        F.count("*").alias("observations"),
        F.var_pop("_y").alias("_vy"),
        _symmetric({(i, j): F.sum(F.col("_x")[i] * F.col("_x")[j]) for i, j in pairs}, n).alias("_xx"),
        F.array(*[F.sum(F.col("_x")[i] * F.col("_y")) for i in range(n)]).alias("_xy"),
    )
    fits = sums.withColumn("_inv", inverse(F.col("_xx"), n)).withColumn("_b", matrix_vector(F.col("_inv"), F.col("_xy"))).drop("_xx", "_xy")
    fitted = rows.join(fits.select(*keys, "_b"), list(keys)) if keys else rows.crossJoin(F.broadcast(fits.select("_b")))
    fitted = fitted.withColumn("_u", F.col("_y") - dot(F.col("_b"), F.col("_x")))
    fitted = fitted.withColumn("_s", F.transform("_x", lambda x: x * F.col("_u")))
    spec = ordered(keys, order)
    back = {f"_s{k}": F.lag("_s", k).over(spec) for k in range(1, lags + 1)}
    fitted = fitted.withColumns(back) if back else fitted
    now = F.col("_s")
    middle = {}
    for i, j in pairs:
        total = now[i] * now[j]
        for k in range(1, lags + 1):
            then = F.col(f"_s{k}")
            total = total + (1 - k / (lags + 1)) * F.coalesce(now[i] * then[j] + now[j] * then[i], F.lit(0.0))
        middle[i, j] = F.sum(total)
    meat = fitted.groupBy(*keys).agg(_symmetric(middle, n).alias("_m"), F.sum(F.col("_u") * F.col("_u")).alias("_ssr"))
    both = fits.join(meat, list(keys)) if keys else fits.crossJoin(F.broadcast(meat))
    both = both.withColumn("_v", product(product(F.col("_inv"), F.col("_m"), n), F.col("_inv"), n))
    spread = F.col("_vy") * F.col("observations")
    both = both.withColumn("r_squared", 1 - F.try_divide(F.col("_ssr"), F.when(spread > 0, spread)))
    weights = {name: [float(i == k) for i in range(n)] for k, name in enumerate(names)}
    weights |= {name: [float(c.get(t, 0.0)) for t in names] for name, c in contrasts.items()}
    listed = []
    for name, w in weights.items():
        along = F.array(*[F.lit(x) for x in w])
        variance = dot(matrix_vector(F.col("_v"), along), along)
        listed.append(F.struct(F.lit(name).alias("term"), dot(F.col("_b"), along).alias("estimate"), F.sqrt(F.when(variance >= 0, variance).when(variance < 0, 0.0)).alias("error"), F.lit(float(nulls.get(name, 0.0))).alias("null_value")))
    out = both.select(*keys, "observations", "r_squared", F.explode(F.array(*listed)).alias("t")).select(*keys, "observations", "r_squared", "t.*")
    return out.withColumn("t", F.try_divide(F.col("estimate") - F.col("null_value"), F.when(F.col("error") > 0, F.col("error"))))


def asymmetric_beta(df: DataFrame, y: str, m: str, lags: int = 5, keys: Sequence[str] = ()) -> DataFrame:
    """Betas of y when the market rises and when it falls, their difference, and robust t statistics."""
    low = "downside_market_return"
    rows = df.withColumn(low, F.when(F.col(m) < 0, F.col(m)).when(F.col(m).isNotNull(), 0.0))
    long = hac_fit(rows, y, [m, low], lags, keys, {"downside": {m: 1.0, low: 1.0}}, {m: 1.0, "downside": 1.0})
    pick = lambda term, c: F.max(F.when(F.col("term") == term, F.col(c)))
    return long.groupBy(*keys).agg(
        F.max("observations").alias("observations"),
        pick("const", "estimate").alias("alpha"),
        pick("const", "t").alias("alpha_hac_t_stat"),
        pick(m, "estimate").alias("upside_market_beta"),
        pick("downside", "estimate").alias("downside_market_beta"),
        pick(low, "estimate").alias("downside_minus_upside_beta"),
        pick(low, "t").alias("beta_asymmetry_hac_t_stat"),
        pick(m, "t").alias("upside_beta_minus_one_hac_t_stat"),
        pick("downside", "t").alias("downside_beta_minus_one_hac_t_stat"),
        F.max("r_squared").alias("r_squared"),
    )


def short_basket_returns(daily: DataFrame, market: DataFrame) -> DataFrame:
    """portfolio, date, basket_return and market_return: what the names sold short earned for their holders."""
    basket = -F.try_divide(F.col("short_return"), F.when(F.col("short_exposure") > 0, F.col("short_exposure")))
    return daily.select("portfolio", "date", basket.alias("basket_return")).join(market.select("date", "market_return"), "date")
