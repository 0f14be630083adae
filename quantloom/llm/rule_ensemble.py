r"""Quality classifier: a sparse ensemble of conjunctive rules.

Shallow boosted trees over text statistics are fitted to labelled rows; every
path from a root to a node becomes a rule, a conjunction of thresholds.  A lasso
logistic regression picks few rules and weighs them.  The result is compiled
into one Spark column expression.

Fitting uses at most ``SAMPLE_ROWS`` labelled rows, the first by a hash of
doc_id, and only those outside the held-out fifth (crc32(doc_id as text) mod 5
= 0).  Language, source, doc_id and labels are never inputs of a score.

Defined results.  Null text counts as empty.  Labels other than 0 and 1 and
labels of unknown documents are ignored; of rows with one doc_id the one with the
smallest statistics is fitted.  Without both classes among the fitting
rows the score is the share of label 1 (1/2 without any label).  A null doc_id
is not held out and never used for fitting.  Repeated rows each get a row.
Columns beside doc_id and text (doc_id, quality of labels) are ignored.

Scale.  Statistics and scores are one projection over the texts, with no
shuffle; the fitting rows are found by a broadcast of at most ``SAMPLE_ROWS``
ids, and the fit sees a table of that many rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import SPACE, bucket_of, let

SAMPLE_ROWS = 20_000
HELD_OUT = 5
CUT = 0.3
STATISTICS = (
    "n_words",
    "mean_chars",
    "symbol_ratio",
    "bang_ratio",
    "pipe_ratio",
    "digit_ratio",
    "upper_ratio",
    "distinct_ratio",
    "punctuation_ratio",
    "line_words",
    "top_line_ratio",
)


def _kept_length(text: Column, drop: str) -> Column:
    return F.length(F.regexp_replace(text, drop, "")).cast("double")


def statistics(text: Column) -> list[Column]:
    """The statistics of a text as doubles, in the order of ``STATISTICS``."""
    text = F.coalesce(text, F.lit(""))
    chars = F.greatest(F.length(text).cast("double"), F.lit(1.0))
    shape = let(
        F.filter(F.split(text, SPACE), lambda w: w != ""),
        lambda w: F.struct(
            F.size(w).cast("double").alias("n"),
            F.size(F.array_distinct(w)).cast("double").alias("distinct"),
        ),
    )
    lines = let(
        F.filter(F.split(text, "\n"), lambda x: F.trim(x) != ""),
        lambda x: F.struct(
            F.size(x).cast("double").alias("n"), F.size(F.array_distinct(x)).cast("double").alias("distinct")
        ),
    )
    n = F.greatest(F.col("shape.n"), F.lit(1.0))
    columns = {
        "n_words": F.col("shape.n"),
        "mean_chars": chars / n,
        "symbol_ratio": _kept_length(text, r"[^#*$%&<>]+") / n,
        "bang_ratio": _kept_length(text, r"[^!]+") / n,
        "pipe_ratio": _kept_length(text, r"[^|]+") / n,
        "digit_ratio": _kept_length(text, r"[^0-9]+") / chars,
        "upper_ratio": _kept_length(text, r"[^\p{Lu}]+") / chars,
        "distinct_ratio": F.col("shape.distinct") / n,
        "punctuation_ratio": _kept_length(text, r"[^.,;:?]+") / n,
        "line_words": F.col("shape.n") / F.greatest(F.col("lines.n"), F.lit(1.0)),
        "top_line_ratio": F.col("lines.distinct") / F.greatest(F.col("lines.n"), F.lit(1.0)),
    }
    return [shape.alias("shape"), lines.alias("lines")], [columns[name].alias(name) for name in STATISTICS]


def with_statistics(docs: DataFrame, *keys: str) -> DataFrame:
    bases, columns = statistics(F.col("text"))
    return docs.select(*keys, "text", *bases).select(*keys, *columns)


@dataclass(frozen=True)
class Rule:
    """A conjunction of (statistic, above?, threshold) with its weight."""

    terms: tuple[tuple[int, bool, float], ...]
    weight: float = 0.0

    def holds(self, x: np.ndarray) -> np.ndarray:
        met = np.ones(len(x), bool)
        for j, above, cut in self.terms:
            met &= (x[:, j] > cut) == above
        return met

    def column(self) -> Column:
        met = F.lit(True)
        for j, above, cut in self.terms:
            statistic = F.col(STATISTICS[j])
            met = met & ((statistic > F.lit(cut)) if above else (statistic <= F.lit(cut)))
        return met


def _tree_rules(x, residual, hessian, edges, rng, depth: int, least: int):
    """Grow one tree on a random half of the rows; its rules and its step over all rows."""
    n, d = x.shape
    rows = rng.random(n) < 0.5
    found, step = [], np.zeros(n)

    def grow(inside, terms):
        take = inside & rows
        g, h = residual[take].sum(), hessian[take].sum() + 1.0
        best = None
        if len(terms) < depth and take.sum() >= 2 * least:
            for j in rng.choice(d, size=max(2, (2 * d) // 3), replace=False):
                cuts = edges[j]
                if not len(cuts):
                    continue
                place = np.searchsorted(cuts, x[take, j], side="left")  # x > cuts[k] exactly if place > k
                sums = np.bincount(place, residual[take], len(cuts) + 1)
                weights = np.bincount(place, hessian[take], len(cuts) + 1)
                count = np.bincount(place, minlength=len(cuts) + 1)
                low_g, low_h, low_n = (np.cumsum(v)[:-1] for v in (sums, weights, count))
                gain = low_g**2 / (low_h + 1) + (g - low_g) ** 2 / (h - low_h) - g**2 / h
                gain[(low_n < least) | (take.sum() - low_n < least)] = -1
                k = int(np.argmax(gain))
                if gain[k] > 1e-6 and (best is None or gain[k] > best[0]):
                    best = (gain[k], j, cuts[k])
        if terms:
            found.append(tuple(terms))
        if best is None:
            step[inside] = g / h
            return
        _, j, cut = best
        for above in (False, True):
            grow(inside & ((x[:, j] > cut) == above), [*terms, (int(j), above, float(cut))])

    grow(np.ones(n, bool), [])
    return found, step


def _simplify(terms):
    """Keep the tightest bound per statistic and side."""
    tight = {}
    for j, above, cut in terms:
        old = tight.get((j, above))
        tight[j, above] = cut if old is None else (max(old, cut) if above else min(old, cut))
    return tuple(sorted((j, above, cut) for (j, above), cut in tight.items()))


def _lasso_logistic(z: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 400):
    """Accelerated proximal gradient for the mean logistic loss plus ``penalty`` times the L1 norm."""
    n, m = z.shape
    weights, bias = np.zeros(m), float(np.log(y.mean() / (1 - y.mean())))
    ahead, ahead_bias, t = weights.copy(), bias, 1.0
    lipschitz = 0.25 * (np.linalg.norm(z, 2) ** 2 / n + 1)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(z @ ahead + ahead_bias)))
        new = ahead - z.T @ (p - y) / n / lipschitz
        new = np.sign(new) * np.maximum(np.abs(new) - penalty / lipschitz, 0)
        new_bias = ahead_bias - (p - y).mean() / lipschitz
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead = new + (t - 1) / t_new * (new - weights)
        ahead_bias = new_bias + (t - 1) / t_new * (new_bias - bias)
        weights, bias, t = new, new_bias, t_new
    return weights, bias


def fit_rules(x: np.ndarray, y: np.ndarray, trees=40, depth=3, rate=0.2, least=10, penalty=0.002, seed=7):
    """Rules with weights, and the bias, of the sparse ensemble."""
    if not len(y):
        return [], 0.0
    if y.min() == y.max():
        return [], float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
    rng = np.random.default_rng(seed)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0.01, 0.99, 50))) for j in range(x.shape[1])]
    score, rules = np.full(len(y), np.log(y.mean() / (1 - y.mean()))), {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        found, step = _tree_rules(x, y - p, p * (1 - p), edges, rng, depth, least)
        rules.update(dict.fromkeys(_simplify(t) for t in found))
        score += rate * step
    # Rules that hold on the same rows are one column.
    columns, kept = {}, []
    for terms in rules:
        held = Rule(terms).holds(x)
        share = held.mean()
        if 0.002 < share < 0.998 and columns.setdefault(held.tobytes(), terms) == terms:
            kept.append((terms, held))
    if not kept:
        return [], float(np.log(y.mean() / (1 - y.mean())))
    z = np.stack([h for _, h in kept], axis=1).astype(float)
    weights, bias = _lasso_logistic(z, y, penalty)
    return [Rule(t, float(w)) for (t, _), w in zip(kept, weights, strict=True) if abs(w) > 1e-4], bias


def training_rows(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Statistics and labels of the fitting rows: at most ``sample_rows`` ids, the first by a hash of doc_id, one row each."""
    chosen = (
        labels.filter("quality in (0, 1) and doc_id is not null")
        .filter(bucket_of(F.col("doc_id"), HELD_OUT) != 0)
        .groupBy("doc_id")
        .agg(F.max("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample_rows)
    )
    found = with_statistics(docs.join(F.broadcast(chosen), "doc_id"), "doc_id", "quality")
    one = found.groupBy("doc_id", "quality").agg(F.min(F.struct(*STATISTICS)).alias("s")).select("doc_id", "quality", "s.*")
    rows = one.toPandas().sort_values("doc_id", kind="stable")
    return rows[list(STATISTICS)].to_numpy(float), rows["quality"].to_numpy(float)


def score_column(rules: list[Rule], bias: float) -> Column:
    """1 / (1 + exp(-(bias + weights of the rules that hold)))."""
    total = F.lit(float(bias))
    for rule in rules:
        total = total + F.when(rule.column(), F.lit(rule.weight)).otherwise(0.0)
    return 1 / (1 + F.exp(-total))


def score_quality(docs: DataFrame, labels: DataFrame, *keys: str, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``keys`` (doc_id by default) and score of every document."""
    keys = keys or ("doc_id",)
    rules, bias = fit_rules(*training_rows(docs.select("doc_id", "text"), labels, sample_rows))
    return with_statistics(docs, *keys).select(*keys, score_column(rules, bias).alias("score"))


def keep_good(docs: DataFrame, labels: DataFrame, cut: float = CUT, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The documents that score ``cut`` or more, columns as given."""
    rules, bias = fit_rules(*training_rows(docs.select("doc_id", "text"), labels, sample_rows))
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text")
    scored = with_statistics(packed, "row").filter(score_column(rules, bias) >= cut)
    return scored.select("row.*")


def op6_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    held = F.coalesce(bucket_of(F.col("doc_id"), HELD_OUT) == 0, F.lit(False))
    return score_quality(docs, labels).select(
        "doc_id", held.alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted")
    )
