r"""Quality rules with risk-controlled cutoffs.

Each rule rejects a document whose statistic exceeds a cutoff.  Cutoffs are
chosen per stratum (language) on a labelled holdout: a cutoff
is admissible if the exact binomial test rejects "it loses more than
``risk / rules`` of the good documents" at level ``delta / hypotheses``
(Bonferroni over all strata, rules and cutoffs).  So with probability
1 - delta, no stratum loses more than ``risk`` of its good documents to all
rules together.  Among admissible cutoffs the one that rejects most bad holdout
documents is taken, the laxest of equals; without any bad one the rule is off.

Defined results.  Null text has no words and fails the base rule.  Documents
without a label (or with a null one) take no part in choosing cutoffs; with no
labels at all every rule is off.  A null lang is a stratum of its own
(named ''; others are named = and the lang).  Rows
that repeat a labelled doc_id count as often as they occur.  Columns beside
doc_id, text and lang (doc_id, quality of labels) are ignored.

Scale.  The texts are read once, into a narrow table of statistics; the
cutoffs come from counts per stratum, rule and grid step.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.llm.common import SPACE, let, scratch

RISK = 0.05
DELTA = 0.05
#: Statistic -> ascending grid of cutoffs.
GRIDS = {
    "symbol_ratio": (0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.6, 0.8, 1.0),
    "bang_ratio": (0.05, 0.1, 0.2, 0.3, 0.5, 0.8),
    "dup_line_ratio": (0.1, 0.2, 0.3, 0.4, 0.5, 0.7),
    "repeat_ratio": (0.1, 0.15, 0.2, 0.25, 0.3, 0.4),
    "mean_chars": (6.5, 7.0, 7.5, 8.0, 9.0, 12.0),
    "upper_ratio": (0.1, 0.2, 0.3, 0.4, 0.5, 0.7),
}


def _repeated_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more."""

    def count(w):
        n = F.size(w)
        windows = F.transform(
            F.sequence(F.lit(0), n - 3),
            lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i")),
        )

        def places(s):
            again = F.filter(
                F.sequence(F.lit(0), F.size(s) - 1),
                lambda k: F.coalesce(F.get(s, k)["h"] == F.get(s, k + 1)["h"], F.lit(False))
                | F.coalesce((k > 0) & (F.get(s, k)["h"] == F.get(s, F.greatest(k - 1, F.lit(0)))["h"]), F.lit(False)),
            )
            starts = F.array_sort(F.transform(again, lambda k: F.get(s, k)["i"]))
            return F.aggregate(
                starts,
                F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
                lambda a, i: F.struct((a["n"] + i + 3 - F.greatest(i, a["end"])).alias("n"), (i + 3).alias("end")),
                lambda a: a["n"],
            )

        return F.when(n >= 3, let(F.sort_array(windows), places)).otherwise(F.lit(0))

    return let(words, count)


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, stratum, the base counts of the contract and the statistics of the rules."""
    text = F.col("text")
    word = r"[^\x20\x09-\x0D]"
    base = docs.select("doc_id", "lang", F.coalesce(text, F.lit("")).alias("text"))
    base = base.withColumn("words", F.filter(F.split("text", SPACE), lambda w: w != "")).withColumn(
        "lines", F.filter(F.split("text", "\n"), lambda x: F.rlike(x, F.lit(word)))
    )
    counted = base.select(
        "doc_id",
        "lang",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").cast("long").alias("n_lines"),
        _repeated_words(F.col("words")).cast("long").alias("n_repeat_words"),
        F.length(F.regexp_replace("text", r"[^!]+", "")).cast("long").alias("n_bangs"),
        F.length(F.regexp_replace("text", r"[^A-Z]+", "")).cast("long").alias("n_upper"),
    )

    def per(part, whole):
        return F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(0.0)

    return counted.select(
        "*",
        F.when(F.col("lang").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), "lang")).alias("stratum"),
        ((F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).alias("base_failed"),
        per("n_symbols", "n_words").alias("symbol_ratio"),
        per("n_bangs", "n_words").alias("bang_ratio"),
        per("n_dup_lines", "n_lines").alias("dup_line_ratio"),
        per("n_repeat_words", "n_words").alias("repeat_ratio"),
        per("word_chars", "n_words").alias("mean_chars"),
        per("n_upper", "word_chars").alias("upper_ratio"),
    )


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(Bin(n, p) <= k), summed term by term in logarithms."""
    odds = math.log(p / (1 - p))
    first = n * F.lit(math.log1p(-p))

    def step(a, i):
        term = a["term"] + F.log((n - i + 1) / i) + odds
        high, low = F.greatest(a["total"], term), F.least(a["total"], term)
        return F.struct(term.alias("term"), (high + F.log1p(F.exp(low - high))).alias("total"))

    steps = F.when(k >= 1, F.sequence(F.lit(1).cast("long"), k.cast("long"))).otherwise(F.array().cast("array<bigint>"))
    return F.least(
        F.lit(1.0),
        F.aggregate(steps, F.struct(first.alias("term"), first.alias("total")), step, lambda a: F.exp(a["total"])),
    )


def choose_cutoffs(labelled: DataFrame, risk: float = RISK, delta: float = DELTA, grids=None) -> DataFrame:
    """stratum, rule, cutoff, n_good, lost, tail: the chosen cutoffs.  ``labelled`` has a column quality."""
    grids = GRIDS if grids is None else grids
    level = risk / len(grids)
    passed = [
        F.struct(
            F.lit(rule).alias("rule"),
            sum(((F.col(rule) > cut).cast("int") for cut in grid), F.lit(0)).alias("steps"),
        )
        for rule, grid in grids.items()
    ]
    good, bad = F.col("quality") == 1, F.col("quality") == 0
    counts = (
        labelled.filter("quality in (0, 1) and not base_failed")
        .select("stratum", "quality", F.explode(F.array(*passed)).alias("r"))
        .groupBy("stratum", "r.rule", "r.steps")
        .agg(F.count_if(good).alias("good"), F.count_if(bad).alias("bad"))
    )
    counts = scratch(counts, "rule-counts")
    hypotheses = max(1, counts.select("stratum").distinct().count()) * sum(len(g) for g in grids.values())
    totals = counts.groupBy("stratum", "rule").agg(F.sum("good").alias("n_good"))
    reached = (
        counts.filter("steps > 0")
        .withColumn("step", F.explode(F.sequence(F.lit(1), F.col("steps"))))
        .groupBy("stratum", "rule", "step")
        .agg(F.sum("good").alias("lost"), F.sum("bad").alias("caught"))
    )
    tested = (
        reached.join(totals, ["stratum", "rule"])
        # The tail is over 1/2 from the mean on, so it need not be summed there.
        .filter(F.col("lost") < F.col("n_good") * level)
        .withColumn("tail", binomial_tail(F.col("lost"), F.col("n_good"), level))
        .filter((F.col("tail") <= delta / hypotheses) & (F.col("caught") > 0))
    )
    best = Window.partitionBy("stratum", "rule").orderBy(F.desc("caught"), F.desc("step"))
    cutoff = F.lit(None).cast("double")
    for rule, grid in grids.items():
        at = F.element_at(F.array(*[F.lit(float(c)) for c in grid]), F.least(F.col("step"), F.lit(len(grid))))
        cutoff = F.when(F.col("rule") == rule, at).otherwise(cutoff)
    return (
        tested.withColumn("place", F.row_number().over(best))
        .filter("place = 1")
        .select("stratum", "rule", cutoff.alias("cutoff"), "n_good", "lost", "tail")
    )


def judge_quality(docs: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA, grids=None) -> DataFrame:
    """The statistics with ``rejected_by`` (rules, sorted) and ``kept``."""
    grids = GRIDS if grids is None else grids
    stats = scratch(statistics(docs), "rule-statistics")
    known = labels.select("doc_id", "quality").filter("quality is not null")
    cuts = choose_cutoffs(stats.join(known, "doc_id"), risk, delta, grids)
    wide = (
        cuts.groupBy("stratum")
        .agg(*[F.max(F.when(F.col("rule") == rule, F.col("cutoff"))).alias(f"cut_{rule}") for rule in grids])
        .withColumnRenamed("stratum", "cut_stratum")
    )
    fired = F.filter(
        F.array(*[F.when(F.col(rule) > F.col(f"cut_{rule}"), F.lit(rule)) for rule in sorted(grids)]),
        lambda x: x.isNotNull(),
    )
    judged = stats.join(wide, F.col("stratum") == F.col("cut_stratum"), "left").withColumn("rejected_by", fired)
    return judged.withColumn("kept", ~F.col("base_failed") & (F.size("rejected_by") == 0)).drop(
        "cut_stratum", *[f"cut_{rule}" for rule in grids]
    )


def op2_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return judge_quality(docs, labels).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
        "stratum",
        F.array_join("rejected_by", ",").alias("rejected_by"),
    )
