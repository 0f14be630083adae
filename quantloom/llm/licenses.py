r"""License scan: base phrases and ordered signature rules.

A rule (:mod:`license_rules`) is a regular expression with a keyword that any
match must contain, a label, a priority and a confidence.  Keywords are looked for
once a text; of the rules only those whose keyword occurs are tried.  Detections
overlap; one that lies within a detection of better priority (or of the same
priority and longer) is suppressed, so "gnu general public license" does not add
to "gnu lesser general public license".

Base: places where a phrase's words stand consecutively; its labels always stay.

Defined results.  Null text is empty: no words, no labels, score 0.  Every row
gives a row, repeated ones too.  Columns beside doc_id and text are ignored.

Matches of a rule do not overlap each other.  Texts of any length and any number
of matches are treated whole, at a cost that grows with both.

Scale.  One projection over the texts; no shuffle, no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import let, lower_ascii, placed_matches
from quantloom.llm.license_rules import BY_LICENSE

SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Base phrases of the contract.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

#: A blank in a rule.
BLANK = r"[\s,-]+"


def signature_rules() -> list[tuple[int, str, str, str, float]]:
    """(priority, label, keyword, pattern, confidence); 1 is the best priority."""
    return [
        # "x ?y" allows for nothing between the parts, too.
        (priority, label, keyword, pattern.replace(" ?", r"[\s,-]*").replace(" ", BLANK), confidence)
        for label, rules in BY_LICENSE.items()
        for priority, keyword, pattern, confidence in rules
    ]


def _spans(text: Column, rule: Column) -> Column:
    """All matches of a rule as structs of start, end, priority, label and confidence."""
    return F.transform(
        placed_matches(text, rule["pattern"]),
        lambda s: F.struct(
            s["start"].alias("start"),
            (-s["end"]).alias("minus_end"),
            rule["priority"].alias("priority"),
            rule["label"].alias("label"),
            rule["confidence"].alias("confidence"),
        ),
    )


def _verdict(detections: Column) -> Column:
    """Labels and the best confidence of detections that no better one contains.

    In order of start (longest first), the furthest end per priority tells
    whether an earlier start of at least the same priority reaches as far.
    """
    reach = [F.lit(-1).alias(f"p{p}") for p in (1, 2, 3)]
    begin = F.struct(*reach, F.array().cast("array<string>").alias("labels"), F.lit(0.0).alias("miss"))

    def step(a, d):
        end = -d["minus_end"]
        inside = (
            (a["p1"] >= end)
            | ((d["priority"] >= 2) & (a["p2"] >= end))
            | ((d["priority"] >= 3) & (a["p3"] >= end))
        )
        return F.struct(
            *[
                F.when(d["priority"] == p, F.greatest(a[f"p{p}"], end)).otherwise(a[f"p{p}"]).alias(f"p{p}")
                for p in (1, 2, 3)
            ],
            F.when(inside, a["labels"]).otherwise(F.array_union(a["labels"], F.array(d["label"]))).alias("labels"),
            F.when(inside, a["miss"]).otherwise(F.greatest(a["miss"], d["confidence"])).alias("miss"),
        )

    ordered = F.array_sort(detections)
    return F.aggregate(ordered, begin, step, lambda a: F.struct(a["labels"].alias("labels"), a["miss"].alias("best")))


def _base_places(words: Column, phrase: str) -> Column:
    """Word positions (from 0) where the phrase's words stand consecutively."""
    parts = phrase.split(" ")
    first = F.transform(words, lambda w, i: F.when(w == parts[0], i))
    heads = F.filter(first, lambda i: i.isNotNull())

    def whole(i):
        same = F.lit(True)
        for k, part in enumerate(parts[1:], 1):
            same = same & F.coalesce(F.get(words, i + k) == part, F.lit(False))
        return same

    return F.filter(heads, whole)


def scan_licenses(docs: DataFrame, rules=None) -> DataFrame:
    """doc_id, n_words, base_places (struct per base label), base_labels, labels and score."""
    rules = signature_rules() if rules is None else rules
    table = F.array(
        *[
            F.struct(
                F.lit(p).alias("priority"),
                F.lit(label).alias("label"),
                F.lit(keyword).alias("keyword"),
                F.lit(pattern).alias("pattern"),
                F.lit(confidence).alias("confidence"),
            )
            for p, label, keyword, pattern, confidence in rules
        ]
    )
    low = F.col("low")
    keywords = sorted({keyword for _, _, keyword, *_ in rules})
    held = F.filter(F.array(*[F.when(F.contains(low, F.lit(k)), F.lit(k)) for k in keywords]), lambda x: x.isNotNull())
    base_gate = F.contains(low, F.lit("license")) | (F.contains(low, F.lit("cc")) & F.contains(low, F.lit("nc")))
    no_places = F.array().cast("array<int>")
    frame = docs.select("doc_id", lower_ascii(F.coalesce(F.col("text"), F.lit(""))).alias("low"))
    frame = frame.withColumn("words", F.filter(F.split("low", SEPARATOR), lambda w: w != "")).withColumn(
        "keywords", held
    )
    for phrase, label in BASE:
        gate = base_gate & F.contains(low, F.lit(phrase.split(" ")[-2]))
        frame = frame.withColumn(
            f"at_{label}", F.when(gate, _base_places(F.col("words"), phrase)).otherwise(no_places)
        )
    none = F.struct(F.array().cast("array<string>").alias("labels"), F.lit(0.0).alias("best"))
    fired = F.filter(table, lambda r: F.array_contains("keywords", r["keyword"]))
    verdict = _verdict(F.flatten(F.transform(fired, lambda r: _spans(low, r))))
    places = [F.col(f"at_{label}") for _, label in BASE]
    base_labels = F.filter(
        F.array(*[F.when(F.size(f"at_{label}") > 0, F.lit(label)) for _, label in BASE]), lambda x: x.isNotNull()
    )
    return (
        frame.withColumn("verdict", F.when(F.size("keywords") > 0, verdict).otherwise(none))
        .withColumn("places", F.concat(*places))
        .withColumn("base_labels", base_labels)
        .select(
            "doc_id",
            F.size("words").cast("long").alias("n_words"),
            "places",
            F.array_sort("base_labels").alias("base_labels"),
            F.array_sort(F.array_union("base_labels", "verdict.labels")).alias("labels"),
            F.greatest("verdict.best", F.when(F.size("base_labels") > 0, 1.0).otherwise(0.0)).alias("score"),
        )
    )


def op7_licenses(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scan_licenses(docs).select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places").cast("long").alias("first_word"),
        F.array_max("places").cast("long").alias("last_word"),
        F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"),
        "score",
    )
