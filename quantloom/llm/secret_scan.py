r"""Secret scan: fixed patterns, and character Markov models for the rest.

Base: assignments, access keys and long hexadecimal runs, each found leftmost
and non-overlapping in code points.  Method: two first-order Markov models over
characters, of random strings and of ordinary identifiers.  The training samples
carry labels by rule: the values that the base patterns find are random strings,
identifiers of 4 to 15 characters that are no access key or hexadecimal run are
ordinary, over all documents, each word weighed by how often it occurs.
Candidates are what base spans leave of runs of ``SHORTEST`` or more token
characters, letters alone too, but not numbers.  A candidate is a secret if its log-likelihood
ratio, summed over pairs of neighbours, exceeds ``threshold`` per pair and
``evidence`` in all, so a short one must be the more distinct.

Defined results.  Null text is empty: no spans.  Rows with the same doc_id and
text give a row each.  With no base match anywhere there are no random strings to
learn from, and the method adds nothing.  Columns beside doc_id and text are
ignored by the scan and kept by :func:`redact`; n_chars, if there, follows the
text.

Scale.  The scan reads the texts once into a table of matches, :func:`redact`
again to replace spans in place; neither shuffles texts.  Training shuffles
distinct words with their counts; the models are 66 x 66 tables.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import PLACES, SPACE, let, packed, placed_matches, scratch

ASSIGN = (
    r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
#: kind, pattern, value group, least characters of the value.
KINDS = (
    ("assign", ASSIGN, 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
SHORTEST = 16
CANDIDATE = rf"[A-Za-z0-9+/_=-]{{{SHORTEST},}}"
IDENTIFIER = rf"^[A-Za-z][A-Za-z0-9_-]{{3,{SHORTEST - 2}}}$"
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_="
OTHER = len(ALPHABET)
THRESHOLD = 0.25
EVIDENCE = 8.0


def _base_columns(text: Column) -> dict[str, Column]:
    """The placed matches of each base kind, behind cheap necessary conditions."""
    gates = {
        "assign": F.rlike(text, F.lit(r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]")),
        "access": F.contains(text, F.lit("AKIA")),
        "hex": F.rlike(text, F.lit(r"[0-9a-f]{24}")),
    }
    return {
        kind: F.when(
            gates[kind], F.filter(placed_matches(text, F.lit(pattern), group), lambda s: F.length(s["value"]) >= least)
        ).otherwise(F.array().cast(PLACES))
        for kind, pattern, group, least in KINDS
    }


def _left_over(run: Column, base: Column) -> Column:
    """The parts of a run that no base span covers, of ``SHORTEST`` characters or more."""

    def part(start, end):
        value = F.substring(run["value"], start - run["start"] + 1, end - start)
        return F.struct(start.alias("start"), end.alias("end"), value.alias("value"))

    def step(a, b):
        free = F.when(b["start"] - a["at"] >= SHORTEST, F.array_append(a["out"], part(a["at"], b["start"]))).otherwise(a["out"])
        return F.struct(F.greatest(a["at"], b["end"]).alias("at"), free.alias("out"))

    def last(a):
        return F.when(run["end"] - a["at"] >= SHORTEST, F.array_append(a["out"], part(a["at"], run["end"]))).otherwise(a["out"])

    touching = F.filter(base, lambda b: (b["start"] < run["end"]) & (run["start"] < b["end"]))
    begin = F.struct(run["start"].alias("at"), F.array().cast(PLACES).alias("out"))
    return F.when(F.size(touching) == 0, F.array(run)).otherwise(F.aggregate(F.array_sort(touching), begin, step, last))


def with_candidates(frame: DataFrame) -> DataFrame:
    """``frame`` (with a column text, never null) and its base matches by kind, and ``loose``: the candidates."""
    frame = frame.withColumns(_base_columns(F.col("text")))
    runs = F.when(F.rlike("text", F.lit(CANDIDATE)), placed_matches(F.col("text"), F.lit(CANDIDATE))).otherwise(F.array().cast(PLACES))
    base = F.concat("assign", "access", "hex")
    parts = F.flatten(F.transform(runs, lambda r: _left_over(r, base)))
    return frame.withColumn("loose", F.filter(parts, lambda s: F.rlike(s["value"], F.lit("[A-Za-z]"))))


def find_candidates(docs: DataFrame) -> DataFrame:
    """doc_id, one array of placed matches per base kind, and the other candidates."""
    return with_candidates(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))).drop("text")


def _code(character: Column) -> Column:
    at = F.instr(F.lit(ALPHABET), character)
    return F.when(at > 0, at - 1).otherwise(F.lit(OTHER))


def _pairs(value: Column) -> Column:
    """Codes of neighbouring characters, one number per pair."""
    n = OTHER + 1
    codes = F.transform(F.split(value, ""), _code)
    return let(
        F.filter(codes, lambda c: c.isNotNull()),
        lambda c: F.transform(
            F.sequence(F.lit(0), F.greatest(F.size(c) - 2, F.lit(0))),
            lambda i: F.get(c, i) * n + F.coalesce(F.get(c, i + 1), F.lit(OTHER)),
        ),
    )


def train_ratio(docs: DataFrame, found: DataFrame) -> list[float] | None:
    """log P(b | a, random) - log P(b | a, ordinary) for every pair of characters, add-one smoothed.

    ``found`` has the base matches of ``docs``.  The result has (alphabet + 1)
    squared entries whatever the input.
    """
    n = OTHER + 1
    random = found.select(F.explode(F.concat("assign", "access", "hex")).alias("s")).select(
        F.lit(1).alias("secret"), F.col("s.value").alias("value"), F.lit(1).cast("long").alias("times")
    )
    ordinary = (
        docs.select(F.explode(F.split(F.coalesce("text", F.lit("")), SPACE)).alias("value"))
        .filter(F.rlike("value", F.lit(IDENTIFIER)))
        .groupBy("value")
        .agg(F.count("*").alias("times"))
        # An identifier may be written in capitals as well.
        .select(F.lit(0).alias("secret"), F.explode(F.array_distinct(F.array("value", F.upper("value")))).alias("value"), "times")
    )
    counts = (
        random.unionByName(ordinary)
        .select("secret", "times", F.explode(_pairs(F.col("value"))).alias("pair"))
        .groupBy("secret", "pair")
        .agg(F.sum("times").alias("n"))
        .collect()
    )
    tables = [[1.0] * (n * n), [1.0] * (n * n)]
    seen = [0, 0]
    for row in counts:
        tables[row["secret"]][row["pair"]] += row["n"]
        seen[row["secret"]] += row["n"]
    if not seen[0] or not seen[1]:
        return None
    ratio = []
    for a in range(n):
        rows = [t[a * n : (a + 1) * n] for t in tables]
        totals = [sum(r) for r in rows]
        ratio += [math.log(rows[1][b] / totals[1]) - math.log(rows[0][b] / totals[0]) for b in range(n)]
    return ratio


def _all_spans(ratio: list[float] | None, threshold: float, evidence: float) -> Column:
    """Base and guessed spans (start, place of the kind, end, kind) in order, over the columns of the candidates."""
    if ratio is None:
        guessed = F.array().cast(PLACES)
    else:
        table = F.array(*[F.lit(round(x, 6)) for x in ratio])

        def distinct(pairs: Column) -> Column:
            total = F.aggregate(pairs, F.lit(0.0), lambda a, p: a + F.element_at(table, p + 1))
            return let(total, lambda t: (t > threshold * F.size(pairs)) & (t > evidence))

        guessed = F.filter("loose", lambda s: let(_pairs(s["value"]), distinct))
    kinds = [("assign", F.col("assign")), ("access", F.col("access")), ("hex", F.col("hex")), ("markov", guessed)]

    def tagged(k: int, name: str, column: Column) -> Column:
        return F.transform(
            column,
            lambda s: F.struct(
                s["start"].alias("start"), F.lit(k).alias("place"), s["end"].alias("end"), F.lit(name).alias("kind")
            ),
        )

    return F.array_sort(F.concat(*[tagged(k, name, column) for k, (name, column) in enumerate(kinds)]))


def scan_secrets(docs: DataFrame, threshold: float = THRESHOLD, evidence: float = EVIDENCE) -> DataFrame:
    """doc_id, counts per base kind, and spans: array of (start, end, kind), ordered by start and kind."""
    found = scratch(find_candidates(docs), "secret-candidates")
    return found.select(
        "doc_id",
        *[F.size(kind).cast("long").alias(f"n_{kind}") for kind in ("assign", "access", "hex")],
        _all_spans(train_ratio(docs, found), threshold, evidence).alias("spans"),
    )


def redact(docs: DataFrame, replacement: str = "[secret]", threshold: float = THRESHOLD, evidence: float = EVIDENCE) -> DataFrame:
    """The documents with every span replaced, in one projection; n_chars, if there, follows the text."""
    base = docs.select(F.coalesce("text", F.lit("")).alias("text"))
    ratio = train_ratio(docs, base.select(*[c.alias(k) for k, c in _base_columns(F.col("text")).items()]))
    frame = docs.select(packed(docs).alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    frame = with_candidates(frame).select("row", "text", _all_spans(ratio, threshold, evidence).alias("spans"))
    text = F.col("text")
    # From the left, each span contributes the text since the last one's end; overlapping spans merge.
    body = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts")),
        lambda a, s: F.struct(
            F.greatest(a["at"], s["end"]).alias("at"),
            F.when(
                s["start"] >= a["at"],
                F.concat(
                    a["parts"],
                    F.array(F.substring(text, a["at"] + 1, s["start"] - a["at"]), F.lit(replacement)),
                ),
            )
            .otherwise(a["parts"])
            .alias("parts"),
        ),
        lambda a: F.concat(F.array_join(a["parts"], ""), F.substring(text, a["at"] + 1, F.lit(2**31 - 1))),
    )
    clean = F.when(F.size("spans") > 0, body).otherwise(F.col("row")["text"])
    out = frame.select("row", clean.alias("clean"))
    row = F.col("row").withField("text", F.col("clean"))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        row = row.withField("n_chars", F.when(F.col("row")["n_chars"].isNotNull(), F.length("clean").cast(kind)))
    return out.select(row.alias("row")).select("row.*")


def _joined(spans: Column) -> Column:
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def op8_secrets(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = scan_secrets(docs)
    base = _joined(F.filter("spans", lambda s: s["kind"] != "markov"))
    return found.select(
        "doc_id",
        "n_assign",
        "n_access",
        "n_hex",
        F.sha2(base.cast("binary"), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"),
    )
