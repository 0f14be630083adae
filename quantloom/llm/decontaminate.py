r"""Benchmark decontamination by a prefix-filtered set join.

Benchmark items are cut into windows of ``window`` consecutive words; an item of
fewer words is one window.  A window is the set of its word shingles.  Because a
window must be contained whole, one shingle is a sufficient prefix: its rarest
in the corpus.  Documents' shingles are joined with these prefixes; a hit gives
the place where the window would start, which must lie within the document
(positional and length bounds), and the words there are compared exactly.

Defined results.  Null texts have no words.  Items without words never occur.
Repeated rows each get a row.  A null doc_id is kept.  A null
item_id is ignored.  Columns beside doc_id and text, item_id and text are
ignored.  Without documents the result is empty; without items nothing is hit.

Scale.  The documents are read twice, each time in one stage without shuffling
their words: once to count how frequent the items' shingles are, once to match.
The item side is broadcast in blocks of ``BLOCK_ROWS`` rows at most, with one
more pass over the documents for each further block, so what a task holds stays
bounded whatever the number of items.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import let, lower_ascii, packed, scratch, small

WINDOW = 10
SHINGLE = 3
BLOCK_ROWS = 100_000
#: Separators once A-Z are lower-cased.
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _words(text: Column) -> Column:
    return F.filter(F.split(lower_ascii(F.coalesce(text, F.lit(""))), SEPARATOR), lambda w: w != "")


def _hashes(words: Column, size: int) -> Column:
    """64-bit hashes of all shingles of ``size`` words, in order."""

    def all_of(w):
        at = F.sequence(F.lit(0), F.size(w) - size)
        return F.when(
            F.size(w) >= size, F.transform(at, lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(size)]))
        ).otherwise(F.array().cast("array<bigint>"))

    return let(words, all_of)


def item_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct windows: ``phrase``, ``words``, ``length`` and the ``items`` that have it (ids as text)."""
    w = F.col("words")
    length = F.least(F.lit(window), F.size(w))
    starts = F.sequence(F.lit(1), F.greatest(F.size(w) - window, F.lit(0)) + 1)
    return (
        items.filter(F.col("item_id").isNotNull())
        .select(F.col("item_id").cast("string").alias("item"), _words(F.col("text")).alias("words"))
        .filter(F.size("words") > 0)
        .select("item", F.explode(F.transform(starts, lambda i: F.slice(w, i, length))).alias("words"))
        .groupBy("words")
        .agg(F.collect_set("item").alias("items"))
        .select("words", "items", F.size("words").alias("length"), F.array_join("words", " ").alias("phrase"))
    )


def _tokens(windows: DataFrame, size: int) -> DataFrame:
    """One row per window and shingle: h, offset, with the window's columns."""
    fit = windows.filter(F.least(F.col("length"), F.lit(SHINGLE)) == size)
    return fit.select("phrase", "items", "length", F.posexplode(_hashes(F.col("words"), size)).alias("offset", "h"))


def _doc_hashes(docs: DataFrame, sizes: list[int]) -> DataFrame:
    """doc_id, mark, words and all shingle hashes of the sizes in use."""
    w = F.col("words")
    base = docs.select("doc_id", F.xxhash64("text").alias("mark"), _words(F.col("text")).alias("words"))
    return base.select(
        "doc_id", "mark", "words", *[_hashes(w, size).alias(f"h{size}") for size in sizes]
    )


def _prefixes(docs: DataFrame, windows: DataFrame, sizes: list[int]) -> DataFrame:
    """Each window with its rarest shingle in the corpus; windows with an absent shingle cannot occur."""
    tokens = scratch(reduce(DataFrame.unionByName, [_tokens(windows, s) for s in sizes]), "bench-tokens")
    counts = []
    hashed = _doc_hashes(docs, sizes)
    all_hashes = hashed.select(F.explode(F.concat(*[F.col(f"h{s}") for s in sizes])).alias("h"))
    for block in _blocks(tokens.select("h").distinct(), "h"):
        counts.append(all_hashes.join(F.broadcast(block), "h").groupBy("h").agg(F.count("*").alias("frequency")))
    frequency = reduce(DataFrame.unionByName, counts)
    known = tokens.join(frequency, "h", "left").withColumn("frequency", F.coalesce("frequency", F.lit(0)))
    rarest = known.groupBy("phrase").agg(F.min(F.struct("frequency", "h", "offset", "length", "items")).alias("least"))
    return scratch(
        rarest.filter("least.frequency > 0").select("phrase", "least.h", "least.offset", "least.length", "least.items"),
        "bench-prefixes",
    )


def _blocks(table: DataFrame, key: str) -> list[DataFrame]:
    """The table in hash blocks of about ``BLOCK_ROWS`` rows, each small enough to broadcast."""
    n = max(1, -(-table.count() // BLOCK_ROWS))
    if n == 1:
        return [table]
    return [table.filter(F.pmod(F.xxhash64(key), F.lit(n)) == i) for i in range(n)]


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, mark, n_words, n_hit, items, spans ([start, end) in words) of every document."""
    windows = scratch(item_windows(items, window), "bench-windows")
    sizes = [r[0] for r in windows.select(F.least("length", F.lit(SHINGLE)).alias("s")).distinct().collect()] or [SHINGLE]
    prefixes = _prefixes(docs, windows, sorted(sizes))
    hashed = _doc_hashes(docs, sorted(sizes))
    w = F.col("words")
    places = hashed.select(
        "doc_id",
        "mark",
        "words",
        F.explode(
            F.concat(
                F.array(F.struct(F.lit(-1).alias("at"), F.lit(None).cast("bigint").alias("h"))),
                *[F.transform(F.col(f"h{s}"), lambda h, i: F.struct(i.alias("at"), h.alias("h"))) for s in sorted(sizes)],
            )
        ).alias("place"),
    ).select("doc_id", "mark", "words", F.col("place.at").alias("at"), F.col("place.h").alias("h"))
    found = []
    for number, block in enumerate(_blocks(prefixes, "phrase")):
        start = F.col("at") - F.col("offset")
        fits = (start >= 0) & (start + F.col("length") <= F.size(w))
        same = F.array_join(F.slice(w, F.greatest(start, F.lit(0)) + 1, F.col("length")), " ") == F.col("phrase")
        # The row with at = -1 stands for the document itself.
        keep = F.col("at") == -1 if number == 0 else F.lit(False)
        found.append(
            places.join(F.broadcast(block), "h", "left")
            .filter(keep | (F.col("phrase").isNotNull() & fits & same))
            .select(
                "doc_id",
                "mark",
                F.when(F.col("at") == -1, F.size(w)).cast("long").alias("n_words"),
                F.when(F.col("at") >= 0, F.struct(start.alias("start"), (start + F.col("length")).alias("end"))).alias("span"),
                F.when(F.col("at") >= 0, F.col("items")).alias("items"),
            )
        )
    hits = reduce(DataFrame.unionByName, found)
    by_doc = hits.groupBy("doc_id", "mark").agg(
        F.max("n_words").alias("n_words"),
        F.count("n_words").alias("rows"),
        F.array_sort(F.collect_set("span")).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda a, s: F.struct(
            (a["n"] + F.greatest(s["end"] - F.greatest(s["start"], a["end"]), F.lit(0))).alias("n"),
            F.greatest(a["end"], s["end"]).alias("end"),
        ),
        lambda a: a["n"].cast("long"),
    )
    out = by_doc.select("doc_id", "mark", "n_words", covered.alias("n_hit"), "items", "spans", "rows")
    return out.withColumn("rows", F.explode(F.sequence(F.lit(1).cast("long"), "rows"))).drop("rows")


def clean_documents(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents without any window of the benchmark, columns as given.

    The texts are shuffled only if more documents are hit than may be broadcast.
    """
    found = decontaminate(docs.select("doc_id", "text"), items, window).filter("n_hit > 0")
    hit = scratch(found.select(F.col("doc_id").alias("hit_doc"), F.col("mark").alias("hit_mark")).distinct(), "bench-hits")
    rows = docs.select(packed(docs).alias("row"), "doc_id", F.xxhash64("text").alias("mark"))
    same = F.col("doc_id").eqNullSafe(F.col("hit_doc")) & (F.col("mark") == F.col("hit_mark"))
    return rows.join(small(hit), same, "left_anti").select("row.*")


def op4_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return decontaminate(docs, items).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP4_SQL = rf"""
WITH iw AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, l, array_to_string(w[i:i + l - 1], ' ') AS phrase
  FROM (SELECT item_id, w, least(10, len(w)) AS l, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM iw WHERE len(w) > 0)),
dw AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
pos AS (
  SELECT doc_id, l, i, array_to_string(w[i:i + l - 1], ' ') AS phrase
  FROM (SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM dw, (SELECT DISTINCT l FROM win) WHERE len(w) >= l)),
hit AS (SELECT pos.doc_id, pos.i, pos.l, win.item_id FROM pos JOIN win ON pos.l = win.l AND pos.phrase = win.phrase),
cov AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + l)) AS p FROM hit) GROUP BY doc_id),
its AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN cov ON dw.doc_id = cov.doc_id LEFT JOIN its ON dw.doc_id = its.doc_id
"""
