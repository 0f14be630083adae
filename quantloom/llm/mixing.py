"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its documents in shuffled order, repeated
``repeat`` times.  A copy's virtual finish time is the running number of tokens
of its source divided by the source's target.  Copies are ordered by finish
time over all sources, and the order is cut where the total budget is reached,
so that each source comes within one document of its target.

Defined results.  Null text has size 0.  A null source is a source of its own,
ordered last.  A document of size 0 takes 0 words.  The shuffle is the md5 of
doc_id, so reruns agree; rows with the same doc_id are ordered by size, and
equal rows are interchangeable.  A null doc_id shuffles as empty text.  An empty
table gives an empty result.  Columns beside doc_id, text and source are ignored
by :func:`mix` and carried along by :func:`mixed_documents`, where columns named
``copy`` and ``finish`` are replaced by its own.

Scale.  Words are counted in one pass over the texts; all later steps read a
narrow table.  Running sums never bring a source into one task: they are taken
inside about sqrt(n) shuffle buckets per source and carried over by the sums of
the buckets.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.llm.common import count_words, packed, scratch

WEIGHTS = (5, 2, 1)
BUDGET = 1.5
REPEAT = 2


def source_targets(sizes: DataFrame, weights=WEIGHTS, budget=BUDGET, repeat=REPEAT) -> DataFrame:
    """Per source: source_size, weight and target.

    Targets share ``budget`` times all sizes by weight; none exceeds ``repeat``
    times its source, and the excess goes to the others by weight.  With the
    sources ordered by cap over weight, a source is at its cap exactly if the
    level that would hold without the sources before it reaches its cap.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    by_ratio = Window.orderBy("ratio", F.col("source").isNull(), "source")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(0))
    place = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    return (
        sizes.groupBy("source")
        .agg(F.sum("size").alias("source_size"))
        .withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), place + 1))
        .withColumn("cap", F.col("source_size") * repeat)
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn(
            "level",
            (F.sum("source_size").over(everything) * budget - F.coalesce(F.sum("cap").over(before), F.lit(0)))
            / F.sum("weight").over(after),
        )
        .withColumn("full", F.col("weight") * F.col("level") >= F.col("cap"))
        .withColumn("water", F.min(F.when(~F.col("full"), F.struct("ratio", "level"))).over(everything)["level"])
        .withColumn(
            "target",
            F.when(F.col("full"), F.col("cap").cast("double")).otherwise(F.col("weight") * F.col("water")),
        )
        .select("source", "source_size", "target")
    )


def _digits(rows: int) -> int:
    """Hexadecimal digits for about sqrt(rows) buckets."""
    return max(1, math.ceil(math.log(max(rows, 2)) / 2 / math.log(16)))


def _queued(sizes: DataFrame, targets: DataFrame, digits: int) -> DataFrame:
    """Each document with ``upto``: its source's tokens in shuffled order up to and including it."""
    sizes = sizes.withColumn("bucket", F.substring("shuffle", 1, digits))
    inside = Window.partitionBy("source", "bucket").orderBy("shuffle", "doc_id", "size", "mark")
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = (
        sizes.groupBy("source", "bucket")
        .agg(F.sum("size").alias("in_bucket"))
        .withColumn("before", F.coalesce(F.sum("in_bucket").over(earlier), F.lit(0)))
    )
    heads = (
        sums.alias("s")
        .join(targets.alias("t"), F.col("s.source").eqNullSafe(F.col("t.source")))
        .select(F.col("s.source").alias("h_source"), F.col("s.bucket").alias("h_bucket"), "before", "source_size", "target")
    )
    running = F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    return (
        sizes.withColumn("within", running)
        .join(heads, F.col("source").eqNullSafe(F.col("h_source")) & (F.col("bucket") == F.col("h_bucket")))
        .withColumn("upto", F.col("before") + F.col("within"))
        .drop("h_source", "h_bucket", "before", "within", "bucket")
    )


def _finish(copy):
    """Virtual finish time of a copy; none where the source's target is 0."""
    served = F.col("upto") + copy * F.col("source_size")
    return F.when(F.col("target") > 0, served / F.col("target"))


def _place(copy):
    return F.struct(_finish(copy).alias("finish"), F.col("shuffle"), copy.alias("copy"), F.col("doc_id"), F.col("size"))


def _cut(queued: DataFrame, total: int, budget: float, repeat: int, digits: int):
    """The last place of the global order that is within the budget; None if all are.

    Finish times are dealt to equal intervals, whose sums show the one that the
    budget ends in; only that interval's copies are sorted.
    """
    slices = 16**digits
    copies = (
        queued.filter("target > 0 and size > 0")
        .withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(repeat - 1))))
        .select(_place(F.col("copy")).alias("place"), "size")
        .withColumn("slice", F.floor(F.col("place.finish") * slices))
    )
    sums = copies.groupBy("slice").agg(F.sum("size").alias("in_slice"))
    upto = F.sum("in_slice").over(Window.orderBy("slice"))
    ends = (
        sums.withColumn("upto", upto).filter(F.col("upto") > budget * total).orderBy("slice").limit(1).collect()
    )
    if not ends:
        return None
    end = ends[0]
    room = budget * total - (end["upto"] - end["in_slice"])
    running = F.sum("size").over(Window.partitionBy("slice").orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
    last = copies.filter(F.col("slice") == end["slice"]).withColumn("running", running)
    found = last.filter(F.col("running") <= room).agg(F.max("place").alias("place")).collect()[0]["place"]
    if found is not None:
        return found
    return copies.filter(F.col("slice") < end["slice"]).agg(F.max("place").alias("place")).collect()[0]["place"]


def mix(docs: DataFrame, weights=WEIGHTS, budget=BUDGET, repeat=REPEAT, mark: str | None = None) -> DataFrame:
    """doc_id, source, mark, size, source_size, target, taken, times and first_finish of every document.

    ``mark`` names a column that tells rows with equal doc_id apart.
    """
    sizes = docs.select(
        "doc_id",
        "source",
        count_words(F.col("text")).alias("size"),
        F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("shuffle"),
        (F.col(mark) if mark else F.lit(0).cast("long")).alias("mark"),
    )
    sizes = scratch(sizes, "mix-sizes")
    seen = sizes.agg(F.count("*").alias("rows"), F.coalesce(F.sum("size"), F.lit(0)).alias("total")).collect()[0]
    digits = _digits(seen["rows"])
    queued = _queued(sizes, source_targets(sizes, weights, budget, repeat), digits)
    cut = _cut(queued, seen["total"], budget, repeat, digits)
    times = F.lit(0)
    for copy in range(repeat):
        taken = (F.col("target") > 0) & (F.col("size") > 0)
        if cut is not None:
            end = F.struct(
                F.lit(cut["finish"]).alias("finish"),
                F.lit(cut["shuffle"]).alias("shuffle"),
                F.lit(cut["copy"]).alias("copy"),
                F.lit(cut["doc_id"]).cast(sizes.schema["doc_id"].dataType).alias("doc_id"),
                F.lit(cut["size"]).cast("long").alias("size"),
            )
            taken = taken & (_place(F.lit(copy)) <= end)
        times = times + taken.cast("int")
    return (
        queued.withColumn("times", times)
        .withColumn("first_finish", _finish(F.lit(0)))
        .withColumn("taken", (F.col("size") * F.col("times")).cast("long"))
        .select("doc_id", "source", "mark", "size", "source_size", "target", "taken", "times", "first_finish")
    )


def mixed_documents(docs: DataFrame, weights=WEIGHTS, budget=BUDGET, repeat=REPEAT) -> DataFrame:
    """The mixed corpus: one row per copy taken, range-sorted by finish time, with ``copy`` and ``finish``.

    Rows are told apart by doc_id, source and a hash of the whole row.  Of equal
    rows one carries the text, and each has its own copies in the plan.
    """
    hashed = [c for c, t in docs.dtypes if "map<" not in t]
    mark = F.xxhash64(*[F.col(f"`{c}`") for c in hashed], *[F.col(f"`{c}`").isNull() for c in hashed])
    rows = docs.select(packed(docs).alias("row"), "doc_id", "source", "text", mark.alias("mark"))
    counted = scratch(mix(rows, weights, budget, repeat, "mark").filter("times > 0"), "mix-plan")
    plan = (
        counted.select(
            F.col("doc_id").alias("p_doc"),
            F.col("source").alias("p_source"),
            F.col("mark").alias("p_mark"),
            F.explode(F.sequence(F.lit(0), F.col("times") - 1)).alias("copy"),
            "first_finish",
            (F.col("source_size") / F.col("target")).alias("lap"),
        )
        .withColumn("finish", F.col("first_finish") + F.col("copy") * F.col("lap"))
        .drop("first_finish", "lap")
    )
    rows = rows.drop("text")
    if not counted.groupBy("doc_id", "source", "mark").count().filter("count > 1").isEmpty():
        rows = rows.groupBy("doc_id", "source", "mark").agg(F.first("row").alias("row"))
    same = F.col("doc_id").eqNullSafe(F.col("p_doc")) & F.col("source").eqNullSafe(F.col("p_source")) & (F.col("mark") == F.col("p_mark"))
    kept = [f"row.`{c}`" for c in docs.columns if c not in ("copy", "finish")]
    return (
        rows.join(plan, same)
        .repartitionByRange(F.col("finish"), F.col("doc_id"))
        .sortWithinPartitions("finish", "doc_id", "copy")
        .select(*kept, "copy", "finish")
    )


def op10_mix(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS shuffle,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents),
s AS (
  SELECT source, sum(size) AS source_size,
         CAST([5, 2, 1][(row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1] AS BIGINT) AS weight
  FROM d GROUP BY source),
r AS (SELECT *, 2 * source_size AS cap, (2 * source_size) / weight::DOUBLE AS ratio FROM s),
l AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE
             - coalesce(sum(cap) OVER (ORDER BY ratio, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY ratio, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS level
  FROM r),
t AS (
  SELECT source, CAST(source_size AS BIGINT) AS source_size,
         CASE WHEN weight * level >= cap THEN CAST(cap AS DOUBLE)
              ELSE weight * (SELECT arg_min(level, ratio) FROM l WHERE weight * level < cap) END AS target
  FROM l),
q AS (
  SELECT d.*, t.source_size, t.target,
         sum(size) OVER (PARTITION BY d.source ORDER BY shuffle, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (
  SELECT doc_id, shuffle, size, copy, (upto + copy * source_size)::DOUBLE / target AS finish
  FROM q, (SELECT unnest([0, 1]) AS copy) WHERE target > 0 AND size > 0),
o AS (SELECT *, sum(size) OVER (ORDER BY finish, shuffle, copy, doc_id, size ROWS UNBOUNDED PRECEDING) AS running FROM c),
n AS (
  SELECT doc_id, count(*) AS times FROM o WHERE running <= 1.5::DOUBLE * (SELECT sum(size) FROM d) GROUP BY doc_id)
SELECT q.doc_id, q.size, q.source_size, q.target, CAST(q.size * coalesce(n.times, 0) AS BIGINT) AS taken
FROM q LEFT JOIN n ON q.doc_id = n.doc_id
"""
