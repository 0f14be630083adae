"""Shared pieces of the corpus operators: scratch tables, words, let-bindings."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
#: Separators between words of ASCII letters, digits and any non-ASCII character.
NON_ALNUM = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


#: A table of at most this many keys is broadcast; a larger one is joined by a shuffle.
BROADCAST_KEYS = 500_000
#: Bytes of an Arrow batch that a task hands to Python; a longer row is a batch of its own.
BATCH_BYTES = 8 << 20
_OWN: dict[str, str] = {}
_MADE: list[list[DataFrame]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Where neither that setting nor a checkpoint folder is there, one is made in
    local mode (tests in one process); on a cluster that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        found = _OWN.get(app) or _OWN.setdefault(app, f"file://{tempfile.mkdtemp(prefix='quantloom-')}")
    return found


def _folder(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder


@contextmanager
def bounded_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of jobs that run within are bounded by ``BATCH_BYTES`` besides the session's rows.

    Texts, token sets and unions differ in length by orders of magnitude, so a
    bound of rows alone says nothing about a worker's memory.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def scratch(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once as a table in the shared folder and read it back.

    This cuts the lineage with a copy that survives lost executors, and later
    readers see only the columns they need.  What is left of the application's
    tables goes when the driver ends.
    """
    spark = df.sparkSession
    home = f"{shared_dir(spark)}/quantloom-{spark.sparkContext.applicationId}"
    files, folder = _folder(spark, home)
    files.deleteOnExit(folder)
    path = f"{home}/{tag}-{uuid.uuid4().hex}"
    with bounded_batches(spark):
        df.write.option("compression", "zstd").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    if _MADE:
        _MADE[-1].append(table)
    return table


def drop_scratch(*tables: DataFrame) -> None:
    """Delete scratch tables that no later step reads."""
    for table in tables:
        for file in table.inputFiles()[:1]:
            files, path = _folder(table.sparkSession, file)
            files.delete(path.getParent(), True)


def settled(make: Callable[[], DataFrame], tag: str) -> DataFrame:
    """The result of ``make`` as a scratch table; the scratch tables made on the way are deleted."""
    _MADE.append([])
    try:
        made = _MADE[-1]
        out = scratch(make(), tag)
    finally:
        _MADE.pop()
    drop_scratch(*made[:-1])
    if _MADE:
        _MADE[-1].append(out)
    return out


def small(keys: DataFrame, most: int = BROADCAST_KEYS) -> DataFrame:
    """``keys``, a written table, marked for broadcast if it has at most ``most`` rows."""
    return F.broadcast(keys) if keys.count() <= most else keys


def packed(docs: DataFrame) -> Column:
    """The whole row as one struct column, so that no name of the input can clash with a helper's."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns])


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of finished steps.

    Spark deletes them when the driver's collector finds that nothing refers to
    them any more, which on an idle driver heap may be long after the step.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value``, which is evaluated once per row however often it is used."""
    return F.transform(F.array(value), body)[0]


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z and nothing else; the plain lower-casing serves texts of ASCII only."""
    plain = F.length(text) == F.octet_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, _UPPER, _UPPER.lower()))


def words(text: Column, separator: str = SPACE) -> Column:
    """Words between separators, never empty ones; null text has none."""
    parts = F.split(F.coalesce(text, F.lit("")), separator)
    return F.filter(parts, lambda w: w != "")


def count_words(text: Column, separator: str = SPACE) -> Column:
    """``size(words(...))`` without building the filtered array."""
    text = F.coalesce(text, F.lit(""))
    return let(
        F.split(text, separator),
        lambda p: F.size(p)
        - F.when(F.element_at(p, 1) == "", 1).otherwise(0)
        - F.when((F.size(p) > 1) & (F.element_at(p, -1) == ""), 1).otherwise(0),
    ).cast("long")


_CHUNK = 256
PLACES = "array<struct<start:int,end:int,value:string>>"


def placed_matches(text: Column, pattern: Column, group: int = 0) -> Column:
    """All leftmost matches of ``pattern`` as structs (start, end, value of the group), in code points.

    Starts are running sums of the lengths of the pieces between matches.  They
    are built in chunks, so that a text with very many matches costs no more
    than chunk times matches.
    """
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    value = F.regexp_extract_all(text, pattern, F.lit(group))

    def place(steps):
        chunks = F.transform(
            F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / _CHUNK).cast("int")),
            lambda c: F.slice(steps, c * _CHUNK + 1, F.lit(_CHUNK)),
        )

        def one(a, s):
            start = a["at"] + s["gap"]
            found = F.struct(start.alias("start"), (start + s["long"]).alias("end"), s["value"].alias("value"))
            return F.struct((start + s["long"]).alias("at"), F.array_append(a["out"], found).alias("out"))

        def chunk(a, steps_of):
            inner = F.aggregate(steps_of, F.struct(a["at"].alias("at"), F.array().cast(PLACES).alias("out")), one)
            return let(inner, lambda r: F.struct(r["at"].alias("at"), F.array_append(a["out"], r["out"]).alias("out")))

        start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{PLACES}>").alias("out"))
        return F.flatten(F.aggregate(chunks, start, chunk, lambda a: a["out"]))

    steps = F.filter(
        F.zip_with(
            F.zip_with(F.call_function("split", text, pattern), whole, lambda g, m: F.struct(g.alias("gap"), m.alias("hit"))),
            value,
            lambda s, v: F.struct(F.length(s["gap"]).alias("gap"), F.length(s["hit"]).alias("long"), v.alias("value")),
        ),
        lambda s: s["long"].isNotNull(),
    )
    return let(steps, lambda s: F.when(F.size(s) > 0, place(s)).otherwise(F.array().cast(PLACES)))


def bucket_of(key: Column, modulus: int) -> Column:
    """crc32 of the key as text, modulo ``modulus``; a null key is in no bucket."""
    return F.pmod(F.crc32(key.cast("string")), F.lit(modulus))
