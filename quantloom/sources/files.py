"""Reading and writing of panels: Parquet, CSV, wide vendor layouts, checked writes."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

OHLCV = T.StructType(
    [T.StructField("date", T.DateType()), T.StructField("ticker", T.StringType())]
    + [T.StructField(c, T.DoubleType()) for c in ("open", "high", "low", "close", "adj_close", "volume")]
)


def read_parquet(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).parquet(path)


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.option("header", True).schema(schema).csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def vendor_symbol(symbol: Column) -> Column:
    """Dots as dashes."""
    return F.translate(F.trim(symbol), ".", "-")


def normalise_universe(raw: DataFrame, symbol="symbol", name="name", sector="sector") -> DataFrame:
    """ticker, vendor_ticker, name, sector in ticker order, from a table with any capitalisation of its headers."""
    found = {c.lower().strip(): c for c in raw.columns}
    missing = [c for c in (symbol, name, sector) if c not in found]
    if missing:
        raise ValueError(f"universe lacks columns {missing}")
    picked = [F.trim(F.col(f"`{found[c]}`")) for c in (symbol, name, sector)]
    return raw.select(
        picked[0].alias("ticker"), vendor_symbol(picked[0]).alias("vendor_ticker"), picked[1].alias("name"), picked[2].alias("sector")
    ).orderBy("ticker")


UNIVERSES = {"default": normalise_universe}


def get_universe(name: str, raw: DataFrame) -> DataFrame:
    if name not in UNIVERSES:
        raise ValueError(f"unknown universe {name!r}; known: {sorted(UNIVERSES)}")
    return UNIVERSES[name](raw)


def tidy_wide(wide: DataFrame, tickers: Sequence[str], fields: Sequence[str], separator: str = "|") -> DataFrame:
    """Columns named field|ticker as one row per date and ticker; rows without adj_close go."""
    packed = F.explode(
        F.array(
            *[
                F.struct(F.lit(t).alias("ticker"), *[F.col(f"`{f}{separator}{t}`").cast("double").alias(f) for f in fields])
                for t in tickers
            ]
        )
    )
    out = wide.select("date", packed.alias("r")).select("date", "r.*")
    return out.dropna(subset=["adj_close"]) if "adj_close" in fields else out


def file_stem(name: str) -> str:
    return name.lower().replace(" ", "_").replace("-", "_")


def row_checksum(df: DataFrame) -> Column:
    """An aggregate over all cells that does not depend on the order of rows; nulls count by their place."""
    cells = [F.to_json(F.struct(f"`{f.name}`")) if isinstance(f.dataType, (T.MapType, T.VariantType)) else F.col(f"`{f.name}`") for f in df.schema.fields]
    places = F.array(*[c.isNull() for c in cells])
    return F.coalesce(F.sum(F.xxhash64(*cells, places).cast("decimal(20,0)")), F.lit(0).cast("decimal(30,0)")).cast("string")


def write_checked(df: DataFrame, path: str, keys: Sequence[str]) -> DataFrame:
    """Write beside the target, read back, compare, then move into place; returns a one-row manifest.

    What was given is counted and summed up by the write itself, what was written
    by one scan.  A move that fails puts the old data back.  Between the two moves
    there is nothing at ``path``; readers that must not notice a change use
    ``group_commit``.
    """
    spark = df.sparkSession
    aside, seen = f"{path}.{uuid.uuid4().hex}", Observation()
    total = lambda d: [F.count(F.lit(1)).alias("rows"), row_checksum(d).alias("checksum")]
    df.observe(seen, *total(df)).sortWithinPartitions(*keys).write.parquet(aside)
    back = spark.read.schema(df.schema).parquet(aside)
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    target, new, old = fs_path(path), fs_path(aside), fs_path(f"{path}.{uuid.uuid4().hex}.old")
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if back.agg(*total(back)).first().asDict() != seen.get:
        fs.delete(new, True)
        raise ValueError(f"{path}: what was written differs from what was given")
    had = fs.exists(target)
    if had and not fs.rename(target, old):
        raise OSError(f"{path}: the old data could not be moved away; the new are in {aside}")
    if not fs.rename(new, target):
        if had:
            fs.rename(old, target)
        raise OSError(f"{path}: the new data could not be moved into place; they are in {aside}")
    if had:
        fs.delete(old, True)
    return spark.read.schema(df.schema).parquet(path).agg(F.lit(path).alias("path"), F.count("*").alias("rows"))
