"""Tables that several steps read, written once to the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
_ONCE: dict[tuple[str, ...], tuple[str, DataFrame]] = {}


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset a folder is made in local mode, and on a cluster it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        found = _OWN.get(app) or _OWN.setdefault(app, f"file://{tempfile.mkdtemp(prefix='quantloom-')}")
    return found


def _files(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder


def _written(df: DataFrame) -> tuple[str, DataFrame]:
    spark = df.sparkSession
    home = f"{shared_folder(spark)}/panels-{spark.sparkContext.applicationId}"
    files, folder = _files(spark, home)
    files.deleteOnExit(folder)
    path = f"{home}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path, spark.read.schema(df.schema).parquet(path)


def kept(df: DataFrame) -> DataFrame:
    """``df`` as a table of its own, cut from its plan; the application's tables go when the driver ends."""
    return _written(df)[1]


def _stamp(spark: SparkSession, path: str) -> str:
    """What is in a folder and when it changed: names, sizes and times of its entries."""
    files, folder = _files(spark, path)
    return ";".join(sorted(f"{s.getPath().getName()} {s.getLen()} {s.getModificationTime()}" for s in files.listStatus(folder)))


def once(spark: SparkSession, sf_dir: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table ``name`` derived from ``sf_dir``, made at its first use in the application and read from then on.

    It is made anew once an entry of ``sf_dir`` has changed.
    """
    key = (spark.sparkContext.applicationId, sf_dir, name, _stamp(spark, sf_dir))
    if key in _ONCE:
        files, folder = _files(spark, _ONCE[key][0])
        if files.exists(folder):
            return _ONCE[key][1]
    _ONCE[key] = _written(make())
    return _ONCE[key][1]
