"""A corpus pipeline of five stages over ``documents``.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next stage's docs.  All but the last
return the columns of ``documents``; the last adds ``copy`` and ``finish``.

The quality classifier is fitted from labelled rows, which SQL cannot express,
so there is no ORACLE_SQL; ``tests/llm`` holds :func:`run` against a brute-force
version of all stages behind the classifier.

Defined results.  A null or empty text is scored as it is; if kept, it stays in
every stage and has no share in the mix (size 0, no copies).  Rows with a null
doc_id are documents like others.  Of equal texts the smallest doc_id stays, of
equal rows one; ties of the mix are settled by the shuffle, doc_id and size.
Other columns are carried along, whatever their names; only ``copy`` and
``finish`` are replaced by the last stage.  Empty tables give empty results.
Texts of any length are processed whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quantloom.llm import decontaminate, jaccard_groups, mixing, rule_ensemble, secret_scan
from quantloom.llm.common import drop_scratch, settled


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble scores below its cut go."""
    return rule_ensemble.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones stays, the one with the smallest id.

    Texts link from a Jaccard measure of 0.8 of their 5-word shingles on.
    """
    return jaccard_groups.keep_one_of_each(docs, size=5, percent=80)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of a benchmark item go."""
    return decontaminate.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the texts; every document stays."""
    return secret_scan.redact(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: one row per copy taken, in order of virtual finish time."""
    return mixing.mixed_documents(docs)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("benchmark_free", benchmark_free),
    ("without_secrets", without_secrets),
    ("mixed", mixed),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        kept = settled(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), f"pipeline-{name}")
        if docs is not source:
            drop_scratch(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
