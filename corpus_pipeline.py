"""The corpus pipeline: quality, near-duplicates, benchmark leaks, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and works on all rows the one before it kept; all
but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tierspark.llm import decontaminate, histogram_shard, pfair_mix, quality_qda, simhash_dedup
from tierspark.llm.common import documents
from tierspark.session import release, scratch_path, scratch_scope


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality_qda.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one with the smallest id."""
    return simhash_dedup.keep_one_of_each_group(docs, shingle=3, max_bits=2)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go."""
    return decontaminate.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the mixed sources."""
    return pfair_mix.mix(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their size and shard; the shards are consecutive stretches of
    the mixed order, and keep it."""
    return histogram_shard.assign_shards(docs, shards=16, keep_order=True)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates),
          ("benchmark_leaks", benchmark_leaks), ("mixing", mixing), ("sharding", sharding)]

#: SQL expresses neither the classifier nor the alignment; see tests/llm for brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another, each written to the shared folder and read again.
    A stage's own tables, and what it read, are deleted once it is written."""
    docs, written = documents(spark, sf_dir), None
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"pipeline-{name}")
        with scratch_scope(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        release(written)
        docs = written = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
