"""The corpus pipeline: each stage applies one operator to all that the stage before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from callspark.llm.decontaminate import decontaminated
from callspark.llm.mixing import mixed
from callspark.llm.ngram_join import one_per_group
from callspark.llm.shared import settle, unsettle
from callspark.llm.sharding import sharded
from callspark.llm.toxicity import without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine doesn't reject.

    Null and empty texts score the model's bias; rows that repeat are judged each; an empty table stays empty.
    """
    return without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at 0.8.

    Rows are told apart by doc_id and text, null ids come last; rows without words all stay; an empty table stays empty.
    """
    return one_per_group(docs, 5, 80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth is verbatim from the benchmark.

    Null and empty texts stay, and so do other texts of a contaminated doc_id; an empty benchmark rejects nothing.
    """
    return decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them.

    Rows without words go; null is a source of its own; rows that repeat come as often each; an empty table stays empty.
    """
    return mixed(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their output shard.

    Rows of one doc_id share it, and so do those without; an empty table stays empty.
    """
    return sharded(docs)


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mix),
    ("sharding", shard),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is a table that the next one reads."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, settle(stage(spark, docs, sf_dir), name)
        unsettle(before)
    return STAGES[-1][1](spark, docs, sf_dir)


#: SQL can't express the learned scores of the first stage.
ORACLE_SQL = None
QUERIES = {"pipeline": run}
SQL: dict[str, str] = {}
