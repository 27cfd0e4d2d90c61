"""From raw documents to sharded training data: five stages, each over all that the one before kept.

Every stage takes an empty table to an empty one, and leaves columns that it doesn't know as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from foliospark.llm import decontaminate, mixing, quality_gam, sharding, simhash


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality classifier rejects.

    Null and empty texts are scored as texts without words; repeated rows go or stay together; null ids are scored like others.
    """
    return quality_gam.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates, that of smallest doc_id.

    Null and wordless texts are one group; of repeated rows one stays; null ids come last.
    """
    return simhash.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold benchmark passages. Null and wordless texts hold none; repeated rows go or stay together."""
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents so that sources come near their targets.

    A null source is one of its own; texts without words are left out; repeated rows are taken equally often.
    """
    return mixing.repeat(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds the shard of every row. Equal texts share one; null texts count as empty ones."""
    return sharding.place(docs)


STAGES = [("quality", quality), ("dedup", dedup), ("decontaminate", decontaminated), ("mix", mixed), ("shard", sharded)]

#: The classifier is fitted, SimHash links are transitive and mixing draws by hashes: not for SQL. A test runs all stages
#: beside plain Python on the smallest tables.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
