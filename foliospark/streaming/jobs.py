"""Append-only audit log and incremental ingest, resumable by checkpoints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.chunking import batches_without, embed
from ..sources.files import AUDIT, CHUNK


def audit_log(spark: SparkSession, source: str, sink: str, checkpoint: str) -> StreamingQuery:
    """Appends audit records that arrive as JSON files under source to Parquet under sink, each once."""
    records = spark.readStream.schema(AUDIT).json(source)
    return records.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(sink)


def audit_once(spark: SparkSession, source: str, sink: str, checkpoint: str, late: str = "1 day") -> StreamingQuery:
    """As audit_log(), but a record that arrives again, in another file, within `late` of the newest time seen adds nothing.

    Records are the same if all their fields are. One without a time has that of its file. State is kept for as long as `late`.
    """
    fields = [f.split()[0] for f in AUDIT.split(", ")]
    records = spark.readStream.schema(AUDIT).json(source).withColumn("record", F.sha2(F.to_json(F.struct(*fields), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}), 256))
    timed = records.withColumn("ts", F.coalesce("ts", "_metadata.file_modification_time")).withWatermark("ts", late)
    once = timed.dropDuplicatesWithinWatermark(["record"]).drop("record")
    return once.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(sink)


def audit_rollup(spark: SparkSession, sink: str) -> DataFrame:
    """(day, mode, n, users) of the audit records under sink."""
    rows = spark.read.schema(AUDIT).parquet(sink)
    return rows.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "mode").agg(F.count("*").alias("n"), F.count_distinct("username").alias("users"))


def embed_new_chunks(spark: SparkSession, source: str, vectors: str, checkpoint: str, provider, dims: int) -> StreamingQuery:
    """Embeds chunks that arrive as JSON files under source and appends them to Parquet under vectors.

    A chunk that has a vector already is left out, so a batch that is run again after a loss adds nothing twice.
    """

    def one(batch: DataFrame, _: int) -> None:
        known = spark.createDataFrame([], "chunk_id STRING, vec ARRAY<FLOAT>")
        try:
            known = spark.read.parquet(vectors)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
        embed(batches_without(batch.dropDuplicates(["chunk_id"]), known), provider, dims).write.mode("append").parquet(vectors)

    return spark.readStream.schema(CHUNK).json(source).writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
