"""Embedding of chunks that can be stopped and gone on with: texts are known by their digest, vectors by digest and model.

A store is a folder with two tables that are only appended to (vectors; failed, the dead letters) and a log of runs. New texts, each once however
many chunks have it, are dealt out into units; a unit is embedded and then committed in one write. What a run finds in the store
it leaves out, so a run after a crash embeds what no committed unit holds, and a changed text or another model embeds anew.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.providers import Policy, asked
from ..operators.spotting import kept
from ..sources.files import CHUNK

VECTORS = "digest STRING, model STRING, vec ARRAY<FLOAT>"
FAILED = "digest STRING, model STRING, status STRING, attempts INT, run STRING"
RUNS = "run STRING, model STRING, unit INT, units INT, embedded LONG, failed LONG, reused LONG, total LONG, done BOOLEAN, updated_at DOUBLE"
UNIT_ROWS = 200_000  # texts embedded between two commits, about
SLICES = 16  # of a unit, each written by one task


def digest(text: str = "text"):
    return F.sha2(F.coalesce(F.col(text), F.lit("")), 256)


def _table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], schema)
        raise


def _log(spark: SparkSession, store: str, run: str, model: str, **values) -> None:
    row = {"run": run, "model": model, "unit": -1, "units": 0, "embedded": 0, "failed": 0, "reused": 0, "total": 0, "done": False, "updated_at": time.time()} | values
    names = [x.split()[0] for x in RUNS.split(", ")]
    spark.createDataFrame([tuple(row[n] for n in names)], RUNS).coalesce(1).write.mode("append").json(f"{store}/runs")


def state(spark: SparkSession, store: str, model: str) -> dict | None:
    """The last run for a model: run, units, committed units, embedded, failed, reused and total texts, done; None before the first."""
    try:
        rows = spark.read.schema(RUNS).json(f"{store}/runs").filter(F.col("model") == model)
        last = rows.groupBy("run").agg(F.max("updated_at").alias("updated_at"), F.max("units").alias("units"), F.count_if(F.col("unit") >= 0).alias("committed"), F.sum("embedded").alias("embedded"), F.sum("failed").alias("failed"), F.max("reused").alias("reused"), F.max("total").alias("total"), F.max("done").alias("done"))
        first = last.orderBy(F.desc("updated_at")).limit(1).collect()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise
    return first[0].asDict() if first else None


def embed_new(chunks: DataFrame, store: str, call: Callable[[list[dict]], list], model: str, dims: int, policy: Policy = Policy(), unit_rows: int = UNIT_ROWS) -> dict:
    """Embeds the texts of chunks (text) that the store has no vector of for this model, and returns state().

    call gets rows {digest, text} and gives vectors of `dims` numbers. What it can't embed stands in failed with its status, and is asked again by the
    next run. Null texts count as empty ones.
    """
    spark, run = chunks.sparkSession, uuid.uuid4().hex
    wanted = chunks.select(digest().alias("digest"), F.coalesce("text", F.lit("")).alias("text")).groupBy("digest").agg(F.any_value("text").alias("text"))
    known = _table(spark, f"{store}/vectors", VECTORS).filter(F.col("model") == model).select("digest").distinct()
    todo = kept(wanted.join(known, "digest", "left_anti"))
    total, left = chunks.select(digest().alias("digest")).distinct().count(), todo.count()
    units = -(-left // unit_rows)
    _log(spark, store, run, model, units=units, reused=total - left, total=total, done=not units)
    if units > 1:  # each unit reads its own files
        path = f"{store}/todo/{run}"
        cut = F.pmod(F.crc32(F.reverse("digest")), F.lit(SLICES)).alias("cut")  # a task writes a slice of a unit, not all of it
        todo.withColumn("unit", F.pmod(F.crc32("digest"), F.lit(units)).cast("int")).repartition(units * SLICES, "unit", cut).write.partitionBy("unit").parquet(path)
    fits = lambda v: None if len(v) == dims else "bad_dims"
    tasks = max(1, min(2 * spark.sparkContext.defaultParallelism, -(-left // (policy.batch * max(1, units)))))
    numbers = lambda rows: [None if v is None else [float(x) for x in v] for v in call(rows)]
    for unit in range(units):
        part = _table(spark, f"{path}/unit={unit}", "digest STRING, text STRING") if units > 1 else todo
        done = asked(part.repartition(tasks), numbers, "array<float>", policy, fits)
        done.filter("status is null").select("digest", F.lit(model).alias("model"), F.col("reply").alias("vec")).write.mode("append").parquet(f"{store}/vectors")
        failed = done.filter("status is not null").select("digest", F.lit(model).alias("model"), "status", "attempts", F.lit(run).alias("run"))
        n = done.agg(F.count_if(F.col("status").isNull()), F.count_if(F.col("status").isNotNull())).first()
        if n[1]:
            failed.write.mode("append").parquet(f"{store}/failed")
        _log(spark, store, run, model, unit=unit, units=units, embedded=n[0], failed=n[1], reused=total - left, total=total, done=unit == units - 1)
    return state(spark, store, model)


def vectors_of(chunks: DataFrame, store: str, model: str) -> DataFrame:
    """(chunk_id, vec) of chunks (chunk_id, text) whose text the store has a vector of; a digest that was committed twice counts once."""
    known = _table(chunks.sparkSession, f"{store}/vectors", VECTORS).filter(F.col("model") == model)
    once = known.groupBy("digest").agg(F.any_value("vec").alias("vec"))
    return chunks.select("chunk_id", digest().alias("digest")).join(once, "digest").select("chunk_id", "vec")


def failed_of(spark: SparkSession, store: str, model: str) -> DataFrame:
    """(digest, status, attempts) of texts that have no vector of a model yet, as their last run left them."""
    rows = _table(spark, f"{store}/failed", FAILED).filter(F.col("model") == model)
    known = _table(spark, f"{store}/vectors", VECTORS).filter(F.col("model") == model).select("digest")
    last = rows.groupBy("digest").agg(F.max_by("status", "attempts").alias("status"), F.max("attempts").alias("attempts"))
    return last.join(known, "digest", "left_anti")


def embed_stream(spark: SparkSession, source: str, store: str, checkpoint: str, call: Callable[[list[dict]], list], model: str, dims: int, policy: Policy = Policy()) -> StreamingQuery:
    """Embeds what arrives as JSON chunks under source into a store; a batch that is run again finds its texts there."""

    def one(batch: DataFrame, _: int) -> None:
        embed_new(batch, store, call, model, dims, policy)

    return spark.readStream.schema(CHUNK).json(source).writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
