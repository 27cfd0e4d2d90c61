"""Places of rows in a whole order, and digests that follow from it, without a task that holds a book."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .spotting import kept, small

LAST = 10**9  # the place of what doesn't say where it stands
FAN = 1024  # digests that are folded into one


def numbered(rows: DataFrame, by: list[Column], within: tuple[str, ...] = (), name: str = "no") -> DataFrame:
    """rows with a number from 1 without gaps, in the order `by`, for each value of the columns `within`.

    Rows are dealt out by ranges of (within, by) and sorted there; a range goes on where the ones before it ended. What is gathered is a row a
    range and value. Rows that are equal in all of it come in any order, so `by` should end with an id.
    """
    keys = [F.col(c) for c in within] + list(by)
    put = kept(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id()))
    counts = put.groupBy("__part", *within).agg(F.count("*").alias("__n"), F.min("__at").alias("__first"))
    before = F.sum("__n").over(Window.partitionBy(*within).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    starts = kept(counts.select("__part", *within, "__first", F.coalesce(before, F.lit(0)).alias("__start")))
    starts = small(starts.withColumnsRenamed({"__part": "__of", **{c: f"__of_{c}" for c in within}}))
    on = F.col("__part") == F.col("__of")
    for c in within:
        on = on & F.col(c).eqNullSafe(F.col(f"__of_{c}"))
    found = put.join(starts, on, "left")
    return found.withColumn(name, F.col("__at") - F.col("__first") + F.col("__start") + 1).select(*rows.columns, name)


def position(chunk_id: Column, page_start: Column) -> list[Column]:
    """(page, place) that an id such as p12_c3 states, else its page_start and a place after all others; what says nothing comes last."""
    text = chunk_id.cast("string")
    said = lambda k: F.nullif(F.regexp_extract(text, r"^p([0-9]{1,7})_c([0-9]{1,5})$", k), F.lit("")).cast("long")
    return [F.coalesce(said(1), F.when(page_start > 0, page_start.cast("long")), F.lit(LAST)), F.coalesce(said(2), F.lit(LAST))]


def in_document_order(chunks: DataFrame) -> DataFrame:
    """chunks (chunk_id, page_start, ..., and book if there are several) with book and doc_ord, their place in the book by their ids."""
    rows = chunks if "book" in chunks.columns else chunks.withColumn("book", F.lit(""))
    return numbered(rows, [*position(F.col("chunk_id"), F.col("page_start")), F.col("chunk_id").cast("string")], ("book",), "doc_ord")


def digest_tree(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row (n, levels, digest): hashes of rows, in the order of their ids, are folded FAN to one until one is left.

    Ids may be of any type that sorts. The digest changes if and only if a row does, is added or goes. No rows have the hash of nothing.
    """
    own = F.sha2(F.concat_ws("\t", F.col(id_col).cast("string"), F.coalesce(F.col(text_col), F.lit(""))), 256)
    level = numbered(rows.select(F.col(id_col).alias("__id"), own.alias("h")), [F.col("__id"), F.col("h")]).select(F.col("no"), "h")
    n, levels = level.count(), 0
    left = n
    while left > 1 or not levels:
        block = F.floor((F.col("no") - 1) / FAN)
        fold = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("no", "h"))), lambda x: x["h"]), "\n")  # FAN at most
        level = kept(level.groupBy((block + 1).alias("no")).agg(F.sha2(fold, 256).alias("h")))
        left, levels = level.count(), levels + 1
    spark = rows.sparkSession
    found = level.select(F.lit(n).cast("long").alias("n"), F.lit(levels).alias("levels"), F.col("h").alias("digest"))
    return found if n else spark.range(1).select(F.lit(0).cast("long").alias("n"), F.lit(0).alias("levels"), F.sha2(F.lit(""), 256).alias("digest"))
