"""What the operators share: words, shared checkpoints and broadcasts behind a checked size."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of anything but space, tab, \n, \v, \f and \r.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Rows up to which a side of narrow rows is broadcast; a larger one is joined by shuffling.
BROADCAST_ROWS = 200_000


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints: spark.checkpoint.dir. Where that is unset, one of its own on a single machine; on a
    cluster, whose executors wouldn't see that, an error."""
    sc = spark.sparkContext
    known = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not known:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        known = tempfile.mkdtemp(prefix="foliospark-checkpoint-")
        sc.setCheckpointDir(known)
    elif not sc.getCheckpointDir():
        sc.setCheckpointDir(known)
    return known


def cut(df: DataFrame) -> DataFrame:
    """df, written to the shared checkpoint folder once, so that what follows neither recomputes it nor depends on executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def words(text: Column) -> Column:
    """The words of a text as an array; null and blank texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP), "")


def ascii_lower(text: Column) -> Column:
    """text with A-Z in lower case and nothing else changed."""
    return F.translate(text, UPPER, LOWER)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has few enough rows; df must be cheap to count (a checkpoint)."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def share(spark: SparkSession, n_rows: int, rows_each: int, most: int) -> int:
    """Number of pieces for n_rows rows: about rows_each rows in each, at most so many pieces."""
    return max(1, min(most, -(-n_rows // rows_each)))


def crc_of_id(col: str = "doc_id") -> Column:
    """crc32 of an id written in decimal; null ids count as 0."""
    return F.coalesce(F.crc32(F.col(col).cast("string")), F.lit(0))
