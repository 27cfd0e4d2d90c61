"""Sharding by longest-processing-time scheduling of groups that must stay together.

Groups are rows of equal text. The largest go, one after the other, to the shard with the least bytes so far, taken from
a heap. The driver sees groups by size alone: a run of equal sizes and how many there are (the sum of different sizes is at most all bytes T, so
there are at most sqrt(2 T) runs), and hands few groups out by the heap, many in whole rounds, which gives the same loads.
Which shard the k-th group of a run has follows from the loads before the run in closed form, so every group finds its own,
knowing its place in the order of all, and rows find their group by hash.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordering import numbered
from .common import cut, small

SHARDS = 16
ONE_BY_ONE = 256  # groups of equal size up to which the heap hands out each
GROUP_ROWS = 1_000_000  # groups up to which their shards are broadcast: narrow rows, some 100 MB; more are joined by a shuffle
SLOT_ROWS, MOST_CHUNKS = 200, 100_000  # rows numbered together, at most so many chunks


def schedule(items: list[tuple[int, str]], shards: int) -> dict[str, int]:
    """Shard of each (size, name): largest first (ties by name), each to the shard with the least so far."""
    heap = [(0, s) for s in range(shards)]
    out = {}
    for size, name in sorted(items, key=lambda x: (-x[0], x[1])):
        load, s = heapq.heappop(heap)
        out[name] = s
        heapq.heappush(heap, (load + size, s))
    return out


def shards_of(loads: np.ndarray, size: np.ndarray, nth: np.ndarray) -> np.ndarray:
    """The shard that the nth (from 0) of many groups of equal size goes to, for loads (rows, shards) before the first of them.

    Shard j takes a group whenever its load, L_j + k * size after k groups, is the least (ties: the lower shard). With L_j = a_j * size + b_j
    these moments are ordered by (a_j + k, b_j, j): level m has those shards with a_j <= m, and before it there were sum(max(0, m - a_j))
    groups, which is the largest of j * m - (sum of the j least a).
    """
    n, k = loads.shape[1], np.arange(1, loads.shape[1] + 1)
    a, b = loads // size[:, None], loads % size[:, None]
    least = np.cumsum(np.sort(a, 1), 1)
    level = ((nth[:, None] + least) // k).min(1)
    before = np.maximum(0, (k * level[:, None] - least).max(1))
    order = np.lexsort((np.broadcast_to(np.arange(n), a.shape), b, a > level[:, None]), axis=1)
    return np.take_along_axis(order, (nth - before)[:, None], 1)[:, 0]


def runs(histogram: list[tuple[int, int]], shards: int) -> list[tuple[int, int, list[int]]]:
    """(size, groups before, loads before) of each run of a histogram (size, groups), largest sizes first."""
    heap, out, before = [(0, s) for s in range(shards)], [], 0
    for size, n in sorted(histogram, reverse=True):
        loads = [0] * shards
        for load, s in heap:
            loads[s] = load
        out.append((size, before, loads))
        before += n
        if n <= ONE_BY_ONE:
            for _ in range(n):
                load, s = heap[0]
                heapq.heapreplace(heap, (load + size, s))
            continue
        # whole rounds at once: all up to the level that n groups reach, and the shards that take one more
        a, now = np.array(loads, object) // size, np.array(loads, object)
        least = np.cumsum(np.sort(a))
        level = min((n + int(c)) // k for k, c in enumerate(least, 1))
        given = np.maximum(0, level - a)
        more = sorted((s for s in range(shards) if a[s] <= level), key=lambda s: (now[s] % size, s))[: n - int(given.sum())]
        for s in more:
            given[s] += 1
        heap = [(int(load + size * g), s) for s, (load, g) in enumerate(zip(now, given))]
        heapq.heapify(heap)
    return out


def _narrow(text: str = "text") -> list[Column]:
    t = F.coalesce(F.col(text), F.lit(""))
    return [(F.octet_length(t) + 1).cast("long").alias("size"), F.crc32(t).alias("text_crc32"), F.xxhash64(t).alias("hash")]


def _groups(rows: DataFrame, shards: int) -> DataFrame:
    """(hash, text_crc32, size, shard) of every group of rows (size, text_crc32, hash)."""
    spark = rows.sparkSession
    groups = cut(rows.groupBy("hash", "text_crc32", "size").agg((F.count("*") * F.col("size")).alias("bytes")))
    histogram = [(r[0], r[1]) for r in groups.groupBy("bytes").agg(F.count("*")).collect()]  # different sizes: see above
    known = runs(histogram, shards)
    table = pa.table({"bytes": pa.array([r[0] for r in known], pa.int64()), "before": pa.array([r[1] for r in known], pa.int64()), "loads": pa.array([r[2] for r in known], pa.list_(pa.int64()))})
    placed = numbered(groups, [F.desc("bytes"), F.col("hash"), F.col("text_crc32"), F.col("size")])
    placed = placed.join(small(cut(spark.createDataFrame(table))), "bytes").select("hash", "text_crc32", "size", "bytes", (F.col("no") - 1 - F.col("before")).alias("nth"), "loads")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                loads = b.column("loads").flatten().to_numpy().reshape(b.num_rows, -1)
                found = shards_of(loads, b.column("bytes").to_numpy(), b.column("nth").to_numpy())
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("hash", "text_crc32", "size")), pa.array(found, pa.int32())], ["hash", "text_crc32", "size", "shard"])

    return cut(placed.mapInArrow(find, "hash long, text_crc32 long, size long, shard int"))


def _with_shard(rows: DataFrame, groups: DataFrame) -> DataFrame:
    return rows.join(small(groups, GROUP_ROWS), ["hash", "text_crc32", "size"])


def assign(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Per row of docs: doc_id, size, text_crc32, law ('bytes'), shard, slot (0, 1, ... within the shard), grown_shard (null).

    Null texts count as empty ones and group with them; repeated rows stay together and have slots of their own; ties of
    sizes go by hash. Long texts are known by size and hash alone. An empty table gives an empty result. Other columns are ignored.
    """
    rows = cut(docs.select("doc_id", *_narrow()))
    at = cut(_with_shard(rows, _groups(rows, shards)).select("doc_id", "size", "text_crc32", "hash", "shard"))
    return _slots(at, shards).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def place(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """docs with one more column, the shard of each row as assign() has it (in place of a column of that name).

    Groups are counted from sizes and hashes. Up to GROUP_ROWS of them rows stay where they are, beyond that they move to their group's
    shard by a join. Odd rows are treated as in assign().
    """
    wide = docs.drop("shard")
    groups = _groups(cut(wide.select(*_narrow())), shards)
    keyed = wide.select(F.struct(*wide.columns).alias("__row"), *_narrow())
    return _with_shard(keyed, groups).select("__row.*", "shard")


def _slots(at: DataFrame, shards: int) -> DataFrame:
    """at with slot: numbers without gaps in each shard, dealt out chunk by chunk; a shard has chunks in proportion to its rows.

    A row's chunk goes by the hash of its id and text. Rows equal in both that are more than a chunk's share are dealt out
    over as many chunks as they fill; it can't be told which of them has which slot. at must be a checkpoint.
    """
    held = {r[0]: r[1] for r in at.groupBy("shard").count().collect()}  # one row per shard
    each = max(SLOT_ROWS, sum(held.values()) // MOST_CHUNKS)
    chunks = F.get(F.array(*[F.lit(max(1, held.get(s, 0) // each)) for s in range(shards)]), F.col("shard"))
    hot = cut(at.groupBy("doc_id", "hash").agg(F.count("*").alias("n")).filter(F.col("n") > each).select(F.col("doc_id").alias("__id"), F.col("hash").alias("__hash"), "n"))
    at = at.withColumn("nth", F.monotonically_increasing_id())
    at = at.join(F.broadcast(hot), at["doc_id"].eqNullSafe(F.col("__id")) & (at["hash"] == F.col("__hash")), "left")  # fewer than rows / each
    part = F.when(F.col("n").isNotNull(), F.pmod(F.xxhash64("nth"), F.ceil(F.col("n") / each))).otherwise(F.lit(0))
    at = at.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "hash", part), chunks)).drop("__id", "__hash", "n")
    counts = cut(at.groupBy("shard", "chunk").agg(F.count("*").alias("n")))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("shard", "chunk", F.coalesce(before, F.lit(0)).alias("start"))
    order = F.row_number().over(Window.partitionBy("shard", "chunk").orderBy("doc_id", "hash", "nth"))
    return at.withColumn("place", order).join(F.broadcast(starts), ["shard", "chunk"]).withColumn("slot", F.col("start") + F.col("place") - 1)
