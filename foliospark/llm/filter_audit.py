"""What filters take away in every order of application: removed, redundant and lost rows of each step.

Texts are judged once. All that orders can differ in is the set of filters that a row fails, so rows are counted by part and
by that set, a mask of five bits. A mask matrix (0 where a filter fails the row, infinite elsewhere) and a matrix of the
filters' positions in each order (the inverse permutations) are combined as a product in which min stands for the sum and
+ for the product: the least position among failing filters is the step that removes a row. The counts of each mask are
then scattered to these steps. No row is looked at a second time, whatever the number of orders.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import UPPER, cut, small

FILTERS = "ABCDE"
MIN_WORDS, DISTINCT_PERCENT, UPPER_PERCENT, MARKS = 100, 80, 10, "#$%&*|"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
NEVER = len(FILTERS)  # the step of rows that fail nothing
BLOCK = 1 << 20  # bytes of a text that are split into words at a time
_SPACES, _CONTINUES = b" \t\n\v\f\r", bytes(range(0x80, 0xC0))


def failures(data: bytes) -> int:
    """Bits 0 to 3: the text (UTF-8) fails A (few words), B (few distinct ones), C (many capitals), D (marks)."""
    words, seen, at = 0, set(), 0
    while at < len(data):
        to = min(len(data), at + BLOCK)
        while to < len(data) and data[to] not in _SPACES:
            to += 1
        block = data[at:to].split()
        words, at = words + len(block), to
        seen.update(block)
    capitals = len(data) - len(data.translate(None, UPPER.encode()))
    points = len(data.translate(None, _CONTINUES))
    marked = len(data.translate(None, MARKS.encode())) < len(data)
    return (words < MIN_WORDS) | (100 * len(seen) < DISTINCT_PERCENT * words) << 1 | (100 * capitals > UPPER_PERCENT * points) << 2 | marked << 3


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [x.as_py() or b"" for x in b.column("text").cast(pa.large_binary())]
        columns = [b.column("doc_id"), b.column("part"), pa.array([failures(t) for t in texts], pa.int32()), pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "part", "mask", "digest"])


def steps() -> np.ndarray:
    """(masks, orders): the step, from 0, at which each order removes rows of each mask; NEVER where none does."""
    masks = np.arange(1 << len(FILTERS))
    fails = np.where(masks[:, None] >> np.arange(len(FILTERS)) & 1, 0, NEVER)
    position = np.array([[order.index(f) for order in ORDERS] for f in FILTERS])
    return np.minimum((fails[:, :, None] + position[None]).min(1), NEVER)


def tally(counts: np.ndarray) -> dict[str, np.ndarray]:
    """For counts (masks, 3: rows, good, toxic) of one part the measures (orders, steps) of every order."""
    at, n_orders, n_steps = steps(), len(ORDERS), len(FILTERS)
    gone = np.zeros((n_orders, n_steps + 1, counts.shape[1]), np.int64)
    which = np.broadcast_to(np.arange(n_orders), at.shape)
    np.add.at(gone, (which, at), np.broadcast_to(counts[:, None, :], (*at.shape, counts.shape[1])))
    gone = gone[:, :n_steps]
    filters = np.array([[FILTERS.index(f) for f in order] for order in ORDERS])
    fails = np.arange(len(counts))[:, None, None] >> filters & 1
    before = at[:, :, None] < np.arange(n_steps)
    redundant = np.einsum("mos,m->os", (fails & before).astype(np.int64), counts[:, 0])
    shares = np.zeros(n_steps, np.int64)
    np.add.at(shares, filters, gone[:, :, 0])
    return {
        "kept": counts[:, 0].sum() - gone[:, :, 0].cumsum(1), "removed": gone[:, :, 0], "redundant": redundant, "unique_fails": counts[1 << filters, 0],
        "good_lost": gone[:, :, 1], "toxic_lost": gone[:, :, 2], "shapley": shares[filters],
    }


_MEASURES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def _expanded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n = len(ORDERS) * len(FILTERS)
    for b in batches:
        for part, cells in zip(b.column("part").to_pylist(), b.column("cells").to_pylist()):
            counts = np.zeros((1 << len(FILTERS), 3), np.int64)
            for c in cells:
                counts[c["mask"]] = c["n"], c["good"], c["toxic"]
            found = tally(counts)
            columns = [pa.array([part] * n, pa.string()), pa.array(np.repeat(ORDERS, len(FILTERS)), pa.string()), pa.array(np.tile(np.arange(1, len(FILTERS) + 1), len(ORDERS)), pa.int32())]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array(found[m].reshape(-1), pa.int64()) for m in _MEASURES)], ["part", "filter_order", "step", *_MEASURES])


def masks(docs: DataFrame, part: Column | None = None) -> DataFrame:
    """(doc_id, part, mask) per row of docs: bit f of mask says that the row fails filter f of FILTERS.

    part: `lang` unless given; null is the empty string. E fails a row if a row of smaller doc_id has the same text (by SHA-256),
    in whatever part. Null texts count as empty ones; a row without an id repeats none and is repeated by none.
    """
    rows = docs.select("doc_id", F.coalesce((F.col("lang") if part is None else part).cast("string"), F.lit("")).alias("part"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = cut(rows.mapInArrow(_judged, f"doc_id {kind}, part string, mask int, digest binary"))
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("__first"), F.count("*").alias("__n")).filter("__n > 1")
    again = F.coalesce(F.col("__first") < F.col("doc_id"), F.lit(False)).cast("int")
    found = rows.join(small(cut(first.select("digest", "__first"))), "digest", "left")
    return found.select("doc_id", "part", F.col("mask").bitwiseOR(F.shiftleft(again, 4)).alias("mask"))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, filter_order (all permutations of FILTERS) and step (1 to 5), with counts of the part's rows.

    kept: left after this step; removed: by it; redundant: fail its filter and were removed before; unique_fails: fail its
    filter alone; good_lost, toxic_lost: removed by it with quality, toxic 1 in labels (doc_id, quality, toxic); shapley: its
    filter's removed, summed over all orders and steps. Parts are the values of lang, null being the empty string. Null texts are empty
    ones, long ones are read whole, in blocks. Repeated rows count each; of repeated labels any 1 counts; rows without an
    id have no label. An empty table gives no parts and so no rows. Other columns are ignored.
    """
    marked = [F.max((F.col(c) == 1).cast("long")).alias(c) for c in ("quality", "toxic")]
    known = labels.filter("doc_id is not null and (quality = 1 or toxic = 1)").groupBy("doc_id").agg(*marked)
    rows = masks(docs).join(known, "doc_id", "left")
    counts = rows.groupBy("part", "mask").agg(F.count("*").alias("n"), F.coalesce(F.sum("quality"), F.lit(0)).alias("good"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"))
    parts = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))  # at most 32 each
    return parts.mapInArrow(_expanded, "part string, filter_order string, step int, " + ", ".join(f"{m} long" for m in _MEASURES))
