"""SimHash near-duplicates by a binary trie self-join.

Every text gets a 64-bit fingerprint in one map-only pass. Distinct fingerprints are then joined with themselves:
two fingerprints within 2 bits agree on one of any 3 disjoint bit ranges, so a trie is walked below each such range
(its budget of errors spent on the free bits only), visiting pairs of nodes together, adding up differing bits and
dropping a pair of nodes as soon as it is over the budget. A trie that would hold more than MAX_TRIE fingerprints is
first split again by the same argument on its free bits; after four splits at most 13 bits are free, so no trie ever
holds more than 8192 fingerprints, however many near copies there are. A trie yields a spanning star per linked group,
not its pairs; stars are joined into components by alternating star contraction over shuffles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .common import cut, small

BITS, BUDGET, SHINGLE, SEED = 64, 2, 3, 42
MAX_TRIE = 512  # fingerprints below one exact range; fuller ones are split on their free bits
LEVELS = 4  # exact ranges fixed one inside the other; then at most 13 bits are free
BLOCK = 1 << 20  # bytes of a text that are split into words at a time
_GAPS = b" \t\n\v\f\r"


def _word_blocks(data: bytes) -> Iterator[list[bytes]]:
    """The words of data in order, in lists of bounded size."""
    at, end = 0, len(data)
    while at < end:
        to = min(end, at + BLOCK)
        while to < end and data[to] not in _GAPS:
            to += 1
        yield data[at:to].split()
        at = to


def fingerprint(text: str | None) -> int:
    """The signed 64-bit fingerprint of one text; 0 without words."""
    ones, n, before = np.zeros(BITS, np.int64), 0, []
    for block in _word_blocks((text or "").encode("utf-8", "surrogatepass").lower()):
        run = before + block
        if len(run) >= SHINGLE:
            h = np.array([xxhash.xxh64_intdigest(b" ".join(t), SEED) for t in zip(*(run[i:] for i in range(SHINGLE)))], np.uint64)
            ones += np.unpackbits(h.astype(">u8").view(np.uint8)).reshape(-1, BITS).sum(0, dtype=np.int64)
            n += len(h)
        before = run[-(SHINGLE - 1) :]
    if not n:
        if not before:
            return 0
        h = np.array([xxhash.xxh64_intdigest(b" ".join(before), SEED)], np.uint64)
        ones, n = np.unpackbits(h.astype(">u8").view(np.uint8)).astype(np.int64), 1
    return int(np.packbits(2 * ones > n).view(">i8")[0])


@F.pandas_udf(LongType())
def _fingerprints(text: pd.Series) -> pd.Series:
    return pd.Series([fingerprint(t) for t in text], dtype="int64")


def child_masks(mask: int) -> list[int]:
    """mask (unsigned) with one third of its free bits fixed as well, for each third."""
    free = [b for b in range(BITS - 1, -1, -1) if not mask >> b & 1]
    third = -(-len(free) // 3)
    return [mask | sum(1 << b for b in free[i : i + third]) for i in range(0, len(free), third)]


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def trie_pairs(fps: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs i < j within BUDGET bits, for each run [start, end) of fps (unsigned, ascending and distinct in a run)."""
    alo, ahi, blo, bhi = starts, ends, starts, ends
    err = np.zeros(len(starts), np.int8)
    for bit in range(BITS - 1, -1, -1):
        ones = np.concatenate([[0], np.cumsum((fps >> np.uint64(bit)) & np.uint64(1)).astype(np.int64)])
        amid, bmid = ahi - (ones[ahi] - ones[alo]), bhi - (ones[bhi] - ones[blo])
        same = alo == blo
        parts = [(alo, amid, blo, bmid, err), (amid, ahi, bmid, bhi, err), (alo, amid, bmid, bhi, err + 1)]
        other = ~same
        parts.append((amid[other], ahi[other], blo[other], bmid[other], err[other] + 1))
        alo, ahi, blo, bhi, err = (np.concatenate(x) for x in zip(*parts))
        keep = (ahi > alo) & (bhi > blo) & (err <= BUDGET) & ~((alo == blo) & (ahi - alo < 2))
        alo, ahi, blo, bhi, err = alo[keep], ahi[keep], blo[keep], bhi[keep], err[keep]
    return alo, blo


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index reachable from each of n indices over the pairs."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _stars(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def link(runs: list[np.ndarray]) -> pd.DataFrame:
        fps, ends = np.concatenate(runs), np.cumsum([len(r) for r in runs])
        a, b = trie_pairs(fps, ends - [len(r) for r in runs], ends)
        root = _roots(len(fps), a, b)
        far = np.flatnonzero(root != np.arange(len(fps)))
        return pd.DataFrame({"u": fps[far].view(np.int64), "v": fps[root[far]].view(np.int64)})

    for pdf in batches:
        runs, load = [], 0
        for fps in pdf["fps"]:
            run = np.unique(np.asarray(fps, np.int64).view(np.uint64))
            runs.append(run)
            load += len(run) ** 2
            if load > 2_000_000:
                yield link(runs)
                runs, load = [], 0
        if runs:
            yield link(runs)


def link_fingerprints(fps: DataFrame) -> DataFrame:
    """Edges (u, v) that connect exactly the fingerprints (column fp, distinct, not null) that links connect."""
    masks, masks_of = [0], {0: child_masks(0)}
    rows = fps.select(F.lit(0).cast("long").alias("mask"), "fp")
    found = None
    for level in range(LEVELS):
        kids = F.create_map(*[x for m in masks for x in (F.lit(_signed(m)).cast("long"), F.array(*[F.lit(_signed(c)).cast("long") for c in masks_of[m]]))])
        rows = rows.select("fp", F.explode(kids[F.col("mask")]).alias("mask")).select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("val"), "fp")
        counts = cut(rows.groupBy("mask", "val").count().filter("count > 1"))
        last = level == LEVELS - 1
        fit = counts if last else counts.filter(F.col("count") <= MAX_TRIE)
        runs = rows.join(fit.select("mask", "val"), ["mask", "val"]).groupBy("mask", "val").agg(F.collect_list("fp").alias("fps"))
        edges = runs.select("fps").mapInPandas(_stars, "u long, v long")
        found = edges if found is None else found.unionByName(edges)
        over = counts.filter(F.col("count") > MAX_TRIE)
        if last or over.isEmpty():
            break
        rows = rows.join(over.select("mask", "val"), ["mask", "val"]).select("mask", "fp")
        masks = [c for m in masks for c in masks_of[m]]
        masks_of = {m: child_masks(m) for m in masks}
    return cut(found.distinct())


def components(edges: DataFrame) -> DataFrame:
    """(id, root) for every end of the edges (u, v): root is the smallest id connected with it.

    Alternates large-star and small-star steps until no edge changes; each step groups with partial aggregation and
    joins on the end of an edge, a join whose hot keys adaptive execution can split.
    """
    edges = cut(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        edges = cut(joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    labels = edges.select(F.col("u").alias("id"), F.col("v").alias("root"))
    return labels.unionByName(labels.select(F.col("root").alias("id"), "root").distinct())


def _component_of(rows: DataFrame) -> DataFrame:
    """(fp, root, component_id) for every fingerprint of rows (doc_id, fp): root is equal for all that links connect, and
    component_id is their smallest doc_id."""
    classes = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("low")))
    labels = cut(components(link_fingerprints(classes.select("fp"))))
    lows = labels.join(classes, labels["id"] == classes["fp"]).groupBy("root").agg(F.min("low").alias("low"))
    linked = labels.join(lows, "root").select(F.col("id").alias("fp"), "root", F.col("low").alias("linked"))
    return cut(classes.join(linked, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), F.coalesce("linked", "low").alias("component_id")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: its id, fingerprint (16 hex digits) and component_id, the smallest id reachable over links.

    Null and wordless texts have fingerprint zero and link like others. Repeated rows and ids stay as they are. Null ids
    are kept and never become a component_id, unless a component has no other (then null). A bit that is set in just half the shingles is 0.
    Long texts are read whole, in blocks; an empty table gives an empty result. Other columns are ignored.
    """
    rows = cut(docs.select(F.col(id_col).alias("doc_id"), _fingerprints(F.col(text_col)).alias("fp")))
    return rows.join(small(_component_of(rows)), "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one row of each component: that of smallest doc_id, null ids last, of those that of smallest text hash.

    An id may stand on rows of different texts; each belongs to the component of its text. Of rows equal in doc_id and text
    one is kept, whatever their other columns. Rows are unchanged, an empty table stays empty. What is decided about rows are
    ids and hashes; texts meet those that go, which are broadcast if they are few.
    """
    rows = cut(docs.select("doc_id", F.xxhash64("text").alias("hash"), _fingerprints(F.col("text")).alias("fp")))
    keys = rows.groupBy("doc_id", "hash", "fp").agg(F.count("*").alias("n"))
    keys = cut(keys.join(small(_component_of(rows).select("fp", "root")), "fp"))
    me = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "hash")
    first = cut(keys.groupBy("root").agg(F.min(me).alias("first")))
    verdict = keys.join(small(first), "root").select(F.col("doc_id").alias("__id"), F.col("hash").alias("__hash"), "n", (me == F.col("first")).alias("__stays"))
    marked = cut(verdict.filter("not __stays or n > 1"))
    is_row = docs["doc_id"].eqNullSafe(F.col("__id")) & (F.xxhash64(docs["text"]) == F.col("__hash"))
    kept = docs.join(small(marked), is_row, "left_anti")
    again = marked.filter("__stays")
    if again.isEmpty():
        return kept
    repeated = docs.join(small(again), is_row, "left_semi").withColumn("__hash", F.xxhash64("text")).dropDuplicates(["doc_id", "__hash"])
    return kept.unionByName(repeated.drop("__hash"))
