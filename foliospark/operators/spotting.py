"""Where names stand in texts: an automaton of the names is sent to the texts, which stay where they are.

Names are taken in shards of bounded bytes, one automaton each, dealt out by hash; texts are read once a shard. What leaves a task are
matches, in a shuffle only where several shards have to agree on the longest name, and then without texts.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .automaton import BYTES_A_CHARACTER, Automaton

BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 128 << 20  # of an automaton and what is known of its names, at most about so many
SEARCHED = 1 << 20  # characters of texts that are worked on together
SPREAD_BYTES = 256 << 20
RETURNED = 16 << 20  # bytes of rows in a batch that is given back, about
RECEIVED = 16 << 20  # bytes of rows in a batch that a worker gets, in steps that are run at once: it and the JVM hold some of them at a time
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df (narrow and cheap to count) with a broadcast hint if it has few enough rows; a larger one is joined by a shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which executors share. Where that is unset, one of its own serves on a single machine;
    on a cluster that is an error."""
    sc = spark.sparkContext
    known = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not known and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    known = known or tempfile.mkdtemp(prefix="foliospark-checkpoint-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(known)
    return known


@contextmanager
def bounded_batches(spark: SparkSession) -> Iterator[None]:
    """Within it, workers get batches of RECEIVED bytes, unless the session has a bound of its own."""
    own = spark.conf.get(BATCH_BYTES, None) is not None
    if not own:
        spark.conf.set(BATCH_BYTES, str(RECEIVED))
    try:
        yield
    finally:
        if not own:
            spark.conf.unset(BATCH_BYTES)


def kept(df: DataFrame) -> DataFrame:
    """df, written once to the shared folder: what follows neither recomputes it nor carries its plan."""
    shared_folder(df.sparkSession)
    with bounded_batches(df.sparkSession):
        return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """df, written once as Parquet under the shared folder and read from there: for what is large and read several times, a few columns each."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/rows-{uuid.uuid4().hex}"
    with bounded_batches(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """df over all cores if it is small by Spark's estimate: a small table in one file would be a single task. Large ones stay as they are, and
    so do columns and rows of files that are as many as cores."""
    size, cores = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())), df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if size <= SPREAD_BYTES and not _in_files(df, cores) else df


def _in_files(df: DataFrame, n: int) -> bool:
    """Whether df is columns and rows of n files or more, read where they are."""
    plan = df._jdf.queryExecution().optimizedPlan()
    while plan.nodeName() in ("Project", "Filter"):
        plan = plan.child()
    return plan.nodeName() == "LogicalRelation" and len(df.inputFiles()) >= n


class Names:
    """One shard: an automaton of different names, and the rows that each of them has."""

    def __init__(self, table: pa.Table, name: str):
        table = table.combine_chunks()
        of = table[name].to_pylist()
        names = sorted(set(of))
        number = {n: k for k, n in enumerate(names)}
        row = np.argsort(np.array([number[n] for n in of], np.int64), kind="stable")
        self.automaton, self.rows = Automaton(names), table.take(pa.array(row))
        self.counts = np.bincount([number[n] for n in of], minlength=len(names)) if of else np.zeros(0, np.int64)
        self.begins = np.cumsum(self.counts) - self.counts

    def pairs(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(text, row): the rows of the names that each text holds, each once."""
        text, name = self.automaton.held(texts)
        which, row = self.rows_of(name)
        return text[which], row

    def rows_of(self, name: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in name, row): the rows of each of these names."""
        n = self.counts[name]
        return np.repeat(np.arange(len(name)), n), np.repeat(self.begins[name], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def _shards(names: DataFrame, name: str, by: tuple[str, ...] = ()) -> Iterator[DataFrame]:
    """Parts of names, each of bounded bytes; names must be kept. Rows that agree in the columns `by` stay together."""
    size = F.octet_length(F.to_json(F.struct(*names.columns))) + BYTES_A_CHARACTER * F.length(name)
    n = -(-(names.agg(F.sum(size.cast("long"))).first()[0] or 0) // BROADCAST_BYTES)
    for k in range(max(1, n)):
        yield names.filter(F.pmod(F.xxhash64(*(by or names.columns)), F.lit(n)) == k) if n > 1 else names


def pieces(b: pa.RecordBatch, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose texts have about SEARCHED characters together, at least a row each: what is made of texts in a
    worker is bounded by this, not by the rows of a batch."""
    ends = np.cumsum(pc.fill_null(pc.utf8_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    begin = 0
    while begin < b.num_rows:
        before = int(ends[begin - 1]) if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, before + SEARCHED, side="right")))
        yield b.slice(begin, end - begin)
        begin = end


def searched(rows: DataFrame, names: DataFrame, schema: StructType, give: Callable[[pa.Table, list[str], Names], Iterator[pa.Table]], name: str = "name", by: tuple[str, ...] = ()) -> DataFrame:
    """What give() makes of parts of rows (text, ...), their texts and a shard of names (name, ...): a map over rows for each shard.

    Empty names are left out; null texts are empty. Rows of names that agree in the columns `by` are in one shard.
    """
    usable = kept(names.filter(F.length(name) > 0))
    out = None
    for shard in _shards(usable, name, by):
        known = rows.sparkSession.sparkContext.broadcast(Names(shard.toArrow(), name))

        def search(batches: Iterator[pa.RecordBatch], known=known) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for piece in pieces(b):
                    for t in give(pa.Table.from_batches([piece]), [x or "" for x in piece.column("text").to_pylist()], known.value):
                        yield from t.combine_chunks().to_batches()

        found = spread(rows).mapInArrow(search, schema)
        out = found if out is None else out.unionByName(found)
    return out


def agreeing(part: pa.Table, names: pa.Table, text: np.ndarray, row: np.ndarray, on: tuple[str, ...]) -> np.ndarray:
    """Whether rows of part and of names agree in the columns `on`; nulls agree with nothing."""
    out = np.ones(len(text), bool)
    for c in on:
        same = part[c].to_numpy()[text] == names[c].to_numpy()[row]
        out &= same & part[c].is_valid().to_numpy()[text] & names[c].is_valid().to_numpy()[row]
    return out


def spotted(rows: DataFrame, names: DataFrame, name: str = "name", on: tuple[str, ...] = (), carry: tuple[str, ...] | None = None) -> DataFrame:
    """rows (text, ...) with each row of names (name, ...) whose name their text contains, and that agrees in the columns `on`.

    A map over rows, whatever the number of names. Empty names stand nowhere; null texts hold nothing. carry: the columns of rows
    that come out (all, unless given); a text that comes out is written once for every name that it holds.
    """
    carry = tuple(rows.columns) if carry is None else carry
    more = [c for c in names.columns if c not in on]
    schema = StructType([*(rows.schema[c] for c in carry), *(names.schema[c] for c in more)])

    def give(part: pa.Table, texts: list[str], known: Names) -> Iterator[pa.Table]:
        text, row = known.pairs(texts)
        if on:
            fits = agreeing(part, known.rows, text, row, on)
            text, row = text[fits], row[fits]
        part = part.select(list(carry))
        step = max(1, int(RETURNED * len(part) // max(1, part.nbytes)))
        for k in range(0, len(text), step):
            left, right = part.take(pa.array(text[k : k + step])), known.rows.take(pa.array(row[k : k + step]))
            for c in more:
                left = left.append_column(c, right[c])
            yield left

    return searched(rows, names, schema, give, name)


def tallied(rows: DataFrame, names: DataFrame) -> DataFrame:
    """(name, n_chunks, first): of each of the names (name) that stand in some of rows (chunk_id, text), in how many, and the
    smallest chunk_id. Tasks count before anything leaves them."""
    schema = StructType([names.schema["name"], StructField("n_chunks", LongType()), StructField("first", rows.schema["chunk_id"].dataType)])

    def give(part: pa.Table, texts: list[str], known: Names) -> Iterator[pa.Table]:
        text, name = known.automaton.held(texts)
        order = pc.sort_indices(part["chunk_id"]).to_numpy()
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        least = np.full(len(known.counts), len(order))
        np.minimum.at(least, name, place[text])
        n = np.bincount(name, minlength=len(known.counts))
        some = np.flatnonzero(n)
        yield pa.table([known.rows["name"].take(pa.array(known.begins[some])), pa.array(n[some]), part["chunk_id"].take(pa.array(order[least[some]]))], ["name", "n_chunks", "first"])

    found = searched(rows.select("chunk_id", "text"), names.select("name").distinct(), schema, give)
    return found.groupBy("name").agg(F.sum("n_chunks").alias("n_chunks"), F.min("first").alias("first"))


def longest(rows: DataFrame, names: DataFrame, most: int) -> DataFrame:
    """(qid, name, at) for rows (qid, text): the longest of the names (name) at each place, from the left, each after the end of
    the one before, `most` a text; at counts characters from 1."""
    usable = kept(names.select("name").filter(F.length("name") > 0).distinct())
    asked, found = rows.select("qid", "text"), []
    shards = list(_shards(usable, "name"))
    alone = len(shards) == 1
    kind = f"qid {dict(rows.dtypes)['qid']}, name string, at int"
    for shard in shards:
        known = rows.sparkSession.sparkContext.broadcast(Names(shard.toArrow(), "name"))

        def search(batches: Iterator[pa.RecordBatch], known=known) -> Iterator[pa.RecordBatch]:
            for b in batches:
                words = known.value.rows["name"]
                for piece in pieces(b):
                    texts = [t or "" for t in piece.column("text").to_pylist()]
                    if alone:
                        hits = known.value.automaton.longest_first(texts, most)
                        text, start, name = (np.array(x, np.int64) for x in (zip(*hits) if hits else ((), (), ())))
                    else:  # other shards may have longer names, so none is taken yet
                        text, start, name = known.value.automaton.find(texts)
                    row = pa.array(known.value.begins[name])
                    yield pa.RecordBatch.from_arrays([piece.column("qid").take(pa.array(text)), words.take(row).combine_chunks(), pa.array((start + 1).astype(np.int32))], ["qid", "name", "at"])

        found.append(asked.mapInArrow(search, kind))
    if alone:
        return found[0]
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    best = every.groupBy("qid", "at").agg(F.max(F.length("name")).alias("n"), F.max_by("name", F.length("name")).alias("name"))
    order = F.array_sort(F.collect_list(F.struct("at", "n", "name")))  # of one text, one for each place at most
    start = F.struct(F.lit(1).alias("free"), F.expr("cast(array() as array<struct<at:int,n:int,name:string>>)").alias("out"))
    walk = F.aggregate(order, start, lambda a, x: F.when((x["at"] >= a["free"]) & (F.size(a["out"]) < most), F.struct((x["at"] + x["n"]).alias("free"), F.concat(a["out"], F.array(x)).alias("out"))).otherwise(a))["out"]
    return best.groupBy("qid").agg(walk.alias("w")).select("qid", F.explode("w").alias("x")).select("qid", "x.name", "x.at")
