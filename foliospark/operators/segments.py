"""A BM25 index that is kept up to date: segments that are only appended to, newer ones over older ones.

A store has, for each segment, an index of its chunks and the counts of chunks that have each term, and versions that name the segments which
count. Adding chunks writes a segment; a chunk that was there before counts as its newest segment has it, and one that was
deleted not at all. A search reads the segments without the rows that newer ones put away, known by their ids alone; statistics are the
sums over segments less what those rows had. So nothing is indexed a second time, and hits and scores are those of an index made anew.
"""

from __future__ import annotations

import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..conf import DEFAULT, EngineConf
from . import lexical
from .spotting import kept, small


class Store:
    """An index under a folder that executors share. One writer at a time; readers see the last whole version."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _versions(self) -> list[dict]:
        try:
            rows = self.spark.read.schema("value STRING").text(f"{self.path}/versions").collect()  # a short line a version
        except AnalysisException as e:
            if "PATH_NOT_FOUND" in str(e):
                return []
            raise
        return sorted((json.loads(r.value) for r in rows if r.value), key=lambda v: v["version"])

    def version(self) -> dict:
        """The last version: its number, and its segments ({name, no, kind}) in order."""
        known = self._versions()
        return known[-1] if known else {"version": 0, "segments": [], "made": 0}

    def _commit(self, segments: list[dict], made: int, seen: int) -> dict:
        if self.version()["version"] != seen:
            raise RuntimeError("the index was changed by another writer")
        v = {"version": seen + 1, "segments": segments, "made": made}
        self.spark.createDataFrame([(json.dumps(v),)], "value STRING").coalesce(1).write.mode("append").text(f"{self.path}/versions")
        return v

    def _write(self, index: DataFrame, kind: str) -> dict:
        """A new segment, of an index or of ids that are gone; nothing refers to it until a version does."""
        last, name = self.version(), uuid.uuid4().hex
        index.write.parquet(f"{self.path}/{kind}/{name}")
        if kind == "rows":
            rows = self.spark.read.parquet(f"{self.path}/rows/{name}")
            rows.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).write.parquet(f"{self.path}/df/{name}")
        return {"name": name, "no": last["made"] + 1, "kind": kind}

    def add(self, chunks: DataFrame) -> dict:
        """chunks (chunk_id, text) join the index, or take the place of what it has under their ids; of repeated ids one counts."""
        last, seg = self.version(), self._write(lexical.index(chunks.dropDuplicates(["chunk_id"])), "rows")
        return self._commit([*last["segments"], seg], seg["no"], last["version"])

    def delete(self, ids: DataFrame) -> dict:
        """Chunks of these ids (chunk_id) are in the index no more, until they are added again."""
        last, seg = self.version(), self._write(ids.select("chunk_id").distinct(), "gone")
        return self._commit([*last["segments"], seg], seg["no"], last["version"])

    def compact(self) -> dict:
        """One segment of all that counts, in place of all others."""
        last = self.version()
        seg = self._write(self.rows().drop("seg"), "rows")
        return self._commit([seg], seg["no"], last["version"])

    def _union(self, kind: str, folder: str) -> DataFrame | None:
        out = None
        for s in self.version()["segments"]:
            if s["kind"] == kind:
                part = self.spark.read.parquet(f"{self.path}/{folder}/{s['name']}").withColumn("seg", F.lit(s["no"]))
                out = part if out is None else out.unionByName(part)
        return out

    def _away(self, rows: DataFrame) -> DataFrame:
        """(chunk_id, seg) of rows that a newer segment puts away; ids alone are shuffled."""
        every, gone = rows.select("chunk_id", "seg"), self._union("gone", "gone")
        every = every if gone is None else every.unionByName(gone)
        newest = every.groupBy("chunk_id").agg(F.max("seg").alias("newest"), F.count("*").alias("n")).filter("n > 1")
        if gone is not None:  # an id that was deleted last is put away wherever it stands
            last = gone.groupBy("chunk_id").agg(F.max("seg").alias("gone"))
            newest = newest.join(last, "chunk_id", "left").withColumn("newest", F.when(F.col("gone") == F.col("newest"), F.col("newest") + 1).otherwise(F.col("newest")))
        return rows.select("chunk_id", "seg").join(small(kept(newest.select("chunk_id", "newest"))), "chunk_id").filter("seg < newest").select("chunk_id", "seg")

    def rows(self) -> DataFrame:
        """The index (chunk_id, dl, terms, tfs, seg) of all chunks that count."""
        rows = self._union("rows", "rows")
        if rows is None:
            raise ValueError("the index has no segment")
        return rows.join(small(kept(self._away(rows))), ["chunk_id", "seg"], "left_anti").select("chunk_id", "dl", "terms", "tfs", "seg")

    def statistics(self) -> tuple[DataFrame, int, float]:
        """((term, df), n, avgdl): sums over segments, less the rows that were put away."""
        rows = self._union("rows", "rows")
        away = kept(rows.join(small(kept(self._away(rows))), ["chunk_id", "seg"]).select("dl", "terms"))
        count = lambda df: df.filter("dl > 0").agg(F.count("*"), F.coalesce(F.sum(F.col("dl").cast("long")), F.lit(0))).first()
        (n, dl), (n_away, dl_away) = count(rows), count(away)
        lost = away.select(F.explode("terms").alias("term"), F.lit(-1).cast("long").alias("df"))
        df = self._union("rows", "df").select("term", "df").unionByName(lost).groupBy("term").agg(F.sum("df").alias("df")).filter("df > 0")
        return df, n - n_away, (dl - dl_away) / (n - n_away) if n > n_away else 1.0

    def search(self, questions: DataFrame, k: int, conf: EngineConf = DEFAULT) -> DataFrame:
        """(qid, chunk_id, score, rank), as lexical.search() over all chunks that count."""
        return lexical.search(questions, self.rows(), k, conf, self.statistics())
