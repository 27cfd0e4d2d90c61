"""Exact cosine search over vectors (id, vec)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lexical import CELLS, Best, _cut, top
from .spotting import pieces

BLOCK = 4096  # query vectors that are broadcast at a time


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def normalised(vectors: DataFrame, vec: str = "vec") -> DataFrame:
    """vectors with vec as doubles of length one; a zero vector stays zero."""
    return vectors.withColumn("__n", norm(F.col(vec)) + 1e-12).withColumn(vec, F.transform(vec, lambda x: x.cast("double") / F.col("__n"))).drop("__n")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def search(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(qid, chunk_id, score, rank): the k nearest of vectors (chunk_id, vec) for each of queries (qid, vec); with ids of the same
    integer type, itself left out.

    Blocks of queries are broadcast; each task multiplies them with its rows and passes on its best k.
    """
    spark, n = vectors.sparkSession, queries.count()
    kinds = dict(queries.dtypes)["qid"], dict(vectors.dtypes)["chunk_id"]
    same = set(kinds) == {"bigint"}
    ids_of = lambda col, kind: col.to_numpy(np.int64) if kind == "bigint" else col.to_numpy(object)
    blocks = max(1, -(-n // BLOCK))
    out = None
    for b in range(blocks):
        part = queries.filter(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == b).select("qid", "vec").orderBy("qid").toPandas()
        ids = ids_of(part["qid"], kinds[0])
        q = np.array(part["vec"].tolist(), float).reshape(len(ids), -1)
        held = spark.sparkContext.broadcast((ids, q / (np.linalg.norm(q, axis=1, keepdims=True) + 1e-12)))

        def best(batches: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            ids, q = held.value
            found, step = Best(len(ids), k, -np.inf), max(1, CELLS // max(1, len(ids)))
            for pdf in batches:
                if not len(pdf) or not len(ids):
                    continue
                pdf = pdf.sort_values("chunk_id")  # ties go by the chunk
                c, v = ids_of(pdf["chunk_id"], kinds[1]), np.array(pdf["vec"].tolist(), float)
                v /= np.linalg.norm(v, axis=1, keepdims=True) + 1e-12
                for at in range(0, len(c), step):
                    s = np.round(v[at : at + step] @ q.T, 6)
                    if same:
                        s[c[at : at + step, None] == ids] = -np.inf
                    found.add(s, pa.array(c[at : at + step]))
            if found.rows():
                i, s, c = found.rows()
                yield pd.DataFrame({"qid": ids[i], "chunk_id": c.to_numpy(zero_copy_only=False), "score": s})

        found = vectors.select("chunk_id", "vec").mapInPandas(best, f"qid {kinds[0]}, chunk_id {kinds[1]}, score double")
        out = found if out is None else out.unionByName(found)
    return top(out, k)


def point_scores(pairs: DataFrame, vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """pairs (qid, chunk_id) with their cosine; 0 where a vector is missing."""
    unit = normalised(vectors).select("chunk_id", F.col("vec").alias("v"))
    asked = normalised(queries).select("qid", F.col("vec").alias("q"))
    found = pairs.join(unit, "chunk_id", "left").join(asked, "qid", "left")
    return found.select("qid", "chunk_id", F.coalesce(F.round(dot(F.col("v"), F.col("q")), 6), F.lit(0.0)).alias("score"))


def hashed_embedding(text: Column, d: int = 64) -> Column:
    """A deterministic stand-in for a remote embedding: signed counts of hashed tokens.

    Texts are cut into tokens in arrays, once a text, and each different token of a part of texts is hashed once, as Spark's xxhash64 does.
    """

    @F.arrow_udf("array<double>")
    def embed(texts: pa.Array) -> pa.Array:
        out = [np.zeros((0, d))]
        for piece in pieces(pa.RecordBatch.from_arrays([texts], ["text"])):
            row, name, names = _cut([t or "" for t in piece.column(0).to_pylist()])
            h = xxhash64(names)
            cell = row * np.int64(d) + (h % d)[name]
            out.append(np.bincount(cell, np.where(h >> 8 & 1, -1.0, 1.0)[name], piece.num_rows * d).reshape(-1, d))
        vectors = np.concatenate(out)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(vectors) + 1, dtype=np.int32) * np.int32(d)), pa.array(vectors.ravel()))

    return embed(text)


def xxhash64(names: pa.Array) -> np.ndarray:
    """Spark's xxhash64 of strings: XXH64 of their bytes, with 42 as its seed. Strings advance together, a word at a time."""
    p1, p2, p3, p4, p5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turned = lambda x, n: x << np.uint64(n) | x >> np.uint64(64 - n)
    mixed = lambda h, x: turned(h + x * p2, 31) * p1
    data = pa.concat_arrays([names.cast(pa.large_binary())])
    ends = np.frombuffer(data.buffers()[1], np.int64)[data.offset : data.offset + len(data) + 1]
    size, at = np.diff(ends), ends[:-1].copy()
    raw = np.frombuffer(data.buffers()[2], np.uint8) if data.buffers()[2] else np.zeros(0, np.uint8)
    raw = np.append(raw, np.zeros(8, np.uint8))
    read = lambda at, kind: raw[at[:, None] + np.arange(np.dtype(kind).itemsize)].view(kind)[:, 0].astype(np.uint64)
    with np.errstate(over="ignore"):
        seed, h = np.uint64(42), np.full(len(size), np.uint64(42) + p5)
        left = np.flatnonzero(size >= 32)
        if len(left):
            lanes, long = [np.full(len(size), x) for x in (seed + p1 + p2, seed + p2, seed, seed - p1)], left
            while len(left):
                for k, lane in enumerate(lanes):
                    lane[left] = mixed(lane[left], read(at[left] + 8 * k, "<u8"))
                at[left] += 32
                left = left[ends[1:][left] - at[left] >= 32]
            h[long] = sum(turned(lane[long], n) for lane, n in zip(lanes, (1, 7, 12, 18)))
            for lane in lanes:
                h[long] = (h[long] ^ mixed(np.uint64(0), lane[long])) * p1 + p4
        h += size.astype(np.uint64)
        left = np.flatnonzero(ends[1:] - at >= 8)
        while len(left):
            h[left] = turned(h[left] ^ mixed(np.uint64(0), read(at[left], "<u8")), 27) * p1 + p4
            at[left] += 8
            left = left[ends[1:][left] - at[left] >= 8]
        left = np.flatnonzero(ends[1:] - at >= 4)
        h[left] = turned(h[left] ^ read(at[left], "<u4") * p1, 23) * p2 + p3
        at[left] += 4
        left = np.flatnonzero(ends[1:] > at)
        while len(left):
            h[left] = turned(h[left] ^ raw[at[left]].astype(np.uint64) * p5, 11) * p1
            at[left] += 1
            left = left[ends[1:][left] > at[left]]
        h = (h ^ h >> np.uint64(33)) * p2
        h = (h ^ h >> np.uint64(29)) * p3
        return (h ^ h >> np.uint64(32)).view(np.int64)
