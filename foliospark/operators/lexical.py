"""BM25 over chunks (chunk_id, text), for many questions (qid, text) at once.

Chunks are read as a forward index: per chunk its length and the counts of its terms, made within the row, so nothing is
shuffled for it. Texts are cut into terms once: an index is written before it is searched, and one that is kept (keep) serves
any number of searches. Statistics and scoring then read its columns: questions are broadcast block by block, every task scores its
chunks against all questions of the block and passes on its best k a question, so what is shuffled grows with questions and
tasks, not with questions times chunks. Terms that many questions and chunks have are multiplied as a matrix, the others go by lists.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..conf import DEFAULT, EngineConf
from ..functions.text import tokens
from .automaton import points
from .spotting import BROADCAST_ROWS, bounded_batches, kept, pieces, shared_folder, small, spread

ASKED = 1_000_000  # terms of questions that are broadcast at a time, repeats between questions counted
CELLS = 1_000_000  # questions times chunks that a task scores together
ROWS = 1_000  # chunks that a task scores together at most
COMMON = 1_024  # terms at most whose weights are multiplied as a matrix
COMMON_SHARE = 0.002  # of questions times chunks have a term: above it a matrix is faster than lists
LEAST_ASKED = 64  # questions from which on a matrix is used
ENTRIES = 1_000_000  # shared terms of questions and chunks that a task adds up together, a chunk's at least


def index(chunks: DataFrame) -> DataFrame:
    """(chunk_id, dl, terms, tfs): each chunk's length in tokens, different terms in order, and how often it has them.

    A chunk without tokens has none. An index may stand for chunks wherever they are searched.
    """
    return spread(chunks.select("chunk_id", F.coalesce("text", F.lit("")).alias("text"))).mapInArrow(_counted, f"chunk_id {dict(chunks.dtypes)['chunk_id']}, dl int, terms array<string>, tfs array<int>")


#: The lower-case form of an ASCII letter or digit by code point, 0 for everything else.
LOWER = np.array([ord(chr(c).lower()) if chr(c).isalnum() and c < 128 else 0 for c in range(129)], np.uint8)


def _cut(texts: list[str]) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(text, name, names): the tokens that functions.text.tokens has in texts, as places in names, which are different and in order.

    Words and pairs are cut and numbered in arrays; only different ones become strings.
    """
    chars = points("\n".join(texts))
    text = np.repeat(np.arange(len(texts), dtype=np.int32), [len(t) + 1 for t in texts])
    low = LOWER[np.minimum(chars, 128)]
    place = np.flatnonzero(low)
    first = np.flatnonzero(np.diff(place, prepend=-2) > 1)
    ends = pa.py_buffer(np.append(first, len(place)).astype(np.int32))
    words = pa.StringArray.from_buffers(len(first), ends, pa.py_buffer(low[place])).dictionary_encode()
    order = pc.sort_indices(words.dictionary)
    rank = np.empty(len(order), np.int64)
    rank[order.to_numpy()] = np.arange(len(order))

    han = np.flatnonzero((chars >= 0x4E00) & (chars <= 0x9FFF))
    goes_on = np.diff(han, prepend=-2) == 1
    paired = np.append(goes_on[1:], False)[: len(han)]
    code = chars[han].astype(np.int64) - 0x4E00
    code = code << 15 | np.where(paired, np.append(code[1:], 0)[: len(han)] + 1, 0)
    used = paired | ~goes_on  # of a run, all but the last; one that is alone as it is
    codes, pair = np.unique(code[used], return_inverse=True)
    pairs = [chr(0x4E00 + (c >> 15)) + (chr(0x4DFF + (c & 0x7FFF)) if c & 0x7FFF else "") for c in codes.tolist()]
    names = pa.concat_arrays([words.dictionary.take(order), pa.array(pairs, pa.string())])
    return np.concatenate([text[place[first]], text[han[used]]]), np.concatenate([rank[words.indices.to_numpy()], len(order) + pair]), names


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for piece in pieces(b):
            row, name, names = _cut([t or "" for t in piece.column("text").to_pylist()])
            dl = np.bincount(row, minlength=piece.num_rows)
            both, n = np.unique(row * np.int64(max(1, len(names))) + name, return_counts=True)
            row, term = np.divmod(both, max(1, len(names)))
            ends = pa.array(np.searchsorted(row, np.arange(piece.num_rows + 1)).astype(np.int32))
            terms = names.take(pa.array(term))
            yield pa.RecordBatch.from_arrays([piece.column("chunk_id"), pa.array(dl.astype(np.int32)), pa.ListArray.from_arrays(ends, terms), pa.ListArray.from_arrays(ends, pa.array(n.astype(np.int32)))], ["chunk_id", "dl", "terms", "tfs"])


def keep(chunks: DataFrame, path: str | None = None) -> DataFrame:
    """The index, written as Parquet under path (which executors share; a new one in the shared folder unless given) and read from there.

    chunks that are an index already are given back.
    """
    if "tfs" in chunks.columns:
        return chunks
    path = path or f"{shared_folder(chunks.sparkSession).rstrip('/')}/bm25-{uuid.uuid4().hex}"
    with bounded_batches(chunks.sparkSession):
        index(chunks).write.mode("overwrite").parquet(path)
    return chunks.sparkSession.read.parquet(path)


def _indexed(chunks: DataFrame) -> DataFrame:
    return chunks if "tfs" in chunks.columns else index(chunks)


def postings(chunks: DataFrame) -> DataFrame:
    """(term, chunk_id, tf, dl); chunks without tokens have none."""
    rows = _indexed(chunks).select("chunk_id", "dl", F.explode(F.arrays_zip("terms", "tfs")).alias("x"))
    return rows.select("x.terms", "chunk_id", F.col("x.tfs").cast("long").alias("tf"), "dl").withColumnRenamed("terms", "term")


def frequencies(chunks: DataFrame) -> DataFrame:
    """(term, df): in how many chunks each term stands."""
    return _indexed(chunks).select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def corpus(chunks: DataFrame) -> DataFrame:
    """One row (n, avgdl) over chunks that have tokens."""
    return _indexed(chunks).filter("dl > 0").agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def query_terms(questions: DataFrame) -> DataFrame:
    return questions.select("qid", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))


def _weights(questions: DataFrame, docs: DataFrame, stats: tuple[DataFrame, int, float] | None = None) -> tuple[DataFrame, float]:
    """(qid, term, idf) of terms that some chunk has, and the mean length. docs: an index that is kept; stats: what is known of it."""
    asked = query_terms(questions)
    if stats is None:
        total = docs.filter("dl > 0").agg(F.count("*").alias("n"), F.sum(F.col("dl").cast("long")).alias("dl")).first()
        wanted = kept(asked.select("term").distinct())
        few = wanted.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS  # else all terms are counted: counts are shuffled, not the terms of all chunks
        rows = docs.select(F.explode("terms").alias("term"))
        df = (rows.join(F.broadcast(wanted), "term", "left_semi") if few else rows).groupBy("term").agg(F.count("*").alias("df"))
        stats = df, total["n"], (total["dl"] / total["n"] if total["n"] else 1.0)
    df, n, avgdl = stats
    return asked.join(df, "term").select("qid", "term", idf(F.lit(n), F.col("df")).alias("idf")), avgdl


def scores(questions: DataFrame, chunks: DataFrame, conf: EngineConf = DEFAULT, k: int | None = None, stats: tuple[DataFrame, int, float] | None = None) -> DataFrame:
    """(qid, chunk_id, score) of chunks that share a term with the question: all of them, or with k at least the best k. stats: ((term, df),
    n, avgdl) of an index, where they are known."""
    docs = keep(chunks)
    weights, avgdl = _weights(questions, docs, stats)
    weights = kept(weights)
    n_asked = weights.count()
    blocks = max(1, -(-n_asked // ASKED))
    kinds = dict(questions.dtypes)["qid"], dict(docs.dtypes)["chunk_id"]
    out = None
    for b in range(blocks):
        part = weights.filter(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == b).orderBy("term", "qid").toArrow()
        found = docs.select("chunk_id", "dl", "terms", "tfs").mapInArrow(_scorer(docs, part, avgdl, conf, k), f"qid {kinds[0]}, chunk_id {kinds[1]}, score double")
        out = found if out is None else out.unionByName(found)
    return out.select("qid", "chunk_id", F.round("score", 6).alias("score"))


def _common(times: np.ndarray, idfs: np.ndarray, n_asked: int) -> np.ndarray:
    """Places of terms that most questions and chunks share, by their number of questions and their idf."""
    share = times / max(1, n_asked) * np.exp(-idfs)  # exp(-idf) is about the share of chunks
    most = np.argsort(-share, kind="stable")[:COMMON]
    return most[share[most] > COMMON_SHARE] if n_asked >= LEAST_ASKED else most[:0]


def _scorer(docs: DataFrame, asked: pa.Table, avgdl: float, conf: EngineConf, k: int | None):
    """A function over batches of the index, for a block of weights sorted by term."""
    asked = asked.combine_chunks()
    qids = asked["qid"].unique()
    who = pc.index_in(asked["qid"], value_set=qids).to_numpy().astype(np.int32)
    terms, idfs = asked["term"].unique(), asked["idf"].to_numpy()
    starts = np.searchsorted(pc.index_in(asked["term"], value_set=terms).to_numpy(), np.arange(len(terms) + 1))
    common = _common(np.diff(starts), idfs[starts[:-1]], len(qids))
    held = docs.sparkSession.sparkContext.broadcast((qids, terms, who, idfs, starts, common))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, terms, who, idfs, starts, common = held.value
        if not len(qids):
            return
        step, best = max(1, min(ROWS, CELLS // len(qids))), None if k is None else Best(len(qids), k)
        column = np.full(len(terms) + 1, -1)  # the last: of no term
        column[common] = np.arange(len(common))
        matrix = np.zeros((len(common), len(qids)))
        for j, t in enumerate(common):
            matrix[j, who[starts[t] : starts[t + 1]]] = idfs[starts[t] : starts[t + 1]]
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                rb = whole.slice(at, step)
                order = pc.sort_indices(rb.column("chunk_id"))  # ties go by the chunk
                rb = pa.RecordBatch.from_arrays([c.take(order) for c in rb.columns], names=rb.schema.names)
                lists, n = rb.column("terms"), rb.num_rows
                chunk = np.repeat(np.arange(n), pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False))
                term = pc.index_in(lists.flatten(), value_set=terms).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
                has = term >= 0
                chunk, term, tf = chunk[has], term[has], rb.column("tfs").flatten().to_numpy(zero_copy_only=False)[has].astype(float)
                dl = rb.column("dl").to_numpy(zero_copy_only=False)[chunk]
                w = tf * (conf.k1 + 1) / (tf + conf.k1 * (1 - conf.b + conf.b * dl / avgdl))
                place = column[term]
                often = place >= 0
                shared = np.zeros((n, len(common)))
                shared[chunk[often], place[often]] = w[often]
                s = shared @ matrix  # a chunk's scores lie together
                chunk, term, w = chunk[~often], term[~often], w[~often]
                times = starts[term + 1] - starts[term]
                upto = np.append(0, np.cumsum(np.bincount(chunk, times, n)))
                low = 0
                while low < n:  # a chunk's terms stay together
                    high = max(low + 1, int(np.searchsorted(upto, upto[low] + ENTRIES, side="right")) - 1)
                    own = slice(*np.searchsorted(chunk, (low, high)))
                    entry = np.arange(int(times[own].sum())) + np.repeat(starts[term[own]] - np.cumsum(times[own]) + times[own], times[own])
                    cell = who[entry] + np.repeat((chunk[own] - low) * len(qids), times[own])
                    s[low:high] += np.bincount(cell, idfs[entry] * np.repeat(w[own], times[own]), len(qids) * (high - low)).reshape(high - low, len(qids))
                    low = high
                if best is None:
                    c, q = np.nonzero(s > 0)
                    yield pa.RecordBatch.from_arrays([qids.take(pa.array(q)), rb.column("chunk_id").take(pa.array(c)), pa.array(s[c, q])], names=["qid", "chunk_id", "score"])
                else:
                    best.add(s, rb.column("chunk_id"))
        if best is not None and best.rows():
            q, score, ids = best.rows()
            yield pa.RecordBatch.from_arrays([qids.take(pa.array(q)), ids, pa.array(score)], names=["qid", "chunk_id", "score"])

    return score


class Best:
    """The k rows of highest positive score of each of n questions among all that were added, rounded as they are ranked; of equal
    ones those of the smallest ids. What is held is bounded by questions times k."""

    def __init__(self, n: int, k: int, least: float = 0.0):
        self.n, self.k, self.floor = n, k, least
        self.least = np.full(n, least)  # what a score must have to be among the best, rounding left out
        self.parts: list[tuple[np.ndarray, np.ndarray, pa.Array]] = []
        self.held = self.kept = 0

    def add(self, s: np.ndarray, ids: pa.Array) -> None:
        """s: scores of rows that have these ids, in order, with all questions."""
        cell = np.flatnonzero((s >= self.least) & (s > self.floor))
        c, q = np.divmod(cell, self.n) if len(cell) <= self.n * self.k else _best(s.T, self.k, self.floor)[::-1]
        self.parts.append((q.astype(np.int32), s[c, q], ids.take(pa.array(c))))
        self.held += len(q)
        if self.held > self.kept + self.n * self.k:
            self._cut()

    def _cut(self) -> None:
        q, s = (np.concatenate([p[i] for p in self.parts]) for i in (0, 1))
        ids = pa.concat_arrays([p[2] for p in self.parts])
        order = pc.sort_indices(pa.table({"q": q, "r": -np.round(s, 6), "id": ids}), sort_keys=[("q", "ascending"), ("r", "ascending"), ("id", "ascending")]).to_numpy()
        begin = np.searchsorted(q[order], np.arange(self.n + 1))
        n = np.diff(begin)
        order = order[np.arange(len(q)) - np.repeat(begin[:-1], n) < self.k]
        q, s = q[order], s[order]
        n = np.minimum(n, self.k)
        full = np.flatnonzero(n == self.k)
        self.least[full] = np.round(s[np.cumsum(n)[full] - 1], 6) - 1e-6
        self.parts, self.held, self.kept = [(q, s, ids.take(pa.array(order)))], len(q), len(q)

    def rows(self) -> tuple[np.ndarray, np.ndarray, pa.Array] | None:
        """(question, score, id) of what is best, question by question."""
        if not self.parts:
            return None
        self._cut()
        return self.parts[0]


def _best(s: np.ndarray, k: int, floor: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Places of the k highest scores above floor of each row, rounded as they are ranked; of equal ones those that come first."""
    if s.shape[1] <= k:
        return np.nonzero(s > floor)
    r = np.where(s > floor, np.round(s, 6), -np.inf)
    least = np.partition(r, -k, 1)[:, -k][:, None]
    above, equal = r > least, (r == least) & (r > -np.inf)
    return np.nonzero(above | equal & (np.cumsum(equal, 1) <= k - above.sum(1, keepdims=True)))


def top(ranked: DataFrame, k: int, by: str = "qid", score: str = "score", tie: str = "chunk_id") -> DataFrame:
    """The k rows of highest score per question with their rank; ties go by the tie column."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(score), tie))
    return ranked.withColumn("rank", rank).filter(F.col("rank") <= k)


def search(questions: DataFrame, chunks: DataFrame, k: int, conf: EngineConf = DEFAULT, stats: tuple[DataFrame, int, float] | None = None) -> DataFrame:
    """(qid, chunk_id, score, rank): the best k chunks (or rows of an index) of each question."""
    return top(scores(questions, chunks, conf, k, stats), k)


def point_scores(pairs: DataFrame, questions: DataFrame, chunks: DataFrame, conf: EngineConf = DEFAULT) -> DataFrame:
    """pairs (qid, chunk_id) with their score, 0 without a shared term. Terms of the pairs alone are joined."""
    docs = keep(chunks)
    weights, avgdl = _weights(questions, docs)
    rows = small(kept(pairs.select("qid", "chunk_id").distinct())).join(docs, "chunk_id").select("qid", "chunk_id", "dl", F.explode(F.arrays_zip("terms", "tfs")).alias("x"))
    tf = F.col("x.tfs")
    w = F.col("idf") * tf * (conf.k1 + 1) / (tf + conf.k1 * (1 - conf.b + conf.b * F.col("dl") / avgdl))
    rows = rows.withColumn("term", F.col("x.terms")).join(weights, ["qid", "term"]).groupBy("qid", "chunk_id").agg(F.round(F.sum(w), 6).alias("score"))
    return pairs.join(rows, ["qid", "chunk_id"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def overlap(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """pairs with the number of different tokens that two texts share."""
    return pairs.withColumn("overlap", F.size(F.array_intersect(tokens(F.col(left)), tokens(F.col(right)))).cast("long"))
