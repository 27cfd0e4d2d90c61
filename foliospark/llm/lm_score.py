"""Language-model scores from a log-frequency Bloom filter.

Counts of words and word pairs of the training documents are quantised on a log scale; an n-gram of level q is entered
into a Bloom filter q times, as (n-gram, 1) to (n-gram, q). A count is read back by probing level after level until one
is missing, and probabilities are smoothed from the counts so read. Every n-gram is held, those seen once too: the filter
is cut into segments by n-gram, its size and the number of its segments grow with the corpus, and a segment has
BITS_PER_ENTRY bits for each of its entries, so the rate of false probes is the same at every size.

A filter that is proven to have at most BROADCAST_BYTES is broadcast to where documents are scored. A larger one stays
where it was built: probes travel to the segments, and the levels found travel back. Both ways read the same bits, so
scores are the same. What travels is packed: a chunk of some million tokens asks a segment once, for each of its different
n-grams, with 32 bits each, as steps from one to the next in order. A frequent n-gram therefore costs one number a chunk, however many documents hold it.

Texts are split into words once. The chunks of word numbers are written to the checkpoint folder and everything after
reads them from there, so lost executors change nothing.

The exact base score needs exact counts of all words; they come back from the segments with the levels. Words are told
apart by 64-bit hashes, pairs by 32 bits within their segment (a false count in about 1 of 4,000 pairs, fewer than the filter
itself errs on: PROBES probes with BITS_PER_ENTRY bits an entry make 0.7 % of absent entries look present).
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_of_id, cut

FOLDS, HELD_OUT = 7, 2
BROADCAST_BYTES = 16 << 20  # of a filter that is broadcast; beyond, probes travel to the segments
SEGMENT_TEXT = 16 << 20  # bytes of text for which there is a segment; a task holds one, in some ten times that memory
PROBES, BITS_PER_ENTRY = 4, 12
EXACT_COUNTS, LOG_BASE = 10, 1.1  # levels up to EXACT_COUNTS are counts, a further one stands for LOG_BASE times as much
MASS = 4.0  # weight of a word's own share in a pair's, in counts
CHUNK = 1_000_000  # tokens that are worked on at a time; a document is never divided
MOST_TASKS = 50_000  # that segments or chunks are dealt to
END, START = 0xFFFFFFFFFFFFFFFF, 0xFFFFFFFFFFFFFFFE  # keys of the end token and of what stands before the first word

CHUNK_ROW = "ends binary, held binary, words binary, tokens binary"
PROBE_ROW = "seg int, chunk long, pairs binary, pair_n binary, words binary, word_n binary"
ANSWER_ROW = "seg int, chunk long, pair_levels binary, word_levels binary, word_counts binary, bits binary, n long, distinct long"


class _Numbers(dict):
    """Words numbered as they come."""

    def __missing__(self, w: bytes) -> int:
        self[w] = k = len(self)
        return k


def _mix(a: np.ndarray, b: np.ndarray | int) -> np.ndarray:
    """A 64-bit hash of two numbers, one to one in the first."""
    with np.errstate(over="ignore"):
        x = a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.asarray(b).astype(np.uint64)
        for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
        return x ^ (x >> np.uint64(31))


def _pack(numbers: np.ndarray) -> bytes:
    """Numbers of some type, mostly small, compressed byte plane by byte plane."""
    return zlib.compress(np.ascontiguousarray(numbers.view(np.uint8).reshape(-1, numbers.itemsize).T).tobytes(), 1)


def _unpack(data: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def _pack_steps(ascending: np.ndarray) -> bytes:
    return _pack(np.diff(ascending, prepend=ascending.dtype.type(0)))


def _unpack_steps(data: bytes, kind: type) -> np.ndarray:
    return np.cumsum(_unpack(data, kind), dtype=kind)


def _chunks(batches: Iterator[pa.RecordBatch], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, held_out, text) to chunks of them with about CHUNK tokens: words are the keys of a chunk's different
    words (the end token first), tokens their numbers in order, ends where texts end."""
    fields = pa.schema([("ids", pa.list_(kind)), *((c, pa.binary()) for c in ("ends", "held", "words", "tokens"))])
    for rb in batches:
        ids, texts, held = rb.column(0), rb.column(2).to_pylist(), np.array(rb.column(1).to_pylist(), bool)
        numbers, parts, at, load = _Numbers({None: 0}), [], 0, 0
        for k, text in enumerate(texts):
            w = (text or "").encode("utf-8", "surrogatepass").lower().split()
            part = np.zeros(len(w) + 1, np.uint32)
            part[:-1] = np.fromiter(map(numbers.__getitem__, w), np.uint32, len(w))
            parts.append(part)
            load += len(part)
            if load >= CHUNK or k == len(texts) - 1:
                words = np.array([END, *(min(xxhash.xxh64_intdigest(w, 11), START - 1) for w in list(numbers)[1:])], np.uint64)
                ends = np.cumsum([len(p) for p in parts], dtype=np.int64)
                own = pa.ListArray.from_arrays(pa.array([0, k + 1 - at], pa.int32()), ids.slice(at, k + 1 - at))
                yield pa.RecordBatch.from_arrays([own, *(pa.array([x], pa.binary()) for x in (ends.tobytes(), held[at : k + 1].tobytes(), words.tobytes(), _pack(np.concatenate(parts))))], schema=fields)
                numbers, parts, at, load = _Numbers({None: 0}), [], k + 1, 0


class _Grams:
    """The n-grams of a chunk in the order in which it asks for them: by segment, and by their bits within it."""

    def __init__(self, row: dict, n_seg: int):
        self.words, self.tokens = np.frombuffer(row["words"], np.uint64), _unpack(row["tokens"], np.uint32).astype(np.int32)
        self.ends, self.held = np.frombuffer(row["ends"], np.int64), np.frombuffer(row["held"], bool)
        self.starts = self.ends - np.diff(self.ends, prepend=0)
        self.before = np.empty_like(self.tokens)
        self.before[1:] = self.tokens[:-1]
        self.before[self.starts] = len(self.words)  # START
        context = _mix(np.append(self.words, np.uint64(START)), 2)
        self.pairs, self.pair_of = np.unique(_place(_mix(context[self.before], self.words[self.tokens]), n_seg), return_inverse=True)
        mixed = _word_keys(self.words)
        self.order = np.argsort(mixed)
        self.mixed = mixed[self.order]

    def trained(self) -> tuple[np.ndarray, np.ndarray]:
        """How often each pair and each word stands in training texts of the chunk."""
        learnt = np.repeat(~self.held, np.diff(self.ends, prepend=0)).astype(float)
        pairs, words = np.bincount(self.pair_of, learnt, len(self.pairs)), np.bincount(self.tokens, learnt, len(self.words))
        return pairs.astype(np.uint32), words[self.order].astype(np.uint32)


def _word_keys(words: np.ndarray) -> np.ndarray:
    return _mix(words, 1)


def _place(key: np.ndarray, n_seg: int) -> np.ndarray:
    """The segment of each n-gram in the upper, its bits there in the lower half."""
    low = np.uint64(0xFFFFFFFF)
    return (_segment(key, n_seg) << np.uint64(32)) | (key & low)


def _segment(key: np.ndarray, n_seg: int) -> np.ndarray:
    return ((key >> np.uint64(32)) * np.uint64(n_seg)) >> np.uint64(32)


def level(count: np.ndarray) -> np.ndarray:
    """Levels of counts: 0 of 0, the count up to EXACT_COUNTS, then on a log scale."""
    up = np.log(np.maximum(count, EXACT_COUNTS) / EXACT_COUNTS) / np.log(LOG_BASE)
    return np.minimum(count, EXACT_COUNTS).astype(np.int64) + np.floor(up + 1e-9).astype(np.int64)


def count_of(lev: np.ndarray) -> np.ndarray:
    """The middle of the counts of a level; 0 for level 0."""
    lev = np.asarray(lev, np.int64)
    low = EXACT_COUNTS * LOG_BASE ** np.maximum(lev - EXACT_COUNTS, 0.0)
    first, last = np.ceil(low - 1e-6), np.ceil(low * LOG_BASE - 1e-6) - 1
    return np.where(lev < EXACT_COUNTS, lev, (first + np.maximum(first, last)) / 2)


def _bits_at(key: np.ndarray, lev: np.ndarray | int, bits: int) -> list[np.ndarray]:
    """The bits of (n-gram, level), by double hashing."""
    x = _mix(key, np.asarray(lev) + 1000)
    a, b, low = x & np.uint64(0xFFFFFFFF), (x >> np.uint64(32)) | np.uint64(1), np.uint64(0xFFFFFFFF)
    return [((((a + np.uint64(i) * b) & low) * np.uint64(bits)) >> np.uint64(32)).astype(np.int64) for i in range(PROBES)]


def build(key: np.ndarray, lev: np.ndarray) -> np.ndarray:
    """A segment's filter as bytes: n-grams (64-bit keys) with their levels, all of them."""
    entries = int(lev.sum())
    held = np.zeros(-(-max(64, entries * BITS_PER_ENTRY) // 8) * 8, bool)
    for lo in range(0, len(key), 500_000):  # so many n-grams at a time
        k, n = key[lo : lo + 500_000], lev[lo : lo + 500_000]
        every = np.repeat(k, n)
        nth = np.arange(len(every)) - np.repeat(np.cumsum(n) - n, n) + 1
        for p in _bits_at(every, nth, len(held)):
            held[p] = True
    return np.packbits(held)


def probe(held: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Level of each n-gram: how many levels in a row the filter has."""
    lev, live, at, bits = np.zeros(len(key), np.uint16), np.arange(len(key)), 0, len(held) * 8
    while len(live) and at < 1000:
        at += 1
        has = np.ones(len(live), bool)
        for p in _bits_at(key[live], at, bits):
            has &= (held[p >> 3] >> (7 - (p & 7)).astype(np.uint8)) & 1 == 1
        live = live[has]
        lev[live] = at
    return lev


def _pair_keys(bits: np.ndarray) -> np.ndarray:
    """Filter keys of pairs from their 32 bits."""
    return bits.astype(np.uint64) | np.uint64(1 << 40)


def _ask(n_seg: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Chunks to what they ask each segment: different pairs and words, with their counts in training texts."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            for row in rb.to_pylist():
                g = _Grams(row, n_seg)
                pair_n, word_n = g.trained()
                pair_seg, word_seg = (g.pairs >> np.uint64(32)).astype(np.int64), _segment(g.mixed, n_seg).astype(np.int64)
                bits = g.pairs.astype(np.uint32)
                asked = np.union1d(pair_seg, word_seg)
                cols = {"pairs": [], "pair_n": [], "words": [], "word_n": []}
                for (a, b), (c, d) in zip(_runs(pair_seg, asked), _runs(word_seg, asked)):
                    for name, x, packed in (("pairs", bits[a:b], _pack_steps), ("pair_n", pair_n[a:b], _pack), ("words", g.mixed[c:d], _pack_steps), ("word_n", word_n[c:d], _pack)):
                        cols[name].append(packed(x))
                yield pa.RecordBatch.from_arrays([pa.array(asked, pa.int32()), pa.array([row["chunk"]] * len(asked), pa.int64()), *(pa.array(x, pa.binary()) for x in cols.values())], names=["seg", "chunk", *cols])

    return ask


def _runs(sorted_by: np.ndarray, values: np.ndarray) -> Iterator[tuple[int, int]]:
    """Where each of the values begins and ends in a sorted array."""
    return zip(np.searchsorted(sorted_by, values).tolist(), np.searchsorted(sorted_by, values, "right").tolist())


def _counted(parts: list[bytes], counts: list[bytes], kind: type) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Different keys of all parts, their summed counts, and for each part its keys as places among them."""
    asked = [_unpack_steps(p, kind) for p in parts]
    key, at = np.unique(np.concatenate(asked), return_inverse=True)
    n = np.bincount(at, np.concatenate([_unpack(c, np.uint32) for c in counts]), len(key)).astype(np.int64)
    return key, n, np.split(at, np.cumsum([len(a) for a in asked])[:-1])


def _answer(broadcast: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What is asked of segments, sorted by segment, to answers: levels of pairs and words (if the filter isn't broadcast)
    and exact counts of words, in the order asked. A further row without a chunk has the segment's sums, and its bits if
    they are broadcast. A task holds one segment, which is a fixed share of the corpus."""

    def of_segment(seg: int, rows: list[dict]) -> pa.RecordBatch:
        pairs, pair_n, pair_at = _counted([r["pairs"] for r in rows], [r["pair_n"] for r in rows], np.uint32)
        words, word_n, word_at = _counted([r["words"] for r in rows], [r["word_n"] for r in rows], np.uint64)
        keys = np.concatenate([_pair_keys(pairs), words])
        held = build(keys, level(np.concatenate([pair_n, word_n])))
        out = {"chunk": [None], "pair_levels": [None], "word_levels": [None], "word_counts": [None], "bits": [held.tobytes() if broadcast else None], "n": [int(word_n.sum())], "distinct": [int((word_n > 0).sum())]}
        levels = None if broadcast else probe(held, keys)
        for r, p, w in zip(rows, pair_at, word_at):
            found = (None, None) if broadcast else (_pack(levels[p]), _pack(levels[len(pairs) + w]))
            for name, x in zip(out, (r["chunk"], *found, _pack(word_n[w]), None, None, None)):
                out[name].append(x)
        kinds = [pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array([seg] * len(out["chunk"]), pa.int32()), *(pa.array(x, t) for x, t in zip(out.values(), kinds))], names=["seg", *out])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seg, rows = None, []
        for rb in batches:
            for r in rb.to_pylist():
                if r["seg"] != seg and rows:
                    yield of_segment(seg, rows)
                    rows = []
                seg = r["seg"]
                rows.append(r)
        if rows:
            yield of_segment(seg, rows)

    return answer


def score(docs: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    score is the sum over tokens w after v of log10((c(v, w) + MASS * p(w)) / (c(v) + MASS)), p(w) = (c(w) + 1) / (N + V + 1),
    with counts c as the filter has them; before the first word stands a start mark, which is as frequent as the end. After
    every context the probabilities sum to 1 but for what quantising and false probes do to counts, a few percent.

    Null and empty texts are an end token alone. Repeated rows get equal scores, and count as often in training as they
    occur. Null ids count as crc32 0, so they are trained on. An empty table gives an empty result; texts are read whole.
    Other columns are ignored. broadcast_bytes decides how the filter is read, not what it holds.
    """
    spark = docs.sparkSession
    held_out = F.pmod(crc_of_id(), F.lit(FOLDS)) == HELD_OUT
    rows = docs.select("doc_id", held_out.alias("held_out"), F.col("text").cast("string"))
    n_bytes, n_rows = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("*")).first()
    n_seg = max(1, -(-n_bytes // SEGMENT_TEXT))
    # a token has two bytes of text, or ends one; it makes a word's entry and a pair's at most
    broadcast = 2 * (n_bytes // 2 + n_rows) * BITS_PER_ENTRY // 8 + 16 * n_seg <= broadcast_bytes
    kind = dict(docs.dtypes)["doc_id"]
    arrow_kind = pa.string() if kind == "string" else pa.int32() if kind == "int" else pa.int64()
    chunks = cut(rows.mapInArrow(lambda b: _chunks(b, arrow_kind), f"ids array<{kind}>, {CHUNK_ROW}"))
    chunks = chunks.withColumn("chunk", F.monotonically_increasing_id())  # of written rows: the same each time
    tasks = min(n_seg, MOST_TASKS)
    asked = chunks.drop("ids").mapInArrow(_ask(n_seg), PROBE_ROW)
    asked = asked.repartitionById(tasks, (F.col("seg") * F.lit(tasks).cast("long") / F.lit(n_seg)).cast("int")).sortWithinPartitions("seg", "chunk")
    answers = cut(asked.mapInArrow(_answer(broadcast), ANSWER_ROW))
    total, distinct = answers.filter("chunk is null").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("distinct"), F.lit(0))).first()
    held = None
    if broadcast:  # at most broadcast_bytes
        held = spark.sparkContext.broadcast({r["seg"]: r["bits"] for r in answers.filter("bits is not null").select("seg", "bits").collect()})

    def rate(left: pa.Table, right: pa.Table) -> pa.Table:
        g, found = _Grams(left.to_pylist()[0], n_seg), sorted(right.to_pylist(), key=lambda r: r["seg"])
        joined = lambda name, kind: np.concatenate([_unpack(r[name], kind) for r in found])
        exact = np.empty(len(g.words), np.int64)
        exact[g.order] = joined("word_counts", np.int64)
        if held is None:
            pair_levels, word_levels = joined("pair_levels", np.uint16), joined("word_levels", np.uint16)
        else:
            filters = {s: np.frombuffer(b, np.uint8) for s, b in held.value.items()}
            pair_levels, word_levels = _probe_all(filters, g.pairs >> np.uint64(32), _pair_keys(g.pairs.astype(np.uint32))), _probe_all(filters, _segment(g.mixed, n_seg), g.mixed)
        c1 = np.empty(len(g.words) + 1)
        c1[g.order] = count_of(word_levels)
        c1[-1] = c1[0]  # as many texts begin as end
        own = (c1 + 1) / (total + distinct + 1)
        p = (count_of(pair_levels)[g.pair_of] + MASS * own[g.tokens]) / (c1[g.before] + MASS)
        base = np.log10((exact + 1) / (total + distinct + 1))
        add = lambda v: np.add.reduceat(v, g.starts)
        ids = left.column("ids").combine_chunks().flatten()
        return pa.table([ids, pa.array(g.held), pa.array(np.diff(g.ends, prepend=0)), pa.array(add((exact > 0)[g.tokens].astype(np.int64))), pa.array(add(base[g.tokens])), pa.array(add(np.log10(p)))], names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    pieces = min(MOST_TASKS, max(1, -(-n_bytes // SEGMENT_TEXT), spark.sparkContext.defaultParallelism))
    left, right = chunks.repartition(pieces, "chunk"), answers.filter("chunk is not null").drop("bits", "n", "distinct").repartition(pieces, "chunk")
    rated = left.groupBy("chunk").cogroup(right.groupBy("chunk")).applyInArrow(rate, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return rated.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(int(total)).cast("long").alias("train_tokens"), "base_score", "score")


def _probe_all(filters: dict[int, np.ndarray], seg: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Levels of n-grams that are sorted by segment."""
    out = np.zeros(len(key), np.uint16)
    values = np.unique(seg)
    for s, (a, b) in zip(values.tolist(), _runs(seg, values)):
        out[a:b] = probe(filters[s], key[a:b])
    return out
