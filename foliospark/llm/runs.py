"""Periodic runs of words, found by a dictionary of basic factors, and texts with the repetitions taken out.

A run is a stretch of words with smallest period q, of at least max(MIN_RUN, 2q) words, that can't be made longer. For every
power of two the factors of that length are named, equal ones alike, by sorting pairs of names of half the length. A run of
period q holds a factor of length L (the power of two with L <= q < 2L; FIRST for all q below 2 * FIRST) at its start and again q
later. Occurrences of one factor that follow each other within L/2 are an arithmetic progression of the factor's own period p,
and there the word before an occurrence is the same for all of them but the first. A run that begins at i has other words
before i and i + q, so one of the two is the first of its progression: pairing the first occurrences with those less than 2L
away, in both directions, proposes every run, and in number what grows with the words. Proposals are extended by the
dictionary's names, from long factors to short ones; those that begin and end together are one run, of the least period.

Texts are taken together in groups of bounded size with a word of its own between them, so that short ones cost no more.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_RUN = 12
FIRST = 4  # length of the shortest factors that propose: FIRST + q words fit into a run for all q below 2 * FIRST
GROUP_WORDS = 1 << 17  # words of short texts that are searched together
BLOCK = 1 << 20  # bytes of a text that are split into words at a time, words that are joined at a time
_SPACES = b" \t\n\v\f\r"
_OUT = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def _levels(w: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each power of two: it, the name of the factor at each place (-1 if it occurs once), and the places of factors that
    occur more than once with their names, sorted by name and place. Ends when no factor recurs."""
    n, length, at, key = len(w), 1, np.arange(len(w)), w - w.min() if len(w) else w
    while len(at):
        if (int(key.max()) + 1) * n < 1 << 62:
            both = np.sort(key * n + at)
            k = both // n
            place = both - k * n
        else:
            order = np.argsort(key, kind="stable")
            k, place = key[order], at[order]
        new = np.empty(len(k), bool)
        new[0], new[1:] = True, k[1:] != k[:-1]
        more = ~new  # has a predecessor of its kind
        more[:-1] |= ~new[1:]  # or a successor
        place, name = place[more], np.cumsum(new[more]) - 1
        if not len(place):
            return
        names = np.full(n, -1, np.int32)
        names[place] = name
        yield length, names, place, name
        at = np.flatnonzero(names >= 0)
        at = at[at + length < n]
        at = at[names[at + length] >= 0]
        key = names[at].astype(np.int64) * (int(name[-1]) + 1) + names[at + length]
        length *= 2


def _spread(first: np.ndarray, begin: np.ndarray, end: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each of first, repeated beside place[begin:end] of its own."""
    count = end - begin
    step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return np.repeat(first, count), place[np.repeat(begin, count) + step]


def _proposed(w: np.ndarray, length: int, place: np.ndarray, name: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places i < j of one factor, at most 2 * length - 1 apart, with different words before them."""
    key = name.astype(np.int64) * (3 * len(w) + 3) + place
    leads = np.ones(len(place), bool)
    leads[1:] = (name[1:] != name[:-1]) | (2 * (place[1:] - place[:-1]) > length)
    first, at = place[leads], key[leads]
    least = 1 if length == FIRST else length
    i, j = _spread(first, np.searchsorted(key, at + least), np.searchsorted(key, at + 2 * length), place)
    l, k = _spread(first, np.searchsorted(key, at - 2 * length + 1), np.searchsorted(key, at - least + 1), place)
    i, j = np.concatenate([i, k]), np.concatenate([j, l])
    begins = (i == 0) | (w[i - 1] != w[j - 1])
    return i[begins], j[begins]


def find(w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs in the words w (numbers, int64; unique ones part texts), by start, length and period."""
    named, pairs = [], []
    for length, names, place, name in _levels(w):
        named.append((length, names))
        if length >= FIRST:
            pairs.append(_proposed(w, length, place, name))
    if not pairs:
        return (np.zeros(0, np.int64),) * 3
    i, j = (np.concatenate(x) for x in zip(*pairs))
    more = np.zeros(len(i), np.int64)
    for length, names in reversed(named):
        y = j + more
        inside = y < len(w)
        there = names[np.where(inside, y, 0)]
        more += length * (inside & (there >= 0) & (names[i + more] == there))
    q, total = j - i, j - i + more
    long = (more >= q) & (total >= MIN_RUN)
    i, total, q = i[long], total[long], q[long]
    order = np.lexsort((q, total, i))
    i, total, q = i[order], total[order], q[order]
    new = np.ones(len(i), bool)
    new[1:] = (i[1:] != i[:-1]) | (total[1:] != total[:-1])
    return i[new], total[new], q[new]


def _word_numbers(data: bytes, number: dict[bytes, int]) -> np.ndarray:
    """The words of data as numbers, made block by block."""
    parts, at = [], 0
    while at < len(data):
        to = min(len(data), at + BLOCK)
        while to < len(data) and data[to] not in _SPACES:
            to += 1
        parts.append(np.array(list(map(number.__getitem__, data[at:to].split())), np.int64))
        at = to
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def plant(w: np.ndarray, h: int) -> np.ndarray:
    """The words, with the end of one in ten texts (by h, the CRC-32 of its id) made periodic."""
    n, g = len(w), h // 10
    if h % 10 or not n:
        return w
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return np.concatenate([w[:a], w[a + np.arange(n - a) % p]])


def _digests(w: np.ndarray, names: list[bytes], start: np.ndarray, length: np.ndarray, period: np.ndarray) -> tuple[str, str]:
    """SHA-256 of the list of runs, and of the words that no run repeats, joined by spaces."""
    runs = "".join(f"{s},{n},{q}\n" for s, n, q in zip(start.tolist(), length.tolist(), period.tolist()))
    if len(start):
        edge = np.zeros(len(w) + 1, np.int64)
        np.add.at(edge, start + period, 1)
        np.add.at(edge, start + length, -1)
        w = w[np.cumsum(edge[:-1]) == 0]
    text = hashlib.sha256()
    for k in range(0, len(w), BLOCK):
        text.update(b" " * (k > 0) + b" ".join(map(names.__getitem__, w[k : k + BLOCK].tolist())))
    return hashlib.sha256(runs.encode()).hexdigest(), text.hexdigest()


def _rows(texts: list[np.ndarray], names: list[bytes]) -> list[tuple]:
    """A row of results for each text, all searched together."""
    ends = np.cumsum([len(t) + 1 for t in texts])
    joined = np.concatenate([x for k, t in enumerate(texts) for x in (t, [-1 - k])]).astype(np.int64)
    start, length, period = find(joined)
    at = np.searchsorted(ends, start, side="right")
    cuts, out = np.searchsorted(at, np.arange(len(texts) + 1)), []
    for k, t in enumerate(texts):
        a, b = cuts[k], cuts[k + 1]
        s, n, q = start[a:b] - (ends[k] - len(t) - 1), length[a:b], period[a:b]
        order = np.lexsort((q, s))
        s, n, q = s[order], n[order], q[order]
        best = np.lexsort((q, s, -n))[:1]
        top = (int(s[best[0]]), int(n[best[0]]), int(q[best[0]]), int(1000 * n[best[0]] // q[best[0]])) if len(best) else (None,) * 4
        out.append((b - a, *top, *_digests(t, names, s, n, q)))
    return out


def _searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts, hashes, begin = b.column("text").cast(pa.large_binary()), b.column("hash").to_pylist(), 0
        group, number, n = [], defaultdict(), 0
        number.default_factory = number.__len__
        for k in range(b.num_rows):
            words = _word_numbers(texts[k].as_py() or b"", number)
            group.append(words if hashes[k] is None else plant(words, hashes[k]))
            n += len(words)
            if n >= GROUP_WORDS or k == b.num_rows - 1:
                found = list(zip(*_rows(group, list(number))))
                kinds = [pa.int64()] * 5 + [pa.string()] * 2
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(begin, len(group)), *(pa.array(x, t) for x, t in zip(found, kinds))], ["doc_id", *(x.split()[0] for x in _OUT.split(", "))])
                group, n, begin = [], 0, k + 1
                number.clear()


def collapse(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, n_runs; start, length, period, exponent_milli of the longest run (ties: least start, then period;
    null without runs); runs_sha256 of all runs and collapsed_sha256 of the words that are left.

    One in ten texts, by the CRC-32 of its id in decimal, is made periodic at its end first. Words that a run holds after its
    first period are dropped. A null text has no words; a row without an id is not made periodic. Repeated rows give equal
    results. Texts are searched whole, however long: a task holds one text, or a group of short ones, as numbers. An empty table
    gives an empty result. Other columns are ignored.
    """
    rows = docs.select("doc_id", "text", F.crc32(F.col("doc_id").cast("string")).alias("hash"))
    return rows.mapInArrow(_searched, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {_OUT}")
