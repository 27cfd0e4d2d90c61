"""Filter audit, periodic runs and token files against plain models, on odd tables too."""

import hashlib
import io
import random
import re
import zlib
from collections import Counter
from itertools import permutations

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from foliospark.llm import filter_audit, runs, token_codes

from test_llm import WORD, docs, empty, odd  # noqa: F401

BPE = public_tokenizers.path("byte_bpe_50k.json")

# --- filter audit


def naive_audit(rows, labels):
    """Applies the filters in every order, one after the other, to all rows (doc_id, text, lang)."""
    good, toxic = ({d for d, *x in labels if x[k] == 1 and d is not None} for k in (0, 1))
    judged = []
    for i, text, lang in rows:
        t = text or ""
        w = WORD.findall(t)
        fails = {f for f, x in zip("ABCDE", (len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), re.search(r"[#$%&*|]", t), i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in rows))) if x}
        judged.append((lang or "", i, fails))
    out = {}
    for part in {p for p, *_ in judged}:
        total = Counter()
        for order in map("".join, permutations("ABCDE")):
            left = [(i, f) for p, i, f in judged if p == part]
            every = list(left)
            for step, name in enumerate(order, 1):
                gone = [(i, f) for i, f in left if name in f]
                left = [(i, f) for i, f in left if name not in f]
                before = sum(1 for i, f in every if name in f) - len(gone)
                total[name] += len(gone)
                out[part, order, step] = [len(left), len(gone), before, sum(f == {name} for _, f in every), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)]
        for (p, order, step), x in out.items():
            if p == part:
                x.append(total[order[step - 1]])
    return {k: tuple(x) for k, x in out.items()}


def test_audit_against_applying_the_filters(spark, sf, docs, odd):  # noqa: F811
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    plain = docs.filter("doc_id % 3 = 0")
    strange = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (1, None, 1), (3, 1, None), (None, 1, 1), (5, 0, 1)], "doc_id long, quality int, toxic int").withColumn("mask", F.lit(1))
    for table, known in ((plain, labels), (odd.withColumn("part", F.lit("x")).withColumn("mask", F.lit(7)), strange)):
        got = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in filter_audit.audit(table, known).collect()}
        assert got == naive_audit([tuple(r) for r in table.select("doc_id", "text", "lang").collect()], [tuple(r) for r in known.select("doc_id", "quality", "toxic").collect()])
    assert filter_audit.audit(empty(spark), labels).count() == 0
    assert filter_audit.audit(plain, labels.limit(0)).agg(F.sum("good_lost")).first()[0] == 0


def test_audit_removal_steps():
    at = filter_audit.steps()
    for k, order in enumerate(filter_audit.ORDERS):
        for mask in range(32):
            assert at[mask, k] == min((order.index(f) for b, f in enumerate("ABCDE") if mask >> b & 1), default=5)


def test_audit_reads_long_texts_in_blocks(monkeypatch):
    text = " ".join(f"word{k % 90}" for k in range(3000)).encode()
    whole = filter_audit.failures(text)
    monkeypatch.setattr(filter_audit, "BLOCK", 50)
    assert filter_audit.failures(text) == whole == 2


# --- periodic runs


def naive_runs(w):
    """All runs by trying every period at every place."""
    found = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i - s >= q and i + q - s >= 12:
                found.setdefault((s, i + q - s), q)
            i = max(i, s + 1)
    return sorted((s, n, q) for (s, n), q in found.items())


def naive_collapse(doc_id, text):
    w = WORD.findall(text or "")
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and w and doc_id is not None:
        a = h // 10 % len(w)
        p = 1 + (len(w) - a) // (3 + h // 10 % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
    found = sorted(naive_runs(w), key=lambda r: (r[0], r[2]))
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    top = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(found), *top, top[1] and 1000 * top[1] // top[2], sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_runs_against_all_periods_of_random_words():
    rng = np.random.default_rng(4)
    for k in range(3000):
        w = rng.integers(0, rng.integers(1, 4), rng.integers(0, 120))
        if k % 2:  # repetitions of repetitions, where occurrences of factors form progressions
            x, w = list(rng.integers(0, 2, rng.integers(1, 6))), []
            for _ in range(rng.integers(1, 6)):
                w += x[: rng.integers(1, len(x) + 1)] * rng.integers(1, 9) + [2] * int(rng.integers(0, 2))
            w = np.array((w * int(rng.integers(1, 4)))[:160])
        got = list(zip(*(a.tolist() for a in runs.find(np.asarray(w, np.int64)))))
        assert sorted(got) == naive_runs(w.tolist()), w.tolist()


def test_runs_whose_periods_form_a_progression():
    """(ab)^5 a (ab)^5 a: two stretches of period 2 side by side make runs of many periods."""
    w = ([0, 1] * 5 + [0]) * 2 + [0, 1]
    got = sorted(zip(*(a.tolist() for a in runs.find(np.array(w, np.int64)))))
    assert got == naive_runs(w) and {q for *_, q in got} == {7, 9, 11}


def test_runs_stay_few_and_quick():
    for w, n in ((np.zeros(1 << 17, np.int64), 1), (np.tile([0, 1, 1], 40_000), 1)):
        start, length, period = runs.find(w)
        assert len(start) == n and length[0] == len(w)


def test_collapse_against_brute_force(spark, docs, odd):  # noqa: F811
    short = docs.filter("length(text) < 6000")
    extra = spark.createDataFrame([(10_000 + k, t) for k, t in enumerate(["a " * 40, "x y z " * 5 + "x", "a b\tc\n" * 4, " ".join("abcdefghijk"), "one " * 11, "é à b " * 9, " ".join(str(k) for k in range(400))] + ["same words in all of these texts, again and again " * 9] * 40)], "doc_id long, text string")
    for table in (short.select("doc_id", "text").union(extra), odd.filter("doc_id is null or doc_id <> 5").withColumn("hash", F.lit("h"))):
        got = Counter(tuple(r) for r in runs.collapse(table).collect())
        assert got == Counter(naive_collapse(r.doc_id, r.text) for r in table.select("doc_id", "text").collect())
    assert runs.collapse(empty(spark)).count() == 0
    long = runs.collapse(odd.filter("doc_id = 5")).first()
    assert long.period == 700 and long.n_runs == 1 and long.length == 60_000


def test_texts_searched_together_do_not_touch():
    texts = [np.array([k % 3 for k in range(n)], np.int64) for n in (0, 30, 1, 13)]
    together = runs._rows(texts, [b"a", b"b", b"c"])
    assert together == [x for t in texts for x in runs._rows([t], [b"a", b"b", b"c"])]


# --- token files


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(BPE)
    t.encode_special_tokens = True
    return t


def test_pieces_encode_as_whole_texts_do(tokenizer, docs):  # noqa: F811
    pieces, r = token_codes.Pieces(BPE), random.Random(5)
    signs = ["a", "B", "é", " ", "  ", "\n", "\n\n", "\t", "'s", "'", " '", "1", "23", "中", "　", ",", ".", "!?", "<|endoftext|>", "\x85", "\x1c", " ", " ", "ñ", "​", "\r", "*", "_", "ª", "Ⅷ", "²", "\x00", "٣", "̈", "ɏ", "×", "\U0001f600", " ", "᠎"]
    even = [s for s in signs if s.strip()] + [" ", "\n", " "] * 4
    texts = ["".join(r.choices(s, k=r.randint(0, 14))) for s in (signs, even) for _ in range(8000)] + [x.text or "" for x in docs.collect()] + ["x" * 9000, "word " * 20_000]
    for t, e in zip(texts, tokenizer.encode_batch(texts, add_special_tokens=False)):
        assert pieces.encode(t).tolist() == [*e.ids, token_codes.END], t


def test_pieces_of_other_tokenizers_are_whole_texts():
    path = public_tokenizers.path("word_bpe_49k.json")
    pieces, whole = token_codes.Pieces(path), Tokenizer.from_file(path)
    assert not pieces.apart
    assert pieces.encode("Some words, in Line\nafter line.").tolist() == [*whole.encode("Some words, in Line\nafter line.", add_special_tokens=False).ids, token_codes.END]


def test_pieces_forget_when_full(tokenizer, monkeypatch):
    monkeypatch.setattr(token_codes, "CACHE", 5)
    pieces, text = token_codes.Pieces(BPE), "many different words, some of them\nagain, some of them not; " * 3
    assert pieces.encode(text).tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, token_codes.END] and len(pieces) <= 5


class Memory:
    """Bytes that tell how many of them were read."""

    def __init__(self, data):
        self.data, self.read = data, 0

    def read_at(self, n, at):
        self.read += n
        return self.data[at : at + n]


def written(docs):  # noqa: F811
    out = io.BytesIO()
    w = token_codes.Writer(out)
    for d in docs:
        w.add(d)
    w.close([pa.array(range(len(docs)), pa.int64())])
    f = Memory(out.getvalue())
    return token_codes.Reader(f, len(f.data)), f


@pytest.mark.parametrize("bits", [1, 7, 8, 9, 16, 24, 32])
def test_codes_give_any_token_and_range(bits, monkeypatch):
    monkeypatch.setattr(token_codes, "SEGMENT", 1000)
    for trial in range(6):
        rng = np.random.default_rng(100 * bits + trial)
        docs = [(2 ** (rng.random(rng.integers(0, 900)) * bits)).astype(np.uint64).clip(0, (1 << bits) - 1).astype("<u4") for _ in range(rng.integers(0, 12))]  # noqa: F811
        flat = np.concatenate(docs) if docs else np.zeros(0, "<u4")
        reader, _ = written(docs)
        assert reader.n == len(flat) and reader.docs["n_tokens"].to_pylist() == [len(d) for d in docs]
        for i in rng.integers(0, max(1, len(flat)), 60 if len(flat) else 0).tolist() + ([0, len(flat) - 1] if len(flat) else []):
            assert reader.token(i) == flat[i]
        for _ in range(40):
            a, b = sorted(rng.integers(0, len(flat) + 1, 2).tolist())
            assert np.array_equal(reader.tokens(a, b), flat[a:b])
        with pytest.raises(IndexError):
            reader.token(len(flat))


def test_a_token_is_read_without_its_block():
    rng = np.random.default_rng(1)
    reader, f = written([rng.integers(0, 50_000, 300_000).astype("<u4")])
    f.read = 0
    reader.token(123_456)
    assert f.read < 300


def test_widths_are_the_cheapest():
    rng = np.random.default_rng(2)
    for most in (3, 6, 9, 15, 20):
        ids = (2 ** (rng.random(4000) * most)).astype("<u4")
        top = -(-int(ids.max()).bit_length() // 4) * 4

        def cost(ws, ids=ids):
            left, out = ids, 0
            for k, w in enumerate(ws):
                out += len(left) * (w + (k < len(ws) - 1) * (1 + 32 / token_codes.RANK_BITS))
                left = left[left >> np.uint32(w) > 0] >> np.uint32(w)
            return out

        def splits(n):
            return [[n]] + [[w, *rest] for w in range(4, n, 4) for rest in splits(n - w)]

        assert cost(token_codes.widths(ids)) == pytest.approx(min(map(cost, splits(top))))


def test_damaged_token_files_are_refused():
    reader, f = written([np.arange(10, dtype="<u4")])
    with pytest.raises(ValueError):
        token_codes.Reader(Memory(f.data[:-1]), len(f.data) - 1)


def naive_tokens(tokenizer, rows):
    """Counter of rows; ids that are equal go by the hash of the text, so they are compared as a set."""
    out, at = [], 0
    for i, _, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, token_codes.END]
        out.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return Counter(out)


def test_token_files_against_a_plain_loop(spark, docs, odd, tokenizer, monkeypatch):  # noqa: F811
    monkeypatch.setattr(token_codes, "PIECE", 1000)
    monkeypatch.setattr(token_codes, "SEGMENT", 5000)
    for table in (docs, odd.withColumn("hash", F.lit("h")).withColumn("nth", F.lit(0)).withColumn("start", F.lit(1))):
        rows = [tuple(r) for r in table.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))), "text").collect()]
        got = Counter(tuple(r) for r in token_codes.round_trip(table.repartition(3), BPE).select("doc_id", "start", "n_tokens", "ids_crc32").collect())
        assert got == naive_tokens(tokenizer, rows)
    assert token_codes.round_trip(empty(spark), BPE).count() == 0
