"""The training-data operators against brute force, round trips and held-out labels, and on odd tables."""

import base64
import hashlib
import io
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from foliospark.llm import decontaminate, html_extract, lm_score, mixing, quality_gam, quality_rules, queries, sharding, simhash, url_filter, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, key string, seed long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark, sf):
    yield (table := spark.read.parquet(f"{sf}/documents.parquet").cache())
    table.unpersist()


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and columns named like inner ones."""
    long = " ".join(f"w{k % 700}" for k in range(60_000))
    rows = [(1, "same text here now", "en", "a"), (1, "same text here now", "en", "a"), (2, "same text here now", "en", "b"), (3, "", "en", "a"), (4, None, None, None), (None, "no id at all here", "en", "a"), (None, None, None, None), (5, long, "en", None), (6, " \t\n ", "de", "b")]
    return spark.createDataFrame([(*r, 0, 0.5, "k", 9) for r in rows], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def naive_fingerprint(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)] * bool(w)
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def naive_components(pairs):
    """(id, fingerprint) to the smallest id reachable, by comparing all."""
    fps = sorted({f for _, f in pairs})
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if (a ^ b).bit_count() <= 2:
                root[max(find(a), find(b))] = min(find(a), find(b))
    low = {}
    for i, f in pairs:
        if i is not None:
            low[find(f)] = min(i, low.get(find(f), i))
    return {(i, f): low.get(find(f)) for i, f in pairs}


def test_simhash_against_brute_force(spark, docs, odd):
    for table in (docs, odd):
        rows = table.select("doc_id", "text").collect()
        want = naive_components([(r.doc_id, naive_fingerprint(r.text)) for r in rows])
        got = simhash.near_duplicates(table).collect()
        assert len(got) == len(rows)
        assert {((r.doc_id, int(r.fingerprint, 16)), r.component_id) for r in got} == set(want.items())
    assert simhash.near_duplicates(empty(spark)).count() == 0


def test_simhash_splits_full_tries(spark, monkeypatch):
    monkeypatch.setattr(simhash, "MAX_TRIE", 4)
    rng = np.random.default_rng(3)
    fps = {int(x) for x in rng.integers(0, 1 << 62, 40)}
    for f in list(fps)[:8]:
        for _ in range(30):
            a, b = rng.integers(0, 63, 2)
            f ^= (1 << int(a)) ^ (1 << int(b))
            fps.add(f)
    table = spark.createDataFrame([(f,) for f in sorted(fps)], "fp long")
    labels = {r["id"]: r["root"] for r in simhash.components(simhash.link_fingerprints(table)).collect()}
    want = naive_components([(f, f) for f in fps])
    assert all(labels.get(f, f) == want[f, f] for f in fps)


def test_keep_one(spark, odd):
    assert sorted(str(r.doc_id) for r in simhash.keep_one(odd).collect()) == ["1", "3", "5", "None"]


def test_classifier_held_out(spark, sf, docs, odd):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = quality_gam.classify(docs, labels)
    known = got.join(labels, "doc_id").filter("held_out").toPandas()
    assert (known.predicted == known.quality).mean() > 0.85
    r = got.first()
    assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    out = quality_gam.classify(odd, labels).collect()
    assert len(out) == 9 and all(0 <= r.score <= 1 for r in out)
    none = labels.limit(0)
    assert {r.score for r in quality_gam.classify(odd, none).collect()} == {0.5}
    assert quality_gam.classify(empty(spark), none).count() == 0
    assert set(quality_gam.keep_good(odd, labels).columns) == set(odd.columns)


def test_classifier_counts_every_word():
    top = quality_gam.FEATURES.index("top_word")
    for text in (" ".join(["x%d" % k for k in range(20)] + ["same"] * 10), "a b " * 40 + "c d e " * 200 + "z " * 300, "", None):
        w = (text or "").split()
        assert quality_gam.features(text)[top] == max(Counter(w).values(), default=0) / max(1, len(w))


def test_decontamination(spark, odd):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    swapped = item.replace("delta", "DIFFERENT").replace("kappa", "other")
    rows = [(1, f"before {item} after"), (2, f"x {swapped} y"), (3, "alpha beta gamma delta and nothing more of it here"), (4, None), (None, item), (5, item.upper().replace(" ", "\n"))]
    bench = spark.createDataFrame([(7, item), (8, None), (9, "too short"), (7, item)], "item_id long, text string")
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = decontaminate.leaks(table, bench).collect()
    assert sorted((str(r.doc_id), r.item_id) for r in got) == [("1", 7), ("2", 7), ("5", 7), ("None", 7)]
    assert {r.matched for r in got if r.doc_id == 2} == {10}
    assert sorted(r.doc_id for r in decontaminate.without_leaks(table, bench).collect()) == [3, 4]
    assert decontaminate.leaks(odd, bench).count() == 0 and decontaminate.leaks(empty(spark), bench).count() == 0
    assert decontaminate.without_leaks(odd, bench.limit(0)).count() == 9


def test_decontamination_finds_all_copies(spark, sf, docs):
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    want = {(d.doc_id, b.item_id) for d in docs.collect() for b in bench.collect() if b.text in d.text}
    assert want <= {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, bench).collect()}


def test_mixing(spark, docs, odd):
    got = mixing.mix(docs).toPandas()
    again = mixing.mix(docs.repartition(7)).toPandas()
    assert sorted(zip(got.doc_id, got.taken)) == sorted(zip(again.doc_id, again.taken))
    assert math.isclose(got.groupby("source").target.first().sum(), 1.5 * got["size"].sum(), rel_tol=1e-9)
    assert (got.taken <= 2 * got["size"]).all()
    by = got.groupby("source").agg({"taken": "sum", "target": "first", "size": "max"})
    assert ((by.taken - by.target).abs() <= by["size"] + 1).all()
    out = mixing.mix(odd).collect()
    assert len(out) == 9 and all(r.taken == 0 for r in out if r.size == 0)
    assert mixing.mix(empty(spark)).count() == 0
    n = mixing.mix(odd).agg(F.sum("copies")).first()[0]
    assert mixing.repeat(odd).count() == n and mixing.repeat(odd).columns == odd.columns


def test_targets_share_the_excess(spark):
    rows = spark.createDataFrame([("a", 10), ("b", 100), (None, 100)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(rows).collect()}
    assert got["a"] == 20.0 and math.isclose(got["b"], (315 - 20) / 3) and math.isclose(got[None], min(200, (315 - 20) * 2 / 3))


def test_sharding(spark, docs, odd):
    for table, tight in ((docs, True), (odd, False)):
        got = sharding.assign(table).toPandas()
        assert len(got) == table.count()
        for _, part in got.groupby("shard"):
            assert sorted(part.slot) == list(range(len(part)))
        assert got.groupby(["text_crc32", "size"]).shard.nunique().max() == 1
        if tight:
            loads = got.groupby("shard")["size"].sum()
            assert loads.max() - loads.min() <= got.groupby(["text_crc32", "size"])["size"].sum().max()
    assert sharding.assign(empty(spark)).count() == 0


def naive_rules(text):
    w, seen = WORD.findall(text or ""), {}
    for i in range(len(w) - 2):
        seen.setdefault(tuple(w[i : i + 3]), []).append(i)
    covered = {j for v in seen.values() if len(v) > 1 for i in v for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_quality_rules(spark, docs, odd):
    for table in (docs, odd):
        got = sorted(tuple(map(str, r)) for r in quality_rules.judge(table).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect())
        assert got == sorted(tuple(map(str, (r.doc_id, *naive_rules(r.text)))) for r in table.select("doc_id", "text").collect())
    assert quality_rules.judge(empty(spark)).count() == 0


def test_quality_rules_keep_clean_text(spark, sf, docs):
    good = spark.read.parquet(f"{sf}/labels.parquet").filter("quality = 1")
    got = quality_rules.judge(docs).join(good, "doc_id").filter("not base_failed")
    assert got.filter("not kept").count() == 0


def test_quality_rules_judge_texts_without_common_words(spark):
    rng = np.random.default_rng(4)
    common, syllables = ["the", "of", "and", "to", "in", "is", "it", "for"], ["ba", "ku", "mi", "ro", "se", "ta", "lo", "ne"]
    other = lambda: "".join(rng.choice(syllables, 5))
    normal = lambda n: " ".join(str(rng.choice(common)) if rng.random() < 0.4 else other() for _ in range(n))
    rows = [(k, normal(400), "en") for k in range(60)] + [(100, " ".join(other() for _ in range(5000)), "en"), (101, " ".join(other() for _ in range(60)), "en")]
    got = {r.doc_id: r for r in quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert not got[100].base_failed and not got[100].kept and math.isclose(got[100].word_distance, 1, abs_tol=0.02)
    assert got[101].kept and got[101].word_distance is None
    assert all(got[k].kept and got[k].word_distance < 0.5 for k in range(60))


def test_warc_round_trip(spark, sf):
    rows = [(1, "http://a/", "x"), (2, "u\r\nEvil: 1", "x"), (3, None, None), (4, "http://b/", ""), (None, "n", "é" * 300_000), (2, "again", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = warc.round_trip(pages).collect()
    assert len(got) == 6 and all(r.valid for r in got)
    kinds = sorted((str(r.page_id), r.record_type, str(r.refers_to), r.payload_bytes) for r in got)
    assert kinds == [("1", "revisit", "2", 1), ("2", "response", "None", 1), ("2", "response", "None", 1), ("3", "revisit", "4", 0), ("4", "response", "None", 0), ("None", "response", "None", 600_000)]
    assert {r.payload_digest for r in got if r.payload_bytes == 1} == {base64.b32encode(hashlib.sha1(b"x").digest()).decode()}
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_warc_ids_of_any_size(spark):
    big = 2**53 + 1
    pages = spark.createDataFrame([(big, "u", "x"), (big - 1, "v", "x"), (None, "w", "y"), (-7, None, "z")], "page_id long, url string, html string")
    odd_names = pages.withColumns({c: F.lit(1) for c in ("sha", "owner", "refers_to", "n", "payload_bytes", "valid", "path")})
    for table in (pages, odd_names):
        assert sorted((str(r.page_id), r.refers_to) for r in warc.round_trip(table).collect()) == sorted([(str(big), None), (str(big - 1), big), ("None", None), ("-7", None)])


def test_warc_reader_rejects_damage():
    good = warc.record(1, "u", b"payload", None)
    assert [r["valid"] for r in warc.records(io.BytesIO(good * 2).read)] == [True, True]
    with pytest.raises(ValueError):
        list(warc.records(io.BytesIO(good[:-12]).read))
    plain = zlib.decompress(good, 31).replace(b"payload", b"pAyload")
    z = zlib.compressobj(3, zlib.DEFLATED, 31)
    assert [r["valid"] for r in warc.records(io.BytesIO(z.compress(plain) + z.flush()).read)] == [False]


def test_url_filter(spark):
    urls = ["http://EXAMPLE.org/es/1", "http://a.example.org/en/12?x", "https://x.org", "http://x.org/", "ftp://q.com/de/", "http://q.com/fr/?a", "http://notorg/", "http://e.net/x.org/", None, "no scheme", "http://casino.net/", "http://www.free-bets.example.net/a", "http://" + "é" * 5000 + ".org/"]
    got = [(r.rule, r.verdict) for r in url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).orderBy("page_id").collect()]
    assert got[:8] == [("example.org/es/", "block"), ("example.org/en/1", "block"), (None, "allow"), ("org/", "allow"), ("com/de/", "block"), ("com/fr/", "allow"), (None, "allow"), (None, "allow")]
    assert got[8:] == [(None, "allow"), (None, "allow"), (None, "block"), (None, "block"), ("org/", "allow")]


def test_url_filter_on_odd_tables(spark):
    rows = [(1, "http://x.org/"), (1, "http://x.org/"), (None, None), (3, "http://a.com/de/" + "y" * 50_000), (4, "http://a.com/de")]
    table = spark.createDataFrame(rows, "page_id long, url string").withColumns({c: F.lit(7) for c in ("host", "path", "rule", "verdict", "__d")})
    got = sorted(map(str, ((r.page_id, r.rule, r.verdict, len(r.path)) for r in url_filter.judge(table).collect())))
    assert got == sorted(map(str, [(1, "org/", "allow", 1), (1, "org/", "allow", 1), (None, None, "allow", 0), (3, "com/de/", "block", 50_004), (4, None, "allow", 3)]))
    assert url_filter.judge(table.limit(0)).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_as_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("pages", "documents", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = queries.QUERIES[name](spark, sf)
    want = con.sql(queries.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(str, (tuple(r[c] for c in want.columns) for r in got.collect()))) == sorted(map(str, want.fetchall()))


def test_globs_against_regex():
    rng = np.random.default_rng(1)
    globs = ["".join(rng.choice(list("ab*/"), 5)) for _ in range(60)]
    texts = ["".join(rng.choice(list("ab/"), rng.integers(0, 9))) for _ in range(300)]
    got = url_filter.run(url_filter.compile_globs(globs), texts)
    want = [[re.fullmatch("".join(".*" if c == "*" else re.escape(c) for c in g), t) is not None for g in globs] for t in texts]
    assert (got == np.array(want)).all()


def lm_model(rows):
    """(counts of words, of pairs; tokens) of training rows by plain counting; pairs begin with (0, w)."""
    tokens = lambda t: [*(t or "").encode().lower().split(), None]
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    c1, c2 = Counter(), Counter()
    for r in rows:
        if not out(r.doc_id):
            c1.update(tokens(r.text))
            c2.update(zip([0, *tokens(r.text)], tokens(r.text)))
    return c1, c2, tokens


def test_lm_base_score(spark, docs, odd):
    for table in (docs, odd):
        rows = table.select("doc_id", "text").collect()
        c, _, tokens = lm_model(rows)
        n, v = sum(c.values()), len(c)
        want = sorted((str(r.doc_id), len(tokens(r.text)), sum(c[w] > 0 for w in tokens(r.text)), round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens(r.text)), 4)) for r in rows)
        got = lm_score.score(table).collect()
        assert sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 4)) for r in got) == want
        assert all(r.train_tokens == n for r in got)
    assert lm_score.score(empty(spark)).count() == 0
    assert lm_score.score(docs.limit(5).select(F.col("doc_id").cast("string").alias("doc_id"), "text")).count() == 5


def test_lm_score_against_exact_counts(spark, docs, odd, monkeypatch):
    """The same score as from counts that are exact but for their levels, save for false probes; however it is read."""
    monkeypatch.setattr(lm_score, "SEGMENT_TEXT", 50_000)
    monkeypatch.setattr(lm_score, "CHUNK", 10_000)
    for table in (docs, odd):
        rows = table.select("doc_id", "text").collect()
        c1, c2, tokens = lm_model(rows)
        n, v = sum(c1.values()), len(c1)
        c1[0] = c1[None]
        q = lambda c: float(lm_score.count_of(lm_score.level(np.array([c])))[0])
        p = lambda v_, w: (q(c2[v_, w]) + lm_score.MASS * (q(c1[w]) + 1) / (n + v + 1)) / (q(c1[v_]) + lm_score.MASS)
        want = {(r.doc_id, r.text): sum(math.log10(p(*x)) for x in zip([0, *tokens(r.text)], tokens(r.text))) for r in rows}
        both = [lm_score.score(table, broadcast_bytes=b).collect() for b in (1 << 40, 0)]
        assert sorted((str(r.doc_id), r.score) for r in both[0]) == sorted((str(r.doc_id), r.score) for r in both[1])
        got, exact = sorted((str(r.doc_id), r.n_tokens, r.score) for r in both[0]), sorted((str(r.doc_id), len(tokens(r.text)), want[r.doc_id, r.text]) for r in rows)
        off = [abs(a[2] - b[2]) / a[1] for a, b in zip(got, exact)]
        assert [x[:2] for x in got] == [x[:2] for x in exact] and np.mean(off) < 0.02 and np.median(off) < 0.01
        if table is docs:  # what follows a context has probability 1 in all
            after = Counter()
            for (a, _), c in c2.items():
                after[a] += q(c)
            own = sum(q(c) + 1 for w, c in c1.items() if w != 0) / (n + v + 1)
            sums = [(after[a] + lm_score.MASS * own) / (q(c1[a]) + lm_score.MASS) for a in after]
            assert 0.98 < np.median(sums) < 1.02 and 0.9 < min(sums) and max(sums) < 1.1


def test_lm_score_knows_documents_that_occur_twice(spark):
    rng = np.random.default_rng(5)
    text = lambda: " ".join(f"w{k}" for k in rng.integers(0, 3000, 200))
    rows = [(k, text()) for k in range(300)]
    twice = rows[:40]
    table = spark.createDataFrame(rows + [(1000 + k, t) for k, t in twice], "doc_id long, text string")
    got = {r.doc_id: r for r in lm_score.score(table, broadcast_bytes=0).collect()}
    learnt = [k for k in range(300) if not got[k].held_out]
    two = [got[k].score for k in learnt if k < 40 and not got[1000 + k].held_out]
    assert min(two) > max(got[k].score for k in learnt if k >= 40)


def test_bloom_counts():
    keys = np.random.default_rng(2).integers(0, 1 << 62, 30_000).astype(np.uint64)
    n = np.arange(30_000) % 50 + 1
    lev = lm_score.level(n)
    got = lm_score.probe(lm_score.build(keys, lev), keys)
    assert (got >= lev).all() and (got > lev).mean() < 0.01
    absent = np.random.default_rng(3).integers(1 << 62, 1 << 63, 30_000).astype(np.uint64)
    assert (lm_score.probe(lm_score.build(keys, lev), absent) > 0).mean() < 0.01
    assert (lm_score.level(np.arange(11)) == np.arange(11)).all() and (np.abs(lm_score.count_of(lm_score.level(n)) / n - 1) < 0.06).all()


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header><h2>Site</h2></header><nav><ul><li><a href=/a>Home</a></ul></nav>
<div class="cookie-notice">We use cookies</div>%s<h1>The  title</h1><p>First &amp; best<b>est</b> words of the text that go on for a while.<p>Second&nbsp;part, somewhat longer than the first one was.<script>var t="</p>";</script>
<div class="ad">Buy now</div><form><input>Name</form><p>Third part ends the text here.</p>%s<section id="comments"><p>Nice one!</p></section><aside>More</aside><footer>&copy; me</footer></body>"""
TEXT = "The title\nFirst & bestest words of the text that go on for a while.\nSecond part, somewhat longer than the first one was.\nThird part ends the text here."


def test_html_extraction(spark):
    pages = [PAGE % ("<article>", "</article>"), PAGE % ("<div class=content>", "</div>"), PAGE % ("<main>", "</main>"), None, "", "<<<p", "plain words only", "<p>" * 5000 + "x"]
    table = spark.createDataFrame([(k, None, p) for k, p in enumerate(pages)], "page_id long, url string, html string")
    got = [r.text for r in html_extract.main_text(table).orderBy("page_id").collect()]
    assert got[0] == TEXT and got[1] == TEXT and got[2] == TEXT
    assert got[3] == "" and got[4] == "" and got[6] == "plain words only" and got[7] == "x"
    assert html_extract.main_text(table.limit(0)).count() == 0


def test_html_scan_decides_among_articles(spark):
    teaser = "<article><h3><a href=/%d>Story %d</a></h3><p>A short teaser that leads to another page.</p></article>"
    words = "\n".join(f"<p>Paragraph {k} of the long text " + "goes on and on " * 20 + "</p>" for k in range(6))
    cards = "".join(teaser % (k, k) for k in range(4))
    page = f"<body><main>{cards}<article><h1>The long one</h1>{words}</article>{cards}</main><div>Some words outside.</div></body>"
    plain = f"<body><article><p>Only a promo of few words.</p></article><div>{words}</div></body>"
    table = spark.createDataFrame([(1, None, page), (2, None, plain)], "page_id long, url string, html string")
    one, two = (r.text for r in html_extract.main_text(table).orderBy("page_id").collect())
    assert one.startswith("The long one\nParagraph 0") and one.count("Paragraph") == 6 and "teaser" not in one and "Story" not in one and "outside" not in one
    assert two.count("Paragraph") == 6


def test_best_region():
    assert html_extract.best_region([-1, 2, 3, -1, 4, -9, 5]) == (1, 5)
    assert html_extract.best_region([-1.0]) == (0, 0) and html_extract.best_region([]) == (0, 0)


def test_pipeline(spark, sf):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "dedup", "decontaminate", "mix", "shard"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf).cache()
        assert name == "shard" or out.columns == docs.columns
        counts.append(out.count())
        docs = out
    assert counts[0] > counts[1] > counts[2] >= counts[3] and counts[5] == counts[4]
