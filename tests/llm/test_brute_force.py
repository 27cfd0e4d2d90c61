"""Operators and pipeline stages against plain models that look at everything."""

import bisect
import math
import re
import time
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

import corpus_pipeline
from foliospark.llm import common, decontaminate, html_extract, mixing, quality_gam, quality_rules, sharding, simhash

from test_llm import SCHEMA, WORD, empty, naive_components, naive_fingerprint, naive_rules, odd  # noqa: F401

# --- decontamination


def test_no_window_escapes_the_masks():
    for w in range(decontaminate.EXACT + 1, decontaminate.WINDOW + 1):
        for bad in (b for k in range(w - math.ceil(decontaminate.SIMILARITY * w) + 1) for b in combinations(range(w), k)):
            fits = lambda m, p: all(c == "0" or p + i not in bad for i, c in enumerate(m))
            assert any(fits(m, p) for m in decontaminate.MASKS for p in range(w - len(m) + 1)), (w, bad)


def naive_leak(text, item):
    """The most equal words of a window of the item laid over the text anywhere, and the window's length; (0, 1) if too few."""
    bare = lambda t: [x for x in (w.strip(".,;:!?\"'()[]") for w in (t or "").lower().split()) if x]
    d, b = bare(text), bare(item)
    w = min(len(b), decontaminate.WINDOW)
    best = max((sum(0 <= s + k < len(d) and d[s + k] == b[j + k] for k in range(w)) for j in range(len(b) - w + 1) for s in range(-w, len(d))), default=0) if b else 0
    return (best, w) if w and best >= (w if w <= decontaminate.EXACT else decontaminate.SIMILARITY * w) else (0, 1)


def test_decontamination_against_all_alignments(spark, monkeypatch):
    rng = np.random.default_rng(8)
    vocabulary = [f"v{k}" for k in range(60)]
    item = lambda n: list(rng.choice(vocabulary, n))
    items = [item(n) for n in (1, 2, 3, 4, 5, 6, 7, 9, 12, 13, 14, 20, 33, 60, 80)]
    docs = [item(int(n)) for n in rng.integers(0, 50, 40)]
    for b in items:
        for share in (1.0, 0.7, 0.5):
            for wrong in (0, 1, 2, 3, 4):
                n = max(1, int(len(b) * share))
                at = int(rng.integers(0, len(b) - n + 1))
                part = b[at : at + n]
                for k in rng.choice(n, min(wrong, n), replace=False):
                    part[k] = "other"
                docs.append([*item(int(rng.integers(0, 9))), *part, *item(int(rng.integers(0, 9)))])
    table = spark.createDataFrame([(k, " ".join(d)) for k, d in enumerate(docs)], "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(b)) for k, b in enumerate(items)], "item_id long, text string")
    want = {(d, b, *naive_leak(" ".join(docs[d]), " ".join(items[b]))) for d in range(len(docs)) for b in range(len(items))}
    want = {x for x in want if x[2]}
    for rows in (decontaminate.SEED_ROWS, 0):  # hashes broadcast, and joined by shuffles
        monkeypatch.setattr(decontaminate, "SEED_ROWS", rows)
        got = {(r.doc_id, r.item_id, r.matched, r.compared) for r in decontaminate.leaks(table, bench).collect()}
        assert got == want
    assert len(want) > 150 and len({d for d, *_ in want}) < len(docs)


def test_decontamination_finds_parts_and_short_items(spark):
    rows = [(1, "so one two three four and on"), (2, "one two three and four"), (3, "x " + " ".join(f"p{k}" for k in range(14)) + " y"), (4, " ".join(f"p{k}" for k in range(10)))]
    bench = spark.createDataFrame([(1, "One two, three four!"), (2, " ".join(f"p{k}" for k in range(20)))], "item_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in decontaminate.leaks(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()) == [(1, 1), (3, 2)]


# --- HTML


def test_best_region_against_all_regions():
    rng = np.random.default_rng(6)
    for _ in range(300):
        s = [float(x) for x in rng.integers(-5, 5, int(rng.integers(0, 14)))]
        lo, hi = html_extract.best_region(s)
        assert sum(s[lo:hi]) == max([0.0, *(sum(s[i:j]) for i in range(len(s)) for j in range(i + 1, len(s) + 1))])


def test_html_breaks_and_repeats(spark):
    page = "<body><article>" + "<p>line one<br>line two<BR/>three</p>" + "<p>word and more words of it here</p>" * 4 + "</article></body>"
    table = spark.createDataFrame([(1, "u", page, "x"), (1, "u", page, "x"), (None, None, None, None)], "page_id long, url string, html string, text string")
    got = [r.text for r in html_extract.main_text(table).orderBy("page_id").collect()]
    assert got[0] == "" and got[1] == got[2] and got[1].startswith("line one line two three\nword and")


ARTICLE = "<h1>The title</h1>" + "".join(f"<p>Paragraph {k} of a text that goes on for some words.</p>" for k in range(5))
SIDE = '<div class="sidebar"><p>Some other words beside it.</p></div><div id="comments"><article class="comment"><p>Nice text, I liked it a lot, really.</p></article></div>'


@pytest.mark.parametrize("frame", ['<div class="wrap has-sidebar">', '<div class="container no-sidebar">', '<section class="related-work">', '<div id="td-search">', "<form>", '<div class="comments-open">', '<form><div class="has-sidebar">', '<div class="header-fixed"><div id="widget-7">'])
def test_articles_in_frames_are_not_lost(frame):
    ends = "".join(f"</{x}>" for x in reversed(re.findall(r"<(\w+)", frame)))
    for mark in ("article", "main"):
        page = f"<body><nav><a href=/>Home</a></nav>{frame}{SIDE}<{mark}>{ARTICLE}</{mark}>{SIDE}{ends}<footer>end</footer></body>"
        text = html_extract.extract(page, html_extract.weights(Counter(), Counter()))
        assert text.startswith("The title\nParagraph 0") and text.count("Paragraph") == 5 and "beside" not in text and "liked" not in text and "Home" not in text
    if "comments" not in frame:  # without any mark what holds most of the words is the frame
        text = html_extract.extract(f"<body><nav><a href=/>Home</a></nav>{frame}{ARTICLE}{ends}<footer>end</footer></body>", html_extract.weights(Counter(), Counter()))
        assert text.count("Paragraph") == 5 and "Home" not in text


def test_what_is_beside_an_article_stays_out():
    page = f"<body><article>{ARTICLE}</article><div class=related><article>{ARTICLE * 3}</article></div><div id=comments>{'<p>Long comments here.</p>' * 60}</div></body>"
    text = html_extract.extract(page, html_extract.weights(Counter(), Counter()))
    assert text.count("title") == 1 and "comments" not in text
    assert html_extract.extract(f"<body><div id=comments>{'<p>Long comments here.</p>' * 60}</div><p>One line.</p></body>", html_extract.weights(Counter(), Counter())) == "One line."


def test_html_takes_linear_time():
    for page in ("<div>" * 40_000 + "</b>" * 40_000, "<b><table>" + "<div>" * 40_000 + "</b>" * 40_000, "<article>" * 3000 + "</b>" * 40_000 + "</main>" * 40_000, "<p>" * 40_000 + "x" + "</span>" * 40_000, "<form>" * 20_000 + "<article>x" + "</form>" * 20_000):
        began = time.time()
        html_extract.parse(page)
        assert time.time() - began < 3


def test_html_extraction_of_pages_that_mark_nothing(spark, sf):
    """With the marks of the given pages taken away, the scan finds the same texts."""
    pages = [r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    marked = spark.createDataFrame(pages, "page_id long, url string, html string")
    weight = html_extract.learn(marked)
    shares = []
    for r in pages:
        plain = re.sub(r"<(/?)(?:article|main)\b", r"<\1div", r.html, flags=re.I)
        want, got = Counter(html_extract.extract(r.html, weight).split()), Counter(html_extract.extract(plain, weight).split())
        both = sum((want & got).values())
        shares.append(2 * both / max(1, sum(want.values()) + sum(got.values())))
    assert np.mean(shares) > 0.95 and np.median(shares) == 1.0, (np.mean(shares), sorted(shares)[:5])


# --- near-duplicates


def test_keep_one_with_repeated_ids(spark):
    a, b = "one two three four five six seven", "entirely other words stand in this text here"
    table = spark.createDataFrame([(3, b, "x"), (5, a, "y"), (5, b, "z")], "doc_id long, text string, hash string")
    assert sorted((r.doc_id, r.text) for r in simhash.keep_one(table).collect()) == [(3, b), (5, a)]


def test_keep_one_keeps_one_of_each_component(spark, odd):  # noqa: F811
    rng = np.random.default_rng(9)
    texts = [None, "", *(" ".join(f"w{x}" for x in rng.integers(0, 500, 300)) for _ in range(12))]
    texts += [t + " more" for t in texts[2:6]]
    rows = [(None if rng.random() < 0.2 else int(rng.integers(0, 15)), texts[int(rng.integers(0, len(texts)))], int(k)) for k in range(150)]
    table = spark.createDataFrame(rows, "doc_id long, text string, n int")
    ids = {f: k for k, f in enumerate({naive_fingerprint(t) for t in texts})}
    root = naive_components([(k, f) for f, k in ids.items()])
    parts = defaultdict(list)
    for i, t, _ in rows:
        f = naive_fingerprint(t)
        parts[root[ids[f], f]].append(i)
    got = simhash.keep_one(table).collect()
    assert len(got) == len(parts)
    for r in got:
        f = naive_fingerprint(r.text)
        known = [i for i in parts[root[ids[f], f]] if i is not None]
        assert r.doc_id == (min(known) if known else None)
    assert simhash.keep_one(table).columns == table.columns and simhash.keep_one(empty(spark)).count() == 0
    assert len(simhash.keep_one(odd).collect()) == len({naive_fingerprint(r.text) for r in odd.collect()})


# --- sharding


def naive_schedule(items, shards):
    load, out = [0] * shards, {}
    for size, name in sorted(items, key=lambda x: (-x[0], x[1])):
        s = min(range(shards), key=lambda k: (load[k], k))
        out[name], load[s] = s, load[s] + size
    return out


def test_schedule_against_looking_at_all_shards():
    rng = np.random.default_rng(10)
    for n in (0, 1, 5, 200):
        items = [(int(x), f"g{k}") for k, x in enumerate(rng.integers(1, 50, n))]
        assert sharding.schedule(items, 7) == naive_schedule(items, 7)


def test_shards_in_closed_form_against_the_heap(monkeypatch):
    rng = np.random.default_rng(12)
    for one_by_one in (0, 3, 1000):
        monkeypatch.setattr(sharding, "ONE_BY_ONE", one_by_one)
        for _ in range(150):
            shards = int(rng.integers(1, 9))
            histogram = [(int(s), int(rng.integers(1, 40))) for s in np.unique(rng.integers(1, rng.choice([5, 60, 900]), 8))]
            items = [(s, f"{k:05}") for s, n in histogram for k in range(n)]
            want = naive_schedule([(s, f"{s:09}{k}") for s, k in items], shards)
            for size, before, loads in sharding.runs(histogram, shards):
                n = dict(histogram)[size]
                got = sharding.shards_of(np.array([loads] * n), np.full(n, size), np.arange(n))
                assert got.tolist() == [want[f"{size:09}{k:05}"] for k in range(n)]
                assert before == sum(m for s, m in histogram if s > size)


@pytest.mark.parametrize("groups", [1_000_000, 10])
def test_sharding_against_scheduling_all_groups(spark, sf, monkeypatch, groups):
    """Shards are those of the plain schedule over all groups, whether they are broadcast or joined."""
    monkeypatch.setattr(sharding, "GROUP_ROWS", groups)
    rng = np.random.default_rng(11)
    few = spark.createDataFrame([(k, "x" * int(rng.integers(0, 40)) + str(k // 2)) for k in range(900)], "doc_id long, text string")
    for table in (few, spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet").select("doc_id", "text")):
        got = sharding.assign(table).join(table, "doc_id").withColumn("hash", F.xxhash64("text")).collect()
        sizes = Counter()
        for r in got:
            sizes[r["hash"], r.text_crc32, r["size"]] += r["size"]
        want = naive_schedule([(n, name) for name, n in sizes.items()], 16)
        assert all(r.shard == want[r["hash"], r.text_crc32, r["size"]] for r in got)
        assert sorted((r.text, r.shard) for r in sharding.place(table).collect()) == sorted((r.text, r.shard) for r in got)


def test_slots_of_equal_rows_are_dealt_out(spark):
    table = spark.range(5000).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"), F.lit("same").alias("text"))
    got = sharding.assign(table).toPandas()
    for _, part in got.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))
    rows = common.cut(table.select("doc_id", *sharding._narrow(), F.lit(0).alias("shard")))
    assert sharding._slots(rows, 16).groupBy("chunk").count().agg(F.max("count")).first()[0] < 900  # of 1,667 equal rows


# --- quality rules


def naive_verdicts(rows):
    def shares(counts):
        n = sum(counts)
        return [x / n if n else 0.0 for x in counts]

    def distance(p, q):
        term = lambda a, m: a * math.log2(a / m) if a > 0 else 0.0
        return math.sqrt(max(0.0, sum(0.5 * term(a, (a + b) / 2) + 0.5 * term(b, (a + b) / 2) for a, b in zip(p, q))))

    def classes(text):
        solid = re.sub(r"[\x20\x09-\x0D]+", "", text or "")
        found = [len(regex.findall(f"[{p}]", solid)) for p in quality_rules.CLASSES.values()]
        return [*found, len(solid) - sum(found)]

    langs, base = defaultdict(Counter), []
    for r in rows:
        langs[r.lang or ""].update(w.lower() for w in WORD.findall(r.text or ""))
        n, _, _, _, again = naive_rules(r.text)
        base.append(n < 50 or 100 * again > 50 * n)
    top = {k: [w for w, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))[: quality_rules.COMMON_WORDS]] for k, c in langs.items()}
    counts = []
    for r in rows:
        c = Counter(w.lower() for w in WORD.findall(r.text or ""))
        common_n = [c[w] for w in top[r.lang or ""]]
        counts.append((classes(r.text), [*common_n, sum(c.values()) - sum(common_n)]))
    out = []
    for k, r in enumerate(rows):
        peers = [counts[j] for j, x in enumerate(rows) if (x.lang or "") == (r.lang or "") and not base[j]]
        class_ref, word_ref = ([sum(x) for x in zip(*(p[i] for p in peers))] for i in (0, 1))
        far_class = far_word = None
        if not base[k]:
            mine, words = counts[k]
            if sum(mine) >= quality_rules.MIN_CHARS:
                far_class = distance(shares(mine), shares(class_ref))
            if sum(words) >= quality_rules.MIN_JUDGED_WORDS or sum(words[:-1]) >= quality_rules.MIN_COMMON:
                far_word = distance(shares(words), shares(word_ref)) / distance([0.0] * (len(words) - 1) + [1.0], shares(word_ref))
        kept = not base[k] and (far_class or 0) <= quality_rules.MAX_CLASS_DISTANCE and (far_word or 0) <= quality_rules.MAX_WORD_DISTANCE
        out.append((str(r.doc_id), base[k], kept, None if far_class is None else round(far_class, 6), None if far_word is None else round(far_word, 6)))
    return sorted(map(str, out))


def test_quality_verdicts_against_plain_histograms(spark, sf, odd):  # noqa: F811
    for table in (spark.read.parquet(f"{sf}/documents.parquet"), odd):
        rows = table.collect()
        got = quality_rules.judge(table).collect()
        near = lambda x: None if x is None else round(x, 6)
        assert sorted(str((str(r.doc_id), r.base_failed, r.kept, near(r.class_distance), near(r.word_distance))) for r in got) == naive_verdicts(rows)
    assert {r.class_distance for r in got if r.base_failed} == {None}


def test_quality_rules_reject_what_diverges(spark, sf):
    clean = spark.read.parquet(f"{sf}/documents.parquet").filter("lang = 'en' and length(text) > 1500").select("doc_id", "text", "lang").limit(60)
    rng = np.random.default_rng(12)
    symbols = " ".join("".join(rng.choice(list("#|<>{}=+~^0123456789"), 6)) for _ in range(400))
    bad = spark.createDataFrame([(-1, symbols, "en"), (-2, " ".join(f"{x:04d}" for x in range(600)), "en")], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in quality_rules.judge(clean.unionByName(bad)).collect()}
    assert not got[-1].kept and not got[-2].kept and not got[-1].base_failed and not got[-2].base_failed and got[-1].class_distance > 0.5


# --- classifier


def naive_tree(g, h, n, leaves):
    """Greedy best splits, trying every cut of every leaf."""
    value = lambda a, b: sum(g[a:b]) ** 2 / (sum(h[a:b]) + 1)
    cuts = [(0, len(g))]
    while len(cuts) < leaves:
        tries = [(value(a, m) + value(m, b) - value(a, b), a, m, b) for a, b in cuts for m in range(a + 1, b) if sum(n[a:m]) >= quality_gam.LEAST_LEAF and sum(n[m:b]) >= quality_gam.LEAST_LEAF]
        best = max(tries, default=(0, 0, 0, 0))
        if best[0] <= 1e-6:
            break
        cuts = [c for c in cuts if c != (best[1], best[3])] + [(best[1], best[2]), (best[2], best[3])]
    out = [0.0] * len(g)
    for a, b in cuts:
        out[a:b] = [sum(g[a:b]) / (sum(h[a:b]) + 1)] * (b - a)
    return out


def test_trees_against_all_cuts():
    rng = np.random.default_rng(13)
    for _ in range(60):
        k = int(rng.integers(1, 20))
        g, h, n = rng.normal(0, 5, k), rng.random(k) * 4, rng.integers(0, 15, k)
        assert np.allclose(quality_gam._tree(g, h, n, 3), naive_tree(list(g), list(h), list(n), 3))


def naive_score(model, x):
    total = model.bias + sum(t[bisect.bisect_left(list(e), v)] for e, t, v in zip(model.edges, model.tables, x))
    total += sum(t[bisect.bisect_left(list(model.pair_edges[i]), x[i]), bisect.bisect_left(list(model.pair_edges[j]), x[j])] for i, j, t in model.pairs)
    return 1 / (1 + math.exp(-max(-30, min(30, total))))


def test_boosting_learns_pairs_and_scores_are_sums():
    rng = np.random.default_rng(14)
    x = rng.random((3000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)  # neither number says anything alone
    model = quality_gam.fit(x[:2000], y[:2000])
    assert (0, 1) in [p[:2] for p in model.pairs] and ((model.score(x[2000:]) > 0.5) == y[2000:]).mean() > 0.8
    assert np.allclose(model.score(x[2000:2200]), [naive_score(model, r) for r in x[2000:2200]])


# --- mixing


def test_folding_against_a_plain_loop(spark, monkeypatch):
    """Pairs in order of size, with draws that plain Python can make: the same documents are rounded up."""
    monkeypatch.setattr(mixing, "FAN", 1000)
    monkeypatch.setattr(mixing, "_draw", lambda *ids: F.pmod(ids[0] * 7919 + (ids[1] * 104729 if len(ids) > 2 else F.lit(0)), F.lit(1000)) / 1000.0)
    rng = np.random.default_rng(15)
    for f in (0.25, 0.5, 0.9):
        units = [(k, int(s)) for k, s in enumerate(rng.permutation(np.arange(1, 301))[:80])]
        table = spark.createDataFrame([("s", (k, 0), s, f) for k, s in units], "source string, key struct<id:bigint,salt:bigint>, size long, f double")
        got = {r.key.id: r.up for r in mixing._round_together(table).collect()}
        want, rest = {}, None
        for k, s in sorted(units, key=lambda x: -x[1]):
            if rest is None:
                rest = (k, s, f)
                continue
            (a, sa, fa), (b, sb, fb) = rest, (k, s, f)
            up, down = min((1 - fa) * sa, fb * sb), min(fa * sa, (1 - fb) * sb)
            moved = up if (a * 7919 + b * 104729) % 1000 / 1000 * (up + down) < down else -down
            fa2, fb2 = fa + moved / sa, fb - moved / sb
            done_a = (1 - fa) * sa <= fb * sb if moved > 0 else fa * sa <= (1 - fb) * sb
            want[a if done_a else b] = int((moved > 0) == done_a)
            rest = (b, sb, min(1, max(0, fb2))) if done_a else (a, sa, min(1, max(0, fa2)))
        want[rest[0]] = int(rest[0] * 7919 % 1000 / 1000 < rest[2])
        assert got == want
        assert abs(sum(s * got[k] for k, s in units) - f * sum(s for _, s in units)) <= 301


def test_rounding_keeps_expectations(spark):
    """Over many draws every document is rounded up as often as its fraction says."""
    rows = [(f"s{j}", (k + 1000 * j, 0), int(5 + (k * 37) % 50), 0.3) for j in range(200) for k in range(20)]
    up = mixing._round_together(spark.createDataFrame(rows, "source string, key struct<id:bigint,salt:bigint>, size long, f double")).toPandas()
    by = up.assign(k=[r["id"] % 1000 for r in up["key"]]).groupby("k").up.mean()
    assert len(up) == len(rows) and abs(up.up.mean() - 0.3) < 0.02 and by.between(0.15, 0.45).all()


# --- pipeline


def naive_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight, limit = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}, {s: 2.0 * sizes[s] for s in order}
    left, free, out = 1.5 * sum(sizes.values()), set(order), {}
    while free:
        rate = left / sum(weight[s] for s in free)
        full = {s for s in free if rate * weight[s] >= limit[s]}
        if not full:
            break
        for s in full:
            out[s], left = limit[s], left - limit[s]
        free -= full
    return out | {s: left * weight[s] / sum(weight[x] for x in free) for s in free}


def test_stages_against_plain_python(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels, bench = spark.read.parquet(f"{sf}/labels.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet").collect()
    stage = dict(corpus_pipeline.STAGES)
    step = lambda name, df: common.cut(stage[name](spark, df, sf))
    ids = lambda df: sorted(r[0] for r in df.select("doc_id").collect())
    rows = docs.collect()

    model = quality_gam.train(docs, labels, ~quality_gam.is_held_out())
    good = [r for r in rows if naive_score(model, quality_gam.features(r.text)) >= quality_gam.THRESHOLD]
    out = step("quality", docs)
    assert ids(out) == sorted(r.doc_id for r in good) and len(good) < len(rows)

    root = naive_components([(r.doc_id, naive_fingerprint(r.text)) for r in good])
    unique = [r for r in good if root[r.doc_id, naive_fingerprint(r.text)] == r.doc_id]
    out = step("dedup", out)
    assert ids(out) == sorted(r.doc_id for r in unique) and len(unique) < len(good)

    kept = [r for r in unique if not any(naive_leak(r.text, b.text)[0] for b in bench)]
    out = step("decontaminate", out)
    assert ids(out) == sorted(r.doc_id for r in kept) and len(kept) < len(unique)

    size, total = {r.doc_id: len(WORD.findall(r.text or "")) for r in kept}, Counter()
    for r in kept:
        total[r.source] += size[r.doc_id]
    target = naive_targets(total)
    out = step("mix", out)
    copies = Counter(ids(out))
    for s in total:
        p = target[s] / total[s]
        mine = [r.doc_id for r in kept if r.source == s and size[r.doc_id]]
        assert all(math.floor(p + 1e-9) <= copies[i] <= math.ceil(p - 1e-9) for i in mine)
        assert abs(sum(copies[i] * size[i] for i in mine) - target[s]) <= max(size[i] for i in mine)
    assert all(copies[i] == 0 for i in size if not size[i]) and set(copies) <= set(size)

    n = Counter((r.text or "") for r in out.collect())
    out = step("shard", out)
    assert out.columns == [*docs.columns, "shard"] and Counter((r.text or "") for r in out.collect()) == n
    shards = defaultdict(set)
    for r in out.collect():
        shards[r.text or ""].add(r.shard)
    assert all(len(s) == 1 for s in shards.values()) and set().union(*shards.values()) <= set(range(16))


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_odd_tables(spark, sf, odd, name):  # noqa: F811
    stage = dict(corpus_pipeline.STAGES)[name]
    out = stage(spark, odd, sf)
    assert out.columns == odd.columns + (["shard"] if name == "shard" else [])
    assert {(r.doc_id, r.text) for r in out.select("doc_id", "text").collect()} <= {(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()}
    assert stage(spark, spark.createDataFrame([], SCHEMA), sf).count() == 0


def test_no_local_checkpoints_on_a_cluster(spark):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(key, default=None):
                return default

    with pytest.raises(ValueError):
        common.ensure_checkpoint_dir(Session())
