"""Rounds of replies, evidence in a reranker's order, document order and digest trees, against plain models."""

import hashlib
import random
import re
from itertools import product

import pytest
from pyspark.sql import functions as F

from foliospark.operators import evidence, ordering, understand
from foliospark.plans.engine import Engine

LISTED = "1) 甲\n   关键描写/情节：他来了。\n   简短总结：他来。"
SAID = ["", "无法回答", "信息不足，无法确认。", "哈利住在霍格沃茨。", LISTED]


def scripted(script):
    """A provider that says what is written for a question and round; counts calls in its replies."""

    def call(rows):
        table = rows.sparkSession.createDataFrame([(q, r, t) for (q, r), t in script.items()], "qid long, round string, reply string")
        return rows.join(table, ["qid", "round"]).select("qid", "reply")

    return call


def plain_rounds(replies, has_evidence, is_list):
    """What is said in the end, and in which rounds was asked."""
    refuses = lambda t: t == "无法回答" or (len(t) <= 90 and re.search(evidence.REFUSAL, t)) or t == ""
    said, rounds = replies["first"], ["first"]
    if said and has_evidence and refuses(said):
        rounds.append("abstain")
        said = replies["abstain"] or said
    if said and has_evidence and is_list and not ("关键描写" in said and "简短总结" in said):
        rounds.append("list")
        said = replies["list"] or said
    return said, "+".join(rounds)


def test_rounds_of_replies_against_a_plain_model(spark):
    cases = list(product(SAID, SAID, SAID[1:] + [""], (True, False), (True, False)))
    asked = spark.createDataFrame([(k, "q", "e" if ev else " ", li) for k, (*_, ev, li) in enumerate(cases)], "qid long, question string, evidence string, is_list boolean")
    script = {(k, r): t for k, (a, b, c, _, _) in enumerate(cases) for r, t in zip(("first", "abstain", "list"), (a, b, c))}
    got = {r.qid: (r.reply, r.rounds) for r in evidence.replied(asked, scripted(script)).collect()}
    assert got == {k: plain_rounds(dict(zip(("first", "abstain", "list"), x[:3])), *x[3:]) for k, x in enumerate(cases)}
    once = {r.qid: r.rounds for r in evidence.replied(asked, scripted(script), retry=False).collect()}
    assert "abstain" not in "".join(once.values()) and any("list" in r for r in once.values())


def test_only_those_that_need_it_are_asked_again(spark):
    seen = []

    def call(rows):
        seen.append(sorted((r.qid, r.round) for r in rows.collect()))
        return scripted({(1, "first"): "好。", (2, "first"): "无法回答", (2, "abstain"): "有了。"})(rows)

    asked = spark.createDataFrame([(1, "q", "e", False), (2, "q", "e", False), (3, "q", "e", False)], "qid long, question string, evidence string, is_list boolean")
    got = {r.qid: (r.reply, r.rounds) for r in evidence.replied(asked, call).collect()}
    assert seen == [[(1, "first"), (2, "first"), (3, "first")], [(2, "abstain")], []]
    assert got == {1: ("好。", "first"), 2: ("有了。", "first+abstain"), 3: ("", "first")}


def test_finished_replies(spark):
    texts = ["根据原文，他来了。", "无法回答", "信息不足", "", None, "资料中没有提到。他走了。", "原文片段"]
    rows = spark.createDataFrame(list(enumerate(texts)), "k long, t string").select("k", evidence.finished(F.col("t")).alias("f"))
    got = {r.k: r.f for r in rows.collect()}
    assert got[0] == "他来了。" and got[1] is got[2] is got[3] is got[4] is None and got[5] == "他走了。" and got[6] is None


def test_answers_come_from_rounds(spark):
    questions = spark.createDataFrame([(1, "他住在哪里"), (2, "她住在哪里"), (3, "谁在这里")], "qid long, text string")
    hits = spark.createDataFrame([(q, f"p{q}_c0", 0.5, 1, q, q, "", "这里是一段文字。") for q in (1, 2, 3)], "qid long, chunk_id string, score double, rank int, page_start int, page_end int, chapter string, text string")
    seen = []

    def call(rows):
        seen.extend(rows.columns)
        return scripted({(1, "first"): "无法回答", (1, "abstain"): "他住在塔里。", (2, "first"): "信息不足", (2, "abstain"): "", (3, "first"): "根据原文，是他。"})(rows)

    got = {r.qid: (r.answer, r.way) for r in Engine().answer(questions, hits, call).collect()}
    assert got[1] == ("他住在塔里。", "provider") and got[2][1] == "snippets" and got[3] == ("是他。", "provider")
    assert {"question", "evidence", "is_list", "criteria", "targets", "fields", "known", "round"} <= set(seen)


def test_missing_cells_can_be_shown(spark):
    plans = spark.createDataFrame([(1, ["甲", "乙", "丙"], ["学院", "职业"])], "qid long, targets array<string>, fields array<string>")
    values = spark.createDataFrame([(1, "甲", "学院", "A"), (1, "乙", "学院", "B"), (1, "乙", "职业", "C")], "qid long, target string, field string, value string")
    assert [tuple(r) for r in evidence.filled(values, plans).collect()] == [(1, False, "甲：学院：A\n乙：学院：B；职业：C")]
    assert [tuple(r) for r in evidence.filled(values, plans, "—").collect()] == [(1, False, "甲：学院：A；职业：—\n乙：学院：B；职业：C\n丙：学院：—；职业：—")]


def test_evidence_in_the_order_of_a_reranker(spark):
    hits = spark.createDataFrame([(q, f"c{k}", 1.0 - k / 10, k, None if q < 3 else 0.5) for q in (1, 2, 3) for k in range(1, 6)], "qid long, chunk_id string, score double, rank int, rerank_score double")
    scored = spark.createDataFrame([(1, "c1", 0.1), (1, "c2", 0.9), (1, "c3", 0.9), (1, "c5", 0.95), (2, "c1", None), (3, "c5", 1.0)], "qid long, chunk_id string, rerank_score double")
    got = {}
    for r in evidence.reranked_for_evidence(hits, scored, 4).orderBy("qid", "rank").collect():
        got.setdefault(r.qid, []).append((r.chunk_id, r.score))
    assert got[1] == [("c2", 0.9), ("c3", 0.9), ("c1", 0.1), ("c4", 0.0), ("c5", 0.5)]  # c5 isn't among the first four
    assert [c for c, _ in got[2]] == [c for c, _ in got[3]] == ["c1", "c2", "c3", "c4", "c5"]


def test_document_order_against_a_plain_sort(spark):
    rng = random.Random(4)
    ids = {rng.choice([f"p{rng.randint(0, 30)}_c{rng.randint(0, 12)}", f"x{rng.randint(0, 99)}", f"p{rng.randint(0, 9)}"]) for _ in range(300)}
    rows = [(b, i, rng.choice([None, 0, 3, 12])) for i in sorted(ids) for b in (["a"] if rng.random() < 0.8 else ["b", None])]
    rng.shuffle(rows)
    table = spark.createDataFrame(rows, "book string, chunk_id string, page_start int").withColumn("text", F.lit("t")).repartition(7)

    def key(i, page):
        m = re.fullmatch(r"p([0-9]{1,7})_c([0-9]{1,5})", i)
        return (int(m[1]), int(m[2]), i) if m else (page if page and page > 0 else 10**9, 10**9, i)

    want = {}
    for b, i, page in sorted(rows, key=lambda r: key(r[1], r[2])):
        want.setdefault(b, []).append((i, page))
    got = {}
    for r in ordering.in_document_order(table).orderBy("doc_ord").collect():
        got.setdefault(r.book, []).append((r.chunk_id, r.page_start, r.doc_ord))
    assert got == {b: [(*x, k) for k, x in enumerate(v, 1)] for b, v in want.items()}
    one = ordering.in_document_order(table.drop("book"))
    assert one.columns == ["chunk_id", "page_start", "text", "book", "doc_ord"] and sorted(r.doc_ord for r in one.collect()) == list(range(1, len(rows) + 1))
    assert ordering.in_document_order(table.limit(0)).count() == 0


def plain_tree(rows):
    level = [hashlib.sha256(f"{i}\t{t or ''}".encode()).hexdigest() for i, t in sorted(rows)]
    levels = 0
    while len(level) > 1 or (level and not levels):
        level, levels = [hashlib.sha256("\n".join(level[k : k + ordering.FAN]).encode()).hexdigest() for k in range(0, len(level), ordering.FAN)], levels + 1
    return len(rows), levels, level[0] if level else hashlib.sha256(b"").hexdigest()


@pytest.mark.parametrize("n", [0, 1, 3, 4, 17, 70])
def test_digest_trees_against_a_plain_fold(spark, monkeypatch, n):
    monkeypatch.setattr(ordering, "FAN", 4)
    rows = [(f"id {k:03}", None if k == 2 else f"text {k}") for k in range(n)]
    tree = lambda r: tuple(ordering.digest_tree(spark.createDataFrame(r, "id string, text string").repartition(5), "id", "text").first())
    assert tree(rows) == plain_tree(rows)
    if n > 3:
        changed = [*rows[:-1], (rows[-1][0], "other")]
        assert len({tree(rows)[2], tree(changed)[2], tree(rows[1:])[2], tree([*rows, ("id 999", "")])[2]}) == 4
        assert tree(rows[::-1]) == tree(rows)
