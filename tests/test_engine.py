"""Plans, targets, entities, first appearances and the whole way from questions to answers, on small worked cases."""

import random

import pytest
from pyspark.sql import functions as F

from foliospark.operators import entities, evidence, fusion, lexical, planning, prep, spotting, temporal, understand, vector
from foliospark.plans.engine import Engine


def q(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "qid long, text string")


def test_spotted_against_looking_everywhere(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice("abé王") for _ in range(rng.randrange(0, 30))) for _ in range(40)]
    names = sorted({"".join(rng.choice("abé王") for _ in range(rng.randrange(1, 4))) for _ in range(25)})
    table, known = spark.createDataFrame(list(enumerate(texts)), "id long, text string"), spark.createDataFrame([(n,) for n in [*names, ""]], "name string")
    got = sorted((r.id, r.name) for r in spotting.spotted(table, known).collect())
    assert got == sorted((k, n) for k, t in enumerate(texts) for n in names if n in t)
    assert spotting.spotted(table, known.limit(0)).count() == 0


@pytest.mark.parametrize("block", [1, 3, 7, 1024])
@pytest.mark.parametrize("most", [2, 3])
def test_page_merge_carries_runs_over_blocks(spark, block, most):
    rng = random.Random(block + most)
    texts = [rng.choice(["", "ends。", "open", "open too", "more"]) for _ in range(120)]
    pages = spark.createDataFrame([("b", k, t) for k, t in enumerate(texts) if k % 11] + [("c", 5, "open")], "book string, page_no int, text string")
    got = sorted((r.page_start, r.page_end, r.text) for r in prep.merged(pages, most, block).filter("book = 'b'").collect())
    want, run, kept = [], [], [(k, t) for k, t in enumerate(texts) if k % 11]
    for n, (k, t) in enumerate(kept):
        if t:
            run.append((k, t))
        goes_on = t and t[-1] not in "。" and n + 1 < len(kept) and kept[n + 1][1]
        if run and not goes_on:
            want += [run[i : i + most] for i in range(0, len(run), most)]
            run = []
    assert got == sorted((w[0][0], w[-1][0], "\n".join(t for _, t in w)) for w in want)


def test_kept_index_gives_the_same_hits(spark, tmp_path):
    docs = spark.createDataFrame([(k, " ".join(f"w{x * k % 7}" for x in range(k))) for k in range(30)], "chunk_id long, text string")
    asked = q(spark, "w1 w2 w3", "w5", "none", "w0 w6")
    kept = lexical.keep(docs, str(tmp_path / "index"))
    rows = lambda d, k: sorted(map(tuple, lexical.search(asked, d, k).collect()))
    assert rows(docs, 5) == rows(kept, 5) and len(rows(kept, 5)) == 15
    every = sorted(map(tuple, lexical.scores(asked, docs).collect()))
    assert sorted(r[:3] for r in rows(docs, 99)) == every


def test_partial_ranks_keep_ties_in_order(spark, monkeypatch):
    docs = spark.createDataFrame([(k, "same words") for k in range(50)] + [(99, "same words same")], "chunk_id long, text string").repartition(5)
    want = [tuple(r) for r in lexical.search(q(spark, "same"), docs, 7).orderBy("rank").collect()]
    assert [r[1] for r in want] == [99, 0, 1, 2, 3, 4, 5]
    monkeypatch.setattr(lexical, "CELLS", 3)
    monkeypatch.setattr(lexical, "ASKED", 1)
    assert [tuple(r) for r in lexical.search(q(spark, "same"), docs, 7).orderBy("rank").collect()] == want


def test_targets_by_alias_by_name_and_by_span(spark):
    asked = q(spark, "救世之星的学院是什么", "哈利波特和赫敏的学院分别是什么", "某某某在哪里", "12")
    names = spark.createDataFrame([("哈利",), ("哈利波特",), ("赫敏",), ("什么",)], "name string")
    aliases = spark.createDataFrame([("世之", 1, ["乙"]), ("救世之星", 0, ["哈利", "哈利"])], "phrase string, ord int, entities array<string>")
    got = {r.qid: r.targets for r in planning.targets(asked, names, aliases).collect()}
    assert got == {0: ["哈利"], 1: ["哈利波特", "赫敏"], 2: ["某某某在哪里"], 3: []}


def test_plans_and_queries(spark):
    asked = q(spark, "哈利和赫敏的学院分别是什么", "天气")
    names = spark.createDataFrame([("哈利",), ("赫敏",)], "name string")
    planned = planning.plans(asked, planning.targets(asked, names))
    rows = {r.qid: r for r in planned.collect()}
    assert rows[0].kind == "mapping" and rows[1].kind is None and rows[1].subqueries == []
    f = rows[0].fields[0]
    assert rows[0].subqueries[0].startswith(f"哈利 {f} ") and rows[0].subqueries[-1].startswith(f"哈利 赫敏 {f}") and len(rows[0].subqueries) <= 5
    more = spark.createDataFrame([(1, ["今天天气", "天气", "晴", "雨"])], "qid long, queries array<string>")
    got = [(r.qid, r.sub_no, r.text) for r in planning.queries(planned, more).filter("qid = 1").orderBy("sub_no").collect()]
    assert got == [(1, 0, "天气"), (1, 1, "今天天气")]


def test_replies_of_providers(spark):
    asked = q(spark, "a", "b", "c", "d")
    replies = spark.createDataFrame([(0, '{"queries": ["a", " x ", "x", "y", "z"]}'), (1, "no json"), (2, '{"other": 1}'), (3, '{"queries": ["d", ""]}')], "qid long, reply string")
    assert {r.qid: (r.queries, r.status) for r in planning.expanded(asked, replies).collect()} == {0: (["x", "y"], None), 1: ([], "parse_error"), 2: ([], "bad_format"), 3: ([], "bad_output")}
    pairs = spark.createDataFrame([(k, c) for k in range(5) for c in ("p1", "p2")], "qid long, chunk_id string")
    said = spark.createDataFrame([(0, '{"scores": [{"chunk_id": "p1", "score": 7}]}'), (1, "x"), (2, "{}"), (3, '{"scores": [{"chunk_id": "zz", "score": 1}]}')], "qid long, reply string")
    got = {(r.qid, r.chunk_id): (r.rerank_score, r.status) for r in fusion.rerank_scores(said, pairs).collect()}
    assert got[0, "p1"] == (1.0, None) and got[0, "p2"] == (0.0, None)
    assert [got[k, "p1"] for k in (1, 2, 3, 4)] == [(None, "parse_error"), (None, "bad_format"), (None, "bad_output"), (None, "no_reply")]
    hits = pairs.withColumns({"rank": F.when(F.col("chunk_id") == "p1", 2).otherwise(1), "score": F.lit(0.5)})
    ranked = {(r.qid, r.rank): r.chunk_id for r in fusion.rerank_where_scored(hits, fusion.rerank_scores(said, pairs), 2).collect()}
    assert ranked[0, 1] == "p1" and ranked[1, 1] == "p2" and len(ranked) == 10


def test_entity_recall_by_intent(spark):
    asked = spark.createDataFrame([(0, "马尔", None), (0, "出现了", None), (1, "马尔", "first"), (2, "马尔", "last"), (3, "出现了", None), (4, "马尔", None), (4, "马尔", None)], "qid long, name string, intent string")
    names = spark.createDataFrame([("马尔", 2.0)], "name string, idf double")
    rows = [("马尔", f"p{k}_c0", k, 4, k) for k in range(1, 31)] + [("马尔", "x", 0, 9, 31), ("出现了", "p2_c0", 2, 1, 1)]
    postings = spark.createDataFrame(rows, "name string, chunk_id string, page_start int, tf int, pos int")
    got = {}
    for r in entities.recall(asked, names, postings).collect():
        got.setdefault(r.qid, {})[r.chunk_id] = r.score
    assert set(got[0]) == {f"p{k}_c0" for k in range(1, 21)} == set(got[1]) and set(got[2]) == {f"p{k}_c0" for k in range(11, 31)}
    assert got[0]["p1_c0"] == 6.0 and got[4]["p1_c0"] == 12.0 and got[3] == {"p2_c0": 2.0}
    one = spark.range(1).select(entities.intent(F.lit("他第一次出现")).alias("a"), entities.intent(F.lit("最后一次登场")).alias("b"), entities.page_of(F.lit("p12_c3"), F.lit(None).cast("int")).alias("p")).first()
    assert (one.a, one.b, one.p) == ("first", "last", 12)
    known = {r.name: r.idf for r in entities.loaded(names.unionByName(spark.createDataFrame([("的人", 3.0)], "name string, idf double")), postings).collect()}
    assert known == {"马尔": 2.0, "的人": 3.0}  # what has postings alone must be reasonable


def test_entities_join_a_ranking(spark):
    ranked = spark.createDataFrame([(1, "a", 1), (1, "b", 2)], "qid long, chunk_id string, rank int")
    recalled = spark.createDataFrame([(1, "b", 9.0, 3, "first"), (1, "c", 5.0, 9, "first")], "qid long, chunk_id string, score double, page_start int, intent string")
    got = {r.chunk_id: r.score for r in fusion.with_entities(ranked, recalled).collect()}
    assert abs(got["b"] - 0.0349814913) < 1e-9 and set(got) == {"a", "b", "c"}


STORY = [
    ("b", 1, 1, 1, "一", "马尔·福伊，站在门口。"), ("b", 2, 2, 2, "一", "众人提到马尔福伊。"), ("b", 3, 3, 3, "一", "比赛开始，福伊抓住了飞贼。"), ("b", 4, 4, 4, "二", "马尔说了什么。"), ("b", 5, 5, 5, "一", "金妮的学院是格兰芬多。"), ("b", 6, 6, 6, "一", "金妮笑了。"),
]


def story(spark):
    return spark.createDataFrame([(f"p{r[1]}_c0", *r) for r in STORY], "chunk_id string, book string, doc_ord long, page_start long, page_end long, chapter string, text string")


def test_aliases_and_first_appearance(spark):
    asked = temporal.aliases(spark.createDataFrame([(1, "马尔"), (2, "无人")], "qid long, name string"), story(spark))
    got = {r.qid: (r.aliases, r.alias) for r in asked.collect()}
    assert got[1] == (["福伊", "马尔"], "福伊") and got[2] == (["无人"], None)
    first = temporal.first_appearance(asked, story(spark)).collect()
    assert [(r.qid, r.doc_ord, r.points) for r in first] == [(1, 3, 7)]
    near = temporal.around(temporal.first_appearance(asked, story(spark)), story(spark)).orderBy("rank").collect()
    assert [r.doc_ord for r in near] == [1, 2, 3, 5]


def test_retrieval_of_first_appearances(spark):
    hits = Engine().retrieve(q(spark, "马尔第一次出场是在哪里？", "金妮的学院是什么"), story(spark)).collect()
    early = sorted((r for r in hits if r.qid == 0), key=lambda r: r["rank"])
    assert [r.chunk_id for r in early] == ["p1_c0", "p2_c0", "p3_c0", "p5_c0"] and {r.strategy for r in early} == {"temporal_first_mention_scan"} and early[0].alias_hint == "马尔=福伊"
    rest = [r for r in hits if r.qid == 1]
    assert rest and min(rest, key=lambda r: r["rank"]).chunk_id == "p5_c0" and all(r.strategy.startswith("auto_ratio") for r in rest)
    assert all(r.bm25_score > 0 for r in rest if r["rank"] == 1)


def test_retrieval_through_all_channels(spark):
    embed = lambda c: vector.hashed_embedding(c, 16)
    chunks = story(spark)
    vectors = chunks.select("chunk_id", embed(F.col("text")).alias("vec"))
    names = spark.createDataFrame([("金妮", 1.5)], "name string, idf double")
    postings = spark.createDataFrame([("金妮", "p6_c0", 6, 1, 1)], "name string, chunk_id string, page_start int, tf int, pos int")
    asked = q(spark, "金妮的学院是什么", "初次见面说了什么")
    hits = Engine(embed=embed).retrieve(asked, chunks, vectors, rerank=True, names=names, postings=postings).collect()
    assert {"p5_c0", "p6_c0"} <= {r.chunk_id for r in hits if r.qid == 0} and any(r.vector_score != 0 for r in hits)
    assert {r.strategy for r in hits if r.qid == 1} == {"temporal_position"}
    order = [int(r.chunk_id[1]) for r in sorted((r for r in hits if r.qid == 1), key=lambda r: r["rank"])]
    assert order == sorted(order)
    assert Engine(embed=embed, min_score=2.0).retrieve(asked.filter("qid = 0"), chunks, vectors).count() == 0
    assert Engine(embed=embed).retrieve(asked.filter("qid = 0"), chunks, vectors, min_overlap=99, overlap_max_score=2.0).count() == 0
    plain = Engine(embed=embed, alpha=None).retrieve(q(spark, "比赛"), chunks, vectors).collect()
    assert plain and all(abs(r.score - r.vector_score) < 1e-9 and r.strategy.startswith("auto_delta") for r in plain)


def test_answers(spark):
    asked = q(spark, "金妮的学院分别是什么", "谁是 飞贼", "天气如何", "没有", "你好")
    names = spark.createDataFrame([("金妮",)], "name string")
    hits = [(0, "p5_c0", 1.0, 1, 5, 5, "一", STORY[4][5]), (1, "p3_c0", 1.0, 1, 3, 3, "", STORY[2][5]), (2, "p6_c0", 1.0, 1, 6, 7, "", STORY[5][5]), (4, "p6_c0", 1.0, 1, 6, 6, "", "片段内容")]
    table = spark.createDataFrame(hits, "qid long, chunk_id string, score double, rank int, page_start int, page_end int, chapter string, text string")
    got = {r.qid: (r.answer, r.way) for r in Engine().answer(asked, table, names=names).collect()}
    assert got[0] == ("金妮：金妮的学院：格兰芬多", "structured")
    assert got[1][1] == "list" and got[1][0].startswith("1) ") and "关键描写/情节：比赛开始，福伊抓住了飞贼。" in got[1][0]
    assert got[2] == ("相关内容如下：\n\n来源1）金妮笑了。", "snippets") and got[3] == ("无法回答", "none")
    seen = {}

    def provider(rows):
        seen.update({r.qid: r.evidence for r in rows.collect()})
        return rows.select("qid", F.when(F.col("qid") == 2, "根据资料，今天晴。").otherwise("无法确认。").alias("reply"))

    got = {r.qid: (r.answer, r.way) for r in Engine().answer(asked, table, provider, names=names).collect()}
    assert got[2] == ("今天晴。", "provider") and got[4][1] == "snippets"
    assert seen[2] == "[来源1]（页码 6-7）：\n金妮笑了。" and set(seen) == {2, 4}  # what has an answer by rule isn't asked


def test_bridge_and_clean_style(spark):
    one = lambda t, f: spark.createDataFrame([(t,)], "text string").select(f(F.col("text")).alias("x")).first()["x"]
    assert one("根据参考信息，甲是乙。资料中没有提到丙。", evidence.clean_style) == "甲是乙。"
    assert one("   关键描写/情节：原文如此。", evidence.clean_style) == "关键描写/情节：原文如此。"
    assert one("小说写得好。", evidence.clean_style) == "写得好。"
    assert one("见 [a] 和 [b] 及 [a]", lambda c: F.to_json(evidence.numbered(c))) == '[{"id":"a","no":1},{"id":"b","no":2}]'
    rows = spark.createDataFrame([(1, "Q {context}", "E {query}")], "qid long, text string, evidence string")
    assert evidence.prompts(rows, "A {query} B {context} C").first().prompt == "A Q {context} B E {query} C"


def test_noise_of_targets(spark):
    got = [r.x for r in spark.createDataFrame([("谁",), ("什么",), ("12",), ("哈利",)], "t string").select(understand.is_noise(F.col("t")).alias("x")).collect()]
    assert got == [True, True, True, False]
