"""Names in texts: the packed automaton, its shards, stored indexes and what questions are about, against looking everywhere."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliospark.operators import automaton, entities, evidence, planning, spotting, temporal
from foliospark.sources import files


def everywhere(names, texts):
    return sorted((t, i, k) for t, x in enumerate(texts) for k, n in enumerate(names) for i in range(len(x) - len(n) + 1) if x.startswith(n, i))


def leftmost_longest(names, text, most):
    out, i = [], 0
    while i < len(text) and len(out) < most:
        best = max((n for n in names if text.startswith(n, i)), key=len, default=None)
        if best:
            out.append((best, i + 1))
        i += len(best or "x")
    return out


def cases(n, seed=1):
    rng = random.Random(seed)
    for _ in range(n):
        letters = rng.choice(["a", "ab", "abc", "哈利波a😀\0", "abcdefgh"])
        names = sorted({"".join(rng.choices(letters, k=rng.randint(1, rng.choice([3, 9])))) for _ in range(rng.randint(1, 40))})
        rng.shuffle(names)
        yield names, ["".join(rng.choices(letters + "z", k=rng.randint(0, rng.choice([5, 60, 900])))) for _ in range(rng.randint(0, 7))], rng.randint(1, 5)


def test_automaton_against_looking_everywhere(monkeypatch):
    for lanes, lane in ((8192, 256), (3, 1)):
        monkeypatch.setattr(automaton, "LANES", lanes)
        monkeypatch.setattr(automaton, "LEAST_LANE", lane)
        for names, texts, most in cases(150, lanes):
            a = automaton.Automaton(names)
            found = list(zip(*(x.tolist() for x in a.find(texts))))
            assert sorted(found) == everywhere(names, texts)
            assert found == sorted(found, key=lambda x: (x[0], x[1], len(names[x[2]])))
            assert [(t, names[k], s + 1) for t, s, k in a.longest_first(texts, most)] == [(t, *x) for t, text in enumerate(texts) for x in leftmost_longest(names, text, most)]


def test_automaton_is_arrays_of_bounded_size():
    names = [f"name {k} of many" for k in range(5000)]
    a = automaton.Automaton(names)
    held = [v for v in vars(a).values() if not isinstance(v, (int, np.integer))]
    assert all(isinstance(v, np.ndarray) for v in held)
    assert sum(v.nbytes for v in held) <= automaton.BYTES_A_CHARACTER * sum(map(len, names))


def test_automaton_of_nothing():
    assert automaton.Automaton([]).longest_first(["abc", ""], 3) == [] and automaton.Automaton(["a"]).longest_first([], 3) == []


@pytest.mark.parametrize("most_bytes", [128 << 20, 700])
def test_spotted_and_mentions_in_any_number_of_shards(spark, monkeypatch, most_bytes):
    monkeypatch.setattr(spotting, "BROADCAST_BYTES", most_bytes)
    monkeypatch.setattr(spotting, "RETURNED", 40)
    rng = random.Random(5)
    texts = ["".join(rng.choice("abé王") for _ in range(rng.randrange(0, 30))) for _ in range(30)] + [None, ""]
    names = sorted({"".join(rng.choice("abé王") for _ in range(rng.randrange(1, 5))) for _ in range(25)})
    table = spark.createDataFrame([(k, "ABC"[k % 3] if k % 7 else None, t) for k, t in enumerate(texts)], "qid long, book string, text string")
    rows = [(n, b, [n, b or ""]) for n in [*names, ""] for b in ("A", "B", None)] + [(names[0], "A", ["again"])]
    known = spark.createDataFrame(rows, "name string, book string, more array<string>")
    assert len(list(spotting._shards(spotting.kept(known), "name"))) == (1 if most_bytes > 1000 else 1 + spotting.kept(known).agg(F.sum(F.octet_length(F.to_json(F.struct("*"))) + 64 * F.length("name"))).first()[0] // 700)
    got = sorted((r.qid, r.book, r.text, r.name, r.more) for r in spotting.spotted(table, known, on=("book",)).collect())
    books = {k: "ABC"[k % 3] if k % 7 else None for k in range(len(texts))}
    assert got == sorted((k, books[k], t, n, m) for k, t in enumerate(texts) for n, b, m in rows if n and t and n in t and b is not None and b == books[k])
    found = {}
    for r in entities.mentions(table, known.select("name"), 4).orderBy("at").collect():
        found.setdefault(r.qid, []).append((r.name, r.at))
    assert found == {k: x for k, t in enumerate(texts) if (x := leftmost_longest(names, t or "", 4))}


def test_no_text_is_shuffled(spark):
    table = spark.createDataFrame([(1, "b", 1, "some text")], "qid long, book string, doc_ord long, text string")
    names = spark.createDataFrame([(1, "text")], "qid long, name string")
    for df in (spotting.spotted(table, names.select("name")), entities.mentions(table, names)):
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    plan = temporal.aliases(names, table)._jdf.queryExecution().executedPlan().toString()
    for line in plan.splitlines():
        assert "Exchange" not in line or "text#" not in line


def test_stored_index(spark, tmp_path):
    whole = {
        "meta": {"n": 2}, "entities": [{"name": "马尔", "df": 2, "idf": 1.5}, {"name": " 的人 ", "df": 1}, "odd", {"df": 3}, {"name": ""}],
        "entity_to_chunks": {"马尔": [{"chunk_id": "p1_c0", "tf": 4, "page_start": 1}, 7, {"tf": 1}, {"chunk_id": "p2_c0", "tf": 1, "page_start": 2}], "出现了": [{"chunk_id": "p3_c0", "tf": 2}], "福伊": [{"chunk_id": "p9_c0", "tf": 1}], "x": "no list"},
    }
    path = str(tmp_path / "index.json")
    (tmp_path / "index.json").write_text(json.dumps(whole, ensure_ascii=False, indent=2))
    names, postings = files.read_entity_index(spark, path)
    assert sorted(map(tuple, names.collect()), key=str) == [("的人", 1, None), ("马尔", 2, 1.5)]
    rows = sorted(map(tuple, postings.collect()))
    assert rows == [("出现了", "p3_c0", None, 2, 1), ("福伊", "p9_c0", None, 1, 1), ("马尔", "p1_c0", 1, 4, 1), ("马尔", "p2_c0", 2, 1, 4)]
    assert {r.name: r.idf for r in entities.loaded(names, postings).collect()} == {"马尔": 1.5, "的人": 1.0, "福伊": 1.0}
    files.write_entity_index(names, postings, str(tmp_path / "tables"))
    again = files.read_entity_index(spark, str(tmp_path / "tables"))
    assert sorted(map(tuple, again[0].collect()), key=str) == sorted(map(tuple, names.collect()), key=str) and sorted(map(tuple, again[1].collect())) == rows
    assert files.read_entity_index(spark, str(tmp_path / "none")) is None
    asked = spark.createDataFrame([(1, "马尔和福伊在哪里")], "qid long, text string")
    spotted = entities.mentions(asked, entities.loaded(names, postings))
    got = {r.chunk_id: r.score for r in entities.recall(spotted, entities.loaded(names, postings), postings).collect()}
    assert got == {"p1_c0": 4.5, "p2_c0": 3.0, "p9_c0": 2.0}


def test_broken_index_is_empty(spark, tmp_path):
    (tmp_path / "i.json").write_text("{no json")
    names, postings = files.read_entity_index(spark, str(tmp_path / "i.json"))
    assert names.count() == 0 and postings.count() == 0


def test_aliases_from_a_file_to_targets(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"救世之星": ["哈利", "哈利"], " 世之 ": ["乙", " "], "odd": "text", "none": [], "": ["x"]}, ensure_ascii=False))
    aliases = files.read_aliases(spark, str(tmp_path / "a.json"))
    assert sorted((r.ord, r.phrase, r.entities) for r in aliases.collect()) == [(0, "救世之星", ["哈利", "哈利"]), (1, "世之", ["乙"])]
    asked = spark.createDataFrame([(0, "救世之星的学院是什么"), (1, "世之在哪里"), (2, "某某某在哪里")], "qid long, text string")
    got = {r.qid: r.targets for r in planning.targets(asked, None, aliases).collect()}
    assert got == {0: ["哈利"], 1: ["乙"], 2: ["某某某在哪里"]}


def test_what_questions_about_first_appearances_name(spark):
    names = spark.createDataFrame([("马尔",), ("做什么",), ("福伊",)], "name string")
    asked = spark.createDataFrame([(0, "马尔福第一次出现在哪里"), (1, "第一次出现的马尔和福伊"), (2, "最早登场做什么"), (3, "最早登场 某某 做了"), (4, "")], "qid long, text string")
    got = {r.qid: r.names for r in temporal.named(asked, names).collect()}
    assert got == {0: ["马尔福"], 1: ["马尔", "福伊"], 2: ["做什么"], 3: ["最早登场", "某某"], 4: []}
    plain = {r.qid: r.names for r in temporal.named(asked).collect()}
    assert plain[0] == ["马尔福"] and plain[1] == ["第一次出现的马尔和福"[:10]]


def test_arms_are_compared_over_all_questions(spark):
    q = spark.createDataFrame([(1,), (2,), (3,)], "qid long")
    rows = lambda *x: spark.createDataFrame(list(x), "qid long, chunk_id string, rank int")
    arms = {"none": rows((1, "a", 1), (2, "x", 1), (2, "b", 2)), "expand": rows((1, "z", 1), (1, "a", 4), (3, "c", 9)), "empty": rows((9, "a", 1)).limit(0)}
    gold = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "qid long, chunk_id string")
    got = {r.config: (r.n, r.hit_rate, r.mrr) for r in evidence.ab_grid(q, arms, gold, 8).collect()}
    assert got == {"none": (3, 0.666667, 0.5), "expand": (3, 0.333333, 0.083333), "empty": (3, 0.0, 0.0)}
