"""Providers that fail, stall and answer in part; embedding that is killed and goes on."""

import json
import threading
import time
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from foliospark.operators import fusion, providers
from foliospark.operators.providers import Policy, Refused
from foliospark.streaming import ingest

QUICK = Policy(batch=4, timeout=0.5, attempts=3, backoff=0.01, concurrency=2)


def rows(spark, n):
    return spark.createDataFrame([(k, f"text {k}") for k in range(n)], "qid long, text string")


def test_pauses_grow_to_a_bound():
    assert [providers.pause(k, Policy()) for k in range(1, 7)] == [1, 2, 4, 8, 15, 15]


def test_partial_answers_are_asked_for_the_rest_only():
    seen = []

    def call(batch):
        seen.append([r["qid"] for r in batch])
        return [None if r["qid"] == 2 or (r["qid"] == 1 and len(seen) < 2) else r["qid"] * 10 for r in batch]

    got = providers.answered(call, [{"qid": k} for k in range(4)], QUICK)
    assert got == [(0, None, 1), (10, None, 2), (None, "no_reply", 3), (30, None, 1)]
    assert seen == [[0, 1, 2, 3], [1, 2], [2]]


@pytest.mark.parametrize(
    "error,status,calls",
    [(ConnectionResetError(), "http_unreachable:ConnectionResetError", 3), (Refused("policy"), "refused:policy", 1), (ValueError("x"), "failed:ValueError", 3), (providers.urllib.error.HTTPError("u", 503, "", {}, None), "http_error:503", 3), (providers.urllib.error.HTTPError("u", 401, "", {}, None), "http_error:401", 1), (json.JSONDecodeError("a", "b", 0), "parse_error", 3)],
)
def test_errors_become_statuses(error, status, calls):
    n = []

    def call(batch):
        n.append(1)
        raise error

    assert providers.answered(call, [{}], QUICK) == [(None, status, calls)] and len(n) == calls


def test_wrong_numbers_and_shapes_of_replies():
    assert providers.answered(lambda b: [1], [{}, {}], QUICK) == [(None, "bad_format", 3)] * 2
    assert providers.answered(lambda b: "ab", [{}, {}], QUICK) == [(None, "bad_format", 3)] * 2
    assert providers.answered(lambda b: [[1], [1, 2]], [{}, {}], QUICK, lambda v: None if len(v) == 2 else "bad_dims") == [(None, "bad_format", 3), ([1, 2], None, 1)]


def test_stalled_calls_are_left_and_counted():
    assert providers.stalled().n == 0
    go, n = threading.Event(), []

    def call(batch):
        n.append(1)
        go.wait(5)
        return [1]

    policy = Policy(timeout=0.05, attempts=2, backoff=0.0, stalled_most=3)
    assert providers.answered(call, [{}], policy) == [(None, "timeout", 2)]
    assert providers.answered(call, [{}], policy) == [(None, "provider_stalled", 1)] and len(n) == 3
    go.set()
    time.sleep(0.3)
    assert providers.stalled().n == 0 and providers.answered(lambda b: [1], [{}], policy) == [(1, None, 1)]


def test_only_so_many_calls_at_a_time_and_in_order():
    now, most, lock = [0], [0], threading.Lock()

    def call(batch):
        with lock:
            now[0] += 1
            most[0] = max(most[0], now[0])
        time.sleep(0.02)
        with lock:
            now[0] -= 1
        return [r["k"] for r in batch]

    got = list(providers._in_flight(((k, [{"k": k}]) for k in range(12)), call, Policy(concurrency=3), None))
    assert [(k, r[0][0]) for k, r in got] == [(k, k) for k in range(12)] and 1 < most[0] <= 3


def test_rows_keep_their_columns_and_dead_letters_are_asked_again(spark):
    def call(batch):
        if any(r["qid"] == 5 for r in batch):
            raise Refused("five")
        return [None if r["qid"] == 0 else r["text"].upper() for r in batch]

    table = rows(spark, 10).coalesce(1)
    done = providers.asked(table, call, "string", QUICK)
    got = {r.qid: (r.text, r.reply, r.status, r.attempts) for r in done.collect()}
    assert len(got) == 10 and got[1] == ("text 1", "TEXT 1", None, 1) and got[0][1:] == (None, "no_reply", 3)
    assert {k for k in got if got[k][2] == "refused:five"} == {4, 5, 6, 7}
    dead = providers.dead_letters(done)
    assert sorted(r.qid for r in dead.collect()) == [0, 4, 5, 6, 7]
    again = providers.asked(dead.drop("status", "attempts"), lambda b: ["ok"] * len(b), "string", QUICK)
    assert again.filter("reply = 'ok' and status is null").count() == 5
    assert providers.asked(table.limit(0), call, "string", QUICK).count() == 0


class Handler(BaseHTTPRequestHandler):
    hits = 0

    def do_POST(self):  # noqa: N802
        Handler.hits += 1
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        if body["query"] == "broken":
            code, out = 200, b"{no json"
        elif body["query"] == "denied":
            code, out = 403, b"{}"
        elif body["query"] == "busy" and Handler.hits % 2:
            code, out = 503, b"{}"
        else:
            code, out = 200, json.dumps({"scores": [{"chunk_id": p["chunk_id"], "score": len(p["text"])} for p in body["passages"][:1]]}).encode()
        self.send_response(code)
        self.end_headers()
        self.wfile.write(out)

    def log_message(self, *_):
        pass


def test_reranking_over_http(spark):
    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    call = providers.http_json(f"http://127.0.0.1:{server.server_port}/rerank", lambda b: {"query": b[0]["question"], "passages": b[0]["passages"]}, lambda got, b: [{x["chunk_id"]: x["score"] for x in got["scores"]}], timeout=5)
    pairs = spark.createDataFrame([(k, c, q, t) for k, q in enumerate(("fine", "broken", "denied", "busy")) for c, t in (("p1", " a\r\n" * 900), ("p2", "b"))], "qid long, chunk_id string, question string, text string").coalesce(1)
    got = {(r.qid, r.chunk_id): (r.rerank_score, r.status) for r in providers.reranked_pairs(pairs, call, Policy(batch=1, attempts=3, backoff=0.01, concurrency=1)).collect()}
    server.shutdown()
    assert got[0, "p1"] == (1.0, None) and got[0, "p2"] == (0.0, None) and got[3, "p1"] == (1.0, None)
    assert got[1, "p1"] == (None, "parse_error") and got[2, "p2"] == (None, "http_error:403")
    scored = spark.createDataFrame([(k, c, s) for (k, c), (s, _) in got.items()], "qid long, chunk_id string, rerank_score double")
    hits = pairs.select("qid", "chunk_id", F.when(F.col("chunk_id") == "p1", 2).otherwise(1).alias("rank"), F.lit(0.5).alias("score"))
    first = {r.qid: r.chunk_id for r in fusion.rerank_where_scored(hits, scored, 1).collect()}
    assert first == {0: "p1", 1: "p2", 2: "p2", 3: "p1"}
    gone = providers.http_json("http://127.0.0.1:9/x", lambda b: {}, lambda got, b: [1], timeout=2)
    assert providers.answered(gone, [{}], QUICK)[0][1] == "http_unreachable:URLError"


# --- ingest


def embedder(folder, dims=2, bad=()):
    """Counts, in files, how often each text was embedded; fails on request."""
    folder = str(folder)

    def call(batch):
        import os
        import uuid

        if any(r["text"] in bad for r in batch):
            raise ConnectionError
        for r in batch:
            os.makedirs(f"{folder}/{r['digest']}", exist_ok=True)
            open(f"{folder}/{r['digest']}/{uuid.uuid4().hex}", "w").close()
        return [[float(len(r["text"]))] * dims for r in batch]

    return call


def counts(folder):
    return {p.name: len(list(p.iterdir())) for p in folder.iterdir()} if folder.exists() else {}


def chunks(spark, *texts):
    return spark.createDataFrame([(f"c{k}", t) for k, t in enumerate(texts)], "chunk_id string, text string")


def test_texts_are_embedded_once(spark, tmp_path):
    store, seen = str(tmp_path / "store"), tmp_path / "seen"
    assert ingest.state(spark, store, "m") is None
    first = ingest.embed_new(chunks(spark, "a", "b", "a", None, ""), store, embedder(seen), "m", 2, QUICK)
    assert (first["total"], first["embedded"], first["reused"], first["done"]) == (3, 3, 0, True)
    again = ingest.embed_new(chunks(spark, "a", "b", "c"), store, embedder(seen), "m", 2, QUICK)
    assert (again["total"], again["embedded"], again["reused"], again["units"]) == (3, 1, 2, 1)
    assert set(counts(seen).values()) == {1} and len(counts(seen)) == 4
    nothing = ingest.embed_new(chunks(spark, "c", "a"), store, embedder(seen), "m", 2, QUICK)
    assert nothing["done"] and nothing["units"] == 0 and set(counts(seen).values()) == {1}
    changed = ingest.embed_new(chunks(spark, "a changed"), store, embedder(seen), "m", 2, QUICK)
    other = ingest.embed_new(chunks(spark, "a", "b"), store, embedder(tmp_path / "other", 3), "m2", 3, QUICK)
    assert changed["embedded"] == 1 and other["embedded"] == 2 and ingest.state(spark, store, "m")["run"] == changed["run"]
    got = {r.chunk_id: list(r.vec) for r in ingest.vectors_of(chunks(spark, "a", "a changed", "zz", None), store, "m").collect()}
    assert got == {"c0": [1.0, 1.0], "c1": [9.0, 9.0], "c3": [0.0, 0.0]}


def test_a_killed_run_goes_on_where_it_stopped(spark, tmp_path, monkeypatch):
    store, seen, texts = str(tmp_path / "store"), tmp_path / "seen", [f"text {k}" for k in range(30)]
    real, n = ingest.asked, []

    def dies(*a):
        n.append(1)
        if len(n) == 3:
            raise KeyboardInterrupt
        return real(*a)

    monkeypatch.setattr(ingest, "asked", dies)
    with pytest.raises(KeyboardInterrupt):
        ingest.embed_new(chunks(spark, *texts), store, embedder(seen), "m", 2, QUICK, unit_rows=7)
    half = ingest.state(spark, store, "m")
    assert half["committed"] == 2 and half["units"] == 5 and not half["done"] and 0 < half["embedded"] < 30
    monkeypatch.setattr(ingest, "asked", real)
    whole = ingest.embed_new(chunks(spark, *texts), store, embedder(seen), "m", 2, QUICK, unit_rows=7)
    assert whole["done"] and whole["reused"] == half["embedded"] and whole["embedded"] + whole["reused"] == 30
    assert len(counts(seen)) == 30 and set(counts(seen).values()) == {1}
    assert ingest.vectors_of(chunks(spark, *texts), store, "m").count() == 30


def test_what_fails_is_put_aside_and_asked_again(spark, tmp_path):
    store, seen = str(tmp_path / "store"), tmp_path / "seen"
    texts = chunks(spark, *[f"text {k}" for k in range(9)])
    one = Policy(batch=1, timeout=5, attempts=2, backoff=0.0)
    state = ingest.embed_new(texts, store, embedder(seen, bad=("text 4",)), "m", 2, one)
    assert (state["embedded"], state["failed"], state["done"]) == (8, 1, True)
    assert [(r.status, r.attempts) for r in ingest.failed_of(spark, store, "m").collect()] == [("http_unreachable:ConnectionError", 2)]
    wrong = ingest.embed_new(texts, store, embedder(tmp_path / "w", dims=5), "m", 2, one)
    assert (wrong["embedded"], wrong["failed"]) == (0, 1) and ingest.failed_of(spark, store, "m").count() == 1
    state = ingest.embed_new(texts, store, embedder(seen), "m", 2, one)
    assert (state["embedded"], state["failed"], state["reused"]) == (1, 0, 8)
    assert ingest.failed_of(spark, store, "m").count() == 0 and ingest.vectors_of(texts, store, "m").count() == 9


def test_stream_into_a_store(spark, tmp_path):
    src, store, seen = tmp_path / "in", str(tmp_path / "store"), tmp_path / "seen"
    src.mkdir()
    go = lambda cp: ingest.embed_stream(spark, str(src), store, str(tmp_path / cp), embedder(seen), "m", 2, QUICK).awaitTermination()
    (src / "1.json").write_text('{"chunk_id": "a", "text": "x"}\n{"chunk_id": "b", "text": "y"}\n')
    go("cp")
    (src / "2.json").write_text('{"chunk_id": "b", "text": "y, changed"}\n{"chunk_id": "c", "text": "x"}\n')
    go("cp")
    go("lost")  # a lost checkpoint reads all files again
    assert len(counts(seen)) == 3 and set(counts(seen).values()) == {1}
