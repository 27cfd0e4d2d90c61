"""Files in and out, and streams that resume."""

import json

from foliospark.sources import files
from foliospark.streaming import jobs


def test_sources(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"chunk_id": "p1_c0", "page_start": 1, "page_end": 1, "chapter": "", "text": "a"}\n\n{"chunk_id": "p1_c0", "page_start": 1, "page_end": 2, "chapter": "", "text": "b"}\n')
    assert [(r.chunk_id, r.text) for r in files.read_chunks(spark, str(tmp_path / "c.json")).collect()] == [("p1_c0", "b")]
    (tmp_path / "q.json").write_text('{"question": "x"}\n')
    r = files.read_questions(spark, str(tmp_path / "q.json")).first()
    assert (r.qid, r.gold, r.k, r.mode) == ("", [], 8, "retrieve_only")
    (tmp_path / "a.json").write_text(json.dumps({" 甲 ": ["乙", ""], "x": []}, ensure_ascii=False, indent=2))
    assert [(r.phrase, r.entities) for r in files.read_aliases(spark, str(tmp_path / "a.json")).collect()] == [("甲", ["乙"])]
    (tmp_path / "book.txt").write_text("one\nmore\ftwo\f")
    assert [(r.page_no, r.text) for r in files.read_pages(spark, str(tmp_path / "book.txt")).orderBy("page_no").collect()] == [(1, "one\nmore"), (2, "two")]


def test_streams_add_each_record_once(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "1.json").write_text('{"chunk_id": "a", "text": "x"}\n{"chunk_id": "b", "text": "y"}\n')
    go = lambda: jobs.embed_new_chunks(spark, str(src), str(tmp_path / "v"), str(tmp_path / "cp"), lambda ts: [[1.0, 0.0]] * len(ts), 2).awaitTermination()
    go()
    (src / "2.json").write_text('{"chunk_id": "b", "text": "y"}\n{"chunk_id": "c", "text": "z"}\n')
    go()
    assert sorted(r.chunk_id for r in spark.read.parquet(str(tmp_path / "v")).collect()) == ["a", "b", "c"]
    (src / "3.json").write_text("")
    jobs.audit_log(spark, str(src), str(tmp_path / "audit"), str(tmp_path / "cp2")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "audit")).count() == 4


def test_records_that_arrive_again_add_nothing(spark, tmp_path):
    src, sink = tmp_path / "in", str(tmp_path / "log")
    src.mkdir()
    line = lambda ts, user, mode: json.dumps({"ts": ts, "username": user, "query": "q", "mode": mode, "chunk_ids": ["p1_c0"]}) + "\n"
    go = lambda: jobs.audit_once(spark, str(src), sink, str(tmp_path / "cp")).awaitTermination()
    first = line("2024-01-01T10:00:00Z", "a", "rag") + line("2024-01-01T10:00:00.000001Z", "a", "rag") + line("2024-01-01T11:00:00Z", "b", "rag")
    (src / "1.json").write_text(first)
    go()
    (src / "2.json").write_text(first + line("2024-01-02T09:00:00Z", "a", "retrieve_only") * 2)
    go()
    go()
    rows = spark.read.parquet(sink)
    assert rows.count() == 4 and rows.columns == ["ts", "username", "query", "mode", "top_k", "chunk_ids", "retrieval"]
    assert sorted(map(tuple, jobs.audit_rollup(spark, sink).collect())) == [("2024-01-01", "rag", 3, 2), ("2024-01-02", "retrieve_only", 1, 1)]
