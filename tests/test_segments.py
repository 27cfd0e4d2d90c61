"""An index that is kept up to date against one that is made anew."""

import random

import pytest

from foliospark.operators import lexical, segments


def test_search_after_any_changes_equals_a_new_index(spark, tmp_path):
    rng = random.Random(8)
    text = lambda: " ".join(f"w{rng.randint(0, 9)}" for _ in range(rng.randint(0, 8)))
    frame = lambda rows: spark.createDataFrame(rows, "chunk_id long, text string")
    asked = spark.createDataFrame([(1, "w1 w2 w3"), (2, "w4"), (3, "w0 w9 none"), (4, "")], "qid long, text string")
    store, live = segments.Store(spark, str(tmp_path / "index")), {}

    def same():
        got = sorted(map(tuple, store.search(asked, 6).collect()))
        return got == sorted(map(tuple, lexical.search(asked, frame(sorted(live.items())), 6).collect()))

    for step in range(7):
        if step in (2, 5):
            gone = rng.sample(sorted(live), 5) + [999]
            store.delete(frame([(k, "") for k in gone]))
            for k in gone:
                live.pop(k, None)
        elif step == 4:
            assert store.compact()["segments"][0]["kind"] == "rows"
        else:
            new = {rng.randint(0, 30): text() for _ in range(14)}
            store.add(frame(sorted(new.items())))
            live |= new
        if step in (0, 2, 4, 6):
            assert same(), step
    df, n, avgdl = store.statistics()
    want = lexical.keep(frame(sorted(live.items())))
    total = lexical.corpus(want).first()
    assert (n, round(avgdl, 9)) == (total.n, round(total.avgdl, 9))
    terms = [t for r in want.collect() for t in r.terms]
    assert {r.term: r.df for r in df.collect()} == {t: terms.count(t) for t in terms}
    assert store.version()["version"] == 7


def test_versions(spark, tmp_path):
    store = segments.Store(spark, str(tmp_path / "index"))
    assert store.version()["version"] == 0
    with pytest.raises(ValueError):
        store.rows()
    store.add(spark.createDataFrame([(1, "a"), (1, "a"), (2, None)], "chunk_id long, text string"))
    assert store.rows().count() == 2
    seen = store.version()
    store._write(lexical.index(spark.createDataFrame([(3, "lost")], "chunk_id long, text string")), "rows")  # a writer that died before its version
    assert store.version() == seen and store.rows().count() == 2
    with pytest.raises(RuntimeError):
        store._commit([], 9, seen["version"] - 1)
    store.delete(spark.createDataFrame([(1,)], "chunk_id long"))
    store.add(spark.createDataFrame([(1, "again")], "chunk_id long, text string"))
    assert {r.chunk_id: r.terms for r in store.rows().collect()} == {1: ["again"], 2: []}
