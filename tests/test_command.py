"""Settings of a session, books that are too poor, and the command line."""

import pytest

from foliospark.__main__ import main
from foliospark.conf import EngineConf, configured
from foliospark.operators import prep
from foliospark.plans.engine import Engine
from foliospark.sources import files
from foliospark.streaming import ingest


def test_settings_of_a_session(spark):
    assert configured(spark, {}) == EngineConf()
    spark.conf.set("spark.foliospark.overlap_units", "0")
    spark.conf.set("spark.foliospark.min_score", "0.25")
    try:
        got = configured(spark, {"FOLIOSPARK_TOP_K": "7", "FOLIOSPARK_OVERLAP_UNITS": "3", "FOLIOSPARK_ALPHA": "none", "FOLIOSPARK_RETRY_ON_ABSTAIN": "false"})
        assert (got.overlap_units, got.min_score, got.top_k, got.alpha, got.retry_on_abstain) == (0, 0.25, 7, None, False)
        for bad in ({"FOLIOSPARK_TOP_K": "many"}, {"FOLIOSPARK_TOP_K": "none"}, {"FOLIOSPARK_RETRY_ON_ABSTAIN": "perhaps"}):
            with pytest.raises(ValueError, match="can't be"):
                configured(spark, bad)
    finally:
        for name in ("overlap_units", "min_score"):
            spark.conf.unset(f"spark.foliospark.{name}")


def test_poor_books_are_refused(spark):
    good = [("good", k, "字" * 500) for k in range(6)]
    pages = spark.createDataFrame([*good, ("poor", 1, "short")], "book string, page_no int, text string")
    with pytest.raises(ValueError, match="poor .1 pages, 5 characters"):
        prep.required(pages)
    assert prep.required(pages.filter("book = 'good'")).count() == 6
    with pytest.raises(ValueError, match="no pages"):
        prep.required(pages.limit(0))
    with pytest.raises(ValueError, match="poor"):
        Engine().ingest(pages, strict=True)


def test_ingest_of_a_folder(spark, tmp_path, monkeypatch):
    src, out = tmp_path / "books", str(tmp_path / "out")
    src.mkdir()
    for name in ("one", "two"):
        pages = ["".join(f"哈利波特和赫敏在学院里学习第{k * 20 + j}种魔法，{name}。\n" for j in range(20)) for k in range(1, 4)]
        (src / f"{name}.txt").write_text("\f".join(pages))
    made = main(["ingest", str(src), out, "--text", "--chunk-only"], spark)
    chunks = files.read_books(spark, f"{out}/chunks")
    assert made["chunks"] == chunks.count() > 3 and made["state"] is None and {r.book for r in chunks.select("book").distinct().collect()} == {"one.txt", "two.txt"}
    names, postings = files.read_entity_index(spark, f"{out}/entities")
    assert made["names"] == names.count() and postings.count() >= names.count()
    with pytest.raises(ValueError):
        main(["ingest", str(src), out, "--text", "--chunk-only", "--strict"], spark)
    with pytest.raises(SystemExit):
        main(["ingest", str(src), out, "--text"], spark)

    import sys
    import types

    provider = types.ModuleType("own_provider")
    provider.embed = lambda rows: [[float(len(r["text"])), 1.0] for r in rows]
    monkeypatch.setitem(sys.modules, "own_provider", provider)
    vectors = ["ingest", str(src), out, "--text", "--provider", "own_provider:embed", "--dims", "2", "--model", "m"]
    first, second = main(vectors, spark)["state"], main(vectors, spark)["state"]
    assert first["embedded"] == first["total"] > 0 and second["embedded"] == 0 and second["reused"] == first["total"]
    assert main([*vectors, "--no-resume"], spark)["state"]["reused"] == 0
    assert ingest.vectors_of(files.read_books(spark, f"{out}/chunks"), f"{out}/store", "m").count() == made["chunks"]
