"""Replies cut into pieces at random against the cleaning of whole texts."""

import json
import random

from pyspark.sql import functions as F

from foliospark.operators import evidence
from foliospark.streaming import replies

TEXTS = [
    "根据原文，他来了。她走了！\n资料中没有提到他的去向。最后，书中说他们回家？完", "无法回答", "信息不足，无法确认。", "1) 甲\n   关键描写/情节：原文说他来了。\n   简短总结：他来。", "", " \n ", "从片段里，可以看到。 原文 。无法从资料得出结论。", "没有标点的一句", "。。。！\n\n", "Plain text. No marks here\nSecond line",
]


def cut(rng, text):
    at = sorted(rng.randint(0, len(text)) for _ in range(rng.randint(0, 9)))
    return [text[a:b] for a, b in zip([0, *at], [*at, len(text)])]


def test_sentences_are_cleaned_as_whole_texts_are(spark):
    table = spark.createDataFrame(list(enumerate(TEXTS)), "k long, t string").select("k", "t", evidence.clean_style(F.col("t")).alias("c"), (evidence.is_refusal(evidence.clean_style(F.col("t"))) | (evidence.clean_style(F.col("t")) == evidence.NO_ANSWER)).alias("r"))
    import re

    for r in table.collect():
        parts = re.split(r"(?<=[。！？\n])", r.t)
        assert "".join(map(replies.clean_sentence, parts)) == r.c, r.t
        assert replies.refused(r.c) == r.r


def test_any_cut_of_a_reply_gives_the_cleaned_text(spark, tmp_path):
    rng, src, files = random.Random(9), tmp_path / "in", [[], [], []]
    src.mkdir()
    whole = {q: TEXTS[q % len(TEXTS)] for q in range(40)}
    for q, text in whole.items():
        pieces = cut(rng, text)
        for n, p in enumerate(pieces):
            row = {"qid": q, "seq": n, "delta": p, "last": n == len(pieces) - 1}
            for _ in range(rng.choice([1, 1, 2])):  # some arrive twice, and in any order
                files[rng.randrange(3)].append(row)
    start = lambda: replies.cleaned(spark.readStream.schema(replies.PIECE).json(str(src))).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    for k, rows in enumerate(files):
        rng.shuffle(rows)
        (src / f"{k}.json").write_text("".join(json.dumps(r) + "\n" for r in rows))
        start()  # each time anew from the checkpoint
    want = {r.k: r.c for r in spark.createDataFrame(list(whole.items()), "k long, t string").select("k", evidence.clean_style(F.col("t")).alias("c")).collect()}
    got = {}
    for r in spark.read.parquet(str(tmp_path / "out")).orderBy("qid", "no").collect():
        got.setdefault(r.qid, []).append(r)
    assert set(got) == set(whole)
    for q, rows in got.items():
        assert [r.no for r in rows] == list(range(len(rows))) and [r.kind for r in rows[:-1]] == ["delta"] * (len(rows) - 1)
        assert "".join(r.text for r in rows[:-1]) == want[q] == rows[-1].text
        assert rows[-1].kind == ("refused" if replies.refused(want[q]) else "done")
