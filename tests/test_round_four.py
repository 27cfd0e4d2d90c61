"""What the fourth round of findings was about: texts are cut and embedded once, few rows meet texts where these are."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from foliospark.conf import EngineConf
from foliospark.functions.text import tokens
from foliospark.operators import automaton, entities, spotting, vector
from foliospark.plans.engine import Engine


def test_hashes_are_those_of_spark(spark):
    rng = random.Random(4)
    words = [*("".join(rng.choices("abXY09哈利é😀", k=n)) for n in [*range(90), 300]), ""]
    want = [r[0] for r in spark.createDataFrame(list(enumerate(words)), "k int, w string").orderBy("k").select(F.xxhash64("w")).collect()]
    assert vector.xxhash64(pa.array(words)).tolist() == want
    assert vector.xxhash64(pa.array(words)[7:40]).tolist() == want[7:40] and not len(vector.xxhash64(pa.array([], pa.string())))


def test_embedding_cuts_texts_once(spark, monkeypatch):
    """Sums over the tokens of each text, as a plain expression has them, but not once for each of the vector's numbers."""
    rng = random.Random(5)
    texts = [None, "", " ,。", *("".join(rng.choices("哈利波 aB1é,\n", k=rng.choice([1, 9, 60]))) for _ in range(80))]
    table = spark.createDataFrame(list(enumerate(texts)), "k int, t string").repartition(3)
    signs = F.transform(tokens(F.col("t")), lambda x: F.struct(F.pmod(F.xxhash64(x), F.lit(7)).alias("i"), F.when(F.pmod(F.shiftright(F.xxhash64(x), 8), F.lit(2)) == 0, 1.0).otherwise(-1.0).alias("s")))
    got = table.select("k", signs.alias("signs"), vector.hashed_embedding(F.col("t"), 7).alias("v"))
    for r in got.collect():
        assert r.v == [sum(x.s for x in r.signs if x.i == i) for i in range(7)]
    assert "aggregate(" not in table.select(vector.hashed_embedding(F.col("t"), 7))._jdf.queryExecution().optimizedPlan().toString()


def test_vectors_are_made_once(spark):
    """Retrieval reads the vectors once, for the vector ranking and for the fused one; so does a question's own vector."""
    made = {"chunks": spark.sparkContext.accumulator(0), "questions": spark.sparkContext.accumulator(0)}

    def embed(of):
        count = made[of]

        @F.udf("array<double>")
        def one(text):
            count.add(1)
            return [float(len(text)), 1.0, float(text.count("a"))]

        return one

    chunks = spark.createDataFrame([(k, f"a word {k} of {'many ' * (k % 5)}") for k in range(40)], "chunk_id long, text string")
    vectors = chunks.select("chunk_id", embed("chunks")("text").alias("vec"))
    asked = spark.createDataFrame([(1, "word 3"), (2, "many a")], "qid long, text string")
    hits = Engine(embed=embed("questions")).retrieve(asked, chunks, vectors)
    assert {r.qid for r in hits.collect()} == {1, 2}
    assert (made["chunks"].value, made["questions"].value) == (40, 2)


def test_table_of_states_finds_the_same(monkeypatch):
    rng = random.Random(6)
    for _ in range(40):
        names = sorted({"".join(rng.choices("ab王", k=rng.randrange(1, 5))) for _ in range(rng.randrange(1, 9))})
        texts = ["".join(rng.choices("ab王c", k=rng.randrange(0, 60))) for _ in range(9)]
        a, found = automaton.Automaton(names), []
        for dense in (0, 1 << 20):
            monkeypatch.setattr(automaton, "DENSE", dense)
            found.append([x.tolist() for x in (*a.find(texts), *a.held(texts))])
        assert found[0] == found[1]


def test_postings_against_sorting(spark):
    """The earliest first, then those of highest tf, as many as are kept."""
    rng = random.Random(8)
    rows = [(k, rng.randrange(9), name, rng.randrange(1, 5)) for name in ("甲乙", "甲乙丙", "x") for k in rng.sample(range(60), 25)]
    names = spark.createDataFrame([("甲乙",), ("甲乙丙",)], "name string")
    conf, want = EngineConf(keep_earliest=4, max_postings=13), set()
    for name in ("甲乙", "甲乙丙"):
        own = sorted((r for r in rows if r[2] == name), key=lambda r: (r[1], r[0]))
        own = own[:4] + sorted(own[4:], key=lambda r: (-r[3], r[1], r[0]))
        want |= {(name, r[0], r[1], r[3], k) for k, r in enumerate(own[:13], 1)}
    got = entities.index(spark.createDataFrame(rows, "chunk_id long, page_start int, term string, tf long"), names, conf)
    assert {tuple(r[c] for c in ("name", "chunk_id", "page_start", "tf", "pos")) for r in got.collect()} == want


def test_texts_of_many_files_stay_where_they_are(spark, tmp_path):
    cores = spark.sparkContext.defaultParallelism
    rows = spark.range(40).select("id", F.concat(F.lit("text "), "id").alias("text"))
    moved = lambda df: "Repartition" in spotting.spread(df)._jdf.queryExecution().optimizedPlan().toString()
    for n in (1, cores):
        rows.repartition(n).write.parquet(f"{tmp_path}/{n}")
    few, many = (spark.read.parquet(f"{tmp_path}/{n}") for n in (1, cores))
    assert moved(few) and not moved(many.filter("id > 3").select(F.upper("text").alias("text")))
    assert moved(many.groupBy("id").agg(F.max("text").alias("text"))) and moved(rows)
    assert sorted(spotting.spread(many).collect()) == sorted(rows.collect())


def test_workers_get_bounded_batches(spark, monkeypatch):
    """Steps that are run at once hand texts to workers in batches of bounded bytes; the session is as it was afterwards."""
    monkeypatch.setattr(spotting, "RECEIVED", 4_000)
    sizes = lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches)
    counted = spark.range(0, 400, 1, 1).select(F.repeat(F.lit("x"), 100).alias("text")).mapInArrow(sizes, "n long")
    assert max(r.n for r in spotting.kept(counted).collect()) < 100 and max(r.n for r in spotting.written(counted).collect()) < 100
    assert [r.n for r in counted.collect()] == [400]
