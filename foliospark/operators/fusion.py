"""Rank fusion, gates and cut-offs over rankings (qid, chunk_id, score, rank)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..conf import DEFAULT, EngineConf
from ..functions.text import clamp01, snippet
from .lexical import top


def weighted_rrf(channels: list[tuple[DataFrame, float]], k: int | None, k0: int = DEFAULT.rrf_k0, by: tuple[str, ...] = ("qid",)) -> DataFrame:
    """Sum over channels (ranking, weight) of weight / (k0 + rank), the best k of it; channels of no weight play no part."""
    parts = [c.select(*by, "chunk_id", (F.lit(float(w)) / (k0 + F.col("rank"))).alias("s")) for c, w in channels if w > 0]
    fused = reduce(DataFrame.unionByName, parts).groupBy(*by, "chunk_id").agg(F.round(F.sum("s"), 10).alias("score"))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "chunk_id"))
    fused = fused.withColumn("rank", rank)
    return fused if k is None else fused.filter(F.col("rank") <= k)


def hybrid(vector: DataFrame, lexical: DataFrame, k: int, conf: EngineConf = DEFAULT, by: tuple[str, ...] = ("qid",)) -> DataFrame:
    alpha = min(1.0, max(0.0, conf.alpha))
    return weighted_rrf([(vector, alpha), (lexical, 1 - alpha)], k, conf.rrf_k0, by)


def multi_query(recall: DataFrame, k: int, conf: EngineConf = DEFAULT) -> DataFrame:
    """Fuses rankings (qid, sub_no, chunk_id, rank): the question itself (0) weighs 1, others less."""
    first, rest = recall.filter("sub_no = 0"), recall.filter("sub_no > 0")
    return weighted_rrf([(first, 1.0), (rest, conf.extra_query_weight)], k, conf.rrf_k0)


def with_entities(ranked: DataFrame, recalled: DataFrame, conf: EngineConf = DEFAULT) -> DataFrame:
    """Fuses rankings (qid, chunk_id, rank) with entity recall (qid, chunk_id, score, page_start, intent): nothing is cut off.

    Where a question has an intent, chunks found by entity are ranked by page once more, the earliest or the latest first.
    """
    by_name = recalled.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "chunk_id")))
    timely = by_name.filter(F.col("intent").isNotNull() & (F.col("page_start") > 0))
    page = F.when(F.col("intent") == "last", -F.col("page_start")).otherwise(F.col("page_start"))
    by_page = timely.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(page, "rank")))
    return weighted_rrf([(ranked, 1.0), (by_name, conf.entity_weight), (by_page, conf.chrono_weight)], None, conf.rrf_k0)


def candidate_k(top_k: int, temporal: bool, rerank: bool, many: bool, conf: EngineConf = DEFAULT) -> int:
    return max(top_k, conf.temporal_candidates * temporal, conf.rerank_candidates * (rerank or many))


def threshold(hits: DataFrame, mode: str, conf: EngineConf = DEFAULT) -> DataFrame:
    """hits (qid, chunk_id, score, rank) that pass the cut-off, with cutoff and strategy.

    vector: at most score_delta below the best; else: at least 1 - score_delta of it. A largest gap between neighbours of
    gap_threshold or more (of the best score, unless vector) raises the cut-off to above it. min_keep hits stay anyhow.
    """
    w = Window.partitionBy("qid")
    order = w.orderBy("rank")
    best = F.max("score").over(w)
    drop = F.col("score") - F.lead("score").over(order)
    if mode != "vector":
        drop = F.when(best > 0, drop / best)
    rows = hits.withColumn("best", best).withColumn("drop", F.when(drop > 0, drop))
    gap = F.max(F.when(F.col("drop").isNotNull(), F.struct(F.col("drop"), (-F.col("rank")).alias("r"), F.col("score").alias("s")))).over(w)
    rows = rows.withColumn("gap", gap)
    base = F.col("best") - conf.score_delta if mode == "vector" else F.col("best") * (1 - conf.score_delta)
    cut_gap = F.when(F.col("gap.drop") >= conf.gap_threshold, F.col("gap.s") - 1e-6)
    rows = rows.withColumn("cut", F.greatest(base, cut_gap)).withColumn("kept", F.sum((F.col("score") >= F.col("cut")).cast("int")).over(w)).withColumn("n", F.count("*").over(w))
    short = (F.col("kept") < conf.min_keep) & (F.col("kept") < F.col("n"))
    last = F.min(F.when(F.col("rank") <= conf.min_keep, F.col("score"))).over(w)
    name, gap_name = ("auto_delta", "+gap") if mode == "vector" else ("auto_ratio", "+gap_ratio")
    strategy = F.concat(F.lit(name), F.when(cut_gap.isNotNull(), gap_name).otherwise(""), F.when(short, "+min_keep").otherwise(""))
    rows = rows.withColumn("cutoff", F.when(short, last).otherwise(F.col("cut"))).withColumn("strategy", strategy)
    stays = F.when(short, F.col("rank") <= conf.min_keep).otherwise(F.col("score") >= F.col("cut"))
    return rows.filter(stays).select("qid", "chunk_id", "score", "rank", F.round("cutoff", 6).alias("cutoff"), "strategy")


def gaps(hits: DataFrame, ratio: bool, conf: EngineConf = DEFAULT) -> DataFrame:
    """(qid, cutoff): just below the score before the largest gap; null if that is under gap_threshold."""
    order = Window.partitionBy("qid").orderBy("rank")
    rows = hits.withColumn("drop", F.col("score") - F.lead("score").over(order)).withColumn("best", F.max("score").over(Window.partitionBy("qid")))
    if ratio:
        rows = rows.withColumn("drop", F.when(F.col("best") > 0, F.col("drop") / F.col("best")))
    top_gap = F.max(F.when(F.col("drop") > 0, F.struct("drop", (-F.col("rank")).alias("r"), "score")))
    return rows.groupBy("qid").agg(top_gap.alias("g")).select("qid", F.when(F.col("g.drop") >= conf.gap_threshold, F.round(F.col("g.score") - 1e-6, 6)).alias("cutoff"))


def score_gate(questions: DataFrame, vector: DataFrame, min_score: float) -> DataFrame:
    """(qid, top_score, abstain): whether the best vector score is under min_score; no hit doesn't abstain."""
    best = vector.groupBy("qid").agg(F.max("score").alias("top_score"))
    return questions.select("qid").join(best, "qid", "left").withColumn("abstain", F.coalesce(F.col("top_score") < min_score, F.lit(False)))


def overlap_gate(top_hits: DataFrame, min_overlap: int, max_score: float) -> DataFrame:
    """(qid, overlap, abstain) for (qid, score, question, text) of the best hit: weak in score and in shared tokens."""
    from .lexical import overlap

    return overlap(top_hits, "question", "text").select("qid", "overlap", ((F.col("overlap") < min_overlap) & (F.col("score") < max_score)).alias("abstain"))


def materialise(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """hits with text and snippet; ids without a chunk are dropped."""
    return hits.join(chunks.select("chunk_id", "text"), "chunk_id").withColumn("text_snippet", snippet(F.col("text")))


def rerank(hits: DataFrame, scored: DataFrame, k: int | None) -> DataFrame:
    """hits ordered by a reranker's (qid, chunk_id, rerank_score); missing scores are 0, ties keep their order."""
    rows = hits.join(scored, ["qid", "chunk_id"], "left").withColumn("rerank_score", clamp01(F.coalesce("rerank_score", F.lit(0.0))))
    rows = rows.withColumnRenamed("rank", "recall_rank").drop("score").withColumn("score", F.col("rerank_score"))
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "recall_rank")))
    return rows if k is None else rows.filter(F.col("rank") <= k)


def lexical_rerank_scores(pairs: DataFrame, conf: EngineConf = DEFAULT) -> DataFrame:
    """A deterministic stand-in for a cross encoder over (qid, chunk_id, question, text): sigmoid of the share of the question's tokens."""
    from ..functions.text import tokens

    q, d = F.array_distinct(tokens(F.col("question"))), tokens(F.substring("text", 1, conf.rerank_chars))
    share = F.try_divide(F.size(F.array_intersect(q, d)), F.size(q))
    return pairs.select("qid", "chunk_id", F.round(1 / (1 + F.exp(-(8 * F.coalesce(share, F.lit(0.0)) - 4))), 6).alias("rerank_score"))


def rerank_scores(replies: DataFrame, asked: DataFrame) -> DataFrame:
    """(qid, chunk_id, rerank_score, status) from a provider's JSON replies (qid, reply) for asked (qid, chunk_id).

    A reply is {"scores": [{"chunk_id": ..., "score": ...}]}. Scores are clamped to 0 to 1, missing ones are 0. status is
    parse_error if a reply is no JSON, bad_format without a list, bad_output if no score is of a chunk that was asked for;
    then, and without a reply (no_reply), a question has null scores and keeps its order.
    """
    listed = F.from_json("reply", "struct<scores:array<struct<chunk_id:string,score:double>>>")["scores"]
    got = replies.select("qid", F.try_parse_json("reply").isNull().alias("broken"), listed.alias("list"))
    each = got.select("qid", F.explode("list").alias("x")).filter("x.chunk_id is not null").groupBy("qid", F.col("x.chunk_id").alias("__id")).agg(F.max("x.score").alias("s"))
    rows = asked.select("qid", "chunk_id", F.col("chunk_id").cast("string").alias("__id")).join(got, "qid", "left").join(each.withColumn("__known", F.lit(True)), ["qid", "__id"], "left")
    some = F.max(F.col("__known").isNotNull()).over(Window.partitionBy("qid"))
    status = F.when(F.col("broken").isNull(), "no_reply").when(F.col("broken"), "parse_error").when(F.col("list").isNull(), "bad_format").when(~some, "bad_output")
    rows = rows.withColumn("status", status)
    return rows.select("qid", "chunk_id", F.when(F.col("status").isNull(), clamp01(F.coalesce("s", F.lit(0.0)))).alias("rerank_score"), "status")


def rerank_where_scored(hits: DataFrame, scored: DataFrame, k: int | None) -> DataFrame:
    """rerank() for questions that have scores; the others keep their order and scores. Both are cut to k."""
    known = scored.filter("rerank_score is not null")
    has = known.select("qid").distinct()
    plain = hits.join(has, "qid", "left_anti").withColumns({"rerank_score": F.lit(None).cast("double"), "recall_rank": F.col("rank")})
    both = rerank(hits.join(has, "qid", "left_semi"), known.select("qid", "chunk_id", "rerank_score"), None).unionByName(plain)
    return both if k is None else both.filter(F.col("rank") <= k)


__all__ = ["candidate_k", "gaps", "hybrid", "lexical_rerank_scores", "materialise", "multi_query", "overlap_gate", "rerank", "rerank_scores", "rerank_where_scored", "score_gate", "threshold", "top", "weighted_rrf", "with_entities"]
