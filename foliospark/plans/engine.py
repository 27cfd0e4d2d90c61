"""Ingest, retrieve, answer and evaluate, for many books and questions at once."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..conf import DEFAULT, EngineConf
from ..functions.text import snippet, strip
from ..operators import chunking, entities, evidence, fusion, lexical, planning, prep, temporal, understand, vector
from ..operators.spotting import kept, small


class Engine:
    """Plans over DataFrames: retrieval of all questions at once, each by the way that suits it.

    embed makes a vector of a text (a column function); without it, and without vectors, retrieval is lexical.
    """

    def __init__(self, conf: EngineConf = DEFAULT, embed: Callable[[Column], Column] | None = None, **changes):
        self.conf, self.embed = replace(conf, **changes), embed

    def ingest(self, pages: DataFrame, strict: bool = False) -> DataFrame:
        """Chunks of pages (book, page_no, text). strict: an error if a book has too little text that is content."""
        clean = prep.content_pages(prep.blank_before(prep.without_boilerplate(pages), self.conf), self.conf)
        clean = prep.required(kept(clean), self.conf) if strict else clean
        filled = prep.chapters(prep.merged(clean).withColumnRenamed("page_start", "page_no")).withColumnRenamed("page_no", "page_start")
        return chunking.chunks(filled, self.conf)

    def questions(self, raw: DataFrame) -> DataFrame:
        """(qid, text) of raw questions that policy lets through, as retrieval should see them."""
        return raw.filter(~understand.should_block(F.col("text"))).select("qid", understand.normalise(F.col("text")).alias("text"))

    def recall(self, asked: DataFrame, chunks: DataFrame, vectors: DataFrame | None, k: int) -> tuple[DataFrame, DataFrame | None]:
        """Rankings (qid, sub_no, chunk_id, score, rank) of queries (qid, sub_no, text), and vector scores of the questions
        themselves (qid, chunk_id, score, rank). Each query is searched for under a number of its own."""
        c = self.conf
        kind = dict(asked.dtypes)["qid"]
        own = asked.select(F.concat(F.col("sub_no").cast("string"), F.lit(":"), F.col("qid").cast("string")).alias("qid"), "text")
        back = lambda df: df.withColumns({"sub_no": F.substring_index("qid", ":", 1).cast("int"), "qid": F.regexp_replace("qid", "^[0-9]+:", "").cast(kind)})
        channel = max(k, c.channel_k)
        if vectors is None or self.embed is None:
            return back(lexical.search(own, chunks, k, c)), None
        own = kept(own.withColumn("vec", self.embed(F.col("text"))))
        near = kept(vector.search(vectors, own.select("qid", "vec"), channel if c.alpha is not None else k))  # once, for both that follow
        original = back(near).filter("sub_no = 0").drop("sub_no")
        own = own.drop("vec")
        return back(near if c.alpha is None else fusion.hybrid(near, lexical.search(own, chunks, channel, c), k, c)), original

    def retrieve(
        self, questions: DataFrame, chunks: DataFrame, vectors: DataFrame | None = None, rerank: Callable[[DataFrame], DataFrame] | bool = False, names: DataFrame | None = None,
        postings: DataFrame | None = None, aliases: DataFrame | None = None, expansions: DataFrame | None = None, min_overlap: int = 0, overlap_max_score: float = 0.0,
    ) -> DataFrame:
        """Hits (qid, chunk_id, score, rank, cutoff, strategy, vector_score, bm25_score, alias_hint, text, text_snippet).

        questions (qid, text), chunks (chunk_id, text, and for questions about first appearances book, doc_ord, page_start,
        page_end, chapter). A question about the first appearance of a name is answered from the places around it. Any
        other goes with its subqueries and expansions (qid, queries) through recall and fusion, entities (names, postings)
        join in, and gates may leave it without hits. Then come the places of first appearances in order, a reranker
        ((qid, chunk_id, question, text) to (qid, chunk_id, rerank_score); True for the stand-in), and the cut-off.
        """
        c = self.conf
        planned = kept(self._planned(questions, names, aliases)).withColumn("temporal", understand.is_temporal(F.col("text")))
        early = self._first_appearances(questions, chunks) if "doc_ord" in chunks.columns else None
        if early is not None:
            planned = planned.join(early.select("qid").distinct(), "qid", "left_anti")
        # what is used more than once is kept: a few rows a question, here and below
        planned = kept(planned)
        asked = kept(planning.queries(planned, expansions))
        many = expansions is not None or not planned.filter("kind is not null").isEmpty()
        k = fusion.candidate_k(c.top_k, not planned.filter("temporal").isEmpty(), bool(rerank), many, c)
        index = lexical.keep(chunks)  # for all searches and scores that follow
        found, original = self.recall(asked, index, vectors, k)
        found = kept(found)
        single = found.groupBy("qid").agg((F.max("sub_no") == 0).alias("single"))
        fused = fusion.multi_query(found, k, c).join(single, "qid")
        alone = found.filter("sub_no = 0").select("qid", "chunk_id", F.col("score").alias("own"))
        # a question without further queries keeps the scores of its one ranking; the order is the same
        ranked = fused.join(alone, ["qid", "chunk_id"], "left").select("qid", "chunk_id", F.when(F.col("single"), F.col("own")).otherwise(F.col("score")).alias("score"), "rank", "single")
        mode = F.when(F.col("single") & F.lit(c.alpha is None and vectors is not None and self.embed is not None), "vector").otherwise("hybrid")
        if original is not None:
            ranked = ranked.join(self._gated(planned, found, original, chunks, min_overlap, overlap_max_score), "qid", "left_anti")
        if names is not None and postings is not None:
            ranked = kept(ranked)
            spotted = kept(entities.mentions(planned, names).join(planned.select("qid", entities.intent(F.col("text")).alias("intent")), "qid"))
            recalled = entities.recall(spotted, names, postings, c).join(spotted.select("qid", "intent").distinct(), "qid")
            recalled = kept(recalled.join(ranked.select("qid").distinct(), "qid", "left_semi"))
            some = recalled.select("qid").distinct().withColumn("named", F.lit(True))
            ranked = fusion.with_entities(ranked.join(some, "qid", "left_semi"), recalled, c).withColumn("single", F.lit(False)).unionByName(ranked.join(some, "qid", "left_anti"))
        ranked = ranked.withColumn("mode", mode).drop("single")
        # few rows meet the chunks where these are: no text is shuffled for them
        hits = kept(small(kept(ranked)).join(chunks, "chunk_id").withColumn("text_snippet", snippet(F.col("text"))))
        late = temporal.named(planned.filter("temporal").select("qid", "text"), names)
        timely = None
        if "doc_ord" in chunks.columns:
            timely = temporal.in_order(hits.join(late.select("qid"), "qid", "left_semi"), late, min(c.top_k, c.temporal_keep)).withColumns({"cutoff": F.lit(None).cast("double"), "strategy": F.lit("temporal_position")})
            hits = hits.join(late.select("qid"), "qid", "left_anti")
        if rerank:
            pairs = hits.join(questions.select("qid", F.col("text").alias("question")), "qid").select("qid", "chunk_id", "question", "text")
            scored = fusion.lexical_rerank_scores(pairs, c) if rerank is True else rerank(pairs)
            hits = kept(fusion.rerank_where_scored(hits, scored, c.top_k).withColumn("mode", F.when(F.col("rerank_score").isNotNull(), "rerank").otherwise(F.col("mode"))).drop("recall_rank", "rerank_score"))
        cut = [fusion.threshold(hits.filter(F.col("mode") == m if m == "vector" else F.col("mode") != "vector"), m, c) for m in (["vector", "hybrid"] if c.alpha is None else ["hybrid"])]
        passed = cut[0] if len(cut) == 1 else cut[0].unionByName(cut[1])
        out = passed.join(hits.drop("score", "rank", "mode"), ["qid", "chunk_id"]).withColumn("alias_hint", F.lit(None).cast("string"))
        for more in (timely, early):
            if more is not None:
                out = out.unionByName(more.select(*[x for x in out.columns if x in more.columns]), allowMissingColumns=True)
        return self._diagnosed(kept(out), original, questions, index)

    def _planned(self, questions: DataFrame, names: DataFrame | None, aliases: DataFrame | None) -> DataFrame:
        return planning.plans(questions, planning.targets(questions, names, aliases))

    def _first_appearances(self, questions: DataFrame, chunks: DataFrame) -> DataFrame:
        """Hits around the first appearance of what questions name before a word such as 'first'."""
        target = understand.temporal_target(F.col("text"))
        asked = kept(temporal.aliases(questions.select("qid", target.alias("name")).filter("name is not null"), chunks))
        anchors = temporal.first_appearance(asked, chunks)
        # the earliest book counts where there are several
        one = anchors.groupBy("qid").agg(F.min(F.struct("book", "doc_ord")).alias("a")).select("qid", "a.*")
        near = temporal.around(one, chunks, min(self.conf.top_k, self.conf.temporal_keep))
        hits = small(kept(near)).join(chunks, ["book", "doc_ord"]).join(asked.select("qid", F.concat("name", F.lit("="), "alias").alias("alias_hint")), "qid")
        return kept(hits.withColumns({"score": F.lit(0.0), "cutoff": F.lit(None).cast("double"), "strategy": F.lit("temporal_first_mention_scan"), "text_snippet": snippet(F.col("text"))}))

    def _gated(self, planned: DataFrame, found: DataFrame, original: DataFrame, chunks: DataFrame, min_overlap: int, most: float) -> DataFrame:
        """(qid) of questions that are left without an answer: their best vector score is too low, or not high and their best
        hit shares too few words."""
        c = self.conf
        best = original.groupBy("qid").agg(F.max("score").alias("top_score"))
        out = best.filter(F.col("top_score") < (c.min_score if c.min_score is not None else float("-inf"))).select("qid")
        if min_overlap > 0 and most > 0:
            top = found.filter("sub_no = 0 and rank = 1").select("qid", "chunk_id").join(best, "qid").filter(F.col("top_score") < most)
            top = top.join(planned.select("qid", F.col("text").alias("question")), "qid").join(chunks.select("chunk_id", "text"), "chunk_id")
            weak = fusion.overlap_gate(top.withColumn("score", F.col("top_score")), min_overlap, most).filter("abstain").select("qid")
            out = out.unionByName(weak).distinct()
        return out

    def _diagnosed(self, hits: DataFrame, original: DataFrame | None, questions: DataFrame, chunks: DataFrame) -> DataFrame:
        """hits with vector_score (0 where the question's own vector ranking lacks a chunk) and bm25_score of the question."""
        hits = hits if "alias_hint" in hits.columns else hits.withColumn("alias_hint", F.lit(None).cast("string"))
        scored = hits.withColumn("vector_score", F.lit(0.0))
        if original is not None:
            scored = hits.join(original.select("qid", "chunk_id", F.col("score").alias("v")), ["qid", "chunk_id"], "left").withColumn("vector_score", F.coalesce("v", F.lit(0.0))).drop("v")
        point = lexical.point_scores(hits.select("qid", "chunk_id"), questions, chunks, self.conf).withColumnRenamed("score", "bm25_score")
        return scored.join(point, ["qid", "chunk_id"], "left").drop("book", "doc_ord")

    def answer(
        self, questions: DataFrame, hits: DataFrame, provider: Callable[[DataFrame], DataFrame] | None = None, names: DataFrame | None = None, aliases: DataFrame | None = None,
        rerank: Callable[[DataFrame], DataFrame] | None = None,
    ) -> DataFrame:
        """(qid, answer, way) of questions from their hits (qid, chunk_id, score, rank, page_start, page_end, chapter, text, ...).

        way: none without hits; structured if every target and field of the plan has a value in the evidence; list for list
        questions with names in the evidence; else provider, which gets what is left (qid, question, evidence, is_list, criteria, targets,
        fields, known: the values that were found) and gives (qid, reply), in up to three rounds (evidence.replied), and whose
        reply is cleaned; else snippets, also where a reply is empty or a refusal. rerank puts the first hits in order that have no
        rerank scores yet ((qid, chunk_id, question, text) to (qid, chunk_id, rerank_score)).
        """
        c = self.conf
        if rerank is not None:
            pairs = hits.filter(F.col("rank") <= c.rerank_candidates).join(questions.select("qid", F.col("text").alias("question")), "qid").select("qid", "chunk_id", "question", "text")
            hits = kept(evidence.reranked_for_evidence(hits, kept(rerank(pairs)), c.rerank_candidates))
        hits = hits if "alias_hint" in hits.columns else hits.withColumn("alias_hint", F.lit(None).cast("string"))
        planned = kept(self._planned(questions, names, aliases))
        about = planned.select("qid", F.array_distinct(F.concat("targets", "fields")).alias("terms"))
        held = evidence.key_terms_first(hits.drop("rank").join(small(about), "qid"), F.col("terms")).drop("terms", "held")
        capped = kept(evidence.capped(held, c.evidence_chunks))
        # a name that retrieval knows by another form is told beside it
        hint = capped.filter("no <= 3 and alias_hint is not null").groupBy("qid").agg(F.min_by("alias_hint", "no").alias("hint"))
        left, right = strip(F.substring_index("hint", "=", 1)), strip(F.substring_index("hint", "=", -1))
        fits = F.contains("text", left) & ~F.contains("text", right) & (left != "") & (right != "")
        bridged = kept(questions.join(hint, "qid", "left").select("qid", F.when(fits, evidence.bridge_alias(F.col("text"), left, right)).otherwise(F.col("text")).alias("text")))
        planned = kept(self._planned(bridged, names, aliases))
        pieces = planned.filter("kind is not null")
        wanted = pieces.select("qid", F.explode("targets").alias("target"), "fields").select("qid", "target", F.explode("fields").alias("field"))
        cells = kept(evidence.filled(evidence.structured(capped.select("qid", "no", "text"), wanted), pieces))
        table = cells.filter("complete and table <> ''")
        lists = planned.filter(F.col("kind").isNull() & understand.is_list(F.col("text"))).select("qid", F.col("text").alias("question"))
        seen = capped.select("qid", "no", "text").join(lists, "qid")
        listed = evidence.list_answer(evidence.names_in(seen, evidence.list_terms(F.col("question"), understand.criteria(F.col("question")))), lists.withColumnRenamed("question", "text"))
        shown = capped.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("no"))).withColumn("text_snippet", snippet(F.col("text")))
        out = evidence.extract_answer(questions, shown).withColumnRenamed("answer", "snippets")
        out = out.join(table.select("qid", F.col("table").alias("t")), "qid", "left").join(listed.select("qid", F.col("answer").alias("l")), "qid", "left")
        said = F.lit(None).cast("string")
        if provider is not None:
            about = planned.select("qid", understand.is_list(F.col("text")).alias("is_list"), understand.criteria(F.col("text")).alias("criteria"), "targets", "fields")
            asked = bridged.join(evidence.block(evidence.budgeted(capped, c)), "qid").select("qid", F.col("text").alias("question"), "evidence")
            asked = asked.join(about, "qid").join(cells.select("qid", F.col("table").alias("known")), "qid", "left")
            asked = asked.join(table.select("qid"), "qid", "left_anti").join(listed.select("qid"), "qid", "left_anti")
            replies = evidence.replied(asked, provider, c.retry_on_abstain).select("qid", evidence.finished(F.col("reply")).alias("said"))
            out, said = out.join(replies, "qid", "left"), F.col("said")
        way = F.when(F.col("t").isNotNull(), "structured").when(F.col("l").isNotNull(), "list").when(said.isNotNull(), "provider").when(F.col("snippets") == evidence.NO_ANSWER, "none").otherwise("snippets")
        return out.select("qid", F.coalesce("t", "l", said, "snippets").alias("answer"), way.alias("way"))

    def evaluate(self, questions: DataFrame, hits: DataFrame, gold: DataFrame) -> DataFrame:
        return evidence.hit_and_mrr(questions, hits, gold)
