"""Evidence for answers, answers by rule, and how answers are measured."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..conf import DEFAULT, EngineConf
from ..functions.text import sentences, strip, truncate
from . import understand
from .spotting import kept, small
from .understand import keywords

#: Patterns that results depend on.
REFUSAL = r"(?:无法确认|无法确定|不确定|未知|没有(?:提到|说明|给出|描述)|未(?:提到|说明|给出|描述)|并未(?:提到|说明|给出|描述)|因此，?无法确认|因此，?无法确定|无法(?:从|依据|根据).*(?:得出|确认)|信息不足|资料不足|证据不足)"
META_PREFIX = r"(?iU)^\s*(?:(?:根据|依据|参照|结合|基于)\s*(?:上述|以下|给定|提供的)?\s*(?:参考信息|资料|原文|片段)\s*[，,。:：]?\s*|(?:在|从)\s*(?:参考信息|资料|原文|片段)\s*(?:中|里|内)\s*[，,。:：]?\s*)"
META_CLAUSE = r"(?iU)(?:(?:参考信息|资料|原文|片段)\s*(?:中|里|内)?\s*(?:没有|未|并未)\s*(?:提到|说明|给出|描述)[^。！？\n]*|(?:无法|不能)\s*(?:从|依据|根据)\s*(?:参考信息|资料|原文|片段)[^。！？\n]*)"
NAME = r"[一-鿿]{2,4}(?:·[一-鿿]{2,4})?"
NAME_STOP = ("同学", "学生", "女生", "男生", "老师", "教授", "校长", "学院", "人物", "角色")
META_WORDS = ("参考信息", "资料", "原文", "片段", "页码", "章节", "知识库", "小说", "书中")
KEPT_LABELS = ("关键描写", "情节", "简短总结")
HOUSES = ("格兰芬多", "斯莱特林", "拉文克劳", "赫奇帕奇")
LIST_WORDS = ("哪些", "列出", "列举")
CRITERIA_LINES = ("判定标准：", "1) 依据问题语义从原文中抽取", "2) 需有明确描写或具体情节支撑", "3) 不满足条件的不列出", "")
LABELS, LIST_LABELS = ("   关键描写/情节：", "   简短总结："), ("关键描写", "简短总结")
NO_ANSWER, FOUND = "无法回答", "相关内容如下："
CITATION = r"\[([A-Za-z0-9_:-]+)\]"


def capped(hits: DataFrame, k: int = DEFAULT.evidence_chunks) -> DataFrame:
    """hits (qid, chunk_id, page_start, text, ...) in document order, the first k; page 0 and unknown pages last, ids as text."""
    rows = hits.dropDuplicates(["qid", "chunk_id", "page_start"])
    page = F.coalesce(F.nullif("page_start", F.lit(0)), F.lit(10**9))
    return rows.withColumn("no", F.row_number().over(Window.partitionBy("qid").orderBy(page, F.col("chunk_id").cast("string")))).filter(F.col("no") <= k)


def budgeted(rows: DataFrame, conf: EngineConf = DEFAULT) -> DataFrame:
    """rows (qid, no, text) with piece: texts cut to evidence_chunk_chars, and all of a question to evidence_chars."""
    rows = rows.withColumn("piece", truncate(F.col("text"), conf.evidence_chunk_chars))
    used = F.coalesce(F.sum(F.length("piece")).over(Window.partitionBy("qid").orderBy("no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("left", (F.lit(conf.evidence_chars) - used).cast("int")).filter("left > 0")
    return rows.withColumn("piece", F.when(F.length("piece") > F.col("left"), truncate(F.col("piece"), F.col("left"))).otherwise(F.col("piece"))).drop("left")


def block(rows: DataFrame) -> DataFrame:
    """(qid, evidence): numbered pieces with their pages and chapter, one after the other."""
    first, last, chapter = F.col("page_start").cast("string"), F.col("page_end").cast("string"), strip(F.col("chapter"))
    pages = F.coalesce(F.when(F.col("page_end") != F.col("page_start"), F.concat(first, F.lit("-"), last)), first, F.lit("?"))
    head = F.concat(F.lit("[来源"), F.col("no").cast("string"), F.lit("]（页码 "), pages, F.when(chapter != "", F.concat(F.lit("，"), chapter)).otherwise(""), F.lit("）：\n"), F.col("piece"), F.lit("\n"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("no", head.alias("t")))), lambda x: x["t"]), "\n")
    return rows.groupBy("qid").agg(strip(joined).alias("evidence"))


def extract_answer(questions: DataFrame, hits: DataFrame) -> DataFrame:
    """(qid, answer): the numbered snippets of a question's hits (qid, rank, text_snippet), or that there is none."""
    line = F.concat(F.lit("来源"), F.col("rank").cast("string"), F.lit("）"), strip(F.regexp_replace("text_snippet", r"\n", " ")))
    got = hits.filter(strip(F.col("text_snippet")) != "").groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("t")))), lambda x: x["t"]), "\n").alias("a"))
    return questions.select("qid").join(got, "qid", "left").select("qid", F.coalesce(F.concat(F.lit(FOUND + "\n\n"), F.col("a")), F.lit(NO_ANSWER)).alias("answer"))


def key_terms_first(hits: DataFrame, terms: Column) -> DataFrame:
    """hits ordered by how many of the terms they hold, then by score."""
    n = F.size(F.filter(terms, lambda t: F.contains(F.col("text"), t)))
    return hits.withColumn("held", n).withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("held"), F.desc("score"), "chunk_id")))


def is_refusal(text: Column) -> Column:
    t = strip(text)
    return (t == "") | (F.length(t) <= 90) & t.rlike(REFUSAL)


def clean_style(text: Column) -> Column:
    """text without sentences, clauses and words about sources; lines with labels of lists stay as they are."""
    without = lambda s: reduce(lambda c, w: F.replace(c, F.lit(w), F.lit("")), META_WORDS, s)

    def one(s: Column) -> Column:
        bare = strip(F.regexp_replace(strip(F.regexp_replace(s, META_PREFIX, "")), META_CLAUSE, ""))
        only_meta = s.rlike(META_CLAUSE) & (F.length(strip(F.regexp_replace(s, META_CLAUSE, ""))) <= 2)
        # every pattern needs one of the words, so a sentence without them stays as it is
        plain = ~s.rlike("|".join(META_WORDS)) | s.rlike("|".join(KEPT_LABELS))
        return F.when(plain, s).when(~only_meta, F.when(bare.rlike("|".join(META_WORDS)), strip(without(bare))).otherwise(bare))

    parts = F.transform(F.split(strip(text), r"(?<=[。！？\n])"), strip)
    kept = F.filter(F.transform(parts, one), lambda s: s.isNotNull() & (s != ""))
    return strip(F.array_join(kept, ""))


def clean_value(v: Column) -> Column:
    v = F.regexp_replace(F.regexp_replace(v, r"(?U)^[，,。；;：:\s]+", ""), r"(?U)[，,。；;：:\s]+$", "")
    return strip(F.regexp_replace(v, r"(?:等|等等)$", ""))


def value_of(sentence: Column, target: Column, field: Column) -> Column:
    """What a sentence says a target's field is; null if it says nothing."""
    quote = lambda c: F.concat(F.lit(r"\Q"), c, F.lit(r"\E"))
    t, f = quote(target), quote(field)
    get = lambda p: F.get(F.regexp_extract_all(sentence, p, F.lit(1)), F.lit(0))
    own = get(F.concat(t, F.lit("的"), f, F.lit(r"\s*(?:是|为|：|:)?\s*([^。；;！!\n]+)")))
    plain = get(F.concat(f, F.lit(r"\s*(?:是|为|：|:)\s*([^。；;！!\n]+)")))
    pair = get(F.concat(t, F.lit(r"\s*[与和及]\s*([^，。；;、\n]+)")))
    has_t, has_f = F.contains(sentence, target), F.contains(sentence, field)
    return clean_value(F.coalesce(own, F.when(has_t, plain), F.when(has_t & has_f, pair)))


def structured(evidence: DataFrame, wanted: DataFrame) -> DataFrame:
    """(qid, target, field, value): the first sentence of a question's evidence (qid, no, text) that gives a wanted value."""
    s = evidence.select("qid", "no", F.posexplode(sentences(F.col("text"))).alias("i", "s"))
    rows = s.join(small(kept(wanted)), "qid").filter(F.contains("s", "target") & F.contains("s", "field"))
    # no filter on value: it would go below the join, and every value would be worked out twice
    rows = rows.withColumn("value", value_of(F.col("s"), F.col("target"), F.col("field")))
    first = F.min_by("value", F.when(F.col("value") != "", F.struct("no", "i"))).alias("value")
    return rows.groupBy("qid", "target", "field").agg(first).filter("value is not null")


def filled(values: DataFrame, planned: DataFrame, missing: str | None = None) -> DataFrame:
    """(qid, complete, table) for plans (qid, targets, fields) from values (qid, target, field, value): whether every cell has
    one, and a line per target of what is known, with `missing` in other cells if it is given. Plans without targets or fields are never complete."""
    cells = planned.select("qid", F.posexplode("targets").alias("i", "target"), "fields").select("qid", "i", "target", F.posexplode("fields").alias("j", "field"))
    rows = cells.join(values, ["qid", "target", "field"], "left")
    known = F.col("value") != ""
    part = F.when(known, F.concat("field", F.lit("："), "value")).otherwise(F.lit(None) if missing is None else F.concat("field", F.lit("：" + missing)))
    in_order = lambda c, by: F.transform(F.array_sort(F.filter(F.collect_list(F.struct(F.col(by), c.alias("t"))), lambda x: x["t"].isNotNull())), lambda x: x["t"])
    lines = rows.groupBy("qid", "i", "target").agg(F.array_join(in_order(part, "j"), "；").alias("known"), F.min(F.coalesce(known, F.lit(False)).cast("int")).alias("all"))
    line = F.when(F.col("known") != "", F.concat("target", F.lit("："), "known"))
    return lines.groupBy("qid").agg((F.min("all") == 1).alias("complete"), F.array_join(in_order(line, "i"), "\n").alias("table"))


def list_terms(question: Column, criteria: Column) -> Column:
    """What sentences must hold one of to name something a list question asks for."""
    words = F.concat(F.array(F.coalesce(criteria, F.lit(""))), keywords(question, 8))
    return F.filter(words, lambda t: (t != "") & ~t.isin(*LIST_WORDS))


def names_in(evidence: DataFrame, terms: Column, most: int = 8) -> DataFrame:
    """(qid, name, no, i, sentence): names in sentences that hold one of the terms (in any, without terms), each where it first
    is; names of later sentences are left out once there are `most`."""
    s = evidence.select("qid", "no", F.posexplode(sentences(F.col("text"))).alias("i", "s"), terms.alias("terms"))
    s = s.filter((F.size("terms") == 0) | F.exists("terms", lambda t: F.contains(F.col("s"), t)))
    rows = s.select("qid", "no", "i", "s", F.posexplode(F.regexp_extract_all("s", F.lit(NAME), F.lit(0))).alias("k", "name")).filter(~F.col("name").isin(*NAME_STOP))
    first = rows.groupBy("qid", "name").agg(F.min(F.struct("no", "i", "k", F.col("s").alias("sentence"))).alias("at")).select("qid", "name", "at.*")
    before = F.count("*").over(Window.partitionBy("qid").orderBy("no", "i").rangeBetween(Window.unboundedPreceding, 0)) - F.count("*").over(Window.partitionBy("qid", "no", "i"))
    return first.withColumn("before", before).filter(F.col("before") < most).drop("before")


def list_answer(found: DataFrame, asked: DataFrame) -> DataFrame:
    """(qid, answer): for list questions (qid, text), their names (qid, name, no, i, k, sentence) with the sentence and what
    it says beside the name."""
    criteria = understand.criteria(F.col("text"))
    rows = found.join(asked.select("qid", F.coalesce(criteria, F.lit("")).alias("criteria"), understand.needs_criteria(F.col("text")).alias("needs")), "qid")
    house = F.coalesce(*[F.when(F.contains("sentence", F.lit(h)), h) for h in HOUSES])
    shown = F.when(house.isNotNull(), F.concat("name", F.lit("（"), house, F.lit("）"))).otherwise(F.col("name"))
    plain = strip(F.replace(F.translate("sentence", "“”‘’", ""), F.col("name"), F.lit("")))
    plain = strip(F.when(F.col("criteria") != "", F.replace(plain, F.col("criteria"), F.lit(""))).otherwise(plain))
    brief = F.when(F.length(plain) > 60, F.concat(F.regexp_replace(F.substring(plain, 1, 60), r"(?U)\s+$", ""), F.lit("…"))).otherwise(plain)
    rows = rows.withColumn("no_", F.row_number().over(Window.partitionBy("qid").orderBy("no", "i", "k")))
    item = F.concat(F.col("no_").cast("string"), F.lit(") "), shown, F.lit("\n" + LABELS[0]), "sentence", F.lit("\n" + LABELS[1]), brief)
    lines = rows.groupBy("qid", "needs").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("no_", item.alias("t")))), lambda x: x["t"]), "\n").alias("lines"))
    head = F.when(F.col("needs"), F.lit("\n".join(CRITERIA_LINES) + "\n")).otherwise("")
    return lines.select("qid", strip(F.concat(head, F.col("lines"))).alias("answer"))


def bridge_alias(question: Column, left: Column, right: Column) -> Column:
    """question with the first `left` followed by `right` in brackets."""
    at = F.instr(question, left)
    return F.when(at > 0, F.concat(F.substring(question, F.lit(1), at - 1), left, F.lit("（"), right, F.lit("）"), F.substring(question, at + F.length(left), F.length(question)))).otherwise(question)


def citations(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(CITATION), F.lit(1)))


def answer_sentences(text: Column, compat: bool = False) -> Column:
    """Sentences of an answer; compat also splits after the letter n and the backslash instead of line ends."""
    parts = F.split(F.coalesce(text, F.lit("")), r"(?<=[。！？\n])" if not compat else r"(?<=[。！？\\]|n)")
    return F.filter(F.transform(parts, strip), lambda s: s != "")


def coverage(text: Column, compat: bool = False) -> Column:
    """Share of sentences with a citation; 0 without sentences."""
    s = answer_sentences(text, compat)
    return F.coalesce(F.try_divide(F.size(F.filter(s, lambda x: x.rlike(CITATION))), F.size(s)), F.lit(0.0))


def numbered(text: Column) -> Column:
    """Citations of a text as (id, no), numbered by where each first stands."""
    return F.transform(citations(text), lambda c, i: F.struct(c.alias("id"), (i + 1).alias("no")))


def prompts(rows: DataFrame, template: str) -> DataFrame:
    """rows (qid, text, evidence) with prompt: a template with {query} and {context} in it. The evidence is put in last, so
    nothing that it says is taken for a place to fill."""
    head, tail = template.split("{context}")
    fill = lambda part: F.replace(F.lit(part), F.lit("{query}"), F.col("text"))
    return rows.withColumn("prompt", F.concat(fill(head), F.coalesce("evidence", F.lit("")), fill(tail)))


def hit_and_mrr(questions: DataFrame, hits: DataFrame, gold: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(n, hit_rate, mrr) of rankings against gold (qid, chunk_id); questions without gold or hit count as misses."""
    first = hits.join(gold, ["qid", "chunk_id"]).groupBy(*by, "qid").agg(F.min("rank").alias("first"))
    if by:
        questions = questions.crossJoin(F.broadcast(hits.select(*by).distinct()))  # one row per configuration
    rows = questions.join(first, [*by, "qid"], "left")
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.round(F.avg(F.when(F.col("first").isNotNull(), 1.0).otherwise(0.0)), 6).alias("hit_rate"), F.round(F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))), 6).alias("mrr"))


def ab_grid(questions: DataFrame, arms: dict[str, DataFrame], gold: DataFrame, k: int) -> DataFrame:
    """(config, n, hit_rate, mrr) of the first k hits (qid, chunk_id, rank) of each arm by name; an arm that finds nothing has
    misses alone."""
    hits, spark = None, questions.sparkSession
    for name, found in arms.items():
        arm = found.filter(F.col("rank") <= k).select(F.lit(name).alias("config"), "qid", "chunk_id", "rank")
        hits = arm if hits is None else hits.unionByName(arm)
    names = spark.createDataFrame([(n,) for n in arms], "config string")
    asked = questions.select("qid").crossJoin(F.broadcast(names))  # one row a configuration
    first = hits.join(gold, ["qid", "chunk_id"]).groupBy("config", "qid").agg(F.min("rank").alias("first"))
    rows = asked.join(first, ["config", "qid"], "left")
    return rows.groupBy("config").agg(F.count("*").alias("n"), F.round(F.avg(F.col("first").isNotNull().cast("double")), 6).alias("hit_rate"), F.round(F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))), 6).alias("mrr"))


def reranked_for_evidence(hits: DataFrame, scored: DataFrame, candidates: int) -> DataFrame:
    """hits (qid, chunk_id, score, rank, ...) with their first `candidates` put in the order of a reranker's (qid, chunk_id, rerank_score), and
    the others after them as they were. Questions whose hits have rerank scores already, or that the reranker gave none, stay as they are."""
    known = scored.filter("rerank_score is not null").select("qid", "chunk_id", F.col("rerank_score").alias("__new"))
    rows = hits.join(known, ["qid", "chunk_id"], "left")
    w = Window.partitionBy("qid")
    had = F.max(F.col("rerank_score").isNotNull()).over(w) if "rerank_score" in hits.columns else F.lit(False)
    rows = rows.withColumn("__go", F.max(F.col("__new").isNotNull()).over(w) & ~had).withColumn("__first", F.col("__go") & (F.col("rank") <= candidates))
    new = F.when(F.col("__first"), F.coalesce("__new", F.lit(0.0)))
    rows = rows.withColumn("score", F.coalesce(new, "score")).withColumn("__order", F.when(F.col("__go"), F.coalesce(-new, F.lit(1.0))).otherwise(0.0))
    return rows.withColumn("rank", F.row_number().over(w.orderBy("__order", "rank"))).drop("__new", "__go", "__first", "__order")


def replied(asked: DataFrame, provider: Callable[[DataFrame], DataFrame], retry: bool = True) -> DataFrame:
    """(qid, reply, rounds): what a provider says to asked (qid, question, evidence, is_list, ...), asked again where need be.

    provider gets the rows of a round, with its name in `round`, and gives (qid, reply). All are asked in round first. Those that abstain or
    refuse though there is evidence are asked in round abstain; list questions whose reply lacks a label of lists, in round list. An empty second
    reply leaves the first as it was; an empty first reply is not asked again. rounds names those that were asked, with a + between.
    """
    text = lambda c: strip(F.coalesce(c, F.lit("")))

    def round_of(rows: DataFrame, name: str, which: Column) -> DataFrame:
        part = rows.filter(which).drop("said", "rounds").withColumn("round", F.lit(name))
        got = kept(provider(part).groupBy("qid").agg(text(F.max("reply")).alias("again")))
        both = rows.join(got, "qid", "left").withColumn("rounds", F.when(which, F.concat_ws("+", "rounds", F.lit(name))).otherwise(F.col("rounds")))
        return kept(both.withColumn("said", F.when(which & (F.coalesce("again", F.lit("")) != ""), F.col("again")).otherwise(F.col("said"))).drop("again"))

    rows = round_of(kept(asked.withColumns({"said": F.lit(""), "rounds": F.lit(None).cast("string")})), "first", F.lit(True))
    if retry:
        some = (F.col("said") != "") & (text(F.col("evidence")) != "")
        rows = round_of(rows, "abstain", some & ((F.col("said") == NO_ANSWER) | is_refusal(F.col("said"))))
    some = (F.col("said") != "") & (text(F.col("evidence")) != "")
    lacks = F.lit(False)
    for label in LIST_LABELS:
        lacks = lacks | ~F.contains("said", F.lit(label))
    return round_of(rows, "list", some & F.col("is_list") & lacks).select("qid", F.col("said").alias("reply"), "rounds")


def finished(reply: Column) -> Column:
    """A reply as it is shown: cleaned, once more if words about sources are left; null if nothing or a refusal remains."""
    once = clean_style(reply)
    out = F.when(once.rlike("|".join(META_WORDS)), clean_style(once)).otherwise(once)
    return F.when(~is_refusal(out) & (strip(out) != NO_ANSWER), strip(out))
