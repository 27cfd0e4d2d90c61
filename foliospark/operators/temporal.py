"""First appearances in document order: chunks (book, doc_ord, page_start, page_end, chapter, text)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..conf import DEFAULT
from .automaton import Automaton, points
from .spotting import Names, agreeing, kept, longest, searched, small, spotted
from .understand import TEMPORAL_NOISE, temporal_target, without_noise

#: Words that results depend on.
STRONG = ("抓到", "抓住", "拿到", "赢", "获胜", "打败", "击中", "杀死", "救", "救了", "追上", "击倒", "扑向", "冲向", "出手")
EVENTS = ("比赛", "魁地奇", "决斗", "战斗", "项目", "任务", "行动", "交锋", "对抗")
ROLES, OBJECTS, SAYS = ("队长", "找球手", "勇士", "选手"), ("金色飞贼", "飞贼", "金蛋", "项目"), ("说", "问", "答道", "说道", "喊道", "叫道", "嘟囔", "告诉")
ALIAS_STOP = ("先生", "女士", "教授", "队长", "找球手", "学院", "学生", "爸爸", "妈妈", "第一个", "第一场")
ALIAS_BAD, ALIAS_BAD_END, PRIMARY_BAD_END = "在的了是有这那我你他她它们与和", "说道问指过大小", "迎进出正也在说问道看望走"
NEAR = ((ROLES, 8, 1), (STRONG, 10, 4), (OBJECTS, 12, 2), (SAYS, 8, 2))  # words, characters between, points


def participation(texts: list[str], text: np.ndarray, start: np.ndarray, length: np.ndarray, words: Automaton, of: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Whether words of each kind of NEAR follow the names that begin at these places of texts closely enough (a matrix by kind and
    name), and whether each text has words of EVENTS. words finds the words of all kinds; of: their numbers, by kind, EVENTS last."""
    sizes = np.array([len(t) for t in texts], np.int64)
    apart = max(gap for _, gap, _ in NEAR) + 1  # places between texts, so that nothing is near in another text
    begins = np.cumsum(sizes + apart) - sizes - apart
    end = begins[text] + start + length
    where, at, which = words.find(texts)
    line_end = np.flatnonzero(points("\n".join(texts)) == 10)
    line_end = line_end + np.searchsorted(np.cumsum(sizes + 1), line_end, side="right") * (apart - 1)
    far = np.int64(1) << 60
    after = lambda places: np.append(places, far)[np.searchsorted(places, end)]
    stop, near = after(line_end), []
    for (_, gap, _), numbers in zip(NEAR, of):
        own = np.isin(which, numbers)
        word = after(begins[where[own]] + at[own])
        near.append((word - end <= gap) & (word <= stop))
    eventful = np.zeros(len(texts), bool)
    eventful[where[np.isin(which, of[-1])]] = True
    return np.array(near), eventful


def aliases(asked: DataFrame, chunks: DataFrame, scan: int = DEFAULT.temporal_candidates) -> DataFrame:
    """(qid, name, aliases, alias): the forms under which names (qid, name) go, longest first, and the short one to mention.

    In the first `scan` chunks that hold a name, name·XX gives XX, and nameXX before a mark does if some ·XX stands there too.
    The name itself is always an alias. alias is the shortest other one that looks like a name; null if there is none.
    """
    on = ("book",) if "book" in asked.columns else ()
    names, texts = kept(asked.select(*on, "name").distinct()), chunks.select(*on, "doc_ord", "text")
    order = F.row_number().over(Window.partitionBy(*on, "name").orderBy("doc_ord"))
    # which chunks are first is found without their texts; only those of the first are read again
    first = spotted(texts, names, on=on, carry=(*on, "doc_ord")).withColumn("r", order).filter(F.col("r") <= scan).drop("r").distinct()
    rows = texts.join(small(kept(first)), [*on, "doc_ord"]).filter(F.contains("text", "name"))
    dotted = F.expr(r"regexp_extract_all(text, concat('\\Q', name, '\\E·([一-鿿]{2,4})'), 1)")
    joined = F.expr(r"regexp_extract_all(text, concat('\\Q', name, '\\E([一-鿿]{2,4})(?=[，。,；;：:\n\r\t —-]|$)'), 1)")
    fit = lambda c: ~c.isin(*ALIAS_STOP) & ~c.rlike(TEMPORAL_NOISE) & ~c.rlike(f"[{ALIAS_BAD}]|[{ALIAS_BAD_END}]$")
    every = F.regexp_extract_all("text", F.lit("·([一-鿿]{2,4})"), F.lit(1))
    # what forms may follow from is taken out of the texts first, so that texts aren't shuffled
    rows = rows.select(*on, "name", "doc_ord", dotted.alias("d"), joined.alias("j"), every.alias("v"))
    rows = rows.withColumn("r", order).filter(F.col("r") <= scan)
    held = rows.groupBy(*on, "name").agg(*[F.array_distinct(F.flatten(F.collect_list(c))).alias(c) for c in "djv"])
    found = F.concat(F.filter("d", fit), F.filter(F.array_intersect("j", "v"), fit))
    held = held.select(*on, "name", F.array_distinct(found).alias("found"))
    out = asked.join(held, [*on, "name"], "left").withColumn("found", F.array_except(F.coalesce("found", F.expr("cast(array() as array<string>)")), F.array("name")))
    by_length = F.transform(F.array_sort(F.transform(F.concat(F.array("name"), "found"), lambda x: F.struct((-F.length(x)).alias("n"), x.alias("x")))), lambda s: s["x"])
    short = F.array_min(F.transform(F.filter("found", lambda x: (F.length(x) <= 4) & ~x.rlike(f"[{PRIMARY_BAD_END}]$")), lambda x: F.struct(F.length(x).alias("n"), x.alias("x"))))
    return out.select("qid", *on, "name", by_length.alias("aliases"), short["x"].alias("alias"))


def named(questions: DataFrame, names: DataFrame | None = None, most: int = 3) -> DataFrame:
    """(qid, names) that questions (qid, text) about first appearances are about: what stands before the mark of a first appearance;
    else the known names (name) in the text, those without words of actions first of all; else its CJK spans."""
    target = F.array_compact(F.array(temporal_target(F.col("text"))))
    rows = questions.select("qid", "text", target.alias("target"))
    held = F.expr("cast(null as array<string>)")
    if names is not None:
        found = longest(rows.filter(F.size("target") == 0), names, most).groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "name"))), lambda x: x["name"]).alias("held"))
        rows, held = rows.join(found, "qid", "left"), without_noise(F.col("held"), most)
    plain = F.slice(F.filter(F.regexp_extract_all("text", F.lit(r"[一-鿿·]{2,10}"), F.lit(0)), lambda c: ~c.rlike(TEMPORAL_NOISE)), 1, most)
    return rows.select("qid", F.when(F.size("target") > 0, F.col("target")).otherwise(F.coalesce(held, plain)).alias("names"))


def first_appearance(asked: DataFrame, chunks: DataFrame) -> DataFrame:
    """(qid, book, doc_ord, points) for names (qid, name, and book if they are of one): the first chunk where the name acts (5
    points), else takes part, else is mentioned. With a column aliases, these stand for the name, and their points add up.

    Chunks meet only the names that they hold, where they stand: a task looks for words near names by their places, and passes on
    the best chunk of a question and book among those that it has at a time. No text leaves it.
    """
    on = ("book",) if "book" in asked.columns else ()
    names = asked.select("qid", *on, F.explode(F.array_distinct("aliases")).alias("name")) if "aliases" in asked.columns else asked.select("qid", *on, "name")
    kinds = [*(w for w, _, _ in NEAR), EVENTS]
    every = sorted({w for k in kinds for w in k})
    words, of = Automaton(every), [np.array([every.index(w) for w in k]) for k in kinds]
    worth = np.array([p for _, _, p in NEAR])
    schema = StructType([names.schema["qid"], chunks.schema["book"], chunks.schema["doc_ord"], StructField("points", LongType())])

    def give(part: pa.Table, texts: list[str], known: Names) -> Iterator[pa.Table]:
        text, start, name = known.automaton.find(texts)
        near, eventful = participation(texts, text, start, known.automaton.lengths[name], words, of)
        pair, of_pair = np.unique(text * max(1, len(known.counts)) + name, return_inverse=True)
        acts = np.zeros(len(pair), np.int64)
        for flags, p in zip(near, worth):
            some = np.zeros(len(pair), bool)
            some[of_pair[flags]] = True
            acts += p * some
        text, name = np.divmod(pair, max(1, len(known.counts)))
        which, row = known.rows_of(name)
        text, acts = text[which], acts[which]
        if on:
            fits = agreeing(part, known.rows, text, row, on)
            text, acts, row = text[fits], acts[fits], row[fits]
        # a question's names add up in a chunk
        qids = known.rows["qid"].combine_chunks().dictionary_encode(null_encoding="encode")
        qid, n = qids.indices.to_numpy(), max(1, len(qids.dictionary))
        both, of_both = np.unique(text * n + qid[row], return_inverse=True)
        text, asks = np.divmod(both, n)
        got = np.bincount(of_both, acts, len(both)).astype(np.int64) + eventful[text]
        book = part["book"].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()[text]
        place = pc.rank(part["doc_ord"], "ascending", null_placement="at_start", tiebreaker="min").to_numpy().astype(np.int64)[text]
        group = asks * (int(book.max(initial=0)) + 1) + book
        order = np.lexsort((got, place, np.where(got >= 5, 0, np.where(got >= 1, 1, 2)), group))
        best = order[np.unique(group[order], return_index=True)[1]]
        text = pa.array(text[best])
        yield pa.table([qids.dictionary.take(pa.array(asks[best])), part["book"].take(text), part["doc_ord"].take(text), pa.array(got[best])], ["qid", "book", "doc_ord", "points"])

    rows = searched(chunks.select("book", "doc_ord", "text"), names, schema, give, by=("qid",))
    best = F.min(F.struct(F.when(F.col("points") >= 5, 0).when(F.col("points") >= 1, 1).otherwise(2).alias("c"), "doc_ord", "points"))
    return rows.groupBy("qid", "book").agg(best.alias("b")).select("qid", "book", "b.doc_ord", "b.points")


def around(anchors: DataFrame, chunks: DataFrame, keep: int = DEFAULT.temporal_keep, reach: int = 24, page_reach: int = 3) -> DataFrame:
    """(qid, book, doc_ord, rank): chunks about an anchor, of its chapter and near its page, in document order, the first
    `keep` of them. Anchors are joined with the places around them, not with books."""
    a = small(kept(anchors)).join(chunks.select("book", "doc_ord", "page_start", "page_end", "chapter"), ["book", "doc_ord"])
    a = a.select("qid", "book", F.explode(F.sequence(F.col("doc_ord") - reach, F.col("doc_ord") + reach - 1)).alias("doc_ord"), F.col("page_start").alias("a_page"), F.col("page_end").alias("a_end"), F.coalesce("chapter", F.lit("")).alias("a_chapter"))
    rows = chunks.select("book", "doc_ord", "page_start", F.coalesce("chapter", F.lit("")).alias("chapter")).join(small(kept(a)), ["book", "doc_ord"])
    same = (F.col("chapter") == F.col("a_chapter")) | (F.col("chapter") == "") | (F.col("a_chapter") == "")
    low, high = F.when(F.col("a_page") > 0, F.col("a_page") - page_reach).otherwise(1), F.when(F.col("a_end") > 0, F.col("a_end") + 2)
    near = F.coalesce(F.col("page_start") <= 0, F.lit(True)) | (F.col("page_start") >= low) & (high.isNull() | (F.col("page_start") <= high))
    rank = F.row_number().over(Window.partitionBy("qid", "book").orderBy("doc_ord"))
    return rows.filter(same & near).withColumn("rank", rank).filter(F.col("rank") <= keep).select("qid", "book", "doc_ord", "rank")


def in_order(hits: DataFrame, names: DataFrame, keep: int = DEFAULT.temporal_keep) -> DataFrame:
    """hits (qid, text, doc_ord, ...) that hold one of a question's names (qid, names), or all where none does, by their place
    in the document, the first `keep`."""
    rows = hits.join(small(names), "qid", "left")
    held = F.coalesce(F.exists("names", lambda n: F.contains(F.col("text"), n)), F.lit(False))
    rows = rows.withColumn("held", held).withColumn("some", F.max("held").over(Window.partitionBy("qid"))).filter(F.col("held") | ~F.col("some"))
    rank = F.row_number().over(Window.partitionBy("qid").orderBy("doc_ord", "chunk_id"))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= keep).drop("held", "some", "names")
