"""An entity index from texts alone: frequent n-grams, their postings, recall and longest match."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..conf import DEFAULT, EngineConf
from ..functions.text import CJK, grams, strip
from .automaton import points
from .spotting import longest, pieces, spread

#: Words and characters that results depend on.
STOP = ("什么", "怎么", "为什么", "为何", "哪里", "哪个", "哪些", "是否", "能否", "可以", "一下", "一段", "原文", "内容", "章节", "目录", "作者", "读者", "问题", "回答", "如下", "以上", "如下内容", "原文内容", "要求", "直接", "明确", "无法确定", "无法回答")
NOISY = ("第一次", "首次", "最早", "初次", "出现", "登场", "出场", "第", "章", "页", "……")
QUESTION_WORDS = ("第一次", "首次", "初次", "出现", "登场", "说", "做", "什么", "怎样", "如何")
FUNCTION_START = "的了和与在是有这那他她它"
TITLE = r"(?U)\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+){0,2}\b"
FIRST_INTENT, LAST_INTENT = r"(第一次|首次|初次).{0,6}(出现|登场)", r"(最后一次|最终|末次).{0,6}(出现|登场)"


def candidates(text: Column, conf: EngineConf = DEFAULT) -> Column:
    """N-grams of CJK runs, short ones first, then spans of capitalised words, without stop words, in order."""
    runs = F.filter(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"{CJK}+"), F.lit(0)), lambda r: F.length(r) >= 2)
    by_size = [F.transform(runs, lambda r: grams(r, n)) for n in range(conf.ngram_min, conf.ngram_max + 1)]
    cjk = F.flatten(F.concat(*by_size))
    return F.filter(F.concat(cjk, F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TITLE), F.lit(0))), lambda t: ~t.isin(*STOP))


def frequent(text: str, sizes: range, keep: int) -> list[tuple[str, int]]:
    """(term, tf): the terms of candidates() of highest (tf, length) in a text, ties by first place, `keep` at most.

    Grams are numbers: one of n characters is that of its first n - 1 and a character more. Sorted with their places behind them, they
    give counts and first places at once, and only those that are kept become strings.
    """
    chars = points(text).astype(np.int64)
    han = np.concatenate([[False], (chars >= 0x4E00) & (chars <= 0x9FFF), [False]])
    fits = han[1:-1] & (han[:-2] | han[2:])  # a run of one character has no grams
    bits = max(1, len(text).bit_length())
    mask, gram, found = (1 << bits) - 1, np.zeros(len(chars), np.int64), [np.zeros(0, np.int64)]
    for n in range(1, max(sizes) + 1):
        fits = fits & han[1:-1] if n == 1 else fits[:-1] & han[n:-1]
        place = np.flatnonzero(fits)
        code = (gram[place] << 15) + chars[place + n - 1] - 0x4E00
        if bits <= 24:
            both = np.sort(code << bits | place)
            code, place = both >> bits, both & mask
        else:
            order = np.argsort(code, kind="stable")
            code, place = code[order], place[order]
        new = np.append(True, code[1:] != code[:-1])[: len(code)]
        gram[place] = np.cumsum(new) - 1
        if n in sizes:
            begin = np.flatnonzero(new)
            found.append((np.diff(np.append(begin, len(code))) << 6 | n) << bits | mask - place[begin])
    stop, best, most = frozenset(STOP), np.concatenate(found), keep + len(STOP)
    best = np.sort(np.partition(best, -most)[-most:] if len(best) > most else best)[::-1]
    place, size, tf = (mask - (best & mask)).tolist(), (best >> bits & 63).tolist(), (best >> bits + 6).tolist()
    terms = [(text[p : p + n], k) for p, n, k in zip(place, size, tf)]
    if ((chars >= 65) & (chars <= 90)).any():
        terms = sorted(terms + list(Counter(re.findall(TITLE.removeprefix("(?U)"), text)).items()), key=lambda x: (-x[1], -len(x[0])))
    return [x for x in terms if x[0] not in stop][:keep]


def chunk_terms(chunks: DataFrame, conf: EngineConf = DEFAULT) -> DataFrame:
    """(chunk_id, page_start, term, tf): each chunk's terms of highest (tf, length), ties by first place, per_chunk_keep at most.

    Terms are those of candidates(), counted text by text; only what is kept leaves its task.
    """
    sizes, keep = range(conf.ngram_min, conf.ngram_max + 1), conf.per_chunk_keep

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for piece in pieces(b):
                best = [frequent(t or "", sizes, keep) for t in piece.column("text").to_pylist()]
                rows = np.repeat(np.arange(len(best)), [len(x) for x in best])
                part = [piece.column(c).take(pa.array(rows)) for c in ("chunk_id", "page_start")]
                yield pa.RecordBatch.from_arrays([*part, pa.array([t for x in best for t, _ in x], pa.string()), pa.array([n for x in best for _, n in x], pa.int64())], ["chunk_id", "page_start", "term", "tf"])

    kinds = dict(chunks.dtypes)
    return spread(chunks.select("chunk_id", "page_start", "text")).mapInArrow(count, f"chunk_id {kinds['chunk_id']}, page_start {kinds['page_start']}, term string, tf long")


def vocabulary(terms: DataFrame, n_chunks: int, conf: EngineConf = DEFAULT) -> DataFrame:
    """(name, df, idf) of terms in at least min_df chunks and at most max_df_ratio of them."""
    df = terms.groupBy(F.col("term").alias("name")).agg(F.count("*").alias("df"))
    most = F.greatest(F.ceil(F.lit(n_chunks * conf.max_df_ratio)), F.lit(conf.min_df))
    return df.filter((F.col("df") >= conf.min_df) & (F.col("df") <= most)).withColumn("idf", F.log((F.lit(n_chunks) + 1.0) / (F.col("df") + 1)) + 1)


def index(terms: DataFrame, names: DataFrame, conf: EngineConf = DEFAULT) -> DataFrame:
    """(name, chunk_id, page_start, tf, pos): the earliest chunks of a name first, then those of highest tf, max_postings at most."""
    rows = terms.withColumnRenamed("term", "name").join(names.select("name"), "name", "left_semi")
    rows = rows.withColumn("h", F.xxhash64("name"))  # rows are sorted by numbers first: names begin alike
    early = F.row_number().over(Window.partitionBy("h", "name").orderBy("page_start", "chunk_id"))
    rows = rows.withColumn("e", early).withColumn("late", F.col("e") > conf.keep_earliest)
    dense = F.row_number().over(Window.partitionBy("h", "name", "late").orderBy(F.desc("tf"), "page_start", "chunk_id"))
    pos = F.when(F.col("late"), F.lit(conf.keep_earliest) + dense).otherwise(F.col("e"))
    return rows.withColumn("pos", pos).filter(F.col("pos") <= conf.max_postings).drop("h", "e", "late")


def reasonable(t: Column) -> Column:
    """Whether a term of the postings may be looked for in questions."""
    return (F.length(t) >= 2) & (F.length(t) <= 24) & ~t.rlike("|".join(NOISY)) & ~t.rlike(f"^[{FUNCTION_START}]") & ~t.rlike(r"(?U)\s")


def mentions(questions: DataFrame, names: DataFrame, most: int = 3) -> DataFrame:
    """(qid, name, at): leftmost longest names in each question, not overlapping, `most` at most."""
    return longest(questions, names, most)


def intent(q: Column) -> Column:
    """'last' or 'first' if a question asks for an appearance, else null."""
    return F.when(strip(q).rlike(LAST_INTENT), "last").when(strip(q).rlike(FIRST_INTENT), "first")


def page_of(chunk_id: Column, page_start: Column) -> Column:
    """A chunk's page: the one it states, else the one in its id; null without either."""
    named = F.regexp_extract(chunk_id.cast("string"), r"^p([0-9]{1,7})_c[0-9]+$", 1)
    return F.when(page_start > 0, page_start.cast("long")).otherwise(F.nullif(named, F.lit("")).cast("long"))


def telling(asked: DataFrame) -> DataFrame:
    """asked (qid, name, ...) without names that hold words of questions, unless a question has no others."""
    rows = asked.withColumn("__plain", ~F.col("name").rlike("|".join(QUESTION_WORDS)))
    return rows.withColumn("__some", F.max("__plain").over(Window.partitionBy("qid"))).filter(F.col("__plain") | ~F.col("__some")).drop("__plain", "__some")


def recall(asked: DataFrame, names: DataFrame, postings: DataFrame, conf: EngineConf = DEFAULT) -> DataFrame:
    """(qid, chunk_id, score, page_start): sums of idf * (1 + sqrt(tf)) over the first postings of each mentioned name; a name
    twice counts twice.

    Where a question has an intent (a column of asked), a name's postings are taken by page, the earliest or the latest
    first, and those without a page not at all. A name without an idf counts as 1.
    """
    rows = telling(asked)
    rows = rows if "intent" in rows.columns else rows.withColumn("intent", F.lit(None).cast("string"))
    plain = rows.filter("intent is null").join(postings.filter(F.col("pos") <= conf.entity_postings), "name")
    by_page = postings.withColumn("page", page_of(F.col("chunk_id"), F.col("page_start"))).filter("page is not null")
    ends = {}
    for side, order in (("first", F.col("page")), ("last", F.col("page").desc())):
        rank = F.row_number().over(Window.partitionBy("name").orderBy(order, "pos"))
        ends[side] = rows.filter(F.col("intent") == side).join(by_page.withColumn("rank", rank).filter(F.col("rank") <= conf.entity_postings).drop("rank", "page"), "name")
    found = plain.unionByName(ends["first"]).unionByName(ends["last"]).join(names.select("name", "idf"), "name", "left")
    return found.groupBy("qid", "chunk_id").agg(F.round(F.sum(F.coalesce("idf", F.lit(1.0)) * (1 + F.sqrt("tf"))), 6).alias("score"), F.min("page_start").alias("page_start"))


def loaded(names: DataFrame, postings: DataFrame) -> DataFrame:
    """(name, idf) that questions are searched for: all names, and those that have postings only if they are reasonable; without
    an idf a name counts as 1."""
    more = postings.select("name", F.lit(None).cast("double").alias("idf")).filter(reasonable(F.col("name"))).distinct()
    return names.select("name", "idf").unionByName(more).groupBy("name").agg(F.coalesce(F.max("idf"), F.lit(1.0)).alias("idf"))
