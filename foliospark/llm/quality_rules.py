"""Quality rules with a distribution test, in built-in functions only.

A text fails on its own if it has few words or mostly repeats itself. Of the others, the histogram of character classes
and that of common words, with one bin for all other words, are held against references of the text's language, which
are summed up over all documents that pass the base rules. The distance is Jensen-Shannon's, for words as a share of that of a text without
any common word; texts too short for a stable histogram are not judged by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, small, words

MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Classes of characters, as they stand in brackets; what is left over is the last class.
CLASSES = {"lower": r"\p{Ll}\p{Lo}", "upper": r"\p{Lu}", "digit": r"\p{Nd}", "sentence": r".,;:?'\"()-", "symbol": r"#*$%&|<>!~^=+@_/\\{}\[\]"}
MAX_CLASS_DISTANCE = 0.30  # Jensen-Shannon distance (root of the divergence in bits)
MAX_WORD_DISTANCE = 0.70
COMMON_WORDS = 24  # per language
MIN_CHARS = 200  # below this a text's histogram of classes is not judged
MIN_JUDGED_WORDS, MIN_COMMON = 150, 60  # a text with fewer words, and fewer common ones, is not judged by its words
MOST_LANGUAGES = 10_000  # up to so many the references are broadcast, beyond they are joined by a shuffle


def _n(text: Column, chars: str) -> Column:
    """How many characters of a class a text has: what is left when runs of all others are taken out."""
    return F.length(F.regexp_replace(text, f"[^{chars}]+", "")).cast("long")


def windows(w: Column) -> Column:
    """64-bit hashes of the windows of three words of the array w, in order."""
    hashes = F.transform(w, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))
    return F.slice(hashes, F.lit(1), F.greatest(F.size(w) - 2, F.lit(0)))


def uncommon(text: Column) -> Column:
    """A text without white space and the letters of the class lower: all else is counted in what is left."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), rf"[\x20\x09-\x0D{CLASSES['lower']}]+", "")


def base(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, ...) with the base numbers: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words.

    Windows are told apart by 64-bit hashes; a text without a repeated window sorts nothing. Further columns for judge():
    __words and __rest, what uncommon() leaves of the text.
    """
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.rlike(x, F.lit(WORD)))
    out = docs.withColumns({"__words": words(F.col("text")), "__l": lines, "__rest": uncommon(F.col("text"))})
    out = out.withColumns({"__h": windows(F.col("__words")), "word_chars": F.length(F.array_join("__words", "")).cast("long")})
    pairs = F.sort_array(F.transform("__h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    out = out.withColumn("__s", F.when(F.size(F.array_distinct("__h")) < F.size("__h"), pairs))
    again = F.filter("__s", lambda x, k: (F.get(F.col("__s"), k - 1)["h"] == x["h"]) | F.coalesce(F.get(F.col("__s"), k + 1)["h"] == x["h"], F.lit(False)))
    out = out.withColumn("__i", F.transform(again, lambda x: x["i"]))
    return out.select(
        *docs.columns,
        F.size("__words").cast("long").alias("n_words"),
        "word_chars",
        _n(F.col("__rest"), r"#*$%&|<>").alias("n_symbols"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        F.coalesce(F.size(F.array_distinct(F.flatten(F.transform("__i", lambda i: F.array(i, i + 1, i + 2))))), F.lit(0)).cast("long").alias("n_repeat_words"),
        "__words",
        "__rest",
    )


def jensen_shannon(p: Column, q: Column) -> Column:
    """Distance of two arrays of shares, 0 to 1: the root of the divergence in bits; null if one is null."""
    term = lambda a, m: F.when(a > 0, a * F.log2(a / m)).otherwise(0.0)
    parts = F.zip_with(p, q, lambda a, b: 0.5 * term(a, (a + b) / 2) + 0.5 * term(b, (a + b) / 2))
    return F.when(parts.isNotNull(), F.sqrt(F.greatest(F.lit(0.0), F.aggregate(parts, F.lit(0.0), lambda s, x: s + x))))


def _sum(counts: Column) -> Column:
    return F.aggregate(counts, F.lit(0).cast("long"), lambda s, x: s + x)


def _shares(counts: Column) -> Column:
    total = _sum(counts)
    return F.transform(counts, lambda x: F.when(total > 0, x / total).otherwise(0.0))


def _with_others(counts: Column, n: Column) -> Column:
    """Counts of common words with one more bin: all others of n words."""
    return F.concat(counts, F.array(n - _sum(counts)))


def classes(rest: Column, n_solid: Column) -> Column:
    """Counts of a text's characters by class, white space left out, from what uncommon() leaves of it.

    The last class is the rest.
    """
    others = [_n(rest, p) for name, p in CLASSES.items() if name != "lower"]
    left = F.length(rest).cast("long")
    return F.array(n_solid - left, *others, F.greatest(left - sum(others), F.lit(0).cast("long")))


def common_words(docs: DataFrame) -> DataFrame:
    """One row per language: its COMMON_WORDS most frequent words in lower case (ref_words).

    Ties of words go by the word. A null language is one of its own. Counts are summed where texts are read, before
    they are shuffled.
    """
    each = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.explode(words(F.col("text"))).alias("word"))
    counts = each.groupBy("lang", F.lower("word").alias("word")).agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    top = counts.withColumn("r", rank).filter(F.col("r") <= COMMON_WORDS).groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("r", "word"))).alias("t"))
    return top.select("lang", F.col("t.word").alias("ref_words"))


def _few(known: DataFrame) -> DataFrame:
    """known (one row per language) with a broadcast hint, if it is as small as it should be."""
    return small(known, MOST_LANGUAGES)


def judge(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, and the
    distances class_distance and word_distance (null where too short to judge).

    Null texts have no words and fail; repeated rows get equal verdicts; an empty table gives an empty result; texts are read
    whole, however long. A distance of just the threshold passes. Other columns are ignored.

    word_distance is 1 for a text without any common word of its language, and null for texts of few words and few
    common ones.

    Texts are read twice: for the common words, and for all else. What the second pass finds is written once, counts of
    classes and common words included, so that references are sums over narrow rows and filters on the verdict run no
    rule again.
    """
    docs = docs.select("doc_id", "text", "lang")
    known = cut(common_words(docs)).withColumnRenamed("lang", "__lang")
    rows = base(docs).withColumn("__lang", F.coalesce("lang", F.lit("")))
    rows = rows.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))
    rows = rows.join(_few(known), "__lang", "left")
    hits = F.filter(F.transform("__words", F.lower), lambda w: F.array_contains("ref_words", w))
    rows = rows.withColumns({"__c": classes(F.col("__rest"), F.col("word_chars")), "__hits": F.when(~F.col("base_failed"), hits)})
    rows = rows.withColumn("__k", F.transform("ref_words", lambda r: (F.size("__hits") - F.size(F.array_remove("__hits", r))).cast("long")))
    numbers = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    rows = cut(rows.select(*numbers, "__lang", "__c", F.when(~F.col("base_failed"), F.col("__k")).alias("__k")))
    summed = lambda c, n: F.array_compact(F.array(*[F.sum(F.get(c, F.lit(i))) for i in range(n)]))
    totals = rows.filter("not base_failed").groupBy("__lang").agg(summed("__c", len(CLASSES) + 1).alias("ref_classes"), summed("__k", COMMON_WORDS).alias("ref_counts"), F.sum("n_words").alias("ref_n"))
    totals = totals.withColumn("ref_k", _with_others(F.col("ref_counts"), F.col("ref_n")))
    none = F.transform("ref_k", lambda x, i: (i == F.size("ref_counts")).cast("double"))
    totals = totals.withColumn("__none", jensen_shannon(none, _shares(F.col("ref_k"))))
    rows = rows.join(_few(cut(totals)), "__lang", "left")
    words_of = _shares(_with_others(F.col("__k"), F.col("n_words")))
    long = ~F.col("base_failed") & ((F.col("n_words") >= MIN_JUDGED_WORDS) | (_sum(F.col("__k")) >= MIN_COMMON))
    rows = rows.withColumn("word_distance", F.when(long, jensen_shannon(words_of, _shares(F.col("ref_k"))) / F.nullif("__none", F.lit(0.0))))
    judged = F.when(~F.col("base_failed") & (F.col("word_chars") >= MIN_CHARS), F.col("__c"))
    rows = rows.withColumn("class_distance", jensen_shannon(_shares(judged), _shares(F.col("ref_classes"))))
    verdict = (F.coalesce("class_distance", F.lit(0.0)) <= MAX_CLASS_DISTANCE) & (F.coalesce("word_distance", F.lit(0.0)) <= MAX_WORD_DISTANCE)
    return rows.select(*numbers, (~F.col("base_failed") & verdict).alias("kept"), "class_distance", "word_distance")
