"""Pages (book, page_no, text) to clean, merged pages with chapters.

A book may hold a large part of all pages. Counts are grouped with partial aggregation, and the forward fill of chapters
works on blocks of pages, whose last chapters are then filled on (one row per block).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..conf import DEFAULT, EngineConf
from ..functions.text import lines, strip

#: Patterns and words that results depend on.
PAGE_NUMBER = r"(?i)^\s*([0-9]{1,4}|[ivxlcdm]{1,8})\s*$"
TOC_WORD = "目录"
TOC_LINE = r"(?U)\s[0-9]{1,4}\s*$"
TOC_HEADING = r"(?U)^(第[0-9一二三四五六七八九十百千]+[章節章节篇]|第[一二三四五六七八九十百千]+部)\b"
FRONT_WORDS = ("制作说明", "画廊", "封面", "作者简介", "统一书号", "ISBN", "排版", "字体", "请访问", "Pottermore", "版权", "出品")
CHAPTERS = (r"(?md)(第[0-9一二三四五六七八九十百千]+[章節章节篇][^\n]{0,40})", r"(?md)(^[0-9]+\s*[.、]\s*[^\n]{1,60})", r"(?md)(^[一二三四五六七八九十]+[、.]\s*[^\n]{1,60})")
NOT_CHAPTERS = ("制作说明", "画廊", "封面", "作者简介", "ISBN", "排版", "字体", "请访问", "Pottermore", "目录")
ENDS = r"(?U)[。！？；:：…]\s*$"


def boilerplate(pages: DataFrame) -> DataFrame:
    """(book, line): short lines that are among the first or the last three of at least 3 and 30 % of a book's pages."""
    rows = pages.select("book", lines(F.col("text")).alias("l"))
    least = rows.groupBy("book").agg(F.greatest(F.lit(3), (F.count("*") * 0.30).cast("int")).alias("least"))
    head = F.transform(F.slice("l", 1, 3), lambda x: F.struct(F.lit("h").alias("side"), x.alias("line")))
    tail = F.transform(F.when(F.size("l") < 3, F.col("l")).otherwise(F.slice("l", -3, 3)), lambda x: F.struct(F.lit("f").alias("side"), x.alias("line")))
    seen = rows.select("book", F.explode(F.concat(head, tail)).alias("x")).select("book", "x.side", "x.line").filter((F.length("line") >= 2) & (F.length("line") <= 60))
    return seen.groupBy("book", "side", "line").agg(F.count("*").alias("n")).join(least, "book").filter("n >= least").select("book", "line").distinct()


def without_boilerplate(pages: DataFrame) -> DataFrame:
    """pages with normalised lines, without boilerplate and page numbers; a page without lines left is ''."""
    bad = boilerplate(pages).groupBy("book").agg(F.collect_set("line").alias("bad"))  # lines that 30 % of pages share: few per book
    clean = F.filter("l", lambda x: ~F.coalesce(F.array_contains("bad", x), F.lit(False)) & ~x.rlike(PAGE_NUMBER))
    return pages.select("book", "page_no", lines(F.col("text")).alias("l")).join(bad, "book", "left").select("book", "page_no", F.array_join(clean, "\n").alias("text"))


def blank_before(pages: DataFrame, conf: EngineConf = DEFAULT) -> DataFrame:
    return pages.withColumn("text", F.when(F.col("page_no") < conf.content_start_page, "").otherwise(F.col("text")))


def is_toc(text: Column) -> Column:
    t = strip(text)
    n = F.size(lines(t))
    numbered = F.size(F.filter(lines(t), lambda x: (F.length(x) <= 90) & x.rlike(TOC_LINE)))
    return (t != "") & (F.contains(F.substring(t, 1, 200), F.lit(TOC_WORD)) | (n >= 10) & (numbered >= F.greatest(F.lit(8), (n * 0.6).cast("int"))))


def is_toc_like(text: Column) -> Column:
    ls = lines(text)
    n, heads = F.size(ls), F.size(F.filter(ls, lambda x: x.rlike(TOC_HEADING)))
    return (n >= 12) & (heads >= 8) & (F.size(F.filter(ls, lambda x: F.length(x) <= 36)) / F.greatest(n, F.lit(1)) >= 0.7)


def is_front_matter(text: Column) -> Column:
    t = strip(text)
    few = (F.length(t) <= 120) & (F.size(F.array_distinct(F.filter(F.split(t, ""), lambda x: x != ""))) <= 6)
    return (t != "") & (F.substring(t, 1, 800).rlike("|".join(FRONT_WORDS)) | few)


def content_pages(pages: DataFrame, conf: EngineConf = DEFAULT) -> DataFrame:
    """pages whose tables of contents and front matter are blanked, so that numbering stays."""
    drop = is_toc(F.col("text")) | is_toc_like(F.col("text")) | ((F.col("page_no") < max(80, conf.content_start_page)) & is_front_matter(F.col("text")))
    return pages.withColumn("text", F.when(drop, "").otherwise(F.coalesce("text", F.lit(""))))


def guard(pages: DataFrame, conf: EngineConf = DEFAULT) -> DataFrame:
    """(book, nonempty, chars, ok): whether a book has text enough to be worth indexing."""
    t = strip(F.col("text"))
    got = pages.groupBy("book").agg(F.count_if(t != "").alias("nonempty"), F.sum(F.length(t)).alias("chars"))
    return got.withColumn("ok", (F.col("nonempty") >= conf.min_nonempty_pages) & (F.col("chars") >= conf.min_total_chars))


def required(pages: DataFrame, conf: EngineConf = DEFAULT) -> DataFrame:
    """pages, or ValueError if there are none or a book has too little text."""
    poor = guard(pages, conf).filter(~F.col("ok")).orderBy("book").limit(20).collect()
    if poor:
        raise ValueError("too little text: " + ", ".join(f"{r.book} ({r.nonempty} pages, {r.chars} characters)" for r in poor))
    if pages.isEmpty():
        raise ValueError("no pages")
    return pages


def merged(pages: DataFrame, most: int = 2, block: int = 1024) -> DataFrame:
    """(book, page_start, page_end, text): a page that doesn't end a sentence joins the next, at most `most` pages together.

    Runs of such pages are found as islands and cut into groups of `most`; empty pages are no pages. Runs are found block by
    block of page numbers; how far a run has come at the end of a block is carried on in sums over blocks (one row each), so
    no task has a whole book.
    """
    rows = pages.select("book", "page_no", strip(F.col("text")).alias("text"), F.floor(F.col("page_no") / block).alias("block"))
    inside = Window.partitionBy("book", "block").orderBy("page_no")
    full = F.col("text") != ""
    rows = rows.withColumns({"i": F.row_number().over(inside), "full": full, "open": full & ~F.col("text").rlike(ENDS)})
    # whether a page goes on with the one before it: null at the begin of a block
    rows = rows.withColumn("goes_on", F.col("full") & F.lag("open").over(inside))
    rows = rows.withColumn("begin", F.max(F.when(~F.col("goes_on"), F.col("i"))).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    ends = rows.groupBy("book", "block").agg(F.count("*").alias("n"), F.max("begin").alias("begin"), F.min_by("full", "i").alias("first_full"), F.max_by("open", "i").alias("last_open"))
    order = Window.partitionBy("book").orderBy("block")
    goes_on = F.coalesce(F.col("first_full") & F.lag("last_open").over(order), F.lit(False))
    ends = ends.withColumns({"goes_on": goes_on, "tail": F.when(F.col("begin").isNull(), F.col("n")).otherwise(F.col("n") - F.col("begin") + 1)})
    ends = ends.withColumn("chain", F.sum((F.col("begin").isNotNull() | ~F.col("goes_on")).cast("int")).over(order))
    ends = ends.withColumn("so_far", F.sum("tail").over(Window.partitionBy("book", "chain").orderBy("block")))
    carried = F.when(F.col("goes_on"), F.lag("so_far").over(order)).otherwise(0)
    before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ends = ends.select("book", "block", carried.alias("carried"), before.alias("before"))
    rows = rows.filter("full").join(ends, ["book", "block"])
    place = F.when(F.col("begin").isNull(), F.col("carried") + F.col("i") - 1).otherwise(F.col("i") - F.col("begin"))
    rows = rows.withColumn("group", F.col("before") + F.col("i") - F.pmod(place, F.lit(most)))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_no", "text"))), lambda x: x["text"]), "\n")
    return rows.groupBy("book", "group").agg(F.min("page_no").alias("page_start"), F.max("page_no").alias("page_end"), joined.alias("text")).drop("group")


def chapter_of(text: Column, patterns: tuple[str, ...] = CHAPTERS) -> Column:
    """The first heading in the first forty lines, of the first of the patterns that has one; null without one, or if it is no chapter's."""
    head = F.array_join(F.slice(F.split(strip(text), "\n"), 1, 40), "\n")
    found = F.coalesce(*[F.nullif(F.regexp_extract(head, p, 1), F.lit("")) for p in patterns])
    return F.when(~found.rlike("|".join(NOT_CHAPTERS)), strip(found))


def chapters(pages: DataFrame, block: int = 1024, patterns: tuple[str, ...] = CHAPTERS) -> DataFrame:
    """pages with chapter: the page's own, or that of the nearest page before it; '' before the first."""
    rows = pages.withColumn("__own", chapter_of(F.col("text"), patterns)).withColumn("__block", F.floor(F.col("page_no") / block))
    inside = Window.partitionBy("book", "__block").orderBy("page_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("__here", F.last("__own", ignorenulls=True).over(inside))
    ends = rows.groupBy("book", "__block").agg(F.max_by("__own", F.when(F.col("__own").isNotNull(), F.col("page_no"))).alias("end"))
    before = F.last("end", ignorenulls=True).over(Window.partitionBy("book").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1))
    ends = ends.select("book", "__block", before.alias("__before"))
    return rows.join(ends, ["book", "__block"]).withColumn("chapter", F.coalesce("__here", "__before", F.lit(""))).drop("__own", "__block", "__here", "__before")
