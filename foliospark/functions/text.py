"""Text as columns: white space and sentences by Unicode rules, lengths in code points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CJK = r"[一-鿿]"
LINE_END = r"\r\n|[\n\r\x0B\f\x1c-\x1e\x85\u2028\u2029]"


def strip(c: Column) -> Column:
    """c without white space at its ends; null is empty."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)^\s+|\s+$", "")


def collapse(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s+", " ")


def lines(c: Column) -> Column:
    """Normalised lines that aren't blank."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), LINE_END), lambda x: collapse(strip(x))), lambda x: x != "")


def grams(run: Column, n: int) -> Column:
    """Substrings of n code points, in order; none for shorter runs."""
    at = F.when(F.length(run) >= n, F.sequence(F.lit(1), F.length(run) - (n - 1))).otherwise(F.expr("cast(array() as array<int>)"))
    return F.transform(at, lambda i: F.substring(run, i, F.lit(n)))


def tokens(c: Column) -> Column:
    """Pairs of neighbouring CJK characters (single ones as they are), then ASCII words in lower case."""
    text = F.coalesce(c, F.lit(""))
    cjk = F.flatten(F.transform(F.regexp_extract_all(text, F.lit(f"{CJK}+"), F.lit(0)), lambda r: F.when(F.length(r) == 1, F.array(r)).otherwise(grams(r, 2))))
    return F.concat(cjk, F.transform(F.regexp_extract_all(text, F.lit("[A-Za-z0-9]+"), F.lit(0)), F.lower))


def sentences(c: Column) -> Column:
    """Pieces that end after a sentence mark or a line, stripped, without empty ones."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"(?<=[。！？；;.!?\n])"), strip), lambda x: x != "")


def cjk_sentences(c: Column) -> Column:
    """Pieces split at white space after a CJK sentence mark; the text itself if there is none."""
    found = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"(?U)(?<=[。！？；])\s+"), strip), lambda x: x != "")
    return F.when(F.size(found) > 0, found).otherwise(F.array(strip(c)))


def snippet(c: Column, most: int = 450) -> Column:
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit("…"))).otherwise(c)


def truncate(c: Column, most: int | Column) -> Column:
    """c cut after the last sentence mark within `most` characters, if that keeps 60 % of them, and marked with …"""
    text, n = strip(c), F.lit(most) if isinstance(most, int) else most
    head = F.substring(text, F.lit(1), n)
    last = F.length(F.regexp_extract(head, r"(?s)^(.*)[。！？；….!?;\n]", 1))
    has = head.rlike(r"(?s)[。！？；….!?;\n]")
    cut = F.when(has & (last >= F.floor(n * 0.6)), F.substring(head, F.lit(1), last + 1)).otherwise(head)
    return F.when((n <= 0) | (F.length(text) <= n), text).otherwise(F.concat(F.regexp_replace(cut, r"(?U)\s+$", ""), F.lit("…")))


def clamp01(c: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))
