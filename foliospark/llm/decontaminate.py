"""Benchmark decontamination by spaced seeds, in built-in functions only.

A document leaks an item if somewhere WINDOW words of the item in a row (all of them, if it has fewer) stand in it with at
most a fifth of them replaced; items of up to five words stand there exactly. The rule is the same for items and documents
of every length.

A seed is a fixed mask over consecutive words that counts five of them and ignores the rest, so a replaced word between
counted ones does not hide a passage. The masks are chosen so that no window within the rule escapes all of them. All
places of all documents are hashed under each mask, and the documents that share a hash with the benchmark are found by a
semi-join of hashes alone. In those, the document is laid over the item around every hit, word by word without shifts, and
equal words are counted window by window.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, small, words

#: Each mask counts five words (1) and ignores the others (0). With these, every window of 6 to WINDOW words with at most a
#: fifth of them replaced has a place where a mask fits (a test goes through all of them).
MASKS = ("11111", "101111", "110111", "111011", "111101", "1111001")
WINDOW, SIMILARITY = 13, 0.8
EXACT = 5  # items of up to so many words stand exactly
PIECE = 32  # places of an item that are laid over a document together
AROUND = 64  # words of a document before and after a hit that are at hand: a piece and two windows fit in
SEED_ROWS = 1_000_000  # of the benchmark that are broadcast (16 bytes each); beyond, hashes are joined by a shuffle


def tokens(text: Column) -> Column:
    """Hashes of the words in lower case without punctuation at word ends; words of nothing else are left out."""
    bare = F.transform(words(F.lower(text)), lambda w: F.trim(w, F.lit(".,;:!?\"'()[]")))
    return F.transform(F.filter(bare, lambda w: w != ""), lambda w: F.xxhash64(w))


def _words_at(h: Column, at: Column) -> list[Column]:
    """The word hashes from a place on, each turned by its distance; null after the end."""
    every = [F.get(h, at + i) for i in range(max(map(len, MASKS)))]
    return [(w if not i else F.shiftleft(w, 9 * i).bitwiseOR(F.shiftrightunsigned(w, 64 - 9 * i))).alias(f"__w{i}") for i, w in enumerate(every)]


def _seed(mask: str) -> Column:
    """The hash of the words that a mask counts, over the columns of _words_at: word hashes, turned and put together bit by bit."""
    return reduce(Column.bitwiseXOR, [F.col(f"__w{i}") for i, c in enumerate(mask) if c == "1"], F.lit(int(mask, 2) * 0x9E3779B97F4A7C1 % (1 << 62)))


def pieces(benchmark: DataFrame) -> DataFrame:
    """(item_id, n, lo, word_at, at, to): pieces of the items, each once: word hashes from place lo of the item on, of which
    those of the places at to `to` are its own and the others reach a window further on both sides."""
    items = benchmark.select("item_id", tokens(F.col("text")).alias("item")).distinct().withColumn("n", F.size("item")).filter("n > 0")
    cuts = items.select("*", F.explode(F.expr(f"sequence(0, n - 1, {PIECE})")).alias("at"))
    cuts = cuts.withColumns({"lo": F.greatest(F.col("at") - (WINDOW - 1), F.lit(0)), "to": F.least(F.col("at") + PIECE, F.col("n"))})
    return cuts.select("item_id", "n", "at", "to", "lo", F.slice("item", F.col("lo") + 1, F.least(F.col("to") + WINDOW - 1, F.col("n")) - F.col("lo")).alias("word_at"))


def seeds(parts: DataFrame) -> DataFrame:
    """(seed, piece, q): the hash under each mask at each place q of a piece's own; of items under five words, the whole."""
    places = parts.select("piece", "n", "lo", "word_at", F.explode(F.sequence(F.col("at"), F.col("to") - 1)).alias("q"))
    places = places.select("piece", "n", "q", *_words_at(F.col("word_at"), F.col("q") - F.col("lo")))
    fits = lambda m: (F.col("n") >= len(m)) & (F.col("q") + len(m) <= F.col("n")) if len(m) >= 5 else (F.col("n") == len(m)) & (F.col("q") == 0)
    every = F.array_compact(F.array(*[F.when(fits(m), _seed(m)) for m in _masks(range(1, 5))]))
    return places.select("piece", "q", F.explode(every).alias("seed"))


def _masks(short: list[int] | range) -> list[str]:
    return [*("1" * k for k in short), *MASKS]


def _places(texts: DataFrame) -> DataFrame:
    """(doc_id, text_hash, h, p, words there): every place p of the word hashes h of each text."""
    h = texts.select("doc_id", "text_hash", tokens(F.col("text")).alias("h"))  # a filter here would run before the semi-join
    return h.select("doc_id", "text_hash", "h", F.explode(F.when(F.size("h") > 0, F.sequence(F.lit(0), F.size("h") - 1))).alias("p")).select("*", *_words_at(F.col("h"), F.col("p")))


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, text_hash, item_id, matched, compared): documents that hold an item or WINDOW words in a row of it.

    One row per document text and item, with the best window: of `compared` words (WINDOW, or all of a shorter item) at
    least SIMILARITY are equal at the same places, all of them if compared is EXACT or less. Null texts and texts and items
    without words hold and are nothing; repeated rows are reported once; null ids are reported as null; an empty benchmark
    finds nothing, an empty table of documents holds nothing. Texts are read whole, however long; of equally good windows one is reported. Other
    columns are ignored.
    """
    parts = cut(pieces(benchmark).withColumn("piece", F.monotonically_increasing_id()))
    short = sorted(r[0] for r in parts.filter("n < 5").select("n").distinct().collect())  # of 1 to 4
    asked = cut(seeds(parts))
    texts = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    at = F.array(*[_seed(m) for m in _masks(short)])
    seen = _places(texts).select("doc_id", "text_hash", F.explode(at).alias("seed")).join(small(asked.select("seed").distinct(), SEED_ROWS), "seed", "left_semi")
    seen = cut(seen.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).distinct())
    near = _places(texts.join(small(seen), F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("text_hash") == F.col("__hash")), "left_semi"))
    back = F.least("p", F.lit(AROUND))
    near = near.select("doc_id", "text_hash", "p", back.alias("back"), F.slice("h", F.col("p") - back + 1, F.lit(2 * AROUND)).alias("around"), F.explode(at).alias("seed"))
    hits = near.join(small(asked, SEED_ROWS), "seed").join(small(parts, SEED_ROWS // 50), "piece")
    # word k of the piece lies at back + lo + k - q of what is around the hit; equal ones are written as 1
    where = F.col("back") + F.col("lo") - F.col("q")
    equal = F.array_join(F.transform("word_at", lambda w, k: F.when(F.get("around", where + k) == w, "1").otherwise("0")), "")
    # few rows, written so that windows are counted once for each and not for each hit
    laid = cut(hits.select("doc_id", "text_hash", "item_id", F.least("n", F.lit(WINDOW)).alias("compared"), (F.col("p") - F.col("q")).alias("shift"), "lo", equal.alias("equal")).distinct())
    ones = F.transform(F.sequence(F.lit(1), F.length("equal") - F.col("compared") + 1), lambda j: F.length(F.replace(F.substr("equal", j, F.col("compared")), F.lit("0"), F.lit(""))))
    best = laid.select("doc_id", "text_hash", "item_id", "compared", F.array_max(ones).alias("matched"))
    enough = F.when(F.col("compared") <= EXACT, F.col("matched") == F.col("compared")).otherwise(F.col("matched") >= SIMILARITY * F.col("compared"))
    return best.filter(enough).groupBy("doc_id", "text_hash", "item_id", F.col("compared").cast("long").alias("compared")).agg(F.max("matched").cast("long").alias("matched")).select("doc_id", "text_hash", "item_id", "matched", "compared")


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that hold no benchmark passage, unchanged."""
    bad = cut(leaks(docs, benchmark).select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).distinct())
    return docs.join(small(bad), docs["doc_id"].eqNullSafe(F.col("__id")) & (F.xxhash64(docs["text"]) == F.col("__hash")), "left_anti")
