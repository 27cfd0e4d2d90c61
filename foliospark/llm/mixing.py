"""Mixing sources to target weights by pivotal dependent rounding, in built-in functions only.

A source's target is a number of words; every document of it should be taken target / source size times. The whole part
of that is taken surely. The fractional parts are rounded together: of two documents, words are moved at random from
one to the other until one of the two is whole, which leaves the expectation of each and the sum of both as they were.
Documents are folded so in buckets of about FAN documents; each bucket hands on the one that is still fractional, and
the buckets' rests are folded in the same way, in a tree of as many levels as it takes until a source has one rest.
Large documents come first in a bucket, so that what is left over at the end is a small one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, small

SHARE = 1.5  # of all words that are taken
MOST = 2.0  # times a document at most
WEIGHTS = (3, 1, 2)  # of the sources in order, repeating
FAN = 32
SEED = 7


def targets(sizes: DataFrame, share: float = SHARE, most: float = MOST, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row per source; null is a source and comes last.

    Each round shares what is left by weight among the sources that are not full, and fills up those that get too much.
    """
    order = (F.col("source").isNull(), F.col("source"))
    ranged = cut(sizes.repartitionByRange(*order).withColumn("__p", F.spark_partition_id()))
    held = {r[0]: r[1] for r in ranged.groupBy("__p").count().collect()}  # one row per partition
    ahead = F.create_map(*[F.lit(x) for p in sorted(held) for x in (p, sum(n for q, n in held.items() if q < p))]) if held else F.lit(None)
    place = F.row_number().over(Window.partitionBy("__p").orderBy(*order)) - 1 + (ahead[F.col("__p")] if held else F.lit(0))
    at = cut(ranged.withColumn("weight", F.get(F.array(*map(F.lit, weights)), (place % len(weights)).cast("int")).cast("double")).withColumn("limit", most * F.col("source_size")))
    left = share * (at.agg(F.sum("source_size")).first()[0] or 0)
    rate, full = 0.0, 0
    while left > 0:
        over = (F.col("limit") <= rate * F.col("weight")) if full else F.lit(False)
        kept, weight = at.agg(F.sum(F.when(over, F.col("limit")).otherwise(0.0)), F.sum(F.when(over, 0.0).otherwise(F.col("weight")))).first()
        if not weight:
            break
        rate = max(0.0, left - kept) / weight
        now = at.filter(F.col("limit") <= rate * F.col("weight")).count()
        if now == full:
            break
        full = now
    return at.select("source", "source_size", F.least(F.col("limit"), rate * F.col("weight")).alias("target"))


def _draw(*cols: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(SEED), *cols), F.lit(1 << 40)) / float(1 << 40)


def _fold(x: str) -> Column:
    """Folds the array x of (order, tie, key, size, f) to (rest, done): the one still fractional, and (key, up) of the others."""
    unit = "struct<key:struct<id:bigint,salt:bigint>,size:bigint,f:double>"
    start = F.struct(F.lit(None).cast(unit).alias("rest"), F.expr("cast(array() as array<struct<key:struct<id:bigint,salt:bigint>,up:int>>)").alias("done"))

    def step(acc: Column, e: Column) -> Column:
        c, fresh = acc["rest"], F.struct(e["key"].alias("key"), e["size"].alias("size"), e["f"].alias("f"))
        up = F.least((1 - c["f"]) * c["size"], e["f"] * e["size"])  # words that can move to the carried one, and from it
        down = F.least(c["f"] * c["size"], (1 - e["f"]) * e["size"])
        gains = _draw(c["key"]["id"], e["key"]["id"], c["key"]["salt"], e["key"]["salt"]) * (up + down) < down
        carried_done = F.when(gains, (1 - c["f"]) * c["size"] <= e["f"] * e["size"]).otherwise(c["f"] * c["size"] <= (1 - e["f"]) * e["size"])
        moved = F.when(gains, up).otherwise(-down)
        c_after, e_after = c["f"] + moved / c["size"], e["f"] - moved / e["size"]
        bound = lambda f: F.least(F.lit(1.0), F.greatest(F.lit(0.0), f))
        rest = F.when(carried_done, F.struct(e["key"].alias("key"), e["size"].alias("size"), bound(e_after).alias("f"))).otherwise(F.struct(c["key"].alias("key"), c["size"].alias("size"), bound(c_after).alias("f")))
        done = F.struct(F.when(carried_done, c["key"]).otherwise(e["key"]).alias("key"), F.when(carried_done, gains).otherwise(~gains).cast("int").alias("up"))
        both = F.struct(rest.alias("rest"), F.concat(acc["done"], F.array(done)).alias("done"))
        return F.when(c.isNull(), F.struct(fresh.alias("rest"), acc["done"].alias("done"))).otherwise(both)

    return F.aggregate(x, start, step)


def _round_together(units: DataFrame) -> DataFrame:
    """(source, key, up) for units (source, key, size > 0, 0 < f < 1): up is 0 or 1, and sums of size * up stay near sums of size * f."""
    decided, level = None, 0
    # a source of n units gets n / FAN buckets, whatever n is
    counts = units.groupBy(F.col("source").alias("__s")).agg(F.count("*").alias("__n"))
    current = units.join(small(cut(counts)), F.col("source").eqNullSafe(F.col("__s"))).select("source", "key", "size", "f", F.greatest(F.lit(1), F.ceil(F.col("__n") / FAN)).cast("long").alias("of"))
    while True:
        bucket = F.pmod(F.xxhash64(F.lit(SEED + level), "key"), F.col("of"))
        folded = current.groupBy("source", "of", bucket.alias("b")).agg(F.array_sort(F.collect_list(F.struct((-F.col("size")).alias("order"), F.xxhash64(F.lit(SEED + level), "key").alias("tie"), "key", "size", "f"))).alias("x"))
        folded = cut(folded.select("source", "of", _fold("x").alias("r")).select("source", "of", "r.rest", "r.done"))
        done = folded.select("source", F.explode("done").alias("d")).select("source", "d.key", "d.up")
        last = folded.filter("of = 1").select("source", "rest.key", (_draw(F.col("rest.key.id"), F.col("rest.key.salt")) < F.col("rest.f")).cast("int").alias("up"))
        done = done.unionByName(last)
        decided = done if decided is None else decided.unionByName(done)
        current = folded.filter("of > 1").select("source", "rest.key", "rest.size", "rest.f", F.ceil(F.col("of") / FAN).cast("long").alias("of"))
        level += 1
        if current.isEmpty():
            return decided


def mix(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, size, source_size, target, taken (words the mix takes of it, repeats counted), copies.

    Null texts have size 0; texts without words are taken 0 times. Rows that share doc_id and source are rounded as one
    and taken equally often; rows without an id are told apart by their text. An empty table gives an empty
    result. Texts are read whole, however long. Ids are integers. Other columns are ignored. Every draw is a hash of ids, so reruns
    agree.
    """
    return _mixed(docs.select("doc_id", "source", *_keyed()))


def _keyed() -> tuple[Column, Column]:
    salt = F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.lit(0))
    size = F.when(F.col("text").isNull(), 0).otherwise(F.regexp_count("text", F.lit(WORD)))
    return size.cast("long").alias("size"), F.struct(F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("id"), salt.alias("salt")).alias("key")


def _mixed(rows: DataFrame) -> DataFrame:
    rows = cut(rows)
    by = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")))
    by = cut(by.withColumn("p", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)).withColumn("whole", F.floor("p")).withColumn("f", F.col("p") - F.col("whole")))
    units = rows.groupBy("source", "key").agg(F.sum("size").alias("size")).filter("size > 0")
    part = small(by.filter("f > 0").select(F.col("source").alias("__s"), "f"))
    units = cut(units.join(part, F.col("source").eqNullSafe(F.col("__s"))).select("source", "key", "size", "f"))
    up = cut(_round_together(units).filter("up = 1").select(F.col("source").alias("__s"), F.col("key").alias("__k"), "up"))
    by = by.select(F.col("source").alias("__b"), "source_size", "target", "whole")
    out = rows.join(small(by), F.col("source").eqNullSafe(F.col("__b"))).join(up, F.col("source").eqNullSafe(F.col("__s")) & (F.col("key") == F.col("__k")), "left")
    out = out.withColumn("copies", F.when(F.col("size") > 0, F.col("whole") + F.coalesce("up", F.lit(0))).otherwise(0).cast("long"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", "source", "key")


def repeat(docs: DataFrame) -> DataFrame:
    """docs with each row as often as the mix takes it: not at all, once or twice.

    Nulls, texts without words, repeated rows and an empty table are treated as in mix(); extra columns are kept, copies are
    equal. Texts meet what is decided about them, which is broadcast if it is of few documents.
    """
    size, key = _keyed()
    got = cut(_mixed(docs.select("doc_id", "source", size, key)).filter("copies > 0").select(F.col("source").alias("__s"), F.col("key").alias("__k"), F.col("copies").alias("__copies")).distinct())
    keyed = docs.withColumn("__key", key)
    found = keyed.join(small(got), F.col("source").eqNullSafe(F.col("__s")) & (F.col("__key") == F.col("__k")))
    return found.withColumn("__again", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies")))).select(*docs.columns)
