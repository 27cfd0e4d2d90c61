"""What questions (qid, text) are about, with the names that are known, and the queries that follow from it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip
from . import entities, understand
from .spotting import kept, spotted

NONE = "cast(array() as array<string>)"


def targets(questions: DataFrame, names: DataFrame | None = None, aliases: DataFrame | None = None, most: int = 8) -> DataFrame:
    """(qid, targets): names that a question is about.

    The entities of the first alias phrase (phrase, entities, and ord, its place in the file) that the question holds; else
    the longest known names (name) in it; else its CJK spans. Noise is left out.
    """
    rows = questions.select("qid", strip(F.col("text")).alias("text"))
    out = rows.withColumn("spans", understand.spans(F.col("text"), most)).withColumns({"by_alias": F.expr("cast(null as array<string>)"), "by_name": F.expr("cast(null as array<string>)")})
    if aliases is not None:
        held = spotted(rows, aliases.select(F.col("phrase").alias("name"), "ord", "entities")).groupBy("qid").agg(F.min_by("entities", "ord").alias("__a"))
        out = out.join(held, "qid", "left").withColumn("by_alias", F.slice(F.array_distinct("__a"), 1, most)).drop("__a")
    if names is not None:
        found = entities.mentions(rows, names, 2 * most).filter(~understand.is_noise(F.col("name"))).groupBy("qid", "name").agg(F.min("at").alias("at"))
        found = found.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "name"))), lambda x: x["name"]).alias("__n"))
        out = out.join(found, "qid", "left").withColumn("by_name", F.slice("__n", 1, most)).drop("__n")
    return out.select("qid", F.coalesce("by_alias", "by_name", "spans", F.expr(NONE)).alias("targets"))


def plans(questions: DataFrame, found: DataFrame) -> DataFrame:
    """(qid, text, targets, fields, kind, subqueries) from questions and their targets; without a kind there are no subqueries.

    Targets and fields are kept on the way: what follows names them so often that one expression of all would be too large.
    """
    q, t, f = F.col("text"), F.col("targets"), F.col("fields")
    rows = questions.select("qid", "text").join(kept(found), "qid").withColumn("fields", understand.fields(q))
    rows = kept(rows)
    rows = rows.withColumns({"words": F.array_join(understand.plan_keywords(q, f, t), " "), "kind": understand.plan_kind(q, t, F.size(f))})
    rows = kept(rows)
    return rows.withColumn("subqueries", F.when(F.col("kind").isNotNull(), understand.subqueries(t, f, F.col("words"))).otherwise(F.expr(NONE))).drop("words")


def queries(planned: DataFrame, expansions: DataFrame | None = None, most: int = 2) -> DataFrame:
    """(qid, sub_no, text): each question (0), its subqueries, then `most` expansions (qid, queries), without repeats."""
    rows = planned if expansions is None else planned.join(expansions.select("qid", F.slice("queries", 1, most).alias("more")), "qid", "left")
    more = F.coalesce("more", F.expr(NONE)) if expansions is not None else F.expr(NONE)
    every = F.filter(F.array_distinct(F.concat(F.array("text"), "subqueries", more)), lambda x: x != "")
    return rows.select("qid", F.posexplode(every).alias("sub_no", "text"))


def expanded(questions: DataFrame, replies: DataFrame, most: int = 2) -> DataFrame:
    """(qid, queries, status) from a provider's JSON replies (qid, reply): other queries than the question, without repeats.

    status is null if the reply is as it should be, parse_error if it is no JSON, bad_format without a list of queries, and
    bad_output if nothing is left.
    """
    got = F.from_json("reply", "struct<queries:array<string>>", {"mode": "PERMISSIVE"})
    rows = questions.select("qid", "text").join(replies, "qid").withColumn("any", F.try_parse_json("reply")).withColumn("list", got["queries"])
    clean = F.filter(F.array_distinct(F.transform("list", strip)), lambda x: (x != "") & (x != strip(F.col("text"))))
    rows = rows.withColumn("queries", F.coalesce(F.slice(clean, 1, most), F.expr(NONE)))
    status = F.when(F.col("any").isNull(), "parse_error").when(F.col("list").isNull(), "bad_format").when(F.size("queries") == 0, "bad_output")
    return rows.select("qid", "queries", status.alias("status"))
