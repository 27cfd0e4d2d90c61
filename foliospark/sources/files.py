"""Files in and out: pages, chunks, vectors, indexes, questions, audit records."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import strip

CHUNK = "chunk_id STRING, page_start INT, page_end INT, chapter STRING, text STRING"
QUESTION = "id STRING, question STRING, gold_chunk_ids ARRAY<STRING>, k INT, mode STRING"
AUDIT = "ts TIMESTAMP, username STRING, query STRING, mode STRING, top_k INT, chunk_ids ARRAY<STRING>, retrieval STRING"
FORM_FEED = "\f"


def pages_of_text(docs: DataFrame) -> DataFrame:
    """(book, page_no, text) from (book, text): pages are parted by form feeds; one trailing empty page is dropped."""
    parts = F.split(F.coalesce("text", F.lit("")), FORM_FEED)
    whole = F.when((F.size(parts) > 1) & (strip(F.element_at(parts, -1)) == ""), F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    return docs.select("book", F.posexplode(whole).alias("i", "page")).select("book", (F.col("i") + 1).alias("page_no"), strip(F.col("page")).alias("text"))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Pages of text files (extracted books), one book per file."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("book"), F.col("value").alias("text"))
    return pages_of_text(files)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of chunks; of repeated ids one stays, of the last file and place in it."""
    rows = spark.read.schema(CHUNK).json(path).filter(F.col("chunk_id").isNotNull()).withColumn("at", F.struct("_metadata.file_name", F.monotonically_increasing_id().alias("n")))
    return rows.groupBy("chunk_id").agg(F.max_by(F.struct("page_start", "page_end", "chapter", "text"), "at").alias("c")).select("chunk_id", "c.*")


def read_books(spark: SparkSession, path: str) -> DataFrame:
    """Chunks of several books (book, chunk_id, ...), as write_chunks() writes them; ids are told apart by their book."""
    rows = spark.read.schema(f"book STRING, {CHUNK}").json(path).filter(F.col("chunk_id").isNotNull())
    return rows.withColumn("chunk_id", F.concat_ws("/", "book", "chunk_id"))


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema(QUESTION).json(path)
    return rows.select(F.coalesce("id", F.lit("")).alias("qid"), "question", F.coalesce("gold_chunk_ids", F.expr("cast(array() as array<string>)")).alias("gold"), F.coalesce("k", F.lit(8)).alias("k"), F.coalesce("mode", F.lit("retrieve_only")).alias("mode"))


def read_aliases(spark: SparkSession, path: str) -> DataFrame:
    """(phrase, ord, entities) from one JSON object of phrase to a list, ord being the place in it; other entries and broken
    files give nothing. planning.targets() takes it as it is."""
    found = F.from_json("value", "map<string,string>")  # values as text, so that an odd one spoils no other
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.coalesce(found, F.expr("map()"))).alias("ord", "phrase", "list"))
    rows = rows.select(strip(F.col("phrase")).alias("phrase"), "ord", F.filter(F.transform(F.from_json("list", "array<string>"), strip), lambda x: x != "").alias("entities"))
    return rows.filter((F.col("phrase") != "") & (F.size("entities") > 0))


def read_entity_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame] | None:
    """(name, df, idf) and (name, chunk_id, page_start, tf, pos) of an entity index; None where there is none.

    path: tables as write_entity_index() writes them, or one JSON object {"entities": [{name, df, idf}], "entity_to_chunks": {name: [{chunk_id,
    tf, page_start}]}}, whose entries keep their order as pos. Entries of another form are left out.
    """
    try:
        tables = not spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True).load(path).select("path").isEmpty()
        if tables:
            return spark.read.parquet(f"{path}/names"), spark.read.parquet(f"{path}/postings")
        whole = spark.read.text(path, wholetext=True)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise
    both = whole.select(F.from_json("value", "entities array<string>, entity_to_chunks map<string,string>").alias("v"))
    one = F.from_json("x", "name string, df long, idf double")
    names = both.select(F.explode("v.entities").alias("x")).select(one.alias("e")).select(strip(F.col("e.name")).alias("name"), "e.df", "e.idf").filter("name <> ''")
    items = both.select(F.explode("v.entity_to_chunks").alias("name", "list")).select("name", F.posexplode(F.from_json("list", "array<string>")).alias("at", "x"))
    rows = items.select("name", (F.col("at") + 1).alias("pos"), F.from_json("x", "chunk_id string, tf int, page_start int").alias("e"))
    return names, rows.select("name", "e.chunk_id", "e.page_start", "e.tf", "pos").filter("chunk_id <> '' and tf > 0")


def write_entity_index(names: DataFrame, postings: DataFrame, path: str) -> None:
    """Two tables under path, the postings of a name side by side."""
    names.write.mode("overwrite").parquet(f"{path}/names")
    postings.repartition("name").sortWithinPartitions("name", "pos").write.mode("overwrite").parquet(f"{path}/postings")


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("chunk_id", "vec")


def write_chunks(chunks: DataFrame, path: str) -> None:
    chunks.write.mode("overwrite").json(path)


def write_table(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).parquet(path)


def append_audit(records: DataFrame, path: str) -> None:
    records.withColumn("ts", F.coalesce("ts", F.current_timestamp())).write.mode("append").json(path)


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(AUDIT).json(path)


def write_predictions(predictions: DataFrame, path: str) -> None:
    """One JSON object per line."""
    predictions.write.mode("overwrite").json(path)


def sse_events(rows: DataFrame) -> DataFrame:
    """(frame): event-stream frames from (event, data)."""
    return rows.select(F.format_string("event: %s\ndata: %s\n\n", "event", "data").alias("frame"))


def manifest(chunks: DataFrame, id_col: str, text_col: str, order: list[str]) -> DataFrame:
    """(n, digest) over all chunks: hashes of rows in order are hashed by blocks, and the blocks' hashes once more."""
    rows = chunks.select(F.sha2(F.concat_ws("\t", F.col(id_col).cast("string"), F.col(text_col)), 256).alias("h"), *order)
    blocks = rows.withColumn("block", F.floor(F.col(order[0]) / 1024)).groupBy("block").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, "h"))), lambda x: x["h"]), "\n"), 256).alias("b"), F.count("*").alias("n"))
    return blocks.agg(F.sum("n").alias("n"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "b"))), lambda x: x["b"]), "\n"), 256).alias("digest"))
