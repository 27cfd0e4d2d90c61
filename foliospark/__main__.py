"""python -m foliospark ingest SOURCE OUT: chunks, entity index and vectors of books in files."""

from __future__ import annotations

import argparse
import importlib
import sys
import uuid

from pyspark.sql import SparkSession

from .conf import configured
from .operators import entities
from .operators.spotting import kept
from .plans.engine import Engine
from .sources import files, pdf
from .streaming import ingest as embedding


def _arguments(argv: list[str]) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="python -m foliospark", description=__doc__)
    one = p.add_subparsers(dest="command", required=True).add_parser("ingest")
    one.add_argument("source", help="folder of books: .pdf files, or with --text .txt files whose pages are parted by form feeds")
    one.add_argument("out", help="folder that gets chunks, entities and the store of vectors")
    one.add_argument("--text", action="store_true")
    one.add_argument("--strict", action="store_true", help="fail if a book has too little text")
    one.add_argument("--chunk-only", "--no-embed", action="store_true", help="no vectors")
    one.add_argument("--no-resume", action="store_true", help="a store of its own instead of going on with what is there")
    one.add_argument("--provider", help="module:function that gives vectors of rows (digest, text)")
    one.add_argument("--model", default="default")
    one.add_argument("--dims", type=int)
    found = p.parse_args(argv)
    if not found.chunk_only and not (found.provider and found.dims):
        p.error("vectors need --provider and --dims; or say --chunk-only")
    return found


def main(argv: list[str], spark: SparkSession | None = None) -> dict:
    """Runs a command and gives what it made: chunks, names, broken (pages or files without text) and state (of the vectors)."""
    a = _arguments(argv)
    spark = spark or SparkSession.builder.appName("foliospark").getOrCreate()
    conf, out = configured(spark), a.out.rstrip("/")
    pages = kept(files.read_pages(spark, f"{a.source.rstrip('/')}/*.txt") if a.text else pdf.read_pdf(spark, a.source))
    broken = 0 if a.text else pages.filter("status is not null").count()
    files.write_chunks(Engine(conf).ingest(pages.filter("page_no is not null").select("book", "page_no", "text"), a.strict), f"{out}/chunks")
    chunks = files.read_books(spark, f"{out}/chunks")
    terms = kept(entities.chunk_terms(chunks, conf))
    names = kept(entities.vocabulary(terms, chunks.count(), conf))
    files.write_entity_index(names, entities.index(terms, names, conf), f"{out}/entities")
    made = {"chunks": chunks.count(), "names": names.count(), "broken": broken, "state": None}
    if not a.chunk_only:
        module, _, name = a.provider.partition(":")
        store = f"{out}/store-{uuid.uuid4().hex}" if a.no_resume else f"{out}/store"
        made["state"] = embedding.embed_new(chunks, store, getattr(importlib.import_module(module), name), a.model, a.dims)
    return made


if __name__ == "__main__":
    print(main(sys.argv[1:]))
