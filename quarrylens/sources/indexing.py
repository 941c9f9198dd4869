"""From a folder of sources to a stored code model: discover, parse, resolve, write."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quarrylens.operators.resolve import call_edges, containers_of, structural_edges
from quarrylens.session import cut_lineage
from quarrylens.sources.discovery import discover
from quarrylens.sources.parse import parse_files, parsed_symbols
from quarrylens.sources.store import Store


def index_repository(spark: SparkSession, store: Store, name: str, root: str, now: str, url: str | None = None,
                     max_files: int | None = None, max_bytes: int | None = None) -> dict[str, int | str]:
    """Index a folder as a repository; files stay, symbols, edges and chunks are replaced. Returns the id and counts."""
    found = discover(spark, root, max_files, max_bytes)
    repository_id = store.get_or_create_repository(name, url, now)
    texts = cut_lineage(found.withColumn("repository_id", F.lit(repository_id)))
    store.save_files(texts)
    ids = store.read("files").filter(F.col("repository_id") == repository_id).select(F.col("id").alias("file_id"), "path")
    facts = cut_lineage(parse_files(texts.join(ids, "path")))
    symbols = cut_lineage(parsed_symbols(facts))
    boxes = containers_of(symbols)
    n_symbols = store.replace_symbols(repository_id, symbols.join(boxes, "id", "left").withColumnRenamed("container_id", "parent_symbol_id"))
    files = ids.withColumn("repository_id", F.lit(repository_id))
    structure, diagnostics = structural_edges(facts, symbols, files)
    n_edges = store.replace_relationships(repository_id, call_edges(facts, symbols).unionByName(structure))
    n_chunks = store.replace_chunks(repository_id, chunk_rows(facts, symbols))
    store.mark_indexed(repository_id, now)
    return {"repository_id": repository_id, "files": texts.count(), "symbols": n_symbols, "relationships": n_edges, "chunks": n_chunks,
            "unresolved": diagnostics.count()}


def chunk_rows(facts: DataFrame, symbols: DataFrame) -> DataFrame:
    """file_id, symbol_id, start_line, end_line, content of parsed chunks; code outside of symbols has no symbol_id."""
    chunks = facts.filter("tag = 'chunk'").select("repository_id", "file_id", "name", F.col("kind").alias("type"), "start_line", "end_line", F.col("text").alias("content"))
    s = symbols.select("repository_id", "file_id", "name", "type", F.col("id").alias("symbol_id"), F.col("start_line").alias("s"), F.col("end_line").alias("e"))
    inside = (F.col("s") <= F.col("start_line")) & (F.col("start_line") <= F.col("e"))
    owned = chunks.join(s, ["repository_id", "file_id", "name", "type"], "left").filter(F.col("symbol_id").isNull() | inside)
    return owned.groupBy("file_id", "start_line", "end_line", "content").agg(F.min("symbol_id").alias("symbol_id"))
