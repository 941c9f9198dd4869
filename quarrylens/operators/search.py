"""Search for many queries at once: by vector, by name, along the graph, and all of these together."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from quarrylens.functions.text import evidence_block, query_tokens, utf16_length
from quarrylens.operators.traversal import Graph, check_depth, expand
from quarrylens.session import cut_lineage

DIMENSION = 384


def usable(vector: Column, dimension: int = DIMENSION) -> Column:
    """Exactly `dimension` finite numbers, not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) == dimension) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def semantic_top(queries: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """query_id, chunk_id, similarity, rank: the k most similar chunks of each query's repository, exactly.

    queries: query_id, repository_id, vector; chunks: id, repository_id, vector.
    Every query meets all chunks of its repository; ties go to the smaller id.
    Unusable vectors on either side take no part. Queries travel to the chunks in
    broadcast batches of QUERY_BATCH; a task scores its chunks by matrix products and
    hands on k rows a query, so vectors of chunks are never shuffled.
    """
    if not 1 <= k <= 50:
        raise ValueError("k must be between 1 and 50")
    spark = chunks.sparkSession
    asked = cut_lineage(queries.filter(usable(F.col("vector"))).select("query_id", "repository_id", F.col("vector").cast("array<double>").alias("vector")))
    c = chunks.filter(usable(F.col("vector"))).select("id", "repository_id", F.col("vector").cast("array<double>").alias("vector"))
    parts = max(1, -(-asked.count() // QUERY_BATCH))
    found = []
    for part in range(parts):
        batch = asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == part) if parts > 1 else asked
        by_repository: dict[str, tuple[list, list]] = {}
        for row in batch.collect():
            ids, rows = by_repository.setdefault(row["repository_id"], ([], []))
            ids.append(row["query_id"])
            rows.append(row["vector"])
        blocks = {r: (np.array(ids, dtype=object), _unit(np.array(rows))) for r, (ids, rows) in by_repository.items() if r is not None}
        found.append(c.mapInArrow(_scored(spark.sparkContext.broadcast(blocks), k), "query_id string, chunk_id string, similarity double"))
    w = W.partitionBy("query_id").orderBy(F.desc("similarity"), "chunk_id")
    return reduce(DataFrame.unionByName, found).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


#: Queries whose vectors are broadcast together (15 MB).
QUERY_BATCH = 5_000


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _scored(shared, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, list[tuple[float, str]]] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            repositories = np.array(batch.column("repository_id").to_pylist(), dtype=object)
            ids = np.array(batch.column("id").to_pylist(), dtype=object)
            x = batch.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            for repository in set(repositories) & set(shared.value):
                at = np.flatnonzero(repositories == repository)
                names, q = shared.value[repository]
                # rounded before ranking, so that the order does not hang on the last bits
                scores = np.round(q @ _unit(x[at]).T, 9)
                for row, name in enumerate(names):
                    near = at if len(at) <= k else at[scores[row] >= np.partition(scores[row], -k)[-k]]
                    values = scores[row] if len(at) <= k else scores[row][scores[row] >= np.partition(scores[row], -k)[-k]]
                    best = sorted([*kept.get(name, ()), *((-float(v), str(i)) for v, i in zip(values, ids[near]))])
                    kept[name] = best[:k]
        rows = [(name, i, -v) for name, best in kept.items() for v, i in best]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.float64())],
            names=["query_id", "chunk_id", "similarity"])

    return run


def search(queries: DataFrame, graph: Graph, chunks: DataFrame, mode: str, k: int = 6, depth: int = 1) -> DataFrame:
    """query_id, evidence_id, rank, similarity, semantic_available, effective_depth of each query in one mode.

    semantic: the k most similar chunks; a query without a usable vector falls back to
    structural evidence and says so. structural: as `structural_search`, where
    semantic_available is null. hybrid: all evidence by score; its depth is at most 2.
    """
    if mode not in ("semantic", "structural", "hybrid"):
        raise ValueError("mode is semantic, structural or hybrid")
    check_depth(depth)
    can = usable(F.col("vector"))
    if mode == "hybrid":
        effective = min(depth, 2)
        rows = hybrid_evidence(queries, graph, chunks, k, effective)
        w = W.partitionBy("query_id").orderBy(F.desc("score"), "evidence_id")
        ranked = rows.select("query_id", "evidence_id", F.row_number().over(w).alias("rank"), "similarity")
        return ranked.join(queries.select("query_id", F.coalesce(can, F.lit(False)).alias("semantic_available")), "query_id").withColumn(
            "effective_depth", F.lit(effective))
    blind = queries if mode == "structural" else queries.filter(~F.coalesce(can, F.lit(False)))
    flag = F.lit(None).cast("boolean") if mode == "structural" else F.lit(False)
    structural = structural_search(blind, graph, chunks.drop("vector"), k, depth).select(
        "query_id", "evidence_id", "rank", F.lit(None).cast("double").alias("similarity"), flag.alias("semantic_available"))
    if mode == "structural":
        return structural.withColumn("effective_depth", F.lit(depth))
    semantic = semantic_top(queries, chunks, k).select(
        "query_id", F.concat(F.lit("chunk:"), "chunk_id").alias("evidence_id"), "rank", "similarity", F.lit(True).alias("semantic_available"))
    return semantic.unionByName(structural).withColumn("effective_depth", F.lit(depth))


def pruned_result(evidence: DataFrame, packed: DataFrame, graph: Graph) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(relationships, symbols, summary) of what the packed context holds.

    relationships: query_id, edge_id of the edges whose evidence was packed. symbols:
    query_id, symbol_id of packed evidence and of the ends of packed edges. summary:
    query_id, n_evidence, n_selected, context_chars, truncated (some evidence did not fit).
    """
    chosen = cut_lineage(evidence.select("query_id", "evidence_id", "kind", "symbol_id").join(packed.select("query_id", "evidence_id"), ["query_id", "evidence_id"]))
    relationships = chosen.filter("kind = 'RELATIONSHIP'").select("query_id", F.substring("evidence_id", len("relationship:") + 1, 1 << 30).alias("edge_id"))
    ends = graph.edges.select(F.col("id").alias("edge_id"), F.explode(F.array("source_symbol_id", "target_symbol_id")).alias("symbol_id"))
    symbols = chosen.filter("symbol_id IS NOT NULL").select("query_id", "symbol_id").unionByName(
        relationships.join(ends, "edge_id").select("query_id", "symbol_id")).distinct()
    all_ = evidence.groupBy("query_id").agg(F.count("*").alias("n_evidence"))
    some = packed.groupBy("query_id").agg(F.count("*").alias("n_selected"), F.max("chars_so_far").alias("context_chars"))
    summary = all_.join(some, "query_id", "left").na.fill(0, ["n_selected", "context_chars"]).withColumn("truncated", F.col("n_selected") < F.col("n_evidence"))
    return relationships, symbols, summary


def name_matches(queries: DataFrame, symbols: DataFrame, limit: int = 8) -> DataFrame:
    """query_id, repository_id, symbol_id, rank: symbols whose name is a token of the text, or holds one of four letters or more.

    Exact names first, then by the token's place, line and id. '_' inside a token
    is a wildcard of the part match. queries: query_id, repository_id, text.
    """
    q = queries.select("query_id", "repository_id", query_tokens(F.col("text")).alias("tokens")).filter(F.size("tokens") > 0)
    t = q.select("query_id", "repository_id", F.posexplode("tokens").alias("place", "token")).withColumn("place", F.col("place") + 1)
    s = symbols.select(F.col("id").alias("symbol_id"), "repository_id", F.lower("name").alias("name"), "start_line")
    exact = s.join(t.withColumnRenamed("token", "name"), ["repository_id", "name"]).select("query_id", "repository_id", "symbol_id", "place", "start_line")
    # a part match holds the token's first four letters without a wildcard; names are looked up by their parts of four
    part = t.filter(F.length("token") >= 4).withColumn("gram", F.regexp_extract("token", "[a-z0-9$]{4}", 0))
    grams = s.filter(F.length("name") >= 4).withColumn("gram", F.explode(F.array_distinct(F.transform(
        F.sequence(F.lit(1), F.length("name") - 3), lambda i: F.substring(F.col("name"), i, F.lit(4))))))
    held = F.like(F.col("name"), F.concat(F.lit("%"), F.col("token"), F.lit("%")))
    far = F.lit(999)
    inside = grams.join(part.filter("gram <> ''").select("query_id", "repository_id", "token", "gram"), ["repository_id", "gram"]).filter(held)
    # tokens whose letters all stand beside wildcards have no such part and meet every name of their repository
    loose = s.join(part.filter("gram = ''").select("query_id", "repository_id", "token"), "repository_id").filter(held)
    columns = ["query_id", "repository_id", "symbol_id", far.alias("place"), "start_line"]
    found = exact.unionByName(inside.select(*columns)).unionByName(loose.select(*columns)).groupBy("query_id", "repository_id", "symbol_id", "start_line").agg(
        F.min("place").alias("place")).withColumn("inexact", (F.col("place") == far).cast("int"))
    w = W.partitionBy("query_id").orderBy("inexact", "place", "start_line", "symbol_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit).select("query_id", "repository_id", "symbol_id", "rank")


def structural_search(queries: DataFrame, graph: Graph, chunks: DataFrame, k: int = 5, depth: int = 1) -> DataFrame:
    """query_id, evidence_id, rank: first k chunks of the reached symbols, then all touched edges.

    Seeds are the first k name matches. At depth 0 nothing is reached.
    """
    names = name_matches(queries, graph.symbols, k)
    symbols, edges = expand(graph, names.select("query_id", "repository_id", "symbol_id"), depth)
    reached = chunks.join(symbols.select("query_id", "symbol_id"), "symbol_id")
    w = W.partitionBy("query_id").orderBy("start_line", "id")
    first = reached.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return first.select("query_id", F.concat(F.lit("chunk:"), "id").alias("evidence_id"), "rank").unionByName(
        edges.select("query_id", F.concat(F.lit("relationship:"), "edge_id").alias("evidence_id"), F.lit(None).cast("int").alias("rank")))


def hybrid_evidence(queries: DataFrame, graph: Graph, chunks: DataFrame, k: int = 6, depth: int = 1, names_limit: int = 8) -> DataFrame:
    """query_id, evidence_id, kind, provenance, score, similarity, symbol_id of all evidence of each query.

    Semantic chunks score 1 + max(0, similarity), 0.35 more and BOTH if also reached
    structurally; structural chunks 0.8 if their symbol matches by name, else 0.55;
    edges 0.6, 0.25 more if an endpoint matches by name. A query without a usable
    vector has structural evidence only. queries: query_id, repository_id, text, vector.
    chunks: id, repository_id, symbol_id, start_line, vector.
    """
    if not 0 <= depth <= 2:
        raise ValueError("depth must be between 0 and 2")
    semantic = cut_lineage(semantic_top(queries, chunks, k).select("query_id", F.col("chunk_id").alias("id"), "similarity"))
    names = cut_lineage(name_matches(queries, graph.symbols, names_limit).select("query_id", "repository_id", "symbol_id"))
    of_chunk = chunks.select("id", "repository_id", "symbol_id")
    seeds = semantic.join(of_chunk, "id").filter(F.col("symbol_id").isNotNull()).select("query_id", "repository_id", "symbol_id").unionByName(
        names).distinct()
    symbols, edges = expand(graph, seeds, depth)
    everything = symbols.select("query_id", "symbol_id").unionByName(names.select("query_id", "symbol_id")).distinct()
    matched = names.select("query_id", "symbol_id", F.lit(True).alias("matched"))
    structural = of_chunk.join(everything, "symbol_id").join(matched, ["query_id", "symbol_id"], "left").select(
        "query_id", "id", F.coalesce("matched", F.lit(False)).alias("matched"))
    both = semantic.join(structural, ["query_id", "id"], "full")
    # The scores of evidence by how it was found.
    is_semantic, is_structural = F.col("similarity").isNotNull(), F.col("matched").isNotNull()
    score = F.when(is_semantic, 1 + F.greatest(F.lit(0.0), F.col("similarity")) + F.when(is_structural, 0.35).otherwise(0.0)).otherwise(
        F.when(F.col("matched"), 0.8).otherwise(0.55))
    rows = both.join(of_chunk.drop("repository_id"), "id", "left").select(
        "query_id", F.concat(F.lit("chunk:"), "id").alias("evidence_id"), F.lit("CHUNK").alias("kind"),
        F.when(is_semantic & is_structural, "BOTH").when(is_semantic, "SEMANTIC").otherwise("STRUCTURAL").alias("provenance"),
        score.alias("score"), "similarity", "symbol_id")
    ends = graph.edges.select(F.col("id").alias("edge_id"), "source_symbol_id", "target_symbol_id")
    m1 = matched.withColumnRenamed("symbol_id", "source_symbol_id").withColumnRenamed("matched", "m1")
    m2 = matched.withColumnRenamed("symbol_id", "target_symbol_id").withColumnRenamed("matched", "m2")
    scored = edges.join(ends, "edge_id").join(m1, ["query_id", "source_symbol_id"], "left").join(m2, ["query_id", "target_symbol_id"], "left")
    hit = F.coalesce("m1", "m2", F.lit(False))
    return rows.unionByName(scored.select(
        "query_id", F.concat(F.lit("relationship:"), "edge_id").alias("evidence_id"), F.lit("RELATIONSHIP").alias("kind"),
        F.lit("STRUCTURAL").alias("provenance"), F.when(hit, 0.85).otherwise(0.6).alias("score"),
        F.lit(None).cast("double").alias("similarity"), F.col("source_symbol_id").alias("symbol_id")))


def pack_context(evidence: DataFrame, budget: int = 24_000) -> DataFrame:
    """query_id, evidence_id, position, chars_so_far: evidence that fits the budget, greedily by score.

    In order of score and id a block that does not fit is passed over and smaller ones
    after it still get in; blocks are parted by two characters. Lengths count UTF-16
    units. evidence: query_id, evidence_id, score, block.
    """
    if not 1_000 <= budget <= 100_000:
        raise ValueError("budget must be between 1000 and 100000")

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        query, used, position = None, 0, 0
        for batch in batches:
            rows = []
            for q, evidence_id, block in zip(batch["query_id"], batch["evidence_id"], batch["block"]):
                if q != query:
                    query, used, position = q, 0, 0
                size = utf16_length(block) + (2 if used else 0)
                if used + size <= budget:
                    used, position = used + size, position + 1
                    rows.append((q, evidence_id, position, used))
            yield pd.DataFrame(rows, columns=["query_id", "evidence_id", "position", "chars_so_far"])

    # sorted partitions are folded as a stream: a query's evidence passes one task, but is never held by it
    ordered = evidence.filter(F.length("block") <= budget).select("query_id", "evidence_id", "score", "block").repartition(
        "query_id").sortWithinPartitions("query_id", F.desc("score"), "evidence_id")
    return ordered.mapInPandas(fold, "query_id string, evidence_id string, position int, chars_so_far long")


def evidence_blocks(evidence: DataFrame, graph: Graph, chunks: DataFrame) -> DataFrame:
    """Evidence with its text block. chunks: id, file_id, start_line, end_line, content, file_path."""
    s = graph.symbols.select(F.col("id").alias("symbol_id"), F.col("name").alias("symbol"), F.col("type").alias("symbol_type"),
                             F.col("file_path").alias("s_path"), F.col("start_line").alias("s_start"), F.col("end_line").alias("s_end"))
    c = chunks.select(F.concat(F.lit("chunk:"), "id").alias("evidence_id"), F.col("file_path").alias("c_path"),
                      F.col("start_line").alias("c_start"), F.col("end_line").alias("c_end"), "content")
    n = graph.symbols.select("id", "name")
    e = graph.edges.join(n.withColumnRenamed("id", "source_symbol_id").withColumnRenamed("name", "a"), "source_symbol_id").join(
        n.withColumnRenamed("id", "target_symbol_id").withColumnRenamed("name", "b"), "target_symbol_id").select(
        F.concat(F.lit("relationship:"), "id").alias("evidence_id"), F.concat("a", F.lit(" --"), "type", F.lit("--> "), "b").alias("edge_text"))
    joined = evidence.join(s, "symbol_id", "left").join(c, "evidence_id", "left").join(e, "evidence_id", "left")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            blocks = [
                evidence_block(i, k, p, path or "", int(x or 0), int(y or 0), n, t, None if sim != sim or sim is None else sim, text or "")
                for i, k, p, path, x, y, n, t, sim, text in zip(
                    b["evidence_id"], b["kind"], b["provenance"], b["path"], b["start"].fillna(0), b["end"].fillna(0),
                    b["symbol"], b["symbol_type"], b["similarity"], b["text"])]
            yield pd.DataFrame({"query_id": b["query_id"], "evidence_id": b["evidence_id"], "score": b["score"], "block": blocks})

    return joined.select(
        "query_id", "evidence_id", "kind", "provenance", F.coalesce("c_path", "s_path").alias("path"), F.coalesce("c_start", "s_start").alias("start"),
        F.coalesce("c_end", "s_end").alias("end"), "symbol", "symbol_type", "similarity", F.coalesce("content", "edge_text").alias("text"), "score",
    ).mapInPandas(write, "query_id string, evidence_id string, score double, block string")
