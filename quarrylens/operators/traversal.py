"""Bounded, deterministic graph traversal for many start symbols at once.

Every query of a batch is a row (query_id, repository_id, ...). One job per level
serves all of them: the frontier is joined to the edges, ranked per query, and cut
by that query's remaining budget. Frontiers are checkpointed per level; at most five
levels are allowed. Order is binary on (file path, start line, name, id).
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from quarrylens.session import cut_lineage

MAX_DEPTH = 5
MAX_EDGES = 10_000
MAX_RESULTS = 1_000
MAX_PATHS = 5


def check_depth(depth: int, most: int = MAX_DEPTH) -> None:
    if not 1 <= depth <= most:
        raise ValueError(f"depth must be between 1 and {most}")


def check_types(types: list[str]) -> list[str]:
    known = {"CALLS", "IMPORTS", "IMPLEMENTS", "EXTENDS"}
    if not types or set(types) - known:
        raise ValueError("unknown or no relationship types")
    return sorted(set(types))


@dataclass
class Graph:
    """Edges with both endpoints' sort keys, prepared once per batch of queries."""

    symbols: DataFrame
    edges: DataFrame

    def __post_init__(self) -> None:
        key = self.symbols.select("id", "repository_id", F.struct(
            F.coalesce("file_path", F.lit("")).alias("p"), F.coalesce("start_line", F.lit(0)).alias("l"),
            F.coalesce("name", F.lit("")).alias("n"), F.col("id").alias("i")).alias("key"))
        s = key.select(F.col("id").alias("source_symbol_id"), "repository_id", F.col("key").alias("s_key"))
        t = key.select(F.col("id").alias("target_symbol_id"), "repository_id", F.col("key").alias("t_key"))
        self.keys = key
        self.keyed = cut_lineage(
            self.edges.join(s, ["source_symbol_id", "repository_id"]).join(t, ["target_symbol_id", "repository_id"])
            .select("repository_id", F.col("id").alias("edge_id"), F.col("type").alias("edge_type"),
                    F.col("source_symbol_id").alias("src"), F.col("target_symbol_id").alias("dst"), "s_key", "t_key"))

    def directed(self, direction: str, types: list[str] | None) -> DataFrame:
        """repository_id, at, near, edge_id, edge_type, near_key and the fetch order of each edge."""
        e = self.keyed if types is None else self.keyed.filter(F.col("edge_type").isin(check_types(types)))
        order = F.struct("edge_type", "s_key", "t_key", "edge_id").alias("fetch_order")
        if direction == "OUTGOING":
            return e.select("repository_id", F.col("src").alias("at"), F.col("dst").alias("near"), "edge_id", "edge_type",
                            F.col("t_key").alias("near_key"), order)
        if direction == "INCOMING":
            return e.select("repository_id", F.col("dst").alias("at"), F.col("src").alias("near"), "edge_id", "edge_type",
                            F.col("s_key").alias("near_key"), order)
        raise ValueError("direction is INCOMING or OUTGOING")


def trace(graph: Graph, seeds: DataFrame, direction: str, depth: int, types: list[str] | None = None) -> DataFrame:
    """query_id, symbol_id, depth, edge_id, edge_type of every symbol within `depth` steps of its query's seed.

    seeds: query_id, repository_id, symbol_id (unknown symbols reach nothing). Each
    symbol comes once, at its least depth, by the smallest (type, edge id); the
    seed itself never. No edge budget.
    """
    check_depth(depth)
    edges = graph.directed(direction, types or ["CALLS"])
    frontier = seeds.select("query_id", "repository_id", F.col("symbol_id").alias("at"))
    visited = cut_lineage(frontier)
    frontier = visited
    hits: list[DataFrame] = []
    for level in range(1, depth + 1):
        found = (
            frontier.join(edges, ["repository_id", "at"])
            .groupBy("query_id", "repository_id", F.col("near").alias("at"))
            .agg(F.min(F.struct("edge_type", "edge_id")).alias("e"))
            .join(visited, ["query_id", "repository_id", "at"], "left_anti")
        )
        found = cut_lineage(found)
        if found.isEmpty():
            break
        hits.append(found.select("query_id", F.col("at").alias("symbol_id"), F.lit(level).alias("depth"), "e.edge_id", "e.edge_type"))
        frontier = found.select("query_id", "repository_id", "at")
        visited = visited.unionByName(frontier)
    if not hits:
        return seeds.sparkSession.createDataFrame([], "query_id string, symbol_id string, depth int, edge_id string, edge_type string")
    return reduce(DataFrame.unionByName, hits)


def chains(graph: Graph, seeds: DataFrame, direction: str, depth: int, types: list[str] | None = None) -> DataFrame:
    """query_id, end_id, depth, path of every simple path of at most `depth` edges that leaves a query's seed.

    A path names each symbol once. Parallel edges between two symbols make one path.
    The number of paths is that of the answer; unlike `trace`, none is left out.
    """
    check_depth(depth)
    edges = graph.directed(direction, types or ["CALLS"]).select("repository_id", "at", "near").distinct()
    paths = cut_lineage(seeds.select("query_id", "repository_id", F.col("symbol_id").alias("at"), F.array("symbol_id").alias("path")))
    found: list[DataFrame] = []
    for level in range(1, depth + 1):
        paths = cut_lineage(paths.join(edges, ["repository_id", "at"]).filter(~F.array_contains("path", F.col("near"))).select(
            "query_id", "repository_id", F.col("near").alias("at"), F.array_append("path", F.col("near")).alias("path")))
        found.append(paths.select("query_id", F.col("at").alias("end_id"), F.lit(level).alias("depth"), "path"))
        if paths.isEmpty():
            break
    return reduce(DataFrame.unionByName, found)


def expand(graph: Graph, seeds: DataFrame, depth: int) -> tuple[DataFrame, DataFrame]:
    """(symbols: query_id, symbol_id, depth; edges: query_id, edge_id) of the undirected neighbourhood, seeds included.

    A query may have several seeds. Depth below 1 gives nothing. An edge is
    touched if an endpoint was reached before the last level.
    """
    empty = seeds.sparkSession
    if depth < 1:
        return (empty.createDataFrame([], "query_id string, symbol_id string, depth int"),
                empty.createDataFrame([], "query_id string, edge_id string"))
    both = graph.directed("OUTGOING", None).unionByName(graph.directed("INCOMING", None)).select("repository_id", "at", "near", "edge_id")
    known = graph.keys.select(F.col("id").alias("at"), "repository_id")
    frontier = cut_lineage(seeds.select("query_id", "repository_id", F.col("symbol_id").alias("at")).distinct().join(known, ["repository_id", "at"]))
    visited, levels, touched = frontier, [frontier.withColumn("depth", F.lit(0))], []
    for level in range(1, depth + 1):
        reached = cut_lineage(frontier.join(both, ["repository_id", "at"]).select("query_id", "repository_id", "near", "edge_id"))
        touched.append(reached.select("query_id", "edge_id"))
        frontier = cut_lineage(reached.select("query_id", "repository_id", F.col("near").alias("at")).distinct().join(
            visited, ["query_id", "repository_id", "at"], "left_anti"))
        if frontier.isEmpty():
            break
        levels.append(frontier.withColumn("depth", F.lit(level)))
        visited = visited.unionByName(frontier)
    symbols = reduce(DataFrame.unionByName, levels).select("query_id", F.col("at").alias("symbol_id"), "depth")
    return symbols, reduce(DataFrame.unionByName, touched).distinct()


_STEP = "struct<p:string,l:int,n:string,i:string,t:string,e:string>"


def _step(key: Column, edge_type: Column, edge_id: Column) -> Column:
    """A path step whose order is that of (symbol, edge type, edge id)."""
    return F.struct(key["p"].alias("p"), key["l"].alias("l"), key["n"].alias("n"), key["i"].alias("i"),
                    edge_type.alias("t"), edge_id.alias("e"))


def _start_states(graph: Graph, queries: DataFrame, col: str) -> DataFrame:
    k = graph.keys.select(F.col("id").alias(col), "repository_id", "key")
    none = F.lit("")
    return queries.join(k, [col, "repository_id"]).withColumn("path", F.array(_step(F.col("key"), none, none))).withColumn("at", F.col(col))


def _ranked_pairs(states: DataFrame, edges: DataFrame, fetched_order: bool) -> DataFrame:
    """Pairs of states and edges in processing order, cut by each query's remaining budget.

    First each query's adjacent edges are cut to the budget in fetch order, then the
    pairs. Columns added: use (inside the budget), n (from 1), more (the fetch overflowed),
    over (the pairs did). A query whose pairs are all beyond the budget keeps one unused row for its flags.
    """
    here = states.select("query_id", "repository_id", "at", "left").distinct()
    w = W.partitionBy("query_id").orderBy("fetch_order")
    adjacent = here.join(edges, ["repository_id", "at"]).withColumn("f", F.row_number().over(w)).filter(F.col("f") <= F.col("left") + 1)
    adjacent = adjacent.withColumn("fetched", F.col("f") <= F.col("left"))
    last = F.element_at("path", -1)
    head = F.struct(last["p"], last["l"], last["n"], last["i"])
    length_first = [F.size("path")] if fetched_order else []
    edge_order = ["fetch_order"] if fetched_order else ["near_key", "edge_type", "edge_id"]
    order = W.partitionBy("query_id").orderBy(F.desc("fetched"), head, *length_first, "path", *edge_order)
    whole = W.partitionBy("query_id")
    pairs = states.join(adjacent.drop("left"), ["query_id", "repository_id", "at"]).withColumn("n", F.row_number().over(order))
    return (
        pairs.withColumn("more", F.max(~F.col("fetched")).over(whole))
        .withColumn("over", F.max(F.col("fetched") & (F.col("n") > F.col("left"))).over(whole))
        .withColumn("use", F.col("fetched") & (F.col("n") <= F.col("left"))).filter("use OR n = 1")
    )


def shortest_paths(graph: Graph, queries: DataFrame, depth: int = MAX_DEPTH, types: list[str] | None = None, max_edges: int = MAX_EDGES,
                   max_paths: int = MAX_PATHS) -> DataFrame:
    """query_id, found, n_paths, path_length, paths, traversal_truncated, alternatives_truncated of every query.

    queries: query_id, repository_id, from_id, to_id. `paths` holds at most
    `max_paths` shortest simple paths (arrays of steps with symbol id i, edge type t, edge id e):
    the first ones in traversal order, then sorted. Parallel edges make different paths. A
    query whose symbols are not in its repository is absent from the result. from = to gives
    one path of one step.
    """
    check_depth(depth)
    edges = graph.directed("OUTGOING", types or ["CALLS"])
    ends = graph.keys.select(F.col("id").alias("to_id"), "repository_id")
    states = _start_states(graph, queries.join(ends, ["to_id", "repository_id"]), "from_id").select(
        "query_id", "repository_id", "to_id", "at", "path", F.lit(max_edges).alias("left"))
    states = cut_lineage(states)
    every = states.select("query_id", F.col("at").alias("from_id"), "to_id", "path")
    outcomes = [every.filter("from_id = to_id").select(
        "query_id", F.array("path").alias("paths"), F.lit(False).alias("truncated"), F.lit(False).alias("more_paths"))]
    states = states.filter("at <> to_id")
    for level in range(1, depth + 1):
        pairs = cut_lineage(_ranked_pairs(states, edges, False).select(
            "query_id", "repository_id", "to_id", "near", "left", "n", "use", (F.col("more") | F.col("over")).alias("truncated"),
            F.exists("path", lambda s: s["i"] == F.col("near")).alias("visited"),
            F.concat("path", F.array(_step(F.col("near_key"), F.col("edge_type"), F.col("edge_id")))).alias("path")))
        if pairs.isEmpty():
            break
        hits = pairs.filter("use AND NOT visited AND near = to_id").withColumn("h", F.row_number().over(W.partitionBy("query_id").orderBy("n")))
        per_query = pairs.groupBy("query_id").agg(F.max("truncated").alias("truncated"), F.count_if("use").alias("used"))
        won = hits.groupBy("query_id").agg(
            F.array_sort(F.collect_list(F.when(F.col("h") <= max_paths, F.col("path")))).alias("paths"), (F.max("h") > max_paths).alias("more_paths"))
        ended = cut_lineage(per_query.join(won, "query_id", "left"))
        outcomes.append(ended.filter("paths IS NOT NULL OR truncated").select(
            "query_id", F.coalesce("paths", F.array().cast(f"array<array<{_STEP}>>")).alias("paths"), "truncated",
            F.coalesce("more_paths", F.lit(False)).alias("more_paths")))
        going = ended.filter("paths IS NULL AND NOT truncated").select("query_id", "used")
        states = cut_lineage(pairs.filter("use AND NOT visited AND near <> to_id").join(going, "query_id").select(
            "query_id", "repository_id", "to_id", F.col("near").alias("at"), "path", (F.col("left") - F.col("used")).cast("int").alias("left")))
    results = reduce(DataFrame.unionByName, outcomes)
    return every.select("query_id").join(results, "query_id", "left").select(
        "query_id", F.coalesce(F.size("paths") > 0, F.lit(False)).alias("found"), F.greatest(F.coalesce(F.size("paths"), F.lit(0)), F.lit(0)).alias("n_paths"),
        (F.size(F.get("paths", F.lit(0))) - 1).alias("path_length"), "paths",
        F.coalesce("truncated", F.lit(False)).alias("traversal_truncated"), F.coalesce("more_paths", F.lit(False)).alias("alternatives_truncated"))


_CATEGORIES = (("caller", "CALLS"), ("importer", "IMPORTS"), ("implementor", "IMPLEMENTS"), ("subclass", "EXTENDS"))


def impact(graph: Graph, queries: DataFrame, depth: int = 1, max_edges: int = MAX_EDGES, max_results: int = MAX_RESULTS,
           max_paths: int = MAX_PATHS) -> tuple[DataFrame, DataFrame]:
    """What a change of each query's symbol may affect: (evidence paths, one row of flags per query).

    queries: query_id, repository_id, symbol_id. Four walks over incoming edges share a
    query's edge budget and result cap in the order caller (to `depth`), importer,
    implementor, subclass (one step each). Evidence: query_id, category, symbol_id,
    depth, path. A symbol keeps its first `max_paths` paths per category and is only
    expanded along these. Flags: traversal_truncated, evidence_truncated, results_truncated, n_results.
    """
    check_depth(depth)
    starts = cut_lineage(_start_states(graph, queries, "symbol_id").select("query_id", "repository_id", "at", "path"))
    budget = starts.select("query_id", F.lit(max_edges).cast("long").alias("left"), F.lit(0).cast("long").alias("n_results"),
                           F.lit(False).alias("stopped"), F.lit(False).alias("truncated"), F.lit(False).alias("omitted"), F.lit(False).alias("capped"))
    budget = cut_lineage(budget)
    evidence: list[DataFrame] = []
    for category, kind in _CATEGORIES:
        edges = graph.directed("INCOMING", [kind])
        states = starts
        seen = None
        for level in range(1, (depth if category == "caller" else 1) + 1):
            live = budget.filter("NOT stopped").select("query_id", F.col("left").cast("int").alias("left"), "n_results")
            pairs = cut_lineage(_ranked_pairs(states.join(live, "query_id"), edges, True).select(
                "query_id", "repository_id", "near", "left", "n_results", "n", "use", "more", "over",
                F.exists("path", lambda s: s["i"] == F.col("near")).alias("visited"),
                F.concat("path", F.array(_step(F.col("near_key"), F.col("edge_type"), F.col("edge_id")))).alias("path")))
            fresh = pairs.filter("use AND NOT visited")
            if seen is not None:
                fresh = fresh.join(seen, ["query_id", "near"], "left")
            else:
                fresh = fresh.withColumn("had", F.lit(None).cast("long"))
            had = F.coalesce("had", F.lit(0))
            occurrence = F.row_number().over(W.partitionBy("query_id", "near").orderBy("n"))
            fresh = fresh.withColumn("k", had + occurrence).withColumn("first", F.col("k") == 1)
            new_no = F.sum(F.col("first").cast("long")).over(W.partitionBy("query_id").orderBy("n").rowsBetween(W.unboundedPreceding, W.currentRow))
            fresh = fresh.withColumn("new_no", new_no).withColumn("blocked", F.col("first") & (F.col("n_results") + F.col("new_no") > max_results))
            # everything from the first symbol beyond the result cap on is not processed
            stop_at = F.min(F.when(F.col("blocked"), F.col("n"))).over(W.partitionBy("query_id"))
            fresh = cut_lineage(fresh.withColumn("stop_at", stop_at))
            processed = fresh.filter("stop_at IS NULL OR n < stop_at")
            kept = cut_lineage(processed.filter(F.col("k") <= max_paths).select("query_id", "repository_id", "near", "path", "n"))
            evidence.append(kept.select("query_id", F.lit(category).alias("category"), F.col("near").alias("symbol_id"), F.lit(level).alias("depth"), "path"))
            a = pairs.groupBy("query_id").agg(F.count_if("use").alias("used"), F.max("more").alias("more"), F.max("over").alias("over"))
            b = fresh.groupBy("query_id").agg(
                F.min("stop_at").alias("stop_at"),
                F.sum((F.col("first") & (F.col("stop_at").isNull() | (F.col("n") < F.col("stop_at")))).cast("long")).alias("new"),
                F.max((F.col("k") > max_paths) & (F.col("stop_at").isNull() | (F.col("n") < F.col("stop_at")))).alias("om"))
            no = F.lit(False)
            capped = F.coalesce(F.col("stop_at").isNotNull(), no)
            stop = F.coalesce("more", no) | (F.coalesce("over", no) & ~capped) | capped
            budget = cut_lineage(budget.join(a, "query_id", "left").join(b, "query_id", "left").select(
                "query_id", (F.col("left") - F.coalesce(F.when(capped, F.col("stop_at")).otherwise(F.col("used")), F.lit(0))).alias("left"),
                (F.col("n_results") + F.coalesce("new", F.lit(0))).alias("n_results"),
                (F.col("stopped") | stop).alias("stopped"),
                (F.col("truncated") | stop | F.coalesce("om", no)).alias("truncated"),
                (F.col("omitted") | F.coalesce("om", no)).alias("omitted"),
                (F.col("capped") | capped).alias("capped")))
            counts = kept.groupBy("query_id", "near").agg(F.count("*").alias("c"))
            if seen is None:
                seen = cut_lineage(counts.withColumnRenamed("c", "had"))
            else:
                seen = cut_lineage(seen.join(counts, ["query_id", "near"], "full").select(
                    "query_id", "near", (F.coalesce("had", F.lit(0)) + F.coalesce("c", F.lit(0))).alias("had")))
            states = kept.select("query_id", "repository_id", F.col("near").alias("at"), "path")
            if level < depth and states.isEmpty():
                break
    rows = cut_lineage(reduce(DataFrame.unionByName, evidence))
    flags = budget.select("query_id", F.col("truncated").alias("traversal_truncated"), F.col("omitted").alias("evidence_truncated"),
                          F.col("capped").alias("results_truncated"), "n_results")
    return rows, flags


def affected_symbols(evidence: DataFrame) -> DataFrame:
    """Per query and symbol: least depth, direct or not, categories, scopes, number of evidence paths."""
    scope = F.when(F.col("category") == "importer", "FILE").otherwise("SYMBOL")
    return evidence.groupBy("query_id", "symbol_id").agg(
        F.min("depth").alias("min_depth"), F.array_join(F.sort_array(F.collect_set("category")), ",").alias("categories"),
        F.array_join(F.sort_array(F.collect_set(scope)), ",").alias("scopes"), F.count("*").alias("n_paths")
    ).withColumn("classification", F.when(F.col("min_depth") == 1, "direct").otherwise("indirect"))


def affected_files(evidence: DataFrame, symbols: DataFrame) -> DataFrame:
    """Per query and file: least depth, terminal edge types, and the number of affected symbols."""
    files = symbols.select(F.col("id").alias("symbol_id"), "file_id", "file_path")
    terminal = F.element_at("path", -1)["t"]
    return evidence.join(files, "symbol_id").groupBy("query_id", "file_id", "file_path").agg(
        F.min("depth").alias("min_depth"), F.array_join(F.sort_array(F.collect_set(terminal)), ",").alias("relationship_types"),
        F.countDistinct("symbol_id").alias("n_symbols"))


def implementations(evidence: DataFrame) -> DataFrame:
    """Implementors and subclasses merged per symbol; a symbol that is both counts as subclass first."""
    both = evidence.filter(F.col("category").isin("implementor", "subclass"))
    return both.groupBy("query_id", "symbol_id").agg(
        F.max("category").alias("category"), F.max_by(F.element_at("path", -1)["t"], "category").alias("relationship_type"),
        F.sort_array(F.collect_set("path")).alias("paths"), F.min("depth").alias("min_depth"))
