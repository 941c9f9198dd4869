"""Graph queries: callers, callees, neighbourhoods, shortest paths, change impact.

Each registered query starts at one symbol of every repository: the one with the most callers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quarrylens.operators import traversal as T
from quarrylens.sources.model import MODEL_SQL, CodeModel


def graph_of(model: CodeModel) -> T.Graph:
    return T.Graph(model.graph_symbols, model.edges)


def most_called(model: CodeModel) -> DataFrame:
    """query_id (= repository), repository_id, symbol_id: the most called symbol of each repository, ties to the smaller id."""
    calls = model.edges.filter("type = 'CALLS'").groupBy("repository_id", F.col("target_symbol_id").alias("symbol_id")).agg(F.count("*").alias("n"))
    return calls.groupBy("repository_id").agg(F.min(F.struct((-F.col("n")).alias("n"), "symbol_id")).alias("m")).select(
        F.col("repository_id").alias("query_id"), "repository_id", "m.symbol_id")


def most_calling(model: CodeModel) -> DataFrame:
    calls = model.edges.filter("type = 'CALLS'").groupBy("repository_id", F.col("source_symbol_id").alias("symbol_id")).agg(F.count("*").alias("n"))
    return calls.groupBy("repository_id").agg(F.min(F.struct((-F.col("n")).alias("n"), "symbol_id")).alias("m")).select(
        F.col("repository_id").alias("query_id"), "repository_id", "m.symbol_id")


def callers(spark: SparkSession, d: str) -> DataFrame:
    m = CodeModel(spark, d)
    return T.trace(graph_of(m), most_called(m), "INCOMING", 3)


def callees(spark: SparkSession, d: str) -> DataFrame:
    m = CodeModel(spark, d)
    return T.trace(graph_of(m), most_calling(m), "OUTGOING", 3)


def expand_symbols(spark: SparkSession, d: str) -> DataFrame:
    m = CodeModel(spark, d)
    return T.expand(graph_of(m), most_called(m), 2)[0]


def expand_edges(spark: SparkSession, d: str) -> DataFrame:
    m = CodeModel(spark, d)
    return T.expand(graph_of(m), most_called(m), 2)[1]


def path_queries(m: CodeModel) -> DataFrame:
    a, b = most_calling(m), most_called(m)
    return a.select("query_id", "repository_id", F.col("symbol_id").alias("from_id")).join(
        b.select("query_id", F.col("symbol_id").alias("to_id")), "query_id")


def shortest_path(spark: SparkSession, d: str) -> DataFrame:
    m = CodeModel(spark, d)
    return T.shortest_paths(graph_of(m), path_queries(m), 4).select("query_id", "found", "path_length")


def shortest_path_steps(spark: SparkSession, d: str) -> DataFrame:
    m = CodeModel(spark, d)
    p = T.shortest_paths(graph_of(m), path_queries(m), 4)
    return p.select("query_id", F.posexplode("paths").alias("path_no", "path")).select(
        "query_id", "path_no", F.posexplode("path").alias("step_no", "s")).select(
        "query_id", "path_no", "step_no", F.col("s.i").alias("symbol_id"), F.col("s.t").alias("edge_type"), F.col("s.e").alias("edge_id"))


def _evidence(spark: SparkSession, d: str):
    m = CodeModel(spark, d)
    rows, flags = T.impact(graph_of(m), most_called(m), 3)
    return m, rows, flags


def impact_symbols(spark: SparkSession, d: str) -> DataFrame:
    return T.affected_symbols(_evidence(spark, d)[1]).select("query_id", "symbol_id", "min_depth", "classification", "categories", "scopes")


def impact_files(spark: SparkSession, d: str) -> DataFrame:
    m, rows, _ = _evidence(spark, d)
    return T.affected_files(rows, m.graph_symbols)


def impact_flags(spark: SparkSession, d: str) -> DataFrame:
    return _evidence(spark, d)[2]


def most_implemented(m: CodeModel) -> DataFrame:
    """The symbol of each repository with the most edges of IMPLEMENTS and EXTENDS into it, ties to the smaller id."""
    into = m.edges.filter(F.col("type").isin("IMPLEMENTS", "EXTENDS") & (F.col("source_symbol_id") != F.col("target_symbol_id"))).groupBy(
        "repository_id", F.col("target_symbol_id").alias("symbol_id")).agg(F.count("*").alias("n"))
    return into.groupBy("repository_id").agg(F.min(F.struct((-F.col("n")).alias("n"), "symbol_id")).alias("m")).select(
        F.col("repository_id").alias("query_id"), "repository_id", "m.symbol_id")


def call_chains(spark: SparkSession, d: str) -> DataFrame:
    """Every simple chain of at most three calls from the symbol of each repository that calls most."""
    m = CodeModel(spark, d)
    found = T.chains(graph_of(m), most_calling(m), "OUTGOING", 3)
    return found.select("query_id", "end_id", "depth", F.array_join("path", ">").alias("path"))


def impact_implementations(spark: SparkSession, d: str) -> DataFrame:
    m = CodeModel(spark, d)
    rows, _ = T.impact(graph_of(m), most_implemented(m), 1)
    return T.implementations(rows).select("query_id", "symbol_id", "category", "relationship_type", F.size("paths").alias("n_paths"))


QUERIES = {f.__name__: f for f in (
    callers, callees, expand_symbols, expand_edges, shortest_path, shortest_path_steps, impact_symbols, impact_files, impact_flags,
    impact_implementations, call_chains)}


def _seeds(end: str) -> str:
    return f"""SELECT repository_id AS q, arg_min(s, (-n, s)) AS s FROM (SELECT repository_id, {end} AS s, count(*) AS n FROM ce
    WHERE type = 'CALLS' GROUP BY ALL) GROUP BY 1"""


def _bfs(seeds: str, near: str, at: str, depth: int) -> str:
    """SQL text: least depth at which each symbol is reached from its query's seed."""
    return MODEL_SQL + f""", seed AS ({seeds}), w(q, s, depth) AS (
  SELECT q, s, 0 FROM seed UNION SELECT w.q, e.{near}, w.depth + 1 FROM w JOIN ce e ON e.{at} = w.s AND e.repository_id = w.q AND e.type = 'CALLS'
  WHERE w.depth < {depth}),
b AS (SELECT q, s, min(depth) AS depth FROM w GROUP BY ALL)
"""


def _trace_sql(seeds: str, near: str, at: str, depth: int) -> str:
    return _bfs(seeds, near, at, depth) + f"""SELECT b.q AS query_id, b.s AS symbol_id, CAST(b.depth AS INTEGER) AS depth,
  arg_min(e.id, (e.type, e.id)) AS edge_id, 'CALLS' AS edge_type
FROM b JOIN ce e ON e.{near} = b.s AND e.repository_id = b.q AND e.type = 'CALLS' JOIN b p ON p.q = b.q AND p.s = e.{at} AND p.depth = b.depth - 1
WHERE b.depth > 0 GROUP BY 1, 2, 3"""


_BOTH = """, seed AS ({seed}), u AS (SELECT repository_id AS q, source_symbol_id AS a, target_symbol_id AS b, id FROM ce
  UNION ALL SELECT repository_id, target_symbol_id, source_symbol_id, id FROM ce),
w(q, s, depth) AS (SELECT q, s, 0 FROM seed UNION SELECT w.q, u.b, w.depth + 1 FROM w JOIN u ON u.a = w.s AND u.q = w.q WHERE w.depth < 2),
x AS (SELECT q, s, min(depth) AS depth FROM w GROUP BY ALL)
"""
_IN, _OUT = _seeds("target_symbol_id"), _seeds("source_symbol_id")

_IMPACT = _bfs(_IN, "source_symbol_id", "target_symbol_id", 3) + """, ev AS (
  SELECT q, s, depth, 'caller' AS category, 'CALLS' AS t FROM b WHERE depth > 0
  UNION ALL SELECT seed.q, ce.source_symbol_id, 1, CASE type WHEN 'IMPORTS' THEN 'importer' WHEN 'IMPLEMENTS' THEN 'implementor' ELSE 'subclass' END, type
  FROM seed JOIN ce ON ce.target_symbol_id = seed.s AND ce.repository_id = seed.q AND ce.type <> 'CALLS' AND ce.source_symbol_id <> seed.s)
"""

ORACLE = {
    "call_chains": MODEL_SQL + f""", seed AS ({_OUT}), e AS (SELECT DISTINCT repository_id AS r, source_symbol_id AS a, target_symbol_id AS b FROM ce WHERE type = 'CALLS'),
w(q, s, depth, path) AS (SELECT q, s, 0, [s] FROM seed UNION ALL SELECT w.q, e.b, w.depth + 1, list_append(w.path, e.b) FROM w JOIN e ON e.r = w.q AND e.a = w.s
  WHERE w.depth < 3 AND NOT list_contains(w.path, e.b))
SELECT q AS query_id, s AS end_id, CAST(depth AS INTEGER) AS depth, array_to_string(path, '>') AS path FROM w WHERE depth > 0""",
    "impact_implementations": MODEL_SQL + """, i AS (SELECT * FROM ce WHERE type IN ('IMPLEMENTS', 'EXTENDS') AND source_symbol_id <> target_symbol_id),
seed AS (SELECT repository_id AS q, arg_min(s, (-n, s)) AS s FROM (SELECT repository_id, target_symbol_id AS s, count(*) AS n FROM i GROUP BY ALL) GROUP BY 1)
SELECT q AS query_id, i.source_symbol_id AS symbol_id, CASE WHEN bool_or(type = 'EXTENDS') THEN 'subclass' ELSE 'implementor' END AS category,
  CASE WHEN bool_or(type = 'EXTENDS') THEN 'EXTENDS' ELSE 'IMPLEMENTS' END AS relationship_type, CAST(count(*) AS INTEGER) AS n_paths
FROM seed JOIN i ON i.repository_id = seed.q AND i.target_symbol_id = seed.s GROUP BY 1, 2""",
    "callers": _trace_sql(_IN, "source_symbol_id", "target_symbol_id", 3),
    "callees": _trace_sql(_OUT, "target_symbol_id", "source_symbol_id", 3),
    "expand_symbols": MODEL_SQL + _BOTH.format(seed=_IN) + "SELECT q AS query_id, s AS symbol_id, CAST(depth AS INTEGER) AS depth FROM x",
    "expand_edges": MODEL_SQL + _BOTH.format(seed=_IN) + "SELECT DISTINCT x.q AS query_id, u.id AS edge_id FROM x JOIN u ON u.q = x.q AND u.a = x.s WHERE x.depth < 2",
    "shortest_path": _bfs(_OUT, "target_symbol_id", "source_symbol_id", 4) + f""", goal AS ({_IN})
SELECT seed.q AS query_id, b.depth IS NOT NULL AS found, CAST(b.depth AS INTEGER) AS path_length
FROM seed JOIN goal ON goal.q = seed.q LEFT JOIN b ON b.q = seed.q AND b.s = goal.s""",
    "impact_symbols": _IMPACT + """SELECT q AS query_id, s AS symbol_id, CAST(min(depth) AS INTEGER) AS min_depth,
CASE WHEN min(depth) = 1 THEN 'direct' ELSE 'indirect' END AS classification, string_agg(DISTINCT category, ',' ORDER BY category) AS categories,
string_agg(DISTINCT CASE WHEN category = 'importer' THEN 'FILE' ELSE 'SYMBOL' END, ',' ORDER BY CASE WHEN category = 'importer' THEN 'FILE' ELSE 'SYMBOL' END) AS scopes
FROM ev GROUP BY 1, 2""",
    "impact_files": _IMPACT + """SELECT q AS query_id, gs.file_id, gs.file_path, CAST(min(depth) AS INTEGER) AS min_depth,
string_agg(DISTINCT t, ',' ORDER BY t) AS relationship_types, count(DISTINCT s) AS n_symbols FROM ev JOIN gs ON gs.id = ev.s GROUP BY 1, 2, 3""",
}
