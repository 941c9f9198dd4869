"""Queries on the integrity of the code model: orphan references and symbol hierarchies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quarrylens.operators.hierarchy import all_descendants, build_hierarchy
from quarrylens.operators.orphans import code_orphans, orphan_report
from quarrylens.operators.records import canonical_id, latest_versions
from quarrylens.session import load


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    return code_orphans(*(load(spark, d, t) for t in ("relationships", "code_chunks", "symbols", "files")))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select("ref_table", "record_id", "field_name")


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    return orphan_report(_orphans(spark, d))


def symbol_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Latest parent link of each symbol."""
    slim = load(spark, d, "symbols").select(
        canonical_id("id").alias("id"), canonical_id("parent_symbol_id").alias("parent_id"), "ingested_at")
    return latest_versions(slim, ["parent_id"])


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    nodes = symbol_nodes(spark, d)
    linked = nodes.filter(F.col("parent_id").isNotNull()).select("id")
    tree = build_hierarchy(nodes)
    return tree.join(linked, "id", "left_semi").select(
        F.col("id").alias("symbol_id"), F.col("root_id").alias("root_symbol_id"), "depth")


def p4_tree(spark: SparkSession, d: str) -> DataFrame:
    """Everything about each symbol's place but the numbers of its range."""
    return p4_ranges(spark, d).drop("lft", "rgt")


def p4_ranges(spark: SparkSession, d: str) -> DataFrame:
    """As `p4_tree`, with each symbol's range; siblings are numbered by a hash of their ids, which SQL has not."""
    tree = build_hierarchy(symbol_nodes(spark, d))
    return tree.select(
        F.col("id").alias("symbol_id"), F.col("root_id").alias("root_symbol_id"), "depth",
        F.array_join("path", "/").alias("path"), "n_descendants", "tree_id", "lft", "rgt")


def p4_paths(spark: SparkSession, d: str) -> DataFrame:
    """Path from the root and number of descendants of every symbol that leads to no cycle."""
    tree = build_hierarchy(symbol_nodes(spark, d))
    return tree.filter("depth >= 0").select(
        F.col("id").alias("symbol_id"), F.array_join("path", "/").alias("path"), "n_descendants")


def p4_descendants(spark: SparkSession, d: str) -> DataFrame:
    return all_descendants(symbol_nodes(spark, d))


def p4_cycles(spark: SparkSession, d: str) -> DataFrame:
    """Each cycle with the number of symbols on it or behind it."""
    tree = build_hierarchy(symbol_nodes(spark, d))
    return tree.filter("depth = -1").groupBy(F.col("root_id").alias("cycle_id")).agg(
        F.count_if(F.col("tree_id") == F.col("id")).alias("n_on_cycle"), F.count("*").alias("n_symbols"))


QUERIES = {
    "p3_found": p3_found, "p3_report": p3_report,
    "p4_found": p4_found, "p4_tree": p4_tree, "p4_ranges": p4_ranges, "p4_paths": p4_paths, "p4_descendants": p4_descendants, "p4_cycles": p4_cycles,
}

_CID = "lower(trim({0}, e' \\t\\r\\n'))"


def _latest(table: str, fields: str) -> str:
    return (f"SELECT id, {', '.join(f'v.{x} AS {x}' for x in fields.split())}, arrived_at FROM (SELECT {_CID.format('id')} AS id, "
            f"max(struct_pack(ing := ingested_at, {', '.join(f'{x} := {_FIELD.get(x, _CID.format(x))}' for x in fields.split())})) AS v, "
            f"min(ingested_at) AS arrived_at FROM {table} GROUP BY 1)")


_FIELD = {"is_deleted": "deleted_at IS NOT NULL"}

_ORPHANS = f"""
WITH r AS ({_latest('relationships', 'repository_id source_symbol_id target_symbol_id')}),
c AS ({_latest('code_chunks', 'repository_id symbol_id file_id')}),
refs AS (
  SELECT 'relationships' AS ref_table, id AS record_id, 'source_symbol_id' AS field_name, source_symbol_id AS ref_id, repository_id, arrived_at, 'symbols' AS parent_table FROM r
  UNION ALL SELECT 'relationships', id, 'target_symbol_id', target_symbol_id, repository_id, arrived_at, 'symbols' FROM r
  UNION ALL SELECT 'code_chunks', id, 'symbol_id', symbol_id, repository_id, arrived_at, 'symbols' FROM c
  UNION ALL SELECT 'code_chunks', id, 'file_id', file_id, repository_id, arrived_at, 'files' FROM c),
p AS (
  SELECT 'symbols' AS parent_table, * FROM ({_latest('symbols', 'repository_id is_deleted')})
  UNION ALL SELECT 'files', * FROM ({_latest('files', 'repository_id is_deleted')})),
o AS (
  SELECT refs.*, CASE WHEN p.id IS NULL THEN 'missing'
    WHEN p.repository_id IS DISTINCT FROM refs.repository_id OR refs.repository_id IS NULL THEN 'foreign'
    WHEN p.is_deleted THEN 'deleted'
    WHEN NOT coalesce(p.arrived_at <= refs.arrived_at, false) THEN 'late' END AS reason
  FROM refs LEFT JOIN p ON p.parent_table = refs.parent_table AND p.id = refs.ref_id
  WHERE refs.ref_id IS NOT NULL)
"""

_TREE = f"""
WITH RECURSIVE s AS ({_latest('symbols', 'parent_symbol_id')}),
walk(id, cur, path) AS (
  SELECT id, id, [id] FROM s
  UNION ALL
  SELECT w.id, p.id, list_append(w.path, p.id) FROM walk w JOIN s ON s.id = w.cur JOIN s p ON p.id = s.parent_symbol_id
  WHERE len(list_distinct(w.path)) = len(w.path)),
last AS (SELECT id, arg_max(path, len(path)) AS path FROM walk GROUP BY id),
t AS (
  SELECT id, path, len(list_distinct(path)) < len(path) AS looped,
    CASE WHEN len(list_distinct(path)) < len(path) THEN list_min(path[list_position(path, path[-1]):]) ELSE path[-1] END AS root_id
  FROM last)
"""

ORACLE = {
    "p3_found": _ORPHANS + "SELECT ref_table, record_id, field_name FROM o WHERE reason IS NOT NULL",
    "p3_report": _ORPHANS + """SELECT ref_table, field_name, strftime(arrived_at, '%Y-%m') AS month, reason, count(*) AS n_orphans
FROM o WHERE reason IS NOT NULL GROUP BY ALL""",
    "p4_found": _TREE + """SELECT t.id AS symbol_id, root_id AS root_symbol_id,
CAST(CASE WHEN looped THEN -1 ELSE len(path) - 1 END AS INTEGER) AS depth
FROM t JOIN s USING (id) WHERE s.parent_symbol_id IS NOT NULL""",
    "p4_paths": _TREE + """, n AS (SELECT u.a, count(*) AS n FROM t, UNNEST(path[2:]) AS u(a) WHERE NOT looped GROUP BY 1)
SELECT t.id AS symbol_id, array_to_string(list_reverse(path), '/') AS path, coalesce(n.n, 0) AS n_descendants
FROM t LEFT JOIN n ON n.a = t.id WHERE NOT looped""",
    "p4_cycles": _TREE + """SELECT root_id AS cycle_id, count(*) FILTER (WHERE list_position(path, path[-1]) = 1) AS n_on_cycle, count(*) AS n_symbols
FROM t WHERE looped GROUP BY 1""",
    "p4_descendants": _TREE + """SELECT u.a AS ancestor_id, t.id AS descendant_id, CAST(list_position(path, u.a) - 1 AS INTEGER) AS distance
FROM (SELECT id, CASE WHEN looped THEN path[:list_position(path, path[-1])] ELSE path END AS path FROM t) t, UNNEST(path[2:]) AS u(a)""",
    "p4_tree": _TREE + """, tp AS (SELECT id, root_id, looped, path, CASE WHEN looped THEN path[:list_position(path, path[-1])] ELSE path END AS up FROM t),
n AS (SELECT u.a, count(*) AS n FROM tp, UNNEST(up[2:]) AS u(a) GROUP BY 1)
SELECT id AS symbol_id, root_id AS root_symbol_id, CAST(CASE WHEN looped THEN -1 ELSE len(path) - 1 END AS INTEGER) AS depth,
  CASE WHEN NOT looped THEN array_to_string(list_reverse(path), '/') END AS path, coalesce(n.n, 0) AS n_descendants, up[-1] AS tree_id FROM tp LEFT JOIN n ON n.a = tp.id""",
}
