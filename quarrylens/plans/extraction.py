"""Queries that parse the file texts, and name resolution on the delivered symbols."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quarrylens.operators import resolve as R
from quarrylens.operators.records import canonical_id
from quarrylens.session import cut_lineage
from quarrylens.sources.model import MODEL_SQL, CodeModel
from quarrylens.sources.parse import parse_files, parsed_symbols


def _facts(m: CodeModel) -> DataFrame:
    texts = m.raw("file_texts").select(canonical_id("file_id").alias("file_id"), "content")
    files = m.files.select(F.col("id").alias("file_id"), "repository_id", "path")
    return cut_lineage(parse_files(texts.join(files, "file_id")))


def parsed_symbol_counts(spark: SparkSession, d: str) -> DataFrame:
    return parsed_symbols(_facts(CodeModel(spark, d))).groupBy("repository_id", "type").agg(F.count("*").alias("n_symbols"))


def parsed_edges(spark: SparkSession, d: str) -> DataFrame:
    m = CodeModel(spark, d)
    facts = _facts(m)
    symbols = cut_lineage(parsed_symbols(facts))
    edges, _ = R.structural_edges(facts, symbols, m.files.select("repository_id", F.col("id").alias("file_id"), "path"))
    return R.call_edges(facts, symbols).unionByName(edges)


def unresolved_names(spark: SparkSession, d: str) -> DataFrame:
    m = CodeModel(spark, d)
    facts = _facts(m)
    _, diagnostics = R.structural_edges(facts, cut_lineage(parsed_symbols(facts)), m.files.select("repository_id", F.col("id").alias("file_id"), "path"))
    return diagnostics.groupBy("tag", "reason").agg(F.count("*").alias("n_names"))


def parsed_chunks(spark: SparkSession, d: str) -> DataFrame:
    return _facts(CodeModel(spark, d)).filter("tag = 'chunk'").groupBy("file_id", "kind").agg(
        F.count("*").alias("n_chunks"), F.max(F.col("end_line") - F.col("start_line") + 1).alias("most_lines"))


def container_of_symbol(spark: SparkSession, d: str) -> DataFrame:
    return R.containers_of(CodeModel(spark, d).symbols)


def call_resolution(spark: SparkSession, d: str) -> DataFrame:
    """Every CALLS edge as a reference from its source to its target's name, resolved by name alone."""
    m = CodeModel(spark, d)
    names = m.symbols.select(F.col("id").alias("target_symbol_id"), "name")
    refs = m.edges.filter("type = 'CALLS'").join(names, "target_symbol_id").select(
        F.col("id").alias("ref_id"), F.col("source_symbol_id").alias("source_id"), "repository_id", "name")
    return R.resolve_calls(refs, m.symbols, R.containers_of(m.symbols))


def nested_call_suppression(spark: SparkSession, d: str) -> DataFrame:
    """Chunk starts as call places of the callables whose lines cover them, without those inside nested callables."""
    m = CodeModel(spark, d)
    s = m.symbols.filter(F.col("type").isin("METHOD", "FUNCTION")).select(
        F.col("id").alias("source_id"), "repository_id", "file_id", F.col("start_line").alias("source_start"), F.col("end_line").alias("source_end"))
    places = m.chunks.select(F.col("id").alias("chunk_id"), "repository_id", "file_id", F.col("start_line").alias("line"))
    refs = places.join(s, ["repository_id", "file_id"]).filter(F.col("line").between(F.col("source_start"), F.col("source_end"))).withColumn(
        "ref_id", F.concat_ws(">", "source_id", "chunk_id"))
    return R.drop_nested_calls(refs, m.symbols).select("source_id", "chunk_id", "line")


QUERIES = {f.__name__: f for f in (
    parsed_symbol_counts, parsed_edges, unresolved_names, parsed_chunks, container_of_symbol, call_resolution, nested_call_suppression)}

_BOXES = MODEL_SQL + """, box AS (SELECT s.id, arg_min(c.id, (c.end_line - c.start_line, c.start_line, c.id)) AS container_id FROM cs s JOIN cs c
    ON c.repository_id = s.repository_id AND c.file_id = s.file_id AND c.type IN ('CLASS', 'INTERFACE', 'ENUM') AND c.id <> s.id
    AND c.start_line <= s.start_line AND c.end_line >= s.end_line GROUP BY 1)
"""

ORACLE = {
    "container_of_symbol": _BOXES + "SELECT id, container_id FROM box",
    "call_resolution": _BOXES + """, ref AS (SELECT ce.id AS ref_id, ce.source_symbol_id AS source_id, ce.repository_id, t.name, s.file_id AS s_file, sb.container_id AS s_box
    FROM ce JOIN cs t ON t.id = ce.target_symbol_id JOIN cs s ON s.id = ce.source_symbol_id LEFT JOIN box sb ON sb.id = s.id WHERE ce.type = 'CALLS'),
v AS (SELECT ref_id, source_id, count(c.id) AS n_repo, min(c.id) AS only_one,
    count(*) FILTER (WHERE c.file_id = s_file AND cb.container_id = s_box) AS n_box, min(c.id) FILTER (WHERE c.file_id = s_file AND cb.container_id = s_box) AS box_one,
    count(*) FILTER (WHERE c.file_id = s_file) AS n_file, min(c.id) FILTER (WHERE c.file_id = s_file) AS file_one
    FROM ref LEFT JOIN cs c ON c.repository_id = ref.repository_id AND c.name = ref.name AND c.type IN ('METHOD', 'FUNCTION', 'CONSTRUCTOR')
    LEFT JOIN box cb ON cb.id = c.id GROUP BY 1, 2),
r AS (SELECT *, CASE WHEN n_repo = 1 THEN 'repository' WHEN n_box = 1 THEN 'type' WHEN n_box > 1 THEN 'ambiguous' WHEN n_file = 1 THEN 'file'
    WHEN n_repo > 0 THEN 'ambiguous' ELSE 'unknown' END AS rule FROM v)
SELECT ref_id, source_id, CASE rule WHEN 'repository' THEN only_one WHEN 'type' THEN box_one WHEN 'file' THEN file_one END AS target_id, rule FROM r""",
    "nested_call_suppression": MODEL_SQL + """, p AS (SELECT s.id AS source_id, cc.id AS chunk_id, cc.start_line AS line, s.repository_id, s.file_id, s.start_line AS a, s.end_line AS b
    FROM cc JOIN cs s ON s.repository_id = cc.repository_id AND s.file_id = cc.file_id AND s.type IN ('METHOD', 'FUNCTION') AND cc.start_line BETWEEN s.start_line AND s.end_line)
SELECT source_id, chunk_id, line FROM p WHERE NOT EXISTS (SELECT 1 FROM cs n WHERE n.repository_id = p.repository_id AND n.file_id = p.file_id
    AND n.type IN ('METHOD', 'FUNCTION') AND n.id <> p.source_id AND n.start_line >= p.a AND n.end_line <= p.b AND (n.start_line > p.a OR n.end_line < p.b)
    AND p.line BETWEEN n.start_line AND n.end_line)""",
}
