"""Search queries. The searches asked are those of the search log: each logged query chunk gives a vector and, by its symbol's name, a text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quarrylens.functions.text import embedding_text, normal_path, parser_language, query_tokens, stored_language
from quarrylens.operators import search as S
from quarrylens.operators.records import canonical_id
from quarrylens.plans.graph import graph_of
from quarrylens.session import cut_lineage
from quarrylens.sources.model import MODEL_SQL, CodeModel


def vectors(m: CodeModel) -> DataFrame:
    """id, repository_id, symbol_id, start_line, vector of the newest version of each chunk."""
    return newest_rows(m, ["repository_id", "symbol_id"], ["start_line", "embedding"]).withColumnRenamed("embedding", "vector")


def newest_rows(m: CodeModel, ids: list[str], plain: list[str]) -> DataFrame:
    """id and the given columns of the newest version of each chunk.

    Which version holds is decided on ids and times alone; wide columns stay where
    they are read, but for the few chunks that were delivered twice.
    """
    at = F.coalesce("ingested_at", F.lit("0001-01-01").cast("timestamp_ntz")).alias("_at")
    rows = m.raw("code_chunks").select(canonical_id("id").alias("id"), *[canonical_id(c).alias(c) for c in ids], *plain, at).filter("id IS NOT NULL")
    repeated = cut_lineage(rows.groupBy("id").agg(F.count("*").alias("_n"), F.max("_at").alias("_newest")).filter("_n > 1").select("id", "_newest"))
    repeated = F.broadcast(repeated) if repeated.count() <= 200_000 else repeated.hint("merge")
    marked = rows.join(repeated, "id", "left")
    again = marked.filter("_at = _newest").groupBy("id").agg(F.max_by(F.struct(*ids, *plain), "_at").alias("v")).select("id", "v.*")
    return marked.filter("_newest IS NULL").select("id", *ids, *plain).unionByName(again)


def logged_queries(m: CodeModel, chunks: DataFrame) -> DataFrame:
    """query_id, repository_id, text, vector of every logged search whose query chunk is known."""
    asked = m.raw("search_chunks").select(canonical_id("search_id").alias("query_id"), canonical_id("query_chunk_id").alias("id")).filter(
        F.col("query_id").isNotNull()).groupBy("query_id").agg(F.min("id").alias("id"))
    names = m.symbols.select(F.col("id").alias("symbol_id"), "name")
    return asked.join(chunks, "id").join(names, "symbol_id", "left").select(
        "query_id", "repository_id", F.coalesce("name", F.lit("")).alias("text"), "vector")


def semantic_search(spark: SparkSession, d: str) -> DataFrame:
    m = CodeModel(spark, d)
    c = vectors(m)
    return S.semantic_top(logged_queries(m, c), c, 6).select("query_id", "chunk_id", F.round("similarity", 6).alias("similarity"), "rank")


def name_search(spark: SparkSession, d: str) -> DataFrame:
    m = CodeModel(spark, d)
    return S.name_matches(logged_queries(m, vectors(m)), m.graph_symbols).select("query_id", "symbol_id", "rank")


def structural_search(spark: SparkSession, d: str) -> DataFrame:
    m = CodeModel(spark, d)
    c = vectors(m)
    return S.structural_search(logged_queries(m, c), graph_of(m), c.drop("vector"))


def hybrid_scores(spark: SparkSession, d: str) -> DataFrame:
    m = CodeModel(spark, d)
    c = vectors(m)
    return S.hybrid_evidence(logged_queries(m, c), graph_of(m), c).select(
        "query_id", "evidence_id", "kind", "provenance", F.round("score", 6).alias("score"))


def hybrid_context(spark: SparkSession, d: str) -> DataFrame:
    """What of each query's evidence fits the context, in order."""
    return _context(spark, d)[1]


def hybrid_summary(spark: SparkSession, d: str) -> DataFrame:
    """Per query: evidence found and packed, edges and symbols that stay with it, and whether something was left out."""
    evidence, packed, g = _context(spark, d)
    relationships, symbols, summary = S.pruned_result(evidence, cut_lineage(packed), g)
    n_edges = relationships.groupBy("query_id").agg(F.count("*").alias("n_relationships"))
    n_symbols = symbols.groupBy("query_id").agg(F.count("*").alias("n_symbols"))
    return summary.join(n_edges, "query_id", "left").join(n_symbols, "query_id", "left").na.fill(0, ["n_relationships", "n_symbols"])


def query_search(spark: SparkSession, d: str) -> DataFrame:
    """Semantic search with structural evidence for queries without a usable vector."""
    m = CodeModel(spark, d)
    c = vectors(m)
    return S.search(logged_queries(m, c), graph_of(m), c, "semantic", 5, 1).select("query_id", "evidence_id", "rank", "semantic_available")


def _context(spark: SparkSession, d: str):
    m = CodeModel(spark, d)
    c, g = vectors(m), graph_of(m)
    paths = m.files.select(F.col("id").alias("file_id"), F.col("path").alias("file_path"))
    texts = newest_rows(m, ["file_id"], ["start_line", "end_line", "content"]).join(paths, "file_id", "left")
    evidence = cut_lineage(S.hybrid_evidence(logged_queries(m, c), g, c))
    return evidence, S.pack_context(S.evidence_blocks(evidence, g, texts)), g


def symbol_tokens(spark: SparkSession, d: str) -> DataFrame:
    m = CodeModel(spark, d)
    text = F.concat_ws(" ", "name", "signature")
    return m.symbols.select("id", F.array_join(query_tokens(text), " ").alias("tokens"))


def path_normalise(spark: SparkSession, d: str) -> DataFrame:
    m = CodeModel(spark, d)
    raw = F.concat(F.lit("./x/../"), F.col("path"))
    return m.files.select("id", normal_path(raw).alias("path"), parser_language("path").alias("parser_language"),
                          stored_language("path").alias("language"))


def embedding_texts(spark: SparkSession, d: str) -> DataFrame:
    m = CodeModel(spark, d)
    paths = m.files.select(F.col("id").alias("file_id"), "repository_id", F.col("path").alias("file_path"))
    names = m.symbols.select(F.col("id").alias("symbol_id"), "name", "type")
    text = embedding_text(F.col("file_path"), F.col("name"), F.col("type"), F.col("start_line"), F.col("end_line"), F.col("content"))
    # the text of the version that holds, found by the hash that was chosen with it
    texts = m.raw("code_chunks").select(canonical_id("id").alias("id"), F.xxhash64("content").alias("content_hash"), "content").groupBy(
        "id", "content_hash").agg(F.first("content").alias("content"))
    return m.chunks.join(texts, ["id", "content_hash"]).join(paths, ["file_id", "repository_id"]).join(names, "symbol_id", "left").select("id", text.alias("embedding_text"))


QUERIES = {f.__name__: f for f in (
    semantic_search, name_search, structural_search, query_search, hybrid_scores, hybrid_context, hybrid_summary, symbol_tokens, path_normalise, embedding_texts)}

_ASKED = MODEL_SQL + """, v AS (SELECT lower(trim(id, e' \\t\\r\\n')) AS id, arg_max(struct_pack(r := lower(trim(repository_id, e' \\t\\r\\n')),
    s := lower(trim(symbol_id, e' \\t\\r\\n')), l := start_line, e := embedding), ingested_at) AS v FROM code_chunks GROUP BY 1),
vec AS (SELECT id, v.r AS repository_id, v.s AS symbol_id, v.l AS start_line, v.e::DOUBLE[] AS e,
    coalesce(len(v.e) = 384 AND list_bool_and([x IS NOT NULL AND isfinite(x) FOR x IN v.e]) AND list_bool_or([x <> 0 FOR x IN v.e]), false) AS ok FROM v),
asked AS (SELECT lower(trim(search_id, e' \\t\\r\\n')) AS query_id, min(lower(trim(query_chunk_id, e' \\t\\r\\n'))) AS id FROM search_chunks GROUP BY 1),
q AS (SELECT query_id, vec.repository_id, coalesce(cs.name, '') AS text, vec.e, vec.ok FROM asked JOIN vec USING (id) LEFT JOIN cs ON cs.id = vec.symbol_id),
sem AS (SELECT query_id, c.id AS chunk_id, round(list_dot_product(q.e, c.e) / sqrt(list_dot_product(q.e, q.e) * list_dot_product(c.e, c.e)), 9) AS similarity
    FROM q JOIN vec c ON c.repository_id = q.repository_id WHERE q.ok AND c.ok
    QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, c.id) <= 6),
tok AS (SELECT query_id, repository_id, list_distinct_ordered AS tokens FROM (
    SELECT query_id, repository_id, flatten([CASE WHEN t LIKE '%s' AND length(t) > 4 THEN [t, t[:-2]] ELSE [t] END
        FOR t IN regexp_extract_all(lower(text), '[a-z_$][a-z0-9_$]*')]) AS list_distinct_ordered FROM q)),
nm AS (SELECT query_id, tok.repository_id, gs.id AS symbol_id, row_number() OVER (PARTITION BY query_id ORDER BY
    NOT list_contains(tokens, lower(name)), coalesce(list_position(tokens, lower(name)), 999), start_line, gs.id) AS rank
    FROM tok JOIN gs ON gs.repository_id = tok.repository_id
    WHERE list_contains(tokens, lower(name)) OR list_bool_or([length(t) >= 4 AND lower(name) LIKE '%' || t || '%' FOR t IN tokens])),
both_ways AS (SELECT repository_id AS r, source_symbol_id AS a, target_symbol_id AS b, id FROM ce UNION ALL
    SELECT repository_id, target_symbol_id, source_symbol_id, id FROM ce)
"""

_STRUCTURAL = """, sd AS (SELECT query_id, repository_id, symbol_id FROM nm WHERE rank <= 5),
hit AS (SELECT sd.query_id, u.b AS s, u.id FROM sd JOIN both_ways u ON u.r = sd.repository_id AND u.a = sd.symbol_id),
sy AS (SELECT query_id, symbol_id AS s FROM sd UNION SELECT query_id, s FROM hit),
ch AS (SELECT query_id, 'chunk:' || vec.id AS evidence_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY start_line, vec.id) AS INTEGER) AS rank
    FROM sy JOIN vec ON vec.symbol_id = sy.s QUALIFY rank <= 5),
st5 AS (SELECT * FROM ch UNION ALL SELECT DISTINCT query_id, 'relationship:' || id, NULL FROM hit)
"""

_EVIDENCE = """, n8 AS (SELECT * FROM nm WHERE rank <= 8),
sd AS (SELECT query_id, vec.repository_id, vec.symbol_id FROM sem JOIN vec ON vec.id = sem.chunk_id
    JOIN gs ON gs.id = vec.symbol_id AND gs.repository_id = vec.repository_id UNION SELECT query_id, repository_id, symbol_id FROM n8),
hit AS (SELECT sd.query_id, u.b AS s, u.id FROM sd JOIN both_ways u ON u.r = sd.repository_id AND u.a = sd.symbol_id),
sy AS (SELECT query_id, symbol_id AS s FROM sd UNION SELECT query_id, s FROM hit),
st AS (SELECT sy.query_id, vec.id, bool_or(n8.symbol_id IS NOT NULL) AS matched FROM sy JOIN vec ON vec.symbol_id = sy.s
    LEFT JOIN n8 ON n8.query_id = sy.query_id AND n8.symbol_id = sy.s GROUP BY 1, 2),
ev AS (SELECT coalesce(sem.query_id, st.query_id) AS query_id, coalesce(sem.chunk_id, st.id) AS id, similarity, matched
    FROM sem FULL JOIN st ON st.query_id = sem.query_id AND st.id = sem.chunk_id),
evidence AS (SELECT query_id, 'chunk:' || id AS evidence_id, 'CHUNK' AS kind,
  CASE WHEN similarity IS NOT NULL AND matched IS NOT NULL THEN 'BOTH' WHEN similarity IS NOT NULL THEN 'SEMANTIC' ELSE 'STRUCTURAL' END AS provenance,
  (CASE WHEN similarity IS NOT NULL THEN 1 + greatest(0, similarity) + CASE WHEN matched IS NOT NULL THEN 0.35 ELSE 0 END
    WHEN matched THEN 0.8 ELSE 0.55 END)::DOUBLE AS score, similarity FROM ev
UNION ALL SELECT h.query_id, 'relationship:' || ce.id, 'RELATIONSHIP', 'STRUCTURAL', (CASE WHEN EXISTS (SELECT 1 FROM n8 WHERE n8.query_id = h.query_id
  AND n8.symbol_id IN (ce.source_symbol_id, ce.target_symbol_id)) THEN 0.85 ELSE 0.6 END)::DOUBLE, NULL
FROM (SELECT DISTINCT query_id, id FROM hit) h JOIN ce ON ce.id = h.id)
"""

_PACKED = _EVIDENCE + """, tx AS (SELECT lower(trim(id, e' \\t\\r\\n')) AS id, arg_max(struct_pack(f := lower(trim(file_id, e' \\t\\r\\n')), a := start_line, b := end_line,
    t := content), ingested_at) AS v FROM code_chunks GROUP BY 1),
told AS (SELECT e.query_id, e.evidence_id, e.score, coalesce(vec.symbol_id, ce.source_symbol_id) AS symbol_id, ce.id AS edge_id, ce.target_symbol_id AS far_id,
    '[' || e.evidence_id || '] ' || e.kind || ' ' || e.provenance || ' | ' || coalesce(cf.path, s.file_path, '') || ':' || coalesce(tx.v.a, s.start_line, 0) || '-'
    || coalesce(tx.v.b, s.end_line, 0) || coalesce(' | ' || s.name || coalesce(' (' || s.type || ')', ''), '')
    || coalesce(printf(' | similarity=%.4f', e.similarity), '') || chr(10)
    || coalesce(tx.v.t, s.name || ' --' || ce.type || '--> ' || t.name, '') AS block
  FROM evidence e LEFT JOIN vec ON e.evidence_id = 'chunk:' || vec.id LEFT JOIN tx ON tx.id = vec.id LEFT JOIN cf ON cf.id = tx.v.f
  LEFT JOIN ce ON e.evidence_id = 'relationship:' || ce.id LEFT JOIN gs s ON s.id = coalesce(vec.symbol_id, ce.source_symbol_id) LEFT JOIN gs t ON t.id = ce.target_symbol_id),
lined AS (SELECT *, length(block) AS n, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, evidence_id) AS no FROM told),
fold(query_id, no, used, n_in, evidence_id, taken) AS (
  SELECT query_id, 0::BIGINT, 0::BIGINT, 0::BIGINT, NULL::VARCHAR, false FROM (SELECT DISTINCT query_id FROM lined)
  UNION ALL SELECT f.query_id, l.no, CASE WHEN f.used + l.n + CASE WHEN f.used > 0 THEN 2 ELSE 0 END <= 24000 THEN f.used + l.n + CASE WHEN f.used > 0 THEN 2 ELSE 0 END ELSE f.used END,
    f.n_in + CASE WHEN f.used + l.n + CASE WHEN f.used > 0 THEN 2 ELSE 0 END <= 24000 THEN 1 ELSE 0 END, l.evidence_id,
    f.used + l.n + CASE WHEN f.used > 0 THEN 2 ELSE 0 END <= 24000
  FROM fold f JOIN lined l ON l.query_id = f.query_id AND l.no = f.no + 1),
packed AS (SELECT query_id, evidence_id, CAST(n_in AS INTEGER) AS position, used AS chars_so_far FROM fold WHERE taken)
"""

ORACLE = {
    "semantic_search": _ASKED + """SELECT query_id, chunk_id, round(similarity, 6) AS similarity,
CAST(row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, chunk_id) AS INTEGER) AS rank FROM sem""",
    "name_search": _ASKED + "SELECT query_id, symbol_id, CAST(rank AS INTEGER) AS rank FROM nm WHERE rank <= 8",
    "structural_search": _ASKED + _STRUCTURAL + "SELECT query_id, evidence_id, rank FROM st5",
    "query_search": _ASKED.replace("<= 6)", "<= 5)") + _STRUCTURAL + """SELECT query_id, 'chunk:' || chunk_id AS evidence_id,
CAST(row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, chunk_id) AS INTEGER) AS rank, true AS semantic_available FROM sem
UNION ALL SELECT st5.query_id, evidence_id, rank, false FROM st5 JOIN q ON q.query_id = st5.query_id AND NOT q.ok""",
    "hybrid_scores": _ASKED + _EVIDENCE + "SELECT query_id, evidence_id, kind, provenance, round(score, 6) AS score FROM evidence",
    "hybrid_context": _ASKED + _PACKED + "SELECT * FROM packed",
    "hybrid_summary": _ASKED + _PACKED + """, chosen AS (SELECT told.* FROM told JOIN packed USING (query_id, evidence_id)),
kept AS (SELECT query_id, symbol_id FROM chosen WHERE symbol_id IS NOT NULL UNION SELECT query_id, far_id FROM chosen WHERE far_id IS NOT NULL)
SELECT l.query_id, count(*) AS n_evidence, count(p.evidence_id) AS n_selected, coalesce(max(p.chars_so_far), 0) AS context_chars,
  count(p.evidence_id) < count(*) AS truncated, count(p.evidence_id) FILTER (WHERE l.edge_id IS NOT NULL) AS n_relationships,
  (SELECT count(*) FROM kept k WHERE k.query_id = l.query_id) AS n_symbols
FROM lined l LEFT JOIN packed p ON p.query_id = l.query_id AND p.evidence_id = l.evidence_id GROUP BY l.query_id""",
    "symbol_tokens": MODEL_SQL + """SELECT id, coalesce(array_to_string([u FOR u, i IN f IF list_position(f, u) = i], ' '), '') AS tokens FROM (
  SELECT id, flatten([CASE WHEN t LIKE '%s' AND length(t) > 4 THEN [t, t[:-2]] ELSE [t] END
    FOR t IN regexp_extract_all(lower(concat_ws(' ', name, signature)), '[a-z_$][a-z0-9_$]*')]) AS f FROM cs)""",
    "path_normalise": MODEL_SQL + """, e AS (SELECT id, path, lower(regexp_extract(path, '\\.[^./]+$')) AS x FROM cf)
SELECT id, path, CASE WHEN x = '.java' THEN 'java' WHEN x IN ('.js', '.jsx') THEN 'javascript' WHEN x = '.ts' THEN 'typescript' WHEN x = '.tsx' THEN 'tsx' END AS parser_language,
CASE WHEN x = '.java' THEN 'java' WHEN x IN ('.js', '.jsx') THEN 'javascript' WHEN x IN ('.ts', '.tsx') THEN 'typescript' END AS language FROM e""",
    "embedding_texts": MODEL_SQL + """SELECT cc.id, 'File: ' || cf.path || coalesce(chr(10) || 'Symbol: ' || cs.name, '') || coalesce(chr(10) || 'Symbol type: ' || cs.type, '')
|| coalesce(chr(10) || 'Lines: ' || cc.start_line || '-' || cc.end_line, '') || chr(10) || chr(10) || cc.content AS embedding_text
FROM cc JOIN cf ON cf.id = cc.file_id AND cf.repository_id = cc.repository_id LEFT JOIN cs ON cs.id = cc.symbol_id""",
}
