"""Coverage and integrity reports on the code model."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window as W, functions as F

from quarrylens.operators.records import canonical_id
from quarrylens.sources.model import MODEL_SQL, RELATIONSHIP_TYPES, SYMBOL_TYPES, CodeModel


def embedding_coverage(m: CodeModel) -> DataFrame:
    return m.chunks.groupBy("repository_id").agg(
        F.count("*").alias("n_chunks"), F.count_if(F.col("dims") > 0).alias("n_embedded"),
        F.count_if(F.col("dims") <= 0).alias("n_missing"))


def embedding_dimensions(m: CodeModel) -> DataFrame:
    """Histogram of vector lengths; -1 stands for no vector."""
    return m.chunks.groupBy("dims").agg(F.count("*").alias("n_chunks"))


def duplicate_edges(m: CodeModel) -> DataFrame:
    """Current edges that occur under several ids."""
    return m.relationships.groupBy("repository_id", "source_symbol_id", "target_symbol_id", "type").agg(
        F.count("*").alias("n_ids")).filter("n_ids > 1")


def cross_repository_edges(m: CodeModel) -> DataFrame:
    """Edges of which an endpoint belongs to another repository."""
    ends = m.symbols.select("id", "repository_id")
    s = ends.select(F.col("id").alias("source_symbol_id"), F.col("repository_id").alias("source_repository_id"))
    t = ends.select(F.col("id").alias("target_symbol_id"), F.col("repository_id").alias("target_repository_id"))
    return m.relationships.join(s, "source_symbol_id").join(t, "target_symbol_id").filter(
        (F.col("source_repository_id") != F.col("repository_id")) | (F.col("target_repository_id") != F.col("repository_id"))
    ).select("id", "repository_id", "source_repository_id", "target_repository_id", "type")


def edge_totals(m: CodeModel) -> DataFrame:
    """Edges and distinct sources per type, every type listed, and a TOTAL row."""
    kinds = m.spark.createDataFrame([(t,) for t in RELATIONSHIP_TYPES], "type string")
    per = kinds.join(
        m.edges.groupBy("type").agg(F.count("*").alias("n_edges"), F.countDistinct("source_symbol_id").alias("n_sources")), "type", "left")
    total = m.edges.agg(F.lit("TOTAL").alias("type"), F.count("*").alias("n_edges"), F.countDistinct("source_symbol_id").alias("n_sources"))
    return per.select("type", F.coalesce("n_edges", F.lit(0)).alias("n_edges"), F.coalesce("n_sources", F.lit(0)).alias("n_sources")
                      ).unionByName(total)


def symbol_totals(m: CodeModel) -> DataFrame:
    kinds = m.spark.createDataFrame([(t,) for t in SYMBOL_TYPES], "type string")
    counts = m.symbols.groupBy("type").agg(F.count("*").alias("n"))
    chunked = m.chunks.join(m.symbols.select(F.col("id").alias("symbol_id"), "type"), "symbol_id").groupBy("type").agg(
        F.count("*").alias("c"))
    return kinds.join(counts, "type", "left").join(chunked, "type", "left").select(
        "type", F.coalesce("n", F.lit(0)).alias("n_symbols"), F.coalesce("c", F.lit(0)).alias("n_chunks"))


def repository_edges(m: CodeModel) -> DataFrame:
    """Repositories by number of edges, those without any included."""
    return m.repositories.join(m.edges.withColumnRenamed("id", "edge_id").withColumnRenamed("repository_id", "id"), "id", "left").groupBy(
        "id").agg(F.count("edge_id").alias("n_edges"), F.countDistinct("target_symbol_id").alias("n_targets"))


def chunk_reference_violations(m: CodeModel) -> DataFrame:
    """Per repository: chunks whose file or symbol is missing or of another repository."""
    f = m.files.select(F.col("id").alias("file_id"), F.col("repository_id").alias("f_repo"))
    s = m.symbols.select(F.col("id").alias("symbol_id"), F.col("repository_id").alias("s_repo"))
    joined = m.chunks.join(f, "file_id", "left").join(s, "symbol_id", "left")
    return joined.groupBy("repository_id").agg(
        F.count_if(F.col("f_repo").isNull()).alias("missing_file"),
        F.count_if(F.col("f_repo") != F.col("repository_id")).alias("foreign_file"),
        F.count_if(F.col("symbol_id").isNotNull() & F.col("s_repo").isNull()).alias("missing_symbol"),
        F.count_if(F.col("s_repo") != F.col("repository_id")).alias("foreign_symbol"))


def chunk_sanity(m: CodeModel) -> DataFrame:
    """One row: chunks with wrong lines, without content, and repeated ones."""
    groups = m.chunks.groupBy("repository_id", "file_id", "start_line", "end_line", "content_hash").agg(F.count("*").alias("n"))
    repeated = groups.agg(F.count_if(F.col("n") > 1).alias("repeated_groups"))
    return m.chunks.agg(
        F.count("*").alias("n_chunks"),
        F.count_if((F.col("start_line") < 1) | (F.col("end_line") < F.col("start_line"))).alias("wrong_lines"),
        F.count_if(F.coalesce(F.col("n_solid"), F.lit(0)) == 0).alias("empty_content")).crossJoin(repeated)


def sample_per_kind(m: CodeModel) -> DataFrame:
    """The longest chunk for each kind of symbol (chunks without a symbol are kind FILE)."""
    kinds = m.chunks.join(m.symbols.select(F.col("id").alias("symbol_id"), "type"), "symbol_id", "left").withColumn(
        "kind", F.when(F.col("symbol_id").isNull(), "FILE").when(F.col("type").isin("METHOD", "CONSTRUCTOR", "FUNCTION"), "CALLABLE")
        .when(F.col("type").isin("CLASS", "INTERFACE", "ENUM"), "CONTAINER").otherwise(F.coalesce("type", F.lit("UNKNOWN"))))
    w = W.partitionBy("kind").orderBy(F.desc("n_chars"), "start_line", "id")
    return kinds.withColumn("rank", F.row_number().over(w)).filter("rank = 1").select("kind", "id", "n_chars", "start_line")


def unusable_vectors(m: CodeModel) -> DataFrame:
    """Why delivered vectors cannot be used: rows, chunks, and the ten smallest chunk ids per reason."""
    v = F.col("embedding")
    reason = (F.when(v.isNull(), "missing").when(F.size(v) != 384, "wrong length")
              .when(F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), "not finite").when(~F.exists(v, lambda x: x != 0), "all zero"))
    rows = m.raw("code_chunks").select(canonical_id("id").alias("id"), reason.alias("reason")).filter("reason IS NOT NULL")
    once = rows.groupBy("reason", "id").agg(F.count("*").alias("n"))
    first = once.withColumn("k", F.row_number().over(W.partitionBy("reason").orderBy("id"))).filter("k <= 10").groupBy("reason").agg(
        F.array_join(F.array_sort(F.collect_list("id")), ",").alias("first_ids"))
    return once.groupBy("reason").agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_chunks")).join(first, "reason")


def column_nulls(m: CodeModel) -> DataFrame:
    """Nulls per column of the delivered repositories, files and symbols."""
    parts = []
    for table in ("repositories", "files", "symbols"):
        df = m.raw(table)
        row = df.select(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
        pairs = F.inline(F.array(*[F.struct(F.lit(table).alias("table_name"), F.lit(c).alias("column_name"), F.col(c).alias("n_null")) for c in df.columns]))
        parts.append(row.select(pairs))
    return reduce(DataFrame.unionByName, parts)


def search_log_quality(m: CodeModel) -> DataFrame:
    """Logged searches per month: rows, rows repeated, similarities missing or off the cosine scale."""
    log = m.raw("search_chunks").select(
        canonical_id("search_id").alias("search_id"), canonical_id("chunk_id").alias("chunk_id"), "result_rank", "similarity", "searched_at")
    once = log.groupBy("search_id", "chunk_id", "result_rank").agg(
        F.count("*").alias("n"), F.max("similarity").alias("similarity"), F.min("searched_at").alias("searched_at"))
    return once.groupBy(F.date_format("searched_at", "yyyy-MM").alias("month")).agg(
        F.sum("n").alias("n_rows"), F.sum(F.col("n") - 1).alias("n_repeated"),
        F.count_if(F.col("similarity").isNull()).alias("n_null"),
        F.count_if(F.abs("similarity") > 1.000001).alias("n_off_scale"))


def _q(f):
    return lambda spark, d: f(CodeModel(spark, d))


QUERIES = {f.__name__: _q(f) for f in (
    embedding_coverage, embedding_dimensions, duplicate_edges, cross_repository_edges, edge_totals, symbol_totals, repository_edges,
    chunk_reference_violations, chunk_sanity, sample_per_kind, unusable_vectors, column_nulls, search_log_quality)}

_KINDS = ", ".join(f"('{t}')" for t in RELATIONSHIP_TYPES)
_SYMBOL_KINDS = ", ".join(f"('{t}')" for t in SYMBOL_TYPES)
_NULL_COLUMNS = {
    "repositories": "id name url branch commit_hash created_at indexed_at owner_user_id demo_session_id",
    "files": "id repository_id path language size hash ingested_at deleted_at",
    "symbols": "id repository_id file_id name type start_line end_line parent_symbol_id signature ingested_at deleted_at",
}

ORACLE = {
    "embedding_coverage": MODEL_SQL + """SELECT repository_id, count(*) AS n_chunks, count(*) FILTER (WHERE dims > 0) AS n_embedded,
count(*) FILTER (WHERE dims <= 0) AS n_missing FROM cc GROUP BY 1""",
    "embedding_dimensions": MODEL_SQL + "SELECT CAST(dims AS INTEGER) AS dims, count(*) AS n_chunks FROM cc GROUP BY 1",
    "duplicate_edges": MODEL_SQL + """SELECT repository_id, source_symbol_id, target_symbol_id, type, count(*) AS n_ids FROM cl
GROUP BY ALL HAVING count(*) > 1""",
    "cross_repository_edges": MODEL_SQL + """SELECT cl.id, cl.repository_id, s.repository_id AS source_repository_id,
t.repository_id AS target_repository_id, cl.type FROM cl JOIN cs s ON s.id = source_symbol_id JOIN cs t ON t.id = target_symbol_id
WHERE s.repository_id <> cl.repository_id OR t.repository_id <> cl.repository_id""",
    "edge_totals": MODEL_SQL + f"""SELECT k.type, count(ce.id) AS n_edges, count(DISTINCT source_symbol_id) AS n_sources
FROM (VALUES {_KINDS}) k(type) LEFT JOIN ce ON ce.type = k.type GROUP BY 1
UNION ALL SELECT 'TOTAL', count(*), count(DISTINCT source_symbol_id) FROM ce""",
    "symbol_totals": MODEL_SQL + f"""SELECT k.type, (SELECT count(*) FROM cs WHERE cs.type = k.type) AS n_symbols,
(SELECT count(*) FROM cc JOIN cs ON cs.id = cc.symbol_id WHERE cs.type = k.type) AS n_chunks FROM (VALUES {_SYMBOL_KINDS}) k(type)""",
    "repository_edges": MODEL_SQL + """SELECT cr.id, count(ce.id) AS n_edges, count(DISTINCT target_symbol_id) AS n_targets
FROM cr LEFT JOIN ce ON ce.repository_id = cr.id GROUP BY 1""",
    "chunk_reference_violations": MODEL_SQL + """SELECT cc.repository_id, count(*) FILTER (WHERE cf.id IS NULL) AS missing_file,
count(*) FILTER (WHERE cf.repository_id <> cc.repository_id) AS foreign_file,
count(*) FILTER (WHERE cc.symbol_id IS NOT NULL AND cs.id IS NULL) AS missing_symbol,
count(*) FILTER (WHERE cs.repository_id <> cc.repository_id) AS foreign_symbol
FROM cc LEFT JOIN cf ON cf.id = cc.file_id LEFT JOIN cs ON cs.id = cc.symbol_id GROUP BY 1""",
    "chunk_sanity": MODEL_SQL + """SELECT count(*) AS n_chunks, count(*) FILTER (WHERE start_line < 1 OR end_line < start_line) AS wrong_lines,
count(*) FILTER (WHERE coalesce(length(trim(content, ' ')), 0) = 0) AS empty_content,
(SELECT count(*) FROM (SELECT 1 FROM cc GROUP BY repository_id, file_id, start_line, end_line, content HAVING count(*) > 1)) AS repeated_groups FROM cc""",
    "sample_per_kind": MODEL_SQL + """, k AS (SELECT cc.id, length(content) AS n_chars, cc.start_line, CASE WHEN cc.symbol_id IS NULL THEN 'FILE'
    WHEN type IN ('METHOD', 'CONSTRUCTOR', 'FUNCTION') THEN 'CALLABLE' WHEN type IN ('CLASS', 'INTERFACE', 'ENUM') THEN 'CONTAINER'
    ELSE coalesce(type, 'UNKNOWN') END AS kind FROM cc LEFT JOIN cs ON cs.id = cc.symbol_id)
SELECT kind, id, CAST(n_chars AS INTEGER) AS n_chars, start_line FROM k
QUALIFY row_number() OVER (PARTITION BY kind ORDER BY n_chars DESC NULLS LAST, start_line NULLS FIRST, id) = 1""",
    "unusable_vectors": """WITH r AS (SELECT lower(trim(id, e' \\t\\r\\n')) AS id, CASE WHEN embedding IS NULL THEN 'missing' WHEN len(embedding) <> 384 THEN 'wrong length'
    WHEN list_bool_or([x IS NULL OR NOT isfinite(x) FOR x IN embedding]) THEN 'not finite' WHEN NOT list_bool_or([x <> 0 FOR x IN embedding]) THEN 'all zero' END AS reason FROM code_chunks),
o AS (SELECT reason, id, count(*) AS n, row_number() OVER (PARTITION BY reason ORDER BY id) AS k FROM r WHERE reason IS NOT NULL GROUP BY 1, 2)
SELECT reason, CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_chunks, string_agg(id, ',' ORDER BY id) FILTER (WHERE k <= 10) AS first_ids FROM o GROUP BY 1""",
    "column_nulls": " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, '{c}' AS column_name, count(*) FILTER (WHERE {c} IS NULL) AS n_null FROM {t}"
        for t, cs in _NULL_COLUMNS.items() for c in cs.split()),
    "search_log_quality": """WITH o AS (SELECT lower(trim(search_id, e' \\t\\r\\n')) AS s, lower(trim(chunk_id, e' \\t\\r\\n')) AS c, result_rank,
count(*) AS n, max(similarity) AS similarity, min(searched_at) AS searched_at FROM search_chunks GROUP BY ALL)
SELECT strftime(searched_at, '%Y-%m') AS month, CAST(sum(n) AS BIGINT) AS n_rows, CAST(sum(n - 1) AS BIGINT) AS n_repeated,
count(*) FILTER (WHERE similarity IS NULL) AS n_null, count(*) FILTER (WHERE abs(similarity) > 1.000001) AS n_off_scale FROM o GROUP BY 1""",
}
