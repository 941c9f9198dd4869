"""Look-ups and listings: repositories, files, symbols, chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quarrylens.sources.model import MODEL_SQL, CodeModel


class NotFound(LookupError):
    """No such record in this repository; records of other repositories count as missing."""


def check_page(page: int, page_size: int, most_pages: int = 1_000_000, most_rows: int = 100) -> None:
    if not 1 <= page <= most_pages or not 1 <= page_size <= most_rows:
        raise ValueError("page or page size out of range")


def check_text(value: str, most: int, what: str) -> str:
    """A trimmed request text without control characters."""
    value = value.strip()
    if not value or len(value) > most or any(ord(c) < 32 and c not in "\n\t\r" for c in value):
        raise ValueError(f"{what} is empty, too long, or holds control characters")
    return value


def repository_list(model: CodeModel, owner: str | None = None) -> DataFrame:
    """Repositories with counts of files and symbols and their indexing status, newest first by `listed_at`."""
    n_files = model.files.groupBy(F.col("repository_id").alias("id")).agg(F.count("*").alias("n_files"))
    n_symbols = model.symbols.groupBy(F.col("repository_id").alias("id")).agg(F.count("*").alias("n_symbols"))
    rows = model.repositories if owner is None else model.repositories.filter(F.col("owner_user_id") == owner.lower())
    return rows.join(n_files, "id", "left").join(n_symbols, "id", "left").select(
        "id", "name", F.when(F.col("indexed_at").isNull(), "pending").otherwise("indexed").alias("indexing_status"),
        F.coalesce("n_files", F.lit(0)).alias("n_files"), F.coalesce("n_symbols", F.lit(0)).alias("n_symbols"),
        F.coalesce("indexed_at", "created_at").alias("listed_at"))


def file_listing(model: CodeModel) -> DataFrame:
    """Files with the extent and number of their symbols."""
    extents = model.symbols.groupBy(F.col("file_id").alias("id"), "repository_id").agg(
        F.min("start_line").alias("first_line"), F.max("end_line").alias("last_line"), F.count("*").alias("n_symbols"))
    return model.files.join(extents, ["id", "repository_id"], "left").select(
        "id", "repository_id", "path", "language", "size", "first_line", "last_line", F.coalesce("n_symbols", F.lit(0)).alias("n_symbols"))


def files_page(model: CodeModel, repository_id: str, page: int = 1, page_size: int = 100) -> DataFrame:
    check_page(page, page_size, 10_000, 200)
    rows = file_listing(model).filter(F.col("repository_id") == repository_id)
    return rows.orderBy("path", "id").offset((page - 1) * page_size).limit(page_size)


def file_detail(model: CodeModel) -> DataFrame:
    """Files with their symbols as one ordered text and the number of chunks; sizes beyond 2^53 are null."""
    ordered = F.array_sort(F.collect_list(F.struct("start_line", "name", "id", "type")))
    names = F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", s["start_line"], s["type"], s["name"])), ",")
    symbols = model.symbols.groupBy(F.col("file_id").alias("id"), "repository_id").agg(names.alias("symbols"))
    chunks = model.chunks.groupBy(F.col("file_id").alias("id"), "repository_id").agg(F.count("*").alias("n_chunks"))
    return model.files.join(symbols, ["id", "repository_id"], "left").join(chunks, ["id", "repository_id"], "left").select(
        "id", "path", F.when(F.abs("size") <= 2**53 - 1, F.col("size")).alias("size"),
        F.coalesce("symbols", F.lit("")).alias("symbols"), F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"))


def find_file(model: CodeModel, repository_id: str, path: str) -> DataFrame:
    """The file with this path; both separators are the same."""
    path = check_text(path, 2000, "path").replace("\\", "/")
    rows = file_detail(model).join(
        model.files.filter((F.col("repository_id") == repository_id) & (F.col("path") == path)).select("id"), "id", "left_semi")
    if rows.isEmpty():
        raise NotFound(path)
    return rows


def symbol_detail(model: CodeModel) -> DataFrame:
    """Symbols with file, parent, and the chunk that starts nearest to them (then by end line and id)."""
    s = model.graph_symbols
    c = model.chunks.filter(F.col("symbol_id").isNotNull()).select(
        F.col("symbol_id").alias("id"), "repository_id", F.col("id").alias("chunk_id"),
        F.col("start_line").alias("c_start"), F.col("end_line").alias("c_end"))
    nearest = (
        c.join(s.select("id", "repository_id", "start_line"), ["id", "repository_id"])
        .groupBy("id", "repository_id")
        .agg(F.min(F.struct(F.abs(F.col("c_start") - F.col("start_line")).alias("off"), "c_end", "chunk_id", "c_start")).alias("n"))
    )
    return s.join(nearest, ["id", "repository_id"], "left").select(
        "id", "name", "type", "file_path", "start_line", "end_line", "parent_name", "signature",
        F.col("n.chunk_id").alias("chunk_id"), F.col("n.c_start").alias("chunk_start"), F.col("n.c_end").alias("chunk_end"))


def find_symbol(model: CodeModel, repository_id: str, symbol_id: str) -> DataFrame:
    inside = model.symbols.filter((F.col("repository_id") == repository_id) & (F.col("id") == symbol_id.strip().lower())).select("id")
    rows = symbol_detail(model).join(inside, "id", "left_semi")
    if rows.isEmpty():
        raise NotFound(symbol_id)
    return rows


def symbols_matching(model: CodeModel, kind: str | None = None, search: str | None = None) -> DataFrame:
    """Symbols of all repositories by type and by a part of the name (any case; % and _ are wildcards)."""
    rows = model.graph_symbols
    if kind is not None:
        rows = rows.filter(F.col("type") == kind)
    if search is not None:
        search = check_text(search, 100, "search")
        if search.endswith("\\"):
            raise ValueError("search ends in an escape")
        rows = rows.filter(F.col("name").ilike(f"%{search}%"))
    return rows


def symbol_page(model: CodeModel, repository_id: str, page: int = 1, page_size: int = 50, kind: str | None = None,
                search: str | None = None) -> tuple[DataFrame, int, int]:
    """(page, number of matches, number of pages), ordered by path, line, name, id."""
    check_page(page, page_size)
    rows = symbols_matching(model, kind, search).filter(F.col("repository_id") == repository_id)
    total = rows.count()
    shown = rows.select("id", "name", "type", "file_path", "start_line", "end_line", "parent_name").orderBy(
        "file_path", "start_line", "name", "id").offset((page - 1) * page_size).limit(page_size)
    return shown, total, -(-total // page_size)


def missing_embeddings(model: CodeModel) -> DataFrame:
    """Chunks without a vector, with path and symbol, the symbol only if it is in the same file."""
    f = model.files.select(F.col("id").alias("file_id"), "repository_id", "path")
    s = model.symbols.select(F.col("id").alias("symbol_id"), "repository_id", "file_id", F.col("name").alias("symbol_name"))
    return model.chunks.filter("dims <= 0").join(f, ["file_id", "repository_id"]).join(
        s, ["symbol_id", "repository_id", "file_id"], "left").select("id", "path", "symbol_name", "start_line", "end_line")


def chunk_counts(model: CodeModel) -> DataFrame:
    return model.chunks.groupBy("repository_id").agg(
        F.count("*").alias("n_chunks"), F.countDistinct("file_id").alias("n_files"), F.sum("n_chars").alias("n_chars"))


def _q(f):
    return lambda spark, d: f(CodeModel(spark, d))


QUERIES = {
    "repo_list": _q(repository_list),
    "file_listing": _q(file_listing),
    "file_detail": _q(file_detail),
    "symbol_detail": _q(symbol_detail),
    "symbol_search": _q(lambda m: symbols_matching(m, "METHOD", "order").select("id", "name", "file_path", "start_line")),
    "missing_embeddings": _q(missing_embeddings),
    "chunk_counts": _q(chunk_counts),
}

ORACLE = {
    "repo_list": MODEL_SQL + """SELECT id, name, CASE WHEN indexed_at IS NULL THEN 'pending' ELSE 'indexed' END AS indexing_status,
(SELECT count(*) FROM cf WHERE cf.repository_id = cr.id) AS n_files, (SELECT count(*) FROM cs WHERE cs.repository_id = cr.id) AS n_symbols,
coalesce(indexed_at, created_at) AS listed_at FROM cr""",
    "file_listing": MODEL_SQL + """, x AS (SELECT file_id, repository_id, min(start_line) AS first_line, max(end_line) AS last_line, count(*) AS n FROM cs GROUP BY ALL)
SELECT cf.id, cf.repository_id, path, language, size, first_line, last_line, coalesce(n, 0) AS n_symbols
FROM cf LEFT JOIN x ON x.file_id = cf.id AND x.repository_id = cf.repository_id""",
    "file_detail": MODEL_SQL + """, x AS (SELECT file_id, repository_id, string_agg(start_line || ':' || type || ':' || name, ',' ORDER BY start_line, name, id) AS symbols
    FROM cs GROUP BY ALL), y AS (SELECT file_id, repository_id, count(*) AS n FROM cc GROUP BY ALL)
SELECT cf.id, path, size, coalesce(symbols, '') AS symbols, coalesce(n, 0) AS n_chunks FROM cf
LEFT JOIN x ON x.file_id = cf.id AND x.repository_id = cf.repository_id LEFT JOIN y ON y.file_id = cf.id AND y.repository_id = cf.repository_id""",
    "symbol_detail": MODEL_SQL + """, n AS (SELECT gs.id, cc.id AS chunk_id, cc.start_line AS chunk_start, cc.end_line AS chunk_end FROM gs
    JOIN cc ON cc.symbol_id = gs.id AND cc.repository_id = gs.repository_id
    QUALIFY row_number() OVER (PARTITION BY gs.id ORDER BY abs(cc.start_line - gs.start_line), cc.end_line, cc.id) = 1)
SELECT gs.id, name, type, file_path, start_line, end_line, parent_name, signature, chunk_id, chunk_start, chunk_end FROM gs LEFT JOIN n ON n.id = gs.id""",
    "symbol_search": MODEL_SQL + "SELECT id, name, file_path, start_line FROM gs WHERE type = 'METHOD' AND name ILIKE '%order%'",
    "missing_embeddings": MODEL_SQL + """SELECT cc.id, cf.path, cs.name AS symbol_name, cc.start_line, cc.end_line FROM cc
JOIN cf ON cf.id = cc.file_id AND cf.repository_id = cc.repository_id
LEFT JOIN cs ON cs.id = cc.symbol_id AND cs.repository_id = cc.repository_id AND cs.file_id = cc.file_id WHERE cc.dims <= 0""",
    "chunk_counts": MODEL_SQL + """SELECT repository_id, count(*) AS n_chunks, count(DISTINCT file_id) AS n_files,
CAST(sum(length(content)) AS BIGINT) AS n_chars FROM cc GROUP BY 1""",
}
