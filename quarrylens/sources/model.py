"""The code model read from delivered tables: current repositories, files, symbols, edges and chunks.

Every frame holds the newest version of each record with canonical ids; deleted
records are gone. `MODEL_SQL` says the same for DuckDB, as common table expressions.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from quarrylens.operators.records import canonical_id, latest_versions
from quarrylens.session import load

# Kinds of edges and symbols.
RELATIONSHIP_TYPES = ("CALLS", "EXTENDS", "IMPLEMENTS", "IMPORTS")
SYMBOL_TYPES = ("CLASS", "CONSTRUCTOR", "ENUM", "FIELD", "FUNCTION", "INTERFACE", "METHOD", "VARIABLE")
CONTAINER_TYPES = ("CLASS", "INTERFACE", "ENUM")
CALLABLE_TYPES = ("METHOD", "FUNCTION", "CONSTRUCTOR")


class CodeModel:
    """Frames of one data folder; each is built on first use."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = spark
        self.folder = folder

    def raw(self, name: str) -> DataFrame:
        return load(self.spark, self.folder, name)

    def _current(self, name: str, ids: list[str], plain: list[str], deletable: bool) -> DataFrame:
        extra = ["deleted_at"] if deletable else []
        slim = self.raw(name).select(
            canonical_id("id").alias("id"), *[canonical_id(c).alias(c) for c in ids], *plain, *extra, "ingested_at")
        rows = latest_versions(slim, [*ids, *plain, *extra])
        return (rows.filter("deleted_at IS NULL").drop("deleted_at") if deletable else rows).drop("arrived_at")

    @cached_property
    def repositories(self) -> DataFrame:
        return self.raw("repositories").select(
            canonical_id("id").alias("id"), "name", "url", "branch", "commit_hash", "created_at", "indexed_at",
            canonical_id("owner_user_id").alias("owner_user_id"), canonical_id("demo_session_id").alias("demo_session_id"),
        ).groupBy("id").agg(F.max(F.struct(
            "created_at", "indexed_at", "name", "url", "branch", "commit_hash", "owner_user_id", "demo_session_id")).alias("v")
        ).select("id", "v.*")

    @cached_property
    def files(self) -> DataFrame:
        return self._current("files", ["repository_id"], ["path", "language", "size", "hash"], True).withColumn(
            "path", F.translate("path", "\\", "/"))

    @cached_property
    def symbols(self) -> DataFrame:
        return self._current("symbols", ["repository_id", "file_id", "parent_symbol_id"],
                             ["name", "type", "start_line", "end_line", "signature"], True)

    @cached_property
    def relationships(self) -> DataFrame:
        """All current edges, whatever their endpoints."""
        return self._current("relationships", ["repository_id", "source_symbol_id", "target_symbol_id"], ["type"], False)

    @cached_property
    def chunks(self) -> DataFrame:
        """Current chunks without text and vector, with what is asked about these."""
        slim = self.raw("code_chunks").select(
            canonical_id("id").alias("id"), canonical_id("repository_id").alias("repository_id"),
            canonical_id("file_id").alias("file_id"), canonical_id("symbol_id").alias("symbol_id"),
            "start_line", "end_line", F.length("content").alias("n_chars"),
            F.xxhash64("content").alias("content_hash"), F.length(F.trim("content")).alias("n_solid"),
            F.coalesce(F.size("embedding"), F.lit(-1)).alias("dims"), "ingested_at")
        fields = ["repository_id", "file_id", "symbol_id", "start_line", "end_line", "n_chars", "content_hash", "n_solid", "dims"]
        return latest_versions(slim, fields).drop("arrived_at")

    @cached_property
    def graph_symbols(self) -> DataFrame:
        """Symbols with their file's path and their parent's name, both of the same repository."""
        f = self.files.select(F.col("id").alias("file_id"), "repository_id", F.col("path").alias("file_path"))
        p = self.symbols.select(F.col("id").alias("parent_symbol_id"), "repository_id", F.col("name").alias("parent_name"))
        return self.symbols.join(f, ["file_id", "repository_id"]).join(p, ["parent_symbol_id", "repository_id"], "left")

    @cached_property
    def edges(self) -> DataFrame:
        """Distinct edges (smallest id each) whose endpoints are graph symbols of the edge's repository."""
        ends = self.graph_symbols.select("id", "repository_id")
        unique = self.relationships.groupBy("repository_id", "source_symbol_id", "target_symbol_id", "type").agg(F.min("id").alias("id"))
        return (
            unique.join(ends.withColumnRenamed("id", "source_symbol_id"), ["source_symbol_id", "repository_id"])
            .join(ends.withColumnRenamed("id", "target_symbol_id"), ["target_symbol_id", "repository_id"])
            .select("id", "repository_id", "source_symbol_id", "target_symbol_id", "type")
        )


_ID = "lower(trim({0}, e' \\t\\r\\n'))"


def _newest(table: str, ids: str, plain: str, deletable: bool) -> str:
    fields = ", ".join(f"{c} := {_ID.format(c)}" for c in ids.split())
    others = ", ".join(f"{c} := {c}" for c in plain.split())
    extra = ", deleted_at := deleted_at" if deletable else ""
    names = ", ".join(f"v.{c} AS {c}" for c in [*ids.split(), *plain.split()])
    where = "WHERE v.deleted_at IS NULL" if deletable else ""
    return (f"(SELECT id, {names} FROM (SELECT {_ID.format('id')} AS id, "
            f"arg_max(struct_pack({fields}, {others}{extra}), ingested_at) AS v FROM {table} GROUP BY 1) {where})")


MODEL_SQL = f"""
WITH RECURSIVE cr AS (SELECT {_ID.format('id')} AS id, name, url, branch, commit_hash, created_at, indexed_at,
    {_ID.format('owner_user_id')} AS owner_user_id, {_ID.format('demo_session_id')} AS demo_session_id FROM repositories
    QUALIFY row_number() OVER (PARTITION BY {_ID.format('id')} ORDER BY created_at DESC NULLS LAST, indexed_at DESC NULLS LAST, name DESC) = 1),
cf0 AS {_newest('files', 'repository_id', 'path language size hash', True)},
cf AS (SELECT * REPLACE (replace(path, chr(92), '/') AS path) FROM cf0),
cs AS {_newest('symbols', 'repository_id file_id parent_symbol_id', 'name type start_line end_line signature', True)},
cl AS {_newest('relationships', 'repository_id source_symbol_id target_symbol_id', 'type', False)},
cc0 AS (SELECT {_ID.format('id')} AS id, arg_max(struct_pack(repository_id := {_ID.format('repository_id')},
    file_id := {_ID.format('file_id')}, symbol_id := {_ID.format('symbol_id')}, start_line := start_line, end_line := end_line,
    content := content, dims := coalesce(len(embedding), -1)), ingested_at) AS v FROM code_chunks GROUP BY 1),
cc AS (SELECT id, v.repository_id AS repository_id, v.file_id AS file_id, v.symbol_id AS symbol_id, v.start_line AS start_line,
    v.end_line AS end_line, v.content AS content, v.dims AS dims FROM cc0),
gs AS (SELECT cs.*, cf.path AS file_path, p.name AS parent_name FROM cs
    JOIN cf ON cf.id = cs.file_id AND cf.repository_id = cs.repository_id
    LEFT JOIN cs p ON p.id = cs.parent_symbol_id AND p.repository_id = cs.repository_id),
ce AS (SELECT min(cl.id) AS id, cl.repository_id, cl.source_symbol_id, cl.target_symbol_id, cl.type FROM cl
    JOIN gs s ON s.id = cl.source_symbol_id AND s.repository_id = cl.repository_id
    JOIN gs t ON t.id = cl.target_symbol_id AND t.repository_id = cl.repository_id GROUP BY ALL)
"""
