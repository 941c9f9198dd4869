"""A code model kept as parquet, one partition per repository.

Replacing a repository's rows rewrites its partition only (dynamic overwrite); what is
read from a table is checkpointed before the same table is written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from quarrylens.functions.text import embedding_text
from quarrylens.session import cut_lineage

# Table schemas; every table but repositories is partitioned by repository_id.
SCHEMAS = {
    "repositories": "id string, name string, url string, branch string, commit_hash string, created_at timestamp_ntz, indexed_at timestamp_ntz, "
                    "owner_user_id string, demo_session_id string",
    "files": "id string, path string, language string, size long, hash string, repository_id string",
    "symbols": "id string, file_id string, name string, type string, start_line int, end_line int, parent_symbol_id string, signature string, repository_id string",
    "relationships": "id string, source_symbol_id string, target_symbol_id string, type string, repository_id string",
    "code_chunks": "id string, file_id string, symbol_id string, start_line int, end_line int, content string, embedding array<float>, repository_id string",
}


class InvalidRows(ValueError):
    """Rows that break the model; nothing was written."""


def stable_id(*columns: str) -> Column:
    return F.sha2(F.concat_ws("\0", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), 256)


class Store:
    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = spark
        self.folder = folder.rstrip("/")

    def path(self, table: str) -> str:
        return f"{self.folder}/{table}.parquet"

    def _versions(self, table: str) -> list[str]:
        """Complete versions of a table that is replaced as a whole, oldest first."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(table))
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(path) if s.isDirectory()]
        done = [n for n in names if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path(table)}/{n}/_SUCCESS"))]
        return sorted(n for n in done if n.startswith("v"))

    def read(self, table: str) -> DataFrame:
        path = self.path(table)
        if table == "repositories":
            versions = self._versions(table)
            if not versions:
                return self.spark.createDataFrame([], SCHEMAS[table])
            path = f"{path}/{versions[-1]}"
        try:
            return self.spark.read.schema(SCHEMAS[table]).parquet(path)
        except Exception as error:  # the table has not been written yet
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return self.spark.createDataFrame([], SCHEMAS[table])

    def _write(self, table: str, rows: DataFrame) -> None:
        names = [c.split()[0] for c in SCHEMAS[table].split(", ")]
        out = rows.select(*names)
        if table == "repositories":
            # a whole new version beside the old one, which goes when the new one is complete
            versions = self._versions(table)
            number = int(versions[-1][1:]) + 1 if versions else 1
            cut_lineage(out).write.parquet(f"{self.path(table)}/v{number:012d}")
            for old in versions:
                path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path(table)}/{old}")
                path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        else:
            cut_lineage(out).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("repository_id").parquet(self.path(table))

    def _clear(self, table: str, repository_id: str) -> None:
        """Remove a repository's partition folder through the file system of the path."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path(table)}/repository_id={repository_id}")
        path.getFileSystem(conf).delete(path, True)

    def get_or_create_repository(self, name: str, url: str | None, now: str, owner: str | None = None) -> str:
        """Id of the newest repository with this name, URL and owner; a new row if there is none."""
        same = self.read("repositories").filter(
            (F.col("name") == name) & F.col("url").eqNullSafe(F.lit(url)) & F.col("owner_user_id").eqNullSafe(F.lit(owner)))
        found = same.orderBy(F.desc("created_at"), "id").select("id").first()
        if found:
            return found["id"]
        fresh = self.spark.range(1).select(
            F.sha2(F.lit("\0".join([name, url or "", owner or "", now])), 256).alias("id"), F.lit(name).alias("name"), F.lit(url).cast("string").alias("url"),
            F.lit(None).cast("string").alias("branch"), F.lit(None).cast("string").alias("commit_hash"), F.lit(now).cast("timestamp_ntz").alias("created_at"),
            F.lit(None).cast("timestamp_ntz").alias("indexed_at"), F.lit(owner).cast("string").alias("owner_user_id"), F.lit(None).cast("string").alias("demo_session_id"))
        self._write("repositories", self.read("repositories").unionByName(fresh))
        return fresh.first()["id"]

    def mark_indexed(self, repository_id: str, now: str) -> None:
        rows = self.read("repositories").withColumn("indexed_at", F.when(F.col("id") == repository_id, F.lit(now).cast("timestamp_ntz")).otherwise(F.col("indexed_at")))
        self._write("repositories", rows)

    def save_files(self, files: DataFrame) -> None:
        """Upsert by repository and path (repository_id, path, language, size): ids and hashes of known files stay, others keep their rows."""
        new = files.select("repository_id", "path", "language", "size").groupBy("repository_id", "path").agg(
            F.max(F.struct("language", "size")).alias("v")).select("repository_id", "path", "v.*")
        touched = new.select("repository_id").distinct()
        old = self.read("files").join(touched, "repository_id", "left_semi")
        merged = old.withColumnRenamed("language", "l0").withColumnRenamed("size", "s0").join(new.withColumn("is_new", F.lit(True)), ["repository_id", "path"], "full")
        taken = F.col("is_new").isNotNull()
        self._write("files", merged.select(
            F.coalesce("id", stable_id("repository_id", "path")).alias("id"), "path", F.when(taken, F.col("language")).otherwise(F.col("l0")).alias("language"),
            F.when(taken, F.col("size")).otherwise(F.col("s0")).alias("size"), "hash", "repository_id"))

    def replace_symbols(self, repository_id: str, symbols: DataFrame) -> int:
        return self._replace("symbols", repository_id, symbols)

    def replace_relationships(self, repository_id: str, edges: DataFrame) -> int:
        """Distinct edges by source, target and type replace the repository's; returns their number."""
        rows = edges.select("source_symbol_id", "target_symbol_id", "type").distinct().withColumn("repository_id", F.lit(repository_id))
        return self._replace("relationships", repository_id, rows.withColumn("id", stable_id("repository_id", "source_symbol_id", "target_symbol_id", "type")))

    def replace_chunks(self, repository_id: str, chunks: DataFrame) -> int:
        """Distinct chunks replace the repository's, vectors included; rows with missing or foreign files or symbols are refused."""
        first = W.partitionBy("file_id", "start_line", "end_line", "content").orderBy(F.col("symbol_id").asc_nulls_last())
        rows = cut_lineage(chunks.select("file_id", "symbol_id", "start_line", "end_line", "content").withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n"))
        bad_lines = (F.col("start_line") < 1) | (F.col("end_line") < F.col("start_line")) | (F.length(F.trim("content")) == 0)
        f = self.read("files").filter(F.col("repository_id") == repository_id).select(F.col("id").alias("file_id"), F.lit(True).alias("has_file"))
        s = self.read("symbols").filter(F.col("repository_id") == repository_id).select(F.col("id").alias("symbol_id"), F.lit(True).alias("has_symbol"))
        wrong = rows.join(f, "file_id", "left").join(s, "symbol_id", "left").filter(
            F.coalesce(bad_lines, F.lit(True)) | F.col("has_file").isNull() | (F.col("symbol_id").isNotNull() & F.col("has_symbol").isNull())).count()
        if wrong:
            raise InvalidRows(f"{wrong} chunks with wrong lines, files or symbols")
        full = rows.withColumn("repository_id", F.lit(repository_id)).withColumn("embedding", F.lit(None).cast("array<float>"))
        return self._replace("code_chunks", repository_id, full.withColumn("id", stable_id("repository_id", "file_id", "start_line", "end_line", "content")))

    def _replace(self, table: str, repository_id: str, rows: DataFrame) -> int:
        kept = cut_lineage(rows.filter(F.col("repository_id") == repository_id))
        n = kept.count()
        if n:
            self._write(table, kept)
        else:
            self._clear(table, repository_id)
        return n

    def save_embeddings(self, repository_id: str, vectors: DataFrame, dimension: int = 384) -> int:
        """Set the vectors (id, embedding) of chunks of this repository that have none; returns how many were set."""
        v = F.col("embedding")
        valid = (F.size(v) == dimension) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
        if not vectors.filter(~F.coalesce(valid, F.lit(False))).isEmpty():
            raise InvalidRows(f"an embedding needs {dimension} finite numbers that are not all zero")
        rows = cut_lineage(self.read("code_chunks").filter(F.col("repository_id") == repository_id))
        new = vectors.groupBy("id").agg(F.max(v.cast("array<float>")).alias("fresh"))
        joined = cut_lineage(rows.join(new, "id", "left"))
        n = joined.filter("embedding IS NULL AND fresh IS NOT NULL").count()
        if n:
            self._write("code_chunks", joined.withColumn("embedding", F.coalesce("embedding", "fresh")).drop("fresh"))
        return n

    def missing_texts(self, repository_id: str) -> DataFrame:
        """id, text (header, blank line, content) of the chunks of a repository that have no vector."""
        chunks = self.read("code_chunks").filter((F.col("repository_id") == repository_id) & F.col("embedding").isNull())
        paths = self.read("files").filter(F.col("repository_id") == repository_id).select(F.col("id").alias("file_id"), "path")
        names = self.read("symbols").filter(F.col("repository_id") == repository_id).select(F.col("id").alias("symbol_id"), "name", "type")
        return chunks.join(paths, "file_id", "left").join(names, "symbol_id", "left").select(
            "id", embedding_text(F.col("path"), F.col("name"), F.col("type"), F.col("start_line"), F.col("end_line"), F.col("content")).alias("text"))

    def generate_missing(self, repository_id: str, provider, batch: int = 64) -> dict:
        """Embed chunks without a vector, batch by batch: processed, created, failed, and the first failures by chunk id.

        A task stops asking at its first failing batch, so that a service that is down is
        not asked for every chunk; what it did not reach keeps no vector and counts neither
        as processed nor as failed. Messages are those of the provider.
        """
        def embed(frames):
            import pandas as pd

            from quarrylens.functions.text import check_embedding

            failed = False
            for frame in frames:
                for at in range(0, len(frame), batch):
                    if failed:
                        continue
                    part = frame.iloc[at:at + batch]
                    try:
                        vectors = [check_embedding(v) for v in provider.embed(part["text"].tolist(), "document")]
                        if len(vectors) != len(part):
                            raise ValueError("another number of vectors than asked for")
                        yield pd.DataFrame({"id": part["id"], "embedding": vectors, "error": None})
                    except Exception as error:  # whatever a provider raises is reported by chunk
                        failed = True
                        yield pd.DataFrame({"id": part["id"], "embedding": None, "error": str(error) or type(error).__name__})

        made = cut_lineage(self.missing_texts(repository_id).mapInPandas(embed, "id string, embedding array<float>, error string"))
        total = made.count()
        created = self.save_embeddings(repository_id, made.filter("embedding IS NOT NULL").select("id", "embedding"))
        failures = made.filter("error IS NOT NULL")
        return {"processed": total, "created": created, "failed": failures.count(),
                "failures": [(r["id"], r["error"]) for r in failures.select("id", "error").orderBy("id").limit(100).collect()]}

    def clear_embeddings(self, repository_id: str) -> int:
        rows = cut_lineage(self.read("code_chunks").filter(F.col("repository_id") == repository_id))
        n = rows.filter("embedding IS NOT NULL").count()
        if n:
            self._write("code_chunks", rows.withColumn("embedding", F.lit(None).cast("array<float>")))
        return n

    def delete_repository(self, repository_id: str) -> None:
        """Remove a repository and everything of it."""
        for table in ("files", "symbols", "relationships", "code_chunks"):
            self._clear(table, repository_id)
        self._write("repositories", self.read("repositories").filter(F.col("id") != repository_id))

    def table_sizes(self, repository_id: str) -> dict[str, int]:
        return {t: self.read(t).filter(F.col("repository_id") == repository_id).count() for t in SCHEMAS if t != "repositories"}
