"""The texts of files with what the file records say about them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quarrylens.operators.records import canonical_id, latest_versions


def file_contents(files: DataFrame, file_texts: DataFrame, parts: int | None = None) -> DataFrame:
    """file_id, repository_id, path, language, size, content: newest file record joined to its text.

    Both sides are hashed on the file id into a fixed number of partitions, so that
    costly work per text that follows is spread evenly and not packed by bytes.
    Files without a text and texts without a file record are left out; null
    contents become ''. A text delivered under several spellings of one id is kept
    once per spelling. Columns other than the named ones are ignored.
    """
    parts = parts or 2 * int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slim = files.select(canonical_id("id").alias("id"), canonical_id("repository_id").alias("repository_id"),
                        "path", "language", "size", "ingested_at")
    records = latest_versions(slim, ["repository_id", "path", "language", "size"]).withColumnRenamed("id", "file_id")
    texts = file_texts.select(canonical_id("file_id").alias("file_id"), F.coalesce("content", F.lit("")).alias("content"))
    return (
        texts.filter(F.col("file_id").isNotNull()).repartition(parts, "file_id")
        .join(records.drop("arrived_at").repartition(parts, "file_id"), "file_id")
        .select("file_id", "repository_id", "path", "language", "size", "content")
    )


def spread(df: DataFrame, key: str) -> DataFrame:
    """The frame as it is read, or hashed on `key` where the scan has fewer tasks than the cluster has cores.

    Work per row that is much costlier than moving the row should not wait for a few
    large row groups. Only the number of tasks depends on this, no result does.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df._jdf.queryExecution().toRdd().getNumPartitions() >= cores:
        return df
    return df.repartition(2 * cores, key)
