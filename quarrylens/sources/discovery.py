"""Source files of a folder tree."""

from __future__ import annotations

import os
import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from quarrylens.functions.text import stored_language

# Endings of source files, and folders that hold none of a repository's own.
EXTENSIONS = (".java", ".js", ".jsx", ".ts", ".tsx")
SKIPPED = (".git", "node_modules", "target", "dist", "build")


class TooLarge(ValueError):
    """The tree exceeds a limit."""


@dataclass(frozen=True)
class Limits:
    """What a tree may hold at most; None is no limit. `follow_links` is off for trees nobody vouches for."""

    files: int | None = None
    bytes: int | None = None
    file_bytes: int | None = None
    entries: int | None = None
    seconds: float | None = None
    follow_links: bool = True


def _entries(spark: SparkSession, folder: str):
    """(name, path, is folder, size, is link) of a folder's entries; local folders are listed without the JVM."""
    if "://" not in folder and not folder.startswith("file:"):
        with os.scandir(folder) as found:
            for e in found:
                yield e.name, e.path, e.is_dir(), 0 if e.is_dir() else e.stat().st_size, e.is_symlink()
        return
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    listed = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatusIterator(path)
    while listed.hasNext():
        e = listed.next()
        yield e.getPath().getName(), e.getPath().toString(), e.isDirectory(), e.getLen(), e.isSymlink()


def source_folders(spark: SparkSession, root: str, limits: Limits) -> list[str]:
    """Folders that hold source files, skipped ones never listed; raises TooLarge as soon as a limit is passed.

    Only names and sizes are looked at here, no file is read.
    """
    until = None if limits.seconds is None else time.monotonic() + limits.seconds
    entries = files = size = 0
    folders, todo = [], [root.rstrip("/") or "/"]
    while todo:
        folder, own = todo.pop(), False
        for name, path, is_folder, length, is_link in _entries(spark, folder):
            entries += 1
            if limits.entries is not None and entries > limits.entries:
                raise TooLarge(f"more than {limits.entries} entries")
            if until is not None and time.monotonic() > until:
                raise TooLarge(f"listing took more than {limits.seconds} s")
            if is_link and not limits.follow_links:
                continue
            if is_folder:
                if name not in SKIPPED:
                    todo.append(path)
                continue
            if os.path.splitext(name)[1].lower() not in EXTENSIONS:
                continue
            own, files, size = True, files + 1, size + length
            if limits.file_bytes is not None and length > limits.file_bytes:
                raise TooLarge(f"a file of {length} bytes")
            if limits.files is not None and files > limits.files or limits.bytes is not None and size > limits.bytes:
                raise TooLarge(f"{files} files of {size} bytes and more")
        if own:
            folders.append(folder)
    return sorted(folders)


def discover(spark: SparkSession, root: str, max_files: int | None = None, max_bytes: int | None = None, limits: Limits | None = None) -> DataFrame:
    """path (below root), language, size, content, is_valid_utf8 of every source file outside the skipped folders.

    Folders are listed first, skipped ones not at all; then only source files are read.
    Bytes that are no UTF-8 become U+FFFD. Limits are checked before anything is read.
    """
    limits = limits or Limits(files=max_files, bytes=max_bytes)
    folders = source_folders(spark, root, limits)
    if not folders:
        return spark.createDataFrame([], "path string, language string, size long, content string, is_valid_utf8 boolean")
    base = root.rstrip("/")
    anchor = base.split("://", 1)[-1] if "://" in base else base.removeprefix("file:")
    endings = "(?i)\\.(?:" + "|".join(e[1:] for e in EXTENSIONS) + ")$"
    files = spark.read.format("binaryFile").load(folders).filter(F.col("path").rlike(endings))
    below = F.substring(F.col("path"), F.instr("path", anchor.rstrip("/") + "/") + len(anchor.rstrip("/")) + 1, F.lit(1 << 30))
    if limits.follow_links is False:
        links = [os.path.join(f, e) for f in folders if "://" not in f and os.path.isdir(f) for e in os.listdir(f) if os.path.islink(os.path.join(f, e))]
        files = files.filter(~F.regexp_replace("path", "^file:/+", "/").isin(links)) if links else files
    text = F.col("content").cast("string")
    return files.select(below.alias("path"), F.col("length").alias("size"), F.make_valid_utf8(text).alias("content"), F.is_valid_utf8(text).alias("is_valid_utf8")).select(
        "path", stored_language(F.col("path")).alias("language"), "size", "content", "is_valid_utf8")
