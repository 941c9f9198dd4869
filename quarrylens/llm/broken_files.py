"""Source files that do not parse."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from quarrylens.llm.syntax.check import extension, syntax_error


def check_syntax(contents: DataFrame) -> DataFrame:
    """file_id, repository_id, extension, error of each file; error is null where a dialect accepts it.

    contents: frame of `files.file_contents`. Every text is parsed whole by the
    generalised LL recogniser with all dialect grammars of its extension. Blank
    texts and other extensions are never rejected; an empty input gives an empty
    result. The grammars are built once per Python worker.
    """

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({
                "file_id": batch["file_id"], "repository_id": batch["repository_id"],
                "extension": [extension(p) for p in batch["path"]],
                "error": [syntax_error(p, c) for p, c in zip(batch["path"], batch["content"])],
            })

    return contents.select("file_id", "repository_id", "path", "content").mapInPandas(
        check, "file_id string, repository_id string, extension string, error string")


def broken_rates(checked: DataFrame) -> DataFrame:
    """Files and broken files per repository and language (by extension)."""
    language = F.when(F.col("extension") == ".java", "java").when(
        F.col("extension").isin(".js", ".jsx"), "javascript").when(
        F.col("extension").isin(".ts", ".tsx"), "typescript").otherwise("other")
    return checked.groupBy("repository_id", language.alias("language")).agg(
        F.count("*").alias("n_files"), F.count("error").alias("n_broken"),
        F.round(F.count("error") / F.count("*"), 6).alias("broken_rate"))
