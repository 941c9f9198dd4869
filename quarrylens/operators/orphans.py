"""References to records that do not exist.

References and parent keys are co-partitioned on the key and sorted, and the two
streams are merged once (a sort-merge join; AQE splits a partition in which one
parent attracts a large share of the references). Each parent key carries its
validity (repository, arrival, deletion), so the merge itself tells missing,
foreign, deleted and late parents apart.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from quarrylens.operators.records import canonical_id, latest_versions

REFERENCE_COLUMNS = ["ref_table", "record_id", "field_name", "ref_id", "repository_id", "arrived_at"]


def references(df: DataFrame, table: str, fields: dict[str, str]) -> DataFrame:
    """Non-null references of `table`, one row per record and field; `fields` maps field to parent table."""
    slim = df.select(
        canonical_id("id").alias("id"),
        canonical_id("repository_id").alias("repository_id"),
        "ingested_at",
        *[canonical_id(f).alias(f) for f in fields],
    )
    rows = latest_versions(slim, ["repository_id", *fields])
    pairs = F.array(*[
        F.struct(F.lit(f).alias("field_name"), F.lit(parent).alias("parent_table"), F.col(f).alias("ref_id"))
        for f, parent in fields.items()
    ])
    return (
        rows.select(F.lit(table).alias("ref_table"), F.col("id").alias("record_id"), "repository_id", "arrived_at",
                    F.inline(pairs))
        .filter(F.col("ref_id").isNotNull())
    )


def parent_keys(df: DataFrame, table: str) -> DataFrame:
    """Validity of each parent record: repository, arrival, and whether its newest version is deleted."""
    slim = df.select(
        canonical_id("id").alias("id"),
        canonical_id("repository_id").alias("repository_id"),
        F.col("deleted_at").isNotNull().alias("is_deleted"),
        "ingested_at",
    )
    return latest_versions(slim, ["repository_id", "is_deleted"]).select(
        F.lit(table).alias("parent_table"),
        F.col("id").alias("parent_id"),
        F.col("repository_id").alias("parent_repository_id"),
        F.col("arrived_at").alias("parent_arrived_at"),
        "is_deleted",
    )


def _reason() -> Column:
    return (
        F.when(F.col("parent_id").isNull(), "missing")
        .when(~F.coalesce(F.col("parent_repository_id") == F.col("repository_id"), F.lit(False)), "foreign")
        .when(F.col("is_deleted"), "deleted")
        .when(~F.coalesce(F.col("parent_arrived_at") <= F.col("arrived_at"), F.lit(False)), "late")
    )


def orphan_references(refs: list[DataFrame], parents: list[DataFrame]) -> DataFrame:
    """Every reference without a valid parent, with the reason.

    refs: frames of `references`; parents: frames of `parent_keys`.
    Columns: ref_table, record_id, field_name, ref_id, arrived_at, reason.
    Null references are no references; a blank one points nowhere and is 'missing'.
    A null repository or arrival on either side never counts as a match.
    Empty inputs give an empty result; extra input columns are ignored.
    """
    left = reduce(DataFrame.unionByName, refs)
    right = reduce(DataFrame.unionByName, parents).hint("merge")
    right = right.withColumnRenamed("parent_table", "_of")
    joined = left.join(right, (F.col("ref_id") == F.col("parent_id")) & (F.col("parent_table") == F.col("_of")), "left")
    return (
        joined.select("ref_table", "record_id", "field_name", "ref_id", "arrived_at", _reason().alias("reason"))
        .filter(F.col("reason").isNotNull())
    )


def code_orphans(relationships: DataFrame, code_chunks: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """Orphan references of edges and chunks of the code model."""
    return orphan_references(
        [
            references(relationships, "relationships",
                       {"source_symbol_id": "symbols", "target_symbol_id": "symbols"}),
            references(code_chunks, "code_chunks", {"symbol_id": "symbols", "file_id": "files"}),
        ],
        [parent_keys(symbols, "symbols"), parent_keys(files, "files")],
    )


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Orphans counted per table, field, month of arrival and reason."""
    return orphans.groupBy(
        "ref_table", "field_name", F.date_format("arrived_at", "yyyy-MM").alias("month"), "reason"
    ).agg(F.count("*").alias("n_orphans"))
