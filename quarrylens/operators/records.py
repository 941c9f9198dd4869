"""Rules by which delivered rows become records.

Ids are compared as UUIDs: case and surrounding white space do not count.
A row delivered again is the same record: it arrived at its earliest
`ingested_at`, and its version with the latest `ingested_at` holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: SQL (Spark and DuckDB) for the canonical form of an id.
ID_SQL = "lower(regexp_replace({0}, '^[ \\t\\r\\n]+|[ \\t\\r\\n]+$', '', 'g'))"


def canonical_id(column: str | Column) -> Column:
    """Lower-case id without surrounding white space; null stays null, '' stays ''."""
    col = F.col(column) if isinstance(column, str) else column
    return F.lower(F.regexp_replace(col, r"^[ \t\r\n]+|[ \t\r\n]+$", ""))


def latest_versions(df: DataFrame, fields: list[str], key: str = "id", at: str = "ingested_at") -> DataFrame:
    """One row per record: key, `fields` of the newest version, `arrived_at` (earliest delivery).

    Aggregation is partial on the map side. Rows without a key are no records and
    vanish; a null delivery time sorts before every other. Equal newest times are
    settled by the greatest field values, so the result does not depend on order.
    """
    version = F.struct(F.coalesce(F.col(at), F.lit("0001-01-01").cast("timestamp_ntz")).alias("_at"), *fields)
    return (
        df.filter(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.max(version).alias("_v"), F.min(at).alias("arrived_at"))
        .select(key, "arrived_at", *[F.col(f"_v.{f}").alias(f) for f in fields])
    )
