"""Registered queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quarrylens.llm.broken_files import broken_rates, check_syntax
from quarrylens.llm.credentials import scan_chunks
from quarrylens.llm.files import file_contents
from quarrylens.llm.handmade import classify_files
from quarrylens.llm.languages import document_languages, identify, label_cases
from quarrylens.llm.mixing import mix, share_report
from quarrylens.llm.packing import fill_report, pack
from quarrylens.llm.splitting import split_chunks
from quarrylens.llm.vectors import similar_edges, similar_pairs
from quarrylens.session import load


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    found = scan_chunks(load(spark, d, "code_chunks"), with_text=False)
    return found.select(F.col("id").alias("chunk_id"), F.explode("lines").alias("line_no")).distinct()


def p1_redacted(spark: SparkSession, d: str) -> DataFrame:
    found = scan_chunks(load(spark, d, "code_chunks"))
    return found.filter(F.size("lines") > 0).select(
        F.col("id").alias("chunk_id"), F.size("lines").alias("n_found"), F.array_join("kinds", ",").alias("kinds"),
        F.col("redacted").alias("content"))


def _contents(spark: SparkSession, d: str) -> DataFrame:
    return file_contents(load(spark, d, "files"), load(spark, d, "file_texts"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return check_syntax(_contents(spark, d)).filter(F.col("error").isNotNull()).select("file_id").distinct()


def p2_rates(spark: SparkSession, d: str) -> DataFrame:
    return broken_rates(check_syntax(_contents(spark, d)))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return classify_files(_contents(spark, d)).filter(F.col("kind").isNotNull()).select("file_id")


def p5_kinds(spark: SparkSession, d: str) -> DataFrame:
    kinds = classify_files(_contents(spark, d))
    return kinds.groupBy(F.coalesce("kind", F.lit("hand-written")).alias("kind")).agg(F.count("*").alias("n_files"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return split_chunks(load(spark, d, "code_chunks"), with_text=False).select("chunk_id").distinct()


def p6_pieces(spark: SparkSession, d: str) -> DataFrame:
    return split_chunks(load(spark, d, "code_chunks"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return similar_edges(load(spark, d, "code_chunks")).select(F.col("a").alias("chunk_id_a"), F.col("b").alias("chunk_id_b"))


def p7_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return similar_pairs(load(spark, d, "code_chunks")).select(
        F.col("id").alias("chunk_id"), F.col("other").alias("neighbour_id"), "similarity")


def p8_packed(spark: SparkSession, d: str) -> DataFrame:
    return pack(load(spark, d, "documents"))


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    return fill_report(pack(load(spark, d, "documents")))


def p9_mixed(spark: SparkSession, d: str) -> DataFrame:
    return mix(load(spark, d, "documents"), load(spark, d, "source_targets"))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    targets = load(spark, d, "source_targets")
    return share_report(mix(load(spark, d, "documents"), targets), targets)


def _identified(spark: SparkSession, d: str) -> DataFrame:
    return identify(load(spark, d, "documents"), load(spark, d, "language_names"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return label_cases(_identified(spark, d))


def p10_languages(spark: SparkSession, d: str) -> DataFrame:
    return document_languages(_identified(spark, d))


def p10_passages(spark: SparkSession, d: str) -> DataFrame:
    """The passages of documents that mix languages."""
    mixed = F.size(F.array_distinct(F.transform("passages", lambda p: p["lang"]))) > 1
    return _identified(spark, d).filter(mixed).select("doc_id", F.posexplode("passages").alias("passage_no", "p")).select(
        "doc_id", "passage_no", "p.start_char", "p.end_char", "p.lang", F.round("p.confidence", 6).alias("confidence"))


QUERIES = {
    "p1_found": p1_found, "p1_redacted": p1_redacted,
    "p2_found": p2_found, "p2_rates": p2_rates,
    "p5_found": p5_found, "p5_kinds": p5_kinds,
    "p6_found": p6_found, "p6_pieces": p6_pieces,
    "p7_found": p7_found, "p7_neighbours": p7_neighbours,
    "p8_packed": p8_packed, "p8_fill": p8_fill,
    "p9_mixed": p9_mixed, "p9_shares": p9_shares,
    "p10_found": p10_found, "p10_languages": p10_languages, "p10_passages": p10_passages,
}

_CHUNK_ID = "lower(trim(id, e' \\t\\r\\n'))"

ORACLE: dict[str, str] = {
    "p6_found": f"""
WITH c AS (SELECT {_CHUNK_ID} AS chunk_id, arg_max(coalesce(content, ''), ingested_at) AS content FROM code_chunks GROUP BY 1)
SELECT chunk_id FROM c
WHERE length(content) > 12000
   OR length(content) - length(replace(content, chr(10), '')) + CASE WHEN content LIKE '%' || chr(10) THEN 0 ELSE 1 END > 180""",
}
