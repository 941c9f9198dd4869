"""Mixing sources to target weights.

The total size is the largest for which no source must be repeated more often than
allowed. Each source's documents, in hash order and pass after pass, form a stream
that is cut into blocks. The blocks are interleaved by Pfair scheduling: the j-th
block of a source with weight w may run from slot floor((j-1)/w) and must end by
slot ceil(j/w); the earliest deadline runs first, so that at every point each source
is less than one block off its share.
"""

from __future__ import annotations

import heapq
from fractions import Fraction

from pyspark.sql import DataFrame, Window as W, functions as F

from quarrylens.llm.tokens import token_counts
from quarrylens.session import cut_lineage

#: Tokens of a block, unless that makes more than MAX_SLOTS blocks (the schedule is made on the driver).
BLOCK_TOKENS = 16_384
MAX_SLOTS = 100_000
#: Documents of one source in one prefix-sum bucket, about.
BUCKET_DOCS = 50_000


def pfair_schedule(blocks: dict[str, int]) -> list[tuple[str, int]]:
    """(source, block number) of every slot, for sources with these numbers of blocks."""
    total = sum(blocks.values())
    weights = {s: Fraction(n, total) for s, n in blocks.items() if n}
    waiting: list[tuple[int, str, int]] = []
    for source in sorted(weights):
        heapq.heappush(waiting, (0, source, 1))
    ready: list[tuple[int, str, int]] = []
    out = []
    for slot in range(total):
        while waiting and waiting[0][0] <= slot:
            _, source, j = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-j * weights[source].denominator // weights[source].numerator), source, j))
        _, source, j = heapq.heappop(ready)
        out.append((source, j - 1))
        if j < blocks[source]:
            heapq.heappush(waiting, (j * weights[source].denominator // weights[source].numerator, source, j + 1))
    return out


def _positions(docs: DataFrame, n_docs: int) -> DataFrame:
    """Adds `start`, the tokens of the same source before each document, in hash order.

    Two prefix sums, inside hash ranges and over their totals, so no task holds a whole source.
    """
    buckets = max(64, -(-n_docs // BUCKET_DOCS))
    width = (1 << 62) // buckets + 1
    ranked = docs.withColumn("_h", F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(5)), 2)).withColumn(
        "_b", F.floor(F.col("_h") / F.lit(width)).cast("long"))
    totals = ranked.groupBy("source", "_b").agg(F.sum("n_tokens").alias("_t"))
    bases = totals.select(
        "source", "_b", (F.sum("_t").over(W.partitionBy("source").orderBy("_b")) - F.col("_t")).alias("_base"))
    inside = F.sum("n_tokens").over(W.partitionBy("source", "_b").orderBy("_h", "doc_id", "_copy")
                                    .rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("n_tokens")
    return ranked.withColumn("_inside", inside).join(bases, ["source", "_b"]).select(
        "doc_id", "source", "n_tokens", (F.col("_base") + F.col("_inside")).alias("start"))


def mix(documents: DataFrame, targets: DataFrame, block_tokens: int = BLOCK_TOKENS, max_slots: int = MAX_SLOTS,
        vocabulary: str | None = None) -> DataFrame:
    """slot, source, block, doc_id, repeat (from 1), n_tokens, start: the selected documents in mixed order.

    Read it ordered by slot, then start. Sources without a target, with a share or a
    number of repeats of zero or null, or without tokens, are left out, and the other shares are
    scaled to sum to 1. Documents without tokens are left out. A document is taken
    if its middle lies inside its source's budget, so a source misses its budget by at most half a document.
    """
    spark = documents.sparkSession
    copies = F.monotonically_increasing_id()
    counted = cut_lineage(
        token_counts(documents.select("doc_id", "text", "source"), keep=("source",), vocabulary=vocabulary)
        .filter("n_tokens > 0 AND source IS NOT NULL").withColumn("_copy", copies))
    wanted = {
        r["source"]: (r["share"], r["repeats"])
        for r in targets.filter("source IS NOT NULL AND target_share > 0 AND max_repeats > 0")
        .groupBy("source").agg(F.max("target_share").alias("share"), F.max("max_repeats").alias("repeats")).collect()
    }
    have = {r["source"]: (r["t"], r["n"]) for r in counted.join(
        F.broadcast(spark.createDataFrame([(s,) for s in wanted] or [("",)], "source string")), "source")
        .groupBy("source").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("n")).collect()}
    schema = "slot long, source string, block long, doc_id long, repeat int, n_tokens long, start long"
    wanted = {s: v for s, v in wanted.items() if s in have}
    if not wanted:
        return spark.createDataFrame([], schema)
    share_sum = sum(share for share, _ in wanted.values())
    total = min(have[s][0] * repeats / (share / share_sum) for s, (share, repeats) in wanted.items())
    block = max(block_tokens, int(-(-total // max_slots)))
    budget = {s: total * share / share_sum for s, (share, _) in wanted.items()}
    blocks = {s: max(1, int(-(-b // block))) for s, b in budget.items()}
    slots = spark.createDataFrame([(s, b, i) for i, (s, b) in enumerate(pfair_schedule(blocks))], "source string, block long, slot long")
    plan = F.broadcast(spark.createDataFrame(
        [(s, have[s][0], float(budget[s]), int(wanted[s][1]), blocks[s]) for s in wanted],
        "source string, available long, budget double, max_repeats int, n_blocks long"))
    placed = _positions(counted, sum(n for _, n in have.values())).join(plan, "source")
    # no more passes are made than reach into the budget; the test of the middle decides on the last one
    reach = F.floor((F.col("budget") - F.col("n_tokens") / 2 - F.col("start")) / F.col("available")) + 1
    last = F.least(F.col("max_repeats") - 1, reach).cast("int")
    repeated = placed.withColumn("last", last).filter("last >= 0").withColumn("pass", F.explode(F.sequence(F.lit(0), F.col("last")))).withColumn("at", F.col("pass") * F.col("available") + F.col("start")).filter(
        F.col("at") + F.col("n_tokens") / 2 <= F.col("budget"))
    numbered = repeated.withColumn("block", F.least(F.floor(F.col("at") / F.lit(block)).cast("long"), F.col("n_blocks") - 1))
    return numbered.join(F.broadcast(slots), ["source", "block"]).select(
        "slot", "source", "block", "doc_id", (F.col("pass") + 1).alias("repeat"), "n_tokens", F.col("at").alias("start"))


def share_report(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """Target and actual share of each target source, with documents, tokens and the most repeats used."""
    got = mixed.groupBy("source").agg(
        F.sum("n_tokens").alias("n_tokens"), F.countDistinct("doc_id").alias("n_docs"), F.max("repeat").alias("repeats_used"))
    all_tokens = F.sum("n_tokens").over(W.partitionBy())
    return targets.select("source", "target_share", "max_repeats").join(got, "source", "left").select(
        "source", "target_share", "max_repeats", F.coalesce("n_docs", F.lit(0)).alias("n_docs"),
        F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"), F.coalesce("repeats_used", F.lit(0)).alias("repeats_used"),
        F.round(F.coalesce("n_tokens", F.lit(0)) / all_tokens, 6).alias("actual_share"))
