"""Filling fixed-capacity containers with items of varying length.

A dynamic program over the histogram of all lengths chooses the bucket boundaries
with the least padding. Batches under the token budget are formed bucket by bucket,
longest first; what a batch of long items leaves over is topped up from the longest
shorter bucket whose bound still fits. The work is cut into shards of bounded size by
a hash, each of which packs on its own; a shard leaves at most a few containers
partly filled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from quarrylens.llm.tokens import token_counts
from quarrylens.session import cut_lineage

CAPACITY = 2048
BUCKETS = 24
#: Bounds of one shard: tokens (about 4,000 containers) and items.
SHARD_TOKENS = 8_000_000
SHARD_ITEMS = 200_000


def bucket_bounds(histogram: dict[int, int], buckets: int) -> list[int]:
    """Upper bounds of at most `buckets` length buckets with the least total padding, ascending.

    Every item is padded to its bucket's bound; the last bound is the largest length.
    """
    lengths = np.array(sorted(n for n, c in histogram.items() if c > 0), dtype=np.int64)
    if not len(lengths):
        return []
    counts = np.array([histogram[int(n)] for n in lengths], dtype=np.float64)
    c = np.concatenate([[0.0], np.cumsum(counts)])
    t = np.concatenate([[0.0], np.cumsum(counts * lengths)])
    n = len(lengths)
    k = min(buckets, n)
    best = np.full(n + 1, np.inf)
    best[0] = 0.0
    back = np.zeros((k + 1, n + 1), dtype=np.int64)
    for b in range(1, k + 1):
        now = np.full(n + 1, np.inf)
        for j in range(b, n + 1):
            # the last bucket holds lengths[i:j]
            i = np.arange(b - 1, j)
            cost = best[i] + (c[j] - c[i]) * lengths[j - 1] - (t[j] - t[i])
            at = int(cost.argmin())
            now[j], back[b, j] = cost[at], i[at]
        best = now
    bounds, j = [], n
    for b in range(k, 0, -1):
        bounds.append(int(lengths[j - 1]))
        j = int(back[b, j])
    return sorted(bounds)


def pack_items(lengths: list[int], bounds: list[int], capacity: int, top_up: bool = True) -> list[int]:
    """Container number of each item; no container holds more than `capacity`.

    Items of a bucket are taken in the order given. A container opened in a bucket
    takes items of that bucket while they fit, then, if `top_up`, items of the longest
    shorter bucket whose next one fits.
    """
    edges = np.array(bounds)
    queues: list[list[int]] = [[] for _ in bounds]
    for item, bucket in enumerate(np.searchsorted(edges, lengths).tolist()):
        queues[bucket].append(item)
    for q in queues:
        q.reverse()
    out = [0] * len(lengths)
    number = -1
    for bucket in range(len(bounds) - 1, -1, -1):
        while queues[bucket]:
            number += 1
            room, level = capacity, bucket
            while level >= 0:
                q = queues[level]
                if q and lengths[q[-1]] <= room:
                    item = q.pop()
                    out[item] = number
                    room -= lengths[item]
                elif top_up:
                    level -= 1
                else:
                    break
    return out


def container_pieces(counted: DataFrame, capacity: int) -> DataFrame:
    """doc_id, piece_no, token_start, n_tokens: whole items, and pieces of those over the capacity."""
    n = F.ceil(F.greatest(F.col("n_tokens"), F.lit(1)) / F.lit(capacity)).cast("long")
    parts = counted.select("doc_id", "n_tokens", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("piece_no"))
    return parts.select(
        "doc_id", F.col("piece_no").cast("int").alias("piece_no"), (F.col("piece_no") * capacity).alias("token_start"),
        F.least(F.lit(capacity).cast("long"), F.col("n_tokens") - F.col("piece_no") * capacity).alias("n_tokens"))


def pack(documents: DataFrame, capacity: int = CAPACITY, buckets: int = BUCKETS, vocabulary: str | None = None,
         shard_tokens: int = SHARD_TOKENS, top_up: bool = True) -> DataFrame:
    """doc_id, piece_no, token_start, n_tokens, container_id, container_tokens, fill of every piece.

    Every document is placed; one without tokens (empty or null text) takes a place of
    size 0. Documents with equal ids are separate items. An item is divided
    only if it exceeds the capacity, then into full containers and a rest. An empty
    input gives an empty result; columns other than doc_id and text are ignored.
    Without `top_up` every container holds items of one bucket only.
    """
    pieces = cut_lineage(container_pieces(token_counts(documents, vocabulary=vocabulary), capacity))
    histogram = {r["n_tokens"]: r["count"] for r in pieces.groupBy("n_tokens").count().collect()}  # at most capacity + 1 rows
    bounds = bucket_bounds(histogram, buckets)
    tokens, items = sum(n * c for n, c in histogram.items()), sum(histogram.values())
    shards = max(1, -(-tokens // shard_tokens), -(-items // SHARD_ITEMS))

    def fill(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["doc_id", "piece_no"], kind="stable", ignore_index=True)
        local = np.array(pack_items(group["n_tokens"].tolist(), bounds, capacity, top_up), dtype=np.int64)
        used = np.bincount(local, weights=group["n_tokens"].to_numpy(dtype=np.float64)).astype(np.int64)
        group["container_id"] = local * shards + int(key[0])
        group["container_tokens"] = used[local]
        group["fill"] = used[local] / capacity
        return group.drop(columns="shard")

    shard = F.pmod(F.xxhash64("doc_id", "piece_no"), F.lit(shards)).cast("int").alias("shard")
    return pieces.select("*", shard).groupBy("shard").applyInPandas(
        fill, "doc_id long, piece_no int, token_start long, n_tokens long, container_id long, container_tokens long, fill double")


def fill_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers, pieces, tokens, overall fill, and the share of containers filled to 95 %."""
    containers = packed.groupBy("container_id").agg(F.max("container_tokens").alias("used"), F.count("*").alias("n"))
    return containers.agg(
        F.count("*").alias("n_containers"), F.sum("n").alias("n_pieces"), F.sum("used").alias("n_tokens"),
        F.round(F.sum("used") / (F.count("*") * capacity), 6).alias("fill"),
        F.round(F.avg((F.col("used") >= 0.95 * capacity).cast("double")), 6).alias("share_filled_95"))
