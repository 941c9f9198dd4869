"""Request limits over event time: aligned windows and windows anchored at the first request."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

#: Parts of a window that are counted apart, so that no task holds a hot key's whole window.
SLICES = 64


def aligned_windows(events: DataFrame, keys: list[str], window_seconds: int, limit: int, at: str = "ts", event_id: str = "event_id") -> DataFrame:
    """Each event with its window's start, its number in the window, rejected or not, and seconds to the window's end.

    Windows are aligned to the epoch. Rejected requests count. Equal times are
    ordered by the event id. Events without a time are left out; null keys form
    a group of their own.
    """
    if window_seconds < 1 or limit < 0:
        raise ValueError("window and limit must be positive")
    seconds = F.unix_micros(F.col(at).cast("timestamp"))
    width = window_seconds * 1_000_000
    rows = events.filter(F.col(at).isNotNull()).select(event_id, *keys, at, seconds.alias("_us")).withColumn(
        "_w", F.floor(F.col("_us") / F.lit(width)).cast("long")).withColumn(
        "_s", F.floor((F.col("_us") - F.col("_w") * width) * SLICES / width).cast("int"))
    totals = rows.groupBy(*keys, "_w", "_s").agg(F.count("*").alias("_n"))
    bases = totals.withColumn("_base", F.sum("_n").over(W.partitionBy(*keys, "_w").orderBy("_s")) - F.col("_n"))
    inside = F.row_number().over(W.partitionBy(*keys, "_w", "_s").orderBy("_us", event_id))
    numbered = rows.withColumn("_i", inside)
    same = [numbered[c].eqNullSafe(bases[c]) for c in [*keys, "_w", "_s"]]
    count = bases["_base"] + F.col("_i")
    end = (numbered["_w"] + 1) * width
    return numbered.join(bases, same).select(
        numbered[event_id], *[numbered[k] for k in keys], numbered[at],
        F.timestamp_micros(numbered["_w"] * width).cast("timestamp_ntz").alias("window_start"), count.cast("long").alias("request_no"),
        (count > limit).alias("rejected"), F.greatest(F.ceil((end - numbered["_us"]) / 1_000_000), F.lit(1)).cast("long").alias("retry_after"))


def anchored_step(state: tuple[int, int] | None, now: int, width: int, limit: int) -> tuple[tuple[int, int], bool]:
    """((window end, accepted requests), rejected) after a request at `now`; rejected ones are not counted."""
    if state is None or state[0] <= now:
        return (now + width, 1), limit < 1
    end, used = state
    return ((end, used), True) if used >= limit else ((end, used + 1), False)


def anchored_windows(events: DataFrame, key: str, window_seconds: int, limit: int, at: str = "ts", event_id: str = "event_id") -> DataFrame:
    """event_id, key, rejected: at most `limit` accepted events in a window that opens with a key's first event.

    Each decision hangs on the one before, so a key's events pass one task in order
    of time and id; they are streamed and only the window is held. Events without a time are left out.
    """
    width = window_seconds * 1_000_000
    rows = events.filter(F.col(at).isNotNull()).select(
        event_id, F.col(key).cast("string").alias("key"), F.unix_micros(F.col(at).cast("timestamp")).alias("us"))
    kind = dict(rows.dtypes)[event_id]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = object(), None
        for batch in batches:
            out = []
            for k, us in zip(batch["key"], batch["us"]):
                if k != key:
                    key, state = k, None
                state, rejected = anchored_step(state, int(us), width, limit)
                out.append(rejected)
            yield pd.DataFrame({event_id: batch[event_id], "key": batch["key"], "rejected": out})

    return rows.repartition("key").sortWithinPartitions("key", "us", event_id).mapInPandas(run, f"{event_id} {kind}, key string, rejected boolean")
