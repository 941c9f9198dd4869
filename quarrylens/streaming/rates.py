"""The request limits as continuous queries."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quarrylens.operators.rates import anchored_step
from quarrylens.session import ensure_checkpoint_dir


def event_stream(spark: SparkSession, folder: str, name: str = "events.parquet") -> DataFrame:
    """Events arriving as parquet files in a folder; `ts` as an instant."""
    schema = spark.read.parquet(f"{folder}/{name}").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def window_counts(stream: DataFrame, keys: list[str], window: str, delay: str) -> DataFrame:
    """Requests per key and aligned window; a window is final `delay` after its end, later events are dropped."""
    return stream.withWatermark("ts", delay).groupBy(F.window("ts", window).alias("w"), *keys).agg(F.count("*").alias("n_requests")).select(
        *keys, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n_requests")


def anchored_limits(stream: DataFrame, key: str, window_seconds: int, limit: int, event_id: str = "event_id") -> DataFrame:
    """event_id, key, rejected; the state of a key (window end, accepted) expires with its window."""
    width = window_seconds * 1_000_000

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches), ignore_index=True).sort_values(["us", event_id], kind="stable")
        held = tuple(state.get) if state.exists else None
        out = []
        for us in rows["us"]:
            held, rejected = anchored_step(held, int(us), width, limit)
            out.append(rejected)
        state.update(held)
        state.setTimeoutTimestamp(max(held[0] // 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({event_id: rows[event_id], "key": str(k[0]), "rejected": out})

    slim = stream.withWatermark("ts", "0 seconds").select(event_id, F.col(key).cast("string").alias("key"), "ts", F.unix_micros("ts").alias("us"))
    kind = dict(slim.dtypes)[event_id]
    return slim.groupBy("key").applyInPandasWithState(
        step, f"{event_id} {kind}, key string, rejected boolean", "window_end long, accepted long", "append", GroupStateTimeout.EventTimeTimeout)


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there, write it to the shared folder, and read it back."""
    spark = stream.sparkSession
    ensure_checkpoint_dir(spark)
    base = spark.sparkContext.getCheckpointDir()
    home = f"{base}/stream-{uuid.uuid4().hex}"
    query = (stream.writeStream.outputMode(mode).format("parquet").option("path", f"{home}/out").option("checkpointLocation", f"{home}/state")
             .trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{home}/out")
