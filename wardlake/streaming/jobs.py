"""Streams with the same rows as the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import fleet
from ..operators.rules import detect
from .keyed import Anchored, keyed_stream
from .store import SightingStore


def stream_detections(ev: DataFrame, path: str, checkpoint: str):
    """Single-event rules over a stream, as JSON lines."""
    return detect(ev).writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def stream_sightings(ev: DataFrame, table: str, checkpoint: str, buckets: int = 64, compact_at: int = 8):
    """Prevalence kept up to date: each micro-batch adds its folded sightings as a delta; read them by SightingStore(spark, table, buckets).read().

    A batch that is run again writes the same delta again, so counts stay right; buckets with many deltas are compacted, the others stay as they are.
    """

    def merge(batch: DataFrame, number: int) -> None:
        store = SightingStore(batch.sparkSession, table, buckets)
        store.add(fleet.fold_sightings(fleet.observations(batch)), number)
        store.compact(compact_at)

    return ev.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_anchored(ev: DataFrame, keys: list[str], width: int, delay: str = "1 minute") -> DataFrame:
    """First rows of anchored windows over a stream: a key's rows within width of a kept one are dropped. Its state goes once no row can fall into the window any more."""
    return keyed_stream(ev, keys, Anchored(width), delay)


def stream_counts(ev: DataFrame, keys: list[str], window: str = "1 minute", delay: str = "1 minute") -> DataFrame:
    """Tumbling counts with late rows up to the delay."""
    return ev.withColumn("at", F.timestamp_micros("ts_us")).withWatermark("at", delay).groupBy(F.window("at", window), *keys).agg(F.count(F.lit(1)).alias("n"))


def stream_pairs(first: DataFrame, then: DataFrame, keys: list[str], seconds: int, delay: str = "1 minute") -> DataFrame:
    """Rows of then that follow a row of first with the same key within so many seconds: a stream-stream join."""
    a = first.select(*(F.col(k).alias(f"a_{k}") for k in keys), F.col("event_id").alias("first_id"), F.timestamp_micros("ts_us").alias("a_at")).withWatermark("a_at", delay)
    b = then.withColumn("at", F.timestamp_micros("ts_us")).withWatermark("at", delay)
    on = (F.col("at") >= F.col("a_at")) & (F.col("at") <= F.col("a_at") + F.expr(f"INTERVAL {seconds} SECONDS"))
    for k in keys:
        on = on & (F.col(k) == F.col(f"a_{k}"))
    return b.join(a, on).drop(*(f"a_{k}" for k in keys), "a_at")
