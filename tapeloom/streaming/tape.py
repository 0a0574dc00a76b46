"""Streams of the tape: normalised channels, replay dedup, tumbling bars, the partitioned sink.

Every transformation is the batch function, so a finished stream gives the batch result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tapeloom.operators.bars import imbalance, last_known, mid, spread_bps
from tapeloom.sources import messages
from tapeloom.sources.layers import with_partitions
from tapeloom.schemas import EVENT_MS

RAW = "captured_ms bigint, value string"


def raw_stream(spark: SparkSession, path: str, files_a_trigger: int = 1000) -> DataFrame:
    """Raw messages from Parquet files that arrive in a folder."""
    return spark.readStream.schema(RAW).option("maxFilesPerTrigger", files_a_trigger).parquet(path)


def kafka_stream(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    """Raw messages from Kafka; needs the Kafka connector on the class path."""
    k = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).load()
    return k.select(F.unix_millis("timestamp").alias("captured_ms"), F.col("value").cast("string").alias("value"))


def channel_stream(raw: DataFrame, channel: str, universe: list[str] | None = None) -> DataFrame:
    rows = messages.NORMALISERS[channel](raw, universe)
    return rows.withColumn("event_time", F.timestamp_millis(EVENT_MS[channel]))


def without_replays(trades: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """One row of each (coin, tid) within the watermark's delay."""
    return trades.withWatermark("event_time", delay).dropDuplicatesWithinWatermark(["coin", "tid"])


def stream_quote_bars(quotes: DataFrame, width: str, delay: str = "10 minutes") -> DataFrame:
    """Tumbling bars; append mode emits a bar when the watermark passes its end, later rows are dropped."""
    w = F.window("event_time", width)
    out = quotes.withWatermark("event_time", delay).groupBy("coin", w.alias("w")).agg(
        F.avg(imbalance()).alias("obi"), last_known(mid(), "bbo_ms", "bid_px").alias("mid"), F.avg(spread_bps()).alias("spread_bps"))
    return out.select("coin", F.unix_millis("w.start").alias("bar"), "obi", "mid", "spread_bps")


def stream_flow_bars(trades: DataFrame, width: str, delay: str | None = "10 minutes") -> DataFrame:
    """As ``stream_quote_bars``; without ``delay`` for a stream that has its watermark already."""
    trades = trades.withWatermark("event_time", delay) if delay else trades
    w = F.window("event_time", width)
    signed = F.when(F.col("side") == "B", F.col("notional")).otherwise(-F.col("notional"))
    out = trades.groupBy("coin", w.alias("w")).agg(
        F.sum(signed).alias("taker"), last_known(F.col("px"), "trade_ms", "tid").alias("px"), F.sum("notional").alias("notional"))
    return out.select("coin", F.unix_millis("w.start").alias("bar"), "taker", "px", "notional")


def sink(rows: DataFrame, channel: str, root: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Append a channel to its hour-partitioned table, exactly once."""
    parts = with_partitions(rows.drop("event_time"), EVENT_MS[channel])
    writer = parts.writeStream.format("parquet").option("path", f"{root}/{channel}").option("checkpointLocation", f"{checkpoint}/{channel}")
    return writer.partitionBy("coin", "dt", "hr").outputMode("append").trigger(**(trigger or {"processingTime": "30 seconds"})).start()


__all__ = ["RAW", "channel_stream", "kafka_stream", "raw_stream", "sink", "stream_flow_bars", "stream_quote_bars", "without_replays"]
