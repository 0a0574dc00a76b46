"""One raw stream to the tables of all channels: a batch is read once, and every sink writes it under its number.

A channel's table is ``root/channel/batch=N/coin=/dt=/hr=``; sparse feeds can leave the hour out of the folders. A batch that is run again, because the job ended between two sinks, overwrites what it
has written; a batch counts once all of its sinks are done, which its row in ``root/batches`` says. So readers see whole batches, and each once.
The checkpoint and ``root`` belong together: batch numbers are the checkpoint's.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tapeloom import schemas
from tapeloom.sources import messages
from tapeloom.sources.layers import with_partitions

BATCHES = "batch bigint, rows bigint"
FOLDERS = ("coin", "dt", "hr")


def write_channel(rows: DataFrame, channel: str, root: str, number: int, by: tuple[str, ...] = FOLDERS) -> None:
    """Replace a batch of a channel. A folder with many rows is split over tasks, each of which writes a file of it."""
    parts = with_partitions(rows, schemas.EVENT_MS[channel]).hint("rebalance", *map(F.col, by))
    parts.write.mode("overwrite").partitionBy(*by).parquet(f"{root}/{channel}/batch={number}")


def write_batch(raw: DataFrame, number: int, root: str, universe: list[str] | None = None, by: tuple[str, ...] = FOLDERS) -> None:
    """All channels of a batch of raw messages, then its row among the finished ones."""
    # On disk: a partition of long messages would fill an executor's memory while it is cached.
    held = raw.persist(StorageLevel.DISK_ONLY)
    try:
        for channel, normalise in messages.NORMALISERS.items():
            write_channel(normalise(held, universe), channel, root, number, by)
        done = held.agg(F.lit(number).cast("long").alias("batch"), F.count("*").alias("rows"))
        done.coalesce(1).write.mode("overwrite").parquet(f"{root}/batches/{number}")
    finally:
        held.unpersist()


def fan_out(raw: DataFrame, root: str, checkpoint: str, universe: list[str] | None = None, trigger: dict | None = None, by: tuple[str, ...] = FOLDERS) -> StreamingQuery:
    """Start the stream of ``raw`` messages into the tables below ``root``."""
    writer = raw.writeStream.foreachBatch(lambda batch, number: write_batch(batch, number, root, universe, by)).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"processingTime": "30 seconds"})).start()


def finished(spark: SparkSession, root: str) -> DataFrame:
    """``(batch, rows)`` of the batches that all sinks have."""
    return spark.read.schema(BATCHES).option("recursiveFileLookup", "true").parquet(f"{root}/batches")


def load_channel(spark: SparkSession, root: str, channel: str) -> DataFrame:
    """The finished batches of a channel, with ``dt`` and ``hr``; partitions prune by coin, day and hour."""
    schema = schemas.CHANNELS[channel]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    held = spark.read.schema(f"{fields}, dt string, hr string, batch bigint").parquet(f"{root}/{channel}")
    return held.join(finished(spark, root).select("batch"), "batch", "left_semi").drop("batch").select(*schema.names, "dt", "hr")
