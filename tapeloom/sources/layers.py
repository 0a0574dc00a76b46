"""Tables on disk: candle and funding layers, hour-partitioned tapes, CSV ledgers, label sets."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tapeloom import schemas


class MissingCoin(LookupError):
    """A layer holds no rows of the coin."""


def scratch(spark: SparkSession, tag: str) -> str:
    """A new folder that driver and executors share, below ``spark.checkpoint.dir``."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    root = root or "file://" + tempfile.mkdtemp(prefix="spark-shared-")
    return f"{root.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def stored(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written to a shared folder and read back: computed once, and found again after an executor is lost."""
    path = scratch(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def load_layer(spark: SparkSession, root: str, layer: str, coin: str | None = None) -> DataFrame:
    """A layer partitioned by coin; with ``coin``, that coin's rows, or MissingCoin."""
    df = spark.read.schema(schemas.LAYERS[layer.split("_")[0]]).parquet(f"{root}/{layer}")
    if coin is None:
        return df
    df = df.filter(F.col("coin") == coin)
    if df.isEmpty():
        raise MissingCoin(f"{layer}: no rows of {coin}")
    return df


def write_layer(df: DataFrame, root: str, layer: str) -> None:
    df.repartition("coin").sortWithinPartitions("coin", "ts").write.mode("append").partitionBy("coin").parquet(f"{root}/{layer}")


def load_tape(spark: SparkSession, root: str, channel: str, coins: list[str] | None = None, days: tuple[str, str] | None = None) -> DataFrame:
    """A channel of the tape; coins and days prune partitions before any file is opened."""
    kinds = "coin string, dt string, hr string"
    # A new schema: ``add`` would change the shared one, for every later reader of the session.
    schema = StructType([*schemas.CHANNELS[channel].fields, StructField("dt", StringType()), StructField("hr", StringType())])
    df = spark.read.schema(schema).option("partitionSchema", kinds).parquet(f"{root}/{channel}")
    if coins is not None:
        df = df.filter(F.col("coin").isin(coins))
    if days is not None:
        df = df.filter(F.col("dt").between(*days))
    return df


def load_foreign_tape(spark: SparkSession, root: str, channel: str) -> DataFrame:
    """A tape of nested plain folders ``coin/channel/day/hour.parquet``, read without globbing over names."""
    files = spark.read.schema(schemas.CHANNELS[channel]).option("recursiveFileLookup", "true").parquet(root)
    return files.filter(F.col("_metadata.file_path").contains(f"/{channel}/"))


def with_partitions(df: DataFrame, ms_col: str) -> DataFrame:
    """``dt`` and ``hr`` of the event hour (UTC), the partitions of a tape."""
    day = F.date_from_unix_date((F.col(ms_col) / 86_400_000).cast("int"))
    hour = F.floor(F.col(ms_col) / 3_600_000) % 24
    return df.withColumns({"dt": F.date_format(day, "yyyy-MM-dd"), "hr": F.lpad(hour.cast("string"), 2, "0")})


HOUR = ["coin", "dt", "hr"]


def write_tape(df: DataFrame, root: str, channel: str) -> None:
    """Append rows to a channel's hours, and the names of these hours to its list of hours."""
    parts = stored(with_partitions(df, schemas.EVENT_MS[channel]), "tape")
    parts.repartition(*HOUR).write.mode("append").partitionBy(*HOUR).parquet(f"{root}/{channel}")
    parts.groupBy(*HOUR).agg(F.count("*").alias("rows")).write.mode("append").parquet(f"{root}/{channel}_hours")


def tape_hours(spark: SparkSession, root: str, channel: str) -> DataFrame:
    """``(coin, dt, hr, rows)`` of a channel, from its list of hours; no file of the tape is opened."""
    held = spark.read.schema("coin string, dt string, hr string, rows bigint").parquet(f"{root}/{channel}_hours")
    return held.groupBy(*HOUR).agg(F.sum("rows").alias("rows"))


def first_hours(hours: DataFrame, k: int, keys: tuple[str, ...] = ("coin",)) -> DataFrame:
    """The first ``k`` hours of each key, of a list of hours."""
    order = F.row_number().over(Window.partitionBy(*keys).orderBy("dt", "hr"))
    return hours.withColumn("k", order).filter(F.col("k") <= k).select(*HOUR)


def load_hours(spark: SparkSession, root: str, channel: str, hours: DataFrame) -> DataFrame:
    """The rows of some hours of a channel; the join prunes partitions as it runs, which Spark does where the other side has a filter."""
    chosen = stored(hours.select(*HOUR, F.lit(1).alias("chosen")), "hours").filter("chosen = 1")
    return load_tape(spark, root, channel).join(chosen, HOUR, "left_semi")


def write_ledger(df: DataFrame, path: str, compress: bool = True) -> None:
    df.write.mode("overwrite").option("header", "true").option("compression", "gzip" if compress else "none").csv(path)


def smart_wallets(labels: DataFrame) -> DataFrame:
    """The wallets of the cohort."""
    return labels.filter("is_smart").select("wallet").distinct()


def fingerprint(df: DataFrame) -> DataFrame:
    """Rows and an order-free content hash of a table: sums of the first 60 bits of the MD5 of each row's values, nulls as an empty text."""
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in sorted(df.columns)])
    bits = F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count("*").alias("n_rows"), F.coalesce(F.sum(bits), F.lit(0).cast("decimal(38,0)")).cast("string").alias("content_sum"))
