"""Shared helpers of the training-data operators.

Intermediate tables go to the folder the cluster names in ``spark.checkpoint.dir``, so a lost
executor costs a re-read of Parquet and never a lineage that cannot be recomputed.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: bytes.translate table that lower-cases A-Z only.
LOWER_TABLE = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Rows of one Arrow batch: texts can be long, so a batch stays at some tens of MB.
ARROW_ROWS = 256
#: Rows and bytes up to which a lookup table may be broadcast; both are measured before.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 32_000_000
#: A key with more than one in HOT_SHARE of all rows of a join is hot, so fewer than HOT_SHARE keys can be.
HOT_SHARE, SALTS = 200, 32


def session_setup(spark: SparkSession) -> None:
    """Small Arrow batches, so that Python workers hold few long texts at once."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where none is set and all is one machine (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/tapeloom-{tag}-{uuid.uuid4().hex}"


def stored(df: DataFrame, tag: str, codec: str = "snappy", group_rows: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends, later scans are pruned.

    ``group_rows`` is for rows of megabytes: readers and writers hold a row group of so many rows, where they would hold 4,096 rows and 128 MB.
    """
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    (df.write.option("parquet.block.row.count.limit", group_rows) if group_rows else df.write).parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z and nothing else. Pure ASCII text takes the fast built-in."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(
        F.translate(c, UPPER, LOWER)
    )


def _width(name: str, kind: str) -> Column:
    """Bytes of a value: strings and arrays of strings by their text, arrays by their elements, others as 16."""
    c = F.col(f"`{name}`")
    if kind in ("string", "binary"):
        n = F.octet_length(c)
    elif kind == "array<string>":
        n = F.aggregate(c, F.lit(0), lambda n, x: n + F.coalesce(F.octet_length(x), F.lit(0)) + 8)
    elif kind.startswith("array"):
        n = F.size(c) * 16
    else:
        return F.lit(16)
    return F.coalesce(n, F.lit(0)) + 16


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint, only where the measured rows and bytes are within their limits; else Spark shuffles."""
    widths = [_width(n, t) for n, t in df.dtypes]
    rows, size = df.select(sum(widths[1:], widths[0]).alias("w")).agg(F.count("*"), F.sum("w")).first()
    return F.broadcast(df) if rows <= limit and (size or 0) <= BROADCAST_BYTES else df


def hot_keys(rows: DataFrame, key: str) -> list:
    """The keys that hold more than one in ``HOT_SHARE`` of ``rows``, a stored table: fewer than ``HOT_SHARE`` by construction."""
    total = rows.count()
    counts = rows.groupBy(key).agg(F.count("*").alias("held"))
    return [k for (k,) in counts.filter(F.col("held") * HOT_SHARE > total).select(key).collect()]


def join_hot(rows: DataFrame, ones: DataFrame, key: str, how: str = "inner", hot: list | None = None) -> DataFrame:
    """``rows`` joined with ``ones``, which has few rows a key: rows of hot keys are dealt over ``SALTS`` tasks.

    The salt is a hash of the row, so that a task run again deals alike. ``key`` is never null.
    """
    hot = hot_keys(rows, key) if hot is None else hot
    if not hot:
        return rows.join(ones, key, how)
    is_hot, one = F.col(key).isin(hot), F.lit(0).cast("bigint")
    dealt = rows.withColumn("__salt", F.when(is_hot, F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS))).otherwise(one))
    every = F.sequence(one, F.lit(SALTS - 1).cast("bigint"))
    spread = ones.withColumn("__salt", F.explode(F.when(is_hot, every).otherwise(F.array(one))))
    return dealt.join(spread, [key, "__salt"], how).drop("__salt")
