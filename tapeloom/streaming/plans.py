"""Streaming queries, run to their end over files made from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.sources import adapters as a
from tapeloom.sources.adapters import ctes
from tapeloom.sources.layers import scratch
from tapeloom.streaming import alerts, fan, tape


def _raw_files(s: SparkSession, d: str, root: str) -> str:
    """Trade messages by day of capture, each sent twice as a reconnect would; a last late message closes all windows."""
    t = a.trades(s, d)
    one = F.struct("coin", "side", F.col("px").cast("string").alias("px"), F.col("sz").cast("string").alias("sz"), F.col("trade_ms").alias("time"), "tid", F.hex("tid").alias("hash"), F.array("users_buyer", "users_seller").alias("users"))
    rows = t.select("captured_ms", F.to_json(F.struct(F.lit("trades").alias("channel"), F.array(one).alias("data"))).alias("value"))
    rows.withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1)))).drop("copy").repartition(4).write.parquet(f"{root}/raw")
    return f"{root}/raw"


def _closing(s: SparkSession, d: str) -> DataFrame:
    """A message far ahead of all trades, of a coin of its own."""
    last = a.trades(s, d).agg((F.max("trade_ms") + 400 * a.DAY).alias("time"))
    end = F.struct(F.lit("end").alias("coin"), F.lit("B").alias("side"), F.lit("1").alias("px"), F.lit("1").alias("sz"), "time", F.lit(-1).cast("long").alias("tid"))
    return last.select(F.lit(0).cast("long").alias("captured_ms"), F.to_json(F.struct(F.lit("trades").alias("channel"), F.array(end).alias("data"))).alias("value"))


def _run_to_end(rows: DataFrame, root: str) -> DataFrame:
    out, s = f"{root}/out", rows.sparkSession
    q = rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{root}/check").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return s.read.schema(rows.schema).parquet(out)


def stream_trades(s: SparkSession, d: str) -> DataFrame:
    """Parsed trades of the stream without replays."""
    root = scratch(s, "stream-trades")
    trades = tape.channel_stream(tape.raw_stream(s, _raw_files(s, d, root)), "trades")
    done = _run_to_end(tape.without_replays(trades, "60 days"), root)
    return done.select("coin", "trade_ms", "tid", "side", F.round("px", 6).alias("px"), F.round("notional", 4).alias("notional"))


def stream_bars(s: SparkSession, d: str) -> DataFrame:
    """Hourly bars of the stream without replays; a closing message far ahead lets the watermark pass all windows."""
    root = scratch(s, "stream-bars")
    raw = _raw_files(s, d, root)
    closing = _closing(s, d)
    # A first run reads the trades; the second reads the closing message and emits every window.
    trades = lambda: tape.without_replays(tape.channel_stream(tape.raw_stream(s, raw), "trades"), "60 days")
    _run_to_end(tape.stream_flow_bars(trades(), "1 hour", None), root)
    closing.write.mode("append").parquet(raw)
    done = _run_to_end(tape.stream_flow_bars(trades(), "1 hour", None), root)
    return done.select("coin", "bar", F.round("taker", 4).alias("taker"), F.round("px", 6).alias("px"), F.round("notional", 4).alias("notional"))


def stream_stalls(s: SparkSession, d: str) -> DataFrame:
    """Stalls and recoveries of each coin's trades, told by timers; the closing message lets the watermark pass the last row."""
    root = scratch(s, "stream-stalls")
    raw = _raw_files(s, d, root)
    alarms = lambda: alerts.stall_alerts(tape.channel_stream(tape.raw_stream(s, raw), "trades"), ["coin"], delay="60 days").filter("coin <> 'end'")
    _run_to_end(alarms(), root)
    closing = _closing(s, d).withColumn("captured_ms", F.get_json_object("value", "$.data[0].time").cast("long"))
    closing.write.mode("append").parquet(raw)
    return _run_to_end(alarms(), root)


#: Messages of a file, and files of a batch, at most: batches do not grow with the input.
FILE_MESSAGES, BATCH_FILES = 250_000, 8


def fanned(s: SparkSession, raw: DataFrame, channel: str) -> DataFrame:
    """One channel's table of a stream of all channels' messages, run to its end in several batches of bounded size."""
    root = scratch(s, "fan")
    raw.write.option("maxRecordsPerFile", FILE_MESSAGES).parquet(f"{root}/raw")
    files = len(s.read.schema(tape.RAW).parquet(f"{root}/raw").inputFiles())
    fan.fan_out(tape.raw_stream(s, f"{root}/raw", max(1, min(BATCH_FILES, files // 2))), f"{root}/tape", f"{root}/check", trigger={"availableNow": True}, by=("coin", "dt")).awaitTermination()
    return fan.load_channel(s, f"{root}/tape", channel)


QUERIES = {"stream_trades": stream_trades, "stream_bars": stream_bars, "stream_stalls": stream_stalls}
ORACLE_SQL = {
    "stream_bars": ctes("tr") + """ SELECT coin, trade_ms // 3600000 * 3600000 AS bar, round(sum(CASE WHEN side = 'B' THEN notional ELSE -notional END), 4) AS taker,
round(arg_max(px, (trade_ms, tid)), 6) AS px, round(sum(notional), 4) AS notional FROM tr GROUP BY 1, 2""",
    "stream_stalls": ctes("tr") + """, g AS (SELECT coin, captured_ms AS last_ms, lead(captured_ms) OVER (PARTITION BY coin ORDER BY captured_ms) AS nxt FROM (SELECT DISTINCT coin, captured_ms FROM tr)),
k AS (SELECT * FROM g WHERE nxt IS NULL OR nxt - last_ms >= 240000)
SELECT coin, 'stall' AS kind, last_ms, last_ms + 240000 AS at_ms FROM k UNION ALL SELECT coin, 'recovered', last_ms, nxt FROM k WHERE nxt IS NOT NULL""",
    "stream_trades": ctes("tr") + " SELECT coin, trade_ms, tid, side, round(px, 6) AS px, round(notional, 4) AS notional FROM tr",
}
