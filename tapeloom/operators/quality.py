"""Coverage, windows, latency and freshness of the tape."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.operators.align import HOUR_MS
from tapeloom.operators.order import quantiles
from tapeloom.schemas import EVENT_MS


def coverage(channels: dict[str, DataFrame]) -> DataFrame:
    """``(channel, coin, n_rows, first_ms, last_ms, distinct_ids)``; ids are counted for trades."""
    def one(name: str, df: DataFrame) -> DataFrame:
        ms = EVENT_MS[name]
        ids = F.count_distinct("tid") if name == "trades" else F.lit(None).cast("long")
        return df.groupBy("coin").agg(F.count("*").alias("n_rows"), F.min(ms).alias("first_ms"), F.max(ms).alias("last_ms"), ids.alias("distinct_ids")).select(F.lit(name).alias("channel"), "*")

    return reduce(DataFrame.unionByName, [one(n, d) for n, d in channels.items()])


def selected_coverage(tapes: dict[str, tuple[DataFrame, str]], coins: list[str], anchored: dict[str, str], days: int = 90) -> DataFrame:
    """``(channel, coin, n_rows, first_ms, last_ms)`` of some coins over all channels at once.

    ``tapes`` names the time column of each channel; channels in ``anchored`` are cut to ``days`` before the last row of the
    coin given there. Trades count distinct ids, as a reconnect replays some.
    """
    def one(name: str, df: DataFrame, ms: str) -> DataFrame:
        held = anchored_window(df, ms, anchored[name], days) if name in anchored else df
        n = F.count_distinct("tid") if name == "trades" else F.count("*")
        each = held.filter(F.col("coin").isin(coins)).groupBy("coin").agg(n.alias("n_rows"), F.min(ms).alias("first_ms"), F.max(ms).alias("last_ms"))
        return each.select(F.lit(name).alias("channel"), "*")

    return reduce(DataFrame.unionByName, [one(n, *t) for n, t in tapes.items()])


def anchored_window(df: DataFrame, ms: str, anchor_coin: str, days: int) -> DataFrame:
    """Rows strictly within ``days`` before the anchor coin's last row."""
    last = df.filter(F.col("coin") == anchor_coin).agg((F.max(ms) - days * 24 * HOUR_MS).alias("after"))
    return df.crossJoin(F.broadcast(last)).filter(F.col(ms) > F.col("after")).drop("after")


def channel_counts(channels: dict[str, DataFrame]) -> DataFrame:
    """Rows a channel, and their total under ``total``."""
    each = reduce(DataFrame.unionByName, [d.select(F.lit(n).alias("channel")) for n, d in channels.items()])
    return each.rollup("channel").count().select(F.coalesce("channel", F.lit("total")).alias("channel"), F.col("count").alias("n_rows"))


def tape_window(df: DataFrame, ms: str) -> DataFrame:
    return df.agg(F.min(ms).alias("first_ms"), F.max(ms).alias("last_ms"), ((F.max(ms) - F.min(ms)) / (24 * HOUR_MS)).alias("days"))


def latency(trades: DataFrame, exact: bool = False) -> DataFrame:
    """p50 and p95 of captured less trade time, non-negative; approximate unless ``exact``."""
    lag = trades.select((F.col("captured_ms") - F.col("trade_ms")).alias("lag")).filter("lag >= 0")
    if exact:
        return quantiles(lag, [], "lag", {"p50_ms": 0.5, "p95_ms": 0.95})
    return lag.agg(F.percentile_approx("lag", F.lit(0.5)).alias("p50_ms"), F.percentile_approx("lag", F.lit(0.95)).alias("p95_ms"))


def hourly_coverage(df: DataFrame, ms: str) -> DataFrame:
    """``(coin, present, expected, missing_pct)`` of hours with rows over the coin's span."""
    hour = F.floor(F.col(ms) / HOUR_MS)
    x = df.groupBy("coin").agg(F.count_distinct(hour).alias("present"), (F.max(hour) - F.min(hour) + 1).alias("expected"))
    return x.withColumn("missing_pct", (1 - F.col("present") / F.col("expected")) * 100)


def uptime(df: DataFrame, ms: str) -> DataFrame:
    """Share of hours of the span in which any coin has rows."""
    hour = F.floor(F.col(ms) / HOUR_MS)
    return df.agg((F.count_distinct(hour) / (F.max(hour) - F.min(hour) + 1)).alias("uptime"))


def freshness(channels: dict[str, DataFrame], as_of_ms: int, stall_ms: int = 240_000) -> DataFrame:
    """``(channel, coin, last_ms, age_ms, stalled)`` as of a given time."""
    def one(name: str, df: DataFrame) -> DataFrame:
        return df.groupBy("coin").agg(F.max("captured_ms").alias("last_ms")).select(F.lit(name).alias("channel"), "*")

    all_of = reduce(DataFrame.unionByName, [one(n, d) for n, d in channels.items()])
    age = F.lit(as_of_ms) - F.col("last_ms")
    return all_of.withColumns({"age_ms": age, "stalled": age >= stall_ms})
