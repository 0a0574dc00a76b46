"""Fixed-length bars and hourly features from quotes, trades and contexts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.operators.align import HOUR_MS, bucket, safe_ratio

BPS = 10_000.0


def imbalance() -> Column:
    """Top-of-book imbalance of sizes, null for an empty top."""
    return safe_ratio(F.col("bid_sz") - F.col("ask_sz"), F.col("bid_sz") + F.col("ask_sz"))


def mid() -> Column:
    return (F.col("bid_px") + F.col("ask_px")) / 2


def spread_bps() -> Column:
    return safe_ratio(F.col("ask_px") - F.col("bid_px"), (F.col("ask_px") + F.col("bid_px")) / 2) * BPS


def last_known(value: Column, *order: str) -> Column:
    """The value of the latest row on which it is not null; ties by the later order columns."""
    return F.max_by(value, F.when(value.isNotNull(), F.struct(*order)))


def flow_bars(flows: DataFrame, bar_ms: int = 30_000) -> DataFrame:
    """``(coin, bar, inf_net, taker, px, notional)`` from signed flows; last price by (time, tid)."""
    return flows.groupBy("coin", bucket("trade_ms", bar_ms).alias("bar")).agg(
        F.sum("inf_net").alias("inf_net"), F.sum("taker").alias("taker"), last_known(F.col("px"), "trade_ms", "tid").alias("px"), F.sum("notional").alias("notional"))


def quote_bars(quotes: DataFrame, bar_ms: int = 5_000, tie: str = "seq") -> DataFrame:
    """``(coin, bar, obi, mid, spread_bps)``: mean imbalance, last mid, mean spread."""
    return quotes.groupBy("coin", bucket("bbo_ms", bar_ms).alias("bar")).agg(
        F.avg(imbalance()).alias("obi"), last_known(mid(), "bbo_ms", tie).alias("mid"), F.avg(spread_bps()).alias("spread_bps"))


def mid_bars(quotes: DataFrame, minutes: int = 5, tie: str = "seq") -> DataFrame:
    """Last mid of each bar; bars without quotes are absent."""
    known = quotes.filter("bid_px is not null and ask_px is not null")
    return known.groupBy("coin", bucket("bbo_ms", minutes * 60_000).alias("bar")).agg(last_known(mid(), "bbo_ms", tie).alias("mid"))


def hourly_quotes(quotes: DataFrame) -> DataFrame:
    return quotes.groupBy("coin", bucket("bbo_ms", HOUR_MS).alias("hour")).agg(F.avg(imbalance()).alias("obi_mean"), F.avg(spread_bps()).alias("spread_bps_mean"))


def hourly_taker(trades: DataFrame) -> DataFrame:
    signed = F.when(F.col("side") == "B", F.col("notional")).otherwise(-F.col("notional"))
    return trades.groupBy("coin", bucket("trade_ms", HOUR_MS).alias("hour")).agg(safe_ratio(F.sum(signed), F.sum("notional")).alias("taker_imbalance"))


def hourly_context(ctx: DataFrame, tie: str = "seq") -> DataFrame:
    """Premium mean and last; ``ctx_funding_last`` restates the target, so it is no feature."""
    return ctx.groupBy("coin", bucket("captured_ms", HOUR_MS).alias("hour")).agg(
        F.avg("premium").alias("premium_mean"), last_known(F.col("premium"), "captured_ms", tie).alias("premium_last"),
        last_known(F.col("funding"), "captured_ms", tie).alias("ctx_funding_last"))


def forward_bps(px: str, rows: int, w) -> Column:
    """Return over the next ``rows`` rows in basis points; null at the end."""
    return (safe_ratio(F.lead(px, rows).over(w), F.col(px)) - 1) * BPS


def rolling_sum(column: str, rows: int, keys: list[str], time_col: str) -> Column:
    """Sum over ``rows`` rows, null until that many values are there."""
    w = Window.partitionBy(*keys).orderBy(time_col).rowsBetween(-(rows - 1), 0)
    return F.when(F.count(column).over(w) == rows, F.sum(column).over(w))
