"""Exchange messages made from the adapted tables: ``(captured_ms, value)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.sources import adapters as a


def message(channel: str, data: Column) -> Column:
    return F.to_json(F.struct(F.lit(channel).alias("channel"), data.alias("data"))).alias("value")


def trades(s, d) -> DataFrame:
    """Two trades a message."""
    t = a.trades(s, d)
    one = F.struct("coin", "side", F.col("px").cast("string").alias("px"), F.col("sz").cast("string").alias("sz"), F.col("trade_ms").alias("time"), "tid", F.hex("tid").alias("hash"), F.array("users_buyer", "users_seller").alias("users"))
    m = t.groupBy(F.floor(F.col("tid") / 2).alias("m")).agg(F.max("captured_ms").alias("captured_ms"), F.collect_list(one).alias("data"))
    return m.select("captured_ms", message("trades", F.col("data")))


def books(s, d) -> DataFrame:
    levels = F.from_json("levels_json", "array<array<struct<px:string,sz:string>>>").alias("levels")
    return a.books(s, d).select("captured_ms", message("l2Book", F.struct("coin", F.col("captured_ms").alias("time"), levels)))


def quotes(s, d) -> DataFrame:
    """Both sides; a size of 5 or less is missing from the bid, and every fourth message has no ask."""
    text = lambda c: F.col(c).cast("string")
    bid = F.struct(text("bid_px").alias("px"), F.when(F.col("bid_sz") > 5, text("bid_sz")).alias("sz"))
    ask = F.struct(text("ask_px").alias("px"), text("ask_sz").alias("sz"))
    sides = F.when(F.col("seq") % 4 == 0, F.array(bid)).otherwise(F.array(bid, ask)).alias("bbo")
    return a.quotes(s, d).select("captured_ms", message("bbo", F.struct("coin", F.col("bbo_ms").alias("time"), sides)))


def contexts(s, d) -> DataFrame:
    """All nine values, as text; every third premium is no number."""
    premium = F.when(F.col("seq") % 3 > 0, F.col("premium").cast("string")).otherwise("n/a")
    text = lambda c: F.col(c).cast("string")
    rest = {"openInterest": F.col("seq") * 2, "prevDayPx": F.col("seq") + 0.5, "dayNtlVlm": F.col("seq") * 10, "oraclePx": F.col("seq") + 0.25, "markPx": F.col("seq") + 0.125, "midPx": F.col("seq") + 0.75, "dayBaseVlm": F.col("seq") % 97}
    ctx = F.struct(text("funding").alias("funding"), premium.alias("premium"), *[c.cast("string").alias(k) for k, c in rest.items()])
    return a.contexts(s, d).select("captured_ms", message("activeAssetCtx", F.struct("coin", ctx.alias("ctx"))))


def everything(s, d) -> DataFrame:
    """The messages of all channels in one table."""
    return trades(s, d).unionByName(books(s, d)).unionByName(quotes(s, d)).unionByName(contexts(s, d))
