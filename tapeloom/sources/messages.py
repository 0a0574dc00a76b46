"""Raw exchange messages to typed rows. The same functions serve batch tables and streams.

Input rows have ``captured_ms`` and ``value``, the message's JSON text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHANNEL_OF = {"trades": "trades", "l2book": "l2Book", "bbo": "bbo", "ctx": "activeAssetCtx"}


def route(raw: DataFrame, channel: str) -> DataFrame:
    """The messages of one channel."""
    return raw.filter(F.get_json_object("value", "$.channel") == CHANNEL_OF[channel])


def known_coins(rows: DataFrame, universe: list[str] | None) -> DataFrame:
    return rows if universe is None else rows.filter(F.col("coin").isin(universe))


def tolerant(c: Column) -> Column:
    """A double, or null where the text is no number."""
    return c.try_cast("double")


def trades(raw: DataFrame, universe: list[str] | None = None) -> DataFrame:
    kind = "struct<data:array<struct<coin:string,side:string,px:string,sz:string,time:bigint,tid:bigint,hash:string,users:array<string>>>>"
    t = route(raw, "trades").select("captured_ms", F.explode(F.from_json("value", kind)["data"]).alias("t"))
    px, sz = F.col("t.px").cast("double"), F.col("t.sz").cast("double")
    rows = t.select(
        "captured_ms", F.col("t.time").alias("trade_ms"), "t.coin", "t.side", px.alias("px"), sz.alias("sz"), (px * sz).alias("notional"),
        "t.tid", "t.hash", F.get("t.users", F.lit(0)).alias("users_buyer"), F.get("t.users", F.lit(1)).alias("users_seller"))
    return known_coins(rows, universe)


def depth(levels: Column, n: int = 10) -> Column:
    """USD on the first ``n`` levels."""
    return F.aggregate(F.slice(levels, 1, n), F.lit(0.0), lambda a, x: a + x["px"].cast("double") * x["sz"].cast("double"))


def l2book(raw: DataFrame, universe: list[str] | None = None) -> DataFrame:
    kind = "struct<data:struct<coin:string,time:bigint,levels:array<array<struct<px:string,sz:string>>>>>"
    b = route(raw, "l2book").select("captured_ms", F.from_json("value", kind)["data"].alias("b"))
    b = b.select("captured_ms", "b.coin", F.col("b.time").alias("book_ms"), F.coalesce(F.get("b.levels", F.lit(0)), F.array()).alias("bids"),
                 F.coalesce(F.get("b.levels", F.lit(1)), F.array()).alias("asks"))

    def top(side: str, what: str) -> Column:
        return F.get(side, F.lit(0))[what].cast("double")

    rows = b.select(
        "captured_ms", "book_ms", "coin", top("bids", "px").alias("best_bid_px"), top("bids", "sz").alias("best_bid_sz"),
        top("asks", "px").alias("best_ask_px"), top("asks", "sz").alias("best_ask_sz"), (top("asks", "px") - top("bids", "px")).alias("spread"),
        depth(F.col("bids")).alias("bid_depth_10"), depth(F.col("asks")).alias("ask_depth_10"), F.size("bids").alias("n_bid_lvls"),
        F.size("asks").alias("n_ask_lvls"), F.to_json(F.array("bids", "asks")).alias("levels_json"))
    return known_coins(rows, universe)


def bbo(raw: DataFrame, universe: list[str] | None = None) -> DataFrame:
    kind = "struct<data:struct<coin:string,time:bigint,bbo:array<struct<px:string,sz:string>>>>"
    b = route(raw, "bbo").select("captured_ms", F.from_json("value", kind)["data"].alias("b"))
    side = lambda i, what: F.get("b.bbo", F.lit(i))[what].cast("double")
    rows = b.select("captured_ms", F.col("b.time").alias("bbo_ms"), "b.coin", side(0, "px").alias("bid_px"), side(0, "sz").alias("bid_sz"),
                    side(1, "px").alias("ask_px"), side(1, "sz").alias("ask_sz"))
    return known_coins(rows, universe)


#: Column of the ctx table and its key in the message.
CTX_KEYS = {
    "funding": "funding", "open_interest": "openInterest", "prev_day_px": "prevDayPx", "day_ntl_vlm": "dayNtlVlm", "premium": "premium",
    "oracle_px": "oraclePx", "mark_px": "markPx", "mid_px": "midPx", "day_base_vlm": "dayBaseVlm",
}


def ctx(raw: DataFrame, universe: list[str] | None = None) -> DataFrame:
    kind = "struct<data:struct<coin:string,ctx:map<string,string>>>"
    c = route(raw, "ctx").select("captured_ms", F.from_json("value", kind)["data"].alias("c"))
    values = [tolerant(F.col("c.ctx")[key]).alias(name) for name, key in CTX_KEYS.items()]
    return known_coins(c.select("captured_ms", "c.coin", *values), universe)


NORMALISERS = {"trades": trades, "l2book": l2book, "bbo": bbo, "ctx": ctx}


def keep_first(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of every key in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")


def funding_pages(pages: DataFrame) -> DataFrame:
    """Pages ``(coin, page, value)`` of funding JSON to the funding table; the first of equal times stays."""
    kind = "array<struct<time:bigint,fundingRate:string,premium:string>>"
    rows = pages.select("coin", "page", F.posexplode(F.from_json("value", kind)).alias("at", "r"))
    rows = keep_first(rows.withColumn("ms", F.col("r.time")), ["coin", "ms"], ["page", "at"])
    return rows.select(F.timestamp_millis("ms").alias("ts"), "coin", F.col("r.fundingRate").cast("double").alias("funding_rate"), F.col("r.premium").cast("double").alias("premium"))


def candle_pages(pages: DataFrame) -> DataFrame:
    """Pages ``(coin, page, value)`` of candle JSON; ``ts`` is the candle's close."""
    kind = "array<struct<T:bigint,o:string,c:string,h:string,l:string,v:string>>"
    rows = pages.select("coin", "page", F.posexplode(F.from_json("value", kind)).alias("at", "r"))
    rows = keep_first(rows.withColumn("ms", F.col("r.T")), ["coin", "ms"], ["page", "at"])
    named = {"open": "o", "close": "c", "high": "h", "low": "l", "volume": "v"}
    return rows.select(F.timestamp_millis("ms").alias("ts"), "coin", *[F.col(f"r.{k}").cast("double").alias(n) for n, k in named.items()])


def map_symbols(rows: DataFrame, symbols: DataFrame) -> DataFrame:
    """``rows`` with the venue's pair id from ``symbols (coin, pair)``; unmapped coins are skipped."""
    return rows.join(symbols, "coin")
