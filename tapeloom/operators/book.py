"""Order books: parsing, walking, sampled slippage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.operators.align import safe_ratio
from tapeloom.operators.order import quantiles
from tapeloom.sources.layers import stored
from tapeloom.schemas import BOOK


def asks_of(levels_json: Column) -> Column:
    """``array<struct<px, sz>>`` of the ask side; null if malformed or empty."""
    asks = F.get(F.from_json(levels_json, BOOK), F.lit(1))
    typed = F.transform(asks, lambda x: F.struct(x["px"].cast("double").alias("px"), x["sz"].cast("double").alias("sz")))
    return F.when(F.size(asks) > 0, typed)


def walk(asks: Column, notional: Column, mid: Column) -> Column:
    """VWAP of buying ``notional`` USD over mid, less 1; null if the book is too thin."""
    def step(a: Column, x: Column) -> Column:
        take = F.least(x["px"] * x["sz"], notional - a["filled"])
        more = a["filled"] < notional
        return F.struct(F.when(more, a["filled"] + take).otherwise(a["filled"]).alias("filled"), F.when(more, a["units"] + take / x["px"]).otherwise(a["units"]).alias("units"))

    end = F.aggregate(asks, F.struct(F.lit(0.0).alias("filled"), F.lit(0.0).alias("units")), step)
    return F.when(end["filled"] >= notional, safe_ratio(safe_ratio(notional, end["units"]) - mid, mid))


def every_nth(rows: DataFrame, keys: list[str], order: list[str], n: int = 60) -> DataFrame:
    """Rows 1, n + 1, 2n + 1, ... of each key in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_k", F.row_number().over(w)).filter((F.col("_k") - 1) % n == 0).drop("_k")


def slippage(books: DataFrame, notionals: list[float]) -> DataFrame:
    """Rows of ``books`` times notionals with ``slip``; malformed, one-sided and thin books give null."""
    mid = (F.col("best_bid_px") + F.col("best_ask_px")) / 2
    parsed = books.withColumns({"asks": asks_of(F.col("levels_json")), "mid": mid})
    each = parsed.withColumn("notional", F.explode(F.array(*[F.lit(float(x)) for x in notionals])))
    return each.withColumn("slip", walk(F.col("asks"), F.col("notional"), F.col("mid"))).drop("asks")


def slippage_summary(books: DataFrame, notionals: list[float]) -> DataFrame:
    """``(coin, notional, n, n_filled, median_bps, p95_bps)``."""
    keys = ["coin", "notional"]
    each = stored(slippage(books, notionals).select(*keys, (F.col("slip") * 10_000).alias("bps")), "slippage")
    counts = each.groupBy(*keys).agg(F.count("*").alias("n"), F.count("bps").alias("n_filled"))
    return counts.join(quantiles(each, keys, "bps", {"median_bps": 0.5, "p95_bps": 0.95}), keys, "left")


def edge_slippage(books: DataFrame, notional: float, first: bool, n: int = 60) -> DataFrame:
    """``(coin, dt, slip)``: median over the sampled books of the first or last hour of each day."""
    edge = books.groupBy("coin", "dt").agg((F.min("hr") if first else F.max("hr")).alias("hr"))
    held = every_nth(books.join(edge, ["coin", "dt", "hr"], "left_semi"), ["coin", "dt", "hr"], ["captured_ms"], n)
    return slippage(held, [notional]).groupBy("coin", "dt").agg(F.median("slip").alias("slip"))


def round_trip_slippage(books: DataFrame, notional: float, n: int = 60) -> DataFrame:
    """``(coin, slip_in, slip_out)``: of the first hour of a coin's first day and the last hour of its last day.

    Coins without a filled book at both ends have no row.
    """
    ends = F.broadcast(books.groupBy("coin").agg(F.min("dt").alias("first_dt"), F.max("dt").alias("last_dt")))  # a row a coin
    at = books.join(ends, "coin")
    into = edge_slippage(at.filter("dt = first_dt"), notional, True, n).select("coin", F.col("slip").alias("slip_in"))
    out = edge_slippage(at.filter("dt = last_dt"), notional, False, n).select("coin", F.col("slip").alias("slip_out"))
    return into.join(out, "coin").filter("slip_in is not null and slip_out is not null")


def median_spread(bars: DataFrame, per: list[str] | None = None) -> DataFrame:
    """Median spread by coin; with ``per``, the median of the medians of these parts."""
    if not per:
        return bars.groupBy("coin").agg(F.median("spread_bps").alias("median_spread_bps"))
    parts = bars.groupBy("coin", *per).agg(F.median("spread_bps").alias("m"))
    return parts.groupBy("coin").agg(F.median("m").alias("median_spread_bps"))
