"""Trade ledgers: non-overlapping event trades, gated runs, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.operators.align import safe_ratio
from tapeloom.operators.order import numbered, quantiles
from tapeloom.sources.layers import stored

#: Time of a coin's bars that one task numbers.
SPAN_MS = 30 * 86_400_000


def event_ledger(bars: DataFrame, fee_bps: float, hold: int = 12, frac: float = 0.30, q: float = 0.9, min_bars: int = 1000) -> DataFrame:
    """Trades of an imbalance signal, one position at a time, held ``hold`` bars.

    Thresholds are the ``q`` and ``1 - q`` quantiles of the first ``frac`` of a coin's bars; the rest is
    traded. The greedy choice of entries is parallel over islands: a signal at least ``hold`` bars after
    the previous signal is always taken, so only signals closer than that are folded in order.
    """
    bars = numbered(stored(bars, "bars"), ["coin"], "bar", SPAN_MS).withColumn("i", F.col("__i").cast("int")).drop("__i")
    sizes = bars.groupBy("coin").agg(F.count("*").alias("n"))
    rows = stored(bars.join(sizes, "coin").filter(F.col("n") >= min_bars).withColumn("split", F.floor(F.col("n") * frac)), "bars")
    cuts = quantiles(rows.filter(F.col("i") < F.col("split")), ["coin"], "obi", {"hi": q, "lo": 1 - q})
    live = rows.filter((F.col("i") >= F.col("split")) & (F.col("i") < F.col("n") - hold)).join(cuts, "coin")
    signals = live.filter((F.col("obi") >= F.col("hi")) | (F.col("obi") <= F.col("lo"))).select("coin", "i")
    by_i = Window.partitionBy("coin").orderBy("i")
    starts = (F.coalesce(F.col("i") - F.lag("i").over(by_i), F.lit(hold)) >= hold).cast("int")
    islands = signals.withColumn("island", F.sum(starts).over(by_i)).groupBy("coin", "island").agg(F.array_sort(F.collect_list(F.col("i").cast("int"))).alias("at"))
    empty = F.array().cast("array<int>")
    taken = F.aggregate("at", empty, lambda a, i: F.when((F.size(a) == 0) | (i >= F.element_at(a, F.greatest(F.size(a), F.lit(1))) + hold), F.concat(a, F.array(i))).otherwise(a))
    entries = islands.select("coin", F.explode(F.when(F.size("at") == 1, F.col("at")).otherwise(taken)).alias("i"))
    ends = rows.select("coin", (F.col("i") - hold).alias("i"), F.col("bar").alias("exit"), F.col("mid").alias("exit_mid"), F.col("spread_bps").alias("exit_spread"))
    t = entries.join(live, ["coin", "i"]).join(ends, ["coin", "i"])
    side = F.when(F.col("obi") >= F.col("hi"), 1).otherwise(-1)
    gross = side * (safe_ratio(F.col("exit_mid"), F.col("mid")) - 1) * 10_000
    cost = (F.col("spread_bps") + F.col("exit_spread")) / 2 + 2 * fee_bps
    return t.select("coin", F.col("bar").alias("entry"), "exit", F.when(side > 0, "long").otherwise("short").alias("side"), F.col("mid").alias("entry_mid"), "exit_mid",
                    gross.alias("gross_bps"), cost.alias("cost_bps"), (gross - cost).alias("net_bps"))


def gated_ledger(rows: DataFrame, cost_bps: float, predicted: str = "prediction", value: str = "target_fund") -> DataFrame:
    """A round trip for every run of rows predicted positive: ``(coin, entry, exit, hold_h, funding_bps, net_bps)``."""
    w = Window.partitionBy("coin").orderBy("hour")
    numbered = rows.withColumn("k", F.row_number().over(w)).filter(F.col(predicted) == 1)
    runs = numbered.withColumn("run", F.col("k") - F.row_number().over(w)).groupBy("coin", "run").agg(
        F.min("hour").alias("entry"), F.max("hour").alias("exit"), F.count("*").alias("hold_h"), (F.sum(value) * 10_000).alias("funding_bps"))
    return runs.drop("run").withColumns({"cost_bps": F.lit(cost_bps), "net_bps": F.col("funding_bps") - cost_bps})


def always_on(rows: DataFrame, cost_bps: float, value: str = "target_fund") -> DataFrame:
    """One round trip over the same rows."""
    return rows.groupBy("coin").agg(F.count("*").alias("hours"), (F.sum(value) * 10_000 - cost_bps).alias("always_on_bps"))


def summary(ledger: DataFrame, keys: list[str]) -> DataFrame:
    """Trades, win shares, averages, totals and the median hold."""
    share = lambda c: F.avg((F.col(c) > 0).cast("double")) * 100
    return ledger.groupBy(*keys).agg(
        F.count("*").alias("trades"), share("gross_bps").alias("gross_win_pct"), share("net_bps").alias("net_win_pct"), F.avg("gross_bps").alias("avg_gross"),
        F.avg("net_bps").alias("avg_net"), F.sum("net_bps").alias("total_net"), F.median(F.col("exit") - F.col("entry")).alias("median_hold_ms"))


def pooled_path(ledger: DataFrame, n_coins: int, range_parts: int = 64) -> DataFrame:
    """Running net over all coins in exit order, over ``n_coins``.

    A prefix sum over range partitions: sums of earlier partitions (one row each) are added to the
    running sum inside a partition, so no task holds all trades.
    """
    cuts = ledger.agg(F.percentile_approx("exit", [i / range_parts for i in range(1, range_parts)], 10_000).alias("cuts"))
    part = F.size(F.filter("cuts", lambda c: F.col("exit") > c))
    rows = ledger.crossJoin(F.broadcast(cuts)).withColumn("part", part).drop("cuts")
    sums = rows.groupBy("part").agg(F.sum("net_bps").alias("s"))
    before = sums.select("part", F.coalesce(F.sum("s").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("before"))
    w = Window.partitionBy("part").orderBy("exit", "coin", "entry").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("run", F.sum("net_bps").over(w)).join(F.broadcast(before), "part").select("coin", "entry", "exit", ((F.col("run") + F.col("before")) / n_coins).alias("pooled_net"))
