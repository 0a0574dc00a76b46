"""Cross-sectional funding dispersion: long the lowest, short the highest trailing funding."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.operators.align import day_of, safe_ratio
from tapeloom.operators.stats import annualised


def dispersion(panel: DataFrame, look: int = 720, hold: int = 720, min_alive: int = 10, coverage: float = 0.9) -> DataFrame:
    """Hourly ``(block, hour, ret)`` of every holding block.

    ``panel`` is ``(coin, hour, mark, funding_rate)``; the axis is the sorted distinct hours. At axis
    place ``look + block * hold`` coins are ranked by their mean funding of the ``look`` hours before, a
    fifth at each end is held for ``hold`` hours. Returns are against the previous axis hour, so a coin
    absent there has none. Hours are few and broadcast; each panel row goes to the blocks it serves.
    """
    axis = panel.select("hour").distinct().withColumn("i", F.row_number().over(Window.orderBy("hour")) - 1)
    n = axis.agg(F.count("*").alias("n_axis"))
    rows = panel.join(F.broadcast(axis), "hour").crossJoin(F.broadcast(n))
    before = rows.select("coin", (F.col("i") + 1).alias("i"), F.col("mark").alias("mark0"))
    rows = rows.join(before, ["coin", "i"], "left").withColumn("pnl", safe_ratio(F.col("mark"), F.col("mark0")) - 1 - F.col("funding_rate"))
    valid = (F.col("block") >= 0) & (look + F.col("block") * hold < F.col("n_axis") - 1)
    first, last = F.ceil((F.col("i") - look + 1) / hold), F.floor(F.col("i") / hold)
    looked = rows.withColumn("block", F.explode(F.sequence(first.cast("int"), last.cast("int")))).filter(valid & (F.col("i") < look + F.col("block") * hold) & (F.col("i") >= F.col("block") * hold))
    means = looked.groupBy("block", "coin").agg(F.avg("funding_rate").alias("f"), F.count("funding_rate").alias("held")).filter(F.col("held") / look > coverage)
    w = Window.partitionBy("block")
    ranked = means.withColumns({"alive": F.count("*").over(w), "rank": F.row_number().over(w.orderBy("f", "coin"))}).filter(F.col("alive") >= min_alive)
    k = F.greatest(F.lit(2), F.floor(F.col("alive") / 5))
    picks = ranked.select("block", "coin", F.when(F.col("rank") <= k, 1).when(F.col("rank") > F.col("alive") - k, -1).alias("side")).filter("side is not null")
    held = rows.withColumn("block", F.floor((F.col("i") - look) / hold).cast("int")).filter(valid)
    seg = held.join(picks, ["block", "coin"]).groupBy("block", "hour").agg(
        F.avg(F.when(F.col("side") == -1, F.col("pnl"))).alias("high"), F.avg(F.when(F.col("side") == 1, F.col("pnl"))).alias("low"))
    return seg.select("block", "hour", ((F.col("low") - F.col("high")) / 2).alias("ret")).filter("ret is not null")


def dispersion_risk(hourly: DataFrame, hold_days: float, round_trip: float) -> DataFrame:
    """One row: days, gross and net Sharpe and APR. A block's days are its own; net of both legs re-entered in every block."""
    daily = hourly.groupBy(F.lit("dispersion").alias("series"), "block", day_of("hour").alias("day")).agg(F.sum("ret").alias("ret"))
    daily = daily.withColumn("net", F.col("ret") - 2 * round_trip / hold_days)
    gross, net = (annualised(daily, ["series"], c).select("series", "n", F.col("sharpe").alias(f"{k}_sharpe"), F.col("apr").alias(f"{k}_apr")) for c, k in (("ret", "gross"), ("net", "net")))
    return gross.join(net.drop("n"), "series")
