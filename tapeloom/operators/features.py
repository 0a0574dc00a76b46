"""Leakage-safe hourly features: everything looks back, only the target looks ahead."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.operators.align import DAY_MS, HOUR_MS, by_time, leg_panel, outer_fusion, safe_ratio
from tapeloom.operators.bars import hourly_context, hourly_quotes, hourly_taker
from tapeloom.operators.flow import hourly_cohort
from tapeloom.operators.order import in_blocks, numbered
from tapeloom.sources.layers import stored

#: Rows that returns and lags look back, and rows of a rolling value.
RETURNS, LAGS, ROLLED = (1, 24), (1, 4, 24), 24
#: The 18 model inputs; the current funding rate is not one.
FEATURES = [
    "basis", *[f"{leg}_ret_{k}" for k in RETURNS for leg in ("spot", "perp")], *[f"{of}_lag_{k}" for of in ("basis", "funding") for k in LAGS],
    *[f"{of}_{ROLLED}" for of in ("basis_std", "funding_mean", "funding_std")], *[f"{of}_{f}" for of in ("hour", "dow") for f in ("sin", "cos")],
]
TAPE_FEATURES = ["obi_mean", "spread_bps_mean", "taker_imbalance", "premium_mean", "premium_last"]


#: Rows of a coin that one task computes features of; 24 rows before and one after come with them.
BLOCK_ROWS = 100_000


def feature_matrix(spot: DataFrame, perp: DataFrame, funding: DataFrame, complete: bool = True, block: int = BLOCK_ROWS) -> DataFrame:
    """``(coin, hour, features, funding_rate, target_fund, label)``; with ``complete``, rows without a null only.

    A coin's rows are dealt in blocks with the rows that lags and rolled values look back to, and the one that the target looks ahead to.
    """
    w = by_time(["coin", "__block"], "hour")
    back = w.rowsBetween(1 - ROLLED, 0)

    def rolled(f, c: str):
        return F.when(F.count(c).over(back) == ROLLED, f(c).over(back))

    p = stored(leg_panel(spot, perp, funding), "panel")
    p = in_blocks(numbered(p, ["coin"], "hour", block * HOUR_MS), ["coin"], block, max(*RETURNS, *LAGS, ROLLED - 1), 1)
    p = p.withColumn("basis", safe_ratio(F.col("perp") - F.col("spot"), F.col("spot")))
    cols = {}
    for leg in ("spot", "perp"):
        for k in RETURNS:
            cols[f"{leg}_ret_{k}"] = safe_ratio(F.col(leg), F.lag(leg, k).over(w)) - 1
    for name, c in (("basis", "basis"), ("funding", "funding_rate")):
        for k in LAGS:
            cols[f"{name}_lag_{k}"] = F.lag(c, k).over(w)
    for of, f, c in (("basis_std", F.stddev_samp, "basis"), ("funding_mean", F.avg, "funding_rate"), ("funding_std", F.stddev_samp, "funding_rate")):
        cols[f"{of}_{ROLLED}"] = rolled(f, c)
    hour = F.floor(F.col("hour") / HOUR_MS) % 24
    weekday = (F.floor(F.col("hour") / DAY_MS) + 3) % 7  # 1970-01-01 was a Thursday; Monday is 0
    for name, x, n in (("hour", hour, 24), ("dow", weekday, 7)):
        cols[f"{name}_sin"], cols[f"{name}_cos"] = F.sin(x * (2 * math.pi / n)), F.cos(x * (2 * math.pi / n))
    cols["target_fund"] = F.lead("funding_rate").over(w)
    out = p.withColumns(cols).withColumn("label", (F.col("target_fund") > 0).cast("int"))
    out = out.filter("__own").select("coin", "hour", *FEATURES, "funding_rate", "target_fund", "label")
    return out.dropna(subset=[*FEATURES, "target_fund"]) if complete else out


def tape_features(quotes: DataFrame, trades: DataFrame, ctx: DataFrame, smart: DataFrame | None = None) -> DataFrame:
    """Hourly fusion of the channels; an hour that a channel lacks has null columns for it."""
    parts = [hourly_quotes(quotes), hourly_taker(trades), hourly_context(ctx)]
    return outer_fusion(parts if smart is None else [*parts, hourly_cohort(trades, smart)], ["coin", "hour"])


def fused(candle: DataFrame, tape: DataFrame, columns: list[str]) -> DataFrame:
    """Candle features with the tape columns, rows complete in them."""
    return candle.join(tape.select("coin", "hour", *columns), ["coin", "hour"]).dropna(subset=columns)


def time_split(rows: DataFrame, frac: float, keys=("coin",), time_col: str = "hour") -> DataFrame:
    """``is_train``: the first ``int(n * frac)`` rows of each key."""
    n = F.count("*").over(Window.partitionBy(*keys))
    return rows.withColumn("is_train", F.row_number().over(Window.partitionBy(*keys).orderBy(time_col)) <= F.floor(n * frac))
