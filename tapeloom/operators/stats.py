"""Risk statistics of daily return series, one row per key."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions.normal import norm_cdf, norm_ppf

DAYS = 365
EULER = 0.5772156649015329


def annualised(daily: DataFrame, keys: list[str], value: str = "ret") -> DataFrame:
    """``(keys, n, sharpe, apr, vol)``: 365 days, sample deviation; a flat series has Sharpe 0."""
    sums = daily.filter(F.col(value).isNotNull()).groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mu"), F.stddev_samp(value).alias("sd"))
    sharpe = F.coalesce(F.when(F.col("sd") > 0, F.col("mu") / F.col("sd") * math.sqrt(DAYS)), F.lit(0.0))
    return sums.select(*keys, "n", sharpe.alias("sharpe"), (F.col("mu") * DAYS).alias("apr"), F.coalesce(F.col("sd") * math.sqrt(DAYS), F.lit(0.0)).alias("vol"))


def psr_inputs(daily: DataFrame, keys: list[str], value: str = "ret") -> DataFrame:
    """``(keys, sr, t, skew, kurt)``: per-observation Sharpe, bias-adjusted skew and non-excess kurtosis."""
    x = daily.filter(F.col(value).isNotNull()).groupBy(*keys).agg(
        F.count(value).alias("t"), F.avg(value).alias("mu"), F.stddev_samp(value).alias("sd"), F.skewness(value).alias("g1"), F.kurtosis(value).alias("g2"))
    n = F.col("t").cast("double")
    flat = ~F.coalesce(F.col("sd") > 0, F.lit(False))
    skew = F.when(flat | (n <= 2), 0.0).otherwise(F.col("g1") * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0)))
    excess = (n - 1) / F.nullif((n - 2) * (n - 3), F.lit(0.0)) * ((n + 1) * F.col("g2") + 6)
    kurt = F.when(flat | (n <= 3), 3.0).otherwise(excess + 3)
    return x.select(*keys, F.when(flat, 0.0).otherwise(F.col("mu") / F.col("sd")).alias("sr"), "t", skew.alias("skew"), kurt.alias("kurt"))


def psr_z(sr: Column, t: Column, skew: Column, kurt: Column, sr_star: Column) -> Column:
    """The argument of the normal distribution in the probabilistic Sharpe ratio; the variance is 1e-12, the observations less one are 1, at least."""
    variance = F.greatest(F.lit(1e-12), 1 - skew * sr + (kurt - 1) / 4 * sr * sr)
    return (sr - sr_star) * F.sqrt(F.greatest(F.lit(1.0), t - 1.0)) / F.sqrt(variance)


def psr(sr: Column, t: Column, skew: Column, kurt: Column, sr_star: Column) -> Column:
    return norm_cdf(psr_z(sr, t, skew, kurt, sr_star))


def expected_max_sharpe(var_sr: Column, n_trials: Column) -> Column:
    """Of ``n_trials`` unskilled trials; 0 for fewer than two or without variance."""
    n = F.greatest(n_trials.cast("double"), F.lit(2.0))
    best = (1 - EULER) * norm_ppf(1 - 1 / n) + EULER * norm_ppf(1 - 1 / (n * math.e))
    return F.when((n_trials < 2) | (var_sr <= 0) | var_sr.isNull(), 0.0).otherwise(F.sqrt(var_sr) * best)


def deflated(daily: DataFrame, keys: list[str], value: str = "net") -> DataFrame:
    """Deflated Sharpe of every key, the keys being the trials: their count and Sharpe variance set the bar."""
    inputs = psr_inputs(daily, keys, value)
    with_bar = inputs.crossJoin(F.broadcast(deflation_bar(inputs)))
    return with_bar.withColumn("dsr", psr(F.col("sr"), F.col("t"), F.col("skew"), F.col("kurt"), F.col("sr_star")))


def deflation_bar(trials: DataFrame) -> DataFrame:
    """One row ``(n_trials, var_sr, sr_star)`` of trials with their ``sr``."""
    sums = trials.agg(F.count("*").alias("n_trials"), F.coalesce(F.var_samp("sr"), F.lit(0.0)).alias("var_sr"))
    return sums.withColumn("sr_star", expected_max_sharpe(F.col("var_sr"), F.col("n_trials")))


def indexed(daily: DataFrame, keys: list[str], order: str = "day") -> DataFrame:
    return daily.withColumn("i", F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1)


def bootstrap_sharpe(daily: DataFrame, keys: list[str], value: str = "ret", resamples: int = 1000, block: int = 10, seed: int = 42, ci: float = 0.95) -> DataFrame:
    """``(keys, lo, hi)``: moving-block bootstrap interval of the annualised Sharpe.

    Block starts are MD5 sums of ``seed-resample-block``, so partitioning never changes them. A
    series shorter than a block is taken whole. Deviations inside a resample are of the population.
    """
    rows = indexed(daily.filter(F.col(value).isNotNull()), keys).select(*keys, "i", F.col(value).alias("v"))
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    # The block from each start; the last starts of a series have shorter ones.
    each = rows.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(block - 1)))).withColumn("s", (F.col("i") - F.col("k")).cast("bigint")).filter("s >= 0")
    blocks = each.groupBy(*keys, "s").agg(F.array_sort(F.collect_list(F.struct("k", "v"))).alias("held"))
    draws = sizes.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))))
    draws = draws.withColumn("b", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / block).cast("int") - 1)))
    digest = F.conv(F.substring(F.md5(F.concat_ws("-", F.lit(seed), "r", "b")), 1, 8), 16, 10).cast("bigint")
    draws = draws.withColumn("s", F.pmod(digest, F.greatest(F.lit(1), F.col("n") - block + 1)))
    # Draws come from one row a series, so Spark takes them for small and would broadcast them all.
    drawn = draws.join(blocks.hint("merge"), [*keys, "s"])
    rest = F.least(F.lit(block), F.col("n") - F.col("b") * block).cast("int")
    drawn = drawn.select(*keys, "r", F.explode(F.slice("held", F.lit(1), rest)).alias("d")).groupBy(*keys, "r").agg(F.avg("d.v").alias("mu"), F.stddev_pop("d.v").alias("sd"))
    sharpe = F.coalesce(F.when(F.col("sd") > 0, F.col("mu") / F.col("sd") * math.sqrt(DAYS)), F.lit(0.0))
    tail = (1 - ci) / 2
    return drawn.groupBy(*keys).agg(F.percentile(sharpe, F.lit(tail)).alias("lo"), F.percentile(sharpe, F.lit(1 - tail)).alias("hi"))


def regime_sharpe(daily: DataFrame, labels: DataFrame, min_days: int = 10) -> DataFrame:
    """``(series, regime, n, sharpe, apr, vol)`` of the cells with ``min_days`` or more."""
    return annualised(daily.join(labels, ["series", "day"]), ["series", "regime"]).filter(F.col("n") >= min_days)
