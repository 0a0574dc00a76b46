"""Ranks and exact quantiles of large groups without a task that sees a whole group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.sources.layers import stored

#: Bins of a round of selection.
BINS = 1024


def with_average_ranks(rows: DataFrame, keys: list[str], ranks: dict[str, str]) -> DataFrame:
    """``rows`` with a rank from 1 for each ``{value: name}`` among the rows of ``keys``; ties share the mean of their places.

    Equal values are counted first, so a tie never lies on two sides of a border. The counts are dealt by ranges of keys and value; a value's rank
    is what earlier partitions hold of its key, what its partition holds before it, and half of its own count. Nulls have no rank.
    """
    for value, name in ranks.items():
        counts = rows.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("__held"))
        parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        ranged = stored(counts.repartitionByRange(parts, *keys, value).withColumn("__part", F.spark_partition_id()), "ranges")
        earlier = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
        offsets = ranged.groupBy(*keys, "__part").agg(F.sum("__held").alias("__all")).withColumn("__before", F.coalesce(F.sum("__all").over(earlier), F.lit(0))).drop("__all")
        inside = Window.partitionBy(*keys, "__part").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
        placed = ranged.withColumn("__up", F.sum("__held").over(inside)).join(offsets, [*keys, "__part"])
        rank = F.col("__before") + F.col("__up") - (F.col("__held") - 1) / 2
        rows = rows.join(placed.select(*keys, value, rank.alias(name)), [*keys, value], "left")
    return rows


def quantiles(rows: DataFrame, keys: list[str], value: str, probs: dict[str, float], bins: int = BINS) -> DataFrame:
    """``(keys, names)``: exact quantiles of the non-null values, interpolated between neighbours, for ``{name: share}``.

    The two order statistics of each quantile are selected: values between its bounds are counted in equal bins, the bin that holds its place
    gives the next bounds, its least and largest value, until these are one. A round moves counts only, and each looks at fewer values.
    """
    held = stored(rows.select(*keys, F.col(value).cast("double").alias("v")).filter("v is not null and not isnan(v)"), "values")
    sizes = held.groupBy(*keys).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    asked = F.array(*[F.struct(F.lit(n).alias("name"), (F.lit(float(q)) * (F.col("n") - 1)).alias("at")) for n, q in probs.items()])
    ends = F.array(F.struct(F.lit("below").alias("side"), F.floor("q.at").alias("place")), F.struct(F.lit("above").alias("side"), F.ceil("q.at").alias("place")))
    wanted = sizes.withColumn("q", F.explode(asked)).withColumn("e", F.explode(ends))
    own = [*keys, "name", "side"]
    state = stored(wanted.select(*keys, "q.name", "e.side", "e.place", (F.col("q.at") - F.floor("q.at")).alias("part"), "lo", "hi"), "bounds")
    while state.filter("lo < hi").head(1):
        live = state.filter("lo < hi")
        # Places count from the least value between the bounds.
        bounded = held.join(live, keys) if keys else held.crossJoin(live)
        bin_ = F.least(F.lit(bins - 1), F.floor((F.col("v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2) * bins))
        counts = bounded.filter("v between lo and hi").groupBy(*own, "place", "part", bin_.alias("bin")).agg(F.count("*").alias("held"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        before = F.sum("held").over(Window.partitionBy(*own).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)) - F.col("held")
        chosen = counts.withColumn("before", before).filter("place >= before and place < before + held")
        narrowed = chosen.select(*keys, "name", "side", (F.col("place") - F.col("before")).alias("place"), "part", "lo", "hi", "held")
        # Of two values the place says which.
        one = F.when(F.col("held") == 2, F.when(F.col("place") == 0, F.col("lo")).otherwise(F.col("hi")))
        narrowed = narrowed.withColumns({"lo": F.coalesce(one, "lo"), "hi": F.coalesce(one, "hi")}).drop("held")
        state = stored(state.filter("lo = hi").unionByName(narrowed), "bounds")
    found = state.groupBy(*keys, "name").agg(F.max(F.when(F.col("side") == "below", F.col("lo"))).alias("a"), F.max(F.when(F.col("side") == "above", F.col("lo"))).alias("b"), F.max("part").alias("part"))
    found = found.withColumn("x", F.when(F.col("a") == F.col("b"), F.col("a")).otherwise((1 - F.col("part")) * F.col("a") + F.col("part") * F.col("b")))
    picked = [F.max(F.when(F.col("name") == n, F.col("x"))).alias(n) for n in probs]
    return found.groupBy(*keys).agg(*picked) if keys else found.agg(*picked)


def numbered(rows: DataFrame, keys: list[str], time: str, span: int) -> DataFrame:
    """``rows`` with ``__i``, the place from 0 in time order of the key; no task sees more than ``span`` of time of a key.

    Places within a stretch of time follow what the key's earlier stretches hold. ``rows`` is read twice: store it before.
    """
    stretch = rows.withColumn("__t", F.floor(F.col(time) / span))
    before = F.sum("__n").over(Window.partitionBy(*keys).orderBy("__t").rowsBetween(Window.unboundedPreceding, -1))
    counts = stretch.groupBy(*keys, "__t").agg(F.count("*").alias("__n")).withColumn("__first", F.coalesce(before, F.lit(0))).drop("__n")
    inside = F.row_number().over(Window.partitionBy(*keys, "__t").orderBy(time)) - 1
    return stretch.withColumn("__k", inside).join(counts, [*keys, "__t"]).withColumn("__i", F.col("__first") + F.col("__k")).drop("__t", "__k", "__first")


def in_blocks(rows: DataFrame, keys: list[str], size: int, back: int, ahead: int) -> DataFrame:
    """Rows of ``numbered`` with ``__block`` and ``__own``: blocks of ``size`` rows, each with copies of ``back`` rows before and ``ahead`` rows after it.

    Windows of ``keys`` and ``__block`` that look no farther give for the block's own rows what windows of ``keys`` give.
    """
    own = F.floor(F.col("__i") / size)
    reached = F.sequence(F.greatest(F.lit(0), F.floor((F.col("__i") - ahead) / size)), F.floor((F.col("__i") + back) / size))
    return rows.withColumn("__block", F.explode(reached)).withColumn("__own", F.col("__block") == own)
