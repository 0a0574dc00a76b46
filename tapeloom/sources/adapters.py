"""Market tables derived from the driver's general tables, so that operators can be run and checked on them.

Each view has the same projection in ``CTES``, for the oracle SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HOUR = 3_600_000
DAY = 86_400_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch_ms(column: str):
    return F.expr(f"timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {column})")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    return read(spark, sf_dir, "events").select("event_id", epoch_ms("ts").alias("ms"), "user_id", "event_type", "value", k.alias("k"))


def _coin(by_leg: bool):
    """The coin of an event on the tape: its type, or the coin of the candle legs."""
    return (F.col("user_id") % 2).cast("string").alias("coin") if by_leg else F.col("event_type").alias("coin")


def trades(spark: SparkSession, sf_dir: str, by_leg: bool = False) -> DataFrame:
    e = events(spark, sf_dir)
    sz = F.col("k") + F.lit(1.0)
    return e.select(
        (F.col("ms") + F.col("k") * 10).alias("captured_ms"), F.col("ms").alias("trade_ms"), _coin(by_leg),
        F.when(F.col("event_id") % 2 == 0, "B").otherwise("A").alias("side"), F.col("value").alias("px"), sz.alias("sz"),
        (F.col("value") * sz).alias("notional"), F.col("event_id").alias("tid"), F.col("user_id").cast("string").alias("users_buyer"),
        ((F.col("user_id") * 7 + 3) % 150).cast("string").alias("users_seller"))


def quotes(spark: SparkSession, sf_dir: str, by_leg: bool = False) -> DataFrame:
    e = events(spark, sf_dir)
    return e.select(
        F.col("ms").alias("captured_ms"), F.col("ms").alias("bbo_ms"), _coin(by_leg), F.col("value").alias("bid_px"),
        (F.col("k") + F.lit(1.0)).alias("bid_sz"), (F.col("value") * (1 + (F.col("k") + 1) / 10000)).alias("ask_px"),
        (F.col("user_id") + F.lit(1.0)).alias("ask_sz"), F.col("event_id").alias("seq"))


def contexts(spark: SparkSession, sf_dir: str, by_leg: bool = False) -> DataFrame:
    e = events(spark, sf_dir)
    return e.select(F.col("ms").alias("captured_ms"), _coin(by_leg), ((F.col("k") - 50) / 1e6).alias("premium"),
                    ((F.col("user_id") - 75) / 1e6).alias("funding"), F.col("event_id").alias("seq"))


def _hourly_last(spark: SparkSession, sf_dir: str, kind: str, name: str) -> DataFrame:
    e = events(spark, sf_dir).filter(F.col("event_type") == kind)
    hour = (F.floor(F.col("ms") / HOUR) * HOUR).alias("hour")
    coin = (F.col("user_id") % 2).cast("string").alias("coin")
    return e.groupBy(coin, hour).agg(F.max_by("value", F.struct("ms", "event_id")).alias(name))


def marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hourly_last(spark, sf_dir, "view", "perp")


def spot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hourly_last(spark, sf_dir, "click", "spot")


def funding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hourly_last(spark, sf_dir, "purchase", "raw").select("coin", "hour", ((F.col("raw") - 50) / 1e4).alias("funding_rate"))


def daily_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean order price by priority and day: five long daily series."""
    o = read(spark, sf_dir, "orders")
    return o.groupBy(F.col("o_orderpriority").alias("series"), F.to_date("o_orderdate").alias("day")).agg(F.round(F.avg("o_totalprice"), 6).alias("close"))


def books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order book for each order: its lines are asks, sorted by price, with quoted numbers."""
    line = read(spark, sf_dir, "lineitem").filter("l_quantity > 0")
    px = F.round(F.col("l_extendedprice") / F.col("l_quantity"), 9)
    asks = line.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(px.alias("px"), F.col("l_quantity").alias("sz"), F.col("l_linenumber").alias("n")))).alias("a"))
    text = lambda c: F.transform(c, lambda x: F.struct(x["px"].cast("string").alias("px"), x["sz"].cast("string").alias("sz")))
    best = F.col("a")[0]["px"]
    bids = F.array(F.struct((best * 0.999).cast("string").alias("px"), F.lit("1.0").alias("sz")))
    return asks.select((F.col("l_orderkey") % 7).cast("string").alias("coin"), F.col("l_orderkey").alias("captured_ms"), (best * 0.999).alias("best_bid_px"),
                       best.alias("best_ask_px"), F.to_json(F.array(bids, text(F.col("a")))).alias("levels_json"))


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier by ship month: mean price (mark) and mean discount (funding)."""
    line = read(spark, sf_dir, "lineitem")
    month = F.year("l_shipdate") * 12 + F.month("l_shipdate")
    return line.groupBy(F.col("l_suppkey").cast("string").alias("coin"), month.cast("long").alias("hour")).agg(
        F.round(F.avg("l_extendedprice"), 6).alias("mark"), F.round(F.avg("l_discount"), 9).alias("funding_rate"))


CTES = {
    "ev": """ev AS (SELECT event_id, epoch_us(ts) // 1000 AS ms, user_id, event_type, value, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)""",
    "tr": """tr AS (SELECT ms + k * 10 AS captured_ms, ms AS trade_ms, event_type AS coin, CASE WHEN event_id % 2 = 0 THEN 'B' ELSE 'A' END AS side,
  value AS px, k + 1.0::DOUBLE AS sz, value * (k + 1.0::DOUBLE) AS notional, event_id AS tid, CAST(user_id AS VARCHAR) AS users_buyer,
  CAST((user_id * 7 + 3) % 150 AS VARCHAR) AS users_seller FROM ev)""",
    "qu": """qu AS (SELECT ms AS bbo_ms, event_type AS coin, value AS bid_px, k + 1.0::DOUBLE AS bid_sz, value * (1 + (k + 1) / 10000.0::DOUBLE) AS ask_px,
  user_id + 1.0::DOUBLE AS ask_sz, event_id AS seq FROM ev)""",
    "cx": """cx AS (SELECT ms AS captured_ms, event_type AS coin, (k - 50) / 1e6 AS premium, (user_id - 75) / 1e6 AS funding, event_id AS seq FROM ev)""",
    "mk": """mk AS (SELECT CAST(user_id % 2 AS VARCHAR) AS coin, ms // 3600000 * 3600000 AS hour, arg_max(value, (ms, event_id)) AS perp FROM ev WHERE event_type = 'view' GROUP BY 1, 2)""",
    "sp": """sp AS (SELECT CAST(user_id % 2 AS VARCHAR) AS coin, ms // 3600000 * 3600000 AS hour, arg_max(value, (ms, event_id)) AS spot FROM ev WHERE event_type = 'click' GROUP BY 1, 2)""",
    "fu": """fu AS (SELECT CAST(user_id % 2 AS VARCHAR) AS coin, ms // 3600000 * 3600000 AS hour, (arg_max(value, (ms, event_id)) - 50) / 1e4 AS funding_rate FROM ev WHERE event_type = 'purchase' GROUP BY 1, 2)""",
    "dp": """dp AS (SELECT o_orderpriority AS series, CAST(o_orderdate AS DATE) AS day, round(avg(o_totalprice), 6) AS close FROM orders GROUP BY 1, 2)""",
    "pn": """pn AS (SELECT CAST(l_suppkey AS VARCHAR) AS coin, CAST(year(l_shipdate) * 12 + month(l_shipdate) AS BIGINT) AS hour, round(avg(l_extendedprice), 6) AS mark,
  round(avg(l_discount), 9) AS funding_rate FROM lineitem GROUP BY 1, 2)""",
}
NEEDS = {"tr": ["ev"], "qu": ["ev"], "cx": ["ev"], "mk": ["ev"], "sp": ["ev"], "fu": ["ev"]}


def ctes(*names: str) -> str:
    """``WITH`` and the named views, what they need first."""
    order: list[str] = []
    for n in names:
        order += [x for x in [*NEEDS.get(n, []), n] if x not in order]
    return "WITH " + ",\n".join(CTES[n] for n in order)
