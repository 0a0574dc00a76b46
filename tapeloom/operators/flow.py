"""Signed flows, leg tables, wallet labels and cohort aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.operators.align import HOUR_MS, bucket, ms_window, safe_ratio
from tapeloom.operators.bars import rolling_sum
from tapeloom.operators.ic import top_decile, with_horizons
from tapeloom.operators.order import quantiles
from tapeloom.sources.layers import stored

#: Wallets of a cohort, and bytes of their names, up to which its table is broadcast.
COHORT_ROWS, COHORT_BYTES = 200_000, 16_000_000


def _cohort(smart: DataFrame, *names: str) -> list[DataFrame]:
    """The cohort's wallets under each name, flagged; computed once, measured, and broadcast where they are few."""
    smart = stored(smart.select("wallet").distinct(), "cohort")
    rows, size = smart.agg(F.count("*"), F.sum(F.octet_length("wallet"))).first()
    few = rows <= COHORT_ROWS and (size or 0) <= COHORT_BYTES
    each = [smart.select(F.col("wallet").alias(n)).withColumn(f"in_{n}", F.lit(True)) for n in names]
    return [F.broadcast(x) if few else x for x in each]


def signed_flows(trades: DataFrame, smart: DataFrame) -> DataFrame:
    """``inf_net``: + notional if the buyer is in the cohort, - if the seller is; ``taker``: aggressor's sign."""
    buyers, sellers = _cohort(smart, "users_buyer", "users_seller")
    t = trades.join(buyers, "users_buyer", "left").join(sellers, "users_seller", "left")
    part = lambda flag: F.when(F.col(flag), F.col("notional")).otherwise(0.0)
    return t.select(
        "coin", "trade_ms", "tid", "px", "notional", (part("in_users_buyer") - part("in_users_seller")).alias("inf_net"),
        F.when(F.col("side") == "B", F.col("notional")).otherwise(-F.col("notional")).alias("taker"))


def flow_rates(flow_bars: DataFrame, rows: int = 4, places: int = 3) -> DataFrame:
    """``(coin, bar, px, inf_rate, taker_rate)``: cohort and taker flow summed over ``rows`` bars, null until these are there."""
    rate = lambda c: F.round(rolling_sum(c, rows, ["coin"], "bar"), places)
    return flow_bars.select("coin", "bar", "px", rate("inf_net").alias("inf_rate"), rate("taker").alias("taker_rate"))


def informed_edge(rates: DataFrame, spreads: DataFrame, horizon: int, fee_bps: float, min_bars: int = 200) -> DataFrame:
    """``(coin, bars, move_bps, spread_bps, cost_bps, edge_bps)``: the mean move after top-decile cohort flow against a round trip."""
    pairs = with_horizons(rates, "px", {"h": horizon}, "inf_rate")
    moves = top_decile(pairs, ["coin"], "signal", "fwd").select("coin", F.col("move").alias("move_bps"))
    counts = rates.groupBy("coin").agg(F.count("*").alias("bars")).filter(F.col("bars") >= min_bars)
    out = counts.join(moves, "coin").join(spreads.select("coin", F.col("median_spread_bps").alias("spread_bps")), "coin")
    cost = F.col("spread_bps") + 2 * fee_bps
    return out.select("coin", "bars", "move_bps", "spread_bps", cost.alias("cost_bps"), (F.col("move_bps") - cost).alias("edge_bps"))


def legs(trades: DataFrame) -> DataFrame:
    """Two rows a trade, the buyer's and the seller's, from one scan; absent wallets have no leg."""
    leg = lambda wallet, sign: F.struct(F.col(wallet).alias("wallet"), F.lit(sign).alias("sign"))
    out = trades.withColumn("leg", F.explode(F.array(leg("users_buyer", 1), leg("users_seller", -1)))).filter("leg.wallet is not null")
    return out.select("coin", "trade_ms", "px", "sz", "notional", "leg.wallet", "leg.sign", (F.col("leg.sign") * F.col("notional")).alias("signed"))


def last_marks(marks: DataFrame, end_ms: int, ms: str = "ms", close: str = "close") -> DataFrame:
    """``(coin, mark)``: the last close at or before ``end_ms``."""
    return marks.filter(F.col(ms) <= end_ms).groupBy("coin").agg(F.max_by(close, F.when(F.col(close).isNotNull(), F.col(ms))).alias("mark"))


def wallet_positions(trades: DataFrame, end_ms: int) -> DataFrame:
    """``(wallet, coin, position, cash, n_legs)`` up to the freeze."""
    each = legs(ms_window(trades, "trade_ms", 0, end_ms))
    return each.groupBy("wallet", "coin").agg(
        F.sum(F.col("sign") * F.col("sz")).alias("position"), F.sum(-F.col("signed")).alias("cash"), F.count("*").alias("n_legs"))


def wallet_labels(trades: DataFrame, marks: DataFrame, end_ms: int, min_legs: int = 100, q: float = 0.8) -> DataFrame:
    """``(wallet, total_pnl_usd, n_trades, is_smart)``: marked-to-market PnL, the top of active wallets is smart."""
    valued = wallet_positions(trades, end_ms).join(F.broadcast(last_marks(marks, end_ms).filter("mark is not null")), "coin")
    totals = valued.groupBy("wallet").agg(F.sum(F.col("cash") + F.col("position") * F.col("mark")).alias("total_pnl_usd"), F.sum("n_legs").alias("n_trades"))
    totals = stored(totals, "wallets")
    cut = quantiles(totals.filter(F.col("n_trades") >= min_legs), [], "total_pnl_usd", {"cut": q})
    smart = F.coalesce((F.col("n_trades") >= min_legs) & (F.col("total_pnl_usd") >= F.col("cut")), F.lit(False))
    return totals.crossJoin(F.broadcast(cut)).select("wallet", "total_pnl_usd", "n_trades", smart.alias("is_smart"))


def hourly_cohort(trades: DataFrame, smart: DataFrame) -> DataFrame:
    """``(coin, hour, cohort_net_share)`` over both legs."""
    each = legs(trades).join(*_cohort(smart, "wallet"), "wallet", "left")
    net = F.sum(F.when(F.col("in_wallet"), F.col("signed")).otherwise(0.0))
    return each.groupBy("coin", bucket("trade_ms", HOUR_MS).alias("hour")).agg(safe_ratio(net, F.sum("notional")).alias("cohort_net_share"))


def lean(net: Column) -> Column:
    return F.when(net > 0, "net long").when(net < 0, "net short").otherwise("flat")


def cohort_snapshot(trades: DataFrame, smart: DataFrame, start_ms: int = 0, end_ms: int = 1 << 62) -> DataFrame:
    """A row a coin: the cohort's net and turnover, its share of all turnover, and its lean."""
    each = legs(ms_window(trades, "trade_ms", start_ms, end_ms)).join(*_cohort(smart, "wallet"), "wallet", "left")
    of_cohort = lambda c: F.sum(F.when(F.col("in_wallet"), c).otherwise(0.0))
    sums = each.groupBy("coin").agg(
        of_cohort(F.col("signed")).alias("net_notional"), of_cohort(F.col("notional")).alias("cohort_notional"), F.count_if("in_wallet").alias("n_legs"),
        F.sum("notional").alias("total_notional"), F.min("trade_ms").alias("window_start"), F.max("trade_ms").alias("window_end"))
    return sums.withColumns({
        "cohort_share": F.coalesce(safe_ratio(F.col("cohort_notional"), F.col("total_notional")), F.lit(0.0)), "lean": lean(F.col("net_notional")),
        "net_share": F.coalesce(safe_ratio(F.col("net_notional"), F.col("cohort_notional")), F.lit(0.0))})
