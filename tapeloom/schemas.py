"""Explicit schemas of the market tables; nothing is inferred from files."""

from __future__ import annotations

from pyspark.sql import types as T


def _of(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


_D, _L, _S, _I, _TS = T.DoubleType(), T.LongType(), T.StringType(), T.IntegerType(), T.TimestampType()

FUNDING = _of(ts=_TS, coin=_S, funding_rate=_D, premium=_D)
CANDLES = _of(ts=_TS, coin=_S, open=_D, close=_D, high=_D, low=_D, volume=_D)
TRADES = _of(captured_ms=_L, trade_ms=_L, coin=_S, side=_S, px=_D, sz=_D, notional=_D, tid=_L, hash=_S, users_buyer=_S, users_seller=_S)
BBO = _of(captured_ms=_L, bbo_ms=_L, coin=_S, bid_px=_D, bid_sz=_D, ask_px=_D, ask_sz=_D)
L2BOOK = _of(captured_ms=_L, book_ms=_L, coin=_S, best_bid_px=_D, best_bid_sz=_D, best_ask_px=_D, best_ask_sz=_D, spread=_D,
             bid_depth_10=_D, ask_depth_10=_D, n_bid_lvls=_I, n_ask_lvls=_I, levels_json=_S)
CTX = _of(captured_ms=_L, coin=_S, funding=_D, open_interest=_D, prev_day_px=_D, day_ntl_vlm=_D, premium=_D, oracle_px=_D,
          mark_px=_D, mid_px=_D, day_base_vlm=_D)
LABELS = _of(wallet=_S, total_pnl_usd=_D, n_trades=_L, is_smart=T.BooleanType())
RUNS = _of(config_hash=_S, config=_S, data_span=_S, saved_at=_TS, result=_S)

LAYERS = {"funding": FUNDING, "marks": CANDLES, "spot": CANDLES}
CHANNELS = {"trades": TRADES, "bbo": BBO, "l2book": L2BOOK, "ctx": CTX}
EVENT_MS = {"trades": "trade_ms", "bbo": "bbo_ms", "l2book": "book_ms", "ctx": "captured_ms"}

#: px and sz stay strings: quoted numbers would be null under a DOUBLE schema.
LEVEL = T.StructType([T.StructField("px", _S), T.StructField("sz", _S)])
BOOK = T.ArrayType(T.ArrayType(LEVEL))
