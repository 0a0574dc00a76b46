"""Stall alerts inside a stream: state and an event-time timer for each feed.

A feed (the key columns) is stalled from ``stall_ms`` after a row until its next row; that row recovers it. Rows may come out of order within the
watermark's delay: the state keeps stretches of rows that follow each other within ``stall_ms``, so it grows with the gaps of the delay and not with
the rows, and nothing is said before the watermark is past it. Rows behind the watermark are dropped, as in all stateful operators.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STALL_MS = 240_000


def merged(lo: list[int], hi: list[int], times: list[int], stall_ms: int) -> tuple[list[int], list[int]]:
    """Stretches of old stretches and new times, in order; two are one if less than ``stall_ms`` lies between them."""
    los, his = [], []
    for a, b in sorted([*zip(lo, hi), *((t, t) for t in times)]):
        if his and a - his[-1] < stall_ms:
            his[-1] = max(his[-1], b)
        else:
            los.append(a)
            his.append(b)
    return los, his


def decided(stalled: bool, lo: list[int], hi: list[int], watermark: int, stall_ms: int) -> tuple[list[tuple[str, int, int]], bool, list[int], list[int]]:
    """``(kind, last_ms, at_ms)`` of what no later row can change, and what is left of the state."""
    said = []
    while True:
        if not stalled and hi[0] + stall_ms <= watermark:
            said.append(("stall", hi[0], hi[0] + stall_ms))
            stalled = True
        elif stalled and len(lo) > 1 and lo[1] <= watermark:
            said.append(("recovered", hi[0], lo[1]))
            stalled, lo, hi = False, lo[1:], hi[1:]
        else:
            return said, stalled, lo, hi


def stall_alerts(rows: DataFrame, keys: list[str], ms: str = "captured_ms", stall_ms: int = STALL_MS, delay: str = "10 minutes") -> DataFrame:
    """``(keys, kind, last_ms, at_ms)`` of a stream: the feed's last row, and when the stall began or ended."""
    held = rows.filter(F.col(ms).isNotNull()).select(*keys, F.col(ms).cast("long").alias("ms"), F.timestamp_millis(ms).alias("event_time")).withWatermark("event_time", delay)
    schema = held.schema
    out = ", ".join([*(f"`{k}` {schema[k].dataType.simpleString()}" for k in keys), "kind string", "last_ms bigint", "at_ms bigint"])

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        stalled, lo, hi = state.get if state.exists else (False, [], [])
        watermark = max(0, state.getCurrentWatermarkMs())
        times = [] if state.hasTimedOut else [int(t) for b in batches for t in b["ms"]]
        # After a stall is told, a row of before it can only be a late one.
        lo, hi = merged(list(lo), list(hi), [t for t in times if not stalled or t >= hi[0] + stall_ms], stall_ms)
        if not lo:
            return
        said, stalled, lo, hi = decided(bool(stalled), lo, hi, watermark, stall_ms)
        state.update((stalled, lo, hi))
        if not stalled or len(lo) > 1:
            state.setTimeoutTimestamp(max(watermark + 1, hi[0] + stall_ms if not stalled else lo[1]))
        if said:
            yield pd.DataFrame([(*key, *s) for s in said], columns=[*keys, "kind", "last_ms", "at_ms"])

    return held.groupBy(*keys).applyInPandasWithState(run, out, "stalled boolean, lo array<bigint>, hi array<bigint>", "append", GroupStateTimeout.EventTimeTimeout)


def stall_table(rows: DataFrame, keys: list[str], as_of_ms: int, ms: str = "captured_ms", stall_ms: int = STALL_MS) -> DataFrame:
    """The same rows from a table, as of a time that all rows are before: gaps between neighbours, and the silence after the last one."""
    times = rows.filter(F.col(ms).isNotNull()).select(*keys, F.col(ms).alias("last_ms")).distinct()
    following = F.lead("last_ms").over(Window.partitionBy(*keys).orderBy("last_ms"))
    gaps = times.withColumn("next", following).filter(F.coalesce("next", F.lit(as_of_ms)) - F.col("last_ms") >= stall_ms)
    kinds = F.array(F.struct(F.lit("stall").alias("kind"), (F.col("last_ms") + stall_ms).alias("at_ms")), F.struct(F.lit("recovered").alias("kind"), F.col("next").alias("at_ms")))
    return gaps.select(*keys, "last_ms", F.explode(kinds).alias("k")).filter("k.at_ms is not null").select(*keys, "k.kind", "last_ms", "k.at_ms")
