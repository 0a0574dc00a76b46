"""Ranks and quantiles against plain sorting."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeloom.operators import order


def values(seed=3):
    """Groups of all shapes: many ties, one value, two values, wide ranges, one large group over all partitions."""
    rng = random.Random(seed)
    held = {"ties": [float(rng.randrange(4)) for _ in range(300)], "one": [5.0], "same": [2.5] * 40, "two": [1.0, 9.0], "wide": [10.0 ** rng.uniform(-30, 30) * rng.choice([-1, 1]) for _ in range(200)],
            "large": [rng.choice([rng.gauss(0, 1), 0.0]) for _ in range(3000)], "huge": [-1.7e308, 1.7e308, 0.0]}
    return [(k, v) for k, vs in held.items() for v in [*vs, None]]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(values(), "k string, v double").repartition(5).persist()


def test_average_ranks(spark, rows):
    got = sorted(((r["k"], r["v"], r["rank"]) for r in order.with_average_ranks(rows, ["k"], {"v": "rank"}).collect()), key=repr)
    want = []
    for k, v in values():
        own = [x for j, x in values() if j == k and x is not None]
        want.append((k, v, None if v is None else sum(x < v for x in own) + (sum(x == v for x in own) + 1) / 2))
    assert got == sorted(want, key=repr)


def test_ranks_plan_has_no_window_over_a_whole_key(spark, rows, capsys):
    order.with_average_ranks(rows, ["k"], {"v": "rank"}).explain()
    windows = [x for x in capsys.readouterr().out.splitlines() if "Window [" in x]
    # One within a range of the keys, one over the partitions' totals.
    assert len(windows) == 2 and sum("__part" in x.split("],")[-2] or "__part" in x for x in windows) == 2


@pytest.mark.parametrize("bins", [2, 7, 1024])
def test_quantiles(spark, rows, bins):
    probs = {"low": 0.0, "tenth": 0.1, "mid": 0.5, "p95": 0.95, "top": 1.0}
    got = {r["k"]: r for r in order.quantiles(rows, ["k"], "v", probs, bins).collect()}
    assert len(got) == 7
    for k, r in got.items():
        own = np.array([x for j, x in values() if j == k and x is not None])
        for name, q in probs.items():
            with np.errstate(over="ignore"):
                want = np.sort(own)
                at = q * (len(want) - 1)
                lo, hi = want[int(np.floor(at))], want[int(np.ceil(at))]
                assert r[name] == pytest.approx(lo if lo == hi else (1 - at % 1) * lo + (at % 1) * hi, rel=1e-12, abs=1e-40)


def test_quantiles_without_keys_or_rows(spark, rows):
    one = order.quantiles(rows.filter("k = 'large'"), [], "v", {"q": 0.8}).first()["q"]
    assert one == pytest.approx(np.quantile([x for j, x in values() if j == "large" and x is not None], 0.8))
    assert order.quantiles(rows.filter("k = 'none'"), [], "v", {"q": 0.8}).collect()[0]["q"] is None
    assert order.quantiles(rows.filter("k = 'none'"), ["k"], "v", {"q": 0.8}).collect() == []
    assert order.quantiles(rows.withColumn("v", F.lit(None).cast("double")), ["k"], "v", {"q": 0.8}).collect() == []


def test_windows_in_blocks_equal_windows_over_the_whole_series(spark):
    """Features at any size of block, over a series with gaps and one shorter than a block's border."""
    from tapeloom.operators import features

    rng = random.Random(9)
    hours = [h for h in range(400) if rng.random() < 0.7]
    rows = [(c, h * 3_600_000, 1 + rng.random(), 1 + rng.random(), rng.gauss(0, 1)) for c, held in (("a", hours), ("b", hours[:20])) for h in held]
    df = spark.createDataFrame(rows, "coin string, hour bigint, spot double, perp double, funding_rate double").repartition(4).persist()
    legs = df.select("coin", "hour", "spot"), df.select("coin", "hour", "perp"), df.select("coin", "hour", "funding_rate")

    def made(block):
        return {(r["coin"], r["hour"]): [None if x is None else round(x, 12) for x in r[2:]] for r in features.feature_matrix(*legs, complete=False, block=block).collect()}

    whole = made(100_000)
    assert len(whole) == len(rows) and made(7) == whole and made(50) == whole
    spot = {(c, h): s for c, h, s, *_ in rows}
    for (c, h), found in whole.items():  # by hand: the return over 24 rows, and the target
        own = sorted(x for k, x in spot if k == c)
        i = own.index(h)
        back = round(spot[c, h] / spot[c, own[i - 24]] - 1, 12) if i >= 24 else None
        assert found[features.FEATURES.index("spot_ret_24")] == back
        assert (found[-1] is None) == (i == len(own) - 1)
    place = order.numbered(df, ["coin"], "hour", 13 * 3_600_000).collect()
    assert sorted((r["coin"], r["hour"], r["__i"]) for r in place) == sorted((c, h, sorted(x for k, x in spot if k == c).index(h)) for c, h in spot)
