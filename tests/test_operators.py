"""Hand-computed cases of the table operators."""

import math
import random
import statistics
from datetime import date, datetime, timedelta
from statistics import NormalDist

import pytest
from pyspark.sql import functions as F

from tapeloom.operators import align, bars, book, features, flow, ic, ledger, models, pnl, quality, runs, stats
from tapeloom.sources import layers, messages

H = 3_600_000


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def legs(spark, spot, perp, fund):
    def made(name, values):
        return spark.createDataFrame([("x", i * H, float(v)) for i, v in enumerate(values) if v is not None], f"coin string, hour bigint, {name} double")

    return made("spot", spot), made("perp", perp), made("funding_rate", fund)


def test_basis_drift(spark):
    out = pnl.basis_drift(*legs(spark, [100, 101], [100, 102], [0.0002, 0.0003])).collect()
    assert len(out) == 1
    assert out[0]["drift_pnl"] == pytest.approx(-0.01) and out[0]["pnl"] == pytest.approx(-0.0097)
    assert pnl.basis_drift(*legs(spark, [110, 111], [100, 102], [0, 0])).first()["drift_pnl"] == pytest.approx(-0.01)
    assert pnl.basis_drift(*legs(spark, [100, 101, 105], [100, 101, 105], [0.1, None, 0.2])).agg(F.sum("pnl")).first()[0] == pytest.approx(0.2)


def test_hours_align(spark):
    ts = [(datetime(2024, 1, 1, 0, 59, 59, 999000),), (datetime(2024, 1, 1, 0, 0, 0, 100000),)]
    assert spark.createDataFrame(ts, "ts timestamp").select(align.floor_hour(F.col("ts"))).distinct().count() == 1


def closes(spark, values):
    return spark.createDataFrame([("x", date(2024, 1, 1) + timedelta(i), float(v)) for i, v in enumerate(values)], "series string, day date, close double")


def test_regimes(spark):
    got = pnl.regime_labels(closes(spark, [100, 112, 100, 105]), rows=1).orderBy("day").collect()
    assert [r["regime"] for r in got] == ["calm", "bull", "bear", "calm"]
    marks = spark.createDataFrame([("x", 0, 100.0), ("x", 24 * H, 999.0), ("x", 25 * H, 112.0)], "coin string, hour bigint, perp double")
    assert [r["regime"] for r in pnl.regime_labels(pnl.daily_last(marks), rows=1).orderBy("day").collect()] == ["calm", "bull"]


def daily(spark, series):
    made = [(s, date(2024, 1, 1) + timedelta(i), float(v)) for s, values in series.items() for i, v in enumerate(values)]
    return spark.createDataFrame(made, "series string, day date, ret double")


def test_sharpe(spark):
    got = {r["series"]: r["sharpe"] for r in stats.annualised(daily(spark, {"a": [0.001, 0.002, 0.003], "flat": [0.1, 0.1], "one": [0.5]}), ["series"]).collect()}
    assert got == {"a": pytest.approx(2 * math.sqrt(365)), "flat": 0.0, "one": 0.0}


def test_psr_and_expected_maximum(spark):
    one = spark.createDataFrame([(0.1, 100, 0.0, 3.0, 0.04, 10), (0.1, 100, 0.0, 3.0, 0.0, 10), (0.1, 100, 0.0, 3.0, 0.04, 1)], "sr double, t bigint, skew double, kurt double, v double, n bigint")
    at = stats.psr(F.col("sr"), F.col("t"), F.col("skew"), F.col("kurt"), F.col("sr"))
    got = one.select(at.alias("p"), stats.expected_max_sharpe(F.col("v"), F.col("n")).alias("m")).collect()
    assert got[0]["p"] == pytest.approx(0.5)
    assert got[0]["m"] > 0 and [r["m"] for r in got[1:]] == [0.0, 0.0]


def test_bootstrap(spark):
    d = daily(spark, {"a": [math.sin(i) + 0.3 for i in range(60)], "short": [1.0, 2.0, 3.0]})
    first, again = (rows(stats.bootstrap_sharpe(x, ["series"], resamples=50), "series", "lo", "hi") for x in (d, d.repartition(7)))
    assert first == [(s, pytest.approx(lo), pytest.approx(hi)) for s, lo, hi in again]
    assert first[0][1] < first[0][2] and first[1][1] == first[1][2]


def test_bootstrap_broadcasts_no_draws_and_equals_a_plain_loop(spark):
    import hashlib

    import numpy as np

    rng = random.Random(8)
    held = {"a": [rng.gauss(0.1, 1) for _ in range(47)], "b": [rng.gauss(0, 2) for _ in range(10)], "short": [1.0, 2.0, 4.0], "one": [0.5], "flat": [0.25] * 20}
    out = stats.bootstrap_sharpe(daily(spark, held), ["series"])
    got = {r["series"]: (r["lo"], r["hi"]) for r in out.collect()}
    assert "BroadcastExchange" not in out._jdf.queryExecution().executedPlan().toString()
    for s, v in held.items():
        sharpes, n = [], len(v)
        for r in range(1000):
            own = []
            for b in range(-(-n // 10)):
                at = int(hashlib.md5(f"42-{r}-{b}".encode()).hexdigest()[:8], 16) % max(1, n - 9)
                own += v[at : at + min(10, n - b * 10)]
            sharpes.append(np.mean(own) / np.std(own) * math.sqrt(365) if np.std(own) > 0 else 0.0)
        assert got[s] == (pytest.approx(np.quantile(sharpes, 0.025)), pytest.approx(np.quantile(sharpes, 0.975)))
    assert len(got) == 5


def test_basket_and_common_days(spark):
    d = daily(spark, {"a": [1, 2, 3], "b": [3, 4], "c": [100]})
    assert rows(pnl.basket(d, exclude=("c",)), "ret") == [(2.0,), (3.0,)]
    assert pnl.basket(d.filter("1 = 0")).count() == 0


def test_costs_and_verdict(spark):
    c = pnl.CostModel()
    assert c.round_trip() == pytest.approx(0.0011) and c.round_trip(maker=True) == pytest.approx(0.0003) and c.amortised_daily(0) == 0
    got = spark.createDataFrame([(-0.5,), (0.0,), (1.0,), (1.8,)], "s double").select(pnl.verdict(F.col("s")).alias("v")).collect()
    assert [r["v"] for r in got] == ["not deployable", "not deployable", "marginal", "deployable"]
    net = pnl.net_of_costs(daily(spark, {"a": [0.01, 0.02]}), 0.002, 1.0)
    assert rows(net, "net") == [(pytest.approx(0.0089),), (pytest.approx(0.0189),)]


TRADE = "coin string, trade_ms bigint, tid bigint, side string, px double, sz double, notional double, users_buyer string, users_seller string"


def test_flows_and_bars(spark):
    t = spark.createDataFrame([("x", 0, 1, "B", 100.0, 0.5, 50.0, "aaa", "bbb"), ("x", 10_000, 2, "A", 101.0, 0.3, 30.0, "ccc", "aaa"), ("x", 40_000, 3, "B", 102.0, 0.2, 20.0, "aaa", None)], TRADE)
    smart = spark.createDataFrame([("aaa",)], "wallet string")
    flows = flow.signed_flows(t, smart)
    assert rows(flows, "tid", "inf_net") == [(1, 50.0), (2, -30.0), (3, 20.0)]
    assert rows(bars.flow_bars(flows), "bar", "inf_net", "taker", "px") == [(0, 20.0, 20.0, 101.0), (30_000, 20.0, 20.0, 102.0)]
    both = flow.signed_flows(t, spark.createDataFrame([("aaa",), ("bbb",)], "wallet string"))
    assert rows(both, "tid", "inf_net")[0] == (1, 0.0)
    assert flow.legs(t).count() == 5
    snap = flow.cohort_snapshot(t, smart).first()
    assert (snap["net_notional"], snap["n_legs"], snap["lean"]) == (40.0, 3, "net long")
    assert bars.hourly_taker(t).first()["taker_imbalance"] == pytest.approx(0.4)


def test_quotes_and_fusion(spark):
    q = spark.createDataFrame([("x", 0, 99.0, 2.0, 101.0, 1.0, 1), ("x", 5, 99.0, 1.0, 101.0, 3.0, 2), ("x", 2 * H, 99.0, 1.0, 101.0, 1.0, 3)], "coin string, bbo_ms bigint, bid_px double, bid_sz double, ask_px double, ask_sz double, seq bigint")
    t = spark.createDataFrame([("x", 1, 1, "B", 1.0, 100.0, 100.0, "0xaaa", "b"), ("x", 2, 2, "A", 1.0, 50.0, 50.0, "c", "0xaaa")], TRADE)
    c = spark.createDataFrame([("x", 1, 0.001, 0.1, 1), ("x", 2, 0.003, None, 2)], "coin string, captured_ms bigint, premium double, funding double, seq bigint")
    out = {r["hour"]: r for r in features.tape_features(q, t, c, spark.createDataFrame([("0xaaa",)], "wallet string")).collect()}
    assert out[0]["obi_mean"] == pytest.approx((1 / 3 - 1 / 2) / 2) and out[0]["spread_bps_mean"] == pytest.approx(200)
    assert out[0]["taker_imbalance"] == pytest.approx(1 / 3) and out[0]["premium_last"] == 0.003 and out[0]["ctx_funding_last"] == 0.1
    assert out[0]["cohort_net_share"] == pytest.approx(50 / 300)
    assert out[2 * H]["obi_mean"] == 0 and out[2 * H]["taker_imbalance"] is None


def test_rank_correlation_and_top_decile(spark):
    p = spark.createDataFrame([("x", float(i), float(i * i), 10.0 if i >= 90 else 0.0) for i in range(100)], "coin string, s double, f double, g double")
    assert ic.spearman(p, ["coin"], "s", "f").first()["ic"] == pytest.approx(1.0)
    assert ic.spearman(p, ["coin"], "s", "f", min_n=101).first()["ic"] is None
    assert ic.top_decile(p, ["coin"], "s", "g").first()["move"] == pytest.approx(10.0)


@pytest.mark.parametrize("levels, notional, want", [
    ("[[],[[101,100]]]", 10_000, 0.01), ("[[],[[100,50],[110,50]]]", 10_500, 0.05), ("[[],[[100,1],[1000,100]]]", 1_000, (1000 / 1.9 - 100) / 100),
    ("[[],[[101,1]]]", 10_000, None), ("not json", 10, None), ("[[],[]]", 10, None), ("[[[99,1]]]", 10, None)])
def test_slippage(spark, levels, notional, want):
    import json

    try:
        levels = json.dumps([[{"px": str(p), "sz": str(s)} for p, s in side] for side in json.loads(levels)])
    except ValueError:
        pass
    b = spark.createDataFrame([("x", 100.0, 100.0, levels)], "coin string, best_bid_px double, best_ask_px double, levels_json string")
    got = book.slippage(b, [notional]).first()["slip"]
    assert got == (want if want is None else pytest.approx(want))


def test_every_nth_row(spark):
    b = spark.range(130).select(F.lit("x").alias("coin"), F.col("id").alias("t"))
    assert rows(book.every_nth(b, ["coin"], ["t"]), "t") == [(0,), (60,), (120,)]


def panel(spark, n, change=None):
    spot, perp, fund = ([100 + math.sin(i) for i in range(n)], [100 + math.cos(i) for i in range(n)], [float(i) for i in range(n)])
    if change is not None:
        spot[change], perp[change], fund[change] = 500, 700, 900
    return features.feature_matrix(*legs(spark, spot, perp, fund))


def test_features_shift_and_do_not_look_ahead(spark):
    one = panel(spark, 40).orderBy("hour").collect()
    assert len(features.FEATURES) == 18 and one
    for r in one:
        assert (r["funding_lag_1"], r["funding_lag_4"], r["target_fund"]) == (r["funding_rate"] - 1, r["funding_rate"] - 4, r["funding_rate"] + 1)
    plain, changed = (panel(spark, 48, c).filter(F.col("hour") < 40 * H).select("hour", *features.FEATURES).orderBy("hour").collect() for c in (None, 40))
    assert plain == changed and plain


def test_event_ledger_is_greedy(spark):
    import random

    rng = random.Random(4)
    made = [(c, i * 5000, rng.choice([-1.0, 0.0, 0.0, 1.0, rng.random()]), 100 + rng.random(), rng.random()) for c in "ab" for i in range(600)]
    b = spark.createDataFrame(made, "coin string, bar bigint, obi double, mid double, spread_bps double")
    got = rows(ledger.event_ledger(b, 4.5, hold=7, min_bars=100), "coin", "entry")
    want = []
    for c in "ab":
        g = [r for r in made if r[0] == c]
        first = sorted(r[2] for r in g[:180])
        q = lambda p: first[int(p * 179)] + (p * 179 - int(p * 179)) * (first[min(int(p * 179) + 1, 179)] - first[int(p * 179)])
        hi, lo, i = q(0.9), q(0.1), 180
        while i < 600 - 7:
            if g[i][2] >= hi or g[i][2] <= lo:
                want.append((c, g[i][1]))
                i += 7
            else:
                i += 1
    assert got == sorted(want)
    pooled = ledger.pooled_path(ledger.event_ledger(b, 4.5, hold=7, min_bars=100), 2, range_parts=5).collect()
    total = ledger.event_ledger(b, 4.5, hold=7, min_bars=100).agg(F.sum("net_bps")).first()[0]
    assert max(pooled, key=lambda r: (r["exit"], r["coin"], r["entry"]))["pooled_net"] == pytest.approx(total / 2)


def test_gated_runs(spark):
    d = spark.createDataFrame([("x", i * H, p, 0.001) for i, p in enumerate([0, 1, 1, 0, 1])], "coin string, hour bigint, prediction int, target_fund double")
    assert rows(ledger.gated_ledger(d, 5.0), "entry", "hold_h", "net_bps") == [(H, 2, pytest.approx(15.0)), (4 * H, 1, pytest.approx(5.0))]
    assert ledger.always_on(d, 5.0).first()["always_on_bps"] == pytest.approx(45.0)


def test_guard_and_windows(spark):
    d = spark.createDataFrame([(datetime(2024, 1, 1),), (datetime(2024, 1, 3),)], "ts timestamp")
    assert align.guard_max_ts(d, datetime(2024, 1, 3)).count() == 2
    with pytest.raises(align.LookAhead):
        align.guard_max_ts(d, datetime(2024, 1, 2))


def test_runs(spark, tmp_path):
    a, b = runs.canonical({"strategy": "s", "k": 1}), runs.canonical({"k": 1, "strategy": "s"})
    assert a == b
    made = spark.createDataFrame([(a, "r")], "config string, result string").withColumns({"config_hash": runs.config_hash(F.col("config")), "saved_at": F.current_timestamp()})
    store = made.filter("1 = 0")
    path = str(tmp_path / "runs")
    assert runs.record(made, store, path).count() == 1
    kept = spark.read.schema(made.schema).parquet(path)
    assert runs.unrecorded(made, kept).count() == 0 and len(kept.first()["config_hash"]) == 16
    with pytest.raises(runs.AlreadyRecorded):
        runs.record(made, kept, path, strict=True)
    assert runs.pick(kept, "s", k=1).count() == 1
    with pytest.raises(LookupError):
        runs.pick(kept, "other")


def test_layers(spark, tmp_path):
    d = spark.createDataFrame([(datetime(2024, 1, 1), "dex:ABC", 0.1, 0.0)], "ts timestamp, coin string, funding_rate double, premium double")
    layers.write_layer(d, str(tmp_path), "funding")
    assert layers.load_layer(spark, str(tmp_path), "funding", "dex:ABC").first()["funding_rate"] == 0.1
    with pytest.raises(layers.MissingCoin):
        layers.load_layer(spark, str(tmp_path), "funding", "BTC")


def test_messages(spark):
    raw = spark.createDataFrame([
        (7, '{"channel":"trades","data":[{"coin":"A","side":"B","px":"2.5","sz":"4","time":5,"tid":9,"hash":"h","users":["b","s"]},{"coin":"Z","side":"A","px":"1","sz":"1","time":6,"tid":1,"hash":"h"}]}'),
        (7, '{"channel":"l2Book","data":{"coin":"A","time":5,"levels":[[{"px":"9","sz":"2"}],[{"px":"10","sz":"1"},{"px":"11","sz":"1"}]]}}'),
        (7, '{"channel":"bbo","data":{"coin":"A","time":5,"bbo":[null,{"px":"10","sz":"1"}]}}'),
        (7, '{"channel":"activeAssetCtx","data":{"coin":"A","ctx":{"funding":"0.1","premium":"bad"}}}')], "captured_ms bigint, value string")
    t = messages.trades(raw, ["A"]).collect()
    assert len(t) == 1 and (t[0]["notional"], t[0]["users_seller"]) == (10.0, "s")
    b = messages.l2book(raw).first()
    assert (b["spread"], b["bid_depth_10"], b["ask_depth_10"], b["n_ask_lvls"]) == (1.0, 18.0, 21.0, 2)
    q = messages.bbo(raw).first()
    assert q["bid_px"] is None and q["ask_px"] == 10.0
    c = messages.ctx(raw).first()
    assert c["funding"] == 0.1 and c["premium"] is None and c["mark_px"] is None


def test_freshness_and_coverage(spark):
    t = spark.createDataFrame([("x", 0, 0), ("x", 5 * H, 5 * H)], "coin string, captured_ms bigint, trade_ms bigint")
    assert quality.freshness({"trades": t}, 5 * H + 240_000).first()["stalled"]
    assert quality.hourly_coverage(t, "trade_ms").first()["missing_pct"] == pytest.approx(100 * 4 / 6)


def test_baselines_by_coin(spark):
    rows = lambda held: spark.createDataFrame(held, "coin string, label int")
    train, test = rows([("x", 1), ("x", 1), ("x", 0), ("y", 0)]), rows([("x", 1), ("x", 0), ("x", 1), ("y", 0), ("z", 1)])
    got = {r["coin"]: (r["majority"], r["accuracy"]) for r in models.majority_accuracy(train, test).collect()}
    assert got == {"x": (1, pytest.approx(2 / 3)), "y": (0, 1.0)}
    pairs = spark.createDataFrame([("x", 1.0, 1.0), ("x", 3.0, 1.0), ("x", 0.0, 2.0), ("y", 1.0, 0.0)], "coin string, a double, p double")
    assert {r["coin"]: r["rmse"] for r in models.persistence_rmse(pairs, "a", "p").collect()} == {"x": pytest.approx(math.sqrt(8 / 3)), "y": 1.0}


def test_the_18_inputs_by_name():
    # The inputs of the study, the current funding rate not among them.
    want = {
        "basis", "spot_ret_1", "perp_ret_1", "spot_ret_24", "perp_ret_24", "basis_lag_1", "basis_lag_4", "basis_lag_24", "funding_lag_1", "funding_lag_4",
        "funding_lag_24", "basis_std_24", "funding_mean_24", "funding_std_24", "hour_sin", "hour_cos", "dow_sin", "dow_cos"}
    assert set(features.FEATURES) == want and len(features.FEATURES) == 18


@pytest.mark.parametrize("sr, t, skew, kurt", [(0.2, 50, -0.5, 4.0), (0.2, 1, 0.0, 3.0), (2.0, 10, 3.0, 1.0), (1.0, 0, 1.0, 1.0)])
def test_probabilistic_sharpe_of_degenerate_inputs(spark, sr, t, skew, kurt):
    row = spark.range(1).select(stats.psr(*map(F.lit, (sr, t, skew, kurt, 0.1))).alias("p")).first()
    z = (sr - 0.1) * math.sqrt(max(1, t - 1)) / math.sqrt(max(1e-12, 1 - skew * sr + (kurt - 1) / 4 * sr * sr))
    assert row["p"] == pytest.approx(NormalDist().cdf(z), abs=1e-6)


def test_baselines_deflate_by_all_and_by_hedged_rungs(spark):
    rng = random.Random(4)
    make = lambda mu: spark.createDataFrame([(c, date(2024, 1, 1) + timedelta(k), mu + rng.gauss(0, 0.01)) for c in "ab" for k in range(60)], "series string, day date, ret double")
    window = pnl.one_window({"carry": make(0.002), "drift": make(0.001), "hold": make(0.0)}, exclude=("b",)).persist()
    got = {r["strategy"]: r for r in pnl.strategy_baselines(window, "a", 0.001).collect()}
    assert set(got) == {n for n, *_ in pnl.BASELINES}
    held = {}
    for r in window.collect():
        held.setdefault((r["kind"], r["series"]), []).append(r["ret"])
    assert held["drift", "BASKET_DROP"] == pytest.approx(held["drift", "a"]) and len(held["drift", "BASKET"]) == 60
    ratio = lambda x: statistics.mean(x) / statistics.stdev(x)
    net = lambda kind, series, drag: [x - 0.001 / 60 - drag / 1e4 for x in held[kind, series]]
    rungs = {(s, n): ratio(net(k, s, drag)) for n, k, drag in pnl.LADDER for s in ("a", "b", "BASKET", "BASKET_DROP")}
    for name, kind, series, drag in pnl.BASELINES:
        x = net(kind, series or "a", drag)
        sr, m, n = ratio(x), statistics.mean(x), len(x)
        g1, g2 = (sum((v - m) ** p for v in x) / n / (statistics.pvariance(x) ** (p / 2)) for p in (3, 4))
        skew, kurt = g1 * math.sqrt(n * (n - 1)) / (n - 2), (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * (g2 - 3) + 6) + 3
        for of, trials in (("all", list(rungs.values())), ("hedged", [v for (_, r), v in rungs.items() if r != "funding_only"])):
            k, sd, inv = len(trials), statistics.stdev(trials), NormalDist().inv_cdf
            bar = sd * ((1 - stats.EULER) * inv(1 - 1 / k) + stats.EULER * inv(1 - 1 / (k * math.e)))
            want = NormalDist().cdf((sr - bar) * math.sqrt(n - 1) / math.sqrt(1 - skew * sr + (kurt - 1) / 4 * sr * sr))
            assert got[name][f"n_{of}"] == k and got[name][f"dsr_{of}"] == pytest.approx(want, abs=1e-6)
        assert got[name]["sharpe"] == pytest.approx(sr * math.sqrt(365))


def test_normal_distribution_and_quantile(spark):
    import duckdb
    from statistics import NormalDist

    from tapeloom.functions import normal

    xs = [-38.0, -20.0, -8.5, -7.0710678, -5.0, -2.5, -1.0, -1e-9, 0.0, 0.3, 1.0, 2.0, 7.08, 9.0, 40.0]
    exact = lambda x: 0.5 * math.erfc(-x / math.sqrt(2))
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").coalesce(1).select(normal.norm_cdf(F.col("x"))).collect()]
    assert got == [pytest.approx(exact(x), rel=1e-8, abs=1e-300) for x in xs]
    assert got == [pytest.approx(exact(x), rel=0, abs=1e-14) for x in xs]
    ps = [1e-300, 1e-12, 1e-5, 0.0242, 0.0243, 0.1, 0.5, 0.77, 0.9757, 0.9758, 1 - 1e-9]
    quantiles = [r[0] for r in spark.createDataFrame([(p,) for p in ps], "p double").coalesce(1).select(normal.norm_ppf(F.col("p"))).collect()]
    assert quantiles == [pytest.approx(NormalDist().inv_cdf(p), rel=1e-9, abs=1e-12) for p in ps]
    ends = spark.createDataFrame([(0.0,), (1.0,), (None,)], "p double").coalesce(1).select(normal.norm_ppf(F.col("p"))).collect()
    assert [r[0] for r in ends] == [-math.inf, math.inf, None]
    for text, values, want in ((normal.cdf_sql("v"), xs, got), (normal.ppf_sql("v"), ps[1:], quantiles[1:])):
        values_sql = ", ".join(f"({v!r}::DOUBLE)" for v in values)
        assert [r[0] for r in duckdb.sql(f"SELECT {text} FROM (VALUES {values_sql}) AS t(v)").fetchall()] == [pytest.approx(w, rel=1e-10, abs=1e-300) for w in want]
