"""Model operators and their registered queries: sizes of the study, every coin on its own, all of them in one pass."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeloom.operators import boosting, features, ledger, models, stats
from tapeloom.plans import catalog
from tapeloom.plans import models as plans

H, SF = 3_600_000, "/root/testdata/sf0.01"
COLUMNS = ["basis", "other"]
SCHEMA = "coin string, hour bigint, basis double, other double, funding_rate double, target_fund double, label int"


def made(n=260, coins=("x", "y"), seed=2):
    """In coin y the sign follows the other column; z has too few rows for a model."""
    rng = random.Random(seed)
    out = []
    for c in (*coins, "z"):
        for i in range(n if c != "z" else 20):
            b, o = rng.uniform(-1, 1), rng.uniform(-1, 1)
            sign = (b if c == "x" else o) + rng.gauss(0, 0.2)
            out.append((c, i * H, b, o, rng.uniform(-1, 1), sign * 0.01, int(sign > 0)))
    return out


@pytest.fixture(scope="module")
def rows(spark):
    return models.enough(spark.createDataFrame(made(), SCHEMA).repartition(3), 200).persist()


def test_families_by_coin(spark, rows):
    got = {(r["coin"], r["family"]): r for r in models.compare(rows, columns=COLUMNS, rounds=30, trees=20).collect()}
    assert set(got) == {(c, f) for c in "xy" for f in ("boosted", "forest", "logistic", "majority")}
    for (_, family), r in got.items():
        assert r["n"] == 78 and (r["auc"] is None if family == "majority" else r["auc"] > 0.9 and r["accuracy"] > 0.8)


def test_skill_is_the_share_of_ordered_pairs(spark):
    rng = random.Random(1)
    held = [(k, rng.choice([0.1, 0.2, 0.5, 0.7, 0.9]), rng.randrange(2)) for k in "ab" for _ in range(40)] + [("one", 0.3, 1)]
    got = {r["k"]: r for r in models.skill(spark.createDataFrame(held, "k string, p double, label int"), ["k"]).collect()}
    for k in "ab":
        pos, neg = ([p for c, p, y in held if c == k and y == v] for v in (1, 0))
        assert got[k]["auc"] == pytest.approx(sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / len(pos) / len(neg))
        assert got[k]["accuracy"] == pytest.approx(np.mean([(p > 0.5) == y for c, p, y in held if c == k]))
    assert got["one"]["auc"] is None and got["one"]["n"] == 1


def test_logistic_is_the_minimum_of_its_loss(spark, rows):
    held = [r for r in made() if r[0] == "x"]
    m = models.logistic(rows, COLUMNS).filter("coin = 'x'").first()
    x, y = np.array([r[2:4] for r in held]), np.array([r[6] for r in held])
    z = (x - x.mean(0)) / x.std(0)
    w, b = np.array(m["weight"]), m["intercept"]
    p = 1 / (1 + np.exp(-(z @ w + b)))
    assert z.T @ (p - y) + w == pytest.approx([0, 0], abs=1e-6) and (p - y).sum() == pytest.approx(0, abs=1e-5)
    parts = models.logistic_attribution(models.logistic(rows, COLUMNS), rows, COLUMNS).filter("coin = 'x'").groupBy("hour").agg(F.sum("attribution").alias("s")).collect()
    assert {r["hour"]: r["s"] + b for r in parts} == {r[1]: pytest.approx(v) for r, v in zip(held, z @ w + b)}


def test_drivers_and_their_stability(spark, rows):
    found = {r["coin"]: r for r in models.sign_summary(rows, k=1, columns=COLUMNS, rounds=20).collect()}
    assert {c: r["feature"] for c, r in found.items()} == {"x": "basis", "y": "other"} and found["x"]["n_test"] == 78
    stable = {r["coin"]: (r["leader"], r["lead_share"]) for r in models.stability(rows, [0, 1, 2], columns=COLUMNS, rounds=10).collect()}
    assert stable == {"x": ("basis", 1.0), "y": ("other", 1.0)}
    rmse = {(r["coin"], r["forecast"]): r["rmse"] for r in models.magnitude(rows, columns=COLUMNS, rounds=60).collect()}
    assert all(rmse[c, "boosted"] < 0.01 < rmse[c, "last_value"] for c in "xy")


def test_walk_forward_equals_a_loop_over_folds(spark, rows):
    """Each stretch after the first 70 % is scored by a model of all rows before it, and of no others."""
    size = boosting.Size(rounds=8)
    got = {(r["coin"], r["hour"]): r["p"] for r in models.walk_forward(rows, folds=3, size=size, columns=COLUMNS).collect()}
    want = {}
    for c in "xy":
        own = sorted(r for r in made() if r[0] == c)
        n = len(own)
        first = math.floor(n * 0.7)
        fold = [math.floor((i - first) * 3 / (n - first)) for i in range(first, n)]
        for k in range(3):
            lo, hi = first + fold.index(k), first + len(fold) - fold[::-1].index(k)
            scored = models.boosted_scores(spark.createDataFrame(own[:lo], SCHEMA), spark.createDataFrame(own[lo:hi], SCHEMA), size, columns=COLUMNS)
            want |= {(r["coin"], r["hour"]): r["p"] for r in scored.collect()}
    assert len(want) == 2 * 78 and got == want


def test_gated_ledger_equals_a_loop_over_hours(spark):
    rng = random.Random(5)
    held = [(c, i * H, rng.randrange(2), rng.uniform(-1, 1)) for c in "ab" for i in range(60)]
    got = sorted(map(tuple, ledger.gated_ledger(spark.createDataFrame(held, "coin string, hour bigint, prediction int, target_fund double"), 18.0).select("coin", "entry", "exit", "hold_h", "funding_bps", "net_bps").collect()))
    want = []
    for c in "ab":
        run = []
        for r in [*(r for r in held if r[0] == c), (c, None, 0, 0.0)]:
            if r[2]:
                run.append(r)
            elif run:
                total = sum(x[3] for x in run) * 10_000
                want.append((c, run[0][1], run[-1][1], len(run), pytest.approx(total), pytest.approx(total - 18)))
                run = []
    assert got == want


def test_sizes_of_the_study():
    assert plans.SEEDS == [0, 1, 2, 3, 4] and plans.COIN_ROWS == 200
    size = boosting.Size()
    assert (size.rounds, size.depth, size.rate) == (200, 4, 0.05) and boosting.forest(18).rounds == 300 and boosting.forest(18).depth == 8


@pytest.mark.parametrize("name, columns", [("driver_stability", ["coin", "leader", "lead_share"]), ("model_gated_ledger", ["coin", "entry", "exit", "hold_h", "funding_bps", "cost_bps", "net_bps"])])
def test_whole_queries_end_at_full_size(spark, name, columns):
    """200 rounds for each coin and seed; a table without a coin of 200 rows gives the same columns and no rows."""
    got = catalog.QUERIES[name](spark, SF)
    assert got.columns == columns and {r["coin"] for r in got.collect()} == {"0", "1"}
    none = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert none.columns == columns and none.collect() == []


def test_bootstrap_has_a_thousand_resamples(spark, monkeypatch):
    seen, whole = [], stats.bootstrap_sharpe

    def run(*args, **kw):
        seen.append(kw.get("resamples", 1000))
        return whole(*args, **kw)

    monkeypatch.setattr(stats, "bootstrap_sharpe", run)
    catalog.QUERIES["bootstrap_interval"](spark, "/root/testdata/sf0.001")
    assert seen == [1000] and len(features.FEATURES) == 18
