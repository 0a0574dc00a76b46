"""Boosted trees and forests of many keys and seeds against plain searches."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeloom.operators import boosting as b

COLUMNS = ["u", "v", "w"]


def data(n=160, coins=("x", "y"), seed=1):
    rng = random.Random(seed)
    out = []
    for c in coins:
        for i in range(n):
            u, v, w = rng.uniform(-1, 1), rng.choice([0.0, 1.0, 2.0]), rng.gauss(0, 1)
            out.append((c, i * 3_600_000, u, v, w, int(u + 0.3 * v + 0.2 * w > 0.3), u * v))
    return out


SCHEMA = "coin string, hour bigint, u double, v double, w double, label int, y double"


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(data(), SCHEMA).repartition(3).persist()


def nodes(trees, *more):
    return sorted(map(tuple, trees.select("coin", "seed", "tree", "node", "feature", "cut", "value", "cover", *more).collect()), key=repr)


def plain_tree(x, g, h, size, depth, ids=None):
    """The best splits over all cuts, by trying each of them: ``{node: (feature, cut, value, cover)}``."""
    out = {}

    def power(rows):
        return sum(g[i] for i in rows) ** 2 / (sum(h[i] for i in rows) + size.l2)

    def grow(node, rows, level):
        G, H = sum(g[i] for i in rows), sum(h[i] for i in rows)
        out[node] = [-1, None, -G / (H + size.l2) * size.rate, H]
        best = (1e-6, None)
        if level < depth:
            for f in range(x.shape[1]):
                for cut in sorted(set(cuts[f])):
                    left, right = [i for i in rows if x[i, f] <= cut], [i for i in rows if x[i, f] > cut]
                    if left and right and sum(h[i] for i in left) >= size.least and sum(h[i] for i in right) >= size.least:
                        gain = power(left) + power(right) - power(rows)
                        if gain > best[0] + 1e-12:
                            best = (gain, (f, cut, left, right))
        if best[1]:
            f, cut, left, right = best[1]
            out[node][:2] = [f, cut]
            grow(2 * node + 1, left, level + 1)
            grow(2 * node + 2, right, level + 1)

    cuts = [[float(np.percentile(x[:, f], 100 * k / size.bins)) for k in range(1, size.bins)] for f in range(x.shape[1])]
    grow(0, list(range(len(x))), 0)
    return out


def test_first_trees_are_the_best_splits_over_all_cuts(spark, rows):
    size = b.Size(rounds=2, depth=3, bins=16)
    got = {c: {} for c in "xy"}
    for c, _, tree, node, *rest in nodes(b.fit(rows, ["coin"], COLUMNS, size=size)):
        got[c].setdefault(tree, {})[node] = rest
    for c in "xy":
        held = [r for r in data() if r[0] == c]
        x, y = np.array([r[2:5] for r in held]), np.array([r[5] for r in held], float)
        p = y.mean()
        assert got[c][-1][0][2] == pytest.approx(math.log(p / (1 - p)))
        margin = np.full(len(y), math.log(p / (1 - p)))
        for tree in range(2):
            q = 1 / (1 + np.exp(-margin))
            want = plain_tree(x, q - y, q * (1 - q), size, 3)
            assert {n: (f, pytest.approx(cut), pytest.approx(v, abs=1e-7), pytest.approx(h, abs=1e-6)) for n, (f, cut, v, h) in want.items()} == {n: tuple(r) for n, r in got[c][tree].items()}
            for i, r in enumerate(x):
                node = 0
                while want[node][0] >= 0:
                    node = 2 * node + 1 + int(r[want[node][0]] > want[node][1])
                margin[i] += want[node][2]


@pytest.mark.parametrize("size", [b.Size(rounds=3, depth=3, subsample=0.7), b.Size(rounds=2, depth=2, bagged=True, tried=2, l2=0.0, rate=1.0, objective="squared")])
def test_blocks_and_partitions_change_nothing(spark, rows, size):
    """Keys of several blocks exchange sums; the trees are those of one block, to the last bit."""
    one = nodes(b.fit(rows, ["coin"], COLUMNS, size=size, seeds=[0, 1]))
    uneven = spark.createDataFrame(data(), SCHEMA).repartition(7)
    assert nodes(b.fit(uneven, ["coin"], COLUMNS, size=size, seeds=[0, 1], block=40)) == one
    assert {r[1] for r in one} == {0, 1} and [r[2:] for r in one if r[1] == 0] != [r[2:] for r in one if r[1] == 1]


def test_margins_learn(spark, rows):
    size = b.Size(rounds=40)
    trees = b.fit(rows, ["coin"], COLUMNS, size=size).persist()
    scored = b.margins(rows, trees, ["coin"], COLUMNS, keep=["label"], size=size)
    right = scored.agg(F.avg(((F.col("margin") > 0).cast("int") == F.col("label")).cast("double"))).first()[0]
    assert right > 0.9 and scored.count() == 320
    # Rows in blocks of their own give the same margins.
    again = b.margins(rows, trees, ["coin"], COLUMNS, keep=["label"], size=size)
    assert sorted(map(tuple, scored.collect())) == sorted(map(tuple, again.collect()))
    squared = b.Size(rounds=60, objective="squared", rate=0.2)
    fitted = b.margins(rows, b.fit(rows, ["coin"], COLUMNS, label="y", size=squared), ["coin"], COLUMNS, keep=["y"], size=squared)
    error = fitted.agg(F.sqrt(F.avg(F.pow(F.col("margin") - F.col("y"), F.lit(2)))).alias("e"), F.stddev("y").alias("sd")).first()
    assert error["e"] < 0.35 * error["sd"]
    wood = b.forest(3, trees=30)
    shares = b.margins(rows, b.fit(rows, ["coin"], COLUMNS, size=wood), ["coin"], COLUMNS, keep=["label"], size=wood).collect()
    assert all(0 <= r["margin"] <= 1 for r in shares) and np.mean([(r["margin"] > 0.5) == r["label"] for r in shares]) > 0.9


def subsets(x, tree, features):
    """Shapley values of one row and one tree by enumeration of all subsets of known features."""
    feature, cut, value, cover = tree

    def expected(node, known):
        f = feature[node]
        if f < 0:
            return value[node]
        if f in known:
            return expected(2 * node + 1 + int(x[f] > cut[node]), known)
        return sum(cover[k] / cover[node] * expected(k, known) for k in (2 * node + 1, 2 * node + 2))

    out = []
    for i in range(features):
        others = [f for f in range(features) if f != i]
        total = 0.0
        for k in range(features):
            weight = math.factorial(k) * math.factorial(features - k - 1) / math.factorial(features)
            total += weight * sum(expected(0, {*s, i}) - expected(0, set(s)) for s in itertools.combinations(others, k))
        out.append(total)
    return out, expected(0, set())


def test_shapley_values_equal_all_subsets():
    rng = np.random.default_rng(0)
    for depth in (1, 3, 4):
        n = 2 ** (depth + 1) - 1
        feature = np.array([rng.integers(0, 5) if k < 2**depth - 1 else -1 for k in range(n)])
        cover = np.zeros(n)
        for k in range(n - 1, -1, -1):
            cover[k] = rng.integers(1, 9) if feature[k] < 0 else cover[2 * k + 1] + cover[2 * k + 2]
        tree = feature, rng.normal(size=n), np.where(feature < 0, rng.normal(size=n), 0.0), cover
        x = rng.normal(size=(20, 5))
        out = np.zeros((20, 5))
        base = b.shapley_of_tree(x, tree, out)
        for row, got in zip(x, out):
            want, expected = subsets(row, tree, 5)
            assert got == pytest.approx(want, abs=1e-12) and base == pytest.approx(expected)
        assert base + out.sum(1) == pytest.approx(tree[2][b.leaves(x, tree)])


def test_attributions_add_up_to_margins(spark, rows):
    size = b.Size(rounds=12, subsample=0.7)
    trees = b.fit(rows, ["coin"], COLUMNS, size=size, seeds=[3, 4]).persist()
    margin = {(r["coin"], r["hour"], r["seed"]): r["margin"] for r in b.margins(rows, trees, ["coin"], COLUMNS, size=size).collect()}
    parts = b.shapley(rows, trees, ["coin"], COLUMNS, size=size)
    assert {r["feature"] for r in parts.select("feature").distinct().collect()} == {*COLUMNS, "(base)"}
    sums = {(r["coin"], r["hour"], r["seed"]): r["s"] for r in parts.groupBy("coin", "hour", "seed").agg(F.sum("attribution").alias("s")).collect()}
    assert len(sums) == 640 and sums == {k: pytest.approx(v, abs=1e-9) for k, v in margin.items()}


def test_keys_without_a_split_and_no_rows(spark):
    flat = spark.createDataFrame([("x", 1, 0.0, 0.0, 0.0, 1, 1.0), ("x", 2, 0.0, 0.0, 0.0, 1, 1.0)], SCHEMA)
    made = nodes(b.fit(flat, ["coin"], COLUMNS, size=b.Size(rounds=2)))
    assert [(r[2], r[3], r[4]) for r in made] == [(-1, 0, -1), (0, 0, -1), (1, 0, -1)]
    none = b.fit(flat.limit(0), ["coin"], COLUMNS, size=b.Size(rounds=2))
    assert none.collect() == [] and none.columns == ["coin", "seed", "tree", "node", "feature", "cut", "value", "cover"]
    assert b.margins(flat, none, ["coin"], COLUMNS).collect() == []
