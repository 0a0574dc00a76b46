"""Boosted trees and forests of many models at once: histograms by (model, node, feature, bin).

A model is a key (such as a coin) and a seed. Features are cut at exact quantiles of the key's training rows, and the rows are stored as blocks of
bin numbers. Trees grow level by level: every block adds up gradients by (seed, node, feature, bin), the sums over a key's blocks give the best
splits, and the blocks descend. Where one block holds all rows of a key, its sums are the key's, and its trees grow in place, in one job; the keys of
several blocks exchange sums, all keys and seeds together, in one job a level. So the number of jobs depends on neither. Gradients are added up as
integers of ``2 ** -SCALE``, so sums are exact, and the size of blocks and the partitioning change nothing.

Splits and leaves follow the second-order gain with an L2 term on leaf values. ``bagged`` models are forests: each tree has Poisson weights of rows and
``tried`` features a node, and a row's value is the mean over trees. Draws are hashes of seed, tree, node and row.

Nodes are numbered as in a heap. Tree tables have ``(keys, seed, tree, node, feature, cut, value, cover)``: a leaf has feature -1; a row goes left,
to ``2 * node + 1``, where its value is at most ``cut``. The constant that margins start from is tree -1.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.sources.layers import stored

SCALE = 30
#: Rows of a block: hourly rows of one coin over seven years.
BLOCK = 65_536
_GOLD, _M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


@dataclass(frozen=True)
class Size:
    """What a model is: ``objective`` is ``logistic`` (labels 0 and 1, margins in log-odds) or ``squared``."""

    rounds: int = 200
    depth: int = 4
    rate: float = 0.05
    l2: float = 1.0
    least: float = 1.0
    subsample: float = 1.0
    bins: int = 32
    objective: str = "logistic"
    bagged: bool = False
    tried: int = 0

    @property
    def nodes(self) -> int:
        return 2 ** (self.depth + 1) - 1


def forest(columns: int, trees: int = 300, depth: int = 8) -> Size:
    """A forest of ``trees``, trying the root of the number of columns at each node."""
    return Size(rounds=trees, depth=depth, rate=1.0, l2=0.0, objective="squared", bagged=True, tried=max(1, round(math.sqrt(columns))))


def drawn(*parts) -> np.ndarray:
    """Numbers from 0 to 1, a hash of the parts, which are broadcast against each other."""
    x = np.uint64(1)
    with np.errstate(over="ignore"):
        for p in parts:
            x = (x + np.asarray(p).astype(np.uint64)) * _GOLD
            x = (x ^ (x >> np.uint64(30))) * _M1
            x = (x ^ (x >> np.uint64(27))) * _M2
            x = x ^ (x >> np.uint64(31))
    return (x >> np.uint64(11)).astype(np.float64) / 2.0**53


def gradients(size: Size, margin: np.ndarray, y: np.ndarray, seed: int, tree: int, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives of the loss, as integers; 0 for rows that the tree does not see."""
    if size.bagged:
        u, weight, term, below = drawn(seed, tree, ids), np.zeros(len(ids)), math.exp(-1), math.exp(-1)
        for k in range(1, 9):  # Poisson with mean 1
            weight += u >= below
            term /= k
            below += term
        g, h = -weight * y, weight
    else:
        if size.objective == "logistic":
            p = 1 / (1 + np.exp(-margin))
            g, h = p - y, p * (1 - p)
        else:
            g, h = margin - y, np.ones(len(y))
        if size.subsample < 1:
            seen = drawn(seed, tree, ids) < size.subsample
            g, h = g * seen, h * seen
    return np.rint(g * 2**SCALE), np.rint(h * 2**SCALE)


def histogram(bins: np.ndarray, at: np.ndarray, width: int, g: np.ndarray, h: np.ndarray, size: Size) -> np.ndarray:
    """``(2, width, features, bins)``: sums of ``g`` and ``h`` of the rows with ``0 <= at < width``; exact integers below 2 ** 53."""
    rows = np.flatnonzero((at >= 0) & ((g != 0) | (h != 0)))
    n_features = bins.shape[1]
    cell = (at[rows, None] * n_features + np.arange(n_features)) * size.bins + bins[rows]
    shape, cells = (width, n_features, size.bins), width * n_features * size.bins
    return np.stack([np.bincount(cell.ravel(), np.repeat(x[rows], n_features), cells).reshape(shape) for x in (g, h)])


def best_splits(sums: np.ndarray, size: Size, seed: int, tree: int, first: int) -> tuple[np.ndarray, ...]:
    """``(feature, bin, G, H)`` of each node; feature -1 where no split gains. Ties go to the first feature, then the first bin."""
    left = np.cumsum(sums / 2.0**SCALE, axis=3)
    total = left[:, :, :1, -1:]
    right = total - left
    power = lambda x: np.divide(x[0] ** 2, x[1] + size.l2, out=np.zeros_like(x[0]), where=x[1] + size.l2 > 0)
    gain = power(left) + power(right) - power(total)
    gain[(left[1] < size.least) | (right[1] < size.least)] = -1
    gain[:, :, -1] = -1
    if size.tried:
        u = drawn(seed, tree, np.arange(first, first + len(gain))[:, None], np.arange(gain.shape[1]) + 1_000_003)
        gain[np.argsort(np.argsort(u, axis=1), axis=1) >= size.tried] = -1
    flat = gain.reshape(len(gain), -1)
    best = flat.argmax(1)
    feature = np.where(flat[np.arange(len(flat)), best] > 1e-6, best // size.bins, -1)
    return feature, np.where(feature >= 0, best % size.bins, 0), total[0, :, 0, 0], total[1, :, 0, 0]


def leaf_value(g: float, h: float, size: Size) -> float:
    return -g / (h + size.l2) * size.rate if h + size.l2 > 0 else 0.0


class Tree:
    """A tree that grows by levels."""

    def __init__(self, size: Size, features: int):
        self.size, self.level = size, 0
        self.feature, self.bin = np.full(size.nodes, -1), np.zeros(size.nodes, int)
        self.value, self.cover, self.made = np.zeros(size.nodes), np.zeros(size.nodes), np.zeros(size.nodes, bool)
        self.made[0] = True
        self.features = features

    def first(self) -> int:
        return 2**self.level - 1

    def split(self, sums: np.ndarray, seed: int, tree: int) -> bool:
        """Take the sums of the level's nodes; true if there is a next level."""
        lo = self.first()
        feature, at, g, h = best_splits(sums, self.size, seed, tree, lo)
        for k in np.flatnonzero(self.made[lo : lo + len(feature)]):
            node = lo + k
            self.value[node], self.cover[node] = leaf_value(g[k], h[k], self.size), h[k]
            if self.level < self.size.depth and feature[k] >= 0:
                self.feature[node], self.bin[node] = feature[k], at[k]
                self.made[2 * node + 1 : 2 * node + 3] = True
        self.level += 1
        return bool(self.made[self.first() : self.first() + 2**self.level].any()) if self.level <= self.size.depth else False

    def descend(self, bins: np.ndarray) -> np.ndarray:
        """The node each row stands in: a leaf, or the level that is not split yet."""
        node = np.zeros(len(bins), int)
        for _ in range(self.level):
            f = self.feature[node]
            right = bins[np.arange(len(bins)), np.maximum(f, 0)] > self.bin[node]
            node = np.where(f >= 0, 2 * node + 1 + right, node)
        return node

    def sums(self, bins: np.ndarray, g: np.ndarray, h: np.ndarray) -> np.ndarray:
        at = self.descend(bins) - self.first()
        # Leaves need no more than the sums of one column.
        return histogram(bins[:, :1] if self.level == self.size.depth else bins, at, 2**self.level, g, h, self.size)

    def rows(self) -> list[tuple]:
        return [(int(n), int(self.feature[n]), int(self.bin[n]), float(self.value[n]), float(self.cover[n])) for n in np.flatnonzero(self.made)]


def blocks_of(rows: DataFrame, keys: list[str], columns: list[str], label: str, order: str, size: Size, block: int) -> tuple[DataFrame, DataFrame]:
    """``(keys, block, blocks, base, ids, y, bins)`` with matrices as bytes, and ``(keys, cuts)``."""
    steps = F.array(*[F.lit(i / size.bins) for i in range(1, size.bins)])
    cuts = rows.groupBy(*keys).agg(F.array(*[F.array_distinct(F.percentile(c, steps)) for c in columns]).alias("cuts"), F.ceil(F.count("*") / block).alias("blocks"), F.avg(F.col(label).cast("double")).alias("base"))
    dealt = rows.select(*keys, F.col(order).cast("long").alias("__id"), F.col(label).cast("double").alias("__y"), *columns).join(cuts, keys)
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("__id"), F.col("blocks")))
    # The number of cuts below a value: values up to the first cut are in bin 0.
    below = lambda cuts, c: F.size(F.filter(cuts, lambda x: x < F.col(c)))
    bins = F.array(*[below(F.col("cuts")[i], c) for i, c in enumerate(columns)])
    dealt = dealt.select(*keys, "block", "blocks", "base", "__id", "__y", bins.alias("__bins"))

    def pack(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("__id", kind="stable")
        out = df.iloc[:1][[*keys, "block", "blocks", "base"]].copy()
        out["ids"] = [df["__id"].to_numpy(np.int64).tobytes()]
        out["y"] = [df["__y"].to_numpy(np.float64).tobytes()]
        out["bins"] = [np.stack(df["__bins"].to_numpy()).astype(np.uint8).tobytes()]
        return out

    kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    packed = dealt.groupBy(*keys, "block").applyInPandas(pack, f"{kinds}, block bigint, blocks bigint, base double, ids binary, y binary, bins binary")
    return packed, cuts.select(*keys, "cuts")


def unpacked(row: dict, features: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    bins = np.frombuffer(row["bins"], np.uint8).reshape(-1, features).astype(np.int64)
    return bins, np.frombuffer(row["y"], np.float64), np.frombuffer(row["ids"], np.int64)


def start(size: Size, base: float) -> float:
    """The margin that a model starts from: the log-odds of the mean label, or the mean; a forest starts from 0."""
    if size.bagged:
        return 0.0
    if size.objective == "squared":
        return base
    p = min(max(base, 1e-6), 1 - 1e-6)
    return math.log(p / (1 - p))


def grown(row: dict, size: Size, seeds: list[int], features: int) -> Iterator[tuple]:
    """All trees of a key whose rows are one block: ``(seed, tree, node, feature, bin, value, cover)``."""
    bins, y, ids = unpacked(row, features)
    for seed in seeds:
        margin = np.full(len(y), start(size, row["base"]))
        yield (seed, -1, 0, -1, 0, float(start(size, row["base"])), 0.0)
        for k in range(size.rounds):
            tree = Tree(size, features)
            g, h = gradients(size, margin, y, seed, k, ids)
            while tree.split(tree.sums(bins, g, h), seed, k):
                pass
            if not size.bagged:
                margin += tree.value[tree.descend(bins)]
            for r in tree.rows():
                yield (seed, k, *r)


_ROW = "seed int, tree int, node int, feature int, bin int, value double, cover double"


def _in_place(blocks: DataFrame, keys: list[str], size: Size, seeds: list[int], features: int) -> DataFrame:
    kinds = ", ".join(f"`{k}` {blocks.schema[k].dataType.simpleString()}" for k in keys)
    names = [x.split()[0] for x in _ROW.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                made = list(zip(*grown(row, size, seeds, features)))
                own = [pa.array([row[k]] * len(made[0]), b.schema.field(k).type) for k in keys]
                rest = [pa.array(x, pa.int32() if i < 5 else pa.float64()) for i, x in enumerate(made)]
                yield pa.RecordBatch.from_arrays([*own, *rest], [*keys, *names])

    return blocks.mapInArrow(run, f"{kinds}, {_ROW}")


def _exchanged(blocks: DataFrame, keys: list[str], size: Size, seeds: list[int], features: int) -> list[tuple]:
    """Trees of the keys of several blocks: one job a level adds up the sums of all blocks of all keys and seeds.

    The driver holds the trees of these keys, which are few: they have more than ``BLOCK`` rows each.
    """
    blocks = blocks.persist()
    bases = {tuple(r[k] for k in keys): r["base"] for r in blocks.select(*keys, "base").distinct().collect()}
    forests: dict[tuple, list[Tree]] = {(key, seed): [] for key in bases for seed in seeds}
    kinds = ", ".join(f"`{k}` {blocks.schema[k].dataType.simpleString()}" for k in keys)

    def level(number: int) -> dict[tuple, np.ndarray]:
        held = blocks.sparkSession.sparkContext.broadcast(forests)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for row in b.to_pylist():
                    key = tuple(row[k] for k in keys)
                    bins, y, ids = unpacked(row, features)
                    for seed in seeds:
                        *done, tree = held.value[key, seed]
                        if tree.level > size.depth or not tree.made[tree.first() : tree.first() + 2**tree.level].any():
                            continue
                        margin = np.full(len(y), start(size, row["base"]))
                        if not size.bagged:
                            for t in done:
                                margin += t.value[t.descend(bins)]
                        sums = tree.sums(bins, *gradients(size, margin, y, seed, number, ids))
                        node, feature, at = np.nonzero((sums != 0).any(axis=0))
                        columns = [pa.array([row[k]] * len(node), b.schema.field(k).type) for k in keys]
                        columns += [pa.array(x.astype(np.int32)) for x in (np.full(len(node), seed), node, feature, at)]
                        columns += [pa.array(s[node, feature, at].astype(np.int64)) for s in sums]
                        yield pa.RecordBatch.from_arrays(columns, [*keys, "seed", "node", "feature", "bin", "g", "h"])

        sums = blocks.mapInArrow(run, f"{kinds}, seed int, node int, feature int, bin int, g bigint, h bigint")
        cells = F.collect_list(F.struct("node", "feature", "bin", "g", "h")).alias("cells")
        totals = sums.groupBy(*keys, "seed", "node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).groupBy(*keys, "seed").agg(cells)
        out = {}
        for r in totals.toLocalIterator():
            model = (tuple(r[k] for k in keys), r["seed"])
            out[model] = np.zeros((2, 2 ** forests[model][-1].level, features, size.bins))
            for c in r["cells"]:
                out[model][:, c["node"], c["feature"], c["bin"]] = c["g"], c["h"]
        held.unpersist()
        return out

    try:
        for number in range(size.rounds):
            for trees in forests.values():
                trees.append(Tree(size, features))
            live = True
            while live:
                live = False
                for model, sums in level(number).items():
                    live |= forests[model][-1].split(sums, model[1], number)
    finally:
        blocks.unpersist()
    rows = [(*key, seed, -1, 0, -1, 0, float(start(size, bases[key])), 0.0) for key, seed in forests]
    return rows + [(*key, seed, k, *r) for (key, seed), trees in forests.items() for k, t in enumerate(trees) for r in t.rows()]


def fit(rows: DataFrame, keys: list[str], columns: list[str], label: str = "label", order: str = "hour", size: Size = Size(), seeds: list[int] = [42], block: int = BLOCK) -> DataFrame:
    """The tree table of a model for each key of ``rows`` and each seed; rows have no null in ``columns``."""
    blocks, cuts = blocks_of(rows, keys, columns, label, order, size, block)
    found = _in_place(blocks.filter("blocks = 1"), keys, size, seeds, len(columns))
    if rows.groupBy(*keys).count().filter(F.col("count") > block).head(1):
        made = _exchanged(blocks.filter("blocks > 1"), keys, size, seeds, len(columns))
        found = found.unionByName(rows.sparkSession.createDataFrame(made, found.schema))
    cut = F.when(F.col("feature") >= 0, F.col("cuts")[F.col("feature")][F.col("bin")])
    return stored(found.join(cuts, keys).select(*keys, "seed", "tree", "node", "feature", cut.alias("cut"), "value", "cover"), "trees")


def with_trees(rows: DataFrame, trees: DataFrame, keys: list[str], columns: list[str], order: str, keep: list[str], made, out: str, block: int = BLOCK) -> DataFrame:
    """``(keys, order, keep, seed, columns of out)``: ``made(matrix, model)`` of each block of rows with each seed's trees of its key."""
    kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in [*keys, order, *keep])
    rows = rows.join(trees.select(*keys).distinct(), keys, "left_semi")
    count = rows.groupBy(*keys).agg(F.ceil(F.count("*") / block).alias("blocks"))
    dealt = rows.select(*keys, order, *keep, *[c for c in columns if c not in keep]).join(count, keys).withColumn("__block", F.pmod(F.xxhash64(order), F.col("blocks"))).drop("blocks")
    dealt_trees = trees.join(count, keys).withColumn("__block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    names = [x.split()[0] for x in out.split(", ")]

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        x = left[columns].to_numpy(dtype=float)
        parts = []
        for seed, own in right.groupby("seed"):
            part = left[[*keys, order, *keep]].copy()
            part["seed"] = np.int32(seed)
            values = made(x, arrays_of(own))
            for n, v in zip(names, values):
                part[n] = list(v) if v.ndim > 1 else v
            parts.append(part)
        return pd.concat(parts, ignore_index=True)

    return dealt.groupBy(*keys, "__block").cogroup(dealt_trees.groupBy(*keys, "__block")).applyInPandas(run, f"{kinds}, seed int, {out}")


def arrays_of(own: pd.DataFrame) -> tuple[float, list[tuple[np.ndarray, ...]]]:
    """The constant, and ``(feature, cut, value, cover)`` by node of each tree."""
    base, trees = 0.0, []
    for number, t in own.sort_values(["tree", "node"]).groupby("tree"):
        if number < 0:
            base = float(t["value"].iloc[0])
            continue
        n = int(t["node"].max()) + 1
        feature, cut, value, cover = np.full(n, -1), np.zeros(n), np.zeros(n), np.zeros(n)
        at = t["node"].to_numpy()
        feature[at], cut[at], value[at], cover[at] = t["feature"], t["cut"].fillna(0.0), t["value"], t["cover"]
        trees.append((feature, cut, value, cover))
    return base, trees


def leaves(x: np.ndarray, tree: tuple[np.ndarray, ...]) -> np.ndarray:
    feature, cut, *_ = tree
    node, rows = np.zeros(len(x), int), np.arange(len(x))
    while (live := feature[node] >= 0).any():
        at = feature[node]
        node = np.where(live, 2 * node + 1 + (x[rows, np.maximum(at, 0)] > cut[node]), node)
    return node


def margins(rows: DataFrame, trees: DataFrame, keys: list[str], columns: list[str], order: str = "hour", keep: list[str] = [], size: Size = Size()) -> DataFrame:
    """``(keys, order, keep, seed, margin)``: log-odds of a logistic model, else the predicted value."""

    def made(x: np.ndarray, model: tuple) -> list[np.ndarray]:
        base, found = model
        total = np.full(len(x), base)
        for t in found:
            total += t[2][leaves(x, t)]
        return [total / max(len(found), 1) if size.bagged else total]

    return with_trees(rows, trees, keys, columns, order, keep, made, "margin double")


def shapley_of_tree(x: np.ndarray, tree: tuple[np.ndarray, ...], out: np.ndarray) -> float:
    """Add the tree's exact Shapley values to ``out``; gives its expected value.

    For each leaf, the features of its path either let a row through or not, and a feature that is not known passes the share of covers that goes
    the path's way. The weights of subsets of known features by size are the coefficients of a polynomial of the other features, so each leaf costs
    the square of its path's features, not the number of subsets.
    """
    feature, cut, value, cover = tree
    expected = 0.0
    paths = [(0, {}, {})]  # node, share of covers by feature, rows let through by feature
    while paths:
        node, share, through = paths.pop()
        if feature[node] >= 0:
            f = int(feature[node])
            right = x[:, f] > cut[node]
            for child, goes in ((2 * node + 1, ~right), (2 * node + 2, right)):
                part = cover[child] / cover[node] if cover[node] > 0 else 0.0
                paths.append((child, share | {f: share.get(f, 1.0) * part}, through | {f: through[f] & goes if f in through else goes}))
            continue
        expected += value[node] * math.prod(share.values())
        m = len(share)
        for f in share:
            # Coefficient k: of the subsets of k other features, what a row passes through on these and by share on the rest.
            poly = [np.ones(len(x)), *[np.zeros(len(x))] * (m - 1)]
            for other in share:
                if other != f:
                    poly = [share[other] * poly[k] + (through[other] * poly[k - 1] if k else 0) for k in range(m)]
            weights = [math.factorial(k) * math.factorial(m - 1 - k) / math.factorial(m) for k in range(m)]
            out[:, f] += value[node] * (through[f] - share[f]) * sum(w * p for w, p in zip(weights, poly))
    return expected


def shapley(rows: DataFrame, trees: DataFrame, keys: list[str], columns: list[str], order: str = "hour", size: Size = Size()) -> DataFrame:
    """Long ``(keys, order, seed, feature, attribution)``: exact Shapley values; with ``(base)`` they add up to the row's margin."""

    def made(x: np.ndarray, model: tuple) -> list[np.ndarray]:
        base, found = model
        out = np.zeros((len(x), len(columns)))
        for t in found:
            base += shapley_of_tree(x, t, out)
        scale = max(len(found), 1) if size.bagged else 1
        return [np.column_stack([out, np.full(len(x), base)]) / scale]

    wide = with_trees(rows, trees, keys, columns, order, [], made, "parts array<double>")
    names = F.array(*[F.lit(c) for c in [*columns, "(base)"]])
    long = wide.select(*keys, order, "seed", F.explode(F.arrays_zip(names.alias("feature"), F.col("parts").alias("attribution"))).alias("p"))
    return long.select(*keys, order, "seed", F.col("p.feature").alias("feature"), F.col("p.attribution").alias("attribution"))
