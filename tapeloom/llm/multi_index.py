"""Near-duplicate vectors by an inverted multi-index: cosine links, their counts and components.

Independent codebooks of the two halves of the unit vectors form a grid of cells. Each vector lies in one cell and visits cells in order of
what a neighbour would have to move to lie there: the squared distances to the borders between its own centroid's region and the other's,
added over both halves. A multi-sequence walk over the two sorted lists of centroids yields cells in just this order, and stops at the bound
that ``recall`` of all neighbours at the threshold itself stay within; closer neighbours stay within it more often. The bound is measured on
vectors of the fit's sample, moved to the threshold in random directions. Pairs of a visitor and a vector of the visited cell are verified by
their cosine in double precision.

Equal vectors form one node of a weight, so copies cost nothing further. A cell is compared in blocks of bounded size, each a task's group of
its own, as matrix products; a block gives sums of links and a forest of its links, never pairs. A pair that both of its vectors would find
counts once: in the cell of the larger node. Codebooks are fitted on at most ``CENTROIDS * PER_CENTROID`` distinct vectors, those of least
hash, so neither partitions nor copies change them; all vectors are indexed and all visit.

Defined results: vectors that are null, empty or zero, that hold null or non-finite components or have another length than most (ties: the
longest), link with nothing and are their own component; a null id is never the smallest of a component that has others; rows that repeat an
id are vectors of their own; an empty table gives no rows. Only the id and the vector are read, so other columns cannot clash.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.llm.common import join_hot, session_setup, stored, table
from tapeloom.llm.minhash import components

COSINE = 0.95
#: Share of the neighbours at the threshold that a vector's own visits must reach.
RECALL = 0.999
#: Most centroids of a half, and the sample's vectors for each.
CENTROIDS, PER_CENTROID = 4096, 32
#: Distinct vectors that a cell of the grid holds on average.
OCCUPANCY = 32
#: Distinct vectors of a cell, and visitors of it, that meet in one group.
BLOCK = 2048
_ROUNDS = 12
#: Cosines this close to the threshold are computed again from the unscaled vectors.
_NEAR = 1e-9


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of ``x`` at length 1 in double precision; scaled before, so that squares stay finite."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def squares(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ centroids.T + (centroids * centroids).sum(1), 0)


def fitted(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Centroids of Lloyd's iterations on the rows of ``x``, begun at ``k`` of them; one that gets no row stays where it is."""
    k = max(1, min(k, len(x)))
    centroids = x[np.sort(np.random.default_rng(seed).permutation(len(x))[:k])].copy()
    for _ in range(_ROUNDS):
        nearest = np.concatenate([squares(x[i : i + 4096], centroids).argmin(1) for i in range(0, len(x), 4096)])
        held = np.bincount(nearest, minlength=k)
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, x)
        centroids[held > 0] = sums[held > 0] / held[held > 0, None]
    return centroids


class Grid:
    """Codebooks of both halves; cells are numbered row by row."""

    def __init__(self, left: np.ndarray, right: np.ndarray, cut: int):
        self.books, self.cut = (left, right), cut
        self.between = [np.sqrt(squares(c, c)) for c in self.books]

    def borders(self, x: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each half: the nearest centroid, and the squared distance to its region's border with every other one."""
        out = []
        for half, book, between in zip((x[:, : self.cut], x[:, self.cut :]), self.books, self.between):
            d = squares(half, book)
            own = d.argmin(1)
            gap = 2 * between[own]
            far = np.divide(d - d[np.arange(len(d)), own][:, None], gap, out=np.zeros_like(d), where=gap > 0)
            out.append((own, far * far))
        return out

    def cells(self, x: np.ndarray) -> np.ndarray:
        left, right = (squares(h, b).argmin(1) for h, b in zip((x[:, : self.cut], x[:, self.cut :]), self.books))
        return left * len(self.books[1]) + right

    def visits(self, x: np.ndarray, bound: float) -> list[list[int]]:
        """Cells of each row, the own one first, whose borders add up to ``bound`` at most."""
        (_, left), (_, right) = self.borders(x)
        width = len(self.books[1])
        out = []
        for a, b in zip(left, right):
            i, j = np.flatnonzero(a <= bound), np.flatnonzero(b <= bound)
            i, j = i[np.argsort(a[i], kind="stable")], j[np.argsort(b[j], kind="stable")]
            out.append([int(i[p]) * width + int(j[q]) for p, q in multi_sequence(a[i].tolist(), b[j].tolist(), bound)])
        return out


def multi_sequence(a: list[float], b: list[float], bound: float) -> Iterator[tuple[int, int]]:
    """Places ``(i, j)`` in order of ``a[i] + b[j]``, both sorted, up to ``bound``.

    A place enters the queue once its two predecessors are out: the next of its row always, the next of its column only from the first row.
    """
    queue = [(a[0] + b[0], 0, 0)]
    while queue:
        far, i, j = heapq.heappop(queue)
        if far > bound:
            return
        yield i, j
        if j + 1 < len(b):
            heapq.heappush(queue, (a[i] + b[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(a):
            heapq.heappush(queue, (a[i + 1] + b[0], i + 1, 0))


def reach(grid: Grid, x: np.ndarray, cosine: float, recall: float, seed: int = 5, most: int = 1000, moved: int = 8) -> float:
    """The bound within which the cells of ``recall`` of all vectors at ``cosine`` to a row of ``x`` lie."""
    rng = np.random.default_rng(seed)
    x = x[:most]
    borders = grid.borders(x)
    far = []
    for _ in range(moved):
        side = rng.standard_normal(x.shape)
        side -= (side * x).sum(1)[:, None] * x
        size = np.sqrt((side * side).sum(1, keepdims=True))
        y = cosine * x + math.sqrt(max(0.0, 1 - cosine * cosine)) * np.divide(side, size, out=np.zeros_like(side), where=size > 0)
        (p, left), (q, right) = borders
        width = len(grid.books[1])
        at = grid.cells(y)
        rows = np.arange(len(x))
        far.append(left[rows, at // width] + right[rows, at % width])
    return float(np.quantile(np.concatenate(far), recall))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(-1, dim).astype(np.float64) if dim else np.zeros((len(column), 0))


def usable(vectors: DataFrame) -> tuple[DataFrame, int]:
    """``vectors (id, v)`` with ``ok``: finite, not zero, of the length that most have; and that length."""
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    ok = F.coalesce(finite, F.lit(False))
    sizes = vectors.filter(ok).groupBy(F.size("v").alias("size")).agg(F.count("*").alias("held"))
    first = sizes.agg(F.max_by("size", F.struct("held", "size")).alias("size")).first()
    dim = first["size"] or 0
    return vectors.withColumn("ok", ok & (F.size("v") == dim)), dim


def fit(nodes: DataFrame, dim: int, cosine: float, recall: float, occupancy: int) -> tuple[Grid, float]:
    """The grid and the bound of the visits, from the distinct vectors of least hash."""
    n = nodes.count()
    k = min(CENTROIDS, max(2, math.ceil(math.sqrt(n / occupancy))))
    held = nodes.orderBy("h1", "h2").limit(k * PER_CENTROID).select("v").toArrow().column(0).combine_chunks()
    x = unit(matrix(held, dim))
    cut = (dim + 1) // 2
    grid = Grid(fitted(x[:, :cut], k, 1), fitted(x[:, cut:], k, 2), cut)
    return grid, reach(grid, x, cosine, recall)


def placed(nodes: DataFrame, grid: Grid, bound: float, dim: int) -> DataFrame:
    """``nodes`` with ``cell`` and ``visits``."""
    names = ["h1", "h2", "weight", "v", "cell", "visits"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = unit(matrix(b.column(3), dim))
                visits = grid.visits(x, bound)
                yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(grid.cells(x), pa.int64()), pa.array(visits, pa.list_(pa.int64()))], names)

    kind = nodes.schema["v"].dataType.simpleString()
    return nodes.select(*names[:4]).mapInArrow(run, f"h1 bigint, h2 bigint, weight bigint, v {kind}, cell bigint, visits array<bigint>")


def forest(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges ``(member, least member)`` of the components of the links ``a[i] - b[i]`` between ``n`` places."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    at = np.flatnonzero(label != np.arange(n))
    return at, label[at]


def compared(key: tuple, group: pa.Table, cosine: float, dim: int) -> pa.Table:
    """Links of one block: visitors against the vectors of the cell. Rows ``(node, links, other)``: sums of weights, edges of the forest."""
    home = group.column("home").to_numpy()
    node, weight, own = (group.column(c).to_numpy() for c in ("node", "weight", "own"))
    raw = matrix(group.column("v").combine_chunks(), dim)
    here, there = np.flatnonzero(home), np.flatnonzero(~home)
    x = unit(raw) if len(raw) else raw
    lists = group.column("visits").combine_chunks()
    starts, cells = lists.offsets.to_numpy(), lists.values.to_numpy()
    links, ends = np.zeros(len(node), np.int64), []
    for i in range(0, len(there), 256):
        rows = there[i : i + 256]
        s = x[rows] @ x[here].T
        p, q = np.nonzero(s >= cosine - _NEAR)
        if not len(p):
            continue
        value, p, q = s[p, q], rows[p], here[q]
        close = np.flatnonzero(np.abs(value - cosine) <= _NEAR)
        for c in close:  # as a plain cosine has it
            u, w = raw[p[c]], raw[q[c]]
            value[c] = (u @ w) / (math.sqrt(u @ u) * math.sqrt(w @ w))
        # The pair is met again where the other visits this one's cell: it counts in the cell of the larger node.
        back = np.zeros(len(p), bool)
        for visitor in np.unique(q):
            mine = np.flatnonzero(q == visitor)
            back[mine] = np.isin(own[p[mine]], cells[starts[visitor] : starts[visitor + 1]])
        good = (value >= cosine) & (node[p] != node[q]) & (~back | (node[p] < node[q]))
        p, q = p[good], q[good]
        np.add.at(links, p, weight[q])
        np.add.at(links, q, weight[p])
        ends.append((p, q))
    # A node may stand on both sides; all its places are one.
    if not ends:
        return pa.table({"node": pa.array([], pa.int64()), "links": pa.array([], pa.int64()), "other": pa.array([], pa.int64())})
    names, place = np.unique(node, return_inverse=True)
    a, b = forest(place[np.concatenate([p for p, _ in ends])], place[np.concatenate([q for _, q in ends])], len(names))
    has = np.flatnonzero(links)
    return pa.table({
        "node": pa.array(np.concatenate([node[has], names[a]]), pa.int64()),
        "links": pa.array(np.concatenate([links[has], np.zeros(len(a), np.int64)]), pa.int64()),
        "other": pa.array(np.concatenate([node[has], names[b]]), pa.int64()),
    })


def met(index: DataFrame, cosine: float, dim: int, block: int) -> DataFrame:
    """``(node, links, other)`` over all blocks of ``index (node, weight, v, cell, visits)``."""
    visits = index.select(F.explode("visits").alias("cell"))
    blocks = lambda held: F.ceil(F.coalesce(held, F.lit(0)) / block).cast("int")
    homes = index.groupBy("cell").agg(F.count("*").alias("held"))
    sizes = visits.groupBy("cell").agg(F.count("*").alias("visitors")).join(homes, "cell")
    sizes = stored(sizes.filter("visitors > 0").select("cell", blocks(F.col("held")).alias("hb"), blocks(F.col("visitors")).alias("vb")), "cells")
    plain = ["node", "weight", "v", "visits", F.col("cell").alias("own")]
    at = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    home = join_hot(index.select(*plain, "cell"), sizes, "cell").withColumn("i", at(F.col("hb"))).withColumn("j", every(F.col("vb")))
    none = F.array().cast("array<bigint>").alias("visits")
    visitors = stored(index.select("node", "weight", "v", none, F.col("cell").alias("own"), F.explode("visits").alias("cell")), "visitors")
    visitors = join_hot(visitors, sizes, "cell").withColumn("j", at(F.col("vb"))).withColumn("i", every(F.col("hb")))
    columns = ["cell", "i", "j", "node", "weight", "v", "visits", "own"]
    both = home.select(*columns, F.lit(True).alias("home")).unionByName(visitors.select(*columns, F.lit(False).alias("home")))
    return both.groupBy("cell", "i", "j").applyInArrow(lambda key, group: compared(key, group, cosine, dim), "node bigint, links bigint, other bigint")


def near_vectors(vectors: DataFrame, cosine: float = COSINE, recall: float = RECALL, occupancy: int = OCCUPANCY, block: int = BLOCK, id_name: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One row per vector: the id, ``n_links, component_id, kept``."""
    session_setup(vectors.sparkSession)
    rows, dim = usable(vectors.select(F.col(id_name).alias("id"), F.col(vector).alias("v")))
    seeds = F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2")
    rows = stored(rows.select("id", "v", "ok", *seeds), "vectors")
    lone = rows.filter("not ok").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    # Equal vectors are one node; its vector is any of them. Digests of 128 bits tell nodes apart.
    nodes = rows.filter("ok").groupBy("h1", "h2").agg(F.count("*").alias("weight"), F.first("v").alias("v"), F.min("id").alias("least"))
    nodes = stored(nodes, "nodes")
    grid, bound = fit(nodes, dim, cosine, recall, occupancy) if nodes.head(1) else (None, 0.0)
    if grid is None:
        return _named(lone, id_name)
    index = stored(placed(nodes, grid, bound, dim).withColumn("node", F.monotonically_increasing_id()), "index")
    found = stored(met(index.drop("h1", "h2"), cosine, dim, block), "links")
    links = found.filter("links > 0").groupBy("node").agg(F.sum("links").alias("links"))
    parts = components(found.filter("node <> other").select(F.col("node").alias("a"), F.col("other").alias("b")))
    known = index.select("h1", "h2", "node", "weight").join(nodes.select("h1", "h2", "least"), ["h1", "h2"])
    known = known.join(links, "node", "left").join(parts, "node", "left").withColumn("part", F.coalesce("label", "node"))
    known = stored(known.select("h1", "h2", "part", "least", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links")), "known")
    least = known.groupBy("part").agg(F.min("least").alias("component_id"))
    known = join_hot(known, least, "part").select("h1", "h2", "n_links", "component_id")
    dealt = join_hot(rows.filter("ok").select("id", "h1", "h2"), known.withColumnRenamed("h2", "more"), "h1").filter("h2 = more")
    return _named(dealt.select("id", "n_links", "component_id").unionByName(lone), id_name)


def _named(done: DataFrame, id_name: str) -> DataFrame:
    return done.select(F.col("id").alias(id_name), "n_links", F.col("component_id"), F.col("component_id").eqNullSafe(F.col("id")).alias("kept"))


def op11_inverted_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


OP11_SQL = """
WITH RECURSIVE v AS (SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, CAST(embedding AS DOUBLE[64]) AS e, len(embedding) = 64 AND (list_max(embedding) <> 0 OR list_min(embedding) <> 0) AS ok FROM embeddings),
g AS (SELECT * FROM v WHERE ok),
p AS (SELECT a.r AS a, b.r AS b FROM g a JOIN g b ON a.r < b.r WHERE array_cosine_similarity(a.e, b.e) >= 0.95),
sym AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
reach(a, b) AS (SELECT a, b FROM sym UNION SELECT reach.a, sym.b FROM reach JOIN sym ON sym.a = reach.b),
n AS (SELECT a, count(*) AS n_links FROM sym GROUP BY a),
c AS (SELECT a, min(vec_id) AS least FROM reach JOIN v ON v.r = reach.b GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, least(vec_id, coalesce(least, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(least, vec_id)) AS kept
FROM v LEFT JOIN n ON n.a = v.r LEFT JOIN c ON c.a = v.r
"""
