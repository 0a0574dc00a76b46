"""Near-duplicate vectors against all pairs: recall, counts, components, awkward rows."""

import numpy as np
import pytest

from tapeloom.llm import multi_index as m

SCHEMA = "vec_id bigint, embedding array<float>, label int, node bigint, id string, v string, cell int"


def brute(rows, cosine=0.95):
    """``{(id, n_links, component)}`` as a sorted list, by all pairs."""
    vectors = [None if v is None or any(x is None for x in v) else np.array(v, np.float32).astype(float) for _, v in rows]
    sizes = [len(v) for v in vectors if v is not None and len(v) and np.isfinite(v).all() and v.any()]
    dim = max(sizes, key=lambda n: (sizes.count(n), n), default=0)
    good = [v is not None and len(v) == dim and np.isfinite(v).all() and v.any() for v in vectors]
    links = [set() for _ in rows]
    at = [i for i, g in enumerate(good) if g]
    x = m.unit(np.array([vectors[i] for i in at])) if at else np.zeros((0, 0))
    for i, row in zip(at, x @ x.T):
        links[i] = {at[j] for j in np.flatnonzero(row >= cosine)} - {i}
    part = list(range(len(rows)))
    for i in range(len(rows)):
        if part[i] == i:
            todo, seen = [i], {i}
            while todo:
                for j in links[todo.pop()] - seen:
                    seen.add(j)
                    todo.append(j)
            for j in seen:
                part[j] = i
    ids = lambda k: [rows[j][0] for j in range(len(rows)) if part[j] == part[k] and rows[j][0] is not None]
    return sorted(((r[0], len(links[k]), min(ids(k), default=None)) for k, r in enumerate(rows)), key=repr)


def run(spark, rows, parts=3, **options):
    df = spark.createDataFrame([(i, v, 0, 1, "x", "y", 2) for i, v in rows], SCHEMA).repartition(parts)
    out = m.near_vectors(df, **options)
    assert out.columns == ["vec_id", "n_links", "component_id", "kept"]
    got = out.collect()
    assert all(r["kept"] == (r["component_id"] == r["vec_id"]) for r in got)
    return sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in got), key=repr)


def at_cosine(rng, x, cosine):
    side = rng.standard_normal(x.shape)
    side -= (side @ x) * x
    return cosine * x + np.sqrt(1 - cosine**2) * side / np.linalg.norm(side)


@pytest.fixture(scope="module")
def planted():
    """Vectors with neighbours just above and just below the threshold, a chain, a crowd of near copies and scaled copies."""
    rng = np.random.default_rng(3)
    base = m.unit(rng.standard_normal((500, 24)))
    rows = list(base)
    for k in range(120):
        rows.append(at_cosine(rng, base[k], 0.951 + 0.04 * rng.random()))
        rows.append(at_cosine(rng, base[k], 0.949 - 0.04 * rng.random()))
    link = base[200]
    for _ in range(12):
        link = at_cosine(rng, link, 0.96)
        rows.append(link)
    rows += [m.unit((base[300] + 0.01 * rng.standard_normal(24))[None])[0] for _ in range(150)]
    rows += [base[301] * 7.5] * 40 + [base[301]] * 40
    order = rng.permutation(len(rows))
    return [(int(i), [float(np.float32(x)) for x in rows[k]]) for i, k in enumerate(order)]


def test_equals_all_pairs(spark, planted):
    want = brute(planted)
    assert sum(n for _, n, _ in want) > 20_000
    assert run(spark, planted) == want
    # Small blocks, many partitions and small cells find the same.
    assert run(spark, planted, parts=11, block=16, occupancy=4) == want


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, None), (2, []), (3, [0.0, 0.0, -0.0]), (4, [1.0, None, 2.0]), (5, [nan, 1.0, 1.0]), (6, [inf, 1.0, 1.0]), (7, [1.0, 2.0]), (8, [1.0, 2.0, 3.0]),
        (8, [1.0, 2.0, 3.0]), (9, [2.0, 4.0, 6.0]), (None, [1.0, 2.0, 3.01]), (None, [-1.0, 0.0, 0.0]), (None, [-1.0, 0.0, 0.0]), (10, [3e38, 0.0, 0.0]),
        (11, [1e-30, 0.0, 0.0]), (12, [0.0, 0.0, 1.0]), (0, [1.0, 2.0, 2.99]), (8, [0.0, -5.0, 0.0])]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []
    assert run(spark, rows[:6]) == brute(rows[:6])
    one = [(1, [2.0]), (2, [-1.0]), (3, [5.0])]
    assert run(spark, one) == brute(one)


def test_walk_yields_cells_in_order_of_distance():
    rng = np.random.default_rng(1)
    a, b = np.sort(rng.random(7)), np.sort(rng.random(5))
    got = [a[i] + b[j] for i, j in m.multi_sequence(a.tolist(), b.tolist(), 1.1)]
    assert got == sorted(x + y for x in a for y in b if x + y <= 1.1)


def test_bound_reaches_the_recall_asked_for():
    """Neighbours at the threshold, in cells that their vectors visit."""
    rng = np.random.default_rng(2)
    x = m.unit(rng.standard_normal((2000, 32)))
    grid = m.Grid(m.fitted(x[:, :16], 12, 1), m.fitted(x[:, 16:], 12, 2), 16)
    for recall in (0.9, 0.99):
        visits = grid.visits(x, m.reach(grid, x, 0.95, recall))
        y = np.array([at_cosine(rng, v, 0.95) for v in x])
        found = np.mean([c in v for c, v in zip(grid.cells(y), visits)])
        assert recall - 0.02 <= found <= recall + 0.02
        assert max(map(len, visits)) < 144
