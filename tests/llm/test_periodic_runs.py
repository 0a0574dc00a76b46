"""Periodic runs against a plain search over all periods."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tapeloom.llm import periodic_runs as p

from .cases import SCHEMA, documents, write


def brute(words, least, times):
    """Maximal stretches for each period; those that have a smaller period of the same stretch are not its smallest."""
    n, found = len(words), []
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            if length >= max(least, times * q) and not any(all(words[x] == words[x + s] for x in range(i, i + length - s)) for s in range(1, q)):
                found.append((i, length, q))
            i = j
    return sorted(found, key=lambda r: (r[0], r[2]))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=60), st.sampled_from([(2, 2), (4, 2), (6, 3), (9, 3)]))
def test_runs_of_small_alphabets(symbols, size):
    words = [b"%d" % s for s in symbols]
    assert p.all_runs(words, p.WordHashes(), *size) == brute(words, *size)


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 10**6))
def test_runs_of_glued_repeats(seed):
    rng = random.Random(seed)
    words = []
    for _ in range(rng.randrange(1, 5)):
        root = [b"%d" % rng.randrange(rng.choice([2, 30])) for _ in range(rng.randrange(1, 14))]
        words += root * rng.randrange(1, 7) + root[: rng.randrange(len(root) + 1)]
        words += [b"w%d" % rng.randrange(1000) for _ in range(rng.choice([0, 0, 1, 20]))]
    assert p.all_runs(words, p.WordHashes()) == brute(words, 24, 3)


def test_common_extensions_and_orders():
    rng = np.random.default_rng(4)
    for n, sigma in ((1, 1), (2, 1), (40, 2), (200, 3), (300, 1)):
        s = rng.integers(0, sigma, n)
        e = p.Extensions(s, orders=True)
        text = s.tolist()
        assert e.leaves.tolist() == sorted(range(n + 1), key=lambda i: text[i:])
        assert np.argsort(e.turned).tolist() == sorted(range(n + 1), key=lambda i: [-x for x in text[i:]])
        a, b = np.triu_indices(n + 1, 1)
        if len(a):
            same = [next((k for k in range(n) if max(x, y) + k >= n or text[x + k] != text[y + k]), 0) for x, y in zip(a, b)]
            assert e.lce(a, b).tolist() == same


def expected(doc, text):
    """The query's row, from its contract."""
    words = (text or "").encode().split()
    n = len(words)
    h = zlib.crc32(str(doc).encode()) if doc is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        period = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % period] for i, w in enumerate(words)]
    runs = brute(words, 24, 3)
    top = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    drop = {i for s, n_, q in runs for i in range(s + q, s + n_)}
    lines = "".join(f"{s},{n_},{q}\n" for s, n_, q in runs)
    kept = b" ".join(w for i, w in enumerate(words) if i not in drop)
    sha = lambda x: hashlib.sha256(x).hexdigest()
    return (doc, len(runs), *(top or (None,) * 3), 1000 * top[1] // top[2] if top else None, sha(lines.encode()), sha(kept))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    some = [r for r in documents() if len(r[1] or "") < 40_000]
    texts = [" ".join(rng.choice("abc") for _ in range(80)), "tick tock " * 30, "one\ttwo\nthree " * 9 + "x " * 40, "É é " * 12, "a b " * 12 + "c " + "b a " * 12]
    many = [(1000 + i, " ".join(rng.choice(["up", "down", "left"]) if i % 3 else f"w{rng.randrange(400)}" for _ in range(rng.randrange(1, 160)))) for i in range(250)]
    return some + [(i, t, None, "s", 1, "r", "d", 0, "l") for i, t in [*enumerate(texts, 500), *many]]


def test_query_equals_brute_force(spark, tmp_path, rows):
    out = p.op12_periodic_runs(spark, write(spark, tmp_path, rows))
    assert out.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    got = sorted(map(tuple, out.collect()), key=repr)
    assert got == sorted((expected(r[0], r[1]) for r in rows), key=repr)
    assert sum(r[1] > 0 for r in got) > 15


def test_empty_table(spark, tmp_path):
    assert p.op12_periodic_runs(spark, write(spark, tmp_path, [])).collect() == []


def test_very_long_text(spark):
    """120,000 words that repeat: the trees hold the whole run."""
    root = [f"w{i}" for i in range(40_000)]
    text = "before " + " ".join(root * 3) + " after"
    df = spark.createDataFrame([(1, text, None, "s", 1, "r", "d", 0, "l")], SCHEMA)
    r = p.periodic_runs(df).first()
    assert [tuple(x) for x in r["runs"]] == [(1, 120_000, 40_000)] and r["n_words"] == 120_002
    assert bytes(r["collapsed"]).decode() == "before " + " ".join(root) + " after"
