import math
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from tapeloom.llm.elias_fano import EliasFano
from tapeloom.llm.ngram_trie import DISCOUNT, Level, build_trie, op6_ngram_trie, score
from tapeloom.llm.string_kernel import folds

SCHEMA = "doc_id bigint, text string"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**40), max_size=300), st.lists(st.integers(0, 2**40), min_size=1, max_size=50))
def test_elias_fano_is_a_sorted_array(values, asked):
    v = np.sort(np.array(values, np.uint64))
    e = EliasFano.build(v, 2**40)
    assert (e.access(np.arange(len(v))) == v).all()
    q = np.array(asked + values, np.uint64)
    place, same = e.successor(q)
    assert (place == np.searchsorted(v, q)).all()
    assert same.tolist() == [x in set(values) for x in q.tolist()]


def brute(rows, train, order):
    """``(tokens, known tokens, base score, score)`` from counts of all n-grams, none left out."""
    def tokens(t):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (t or ""))
        return low.encode().split() + [b"</s>"]

    c, grams, heads, kinds = Counter(), Counter(), Counter(), Counter()
    for t in train:
        w = [b"<s>"] * (order - 1) + tokens(t)
        c.update(w[order - 1 :])
        for k in range(order - 1, len(w)):
            for n in range(1, order):
                h = tuple(w[k - n : k])
                grams[h, w[k]] += 1
                heads[h] += 1
                kinds[h] += grams[h, w[k]] == 1
    n_all, v, out = sum(c.values()), len(c), []
    for i, t in rows:
        w, base, total = [b"<s>"] * (order - 1) + tokens(t), 0.0, 0.0
        for k in range(order - 1, len(w)):
            p = (c[w[k]] + 0.1) / (n_all + 0.1 * (v + 1))
            base += math.log10(p)
            for n in range(1, order):
                h = tuple(w[k - n : k])
                if seen := heads[h]:
                    p = (max(grams[h, w[k]] - DISCOUNT, 0) + DISCOUNT * kinds[h] * p) / seen
            total += math.log10(p)
        w = w[order - 1 :]
        out.append((i, len(w), sum(c[x] > 0 for x in w), base, total))
    return out, n_all


def same(found, want):
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[3])
    found, want = sorted(found, key=key), sorted(want, key=key)
    assert len(found) == len(want)
    for r, x in zip(found, want):
        assert r[:3] == x[:3]
        assert r[3] == pytest.approx(x[3], rel=1e-9)
        assert r[4] == pytest.approx(x[4], rel=1e-4, abs=0.01)


COLUMNS = ("doc_id", "n_tokens", "n_known", "base_score", "score")


def documents(spark, n):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").limit(n)
    rows = [tuple(r) for r in docs.collect()]
    rows += [(100_000, None), (100_001, ""), (100_002, "ZZZ neverseen"), (100_003, "once only once"), (100_003, "once only once"), (100_004, "once only once")]
    return [*rows, (None, "no id\tbut \x0b\x0c a text\r\n"), (None, None), (100_005, " the " * 40_000), (100_006, "\x1c\x85 \u2003wide\u00a0blank É é")]


@pytest.mark.parametrize("order", [2, 3, 4])
@pytest.mark.parametrize("shard_rows", [None, 700])
def test_scores_match_brute_force(spark, monkeypatch, shard_rows, order):
    import tapeloom.llm.ngram_trie as module

    monkeypatch.setattr(module, "CHUNK", 5_000)
    rows = documents(spark, 60)
    docs = spark.createDataFrame(rows, SCHEMA)
    want, n = brute(rows, [t for i, t in rows if zlib.crc32(b"" if i is None else str(i).encode()) % 10 != 0], order)
    trie = build_trie(docs.filter(folds(F.col("doc_id"), 10) != 0), order=order, **({"shard_rows": shard_rows} if shard_rows else {}))
    assert trie.n == n
    if shard_rows:
        assert len(trie.words.files) > 1 and len(trie.levels[0].files) > 1 and trie.levels[-1].parts > 1
    same([tuple(r[c] for c in COLUMNS) for r in score(docs, trie).collect()], want)


def test_query_keeps_every_triple_and_ignores_other_columns(spark, tmp_path):
    rows = documents(spark, 40)
    docs = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA + ", held_out string, score int, h string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 10 == 0
    want, n = brute(rows, [t for i, t in rows if not held(i)], 3)
    found = op6_ngram_trie(spark, str(tmp_path)).collect()
    assert all(r["train_tokens"] == n and r["held_out"] == held(r["doc_id"]) for r in found)
    same([tuple(r[c] for c in COLUMNS) for r in found], want)


def test_numbers_beyond_64_bits_sort_alike():
    small, large = Level(20, 2, 1, 1000), Level(40, 2, 1, 1 << 32)
    rng = np.random.default_rng(1)
    c, after = rng.integers(0, 50, 500).astype(np.uint64), rng.integers(0, 900, 500)
    for x in (small.order_of(c, after), large.order_of(c, after)):
        assert list(zip(c[x], after[x])) == sorted(zip(c, after))
    dealt = small.scattered(np.arange(1 << 20), 0)
    assert len(np.unique(dealt)) == 1 << 20


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**50), max_size=300))
def test_coded_rows_come_back(values):
    v = np.sort(np.array(values, np.uint64))
    assert (EliasFano.from_bytes(EliasFano.build(v, 2**50).to_bytes()).values() == v).all()


def test_without_training_rows_the_base_is_zero(spark, tmp_path):
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0]
    spark.createDataFrame([(i, "some words") for i in held], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    found = op6_ngram_trie(spark, str(tmp_path)).collect()
    assert len(found) == len(held) and all(r["base_score"] == r["score"] == 0 and r["n_known"] == r["train_tokens"] == 0 for r in found)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert op6_ngram_trie(spark, str(tmp_path)).count() == 0


def test_model_beats_the_base_on_held_out_documents(spark):
    rows = op6_ngram_trie(spark, "/root/testdata/sf0.001").filter("held_out").agg({"score": "sum", "base_score": "sum"}).first()
    assert rows["sum(score)"] > rows["sum(base_score)"]
