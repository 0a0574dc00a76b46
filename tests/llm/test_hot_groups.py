"""Hot keys, digests that clash, and the size check before a broadcast."""

import pytest

from tapeloom.llm import common
from tapeloom.llm.minhash import near_duplicates, told_apart
from tests.llm import cases


@pytest.mark.parametrize("how", ["inner", "left"])
def test_hot_keys_are_dealt_without_loss(spark, how):
    rows = [("a", i) for i in range(400)] + [("b", 1), ("b", 1), ("c", 2)] + [(f"k{i}", i) for i in range(500)]
    left = spark.createDataFrame(rows, "key string, n int")
    right = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), ("k7", 4), ("z", 5)], "key string, m int")
    assert common.hot_keys(left, "key") == ["a"]
    assert sorted(map(str, common.join_hot(left, right, "key", how).collect())) == sorted(map(str, left.join(right, "key", how).collect()))


def test_no_more_keys_are_hot_than_the_share_allows(spark):
    assert common.hot_keys(spark.range(1000).selectExpr("id % 200 as key"), "key") == []
    assert len(common.hot_keys(spark.range(1000).selectExpr("id % 199 as key"), "key")) < common.HOT_SHARE
    assert common.hot_keys(spark.createDataFrame([], "key int"), "key") == []


def test_broadcast_only_below_rows_and_bytes(spark):
    def hinted(df, **limits):
        return "ResolvedHint" in common.broadcast_if_small(df, **limits)._jdf.queryExecution().analyzed().toString()

    few = spark.createDataFrame([(1, "x", [1], ["y"]), (2, None, None, None)], "a int, b string, c array<int>, d array<string>")
    assert hinted(few) and not hinted(few, limit=1) and hinted(few.limit(0))
    long = "x" * (common.BROADCAST_BYTES // 2)
    assert not hinted(spark.createDataFrame([(long,), (long,), (long,)], "b string"))
    assert not hinted(spark.createDataFrame([([long] * 3,)], "b array<string>"))


def test_sets_of_one_short_digest_are_told_apart(spark):
    rows = [(1, 10, 7, 70), (2, 11, 7, 70), (3, 12, 7, 71), (4, 13, 8, 70), (5, 14, 8, 70)]
    found = {r["doc"]: r["node"] for r in told_apart(spark.createDataFrame(rows, "doc int, row int, node bigint, more bigint")).collect()}
    assert found[1] == found[2] != found[3] and found[4] == found[5] == 8 and len(set(found.values())) == 3
    same = told_apart(spark.createDataFrame(rows[3:], "doc int, row int, node bigint, more bigint"))
    assert same.columns == ["doc", "row", "node"] and {r["node"] for r in same.collect()} == {8}


def test_hot_groups_of_copies_and_near_copies(spark):
    copy, near = cases.prose(60), cases.prose(80).split()
    rows = [(i, copy) for i in range(150)]
    rows += [(1000 + i, " ".join([*near[: i % 70], f"new{i}", *near[i % 70 + 1 :]])) for i in range(150)]
    rows += [(2000 + i, cases.prose(40)) for i in range(250)] + [(3000 + i, None) for i in range(20)]

    def shingles(text):
        w = (text or "").lower().split()
        return frozenset(zip(w, w[1:])) if len(w) > 1 else frozenset(w)

    sets = {i: shingles(t) for i, t in rows}
    least = {i: i for i in sets}
    ids = [i for i in sets if sets[i]]
    changed = True
    links = [(a, b) for a in ids for b in ids if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            m = min(least[a], least[b])
            if (least[a], least[b]) != (m, m):
                least[a] = least[b] = m
                changed = True
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r["doc_id"]: r["component_id"] for r in near_duplicates(docs, size=2).collect()} == least
