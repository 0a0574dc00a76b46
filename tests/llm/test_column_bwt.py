import hashlib
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tapeloom.llm.column_bwt import anchors, collection_bwt, gram_hashes, op7_column_bwt, stretches, without_repeats

SCHEMA = "doc_id bigint, text string, more string"


def brute_bwt(strings):
    rows = sorted(((list(s[len(s) - k :]) + [i - len(strings)], i, k) for i, s in enumerate(strings) for k in range(len(s) + 1)), key=lambda r: r[0])
    bwt = [0 if k == len(strings[i]) else strings[i][len(strings[i]) - k - 1] + 1 for _, i, k in rows]
    lcp = [0]
    for (a, i, k), (b, j, n) in zip(rows, rows[1:]):
        c = 0
        while c < min(k, n) and a[c] == b[c]:
            c += 1
        lcp.append(c)
    return bwt, lcp, [(i, k) for _, i, k in rows]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=12).map(lambda b: bytes(x % 3 + 97 for x in b)), min_size=1, max_size=8))
def test_transform_and_common_prefixes(strings):
    bwt, lcp, places = collection_bwt(strings)
    want_bwt, want_lcp, want_places = brute_bwt(strings)
    width = max(map(len, strings)) + 1
    assert bwt.tolist() == want_bwt
    assert lcp.tolist() == want_lcp
    assert [(p // width, p % width) for p in places.tolist()] == want_places


def test_every_window_holds_an_anchor():
    raw = bytes(random.Random(3).choices(b"abcd ", k=2000))
    assert len(set(gram_hashes(b"abcabcabcabc", 5)[::3].tolist())) == 1
    pos, _ = anchors(raw, 30, 12)
    held = np.zeros(len(raw), bool)
    held[pos] = True
    assert all(held[s : s + 19].any() for s in range(len(raw) - 29))


def brute(rows, length):
    docs = sorted(((-(1 << 63) if i is None else i, (t or "").encode()) for i, t, _ in rows), key=lambda x: x[0])
    seen, out = set(), {}
    for i, raw in docs:
        gone = np.zeros(len(raw), bool)
        for s in range(len(raw) - length + 1):
            w = raw[s : s + length]
            if w in seen:
                gone[s : s + length] = True
            seen.add(w)
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        kept = bytes(np.frombuffer(raw, np.uint8)[~gone])
        out[i] = (len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


def results(df):
    return {-(1 << 63) if r["doc_id"] is None else r["doc_id"]: (r["n_bytes"], sum(s["end"] - s["start"] for s in r["removed"]), len(r["removed"]), hashlib.sha256(r["kept"]).hexdigest()) for r in df.collect()}


def test_edge_cases_match_brute_force(spark):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abcdefghé \n") for _ in range(n))
    passage, long = word(130), word(6000)
    rows = [(None, passage + word(50), "x"), (1, None, "y"), (2, "", None), (3, "a" * 700, ""), (4, long, ""), (5, long[:2500] + "X" + long[2501:], ""),
            (6, word(90), ""), (7, "a" * 99, ""), (8, long + long[:300], "")]
    rows += [(10 + i, word(rng.randrange(80)) + passage + word(rng.randrange(80)), "") for i in range(30)]
    rows += [(50 + i, long[i * 50 : i * 50 + 100 + i], "") for i in range(30)]
    assert results(without_repeats(spark.createDataFrame(rows, SCHEMA))) == brute(rows, 100)


def test_hot_anchors_are_dealt_out(spark):
    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("abcdef é") for _ in range(n))
    passage, sides = word(240), [word(45) for _ in range(4)]
    rows = [(i, word(rng.randrange(40)) + rng.choice(sides)[rng.randrange(45) :] + passage[rng.randrange(60) : 240 - rng.randrange(80)] + rng.choice(sides)[: rng.randrange(45)] + word(30), "") for i in range(90)]
    rows += [(200 + i, rows[i][1][i:], "") for i in range(40)]
    want = brute(rows, 100)
    df = spark.createDataFrame(rows, SCHEMA)
    for hot in (1, 3, 20):
        assert results(without_repeats(df, hot=hot)) == want


def test_stretches_hold_every_beginning():
    for level in range(7):
        found = stretches(60, level)
        assert [x for lo, hi in found for x in range(lo, hi + 1)] == list(range(61))
        assert len(found) == min(2**level, 61)


def test_very_long_text(spark):
    """A text of a megabyte that holds passages of its own and of another, against brute force."""
    rng = random.Random(9)
    long = "".join(rng.choices("abcdefghijklmnop \n", k=1_000_000))
    rows = [(2, long[:600_000] + long[1000:1400] + long[600_000:], ""), (1, long[300_000:300_450] + "x" + long[700_000:700_099], "")]
    assert results(without_repeats(spark.createDataFrame(rows, SCHEMA))) == brute(rows, 100)


def test_repeated_rows_return_alike(spark):
    text = "".join(random.Random(1).choices("abcdefgh ", k=400))
    rows = [(1, text, ""), (1, text, ""), (2, text, "")]
    got = sorted((r["doc_id"], r["n_removed"]) for r in (without_repeats(spark.createDataFrame(rows, SCHEMA)).selectExpr("doc_id", "aggregate(removed, 0L, (a, s) -> a + s.end - s.start) n_removed").collect()))
    assert got == [(1, 0), (1, 0), (2, 400)]


def test_documents_match_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    want = brute([(r[0], r[1], None) for r in docs.collect()], 100)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in op7_column_bwt(spark, "/root/testdata/sf0.001").collect()}
    assert got == want


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert op7_column_bwt(spark, str(tmp_path)).count() == 0
