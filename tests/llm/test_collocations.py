"""Collocations against a plain count of all phrases."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from tapeloom.llm import collocations as c

from .cases import SCHEMA, documents

UPPER = {x: x + 32 for x in range(65, 91)}


def brute(rows, depth=3, least=10, inside=50, top=2000):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(UPPER)):
            w = [x for x in re.split("[ \t]+", piece) if x]
            n[lang] += len(w)
            for k in range(1, depth + 1):
                f.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    found = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= least}
    gone = {
        (lang, w[i : i + k]) for (lang, w), a in found.items() for k in range(2, len(w)) for i in range(len(w) - k + 1) if 100 * a >= inside * f[lang, w[i : i + k]]}
    out = []
    for lang in {k[0] for k in found}:
        scored = []
        for (at, w), a in found.items():
            if at == lang and (at, w) not in gone:
                score, _, left, right = min((1_000_000 * a * a // (f[at, w[:k]] * f[at, w[k:]]), k, f[at, w[:k]], f[at, w[k:]]) for k in range(1, len(w)))
                scored.append((-score, -a, " ".join(w).encode(), a, left, right))
        for rank, (score, _, phrase, a, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, phrase.decode(), a, left, right, n[lang], -score))
    return sorted(out)


def run(spark, rows, parts=3, **options):
    df = spark.createDataFrame([(i, t, lang, "s", 1, "r", "d", 0, "l") for i, (t, lang) in enumerate(rows)], SCHEMA).repartition(parts)
    out = c.collocations(df, **options)
    assert out.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(map(tuple, out.collect()))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(6)
    words = ["New", "new", "York", "city", "the", "of", "größe", "日本", "É", "é", "x\x00y", "a-b", "\x1f", "tab\tbed", "end.", "stop,", "line\nfeed", "cr\rx"]
    some = [(" ".join(rng.choice(words) for _ in range(rng.randrange(60))), rng.choice(["en", "de", None, "und", ""])) for _ in range(150)]
    return some + [("new york city hall " * 40, "en"), ("a b " * 30 + "a b c " * 12, "fr")] + [(r[1], r[2]) for r in documents()]


def test_equals_plain_counts(spark, rows):
    want = brute(rows)
    assert len(want) > 50
    assert run(spark, rows) == want
    # Many small shards and other partitions give the same, and so do other sizes.
    assert run(spark, rows, parts=7, pending=300) == want
    assert run(spark, rows, depth=4, least=3, inside=70, top=25) == brute(rows, 4, 3, 70, 25)


def test_row_groups_of_the_index_hold_few_shards(spark, rows, monkeypatch):
    """Readers decode a row group at once, so a partition of many shards must not be one."""
    import pyarrow.parquet as pq

    kept, whole = [], c.stored

    def storing(df, tag, *options):
        out = whole(df, tag, *options)
        kept.extend(f.removeprefix("file://") for f in out.inputFiles() if tag == "shards")
        return out

    monkeypatch.setattr(c, "stored", storing)
    assert run(spark, rows, parts=1, pending=300) == brute(rows)
    groups = [m.row_group(i).num_rows for m in (pq.ParquetFile(f).metadata for f in kept) for i in range(m.num_row_groups)]
    assert sum(groups) > 20 and max(groups) <= 4


def test_without_words(spark):
    assert run(spark, []) == [] and run(spark, [(None, None), ("", "en"), (" ,.\n", "de")]) == []


def test_slots_shared_by_chance_change_nothing(spark, rows, monkeypatch):
    """With all bits set nothing is pruned before the counts are summed."""
    monkeypatch.setattr(c, "full_slots", lambda counts, least: np.full(1 << (c.SLOT_BITS - 3), 255, np.uint8))
    assert run(spark, rows) == brute(rows)


def test_slots_add_up_over_shards(spark):
    """Counts above 255 and of several shards: a slot is full from exactly the least count on."""
    texts = spark.createDataFrame([("en", "often " * 700 + "rare " * 9 + ". " + "ten " * 5), ("en", "often " + "ten " * 5)], "lang string, text string").repartition(2)
    index = c.shards(texts, 3, 100).persist()
    held = spark.sparkContext.broadcast(np.zeros(1 << (c.SLOT_BITS - 3), np.uint8))
    for least, words in ((701, {b"often"}), (702, set()), (10, {b"often", b"ten"}), (9, {b"often", b"ten", b"rare"})):
        slots = c.Slots("en", [b"often", b"rare", b"ten"], c.full_slots(c.slot_counts(index, 1, held), least))
        assert {w for w, full in zip([b"often", b"rare", b"ten"], slots.full(np.array([[1], [2], [3]]))) if full} == words


def test_large_counts_are_exact(spark):
    big = 10**15 - 1
    row = spark.createDataFrame([(big - 7, big, big - 3)], "a bigint, l bigint, r bigint").select(c.ratio("a", "l", "r").alias("s")).first()
    assert row["s"] == 1_000_000 * (big - 7) ** 2 // (big * (big - 3))
