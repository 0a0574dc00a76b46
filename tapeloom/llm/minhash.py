"""Near-dedup with circulant MinHash, banding and exact Jaccard verification.

Signature: shingle hashes fall on a universe of ``UNIVERSE`` places, a first permutation deals them
anew, and coordinate k is the least value of a second permutation shifted circularly by k. Two
permutations thus give all ``bands * rows`` coordinates. At similarity 0.8 a pair misses all of 40
bands of 6 rows with probability 5e-6.

Documents with equal shingle sets form one node, so copies cost nothing further. A node is a 64-bit
digest of the sorted set; sets that share it by chance are told apart by 64 more bits. Nodes of a bucket are compared with the bucket's leader on full sets; links give
components. Where buckets still hold several components, their nodes in different components are
compared further, but for pairs that exact bounds rule out: two sets of the wanted similarity share one
of each other's rarest shingles, and so early in order of rarity that enough can follow.
So no link between such nodes is lost, and pairs that are connected already are never made.

A group of copies may hold a third of all rows: joins by node, component, bucket and leader deal the rows
of such keys over many tasks (``join_hot``).

Defined results: null, empty or wordless texts have no shingles and are their own component; texts
with fewer words than a shingle have one shingle, the whole sequence; a null id is never the
smallest of a component that has others; repeated rows are copies and each returns; an empty table
gives no rows. Only the id and the text are read, so other columns cannot clash.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeloom.llm.common import LOWER_TABLE, broadcast_if_small, hot_keys, join_hot, session_setup, stored, table

UNIVERSE = 1 << 20
#: Shingles whose coordinates are made at once: the block stays in a core's cache.
BLOCK = 256
_CACHED_WORDS = 400_000
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a number of words."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= _CACHED_WORDS:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


def shingle_set(text: str | None, size: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``size``-word shingles of ``text``."""
    found = (text or "").encode("utf-8", "surrogatepass").translate(LOWER_TABLE).split()  # splits at 0x20, 0x09-0x0D
    n = len(found)
    if not n:
        return np.zeros(0, np.uint64)
    of_words = np.fromiter(map(hashes.__getitem__, found), np.uint64, n)
    span = min(size, n)
    made = np.full(n - span + 1, np.uint64(span))
    for i in range(span):
        made = mixed(made * _GOLD + of_words[i : n - span + 1 + i])
    return np.unique(made)


@functools.lru_cache(maxsize=2)
def permutations(coordinates: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """The first permutation, and views of the second one from each place, ``coordinates`` long."""
    rng = np.random.default_rng(seed)
    first = rng.permutation(UNIVERSE).astype(np.int32)
    second = rng.permutation(UNIVERSE).astype(np.int32)
    around = np.concatenate([second, second[:coordinates]])
    return first, np.lib.stride_tricks.sliding_window_view(around, coordinates)


def signature(shingles: np.ndarray, coordinates: int) -> np.ndarray:
    first, shifted = permutations(coordinates)
    places = first[(shingles & np.uint64(UNIVERSE - 1)).astype(np.int64)]
    least = np.full(coordinates, UNIVERSE, np.int32)
    for at in range(0, len(places), BLOCK):
        np.minimum(least, shifted[places[at : at + BLOCK]].min(axis=0), out=least)
    return least


def band_keys(sig: np.ndarray, bands: int) -> np.ndarray:
    """One 64-bit bucket key a band; the band's number is part of the key."""
    key = mixed(np.arange(1, bands + 1, dtype=np.uint64) * _GOLD)
    for column in sig.reshape(bands, -1).T:
        key = mixed(key * _GOLD + column.astype(np.uint64))
    return key


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _lists(parts: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, parts)], dtype=np.int32)
    flat = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(ends), _signed(flat))


def signed_documents(docs: DataFrame, size: int, bands: int, rows: int) -> DataFrame:
    """``(doc, row, n, node, more, keys)``: id, text hash, shingles, 128-bit digest of the set, bucket keys."""
    session_setup(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in batches:
            n, digests, keys = [], b"", []
            for text in b.column(2):
                found = shingle_set(text.as_py(), size, hashes)
                n.append(len(found))
                digests += hashlib.blake2b(found.tobytes(), digest_size=16).digest()
                keys.append(band_keys(signature(found, bands * rows), bands) if len(found) else found)
            node, more = np.frombuffer(digests, np.int64).reshape(-1, 2).T.copy()
            columns = [b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(node), pa.array(more), _lists(keys)]
            yield pa.RecordBatch.from_arrays(columns, ["doc", "row", "n", "node", "more", "keys"])

    rows_in = docs.select(F.col("doc_id").alias("doc"), F.xxhash64("text").alias("row"), "text")
    return rows_in.mapInArrow(run, f"doc {kind}, row bigint, n bigint, node bigint, more bigint, keys array<bigint>")


def told_apart(signed: DataFrame) -> DataFrame:
    """``signed`` without ``more``: rows whose ``node`` other sets have too get a node of all 128 bits."""
    clashes = signed.groupBy("node").agg(F.min("more").alias("lo"), F.max("more").alias("hi")).filter("lo <> hi").select("node")
    if not clashes.head(1):
        return signed.drop("more")
    clashes = clashes.withColumn("clash", F.lit(True))
    node = F.when(F.col("clash"), F.xxhash64("node", "more")).otherwise(F.col("node"))
    both = join_hot(signed, clashes, "node", "left")
    return stored(both.withColumn("node", node).select(*[c for c in signed.columns if c != "more"]), "signed")


def shingle_sets(texts: DataFrame, size: int) -> DataFrame:
    """``(node, shingles)`` of ``(node, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in batches:
            found = [shingle_set(t.as_py(), size, hashes) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), _lists(found)], ["node", "shingles"])

    return texts.select("node", "text").mapInArrow(run, "node bigint, shingles array<bigint>")


def measured(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``pairs (a, b)``, a stored table, with ``both`` and ``either``: sizes of intersection and union of the full sets."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    out = join_hot(pairs, left, "a").join(right, "b").withColumn("both", both)
    return out.select("a", "b", "both", (F.size("sa") + F.size("sb") - F.col("both")).alias("either"))


def components(links: DataFrame) -> DataFrame:
    """``(node, label)`` for the nodes of ``links (a, b)``: the least node reachable.

    Least labels of neighbours, then labels of labels, until nothing changes; each round is a stored
    table, so lineage stays short and a lost executor costs one round.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = stored(both, "links")
    hubs = hot_keys(both, "b")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least("a", F.min("b")).alias("label")), "labels")
    while True:
        seen = join_hot(both, labels.withColumnRenamed("node", "b"), "b", hot=hubs).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        least = labels.join(seen, "node").select("node", "label", F.least("label", "near").alias("new"))
        up = labels.select(F.col("node").alias("new"), F.col("label").alias("above"))
        step = stored(least.join(up, "new", "left").select("node", "label", F.least("new", "above").alias("next")), "labels")
        changed = step.filter("next <> label").count()
        labels = step.select("node", F.col("next").alias("label"))
        if not changed:
            return labels


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, bands: int = 40, rows: int = 6) -> DataFrame:
    """One row per document row: ``doc_id, row, part, n_shingles, component_id, kept``; ``part`` names the component.

    ``size`` words a shingle, similarity of ``percent`` hundredths or more.
    """
    signed = told_apart(stored(signed_documents(docs, size, bands, rows), "signed"))
    nodes = signed.filter("n > 0").select("node", "n", "keys").dropDuplicates(["node"])
    in_buckets = stored(nodes.select("node", "n", F.explode("keys").alias("bucket")), "buckets")
    shared = stored(in_buckets.groupBy("bucket").agg(F.count("*").alias("held")).filter("held > 1"), "shared")
    held = in_buckets.join(broadcast_if_small(shared), "bucket")
    # The leader of a bucket is its most central node: the one with most company over all its buckets.
    weights = held.groupBy("node").agg(F.sum("held").alias("weight"))
    held = stored(held.drop("held").join(weights, "node"), "held")
    leaders = held.groupBy("bucket").agg(F.max(F.struct("weight", "node")).getField("node").alias("leader"))
    members = stored(join_hot(held.drop("weight"), leaders, "bucket"), "members")

    needed = members.select("node").distinct()
    one_row = signed.join(needed, "node", "left_semi").groupBy("node").agg(F.min(F.struct("doc", "row")).alias("at"))
    one_row = stored(one_row.select("node", F.col("at.doc").alias("doc"), F.col("at.row").alias("row")), "needed")
    small = broadcast_if_small(one_row)
    texts = docs.join(small, docs["doc_id"].eqNullSafe(small["doc"]) & (F.xxhash64(docs["text"]) == small["row"])).select("node", docs["text"])
    sets = stored(shingle_sets(texts, size).dropDuplicates(["node"]), "sets")

    is_link = f"100 * both >= {percent} * either"
    first = members.filter("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    first = stored(first, "first")
    tested = stored(measured(first, sets), "tested")
    labels = components(tested.filter(is_link))

    # What the leaders leave open: buckets of several components. A link of two of their nodes needs a
    # common shingle among each one's rarest fifth (prefix filter), early enough (positional filter).
    placed = members.join(labels, "node", "left").select("bucket", "node", "n", F.coalesce("label", "node").alias("label"))
    parts = placed.groupBy("bucket").agg(F.count_distinct("label").alias("parts"), F.count("*").alias("held")).filter("parts > 1 and held > 2")
    rest = stored(placed.join(parts.select("bucket"), "bucket", "left_semi").select("node", "n", "label").distinct(), "rest")
    tokens = sets.join(rest, "node").select("node", "n", "label", F.explode("shingles").alias("s"))
    df = tokens.groupBy("s").agg(F.count("*").alias("df"))
    tokens = tokens.join(df, "s")
    place = F.row_number().over(Window.partitionBy("node").orderBy("df", "s"))
    prefix = tokens.withColumn("k", place).filter((F.col("k") - 1) * 100 <= (100 - percent) * F.col("n")).filter("df > 1")
    prefix = stored(prefix.select("s", "node", "n", "label", "k"), "prefix")
    groups = prefix.groupBy("s", "label").agg(F.count("*").alias("held")).groupBy("s").agg(F.count("*").alias("parts"), F.max(F.struct("held", "label")).getField("label").alias("largest"))
    x = prefix.join(groups.filter("parts > 1").select("s", "largest"), "s").filter("label <> largest").drop("largest")
    y = prefix.select("s", *[F.col(c).alias(c + "2") for c in ("node", "n", "label", "k")])
    # The first common shingle leaves each set what stands after it, so that bounds the intersection.
    at_most = F.least(F.col("n") - F.col("k"), F.col("n2") - F.col("k2")) + 1
    may_link = (F.col("label") != F.col("label2")) & (percent * (F.col("n") + F.col("n2")) <= (100 + percent) * at_most)
    more = x.join(y, "s").filter(may_link).select(F.least("node", "node2").alias("a"), F.greatest("node", "node2").alias("b")).distinct()
    more = stored(more, "more")
    late = stored(measured(more, sets).filter(is_link), "late")
    if late.head(1):
        labels = components(tested.filter(is_link).select("a", "b").unionByName(late.select("a", "b")))

    at = join_hot(signed.select("doc", "row", "n", "node"), labels, "node", "left").withColumn("part", F.coalesce("label", "node"))
    at = stored(at, "parts")
    least = at.filter("n > 0").groupBy("part").agg(F.min("doc").alias("least"))
    done = join_hot(at, least, "part", "left")
    component = F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc"))
    return done.select(F.col("doc").alias("doc_id"), "row", "part", F.col("n").alias("n_shingles"), component.alias("component_id"), component.eqNullSafe(F.col("doc")).alias("kept"))


def op10_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), size=2).drop("row", "part")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """Pipeline stage: one document of each group; the columns of ``docs``.

    It is the one with the least id, a null id being the largest, then the least text hash. Rows that repeat
    it whole, id and text, go as well. Documents without words are in no group and all stay.
    """
    near = stored(near_duplicates(docs.select("doc_id", "text")).filter("n_shingles > 0").select(F.col("doc_id").alias("__doc"), F.col("row").alias("__row"), "part"), "near")
    rank = F.struct(F.col("__doc").isNull().alias("last"), "__doc", "__row")
    groups = near.groupBy("part").agg(F.min(rank).alias("first"), F.count("*").alias("held")).filter("held > 1")
    others = join_hot(near, groups, "part").filter(rank != F.col("first"))
    first = groups.select(F.col("first.__doc").alias("__doc"), F.col("first.__row").alias("__row"))

    def at(keys: DataFrame):
        return docs["doc_id"].eqNullSafe(keys["__doc"]) & (F.xxhash64(docs["text"]) == keys["__row"])

    kept = docs.join(others.select("__doc", "__row"), at(others), "left_anti")
    twice = near.groupBy("__doc", "__row").agg(F.count("*").alias("held")).filter("held > 1").select("__doc", "__row")
    if not twice.head(1):  # no id and text repeat together
        return kept
    twice = stored(twice.join(first, twice["__doc"].eqNullSafe(first["__doc"]) & (twice["__row"] == first["__row"]), "left_semi"), "twice")
    once = kept.join(twice, at(twice), "left_semi").withColumn("__row", F.xxhash64("text")).dropDuplicates(["doc_id", "__row"]).drop("__row")
    return kept.join(twice, at(twice), "left_anti").unionByName(once)


OP10_SQL = r"""
WITH d AS (SELECT doc_id, string_split_regex(trim(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g')), ' ') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) = 1 THEN w[1] ELSE w[i] || ' ' || w[i + 1] END AS k
      FROM d, unnest(range(1, greatest(len(w), 2))) AS t(i) WHERE NOT (len(w) = 1 AND w[1] = '')),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
df AS (SELECT k, count(*) AS f FROM s GROUP BY k),
r AS (SELECT s.doc_id, s.k, n.n, row_number() OVER (PARTITION BY s.doc_id ORDER BY f, k) AS p
      FROM s JOIN df USING (k) JOIN n USING (doc_id)),
pre AS (SELECT doc_id, k FROM r WHERE 100 * (p - 1) <= 20 * n),
cand AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM pre a JOIN pre b USING (k) WHERE a.doc_id < b.doc_id),
ok AS (SELECT c.a, c.b FROM cand c JOIN n x ON x.doc_id = c.a JOIN n y ON y.doc_id = c.b WHERE 100 * least(x.n, y.n) >= 80 * greatest(x.n, y.n)),
both_n AS (SELECT o.a, o.b, count(*) AS m FROM ok o JOIN s x ON x.doc_id = o.a JOIN s y ON y.doc_id = o.b AND y.k = x.k GROUP BY o.a, o.b),
e AS (SELECT m.a, m.b FROM both_n m JOIN n x ON x.doc_id = m.a JOIN n y ON y.doc_id = m.b WHERE 100 * m >= 80 * (x.n + y.n - m)),
sym AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach AS (
  WITH RECURSIVE g(a, b) AS (SELECT a, b FROM sym UNION SELECT g.a, sym.b FROM g JOIN sym ON sym.a = g.b)
  SELECT a, min(b) AS least FROM g GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(reach.least, d.doc_id)) AS component_id,
       d.doc_id = least(d.doc_id, coalesce(reach.least, d.doc_id)) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN reach ON reach.a = d.doc_id
"""
