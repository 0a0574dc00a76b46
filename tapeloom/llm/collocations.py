"""Phrase collocations by FM-indexes of shards over word numbers.

Each task numbers the words of its texts and keeps, for each language, one shard after another: its words and the Burrows-Wheeler transform of
their numbers, with a separator between pieces, in order of ``depth`` symbols of context. That is all that backward search needs for phrases of up
to ``depth`` words. Phrases are enumerated by interval: a row's left neighbour is the symbol of the transform, the rows sorted by it (stably) are the
rows of the phrases extended to the left, and the way back leads from a phrase's row to the row of its right part. So the intervals of one more word
are the stretches of rows whose first word and whose right part's interval stay the same: an interval's size is the phrase's count in the shard.

Counts of shards are summed. A phrase can be frequent only where its parts are, so phrases are counted size by size, by slots of a hash; the slots
that reach the least count, as bits of ``2 ** SLOT_BITS / 8`` bytes at any input, go to the tasks, which extend the phrases in those slots only.
A slot that phrases share adds work, never a result: what is left is summed by its words.

Scores are exact: products are decimals of 38 digits, which counts up to 10 ** 15 keep within.

Defined results: null or empty texts have no words; a null language is ``und``; repeated rows count each; words differ in case only outside A-Z; an
empty table gives no rows. Only the text and the language are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeloom.llm.common import broadcast_if_small, session_setup, stored, table
from tapeloom.llm.minhash import mixed

DEPTH, LEAST, INSIDE, TOP = 3, 10, 50, 2000
#: Words and separators that a task holds before it closes the largest shard.
PENDING = 600_000
#: Bytes of a batch of shards on its way to Python.
BATCH_BYTES = 8_388_608
SLOT_BITS = 28
_GOLD = np.uint64(0x9E3779B97F4A7C15)
#: A-Z lower-cased, a tab as a space, separators of pieces as line feeds.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else 32 if b == 9 else 10 if b in b".,;:!?" or 10 <= b <= 13 else b for b in range(256))
_ROWS = 200_000
#: Partitions of the index that one task spells out, where enough tasks are left for all cores.
COMBINED = 4
#: Shards of a row group of the index. Spark's reader decodes a row group's values at once, 4,096 rows at most.
GROUP_SHARDS = 4


class Numbers(dict):
    """Numbers of words in order of appearance, from 1; 0 is the separator, -1 what stands between two spaces."""

    def __init__(self):
        super().__init__({b"": -1, b"\n": 0})

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self) - 1
        return n


class Shard:
    """The words of one language that a task has read since it closed the last shard of it."""

    def __init__(self):
        self.numbers, self.parts, self.size = Numbers(), [], 0

    def add(self, text: str | None) -> int:
        raw = (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).replace(b"\n", b" \n ")
        found = raw.split(b" ")
        s = np.fromiter(map(self.numbers.__getitem__, found), np.int32, len(found))
        s = s[s >= 0]
        self.parts += [s, np.zeros(1, np.int32)]
        self.size += len(s) + 1
        return len(s) + 1

    def index(self, depth: int) -> tuple[list[bytes], np.ndarray]:
        """The words by number, and the transform: for each suffix, in order of its first ``depth`` symbols, the symbol before it."""
        s = np.concatenate(self.parts).astype(np.int64)
        width, rank = len(self.numbers) - 1, s
        for d in range(1, depth):
            key = rank * width + np.roll(s, -d)  # the last symbol is a separator: phrases do not reach round
            rank = np.unique(key, return_inverse=True)[1] if d < depth - 1 else key
        bwt = np.roll(s, 1)[np.argsort(rank)]
        return [w for w, n in self.numbers.items() if n > 0], bwt.astype(np.int32)


def shards(docs: DataFrame, depth: int, pending: int) -> DataFrame:
    """``(lang, n, words, bwt)`` of ``docs (lang, text)``: the index of each shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict[str, Shard] = {}
        held = 0

        def closed(lang: str) -> pa.RecordBatch:
            shard = open_.pop(lang)
            words, bwt = shard.index(depth)
            columns = [pa.array([lang]), pa.array([int((bwt > 0).sum())], pa.int64()), pa.array([b" ".join(words)], pa.binary()), pa.array([bwt.tobytes()], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["lang", "n", "words", "bwt"])

        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1)):
                held += open_.setdefault(lang, Shard()).add(text.as_py())
                if held >= pending:
                    largest = max(open_, key=lambda k: (open_[k].size, k))
                    held -= open_[largest].size
                    yield closed(largest)
        for lang in list(open_):
            yield closed(lang)

    return docs.select("lang", "text").mapInArrow(run, "lang string, n bigint, words binary, bwt binary")


class Phrases:
    """Intervals of an index: for each size of phrase, from one word on, the words' numbers and the counts."""

    def __init__(self, words: bytes, bwt: bytes):
        self.words = words.split(b" ") if words else []
        self.bwt = np.frombuffer(bwt, np.int32)
        counts = np.bincount(self.bwt, minlength=len(self.words) + 1)
        self.first = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
        self.right = np.argsort(self.bwt, kind="stable").astype(np.int32)  # from a row to the row of what follows its first word

    def sizes(self, depth: int, keep) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """``(numbers, counts)`` of the phrases of 1 to ``depth`` words whose parts all pass ``keep(numbers)``; the last size is not asked about."""
        rows = len(self.first)
        group, live = self.first, self.first > 0
        for size in range(1, depth + 1):
            edge = np.ones(rows, bool)
            if size == 1:
                edge[1:] = group[1:] != group[:-1]
            else:
                after = group[self.right]
                live = (self.first > 0) & live[self.right]
                edge[1:] = (self.first[1:] != self.first[:-1]) | (after[1:] != after[:-1])
            group = np.cumsum(edge, dtype=np.int32) - 1
            begin = np.flatnonzero(edge)
            counts = np.diff(begin, append=rows)
            good = live[begin]
            begin, counts = begin[good], counts[good]
            numbers, at = [], begin
            for _ in range(size):
                numbers.append(self.first[at])
                at = self.right[at]
            numbers = np.column_stack(numbers) if len(begin) else np.zeros((0, size), np.int32)
            good = np.ones(len(numbers), bool) if size == 1 else keep(numbers[:, :-1])
            if size < depth:
                good[good] = keep(numbers[good])
                kept = np.zeros(int(group[-1]) + 1 if rows else 0, bool)
                kept[group[begin[good]]] = True
                live = live & kept[group]
            yield numbers[good], counts[good]


class Slots:
    """Slots of an index's phrases, by a hash of the language and the words, and the bits that say which are full."""

    def __init__(self, lang: str, words: list[bytes], bits: np.ndarray):
        import xxhash

        self.own = np.array([0, *map(xxhash.xxh3_64_intdigest, words)], np.uint64)
        self.seed, self.bits = np.uint64(xxhash.xxh3_64_intdigest(lang)), bits

    def of(self, numbers: np.ndarray) -> np.ndarray:
        h = np.full(len(numbers), self.seed)
        for column in numbers.T:
            h = mixed(h * _GOLD + self.own[column])
        return (h >> np.uint64(64 - SLOT_BITS)).astype(np.int64)

    def full(self, numbers: np.ndarray) -> np.ndarray:
        at = self.of(numbers)
        return (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def sliced(data: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """Binary values of the stretches of ``data`` between ``cuts``."""
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer((cuts * data.itemsize).astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])


def slot_counts(index: DataFrame, size: int, held: Broadcast) -> DataFrame:
    """``(range, low, count)``: for each shard, counts of its phrases of ``size`` words by slot, slots of a range together.

    ``low`` has two bytes a phrase, ``count`` one; a count above 255 takes more places.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lang, words, bwt in zip(*(b.column(i) for i in range(3))):
                phrases = Phrases(words.as_py(), bwt.as_py())
                slots = Slots(lang.as_py(), phrases.words, held.value)
                *_, (numbers, counts) = phrases.sizes(size, slots.full)
                at = slots.of(numbers)
                order = np.argsort(at)
                at, counts = at[order], counts[order]
                places = -(-counts // 255)
                last = counts - 255 * (places - 1)
                ends = np.cumsum(places) - 1
                at, count = np.repeat(at, places), np.full(int(places.sum()), 255, np.uint8)
                count[ends] = last
                of_range = at >> 16
                cuts = np.flatnonzero(np.diff(of_range, prepend=-1, append=1 << 40))
                columns = [pa.array(of_range[cuts[:-1]].astype(np.int32)), sliced((at & 0xFFFF).astype(np.uint16), cuts), sliced(count, cuts)]
                yield pa.RecordBatch.from_arrays(columns, ["range", "low", "count"])

    return index.select("lang", "words", "bwt").mapInArrow(run, "range int, low binary, count binary")


def full_slots(counts: DataFrame, least: int) -> np.ndarray:
    """Bits of the slots that add up to ``least`` or more. A task holds the counters of one range at a time."""
    parts = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = counts.repartition(parts, "range").sortWithinPartitions("range")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sums = -1, np.zeros(1 << 16)

        def told() -> Iterator[pa.RecordBatch]:
            if (sums >= least).any():
                bits = np.packbits(sums >= least, bitorder="little")
                yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([bits.tobytes()], pa.binary())], ["range", "bits"])

        for b in batches:
            ranges = b.column(0).to_numpy()
            for lo, hi in zip(cuts := np.flatnonzero(np.diff(ranges, prepend=-2)), [*cuts[1:], len(ranges)]):
                if ranges[lo] != at:
                    yield from told()
                    at, sums = int(ranges[lo]), np.zeros(1 << 16)
                low, count = (b.column(i).slice(lo, hi - lo) for i in (1, 2))
                sums += np.bincount(_bytes(low, np.uint16), _bytes(count, np.uint8), 1 << 16)
        yield from told()

    found = dealt.mapInArrow(run, "range int, bits binary").toArrow()
    out = np.zeros(1 << (SLOT_BITS - 3), np.uint8)
    for at, bits in zip(found.column("range").to_pylist(), found.column("bits").to_pylist()):
        out[at << 13 : (at + 1) << 13] = np.frombuffer(bits, np.uint8)
    return out


def _bytes(column: pa.Array, kind) -> np.ndarray:
    """All values of a binary column, one after another."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(memoryview(column.buffers()[2])[offsets[0] : offsets[-1]], kind)


def counted(index: DataFrame, depth: int, least: int) -> DataFrame:
    """``(lang, size, phrase, f)``: phrases of 1 to ``depth`` words that occur ``least`` times or more, over all shards."""
    context = index.sparkSession.sparkContext
    bits = np.zeros(1 << (SLOT_BITS - 3), np.uint8)
    for size in range(1, depth + 1):
        held = context.broadcast(bits)
        bits = bits | full_slots(slot_counts(index, size, held), least)
        held.unpersist()
    held = context.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lang, words, bwt in zip(*(b.column(i) for i in range(3))):
                name, phrases = lang.as_py(), Phrases(words.as_py(), bwt.as_py())
                slots = Slots(name, phrases.words, held.value)
                spelled, prefix = np.array([b"", *phrases.words], object), name.encode() + b"\t"
                for size, (numbers, counts) in enumerate(phrases.sizes(depth, slots.full), 1):
                    if size == depth:
                        good = slots.full(numbers)
                        numbers, counts = numbers[good], counts[good]
                    for i in range(0, len(counts), _ROWS):
                        part = numbers[i : i + _ROWS]
                        own = [spelled[part[:, k]] for k in range(size)]
                        own[0] = prefix + own[0]
                        text = list(map(b" ".join, zip(*own)))
                        columns = [pa.array(text, pa.binary()).cast(pa.string()), pa.array(counts[i : i + _ROWS].astype(np.int64))]
                        yield pa.RecordBatch.from_arrays(columns, ["key", "f"])

    # Fewer and larger tasks have more shards' phrases in common, which are added up before they move.
    held_in = index.rdd.getNumPartitions()
    fewer = index.coalesce(max(1, held_in // COMBINED, min(held_in, context.defaultParallelism)))
    rows = fewer.select("lang", "words", "bwt").mapInArrow(run, "key string, f bigint")
    full = rows.groupBy("key").agg(F.sum("f").alias("f")).filter(F.col("f") >= least)
    phrase = F.substring_index("key", "\t", -1)
    lang = F.expr("substring(key, 1, char_length(key) - char_length(substring_index(key, '\t', -1)) - 1)")
    return full.select(lang.alias("lang"), F.size(F.split(phrase, " ")).alias("size"), phrase.alias("phrase"), "f")


def ratio(a: str, left: str, right: str) -> Column:
    """``floor(1000000 * a * a / (left * right))``, exactly."""
    wide = lambda c: F.col(c).cast("decimal(15,0)")
    top = (wide(a) * wide(a)).cast("decimal(31,0)") * F.lit(1_000_000).cast("decimal(7,0)")
    return F.call_function("div", top, wide(left) * wide(right)).cast("long")


def keyed(phrase: str | Column) -> Column:
    """A phrase of the row's language; it holds no tab, so this is unique."""
    return F.concat_ws("\t", "lang", phrase)


def collocations(docs: DataFrame, depth: int = DEPTH, least: int = LEAST, inside: int = INSIDE, top: int = TOP, pending: int = PENDING) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score`` of the first ``top`` phrases of each language.

    A phrase of 2 to ``depth`` words that occurs ``least`` times has the score of its weakest cut into two parts; it goes where a longer one
    that holds it occurs ``inside`` hundredths as often.
    """
    session_setup(docs.sparkSession)
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text")
    index = stored(shards(texts, depth, pending), "shards", "zstd", GROUP_SHARDS)
    totals = index.groupBy("lang").agg(F.sum("n").alias("n"))
    f = stored(counted(index, depth, least), "phrases")
    sized = {size: f.filter(F.col("size") == size).select(keyed("phrase").alias("part"), "f") for size in range(1, depth)}
    small = {size: broadcast_if_small(df) for size, df in sized.items()}
    words = F.split("phrase", " ")
    span = lambda begin, n: keyed(F.array_join(F.slice(words, begin, n), " "))

    def found(rows: DataFrame, size: int, part: Column, name: str) -> DataFrame:
        """``rows`` with the count of a part of ``size`` words; the parts of a candidate are frequent, so none is missing."""
        held = small[size].withColumnRenamed("f", name)
        # Where its measured size forbids a broadcast, both sides are plain shuffles, so a very common part is split as a skewed join partition.
        return rows.join(held, part == held["part"]).drop("part")

    scored, parts = [], []
    for size in range(2, depth + 1):
        rows = own = f.filter(F.col("size") == size).select("lang", "phrase", F.col("f").alias("a"))
        for k in range(1, size):
            rows = found(found(rows, k, span(1, k), f"l{k}"), size - k, span(k + 1, size - k), f"r{k}")
        cuts = [F.struct(ratio("a", f"l{k}", f"r{k}").alias("score"), F.lit(k).alias("cut"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")) for k in range(1, size)]
        scored.append(rows.select("lang", "phrase", "a", (F.least(*cuts) if size > 2 else cuts[0]).alias("c")))
        inner = [span(i, n) for n in range(2, size) for i in range(1, size - n + 2)]
        if inner:
            parts.append(own.select(F.col("a").alias("longest"), F.explode(F.array(*inner)).alias("part")))
    weakest = reduce(DataFrame.unionByName, scored)
    if parts:
        held = reduce(DataFrame.unionByName, parts).groupBy("part").agg(F.max("longest").alias("longest"))
        weakest = weakest.withColumn("part", keyed("phrase")).join(held, "part", "left").filter(F.col("longest").isNull() | (F.col("longest") * 100 < F.lit(inside) * F.col("a")))
    alone = weakest.select("lang", "phrase", "a", "c")
    order = Window.partitionBy("lang").orderBy(F.desc("c.score"), F.desc("a"), "phrase")
    first = alone.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return first.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "c.l", "c.r", "n", "c.score")


def op13_fm_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, string_split_regex(trim(piece, E' \t'), '[ \t]+') AS ws FROM p WHERE trim(piece, E' \t') <> ''),
g AS (SELECT lang, k AS size, array_to_string(ws[i : i + k - 1], ' ') AS phrase FROM w, unnest([1, 2, 3]) AS s(k), unnest(range(1, len(ws) - k + 2)) AS t(i)),
f AS (SELECT lang, size, phrase, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, sum(f) AS n FROM f WHERE size = 1 GROUP BY lang),
c AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE size > 1 AND f >= 10),
cuts AS (SELECT c.lang, c.phrase, c.size, c.a, k, x.f AS l, y.f AS r, CAST(1000000 AS HUGEINT) * c.a * c.a // (CAST(x.f AS HUGEINT) * y.f) AS score
         FROM (SELECT *, unnest(range(1, size)) AS k FROM c) c
         JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(ws[1 : k], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(ws[k + 1 : c.size], ' ')),
low AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
held AS (SELECT lang, phrase, max(a) AS longest FROM (SELECT lang, a, array_to_string(ws[i : i + 1], ' ') AS phrase FROM c, unnest([1, 2]) AS t(i) WHERE size = 3) GROUP BY ALL),
alone AS (SELECT low.* FROM low LEFT JOIN held USING (lang, phrase) WHERE longest IS NULL OR 100 * longest < 50 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM alone JOIN n USING (lang) QUALIFY rank <= 2000
"""
