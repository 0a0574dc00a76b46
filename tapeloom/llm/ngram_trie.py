"""Language-model scoring with an Elias-Fano n-gram trie in memory-mapped levels.

Level 1 holds the words as a monotone sequence of 64-bit hashes, with exact counts; a word's number is
its place. A node of level k is a successor of a node of level k - 1, its context. A level holds the
contexts that have successors, a monotone sequence of pointers that gives a context's range, and the
monotone sequence ``range begin * base + range size * word number``, in which a successor is searched
inside the range of its context. A node's number is its place, and is its name as a context of level
k + 1. With every node goes the numerator of its probability, its count, quantised to 16 bits: exact below
2^15, above it in steps of its logarithm.

Smoothing: ``P(w | h) = max(c(h, w) - D, 0) / c(h) + D s(h) / c(h) P(w | shorter h)``, ``s(h)`` being the
number of successors of ``h`` (its range), and ``P(w)`` the base estimate. No n-gram is left out. Texts
begin with ``order - 1`` different start symbols, so that the first tokens have full contexts.

Spark counts the words, and encodes each text once as word numbers. For a level, a task gathers
``CHUNK`` tokens, looks up their contexts, and sends each shard its distinct n-grams as one Elias-Fano
coded row with their counts. A shard is a range of scattered context numbers; one task merges its rows
and writes its file to the shared folder. Shards grow in number with the corpus and not in size: copies are counts, and a
context with very many successors is cut along these into ``parts``. Scoring tasks map the files and ask for the
distinct n-grams of ``CHUNK`` tokens in the order of the files. The driver sees lists of files and a few totals.

Defined results: a null text is empty and has one token, the end; rows that repeat count as often as
they stand; a null id counts as the empty text in the fold; without training rows all counts are 0
and the base is log10(0.1 / 0.1) = 0; an empty table gives no rows. Only the id and the text are read.
More than 2^32 different words raise an error.
"""

from __future__ import annotations

import functools
import json
import os
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.llm.common import fresh_path, session_setup, stored, table
from tapeloom.llm.elias_fano import EliasFano
from tapeloom.llm.string_kernel import folds

END = b"\n</s>"  # no word holds a line feed
DISCOUNT = 0.75
#: Words, or tokens of the n-grams, of a shard.
SHARD_ROWS = 6_000_000
#: Distinct words that a counting task gathers before it passes sums on.
GATHERED = 2_000_000
#: Bytes of texts that are split together.
TEXT_BYTES = 8 << 20
#: Tokens that are looked up together.
CHUNK = 1_500_000
#: Counts below this are kept as they are, others in so many steps of a power of ten.
EXACT, STEPS = 1 << 15, 3000
_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))


# ---- tokens ----

def split_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """``(codes, sizes, kinds)``: all tokens as places in ``kinds``, whose last is the end that closes each text."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))  # at 0x20 and 0x09-0x0D
    coded = lists.flatten().dictionary_encode()
    codes, kinds = coded.indices.to_numpy(), coded.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()
    held = np.diff(lists.offsets.to_numpy())
    blank = kinds.index(b"") if b"" in kinds else -1
    real = codes != blank
    sizes = np.bincount(np.repeat(np.arange(len(texts)), held)[real], minlength=len(texts)) + 1
    out = np.full(int(sizes.sum()), len(kinds), np.int64)
    inside = np.ones(len(out), bool)
    inside[np.cumsum(sizes) - 1] = False
    out[inside] = codes[real]
    return out, sizes, [*kinds, END]


def gathered(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[pa.RecordBatch]:
    """Batches joined until their texts, column ``at``, have ``TEXT_BYTES``: words that repeat are then hashed once."""
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.column(at).nbytes
        if size >= TEXT_BYTES:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def word_hashes(kinds: list[bytes]) -> np.ndarray:
    """64-bit hashes in the order of level 1."""
    import xxhash

    return np.fromiter(map(xxhash.xxh3_64_intdigest, kinds), np.uint64, len(kinds))


def changed(*columns: np.ndarray) -> np.ndarray:
    """Rows that differ from the row before; the first one does."""
    out = np.zeros(len(columns[0]), bool)
    out[:1] = True
    for x in columns:
        out[1:] |= x[1:] != x[:-1]
    return out


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sums of their counts."""
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    all_keys, all_counts = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(all_keys)
    all_keys, all_counts = all_keys[order], all_counts[order]
    first = np.flatnonzero(changed(all_keys))
    return all_keys[first], np.add.reduceat(all_counts, first) if len(first) else all_counts


def word_counts(docs: DataFrame) -> DataFrame:
    """``(h, c)`` of all tokens; tasks pass on sums, Spark adds them up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, held = [], [], 0

        def out():
            k, c = _summed(keys, counts)
            return pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(c)], ["h", "c"])

        for b in gathered(batches, 0):
            codes, _, kinds = split_words(b.column(0))
            c = np.bincount(codes, minlength=len(kinds))
            keys.append(word_hashes(kinds)[c > 0])
            counts.append(c[c > 0])
            held += len(keys[-1])
            if held >= GATHERED:
                k, c = _summed(keys, counts)
                keys, counts, held = [k], [c], len(k)
                if held >= GATHERED // 2:
                    yield out()
                    keys, counts, held = [], [], 0
        yield out()

    return docs.select("text").mapInArrow(run, "h bigint, c bigint").groupBy("h").agg(F.sum("c").alias("c"))


# ---- files in the shared folder ----

def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_arrays(uri: str, arrays: dict[str, np.ndarray]) -> None:
    """A header of names, types and places, then the arrays; renamed into place when whole."""
    fs, path = _filesystem(uri)
    fs.create_dir(os.path.dirname(path), recursive=True)
    at, head = 0, {}
    for name, x in arrays.items():
        head[name] = [x.dtype.str, len(x), at]
        at += -(-x.nbytes // 64) * 64
    text = json.dumps(head).encode()
    text = text.ljust(-(-(len(text) + 8) // 64) * 64 - 8)
    part = f"{path}.{uuid.uuid4().hex}"
    with fs.open_output_stream(part) as f:
        f.write(len(text).to_bytes(8, "little") + text)
        for x in arrays.values():
            f.write(np.ascontiguousarray(x).tobytes().ljust(-(-x.nbytes // 64) * 64, b"\0"))
    fs.move(part, path)


@functools.lru_cache(maxsize=4096)
def map_arrays(uri: str) -> dict[str, np.ndarray]:
    """The arrays of a file, memory-mapped; from a store without local paths it comes to Spark's own folder of this executor first."""
    if uri.startswith("file:") or "://" not in uri:
        path = uri.removeprefix("file://") if uri.startswith("file://") else uri.removeprefix("file:")
    else:
        from pyspark import SparkFiles

        fs, remote = _filesystem(uri)
        path = os.path.join(SparkFiles.getRootDirectory(), "levels-" + remote.strip("/").replace("/", "_"))
        if not os.path.exists(path):
            with fs.open_input_stream(remote) as src, open(part := f"{path}.{uuid.uuid4().hex}", "wb") as dst:
                while chunk := src.read(1 << 22):
                    dst.write(chunk)
            os.replace(part, path)
    data = np.asarray(np.memmap(path, np.uint8, "r"))
    size = int.from_bytes(data[:8].tobytes(), "little")
    head = json.loads(data[8 : 8 + size].tobytes())
    return {name: data[8 + size + at : 8 + size + at + n * np.dtype(kind).itemsize].view(kind) for name, (kind, n, at) in head.items()}


def _quantised(counts: np.ndarray) -> np.ndarray:
    large = EXACT + np.round(STEPS * np.log10(np.maximum(counts, EXACT) / EXACT))
    return np.where(counts < EXACT, counts, np.minimum(large, 65_535)).astype(np.uint16)


def _restored(q: np.ndarray) -> np.ndarray:
    q = q.astype(np.float64)
    return np.where(q < EXACT, q, EXACT * 10.0 ** (np.maximum(q - EXACT, 0) / STEPS))


def _written(rows: DataFrame, shards: int, write) -> list[tuple[int, str, int]]:
    """Bring the rows of each shard to one task, which ``write(shard, batches)`` gives the file's path and number of nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, done = None, [], []
        for b in batches:
            shard = b.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(shard[1:] != shard[:-1]) + 1).tolist(), len(shard)]
            for lo, hi in zip(cuts, cuts[1:]):
                if hi > lo:
                    if now is not None and shard[lo] != now:
                        done.append((int(now), *write(int(now), held)))
                        held = []
                    now = shard[lo]
                    held.append(b.slice(lo, hi - lo))
        if held:
            done.append((int(now), *write(int(now), held)))
        columns = [pa.array([x[i] for x in done], t) for i, t in enumerate((pa.int32(), pa.string(), pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, ["shard", "uri", "nodes"])

    dealt = rows.repartitionById(shards, "shard").sortWithinPartitions("shard")
    return sorted(tuple(r) for r in dealt.mapInArrow(run, "shard int, uri string, nodes bigint").collect())


# ---- level 1 ----

@dataclass
class Words:
    """Level 1: files of hash ranges by shard, with the number of the first word of each."""

    files: dict[int, tuple[str, int]]
    bits: int
    n: int
    v: int
    texts: int

    def numbers(self, h: np.ndarray) -> np.ndarray:
        """Numbers of word hashes; -1 for unknown words."""
        out = np.full(len(h), -1, np.int64)
        shard = (h >> np.uint64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(h), np.int64)
        for k in np.unique(shard).tolist():
            if k in self.files:
                uri, first = self.files[k]
                at = np.flatnonzero(shard == k)
                place, same = EliasFano.of(map_arrays(uri), "words").successor(h[at])
                out[at[same]] = first + place[same]
        return out

    def counts(self, number: np.ndarray) -> np.ndarray:
        """Counts of words by number, of texts for start symbols, and 0 for unknown words."""
        out = np.where(number >= self.v, float(self.texts), 0.0)
        order = sorted(self.files.values(), key=lambda x: x[1])
        live = np.flatnonzero((number >= 0) & (number < self.v))
        of_file = np.searchsorted(np.array([first for _, first in order], np.int64), number[live], "right") - 1
        for k in np.unique(of_file).tolist() if len(order) > 1 else range(len(order)):
            at = live[of_file == k] if len(order) > 1 else live
            out[at] = map_arrays(order[k][0])["count"][number[at] - order[k][1]]
        return out


def build_words(train: DataFrame, shard_rows: int = SHARD_ROWS) -> Words:
    """Count the words of ``train (text)`` and write level 1."""
    spark = train.sparkSession
    session_setup(spark)
    counts = stored(word_counts(train), "word_counts")
    end = int(word_hashes([END]).view(np.int64)[0])
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v"), F.coalesce(F.max(F.when(F.col("h") == end, F.col("c"))), F.lit(0)).alias("texts")).first()
    if total["v"] >= 1 << 32:
        raise ValueError("more than 2^32 different words")
    folder, bits = fresh_path(spark, "trie"), int(total["v"] // shard_rows).bit_length()

    def write(shard: int, batches: list[pa.RecordBatch]) -> tuple[str, int]:
        h, c = (np.concatenate([b.column(i).to_numpy() for b in batches]) for i in (1, 2))
        h = h.view(np.uint64)
        order = np.argsort(h)
        write_arrays(uri := f"{folder}/1-{shard}.level", EliasFano.build(h[order], (1 << 64) - 1).arrays("words") | {"count": c[order]})
        return uri, len(h)

    shard = F.shiftrightunsigned("h", 64 - bits) if bits else F.lit(0)
    files = _written(counts.select(shard.cast("int").alias("shard"), "h", "c"), 1 << bits, write)
    first = np.concatenate([[0], np.cumsum([n for *_, n in files], dtype=np.int64)]).tolist()
    return Words({k: (uri, at) for (k, uri, _), at in zip(files, first)}, bits, total["n"], total["v"], total["texts"])


def encode(docs: DataFrame, words: Words) -> DataFrame:
    """The columns of ``docs`` but the text, ``n_tokens, n_known, base_score`` and ``ids``: word numbers as planes of bytes."""
    session_setup(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(words)
    others = [c for c in docs.columns if c != "text"]
    dealt = docs.select(*others, "text")
    names = [*others, "n_tokens", "n_known", "base_score", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        floor = w.n + 0.1 * (w.v + 1)
        for b in gathered(batches, len(others)):
            codes, sizes, kinds = split_words(b.column(len(others)))
            number = w.numbers(word_hashes(kinds))
            count = w.counts(number)
            base = np.log10((count + 0.1) / floor)
            begins = np.cumsum(sizes) - sizes
            known, score = (np.add.reduceat(x[codes], begins) if len(sizes) else x[:0] for x in ((count > 0).astype(np.int64), base))
            ids = number.astype(np.uint32)[codes]  # -1 is the largest
            planes = [x.view(np.uint8).reshape(-1, 4).T.tobytes() for x in np.split(ids, begins[1:])] if len(sizes) else []
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(sizes), pa.array(known), pa.array(score), pa.array(planes, pa.binary())], names)

    schema = docs.select(*others, *(F.lit(0).cast("long").alias(c) for c in names[-4:-2]), F.lit(0.0).alias("base_score"), F.lit(b"").alias("ids")).schema
    return dealt.mapInArrow(run, schema)


# ---- levels of n-grams ----

@dataclass
class Level:
    """Files by shard with the number of each one's first node. Contexts are below ``2 ** bits``, successors below ``base``."""

    bits: int
    shard_bits: int
    parts: int
    base: int
    files: dict[int, tuple[str, int]] = field(default_factory=dict)
    nodes: int = 0

    def scattered(self, context: np.ndarray, part: np.ndarray | int) -> np.ndarray:
        """Context numbers dealt anew over ``2 ** bits``, one to one, so that ranges of them are of like sizes."""
        mask, by = np.uint64((1 << self.bits) - 1), np.uint64(max(1, (self.bits + 1) // 2))
        x = (context * self.parts + part).astype(np.uint64)
        for odd in _ODD:
            x = x * odd & mask
            x ^= x >> by
        return x

    def part_of(self, after: np.ndarray) -> np.ndarray | int:
        return after * self.parts // self.base if self.parts > 1 else 0

    def order_of(self, c: np.ndarray, after: np.ndarray) -> np.ndarray:
        if self.bits + self.base.bit_length() < 64:
            return np.argsort(c * np.uint64(self.base) + after.astype(np.uint64))
        return np.lexsort((after, c))

    def shards_of(self, c: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """``(shard, from, to)`` of sorted ``c``."""
        shard = (c >> np.uint64(self.bits - self.shard_bits)).astype(np.int64)
        cuts = np.flatnonzero(changed(shard)).tolist()
        return ((int(shard[lo]), lo, hi) for lo, hi in zip(cuts, [*cuts[1:], len(c)]))

    def local(self, c: np.ndarray) -> np.ndarray:
        return c & np.uint64((1 << (self.bits - self.shard_bits)) - 1)

    def find(self, context: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(node, count, held)``: the node of each successor (-1: none), its count, the successors of its context."""
        node, count, held = np.full(len(context), -1, np.int64), np.zeros(len(context)), np.zeros(len(context), np.int64)
        live = np.flatnonzero(context >= 0)
        c, w = self.scattered(context[live], self.part_of(after[live])), after[live]
        order = self.order_of(c, w)
        live, c, w = live[order], c[order], w[order]
        first = changed(c, w)
        group, c, w = np.cumsum(first) - 1, c[first], w[first]
        of_node, of_count, of_held = np.full(len(c), -1, np.int64), np.zeros(len(c)), np.zeros(len(c), np.int64)
        for shard, lo, hi in self.shards_of(c):
            if shard not in self.files:
                continue
            uri, number = self.files[shard]
            a = map_arrays(uri)
            local = self.local(c[lo:hi])
            heads = changed(local)
            place, same = EliasFano.of(a, "contexts").successor(local[heads])
            begin, end = np.zeros((2, len(place)), np.int64)
            begin[same], end[same] = (EliasFano.of(a, "ranges").access(place[same] + i) for i in (0, 1))
            of = np.cumsum(heads) - 1
            of_held[lo:hi] = (end - begin)[of]
            at = np.flatnonzero(same[of])
            begin, size = begin[of[at]].astype(np.uint64), of_held[lo + at].astype(np.uint64)
            found, hit = EliasFano.of(a, "next").successor(begin * np.uint64(self.base) + size * w[lo + at].astype(np.uint64))
            at, found = lo + at[hit], found[hit]
            of_node[at], of_count[at] = number + found, _restored(a["count"][found])
        node[live], count[live], held[live] = of_node[group], of_count[group], of_held[group]
        if self.parts > 1:
            held = self.all_held(context)
        return node, count, held

    def all_held(self, context: np.ndarray) -> np.ndarray:
        """Successors of each context over all its parts."""
        kinds, to = np.unique(context, return_inverse=True)
        held = np.zeros(len(kinds), np.int64)
        for part in range(self.parts):
            live = np.flatnonzero(kinds >= 0)
            c = self.scattered(kinds[live], part)
            order = np.argsort(c)
            live, c = live[order], c[order]
            for shard, lo, hi in self.shards_of(c):
                if shard in self.files:
                    a = map_arrays(self.files[shard][0])
                    place, same = EliasFano.of(a, "contexts").successor(self.local(c[lo:hi]))
                    begin, end = (EliasFano.of(a, "ranges").access(place[same] + i).astype(np.int64) for i in (0, 1))
                    held[live[lo:hi][same]] += end - begin
        return held[to]

    def rows(self, context: np.ndarray, after: np.ndarray) -> Iterator[tuple[int, bytes, bytes]]:
        """For each shard its distinct successors, coded, and their counts."""
        live = np.flatnonzero(context >= 0)
        c, w = self.scattered(context[live], self.part_of(after[live])), after[live]
        order = self.order_of(c, w)
        c, w = c[order], w[order]
        first = np.flatnonzero(changed(c, w))
        count = np.diff(np.append(first, len(c)))
        c, w = c[first], w[first]
        top = (1 << (self.bits - self.shard_bits)) * self.base - 1
        for shard, lo, hi in self.shards_of(c):
            keys = self.local(c[lo:hi]) * np.uint64(self.base) + w[lo:hi].astype(np.uint64)
            yield shard, EliasFano.build(keys, top).to_bytes(), _coded_counts(count[lo:hi])

    def arrays(self, keys: np.ndarray, counts: np.ndarray) -> dict[str, np.ndarray]:
        """A shard's file from its sorted keys ``context * base + successor``."""
        base = np.uint64(self.base)
        context, after = keys // base, keys % base
        first = np.flatnonzero(changed(context))
        ranges = np.append(first, len(keys))
        held = np.diff(ranges)
        following = np.repeat(first, held).astype(np.uint64) * base + np.repeat(held, held).astype(np.uint64) * after
        top = (1 << (self.bits - self.shard_bits)) - 1
        return (EliasFano.build(context[first], top).arrays("contexts") | EliasFano.build(ranges, len(keys)).arrays("ranges")
                | EliasFano.build(following, len(keys) * self.base - 1).arrays("next") | {"count": _quantised(counts)})


def _coded_counts(c: np.ndarray) -> bytes:
    kind = next(k for k in ("u1", "u2", "u4", "u8") if c.max() - 1 <= np.iinfo(k).max)
    return kind.encode() + zlib.compress((c - 1).astype(kind).tobytes(), 1)


def _read_counts(raw: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(raw[2:]), raw[:2].decode()).astype(np.int64) + 1


@dataclass
class Trie:
    """The levels of words, of pairs, of triples and so on."""

    words: Words
    levels: list[Level]
    order: int

    @property
    def n(self) -> int:
        return self.words.n

    def sequences(self, planes: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers of encoded texts with their start symbols, and the texts' first places."""
        ids = [np.frombuffer(x, np.uint8).reshape(4, -1).T.copy().view(np.uint32).ravel() for x in planes]
        starts = np.arange(self.order - 1, dtype=np.int64) + self.words.v
        flat = np.concatenate([y for x in ids for y in (starts, x)]).astype(np.int64)
        flat[flat == 0xFFFFFFFF] = self.words.v + self.order - 1  # an unknown word
        return flat, np.cumsum([0] + [len(x) + self.order - 1 for x in ids[:-1]])

    def contexts(self, node: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """What stands before each place; -1 at the beginning of a text."""
        out = np.empty_like(node)
        out[1:] = node[:-1]
        out[begins] = -1
        return out

    def contexts_of_level(self, flat: np.ndarray, begins: np.ndarray, k: int) -> np.ndarray:
        """Contexts for level ``k``: word numbers for pairs, else nodes of the level before."""
        context = self.contexts(flat, begins)
        for level in self.levels[: k - 2]:
            context = self.contexts(level.find(context, flat)[0], begins)
        return context

    def log_probabilities(self, flat: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """log10 of each token's probability; 0 at start symbols."""
        w = self.words
        known = np.where(flat < w.v + self.order - 1, flat, -1)
        count = w.counts(known)
        p = (np.where(flat < w.v, count, 0.0) + 0.1) / (w.n + 0.1 * (w.v + 1))
        context, seen = self.contexts(known, begins), np.append(0.0, count[:-1])
        for level in self.levels:
            node, count, held = level.find(context, flat)
            at = np.flatnonzero(held)
            p[at] = (np.maximum(count[at] - DISCOUNT, 0) + DISCOUNT * held[at] * p[at]) / seen[at]
            context, seen = self.contexts(node, begins), np.append(0.0, count[:-1])
        p[(begins[:, None] + np.arange(self.order - 1)).ravel()] = 1.0
        return np.log10(p)


def _chunks(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[tuple[list[pa.RecordBatch], list[bytes]]]:
    """Batches and their column ``at`` of word numbers, gathered up to ``CHUNK`` tokens."""
    held, planes, size = [], [], 0
    for b in batches:
        for lo in range(0, b.num_rows, 64):
            piece = b.slice(lo, 64)
            held.append(piece)
            own = piece.column(at).to_pylist()
            planes += own
            size += sum(map(len, own)) // 4
            if size >= CHUNK:
                yield held, planes
                held, planes, size = [], [], 0
    if planes:
        yield held, planes


def build_levels(encoded: DataFrame, words: Words, order: int = 3, shard_rows: int = SHARD_ROWS) -> Trie:
    """Count the n-grams of ``encoded (ids)`` and write the levels from 2 to ``order``."""
    spark = encoded.sparkSession
    folder = fresh_path(spark, "trie")
    trie = Trie(words, [], order)
    base = words.v + order
    parts = 1 + min(words.n, words.v) // shard_rows
    for k in range(2, order + 1):
        kinds = (trie.levels[-1].nodes if trie.levels else base) * parts
        bits = max(1, int(kinds - 1).bit_length())
        level = Level(bits, min(bits, int(words.n // shard_rows).bit_length()), parts, base)
        shared = spark.sparkContext.broadcast((trie, level))

        def run(batches: Iterator[pa.RecordBatch], k=k, shared=shared) -> Iterator[pa.RecordBatch]:
            model, of = shared.value
            for _, planes in _chunks(batches, 0):
                flat, begins = model.sequences(planes)
                rows = list(of.rows(model.contexts_of_level(flat, begins, k), flat))
                columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.binary(), pa.binary()))]
                yield pa.RecordBatch.from_arrays(columns, ["shard", "grams", "counts"])

        def write(shard: int, batches: list[pa.RecordBatch], k=k, level=level) -> tuple[str, int]:
            keys, counts, held = [], [], 0
            for b in batches:
                for grams, count in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                    keys.append(EliasFano.from_bytes(grams).values())
                    counts.append(_read_counts(count))
                    held += len(keys[-1])
                if held > 2 * GATHERED:
                    keys, counts = ([x] for x in _summed(keys, counts))
                    held = len(keys[0])
            total, count = _summed(keys, counts)
            write_arrays(uri := f"{folder}/{k}-{shard}.level", level.arrays(total, count))
            return uri, len(total)

        files = _written(encoded.select("ids").mapInArrow(run, "shard int, grams binary, counts binary"), 1 << level.shard_bits, write)
        first = np.concatenate([[0], np.cumsum([n for *_, n in files], dtype=np.int64)]).tolist()
        level.files, level.nodes = {s: (uri, at) for (s, uri, _), at in zip(files, first)}, first[-1]
        trie.levels.append(level)
    return trie


def build_trie(train: DataFrame, order: int = 3, shard_rows: int = SHARD_ROWS) -> Trie:
    """All levels of ``train (text)``."""
    words = build_words(train, shard_rows)
    return build_levels(stored(encode(train.select("text"), words), "encoded"), words, order, shard_rows)


def score_encoded(encoded: DataFrame, trie: Trie) -> DataFrame:
    """The columns of ``encoded`` but ``ids``, and ``score``."""
    shared = encoded.sparkSession.sparkContext.broadcast(trie)
    others = [c for c in encoded.columns if c != "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for held, planes in _chunks(batches, len(others)):
            flat, begins = model.sequences(planes)
            score = pa.array(np.add.reduceat(model.log_probabilities(flat, begins), begins))
            at = 0
            for b in held:
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], score.slice(at, b.num_rows)], [*others, "score"])
                at += b.num_rows

    schema = encoded.select(*others, F.lit(0.0).alias("score")).schema
    return encoded.select(*others, "ids").mapInArrow(run, schema)


def score(docs: DataFrame, trie: Trie) -> DataFrame:
    """``(doc_id, n_tokens, n_known, base_score, score)`` of every row of ``docs``."""
    return score_encoded(encode(docs.select("doc_id", "text"), trie.words), trie)


def op6_ngram_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", (folds(F.col("doc_id"), 10) == 0).alias("held_out"), "text")
    words = build_words(docs.filter("not held_out"))
    encoded = stored(encode(docs, words), "encoded")
    trie = build_levels(encoded.filter("not held_out"), words)
    done = score_encoded(encoded, trie)
    return done.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(trie.n).cast("long").alias("train_tokens"), "base_score", "score")
