"""Periodic runs of words: maximal repetitions of a document, and its text with every run cut to one period.

A run is a stretch of consecutive words with a smallest period q, at least ``least`` words and ``times`` periods long, that neither neighbouring
word extends. All runs are found from Lyndon roots: in one of the two orders of words (the second turned round) the longest Lyndon word at some
place of a run is its period. So every place gives one candidate in each order, the stretch up to the next smaller suffix, which is extended both
ways by longest common extensions. These are depths of lowest common ancestors in two suffix trees, of the words and of the words reversed: built by
Ukkonen's algorithm, toured once (Euler), and answered in constant time by least depths of blocks of the tour.

Trees take memory and time in proportion to their words but with a large factor, so they are built over the stretches where a run can be. A run of
period q holds ``L - q - k + 1`` consecutive places whose k-gram stood q places before (k = least // times). Stretches of places whose k-gram stood
before, no farther than a period that a run of the stretch's size could have, are thus kept, with all words that such a run could reach and one
more on either side; elsewhere there is no run. No run is lost, and none is cut.

Defined results: a null, empty or wordless text has no words and no runs; rows that repeat are treated alike, each on its own; an empty table gives no
rows; words are bytes between ASCII white space, so case and punctuation count. Only the id and the text are read, so other columns cannot clash.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.llm.common import session_setup, table
from tapeloom.llm.minhash import WordHashes, mixed

LEAST, TIMES = 24, 3
#: Places of the tour whose least depth is one entry of the table.
_BLOCK = 16
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def suffix_tree(s: list[int], width: int) -> tuple[list[int], list[int], dict[int, int]]:
    """Ukkonen's tree of ``s``, whose last symbol stands nowhere else: beginnings and ends of edges, and ``{node * width + symbol: child}``."""
    n = len(s)
    begin, end, link, kids = [0], [0], [0], {}
    node = edge = length = waiting = 0
    for i, c in enumerate(s):
        waiting += 1
        last = 0
        while waiting:
            if not length:
                edge = i
            key = node * width + s[edge]
            child = kids.get(key)
            if child is None:
                kids[key] = len(begin)
                begin.append(i)
                end.append(n)
                link.append(0)
                if last:
                    link[last] = node
                    last = 0
            else:
                b, e = begin[child], end[child]
                size = (e if e <= i else i + 1) - b
                if length >= size:  # walk down
                    edge += size
                    length -= size
                    node = child
                    continue
                if s[b + length] == c:
                    if last:
                        link[last] = node
                    length += 1
                    break
                split = len(begin)
                kids[key] = split
                kids[split * width + c] = split + 1
                kids[split * width + s[b + length]] = child
                begin += (b, i)
                end += (b + length, n)
                link += (0, 0)
                begin[child] = b + length
                if last:
                    link[last] = split
                last = split
            waiting -= 1
            if node:
                node = link[node]
            elif length:
                length -= 1
                edge = i - waiting + 1
    return begin, end, kids


class Extensions:
    """Longest common extensions of suffixes, and the suffixes' ranks in both orders of symbols."""

    def __init__(self, symbols: np.ndarray, orders: bool):
        s = [*(symbols + 1).tolist(), 0]  # the end is the least symbol in both orders
        self.n, width = len(s), int(symbols.max(initial=0)) + 2
        begin, end, kids = suffix_tree(s, width)
        keys = np.fromiter(kids.keys(), np.int64, len(kids))
        child = np.fromiter(kids.values(), np.int64, len(kids))
        up = np.argsort(keys)
        self._tour(np.array(end) - np.array(begin), keys[up] // width, child[up])
        if orders:
            self.rank = self._ranks(self.leaves)
            symbol = keys % width
            down = np.lexsort([np.where(symbol == 0, 0, width - symbol), keys // width])
            self.turned = self._ranks(self._leaves(np.array(end) - np.array(begin), keys[down] // width, child[down]))

    @staticmethod
    def _stops(parents: np.ndarray, nodes: int) -> list[int]:
        """Where the children of each node end, in the list sorted by parent; they begin where those of the node before end."""
        return np.cumsum(np.bincount(parents, minlength=nodes)).tolist()

    def _tour(self, sizes: np.ndarray, parents: np.ndarray, children: np.ndarray) -> None:
        """Depths along the Euler tour, the place of each suffix in it, and the suffixes in order."""
        stop, kids, size, n = self._stops(parents, len(sizes)), children.tolist(), sizes.tolist(), self.n
        at = [0, *stop[:-1]]
        tour, leaves, places = [0], [], [0] * n
        path, depths, visited = [0], [0], 1
        while path:
            node = path[-1]
            k = at[node]
            if k == stop[node]:
                path.pop()
                depths.pop()
                if path:
                    tour.append(depths[-1])
                    visited += 1
                continue
            at[node] = k + 1
            child = kids[k]
            depth = depths[-1] + size[child]
            tour.append(depth)
            visited += 1
            if at[child] == stop[child]:  # a leaf: its depth is the suffix's length
                places[n - depth] = visited - 1
                leaves.append(n - depth)
                tour.append(depths[-1])
                visited += 1
            else:
                path.append(child)
                depths.append(depth)
        self.places, self.leaves = np.array(places), np.array(leaves)
        tour += [max(tour)] * (-len(tour) % _BLOCK)
        rows = np.array(tour, np.int64).reshape(-1, _BLOCK)
        self.tour = rows.ravel()
        self.before = np.minimum.accumulate(rows, axis=1).ravel()
        self.after = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        self.levels = [rows.min(axis=1)]
        while (step := 1 << (len(self.levels) - 1)) * 2 <= len(rows):
            low = self.levels[-1]
            self.levels.append(np.minimum(low[:-step], low[step:]))

    def _leaves(self, sizes: np.ndarray, parents: np.ndarray, children: np.ndarray) -> np.ndarray:
        stop, kids, size, n = self._stops(parents, len(sizes)), children.tolist(), sizes.tolist(), self.n
        todo, leaves = [(0, 0)], []
        while todo:
            node, depth = todo.pop()
            first = stop[node - 1] if node else 0
            if first == stop[node]:
                leaves.append(n - depth)
            else:
                todo += [(c, depth + size[c]) for c in reversed(kids[first : stop[node]])]
        return np.array(leaves)

    @staticmethod
    def _ranks(leaves: np.ndarray) -> np.ndarray:
        rank = np.empty(len(leaves), np.int64)
        rank[leaves] = np.arange(len(leaves))
        return rank

    def lce(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Symbols that the suffixes at ``a`` and ``b`` share at their beginning; ``a <> b``, and the end counts as a suffix."""
        x, y = self.places[a], self.places[b]
        x, y = np.minimum(x, y), np.maximum(x, y)
        lo, hi = x // _BLOCK, y // _BLOCK
        out = np.minimum(self.after[x], self.before[y])
        for level in range(len(self.levels)):
            width = hi - lo - 1
            at = np.flatnonzero((width >= 1 << level) & (width < 2 << level))
            if len(at):
                low = self.levels[level]
                out[at] = np.minimum(out[at], np.minimum(low[lo[at] + 1], low[hi[at] - (1 << level)]))
        at = np.flatnonzero(lo == hi)
        if len(at):
            places = np.minimum(x[at, None] + np.arange(_BLOCK), y[at, None])
            out[at] = self.tour[places].min(axis=1)
        return out


def next_smaller(rank: np.ndarray) -> np.ndarray:
    """For each suffix the next one that is smaller: the stretch between is the longest Lyndon word there."""
    r = rank.tolist()
    n = len(r)
    out = [n] * n
    for i in range(n - 2, -1, -1):
        j, mine = i + 1, r[i]
        while j < n and r[j] > mine:
            j = out[j]
        out[i] = j
    return np.array(out, np.int64)


def runs_of(symbols: np.ndarray, least: int, times: int) -> np.ndarray:
    """``(start, length, period)`` of all runs of ``symbols``, numbers from 0, by start and period."""
    n = len(symbols)
    forward = Extensions(symbols, orders=True)
    pairs = np.unique(np.concatenate([np.arange(n) * (n + 1) + next_smaller(rank[:n]) for rank in (forward.rank, forward.turned)]))
    i, j = pairs // (n + 1), pairs % (n + 1)
    right = np.where(j < n, forward.lce(i, np.minimum(j, n)), 0)
    backward = Extensions(symbols[::-1], orders=False)
    left = np.where(i > 0, backward.lce(n - i, n - j), 0)
    start, period = i - left, j - i
    length = j + right - start
    good = length >= np.maximum(least, times * period)
    runs = np.column_stack([start, period, length])[good]
    return np.unique(runs, axis=0)[:, [0, 2, 1]].reshape(-1, 3)


def stretches(hashes: np.ndarray, least: int, times: int) -> list[tuple[int, int]]:
    """Stretches ``(begin, end)``, apart from each other, outside of which no run of words with these 64-bit hashes has a word."""
    n, k = len(hashes), max(1, least // times)
    if n < least:
        return []
    h = np.zeros(n - k + 1, np.uint64)
    for i in range(k):
        h = h * _GOLD + hashes[i : n - k + 1 + i]
    # One sort brings equal k-grams together in order of place. Grams that share their hash by chance only add stretches.
    bits = np.uint64(n.bit_length())
    order = np.sort((mixed(h) << bits) | np.arange(len(h), dtype=np.uint64))
    place = (order & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    again = (order[1:] ^ order[:-1]) >> bits == 0
    if not again.any():
        return []
    back = np.full(len(h), n + 1)
    back[place[1:][again]] = (place[1:] - place[:-1])[again]
    shortest = -(-least * (times - 1) // times) - k + 1
    live = back <= n
    while True:
        edges = np.flatnonzero(np.diff(live, prepend=False, append=False))
        lo, hi = edges[::2], edges[1::2]  # places lo to hi - 1
        most = (hi - lo + k - 1) // (times - 1)
        keep = hi - lo >= shortest
        new = np.zeros(len(h), bool)
        for a, b, q in zip(lo[keep], hi[keep], most[keep]):
            new[a:b] = back[a:b] <= q
        if (new == live).all():
            break
        live = new
    out: list[tuple[int, int]] = []
    for a, b, q in sorted(zip((lo - most - 1).tolist(), (hi + k).tolist(), most.tolist())):
        a, b = max(a, 0), min(b, n)
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def all_runs(words: list[bytes], hashes: WordHashes, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of every run of ``words``, by start and period."""
    if len(words) < least:
        return []
    out = []
    for a, b in stretches(np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words)), least, times):
        numbers: dict[bytes, int] = {}
        symbols = np.array([numbers.setdefault(w, len(numbers)) for w in words[a:b]], np.int64)
        out += [(int(s) + a, int(length), int(p)) for s, length, p in runs_of(symbols, least, times)]
    return out


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """``words`` without those that stand after the first period of a run."""
    if not runs:
        return b" ".join(words)
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return b" ".join([words[i] for i in np.flatnonzero(keep)])


def periodic_runs(docs: DataFrame, least: int = LEAST, times: int = TIMES, rewrite: Callable[[object, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """One row per document: ``doc_id, n_words, runs`` (start, length, period), ``collapsed`` (bytes); ``rewrite(id, words)`` comes first."""
    session_setup(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    run_type = pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in batches:
            sizes, runs, texts = [], [], []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                words = (text.as_py() or "").encode("utf-8", "surrogatepass").split()  # splits at 0x20, 0x09-0x0D
                words = rewrite(doc, words) if rewrite else words
                found = all_runs(words, hashes, least, times)
                sizes.append(len(words))
                runs.append([dict(zip(("start", "length", "period"), r)) for r in found])
                texts.append(collapsed(words, found))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(runs, pa.list_(run_type)), pa.array(texts, pa.binary())], ["doc_id", "n_words", "runs", "collapsed"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed binary")


def repeated_by_id(doc: object, words: list[bytes]) -> list[bytes]:
    """The query's words: one document in ten, chosen by its id, repeats a stretch to its end. A null id's words stay as they are."""
    n = len(words)
    h = zlib.crc32(str(doc).encode()) if doc is not None else 1
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    period = 1 + (n - a) // (3 + g % 8)
    root = words[a : a + period]
    return words[:a] + (root * -(-(n - a) // len(root)))[: n - a]


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = periodic_runs(table(spark, sf_dir, "documents"), rewrite=repeated_by_id)
    # The greater quotient of length and period, exactly: a fraction's whole part, then rests over the product of both periods.
    more = lambda x, y: x["length"] * y["period"] > y["length"] * x["period"]
    best = F.aggregate("runs", F.get("runs", F.lit(0)), lambda x, y: F.when(more(y, x), y).otherwise(x))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))), "\n")
    lines = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    done = done.withColumn("best", best)
    return done.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"), F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
