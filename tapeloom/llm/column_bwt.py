"""Suffix-array dedup with a Burrows-Wheeler transform built column by column.

``collection_bwt`` inserts one symbol of every string each round, from their ends: a string's next
suffix stands, among those with its first symbol, where its last suffix stood, so one stable sort of
the transform gives all places. The transform and the common prefixes are files that each round
reads and writes anew in sequence.

Rounds are as many as the longest string, and each passes over all symbols inserted so far, so whole
documents of 100,000 bytes cannot be built that way. The strings built are therefore the places where
repeats can be: every ``length``-byte string holds the least hashed ``GRAM``-byte gram among its
grams, its anchor, and equal strings have equal anchors at equal offsets. Occurrences of an anchor are
brought together; those with equal surroundings (128-bit digests) are repeats at once, and the distinct
surroundings of an anchor, cut to what each shares with another, are the collection, in blocks of whole
anchors, in which the anchor's bytes are one symbol. Of equal cut ones the earliest is built and the others are repeats; one that is left alone shares with none.
An anchor with more than ``HOT`` distinct surroundings is dealt out further by what an equal string must
share beside the anchor: strings that begin in the same stretch before it share all bytes that every
string of that stretch has. The more surroundings, the shorter the stretches.

Defined results: null and empty texts have no bytes; texts shorter than ``length`` lose nothing; a
null id counts as the smallest; rows that share an id are told apart by their text's hash, and rows
that repeat a document whole are one occurrence and each returns the same; an empty table gives no
rows. Ids are integers. Only the id and the text are read.
"""

from __future__ import annotations

import tempfile
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.llm.common import broadcast_if_small, session_setup, stored, table
from tapeloom.llm.minhash import mixed

LENGTH, GRAM = 100, 40
#: Stands for an anchor; no byte of UTF-8.
ANCHOR = b"\xff"
#: Strings of a block; an anchor with more is a block of its own.
BLOCK = 2048
#: Distinct surroundings of an anchor that may meet in one task.
HOT = 4096
#: Anchors a task reduces among themselves before passing them on.
GATHERED = 2_000_000
_BASE = 0x9E3779B97F4A7C15
_OF_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
NULL_ID = -(1 << 63)
DIGEST = ["c", "d"]


# ---- the collection's transform ----

def collection_bwt(strings: list[bytes], folder: str | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(bwt, lcp, places)``: the transform (0 for a start, else the byte + 1), the common prefix of
    each suffix with the one before, and for each place ``string * (longest + 1) + suffix length``.

    Suffixes end with marks below every byte, in the order of the strings; the empty ones are listed.
    """
    m = len(strings)
    sizes = np.array([len(s) for s in strings], np.int64)
    longest = int(sizes.max(initial=0))
    used = np.unique(np.frombuffer(b"".join(strings), np.uint8))
    kind = np.uint8 if len(used) < 255 else np.uint16
    code = np.zeros(256, kind)  # the symbols that occur, in order, from 1
    code[used] = np.arange(1, len(used) + 1)
    prefix = np.int16 if longest < 32_000 else np.int32
    columns = np.zeros((longest, m), kind)  # round by string, from the ends
    for i, s in enumerate(strings):
        columns[: len(s), i] = code[np.frombuffer(s, np.uint8)[::-1]]
    with tempfile.TemporaryFile(dir=folder, buffering=0) as of_bwt, tempfile.TemporaryFile(dir=folder, buffering=0) as of_lcp:

        def load() -> tuple[np.ndarray, np.ndarray]:
            of_bwt.seek(0)
            of_lcp.seek(0)
            return np.frombuffer(bytearray(of_bwt.readall()), kind), np.frombuffer(of_lcp.readall(), prefix)

        def save(bwt: np.ndarray, lcp: np.ndarray) -> None:
            """Over what was there, which is never longer; a file cut first would be flushed to disk."""
            for file, x in ((of_bwt, bwt), (of_lcp, lcp)):
                file.seek(0)
                raw = memoryview(x).cast("B")
                while raw:
                    raw = raw[file.write(raw) :]

        save(np.zeros(m, kind), np.zeros(m, prefix))
        live, place = np.arange(m), np.arange(m)
        for k in range(longest):
            bwt, lcp = load()
            symbols = columns[k, live]
            bwt[place] = symbols
            keep = symbols > 0  # a finished string keeps its 0
            live, place, symbols = live[keep], place[keep], symbols[keep]
            order = np.argsort(bwt, kind="stable")
            order = order[len(bwt) - np.count_nonzero(bwt) :]
            # Places in ``order`` of the new suffixes: those of a symbol are a stretch of it, in order of place.
            by_rank = np.lexsort((place, symbols))
            cuts = np.flatnonzero(np.concatenate([[True], np.diff(symbols[by_rank]) != 0])) if len(live) else by_rank
            begins = np.cumsum(np.bincount(bwt, minlength=len(used) + 1)[1:])
            begins = np.append(0, begins)
            new = np.empty(len(live), np.int64)
            for lo, hi in zip(cuts.tolist(), [*cuts[1:].tolist(), len(live)]):
                symbol = int(symbols[by_rank[lo]])
                at = begins[symbol - 1]
                new[lo:hi] = at + np.searchsorted(order[at : begins[symbol]], place[by_rank[lo:hi]])
            total = m + len(order)
            old = np.ones(total, bool)
            old[m + new] = False
            # Common prefixes with the neighbour before: of the new suffixes, and of those after them.
            touched = np.sort(np.concatenate([new, new + 1]), kind="stable")
            touched = touched[changed(touched) & (touched < len(order))]
            before = order[np.maximum(touched - 1, 0)]
            here = order[touched]
            same = (touched > 0) & (bwt[before] == bwt[here])
            value = np.zeros(len(touched), prefix)
            if same.any():
                lo, hi = before[same] + 1, here[same] + 1
                at = np.argsort(lo, kind="stable")
                ends = np.empty(2 * len(at), np.int64)
                ends[::2], ends[1::2] = lo[at], hi[at]
                least = np.minimum.reduceat(np.append(lcp, prefix(0)), ends)[::2]
                found = np.empty(len(at), prefix)
                found[at] = least + 1
                value[same] = found
            out_bwt, out_lcp = np.zeros(total, kind), np.zeros(total, prefix)
            out_bwt[old], out_lcp[old] = bwt, lcp
            out_lcp[m + touched] = value
            save(out_bwt, out_lcp)
            live, place = live[by_rank], m + new
        bwt, lcp = load()
    order = np.argsort(bwt, kind="stable")
    order = order[len(bwt) - np.count_nonzero(bwt) :]
    step = np.full(len(bwt), -1, np.int64)
    step[order] = m + np.arange(len(order))
    places = np.zeros(len(bwt), np.int64)
    who, at = np.arange(m), np.arange(m)
    for k in range(longest + 1):
        places[at] = who * (longest + 1) + k
        at = step[at]
        who, at = who[at >= 0], at[at >= 0]
    return np.append(np.uint16(0), used.astype(np.uint16) + 1)[bwt], lcp, places


def later_occurrences(strings: list[bytes], middles: np.ndarray, starts: np.ndarray, ranks: np.ndarray, length: int, gram: int, folder: str | None = None) -> tuple[np.ndarray, np.ndarray]:
    """``(string, offset)`` of the ``length``-byte strings about an anchor, at ``middles``, that also occur earlier.

    A string stands at ``starts`` of a document; earlier is a lower (``ranks``, start + offset). The bytes of an
    anchor are one symbol of the collection, so equal strings are equal stretches with equal anchors.
    """
    marked = [s[:k] + ANCHOR + s[k + gram :] for s, k in zip(strings, middles.tolist())]
    kinds: dict[bytes, int] = {}
    anchor = np.array([kinds.setdefault(s[k : k + gram], len(kinds)) for s, k in zip(strings, middles.tolist())], np.int64)
    _, lcp, places = collection_bwt(marked, folder)
    sizes = np.array([len(s) for s in marked], np.int64)
    symbols = length - gram + 1
    width = int(sizes.max(initial=0)) + 1
    who, left = places // width, places % width
    offset = sizes[who] - left
    run = np.cumsum(lcp < symbols)
    about = np.flatnonzero((left >= symbols) & (offset <= middles[who]))
    who, offset, run = who[about], offset[about], run[about]
    at = starts[who] + offset
    order = np.lexsort((at, ranks[who], anchor[who], run))
    who, offset, run, at = who[order], offset[order], run[order], at[order]
    first = np.flatnonzero(changed(run, anchor[who]))
    lead = np.repeat(first, np.diff(np.append(first, len(run))))
    later = (ranks[who] != ranks[who[lead]]) | (at != at[lead])
    return who[later], offset[later]


# ---- anchors ----

def _power(k: int) -> np.uint64:
    return np.uint64(pow(_BASE, k, 1 << 64))


def gram_hashes(raw: bytes, size: int) -> np.ndarray:
    """Hashes of all ``size``-byte grams, doubled up from single bytes."""
    h, n, out, have = _OF_BYTE[np.frombuffer(raw, np.uint8)], 1, None, 0
    while size:
        if size & n:
            out = h if out is None else out[: len(h) - have] * _power(n) + h[have:] if have else h
            have += n
            size ^= n
        if size:
            h = h[:-n] * _power(n) + h[n:]
            n *= 2
        if out is not None:
            out = out[: len(raw) - have + 1]
            h = h[: len(raw) - n + 1]
    return mixed(out)


def _slide(x: np.ndarray, width: int, f) -> np.ndarray:
    """``f`` over every window of ``width``."""
    n = 1
    while 2 * n <= width:
        x = f(x[:-n], x[n:])
        n *= 2
    return f(x[: len(x) - (width - n)], x[width - n :]) if width > n else x


def anchors(raw: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the grams that are least in some ``length``-byte string."""
    if len(raw) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    width = length - gram + 1
    g = gram_hashes(raw, gram)
    least = _slide(g, width, np.minimum)
    pad = np.zeros(width - 1, np.uint64)
    chosen = np.flatnonzero(_slide(np.concatenate([pad, least, pad]), width, np.maximum) == g)
    return chosen, g[chosen]


def changed(*columns: np.ndarray) -> np.ndarray:
    """Rows that differ from the row before; the first one does."""
    out = np.zeros(len(columns[0]), bool)
    out[:1] = True
    for x in columns:
        out[1:] |= x[1:] != x[:-1]
    return out


def anchor_rows(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """``(key, kind, c, d, doc, row, pos, l, r)``. Kind 0: an anchor, its surroundings' digest and extent.
    Kind 1: surroundings that the task has seen earlier, repeats already, keyed by document.
    """
    import xxhash

    reach = length - gram

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        n = 0

        def out():
            columns = [np.concatenate(x) for x in zip(*held)]
            order = np.lexsort(columns[5::-1])
            columns = [x[order] for x in columns]
            once = changed(*columns[:6])  # a row that repeats a document is the same occurrence
            key, c, d, doc, row, pos, l, r = (x[once] for x in columns)
            again = ~changed(key, c, d)
            key = np.where(again, mixed(doc.view(np.uint64)), key)
            arrays = [key.view(np.int64), again.astype(np.int32), c.view(np.int64), d.view(np.int64), doc, row, pos, l, r]
            for lo in range(0, len(key), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[lo : lo + 50_000]) for x in arrays], ["key", "kind", *DIGEST, "doc", "row", "pos", "l", "r"])

        for b in batches:
            for doc, row, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
                pos, g = anchors(raw, length, gram)
                if not len(pos):
                    continue
                left, right = np.minimum(pos, reach), np.minimum(len(raw) - pos, length)
                around = b"".join([xxhash.xxh3_128_digest(raw[p - l : p + r], l) for p, l, r in zip(pos.tolist(), left.tolist(), right.tolist())])
                c, d = np.frombuffer(around, np.uint64).reshape(-1, 2).T
                k = len(pos)
                held.append((g, c, d, np.full(k, doc, np.int64), np.full(k, row, np.int32), pos, left.astype(np.int32), right.astype(np.int32)))
                n += k
            if n >= GATHERED:
                yield from out()
                held, n = [], 0
        if held:
            yield from out()

    return docs.select("doc", "row", "text").mapInArrow(run, "key bigint, kind int, c bigint, d bigint, doc bigint, row int, pos bigint, l int, r int")


def met_rows(rows: DataFrame) -> DataFrame:
    """``(kind, key, doc, row, start, end, pos)``. Kind 1: a repeated span. Kind 2: distinct surroundings
    of an anchor that has several. Rows come sorted by anchor, so a task keeps one row between batches.
    """
    names = ["kind", "key", "doc", "row", "start", "end", "pos"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_key = last_around = last = None
        first = None  # of the anchor at hand, until it shows other surroundings

        for b in batches:
            columns = [b.column(i).to_numpy() for i in range(9)]
            if len(columns[0]):
                once = changed(*columns[:7])
                once[0] = tuple(x[0] for x in columns[:7]) != last
                last = tuple(x[-1] for x in columns[:7])
                columns = [x[once] for x in columns]
            key, kind, c, d, doc, row, pos, l, r = columns
            if not len(key):
                continue
            spans = [doc, row, pos - l, pos + r, pos]
            given = kind == 1
            at = np.flatnonzero(~given)
            k, around = key[at], (c[at], d[at])
            new_key, new_c = changed(k), changed(k, *around)
            if len(at):
                new_key[0] = k[0] != last_key
                new_c[0] = new_key[0] or tuple(x[0] for x in around) != last_around
            out_kind, out_key = np.where(given, 1, 0), key.copy()
            out_kind[at[~new_c]] = 1
            heads, starts = np.flatnonzero(new_c), np.flatnonzero(new_key)
            group = np.cumsum(new_key)
            other = heads[~new_key[heads]]
            out_kind[at[other]] = 2
            opened = np.intersect1d(starts, np.searchsorted(group, np.unique(group[other])))  # first rows in this batch
            out_kind[at[opened]] = 2
            chosen = np.flatnonzero(out_kind)
            columns = [out_kind[chosen].astype(np.int32), out_key[chosen], *[s[chosen] for s in spans]]
            if first is not None and len(other) and group[other[0]] == 0:
                columns = [np.append(v, np.asarray([w], v.dtype)) for v, w in zip(columns, first)]
                first = None
            if len(at):
                if new_key.any():
                    first = None
                    s = starts[-1]
                    if not (group[other] == group[s]).any():
                        i = at[s]
                        first = (2, key[i], *[v[i] for v in spans])
                last_key, last_around = k[-1], tuple(x[-1] for x in around)
            if len(columns[0]):
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in columns], names)

    return rows.mapInArrow(run, "kind int, key bigint, doc bigint, row int, start bigint, end bigint, pos bigint")


def stretches(reach: int, level: int) -> list[tuple[int, int]]:
    """``0..reach`` bytes before an anchor in up to ``2 ** level`` stretches."""
    cuts = sorted({(reach + 1) * i >> level for i in range((1 << level) + 1)})
    return [(lo, hi - 1) for lo, hi in zip(cuts, cuts[1:])]


def piece_rows(open_ones: DataFrame, length: int, gram: int) -> DataFrame:
    """``(key, doc, row, start, middle, piece)`` of ``(doc, row, text, at)``: the surroundings, the anchor's place in them.

    At a level above 0 there is a piece for each stretch of beginnings, keyed also by the bytes that all its strings have.
    """
    import xxhash

    reach = length - gram

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for doc, row, text, at in zip(*(b.column(i).to_pylist() for i in range(4))):
                raw = text.encode("utf-8", "surrogatepass")
                for x in at:
                    key, pos, start, end = x["key"], x["pos"], x["start"], x["end"]
                    if not x["level"]:
                        out.append((key, doc, row, start, pos - start, raw[start:end]))
                        continue
                    for lo, hi in stretches(reach, x["level"]):
                        must_end = pos + gram + reach - hi
                        if pos - lo >= start and must_end <= end:
                            part = xxhash.xxh3_64_intdigest(raw[pos - lo : must_end], (key + lo) & (2**64 - 1))
                            begin = max(start, pos - hi)
                            out.append((part - (1 << 63), doc, row, begin, pos - begin, raw[begin : min(end, pos + length - lo)]))
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
            columns = [pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(columns, ["key", "doc", "row", "start", "middle", "piece"])

    return open_ones.select("doc", "row", "text", "at").mapInArrow(run, "key bigint, doc bigint, row int, start bigint, middle bigint, piece binary")


def _shared(keys: np.ndarray, sides: list[bytes]) -> np.ndarray:
    """The longest prefix that each string shares with another of its key."""
    sizes = np.array([len(x) for x in sides], np.int64)
    order = np.array(sorted(range(len(sides)), key=lambda i: (keys[i], sides[i])), np.int64)
    width = int(sizes.max(initial=0)) + 1
    grid = np.frombuffer(b"".join(x.ljust(width, b"\0") for x in sides), np.uint8).reshape(len(sides), width)[order]
    sizes, keys, out = sizes[order], keys[order], np.zeros(len(sides), np.int64)
    differ = grid[1:] != grid[:-1]
    same = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    same = np.where(keys[1:] == keys[:-1], np.minimum(same, np.minimum(sizes[1:], sizes[:-1])), 0)
    best = np.maximum(np.append(0, same), np.append(same, 0))
    out[order] = best
    return out


def trimmed(keys: np.ndarray, middles: np.ndarray, texts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Which strings can share ``length`` bytes about their anchor, the bytes that each shares before it, and these cut to what they share."""
    left = _shared(keys, [t[:m][::-1] for t, m in zip(texts, middles)])
    right = _shared(keys, [t[m:] for t, m in zip(texts, middles)])
    kept = np.flatnonzero(left + right >= length)
    cut = [texts[i][middles[i] - left[i] : middles[i] + right[i]] for i in kept]
    return kept, left[kept], cut


def _joined(string: np.ndarray, begin: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping ``length``-byte spans of each string as maximal ones; input sorted."""
    first = np.concatenate([[True], (string[1:] != string[:-1]) | (begin[1:] > begin[:-1] + length)]) if len(string) else np.zeros(0, bool)
    at = np.flatnonzero(first)
    last = np.append(at[1:], len(string)) - 1
    return string[at], begin[at], begin[last] + length if len(at) else begin[at]


def built_spans(pieces: DataFrame, length: int, gram: int) -> DataFrame:
    """``(doc, row, start, end)`` of later occurrences, from the transforms of blocks of whole anchors."""

    def spans(held: list[tuple]) -> pa.RecordBatch:
        key, doc, row, start, middle, texts = (np.concatenate(x) if i < 5 else [p for y in x for p in y] for i, x in enumerate(zip(*held)))
        kept, before, texts = trimmed(key, middle, texts, length)
        doc, row, start = doc[kept], row[kept], (start + middle)[kept] - before
        # Equal strings about an anchor: the earliest stands for all, the others are repeats as a whole.
        earliest: dict[tuple, int] = {}
        again, distinct = [], Counter()
        for i in np.lexsort((start, row, doc)).tolist():
            k = int(key[kept[i]])
            if earliest.setdefault((k, int(before[i]), texts[i]), i) == i:
                distinct[k] += 1
            else:
                again.append(i)
        built = np.array([i for (k, *_), i in earliest.items() if distinct[k] > 1], np.int64)
        who = begin = end = np.zeros(0, np.int64)
        if len(built):
            _, rank = np.unique(np.stack([doc[built], row[built].astype(np.int64)]), axis=1, return_inverse=True)  # in order of (doc, row)
            who, offset = later_occurrences([texts[i] for i in built], before[built], start[built], rank.reshape(-1), length, gram)
            order = np.lexsort((offset, who))
            who, begin, end = _joined(who[order], offset[order], length)
            who = built[who]
        rest = np.array(again, np.int64)
        sizes = np.array([len(texts[i]) for i in again], np.int64)
        who, begin, end = np.append(who, rest), np.append(begin, np.zeros_like(rest)), np.append(end, sizes)
        return pa.RecordBatch.from_arrays([pa.array(doc[who]), pa.array(row[who]), pa.array(start[who] + begin), pa.array(start[who] + end)], ["doc", "row", "start", "end"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        n, last = 0, None
        for b in batches:
            key = b.column(0).to_numpy()
            if not len(key):
                continue
            columns = [key, *(b.column(i).to_numpy() for i in (1, 2, 3, 4)), b.column(5).to_pylist()]
            cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
            for lo, hi in zip(cuts, cuts[1:]):
                if n >= BLOCK and key[lo] != last:
                    yield spans(held)
                    held, n = [], 0
                held.append(tuple(c[lo:hi] for c in columns))
                n, last = n + hi - lo, key[lo]
        if held:
            yield spans(held)

    return pieces.mapInArrow(run, "doc bigint, row int, start bigint, end bigint")


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """``(doc, row, start, end)``: spans of bytes in ``length``-byte strings that also start earlier; they may overlap."""
    spark = docs.sparkSession
    session_setup(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = anchor_rows(docs, length, gram).repartition(parts, "key").sortWithinPartitions("key", "kind", *DIGEST, "doc", "row", "pos")
    met = stored(met_rows(dealt), "met")
    several = met.filter("kind = 2")
    # At most one key in ``hot`` rows; each level halves the stretches, down to single beginnings.
    level = F.least(F.lit((length - gram).bit_length()), F.ceil(F.log2(F.col("held") / hot))).cast("int")
    levels = stored(several.groupBy("key").agg(F.count("*").alias("held")).filter(F.col("held") > hot).select("key", level.alias("level")), "hot_anchors")
    levels = broadcast_if_small(levels)
    placed = several.join(levels, "key", "left").withColumn("level", F.coalesce("level", F.lit(0)))
    at = placed.groupBy("doc", "row").agg(F.collect_list(F.struct("key", "start", "end", "pos", "level")).alias("at"))
    ids = at.select("doc", "row")
    wanted = docs.join(broadcast_if_small(ids), ["doc", "row"], "left_semi")
    pieces = piece_rows(wanted.join(at.hint("shuffle_hash"), ["doc", "row"]), length, gram)
    sorted_pieces = pieces.repartition(parts, "key").sortWithinPartitions("key", "doc", "row", "start")
    built = stored(built_spans(sorted_pieces, length, gram), "built")
    return met.filter("kind = 1").select("doc", "row", "start", "end").unionByName(built)


def with_keys(docs: DataFrame) -> DataFrame:
    """``(doc_id, doc, row, text)``: the rank of a null id is below all, ``row`` tells texts of one id apart."""
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID))
    return docs.select("doc_id", doc.alias("doc"), F.hash("text").alias("row"), "text")


def without_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """One row per document row: ``doc_id, n_bytes, removed`` (maximal spans), ``kept`` (bytes)."""
    keyed = with_keys(docs)
    spans = repeated_spans(keyed.drop("doc_id"), length, gram, hot)
    lists = spans.groupBy("doc", "row").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))
    joined = keyed.join(lists.hint("shuffle_hash"), ["doc", "row"], "left").select("doc_id", "text", "spans")
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, removed, kept = [], [], []
            for text, found in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                raw, runs, parts, at = (text or "").encode("utf-8", "surrogatepass"), [], [], 0
                for x in found or ():
                    if runs and x["start"] <= runs[-1]["end"]:
                        runs[-1]["end"] = max(runs[-1]["end"], x["end"])
                    else:
                        runs.append(dict(x))
                for x in runs:
                    parts.append(raw[at : x["start"]])
                    at = x["end"]
                parts.append(raw[at:])
                sizes.append(len(raw))
                removed.append(runs)
                kept.append(b"".join(parts))
            columns = [b.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.list_(span)), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "removed", "kept"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return joined.mapInArrow(run, f"doc_id {kind}, n_bytes bigint, removed array<struct<start: bigint, end: bigint>>, kept binary")



def op7_column_bwt(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = without_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return done.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
