"""Substring dedup by hashing of sentences, lines or paragraphs.

A text is cut into units that cover it; a unit is normalised (white space collapsed, A-Z lower-cased) and
digested to 128 bits; digests are grouped globally; the earliest ranked occurrence (least document id,
then place) stays. The others are repeats, and go, with their offsets in the original text, where repeats follow
each other for at least ``min_chars`` code points of normalised text: single short units recur by chance.

Passages that documents share begin and end inside lines, so whole lines find few of them; the query therefore cuts
at sentence ends and line ends. ``unit`` takes lines or paragraphs alone as well.

Defined results: null and empty texts have no units; blank units (white space at the beginning of a text) stay and end a
run; a null id ranks after all others; rows that repeat a document whole tie with it and keep the same units; offsets
count code points of the original text; an empty table gives no rows. Only the id and the text are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.llm.common import ascii_lower, session_setup, stored, table

SENTENCE = r"[^.!?。！？\n]*[.!?。！？\n][.!?。！？ \t\x0B\f\r\n]*|[^.!?。！？\n]+"
#: Patterns whose matches cover a text.
UNITS = {"sentence": SENTENCE, "line": r"[^\n]*\n|[^\n]+", "paragraph": r"[\s\S]+?\n(?:[ \t]*\n)+|[\s\S]+"}
#: Half of a passage of fifty words.
MIN_CHARS = 150
HASH = ["h1", "h2"]


def hashed_units(docs: DataFrame, unit: str) -> DataFrame:
    """``(doc, row, pos, n, h1, h2)`` of all units that are not blank; ``n`` code points when normalised."""
    found = F.regexp_extract_all("text", F.lit(UNITS[unit]), F.lit(0))
    rows = docs.select(F.col("doc_id").alias("doc"), F.xxhash64("text").alias("row"), found.alias("units"))
    units = rows.select("doc", "row", F.posexplode("units").alias("pos", "unit"))
    units = units.withColumn("unit", F.trim(F.regexp_replace("unit", r"[ \t\x0B\f\r\n]+", " "))).filter("unit <> ''")
    key = ascii_lower(F.col("unit"))
    return units.select("doc", "row", "pos", F.char_length("unit").alias("n"), F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2"))


def repeated_units(docs: DataFrame, unit: str = "sentence") -> DataFrame:
    """``(doc, row, again)``: places and lengths of the units that stand earlier, for documents that have any."""
    units = stored(hashed_units(docs, unit), "units")
    rank = F.struct(F.col("doc").isNull().alias("last"), "doc", "row", "pos")
    first = units.groupBy(*HASH).agg(F.min(rank).alias("first"), F.count("*").alias("held")).filter("held > 1")
    first = stored(first.select(*HASH, "first.doc", "first.row", "first.pos").toDF(*HASH, "doc1", "row1", "pos1"), "first_units")
    is_first = F.col("doc").eqNullSafe(F.col("doc1")) & (F.col("row") == F.col("row1")) & (F.col("pos") == F.col("pos1"))
    # Plain shuffles on both sides: Spark splits the partition of a very common unit.
    again = units.join(first, HASH).filter(~is_first)
    return again.groupBy("doc", "row").agg(F.array_sort(F.collect_set(F.struct("pos", "n"))).alias("again"))


def long_runs(again: list[dict], min_chars: int) -> set[int]:
    """Places of repeats that follow each other for ``min_chars`` code points."""
    out: set[int] = set()
    run, size = [], 0
    for x in [*again, {"pos": -1, "n": 0}]:
        if run and x["pos"] != run[-1] + 1:
            if size >= min_chars:
                out.update(run)
            run, size = [], 0
        run.append(x["pos"])
        size += x["n"]
    return out


def dedup_units(docs: DataFrame, unit: str = "sentence", min_chars: int = MIN_CHARS) -> DataFrame:
    """One row per document row: ``doc_id, n_units, removed, kept`` (arrays of start and end), ``text``."""
    session_setup(docs.sparkSession)
    repeats = repeated_units(docs, unit)
    rows = docs.select("doc_id", "text")
    at = rows["doc_id"].eqNullSafe(repeats["doc"]) & (F.xxhash64(rows["text"]) == repeats["row"])
    joined = rows.join(repeats.hint("shuffle_hash"), at, "left").select("doc_id", "text", "again")
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern = re.compile(UNITS[unit])
        for b in batches:
            n, removed, kept, texts = [], [], [], []
            for text, again in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                text = text or ""
                found, drops = [m.span() for m in pattern.finditer(text)], long_runs(again or [], min_chars)
                stay = [x for i, x in enumerate(found) if i not in drops]
                n.append(len(found))
                removed.append([{"start": s, "end": e} for i, (s, e) in enumerate(found) if i in drops])
                kept.append([{"start": s, "end": e} for s, e in stay])
                texts.append("".join(text[s:e] for s, e in stay) if drops else text)
            columns = [b.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.list_(span)), pa.array(kept, pa.list_(span)), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_units", "removed", "kept", "text"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    pairs = "array<struct<start: bigint, end: bigint>>"
    return joined.mapInArrow(run, f"doc_id {kind}, n_units bigint, removed {pairs}, kept {pairs}, text string")


def op8_unit_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = dedup_units(table(spark, sf_dir, "documents"))
    listed = F.array_join(F.transform("removed", lambda s: F.concat_ws("-", s["start"], s["end"])), ",")
    return done.select(
        "doc_id", "n_units", F.size("removed").cast("long").alias("n_removed"), listed.alias("removed_spans"),
        F.sha2("text", 256).alias("kept_sha256"))


OP8_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^.!?。！？\n]*[.!?。！？\n][.!?。！？ \t\x0B\f\r\n]*|[^.!?。！？\n]+') AS us FROM documents),
u AS (SELECT doc_id, i, us[i] AS unit,
        translate(trim(regexp_replace(us[i], '[ \t\x0B\f\r\n]+', ' ', 'g')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
      FROM d, unnest(range(1, len(us) + 1)) AS t(i)),
r AS (SELECT *, k <> '' AND row_number() OVER (PARTITION BY k ORDER BY doc_id, i) > 1 AS again,
        CAST(sum(length(unit)) OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) AS e FROM u),
g AS (SELECT *, count(*) FILTER (WHERE NOT again) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM r),
x AS (SELECT *, again AND sum(length(k)) FILTER (WHERE again) OVER (PARTITION BY doc_id, g) >= 150 AS gone FROM g)
SELECT d.doc_id, count(i) AS n_units, count(*) FILTER (WHERE gone) AS n_removed,
       coalesce(string_agg((e - length(unit)) || '-' || e, ',' ORDER BY i) FILTER (WHERE gone), '') AS removed_spans,
       sha256(coalesce(string_agg(unit, '' ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM d LEFT JOIN x ON d.doc_id = x.doc_id GROUP BY d.doc_id
"""
