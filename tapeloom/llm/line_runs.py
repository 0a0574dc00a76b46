"""Line dedup on levelled sorted runs of line hashes.

A store keeps runs: tables ``(h1, h2, n_docs, keeper)`` bucketed and sorted by the 128-bit line hash.
A new batch is reduced to one row per hash, merge-anti-joined with the runs that are there (both
sides are bucketed alike, so the runs are not shuffled) to learn which hashes are new, and added as a
run of level 0. When a level holds ``fanout`` runs they are compacted into one run of the next level.

Runs lie in the shared folder and are removed when the dropped lines are known, or when that fails.

Batches come in falling order of document id, so the batch that brings a hash first also holds
the largest document id with that line: its ``keeper``. Later batches add only their counts.

Defined results: a null or empty text is one empty line; lines keep their places and bytes; a null
document id is one document below all others; repeated rows of an id count as one document and each
row is returned; equal keys keep all their lines in the keeper; an empty table gives no rows. Only
the id and the text are read, so other columns cannot clash.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.llm.common import ascii_lower, fresh_path, removed, stored, table

#: Bytes stripped at both ends of a line: space and 0x09 to 0x0D.
BLANKS = " \t\n\x0b\x0c\r"
HASH = ["h1", "h2"]


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """The line without blanks at its ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def hashed_lines(docs: DataFrame, min_chars: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc, row, pos, h1, h2)`` of every line whose key has ``min_chars`` code points or more."""
    text = F.col(text_col)
    rows = docs.select(F.col(id_col).alias("doc"), F.xxhash64(text).alias("row"), split_lines(text).alias("lines"))
    lines = rows.select("doc", "row", F.posexplode("lines").alias("pos", "line"))  # the text's hash is made once a document
    keys = lines.withColumn("key", F.btrim("line", F.lit(BLANKS))).filter(F.char_length("key") >= min_chars)
    key = ascii_lower(F.col("key"))
    return keys.select("doc", "row", "pos", F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2"))


class LineRuns:
    """The levelled store. ``fanout`` runs of a level are compacted into one of the next."""

    def __init__(self, spark: SparkSession, fanout: int = 3, buckets: int | None = None):
        self.spark, self.fanout = spark, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []
        self.folder = fresh_path(spark, "runs")

    def _save(self, run: DataFrame, level: int) -> None:
        name = f"line_run_{uuid.uuid4().hex}"
        (run.select(*HASH, "n_docs", "keeper").repartition(self.buckets, *HASH)
            .write.bucketBy(self.buckets, *HASH).sortBy(*HASH).format("parquet").option("path", f"{self.folder}/{name}").saveAsTable(name))
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in self.levels for name in level]

    def unseen(self, batch: DataFrame) -> DataFrame:
        """Rows of ``batch`` (with h1, h2) whose hash no run holds: one merge-anti-join per run."""
        for run in self.runs():
            batch = batch.join(run.select(*HASH).hint("merge"), HASH, "left_anti")
        return batch

    def add(self, lines: DataFrame) -> None:
        """Add a batch of ``(doc, h1, h2)``; its documents must be below those of earlier batches."""
        once = lines.groupBy(*HASH, "doc").agg(F.lit(1).alias("one"))  # spread by doc: no hot key yet
        new = once.groupBy(*HASH).agg(F.count("*").alias("n_docs"), F.max("doc").alias("top"))
        if self.runs():
            fresh = self.unseen(new).select(*HASH, F.col("top").alias("keeper"))
            new = new.join(fresh, HASH, "left")
        else:
            new = new.withColumn("keeper", F.col("top"))
        self._save(new, 0)
        level = 0
        while len(self.levels[level]) >= self.fanout:
            self._compact(level)
            level += 1

    def _compact(self, level: int) -> None:
        names = self.levels[level]
        self._save(self._merge([self.spark.table(n) for n in names]), level + 1)
        self.levels[level] = []
        self._drop(names)

    def _drop(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            removed(self.spark, f"{self.folder}/{name}")

    def close(self) -> None:
        """Remove all runs; what was read from them must be stored by then."""
        for level in self.levels:
            self._drop(level)
        self.levels = []

    @staticmethod
    def _merge(runs: list[DataFrame]) -> DataFrame:
        """Runs are bucketed and sorted alike, so each step is a merge join without a shuffle."""
        out = runs[0]
        for run in runs[1:]:
            more = run.select(*HASH, F.col("n_docs").alias("n_more"), F.col("keeper").alias("keeper_more"))
            out = out.join(more.hint("merge"), HASH, "full").select(
                *HASH,
                (F.coalesce("n_docs", F.lit(0)) + F.coalesce("n_more", F.lit(0))).alias("n_docs"),
                F.greatest("keeper", "keeper_more").alias("keeper"))
        return out

    def merged(self) -> DataFrame:
        return self._merge(self.runs())


def batches_by_id(lines: DataFrame, n: int) -> list[DataFrame]:
    """``lines`` in ``n`` ranges of document id, falling; null ids come last."""
    cuts = lines.agg(F.percentile_approx("doc", [i / n for i in range(n - 1, 0, -1)], 1000)).first()[0] or []
    cuts = sorted(set(cuts), reverse=True)
    out, above = [], None
    for cut in cuts:
        out.append(lines.filter(F.col("doc") >= cut if above is None else (F.col("doc") >= cut) & (F.col("doc") < above)))
        above = cut
    out.append(lines if above is None else lines.filter(F.col("doc").isNull() | (F.col("doc") < above)))
    return out


def dropped_lines(docs: DataFrame, min_docs: int = 3, min_chars: int = 20, batches: int = 4, fanout: int = 3) -> DataFrame:
    """``(doc, row, drops)``: the places of the lines to drop, for documents that lose any."""
    lines = stored(hashed_lines(docs, min_chars), "lines")
    store = LineRuns(docs.sparkSession, fanout)
    try:
        for batch in batches_by_id(lines, batches):
            store.add(batch)
        often = stored(store.merged().filter(F.col("n_docs") >= min_docs).select(*HASH, "keeper"), "often")
    finally:
        store.close()
    # Both sides are plain shuffles here, so a very common line is split as a skewed join partition.
    lost = lines.join(often, HASH).filter(~F.col("doc").eqNullSafe(F.col("keeper")))
    return lost.groupBy("doc", "row").agg(F.collect_set("pos").alias("drops"))


def dedup_lines(docs: DataFrame, **limits) -> DataFrame:
    """All columns of ``docs`` and ``__lines``, ``__kept``: the lines, and those that stay."""
    lost = dropped_lines(docs, **limits).select(F.col("doc").alias("__doc"), F.col("row").alias("__row"), F.col("drops").alias("__drops"))
    at = docs["doc_id"].eqNullSafe(lost["__doc"]) & (F.xxhash64(docs["text"]) == lost["__row"])
    joined = docs.join(lost.hint("shuffle_hash"), at, "left")
    lines = split_lines(F.col("text"))
    kept = F.when(F.col("__drops").isNull(), F.col("__lines")).otherwise(
        F.filter("__lines", lambda _, i: ~F.array_contains(F.col("__drops"), i)))
    return joined.withColumn("__lines", lines).withColumn("__kept", kept).drop("__doc", "__row", "__drops")


def op9_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select(
        "doc_id",
        F.size("__lines").cast("long").alias("n_lines"),
        (F.size("__lines") - F.size("__kept")).cast("long").alias("n_dropped"),
        F.sha2(F.array_join("__kept", "\n"), 256).alias("kept_sha256"),
    )


def drop_common_lines(docs: DataFrame) -> DataFrame:
    """Pipeline stage: the texts without their dropped lines; the columns of ``docs``."""
    done = dedup_lines(docs).withColumn("text", F.when(F.col("text").isNotNull(), F.array_join("__kept", "\n")))
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return done.select(*docs.columns)


OP9_SQL = """
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (
  SELECT doc_id, i, ls[i] AS line,
         translate(trim(ls[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM d, unnest(range(1, len(ls) + 1)) AS t(i)),
c AS (SELECT k, max(doc_id) AS keeper FROM l WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT l.doc_id, l.i, l.line, coalesce(l.doc_id <> c.keeper, false) AS gone FROM l LEFT JOIN c USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
