"""Benchmark decontamination on a distributed positional inverted index.

Built-in functions only. The index is a stored table of postings ``(term, doc_id, row, pos)`` in
document-partitioned shards, each sorted by term hash, so a term's postings of a shard stand together
and documents are never shuffled. Each document also has one posting of the empty term at the place
after its last word: its length.

A phrase search takes windows of the items. The counted frequency of every test term gives each
window its two rarest terms; their postings, shifted by the term's offset in the item, are
intersected on (item, document, shift). What survives is intersected with the postings of all other
terms of the item, and runs of consecutive matched offsets of window length are occurrences.

Defined results: null or wordless texts and items have no words, no windows and no hits; repeated
document ids are told apart by text (``row``, its 32-bit hash), repeated rows each return; repeated
items count once; ties of frequency go to the earlier offset, which changes no result; empty tables
give no rows, or rows without hits. Only ids and texts are read, so other columns cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.llm.common import ascii_lower, broadcast_if_small, stored, table

#: A run of digits, letters A-Z in lower case, or characters from U+0080.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
DOC = ["doc_id", "row"]


def words(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The stored postings of all words of all documents."""
    terms = F.concat(words(F.col(text_col)), F.array(F.lit("")))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.hash(F.col(text_col)).alias("row"), terms.alias("terms"))
    postings = rows.select(*DOC, F.posexplode("terms").alias("pos", "term"))  # the text's hash is made once a document
    return stored(postings.sortWithinPartitions(F.xxhash64("term")).select("term", *DOC, "pos"), "postings")


def item_words(items: DataFrame, window: int, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``(item, item_id, n, span, terms)`` of every distinct item with words; span: its window length."""
    rows = items.select(F.col(id_col).alias("item_id"), words(F.col(text_col)).alias("terms")).filter(F.size("terms") > 0)
    rows = rows.distinct().withColumn("n", F.size("terms")).withColumn("span", F.least(F.lit(window), F.col("n")))
    return rows.withColumn("item", F.xxhash64("item_id", "terms"))


def _rare_pairs(items: DataFrame, counts: DataFrame) -> DataFrame:
    """``(item, a, b)``: offsets of the rarest and the second rarest term of each window that can occur."""
    each = items.select("item", "n", "span", F.posexplode("terms").alias("i", "term"))
    known = each.join(counts, "term", "left").select("item", "n", "span", F.struct(F.coalesce("df", F.lit(0)).alias("df"), "i").alias("c"))
    lists = known.groupBy("item", "n", "span").agg(F.array_sort(F.collect_list(F.struct(F.col("c.i"), F.col("c.df")))).alias("by_i"))
    ranked = F.transform(
        F.sequence(F.lit(0), F.col("n") - F.col("span")),
        lambda s: F.array_sort(F.transform(F.slice("by_i", s + 1, F.col("span")), lambda x: F.struct(x["df"].alias("df"), x["i"].alias("i")))),
    )
    windows = lists.select("item", F.explode(ranked).alias("w")).filter(F.col("w")[0]["df"] > 0)
    second = F.when(F.size("w") > 1, F.get("w", F.lit(1))["i"]).otherwise(F.col("w")[0]["i"])
    return windows.select("item", F.col("w")[0]["i"].alias("a"), second.alias("b")).distinct()


def phrase_matches(index: DataFrame, items: DataFrame) -> DataFrame:
    """Occurrences ``(item, item_id, doc_id, row, start, length)``: maximal runs of matched words.

    ``items`` is what ``item_words`` gives. It is broadcast only where its rows and bytes, measured before, are few.
    """
    items = stored(items, "items")
    each = items.select("item", "n", "span", F.posexplode("terms").alias("i", "term"))
    vocabulary = broadcast_if_small(each.select("term").distinct())
    counts = stored(index.join(vocabulary, "term").groupBy("term").agg(F.count("*").alias("df")), "df")
    pairs = stored(_rare_pairs(items, counts), "pairs")

    marks = pairs.select("item", F.explode(F.array("a", "b")).alias("i")).distinct().join(each.select("item", "i", "term"), ["item", "i"])
    lists = index.join(broadcast_if_small(marks), "term").select("item", *DOC, (F.col("pos") - F.col("i")).alias("shift"), "i")
    met = lists.groupBy("item", *DOC, "shift").agg(F.collect_set("i").alias("at"))
    by_item = pairs.groupBy("item").agg(F.collect_list(F.struct("a", "b")).alias("ab"))
    both = met.join(broadcast_if_small(by_item), "item").filter(
        F.exists("ab", lambda p: F.array_contains(F.col("at"), p["a"]) & F.array_contains(F.col("at"), p["b"])))
    found = stored(both.select("item", *DOC, "shift"), "candidates")

    near = broadcast_if_small(found.select(*DOC).distinct())
    near_at = [index[c].eqNullSafe(near[c]) for c in DOC]
    of_docs = index.join(vocabulary, "term", "left_semi").join(near, near_at, "left_semi")
    wanted = found.join(broadcast_if_small(each), "item").select("item", "span", *DOC, "shift", "i", (F.col("shift") + F.col("i")).alias("pos"), "term")
    p = of_docs.select(F.col("doc_id").alias("p_doc"), F.col("row").alias("p_row"), F.col("pos").alias("p_pos"), F.col("term").alias("p_term")).distinct()
    on = wanted["doc_id"].eqNullSafe(p["p_doc"]) & (F.col("row") == F.col("p_row")) & (F.col("pos") == F.col("p_pos")) & (F.col("term") == F.col("p_term"))
    matched = wanted.join(p, on, "left_semi")
    places = matched.groupBy("item", "span", *DOC, "shift").agg(F.array_sort(F.collect_set("i")).alias("at"))
    runs = places.select("item", "span", *DOC, "shift", F.posexplode("at").alias("k", "i"))
    runs = runs.groupBy("item", "span", *DOC, "shift", (F.col("i") - F.col("k")).alias("run")).agg(F.min("i").alias("i0"), F.count("*").alias("length"))
    runs = runs.filter(F.col("length") >= F.col("span"))
    ids = broadcast_if_small(items.select("item", "item_id"))
    return runs.join(ids, "item").select("item", "item_id", *DOC, (F.col("shift") + F.col("i0")).alias("start"), "length")


def proximity_matches(index: DataFrame, queries: DataFrame, slop: int) -> DataFrame:
    """``(query_id, doc_id, row, pos)``: places of a query's rarest term with all its terms within ``slop`` words.

    ``queries`` has ``query_id`` and ``terms`` (an array; null or empty arrays match nothing). A null id is an id like
    others; of terms of equal frequency the first by name is the rarest; rows that repeat a document match once.
    """
    terms = queries.select("query_id", F.explode(F.array_distinct("terms")).alias("term"))
    hits = index.join(terms, "term")
    df = hits.groupBy("query_id", "term").agg(F.count("*").alias("df"))
    rarest = df.groupBy("query_id").agg(F.min(F.struct("df", "term")).getField("term").alias("rare"))
    wanted = terms.groupBy("query_id").agg(F.count("*").alias("n_terms"))
    block = F.floor(F.col("pos") / (slop + 1))
    first = hits.join(rarest, "query_id").filter(F.col("term") == F.col("rare"))
    first = first.select("query_id", *[F.col(c).alias(f"{c}1") for c in DOC], F.col("pos").alias("at"), F.explode(F.array(block - 1, block, block + 1)).alias("block"))
    same = F.expr("h.query_id = f.query_id AND h.block = f.block AND h.doc_id <=> f.doc_id1 AND h.row <=> f.row1")
    near = hits.withColumn("block", block).alias("h").join(first.alias("f"), same)
    near = near.filter(F.abs(F.col("pos") - F.col("at")) <= slop).select("h.query_id", *DOC, "at", "term")
    full = near.groupBy("query_id", *DOC, "at").agg(F.count_distinct("term").alias("n")).join(wanted, "query_id")
    return full.filter(F.col("n") == F.col("n_terms")).select("query_id", *DOC, F.col("at").alias("pos"))


def contamination(docs: DataFrame, items: DataFrame, window: int = 13, share: int = 20) -> DataFrame:
    """One row per document row: words, words inside occurrences, items that occur, and the verdict.

    A document is contaminated if it has hits and ``share * n_hit >= n_words``.
    """
    index = build_index(docs)
    found = stored(phrase_matches(index, item_words(items, window)), "occurrences")
    covered = found.select(*DOC, F.explode(F.sequence("start", F.col("start") + F.col("length").cast("int") - 1)).alias("pos")).distinct()
    hits = covered.groupBy(*DOC).agg(F.count("*").alias("n_hit"))
    held = found.groupBy(*DOC).agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    sizes = index.filter(F.col("term") == "").select(F.col("doc_id"), F.col("row"), F.col("pos").cast("long").alias("n_words"))
    seen = held.join(hits, [held[c].eqNullSafe(hits[c]) for c in DOC]).select(held["doc_id"].alias("h_doc"), held["row"].alias("h_row"), "n_hit", "items")
    rows = sizes.join(seen, sizes["doc_id"].eqNullSafe(seen["h_doc"]) & (sizes["row"] == seen["h_row"]), "left")
    n_hit = F.coalesce("n_hit", F.lit(0))
    listed = F.coalesce("items", F.array().cast("array<string>"))
    return rows.select(
        sizes["doc_id"], sizes["row"], "n_words", n_hit.alias("n_hit"), F.size(listed).cast("long").alias("n_items"),
        F.sha2(F.array_join(listed, ","), 256).alias("items_sha256"),
        ((n_hit > 0) & (share * n_hit >= F.col("n_words"))).alias("contaminated"))


def op5_positional_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("row")


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Pipeline stage: the documents that are not contaminated; the columns of ``docs``."""
    bad = contamination(docs, items).filter("contaminated").select(F.col("doc_id").alias("__doc"), F.col("row").alias("__row"))
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["__doc"]) & (F.hash(docs["text"]) == bad["__row"]), "left_anti")


OP5_SQL = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (SELECT item_id, w, least(13, len(w)) AS n FROM (
         SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark) WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[s:s + n - 1], ' ') AS k FROM iw, unnest(range(1, len(w) - n + 2)) AS t(s)),
lens AS (SELECT DISTINCT n FROM iw),
dwin AS (SELECT doc_id, s, n, array_to_string(w[s:s + n - 1], ' ') AS k FROM dw, lens, unnest(range(1, len(w) - n + 2)) AS t(s)),
occ AS (SELECT DISTINCT doc_id, s, dwin.n, item_id FROM dwin JOIN win ON win.n = dwin.n AND win.k = dwin.k),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM occ, unnest(range(s, s + n)) AS t(p) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items
        FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM occ) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""
