"""URL filter: allow and block rules, then a character language-model ratio.

Two variable-order Markov models (contexts of 0 to ``order`` characters, Witten-Bell smoothing down
to a uniform distribution) are learned from all URLs that the rules accept and reject. A URL that no rule
decides is allowed if ``(log P_accepted - log P_rejected) / length`` reaches a threshold; the
threshold is calibrated on a fifth of these URLs, which the models do not see, for the best mean of
the two classes' accuracies.

The models are stored tables of counts, by gram (a context and its next character) and by context.
To score, each distinct gram of the URLs gets its probabilities once, size by size from one character
up, and the URLs sum the grams of their places. Ranks, counts, scores and the threshold's sums are
shuffled; the driver sees totals only. A gram's log-ratio is a multiple of ``1 / UNIT``, so sums are exact and
partitions change nothing. ``per_class`` and ``max_chars`` bound what is learned from only if they are given.

Defined results: null URLs and URLs without ``://`` have empty host and path and no rule, and a null
URL is scored as the empty one; when only one class was seen its verdict holds, when none was,
``allow``; a tie with the threshold is ``allow``; of fitting rules of equal length the first listed
wins; repeated rows get equal results; an empty table gives no rows. Only the id and the URL are read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeloom.llm.common import HOT_SHARE, ascii_lower, broadcast_if_small, join_hot, stored, table

START, END = "\x02", "\x03"
CLASSES = ("allow", "block")
#: Log-ratios of grams are rounded to multiples of 1 / UNIT: some 10 million characters of the largest ratios fit a long.
UNIT = 2**32
#: Joins of tables that grow are merged: Spark would broadcast them by their compressed bytes, many times smaller than their rows in memory.
MERGED = "merge"
#: (host, path, verdict) of the query's rules.
RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.coalesce(F.locate("://", url), F.lit(0))
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return ascii_lower(host), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def with_rules(pages: DataFrame, rules: list[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``(id, url, host, path, rule, by_rule)``; the longest fitting rule wins."""
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col), F.col(url_col).alias("url"), host.alias("host"), path.alias("path"))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1]), reverse=True)[::-1]:
        fits = ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rows.withColumn("rule", rule).withColumn("by_rule", verdict)


def grams_at(url: Column, order: int) -> Column:
    """The grams of a URL's places: each character, the end counted, after up to ``order`` (1 or more) before it."""
    text = F.concat(F.lit(START), url, F.lit(END))
    first = F.array(*[F.when(F.length(text) >= k, F.substring(text, 1, k)) for k in range(2, order + 1)]).cast("array<string>")
    # One pass of a pattern that looks ahead; cutting at each place would count from the start each time.
    whole = F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{order + 1}}}))."), F.lit(1))
    return F.concat(F.array_compact(first), whole)


def endings(gram: Column) -> Column:
    """The grams with which a gram ends, itself included."""
    return F.transform(F.sequence(F.lit(1), F.length(gram)), lambda k: gram.substr(F.length(gram) - k + 1, k))


def context_of(gram: str) -> Column:
    return F.col(gram).substr(F.lit(1), F.length(gram) - 1)


@dataclass
class UrlModel:
    """Counts of both classes: ``grams (gram, allow, block)`` and ``contexts (context, allow_n, allow_kinds, block_n, block_kinds)``."""

    grams: DataFrame
    contexts: DataFrame
    order: int
    alphabet: int
    only: str | None
    threshold: float = 0.0

    def ratios(self, keys: DataFrame) -> DataFrame:
        """``(key, ratio)`` of distinct grams ``key``: the log-ratio of the classes, in units.

        A gram follows from the gram without its first character. So a join of a size meets, for each shorter gram, at most one row a
        character. A gram at the start of a text is shorter than others, and passes the larger sizes as it is.
        """
        top = self.order + 1
        each = keys.select(F.explode(endings(F.col("key"))).alias("gram")).distinct().withColumn("context", context_of("gram"))
        known = each.join(self.grams.hint(MERGED), "gram", "left").join(self.contexts.hint(MERGED), "context", "left").drop("context").withColumn("size", F.length("gram"))
        passing = keys.filter(F.length("key") < top).select(F.col("key").alias("gram"), F.explode(F.sequence(F.length("key") + 1, F.lit(top))).alias("size"))
        sized = stored(known.unionByName(passing, allowMissingColumns=True), "url-grams")
        below = None
        for size in range(1, top + 1):
            level = sized.filter(F.col("size") == size)
            if below is None:
                level = level.withColumns({f"{v}_p": F.lit(1 / self.alphabet) for v in CLASSES})
            else:
                rest = F.when(F.length("gram") < size, F.col("gram")).otherwise(F.col("gram").substr(F.lit(2), F.lit(size)))
                level = level.withColumn("rest", rest).join(below.hint(MERGED), "rest")
            smooth = {v: (F.coalesce(v, F.lit(0)) + F.col(f"{v}_kinds") * F.col(f"{v}_p")) / (F.col(f"{v}_n") + F.col(f"{v}_kinds")) for v in CLASSES}
            p = [F.when(F.col(f"{v}_n") > 0, smooth[v]).otherwise(F.col(f"{v}_p")).alias(f"{v}_p") for v in CLASSES]
            below = level.select(F.col("gram").alias("rest"), *p)
        ratio = F.round((F.log("allow_p") - F.log("block_p")) * F.lit(float(UNIT))).cast("long")
        return stored(below.select(F.col("rest").alias("key"), ratio.alias("ratio")), "url-ratios")

    def differences(self, urls: DataFrame, id_col: str) -> DataFrame:
        """``(id, difference)``: log-likelihood difference a character, the end counted, of ``urls (id, url)`` with distinct ids and no null."""
        places = urls.select(id_col, F.explode(grams_at(F.col("url"), self.order)).alias("key"))
        keys = stored(places.groupBy("key").agg(F.count("*").alias("n")), "url-keys")
        ratios = self.ratios(keys.select("key"))
        small = broadcast_if_small(ratios)
        if small is ratios:  # not small: all is shuffled, and frequent grams are dealt over many tasks
            total = keys.agg(F.sum("n")).first()[0] or 0
            met = join_hot(places, ratios.hint(MERGED), "key", hot=[r["key"] for r in keys.filter(F.col("n") * HOT_SHARE > total).collect()])
        else:
            met = places.join(small, "key")
        return met.groupBy(id_col).agg((F.sum("ratio") / F.lit(float(UNIT)) / F.count("*")).alias("difference"))

    def difference(self, url: str) -> float:
        """``differences`` for one URL, from the counts of its own grams."""
        text, total = START + url + END, 0
        keys = [text[max(0, i - self.order) : i + 1] for i in range(1, len(text))]
        own = sorted({k[i:] for k in keys for i in range(len(k))})
        counts = {r["gram"]: r for r in self.grams.filter(F.col("gram").isin(own)).collect()}
        contexts = {r["context"]: r for r in self.contexts.filter(F.col("context").isin(sorted({g[:-1] for g in own}))).collect()}
        logs, found = {}, {}
        for gram in sorted(own, key=len):
            for v in CLASSES:
                p, of = found[gram[1:], v] if len(gram) > 1 else 1 / self.alphabet, contexts.get(gram[:-1])
                if of is not None and of[f"{v}_n"] > 0:
                    p = ((counts[gram][v] if gram in counts else 0) + of[f"{v}_kinds"] * p) / (of[f"{v}_n"] + of[f"{v}_kinds"])
                found[gram, v] = p
            logs[gram] = math.floor((math.log(found[gram, "allow"]) - math.log(found[gram, "block"])) * UNIT + 0.5)
        for k in keys:
            total += logs[k]
        return total / UNIT / len(keys)

    def verdict(self, difference: Column) -> Column:
        return F.lit(self.only) if self.only else F.when(difference >= self.threshold, "allow").otherwise("block")


def best_threshold(accepted: list[float], rejected: list[float]) -> float:
    """The cut between two differences with the best mean of both classes' accuracies; ``cut_of`` finds it in tables of any size."""
    if not accepted or not rejected:
        return 0.0
    marked = sorted([(d, 1) for d in accepted] + [(d, 0) for d in rejected])
    good, best, cut = 1.0, 1.0, marked[0][0]
    for i, (d, is_accepted) in enumerate(marked):
        good += -1 / len(accepted) if is_accepted else 1 / len(rejected)
        after = marked[i + 1][0] if i + 1 < len(marked) else d + 1e-9
        if after > d and good > best + 1e-12:
            best, cut = good, (d + after) / 2
    return cut


def cut_of(marked: DataFrame) -> float:
    """The threshold of distinct ``(difference, allow, block)``, with the rows of each class: sums over ranges of differences, then within them."""
    allowed, blocked, least = marked.agg(F.sum("allow"), F.sum("block"), F.min("difference")).first()
    if not allowed or not blocked:
        return 0.0
    ranged = stored(marked.repartitionByRange("difference").withColumn("part", F.spark_partition_id()), "url-ranges")
    inside = Window.partitionBy("part").orderBy("difference").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    sums = ranged.groupBy("part").agg(*[F.sum(v).alias(v) for v in CLASSES])
    before = sums.select("part", *[F.coalesce(F.sum(v).over(earlier), F.lit(0)).alias(f"{v}_before") for v in CLASSES])
    placed = ranged.withColumns({f"{v}_up": F.sum(v).over(inside) for v in CLASSES}).join(F.broadcast(before), "part")
    up = {v: (F.col(f"{v}_before") + F.col(f"{v}_up")).cast("decimal(19,0)") for v in CLASSES}
    # What the mean accuracy gains over allowing all, as an exact number.
    gain = up["block"] * F.lit(allowed).cast("decimal(19,0)") - up["allow"] * F.lit(blocked).cast("decimal(19,0)")
    best = placed.select("difference", gain.alias("gain")).orderBy(F.desc("gain"), "difference").first()
    if best["gain"] <= 0:
        return least
    after = ranged.filter(F.col("difference") > best["difference"]).agg(F.min("difference")).first()[0]
    return (best["difference"] + after) / 2


def split(judged: DataFrame, per_class: int | None, max_chars: int | None) -> DataFrame:
    """``(row, by_rule, url, train, held)``: distinct URLs that a rule decides, with their rows to learn from and, each fifth by hash, to calibrate on."""
    known = judged.filter("by_rule is not null")
    if max_chars is not None:
        known = known.filter(F.length("url") <= max_chars)
    known = known.groupBy("by_rule", "url").agg(F.count("*").alias("n")).withColumn("h", F.xxhash64("url"))
    known = stored(known.withColumn("part", F.shiftright("h", 52)), "urls-known")
    # Places of a class in the order of the hash: within one of its 4,096 ranges, after what lower ranges hold.
    inside = Window.partitionBy("by_rule", "part").orderBy("h", "url").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("by_rule").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = known.groupBy("by_rule", "part").agg(F.sum("n").alias("of_part")).withColumn("before", F.coalesce(F.sum("of_part").over(earlier), F.lit(0))).drop("of_part")
    placed = known.withColumn("up", F.sum("n").over(inside)).join(F.broadcast(before), ["by_rule", "part"])
    last = F.col("before") + F.col("up")
    first = last - F.col("n")
    if per_class is not None:
        last, first = F.least(last, F.lit(per_class)), F.least(first, F.lit(per_class))
    placed = placed.withColumns({"last": last, "first": first}).filter("last > first").withColumn("held", F.expr("last div 5 - first div 5"))
    ids = F.monotonically_increasing_id().alias("row")
    return stored(placed.select(ids, "by_rule", "url", (F.col("last") - F.col("first") - F.col("held")).alias("train"), "held"), "urls-split")


def fit(judged: DataFrame, per_class: int | None = None, max_chars: int | None = None, order: int = 5) -> UrlModel:
    """Learn from all rows of ``with_rules`` that a rule decides; ``per_class`` takes the least hashed of a class, ``max_chars`` the shorter ones."""
    sample = split(judged, per_class, max_chars)

    def by_class(n: str) -> list[Column]:
        return [F.sum(F.when(F.col("by_rule") == v, F.col(n)).otherwise(0)).alias(v) for v in CLASSES]

    sums = [F.sum(v).alias(v) for v in CLASSES]
    whole = sample.filter("train > 0").select("by_rule", "train", F.explode(grams_at(F.col("url"), order)).alias("key")).groupBy("key").agg(*by_class("train"))
    grams = stored(whole.select(F.explode(endings(F.col("key"))).alias("gram"), *CLASSES).groupBy("gram").agg(*sums), "url-counts")
    kinds = [c for v in CLASSES for c in (F.sum(v).alias(f"{v}_n"), F.count(F.when(F.col(v) > 0, 1)).alias(f"{v}_kinds"))]
    contexts = stored(grams.groupBy(context_of("gram").alias("context")).agg(*kinds), "url-contexts")
    alphabet = grams.filter(F.length("gram") == 1).count() + 1
    none = contexts.filter("context = ''").first()
    seen = [v for v in CLASSES if none and none[f"{v}_n"] > 0]
    model = UrlModel(grams, contexts, order, alphabet, None if len(seen) == 2 else (seen or ["allow"])[0])
    held = sample.filter("held > 0")
    scored = model.differences(held.select("row", "url"), "row").join(held.hint(MERGED), "row")
    model.threshold = cut_of(stored(scored.groupBy("difference").agg(*by_class("held")), "url-marks"))
    return model


def judge(judged: DataFrame, model: UrlModel, id_col: str = "page_id") -> DataFrame:
    """``(id, host, path, rule, verdict, difference)`` of the rows of ``with_rules``."""
    # Ids can be null or repeat: rows are numbered, and stored so that the numbers stay.
    rows = stored(judged.select(id_col, "url", "host", "path", "rule", "by_rule", F.monotonically_increasing_id().alias("__row")), "urls")
    found = model.differences(rows.select("__row", F.coalesce("url", F.lit("")).alias("url")), "__row")
    verdict = F.coalesce("by_rule", model.verdict(F.col("difference")))
    return rows.join(found.hint(MERGED), "__row").select(id_col, "host", "path", "rule", verdict.alias("verdict"), "difference")


def op2_url_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = with_rules(table(spark, sf_dir, "pages"), RULES)
    return judge(judged, fit(judged))
