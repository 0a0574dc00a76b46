"""Awkward documents that every operator must take, and helpers to run queries over them."""

import functools
import random

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, row string, doc string, node bigint, label string"
rng = random.Random(11)
WORDS = ["the", "of", "and", "tion", "ESTE", "größe", "été", "año", "x1", "2024", "über", "lorem", "日本", "naïve"]


def prose(n: int) -> str:
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", ",", "a", "er", "ion"]) for _ in range(n))


LONG = prose(60_000)
COPY = prose(80)
LINE = "A line that several documents share, word for word."


@functools.cache
def documents():
    rows = [
        (1, None), (2, ""), (3, " \n\t\n"), (4, "!!! ???"), (5, "Word"), (6, LONG), (7, COPY), (8, COPY), (8, COPY), (9, COPY.replace("lorem", "Lorem ipsum", 1)),
        (None, COPY + " tail"), (10, "x" * 3000), (11, "a\x00b   c\r\nd"), (12, "\n" * 50), (13, f"{LINE}\nown {prose(12)}\n{LINE}"), (14, f"  {LINE.upper()} \nzz"),
        (15, LINE), (16, "tiny\ntiny\ntiny"), (17, LONG[:5000]), (18, "😀 emoji 😀" * 20),
    ]
    rows += [(100 + i, prose(30)) for i in range(25)]
    return [(i, t, ["en", "de", None][k % 3], "s", len(t or ""), "r", "d", k, "l") for k, (i, t) in enumerate(rows)]


def write(spark, folder, rows=None, items=None):
    """A scale-factor folder with ``documents`` and ``benchmark``."""
    rows = documents() if rows is None else rows
    spark.createDataFrame(rows, SCHEMA).write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    held = [(1, COPY[:200]), (2, None), (3, ""), (4, "word"), (5, LINE), (5, LINE), (6, "nothing that occurs anywhere here")] if items is None else items
    spark.createDataFrame(held, "item_id bigint, text string").write.mode("overwrite").parquet(f"{folder}/benchmark.parquet")
    return str(folder)
