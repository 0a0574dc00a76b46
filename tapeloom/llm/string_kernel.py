"""Language identification by string kernels.

Kernel: ``k(x, z) = sum over n = 1..3 of |G_n(x) & G_n(z)|``, the distinct character n-grams two texts
share (blended spectrum, presence), divided by ``sqrt(k(x, x) k(z, z))``. Characters are lower-cased
letters of the learned alphabet; every other character is one blank. Nyström features come from
landmark texts, and one kernel ridge regression per language (one versus rest) is solved on them. As
``k(x, landmarks)`` is a matrix product of presence rows, scores of a block of whole texts are one
product ``presence @ weights``.

Bounds of the fit (documented parameters of ``fit``): ``per_lang`` different texts of each language, those
with the least hashed ids among texts of at most ``max_chars`` characters, and ``landmarks`` of them a language; with many
languages fewer, so that all are learned from ``rows`` texts and ``marks`` landmarks, but one each at least. Every text is scored whole.

Defined results: null texts and texts without a letter are ``und`` with score 0, and so is every text
when nothing could be learned; ties go to the language that sorts first; repeated rows get equal
results; an empty table gives no rows. Only the id, text and language columns are read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeloom.llm.common import broadcast_if_small, session_setup, stored, table

#: Classes of characters: 0 blank, 1..126 learned letters, 127 other letters.
CLASSES = 128
SPACE = CLASSES + CLASSES**2 + CLASSES**3
#: Texts scored by one matrix product.
BLOCK = 32


def folds(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(parts))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class Alphabet:
    """Maps characters to classes; letters outside the learned ones share a class."""

    def __init__(self, letters: str):
        self.to_class = np.zeros(0x110000, np.uint8)
        self.letter = np.zeros(0x110000, bool)
        for c in range(0x110000):
            if chr(c).isalpha():
                self.letter[c] = True
                self.to_class[c] = CLASSES - 1
        for k, low in enumerate(letters[: CLASSES - 2], 1):
            for c in {low, low.upper()}:
                if len(c) == 1:
                    self.to_class[ord(c)] = k

    def grams(self, text: str) -> np.ndarray | None:
        """Codes of the distinct 1- to 3-grams; None without a letter."""
        points = code_points(text)
        if not self.letter[points].any():
            return None
        a = self.to_class[points].astype(np.int64)
        pairs = a[:-1] * CLASSES + a[1:]
        triples = pairs[:-1] * CLASSES + a[2:]
        codes = np.concatenate([a, CLASSES + pairs, CLASSES + CLASSES**2 + triples])
        return self._distinct(codes)

    def _distinct(self, codes: np.ndarray) -> np.ndarray:
        """Distinct codes in linear time: of equal codes the last writer of a slot stays."""
        if not hasattr(self, "_slots"):
            self._slots = np.zeros(SPACE, np.int32)
        at = np.arange(len(codes), dtype=np.int32)
        self._slots[codes] = at
        return codes[self._slots[codes] == at]


@dataclass
class Model:
    letters: str
    langs: list[str]
    vocabulary: np.ndarray  # code -> row of weights, or -1
    weights: np.ndarray  # rows of the vocabulary, one more of zeros; a column a language
    bias: np.ndarray
    sharpness: float = 6.0

    def __getstate__(self):
        known = np.flatnonzero(self.vocabulary >= 0).astype(np.int32)
        return self.__dict__ | {"vocabulary": (known, self.vocabulary[known])}

    def __setstate__(self, state):
        known, rows = state["vocabulary"]
        state["vocabulary"] = np.full(SPACE, -1, np.int32)
        state["vocabulary"][known] = rows
        self.__dict__.update(state)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        if not hasattr(self, "_alphabet"):
            self._alphabet = Alphabet(self.letters)
        names, scores = ["und"] * len(texts), np.zeros(len(texts))
        for at in range(0, len(texts) if self.langs else 0, BLOCK):
            block = texts[at : at + BLOCK]
            presence = np.zeros((len(block), len(self.weights)), np.float32)
            size = np.zeros(len(block))
            for i, text in enumerate(block):
                found = self._alphabet.grams(text) if text else None
                if found is not None:
                    size[i] = len(found)
                    presence[i, self.vocabulary[found]] = 1  # -1, the last column, has zero weights
            values = (presence @ self.weights) / np.sqrt(np.maximum(size, 1))[:, None] + self.bias
            top = values.argmax(axis=1)
            best = values[np.arange(len(block)), top]
            share = 1 / np.exp(self.sharpness * (values - best[:, None])).sum(axis=1)
            sure = 1 / (1 + np.exp(-self.sharpness * best))
            for i in np.flatnonzero(size):
                names[at + i], scores[at + i] = self.langs[top[i]], min(share[i], sure[i])
        return names, scores


def fit(docs: DataFrame, per_lang: int = 300, landmarks: int = 40, max_chars: int = 50_000, rows: int = 2_000, marks: int = 400, ridge: float = 1e-3) -> Model:
    """Learn from ``docs (doc_id, text, lang)``; rows without text or language are left out."""
    hashes = {"h": F.xxhash64("doc_id"), "of_text": F.xxhash64("text")}
    short = docs.filter("lang is not null and text is not null").filter(F.char_length("text") <= max_chars).withColumns(hashes)
    n = max(1, short.select("lang").distinct().count())
    held = max(1, min(per_lang, rows // n))
    per = Window.partitionBy("lang").orderBy("h", "of_text")
    place = F.struct("h", "of_text")
    cut = short.select("lang", *hashes).withColumn("k", F.row_number().over(per)).filter(F.col("k") <= held).groupBy("lang").agg(F.max(place).alias("last"))
    cut = stored(cut, "cut")
    chosen = short.join(broadcast_if_small(cut), "lang").filter(place <= F.col("last")).dropDuplicates(["lang", *hashes])
    found = chosen.orderBy("lang", *hashes).select("lang", "text").limit(held * n).collect()
    return solve([r["text"] for r in found], [r["lang"] for r in found], max(1, min(landmarks, marks // n)), ridge)


def solve(texts: list[str], langs: list[str], landmarks: int, ridge: float) -> Model:
    """Nyström features on the landmarks, then ridge regression of the one-versus-rest targets."""
    counts = Counter(c for t in texts for c in t.lower() if c.isalpha())
    letters = "".join(c for c, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[: CLASSES - 2])
    alphabet = Alphabet(letters)
    found = [(g, y) for t, y in zip(texts, langs) if (g := alphabet.grams(t)) is not None]
    names = sorted({y for _, y in found})
    held: Counter = Counter()
    marks = []
    for g, y in found:
        if held[y] < landmarks:
            held[y] += 1
            marks.append(g)
    vocabulary = np.full(SPACE, -1, np.int32)
    known = np.unique(np.concatenate(marks)) if marks else np.zeros(0, np.int64)
    vocabulary[known] = np.arange(len(known))
    if not names:
        return Model(letters, [], vocabulary, np.zeros((1, 0), np.float32), np.zeros(0))

    def presence(sets: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(sets), len(known) + 1), np.float32)
        for i, g in enumerate(sets):
            out[i, vocabulary[g]] = 1 / np.sqrt(len(g))
        out[:, -1] = 0
        return out

    of_marks = presence(marks)
    values, vectors = np.linalg.eigh((of_marks @ of_marks.T).astype(np.float64))
    good = values > values[-1] * 1e-6
    to_features = vectors[:, good] / np.sqrt(values[good])
    kernel = np.concatenate([presence([g for g, _ in found[i : i + 256]]) @ of_marks.T for i in range(0, len(found), 256)])
    features = kernel @ to_features
    mean = features.mean(axis=0)
    target = np.array([[1.0 if y == n else -1.0 for n in names] for _, y in found])
    centre = target.mean(axis=0)
    gram = (features - mean).T @ (features - mean) + ridge * len(found) * np.eye(features.shape[1])
    beta = np.linalg.solve(gram, (features - mean).T @ (target - centre))
    weights = of_marks.T.astype(np.float64) @ (to_features @ beta)
    return Model(letters, names, vocabulary, weights.astype(np.float32), centre - mean @ beta)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of ``docs`` and ``__lang, __score``: prediction from the text alone."""
    session_setup(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, scores = shared.value.predict(b.column(names.index("text")).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(langs, pa.string()), pa.array(scores)], [*names, "__lang", "__score"])

    schema = docs.select(*names, F.lit("").alias("__lang"), F.lit(0.0).alias("__score")).schema
    return docs.mapInArrow(run, schema)


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.filter(folds(F.col("doc_id"), 3) != 1).select("doc_id", "text", "lang")


def op3_string_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    done = predict(docs.select("doc_id", "text"), fit(training_rows(docs)))
    held_out = folds(F.col("doc_id"), 3) == 1
    return done.select("doc_id", held_out.alias("held_out"), F.col("__lang").alias("lang_pred"), F.col("__score").alias("score"))


def rejection_score(docs: DataFrame, model: Model, share: float = 0.001, least_rows: int = 1000) -> float:
    """The score that all but ``share`` of the right predictions of labelled rows outside the fit reach.

    Rounded down to thousandths. Below ``least_rows`` right predictions such a quantile is not known, and
    the score is 0: only texts without a language are told apart then.
    """
    held_out = docs.filter((folds(F.col("doc_id"), 3) == 1) & F.col("lang").isNotNull()).select("text", "lang")
    right = predict(held_out, model).filter(F.col("__lang") == F.col("lang"))
    bins = right.groupBy(F.floor(F.col("__score") * 1000).cast("long").alias("bin")).count().orderBy("bin").collect()
    total = sum(r["count"] for r in bins)
    if total < least_rows:
        return 0.0
    below = 0
    for r in bins:
        below += r["count"]
        if below > share * total:
            return r["bin"] / 1000
    return 0.0


def keep_identified(docs: DataFrame, min_score: float | None = None) -> DataFrame:
    """Pipeline stage: documents with a language, predicted with ``min_score`` (else ``rejection_score``) or more.

    A document whose language is not given gets the predicted one.
    """
    model = fit(training_rows(docs))
    least = rejection_score(docs, model) if min_score is None else min_score
    done = predict(docs, model)
    lang = F.coalesce("lang", "__lang").alias("lang")
    return done.filter((F.col("__lang") != "und") & (F.col("__score") >= least)).select(*[lang if c == "lang" else c for c in docs.columns])
