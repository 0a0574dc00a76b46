"""The pipeline's stages, each against a brute-force version on its own input."""

import hashlib
import re

import pytest

import corpus_pipeline
from tapeloom.llm import bpe
from tapeloom.llm.minhash import drop_near_duplicates
from tests.llm import cases

UP = {ord(c): chr(ord(c) + 32) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
BLANKS = " \t\n\x0b\x0c\r"


def line_key(x):
    return x.strip(BLANKS).translate(UP)


def shingles(text):
    w = [x for x in re.split(f"[{BLANKS}]+", (text or "").translate(UP)) if x]
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    folder = cases.write(spark, tmp_path_factory.mktemp("pipeline"))
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "out")
        stage(spark, out[-1], folder).write.parquet(path)
        out.append(spark.read.parquet(path))
    return folder, out


def test_stages_keep_the_columns(steps):
    _, out = steps
    assert all(d.columns == out[0].columns for d in out[:5])


def test_language_stage_drops_what_has_no_letter(steps):
    _, (docs, kept, *_) = steps
    want = sorted((r["doc_id"] or -1) for r in docs.collect() if any(c.isalpha() for c in r["text"] or ""))
    assert sorted((r["doc_id"] or -1) for r in kept.collect()) == want


def test_line_stage(steps):
    _, (_, docs, done, *_) = steps
    rows, held = docs.collect(), {}
    for r in rows:
        for x in r["text"].split("\n"):
            if len(line_key(x)) >= 20:
                held.setdefault(line_key(x), set()).add(-1 if r["doc_id"] is None else r["doc_id"])
    stays = lambda i, x: len(h := held.get(line_key(x), ())) < 3 or max(h) == i
    want = sorted((i, "\n".join(x for x in r["text"].split("\n") if stays(i, x))) for r in rows for i in [-1 if r["doc_id"] is None else r["doc_id"]])
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["text"]) for r in done.collect()) == want
    assert all(r["n_chars"] == len(r["text"]) for r in done.collect())


def test_near_duplicate_stage(steps):
    _, (_, _, docs, done, *_) = steps
    rows = [(r["doc_id"], shingles(r["text"])) for r in docs.collect()]
    group = list(range(len(rows)))
    for _ in rows:
        for a, (_, x) in enumerate(rows):
            for b, (_, y) in enumerate(rows):
                if x and y and 100 * len(x & y) >= 80 * len(x | y):
                    group[a] = group[b] = min(group[a], group[b])
    want = []
    for k, (i, s) in enumerate(rows):
        ids = [j for g, (j, _) in zip(group, rows) if g == group[k] and j is not None]
        if not s or i == min(ids, default=None):
            want.append(-1 if i is None else i)
    assert sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in done.collect()) == sorted(want)


def test_decontamination_and_tokens(steps):
    _, (_, _, _, docs, clean, tokens) = steps
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(UP))
    items = [words(t) for t in (cases.COPY[:200], "word", cases.LINE, "nothing that occurs anywhere here")]
    windows = {tuple(x[s : s + min(13, len(x))]) for x in items for s in range(len(x) - min(13, len(x)) + 1)}

    def bad(text):
        w, hit = words(text), set()
        for n in {len(x) for x in windows}:
            for s in range(len(w) - n + 1):
                if tuple(w[s : s + n]) in windows:
                    hit |= set(range(s, s + n))
        return bool(hit) and 20 * len(hit) >= len(w)

    key = lambda r: -1 if r["doc_id"] is None else r["doc_id"]
    assert sorted(map(key, clean.collect())) == sorted(key(r) for r in docs.collect() if not bad(r["text"]))
    encoding = bpe.load_encoding(*bpe.multi_50k())
    assert sorted((key(r), r["n_tokens"]) for r in tokens.collect()) == sorted((key(r), len(encoding.encode_ordinary(r["text"] or ""))) for r in clean.collect())


def test_token_ids_are_those_of_the_digest(steps):
    _, (*_, tokens) = steps
    for r in tokens.collect():
        assert len(r["ids"]) == r["n_tokens"]
        assert hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in r["ids"])).hexdigest() == r["ids_sha256"]


def test_language_stage_names_the_language(steps):
    _, (docs, kept, *_) = steps
    given = {(r["doc_id"], r["text"]): r["lang"] for r in docs.collect()}
    assert all(r["lang"] and r["lang"] == (given[r["doc_id"], r["text"]] or r["lang"]) for r in kept.collect())


def test_one_row_of_each_group_stays(spark):
    a, b = cases.prose(60), cases.prose(60)
    near = a.rsplit(" ", 1)[0]
    rows = [(5, a), (5, a), (5, near), (7, a), (None, b), (None, b), (None, b + " x"), (3, None), (3, None), (4, " "), (9, "own words of one row only here"), (9, "own words of one row only here")]
    docs = spark.createDataFrame([(*r, "x", k) for k, r in enumerate(rows)], "doc_id bigint, text string, part string, row int")
    found = drop_near_duplicates(docs).collect()
    assert sorted(repr(r["doc_id"]) for r in found) == ["3", "3", "4", "5", "9", "None"]
    assert {r["text"] for r in found if r["doc_id"] == 5} <= {a, near}
    assert found[0].asDict().keys() == set(docs.columns)


def test_run_equals_the_stages(spark, steps):
    folder, out = steps
    assert sorted(map(str, corpus_pipeline.run(spark, folder).collect())) == sorted(map(str, out[-1].collect()))


def test_empty_table(spark, tmp_path):
    cases.write(spark, tmp_path, rows=[], items=[])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
