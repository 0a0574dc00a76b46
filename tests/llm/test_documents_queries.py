"""Every document query over the awkward documents, against a brute-force version, and over an empty table."""

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from tapeloom.llm import bpe, gif, positional_index, string_kernel, unit_dedup
from tapeloom.llm.queries import ORACLE_SQL, QUERIES
from tests.llm import cases

UP = {ord(c): chr(ord(c) + 32) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
BLANKS = " \t\n\x0b\x0c\r"


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def split_blank(text):
    return [w for w in re.split(f"[{BLANKS}]+", (text or "").translate(UP)) if w]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    return cases.write(spark, tmp_path_factory.mktemp("cases"))


@pytest.fixture(scope="module")
def rows():
    return [(r[0], r[1]) for r in cases.documents()]


def got(spark, folder, name, *columns):
    return sorted((tuple(r[c] for c in columns) for r in QUERIES[name](spark, folder).collect()), key=repr)


def test_bpe(spark, folder, rows):
    encoding = bpe.load_encoding(*bpe.multi_50k())
    want = []
    for i, t in rows:
        ids = encoding.encode_ordinary(t or "")
        want.append((i, len(ids), sha(b"".join(x.to_bytes(4, "little") for x in ids)), sha((t or "").encode())))
    assert got(spark, folder, "op1_byte_bpe", "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=repr)


@pytest.mark.parametrize("text", [cases.LONG, "word " * 5000, "a" * 30_000, " " * 30_000 + "x", "\n x" * 9000, "it's 5 o'clock\n\n" * 3000])
def test_safe_pieces_keep_ids(text):
    encoding = bpe.load_encoding(*bpe.multi_50k())
    assert "".join(bpe.safe_pieces(text, 997)) == text
    assert bpe.encode_ids(encoding, text, 997).tolist() == encoding.encode_ordinary(text)


def test_encode_then_decode(spark, folder, rows):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    back = bpe.decode(bpe.encode(docs, *bpe.multi_50k()), *bpe.multi_50k())
    assert sorted(((r["doc_id"], bytes(r["bytes"])) for r in back.collect()), key=repr) == sorted(((i, (t or "").encode()) for i, t in rows), key=repr)


def test_gif(spark, folder, rows):
    want = []
    for i, t in rows:
        raw = (t or "").encode()
        payload = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        want.append((i, len(raw), len(payload), sha(payload), zlib.crc32(payload[-64:])))
    assert got(spark, folder, "op4_gif", "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32") == sorted(want, key=repr)


def test_gif_frames(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").filter("doc_id in (5, 6)")
    found = gif.frames(gif.encode_texts(docs)).orderBy("doc_id", "frame_no").collect()
    assert [r["frame_no"] for r in found] == [0, *range(len(found) - 1)] and len(found) > 3
    assert [r["start_ms"] for r in found[1:]] == [100 * k for k in range(len(found) - 1)]
    assert all(sum(r["histogram"]) == r["canvas_width"] * r["canvas_height"] for r in found)
    bad = spark.createDataFrame([(1, bytearray(b"GIF89a")), (2, None)], "doc_id bigint, media binary")
    assert [r["frame_no"] for r in gif.frames(bad).collect()] == [None, None]


def lzw(pixels, size):
    """A plain LZW code stream: one clear code, then literals and another clear before codes grow."""
    clear, bits, out = 1 << size, [], bytearray()
    for k, p in enumerate(pixels):
        if k % ((1 << size) - 2) == 0:
            bits += [clear >> i & 1 for i in range(size + 1)]
        bits += [p >> i & 1 for i in range(size + 1)]
    bits += [clear + 1 >> i & 1 for i in range(size + 1)]
    for k in range(0, len(bits), 8):
        out.append(sum(b << i for i, b in enumerate(bits[k : k + 8])))
    return bytes([size]) + b"".join(bytes([len(out[k : k + 255])]) + out[k : k + 255] for k in range(0, len(out), 255)) + b"\0"


def made_gif(width, height, images):
    """A GIF of ``(disposal, transparent, delay, left, top, width, height, interlaced, local palette, pixels)``."""
    colours = [(0, 0, 0), (255, 0, 0), (0, 255, 0), (0, 0, 255)]
    flat = lambda p: bytes(x for c in p for x in c)
    out = b"GIF89a" + width.to_bytes(2, "little") + height.to_bytes(2, "little") + bytes([0x81, 0, 0]) + flat(colours)
    for disposal, clear, delay, left, top, w, h, woven, local, pixels in images:
        out += b"\x21\xf9\x04" + bytes([disposal << 2 | (clear is not None)]) + delay.to_bytes(2, "little") + bytes([clear or 0, 0])
        out += b"," + b"".join(x.to_bytes(2, "little") for x in (left, top, w, h)) + bytes([(0x81 if local else 0) | (0x40 if woven else 0)]) + (flat(local) if local else b"")
        order = [r for s, d in ((0, 8), (4, 8), (2, 4), (1, 2)) for r in range(s, h, d)] if woven else range(h)
        out += lzw([pixels[r * w + c] for r in order for c in range(w)], 2)
    return out + b";"


def test_gif_disposal_transparency_interlace_and_palettes(spark):
    local = [(9, 9, 9), (90, 90, 90), (200, 200, 200), (250, 250, 250)]
    images = [
        (1, None, 5, 0, 0, 3, 2, False, None, [1, 1, 1, 2, 2, 2]), (3, 0, 7, 1, 0, 2, 2, False, None, [0, 3, 3, 0]), (2, None, 0, 0, 1, 2, 1, False, local, [2, 3]),
        (0, 2, 1, 0, 0, 3, 2, True, None, [2, 2, 3, 2, 2, 2])]
    r, g, b, k = (255, 0, 0), (0, 255, 0), (0, 0, 255), (0, 0, 0)
    want = [[r, r, r, g, g, g], [r, r, b, g, b, g], [r, r, r, local[2], local[3], g], [r, r, b, k, k, g]]
    rows = [(1, bytearray(made_gif(3, 2, images))), (2, bytearray(made_gif(3, 2, []))), (3, bytearray(made_gif(65_535, 65_535, images[:1]))), (4, None), (5, bytearray(made_gif(3, 2, images)[:60]))]
    tall = (1, None, 2, 0, 0, 2, 9, True, None, [x % 4 for x in range(18)])
    rows.append((6, bytearray(made_gif(2, 9, [tall]))))
    found = gif.frames(spark.createDataFrame(rows, "doc_id bigint, media binary")).orderBy("doc_id", "frame_no").collect()
    by = {i: [x for x in found if x["doc_id"] == i] for i in range(1, 7)}
    assert [bytes(x["pixels"]) for x in by[1]] == [bytes(v for c in w for v in c) for w in want]
    assert [(x["start_ms"], x["delay_ms"]) for x in by[1]] == [(0, 50), (50, 70), (120, 0), (120, 10)]
    assert by[1][0]["histogram"][48] == 3 and by[1][0]["histogram"][12] == 3
    assert [x["error"] for i in (2, 3, 4) for x in by[i]] == ["no images", "canvas too large", "no media"]
    assert by[5][-1]["error"] and by[5][-1]["frame_no"] is None
    colours = [k, r, g, b]
    assert bytes(by[6][0]["pixels"]) == bytes(v for p in tall[-1] for v in colours[p])


def words13(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UP))


def test_contamination(spark, folder, rows):
    items = {i: words13(t) for i, t in [(1, cases.COPY[:200]), (4, "word"), (5, cases.LINE), (6, "nothing that occurs anywhere here")]}
    want = []
    for i, t in rows:
        w, hit, held = words13(t), set(), set()
        for item, x in items.items():
            n = min(13, len(x))
            windows = {tuple(x[s : s + n]) for s in range(len(x) - n + 1)}
            for s in range(len(w) - n + 1):
                if tuple(w[s : s + n]) in windows:
                    hit |= set(range(s, s + n))
                    held.add(str(item))
        want.append((i, len(w), len(hit), len(held), sha(",".join(sorted(held))), bool(hit) and 20 * len(hit) >= len(w)))
    columns = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert got(spark, folder, "op5_positional_index", *columns) == sorted(want, key=repr)


def brute_units(rows, order, pattern, least):
    """``(id, units, removed, digest of what is kept)``; ``order`` ranks different texts of one id."""
    key = lambda u: re.sub(f"[{BLANKS}]+", " ", u).strip(" ").translate(UP)
    first = {}
    for last, i, t in sorted({(i is None, i or 0, t or "") for i, t in rows}, key=lambda k: (k[0], k[1], order.get(k[2], 0))):
        for p, u in enumerate(re.findall(pattern, t)):
            first.setdefault(key(u), (last, i, t, p))
    out = []
    for i, t in rows:
        units = re.findall(pattern, t or "")
        assert "".join(units) == (t or "")
        again = [bool(key(u)) and first[key(u)] != (i is None, i or 0, t or "", p) for p, u in enumerate(units)]
        gone = set()
        for p in range(len(units)):
            for q in range(p, len(units)):
                if not again[q]:
                    break
                if sum(len(key(u)) for u in units[p : q + 1]) >= least:
                    gone |= set(range(p, q + 1))
        out.append((i, len(units), len(gone), sha("".join(u for p, u in enumerate(units) if p not in gone))))
    return sorted(out, key=repr)


@pytest.mark.parametrize("unit,least", [("sentence", 150), ("sentence", 1), ("line", 40), ("paragraph", 1)])
def test_unit_hashing(spark, tmp_path, rows, unit, least):
    kana, passage = "かな" * 90, ". ".join(f"shared sentence number {k} of a passage" for k in range(9))
    rows = [*(r for r in rows if r[0] not in (6, 17)), (30, kana + "。end"), (31, "start。" + kana + "。other"), (32, f"own words {passage}. more"), (33, f"A b.\n\n  {passage.upper()}! Then\n \nx"),
            (34, "shared sentence number 3 of a passage"), (35, "  \n one.\n\ntwo three\n \t\n\nfour."), (36, "one. two three. four."), (None, passage), (37, "...!? 3.14 a.b")]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id bigint, text string, units string, pos int")
    order = {r["t"]: r["h"] for r in docs.selectExpr("text t", "xxhash64(text) h").distinct().collect()}
    found = unit_dedup.dedup_units(docs, unit, least).collect()
    want = brute_units(rows, order, unit_dedup.UNITS[unit], least)
    assert sorted(((r["doc_id"], r["n_units"], len(r["removed"]), sha(r["text"])) for r in found), key=repr) == want
    if unit == "sentence":
        assert sum(x[2] > 0 for x in want) >= 4
    for r in found:  # what is kept and removed covers the original text
        text = next((t for i, t in rows if i == r["doc_id"] and len(t or "") == max([x["end"] for x in [*r["kept"], *r["removed"]]], default=0)), "") or ""
        assert "".join(text[x["start"] : x["end"]] for x in r["kept"]) == r["text"]


def test_unit_hashing_query_matches_its_sql(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    columns = ("doc_id", "n_units", "n_removed", "removed_spans", "kept_sha256")
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({ORACLE_SQL['op8_unit_hashing']})").fetchall()
    assert got(spark, str(tmp_path), "op8_unit_hashing", *columns) == sorted(want, key=repr)
    assert any(r[2] for r in want)


def test_line_runs(spark, folder, rows):
    holders = defaultdict(set)
    key = lambda line: line.strip(BLANKS).translate(UP)
    below = -(10**9)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 20:
                holders[key(line)].add(below if i is None else i)
    want = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 20 or len(h := holders[key(x)]) < 3 or max(h) == (below if i is None else i)]
        want.append((i, len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    assert got(spark, folder, "op9_line_runs", "doc_id", "n_lines", "n_dropped", "kept_sha256") == sorted(want, key=repr)


def test_near_duplicates(spark, folder, rows):
    sets = []
    for i, t in rows:
        w = split_blank(t)
        sets.append((i, {tuple(w[k : k + 2]) for k in range(len(w) - 1)} or ({tuple(w)} if w else set())))
    part = list(range(len(sets)))

    def top(k):
        while part[k] != k:
            k = part[k]
        return k

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                part[top(a)] = top(b)
    want = []
    for k, (i, s) in enumerate(sets):
        ids = [sets[j][0] for j in range(len(sets)) if top(j) == top(k) and sets[j][0] is not None]
        least = min(ids, default=None) if s else i
        want.append((i, len(s), least, least == i))
    assert got(spark, folder, "op10_circulant_minhash", "doc_id", "n_shingles", "component_id", "kept") == sorted(want, key=repr)


def test_language(spark, folder, rows):
    found = {(r["doc_id"], r["held_out"]): (r["lang_pred"], r["score"]) for r in QUERIES["op3_string_kernel"](spark, folder).collect()}
    for i, t in rows:
        lang, score = found[i, zlib.crc32(str(i).encode() if i is not None else b"") % 3 == 1]
        assert 0 <= score <= 1
        assert (lang == "und") == (not any(c.isalpha() for c in t or ""))


def test_kernel_model_matches_brute_force():
    rng = random.Random(2)
    bases = {"aa": "abcdeé", "bb": "defghÄ", "cc": "ghiabñ"}
    make = lambda lang: "".join(rng.choice(bases[lang] + " 1A") for _ in range(rng.randrange(3, 60)))
    train = [(make(lang) + "a", lang) for lang in list(bases) * 12]
    asked = [make(rng.choice(list(bases))) + "b" for _ in range(20)] + ["日本語 text", "x"]
    seen = {c for t, _ in train for c in t.lower() if c.isalpha()}

    def grams(t):
        chars = [c.lower() if c.lower() in seen else "?" if c.isalpha() else " " for c in t]
        return {tuple(chars[i : i + n]) for n in (1, 2, 3) for i in range(len(chars) - n + 1)}

    kernel = lambda xs, zs: np.array([[len(x & z) / math.sqrt(len(x) * len(z)) for z in zs] for x in xs])
    langs = sorted(bases)
    sets = [grams(t) for t, _ in train]
    held, marks = defaultdict(int), []
    for s, (_, lang) in zip(sets, train):
        if held[lang] < 5:
            held[lang] += 1
            marks.append(s)
    values, vectors = np.linalg.eigh(kernel(marks, marks))
    good = values > values[-1] * 1e-6
    to = vectors[:, good] / np.sqrt(values[good])
    x, y = kernel(sets, marks) @ to, np.array([[1.0 if lang == n else -1.0 for n in langs] for _, lang in train])
    mean, centre = x.mean(axis=0), y.mean(axis=0)
    beta = np.linalg.solve((x - mean).T @ (x - mean) + 1e-3 * len(x) * np.eye(x.shape[1]), (x - mean).T @ (y - centre))
    want = (kernel([grams(t) for t in asked], marks) @ to - mean) @ beta + centre
    model = string_kernel.solve([t for t, _ in train], [lang for _, lang in train], 5, 1e-3)
    names, scores = model.predict(asked)
    for row, name, score in zip(want, names, scores):
        best = row.max()
        assert row[langs.index(name)] == pytest.approx(best, abs=1e-3)
        assert score == pytest.approx(min(1 / np.exp(6 * (row - best)).sum(), 1 / (1 + math.exp(-6 * best))), abs=1e-3)


def test_kernel_fit_takes_ties_repeats_and_many_languages(spark):
    rows = [(1, "same text here", "a0")] * 40 + [(1, f"other text {k}", "a1") for k in range(30)] + [(k, f"{chr(97 + k % 26) * 4} {chr(97 + k // 26) * 5}", f"l{k:03d}") for k in range(150)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = string_kernel.fit(docs, rows=300)
    assert len(model.langs) == 152
    first = string_kernel.predict(docs, model).select("doc_id", "text", "__lang", "__score").collect()
    again = string_kernel.predict(docs.repartition(5), string_kernel.fit(docs.repartition(7), rows=300)).select("doc_id", "text", "__lang", "__score").collect()
    plain = lambda rows: sorted({(r["doc_id"], r["text"], r["__lang"], round(r["__score"], 4)) for r in rows})
    assert plain(first) == plain(again)


def test_proximity_matches(spark):
    rng = random.Random(6)
    docs = [(1, "alpha beta gamma delta alpha"), (2, "alpha x x x x x beta"), (3, "Beta alpha"), (None, "alpha beta"), (None, "alpha beta"), (4, None), (5, "")]
    docs += [(10 + k, " ".join(rng.choice(["alpha", "beta", "gamma", "x", "y"]) for _ in range(40))) for k in range(12)]
    queries = [(1, ["alpha", "beta"]), (2, ["missing", "alpha"]), (3, None), (4, []), (5, ["gamma", "alpha", "beta", "gamma"])]
    index = positional_index.build_index(spark.createDataFrame(docs, "doc_id bigint, text string"))
    asked = spark.createDataFrame(queries, "query_id bigint, terms array<string>")
    for slop in (1, 3):
        got_rows = {(r["query_id"], r["doc_id"], r["pos"]) for r in positional_index.proximity_matches(index, asked, slop).collect()}
        want = set()
        for q, terms in ((1, {"alpha", "beta"}), (5, {"alpha", "beta", "gamma"})):
            words = [(i, words13(t)) for i, t in docs]
            holders = [(i, w) for i, w in words if w]
            df = {t: sum(w.count(t) for _, w in holders) for t in terms}
            rare = min(terms, key=lambda t: (df[t], t))
            for i, w in holders:
                for p, x in enumerate(w):
                    if x == rare and terms <= set(w[max(0, p - slop) : p + slop + 1]):
                        want.add((q, i, p))
        assert got_rows == want and got_rows


def test_language_accuracy_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    done = QUERIES["op3_string_kernel"](spark, sf).filter("held_out").join(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id")
    right = done.selectExpr("avg(cast(lang = lang_pred as double)) a").first()["a"]
    assert right > 0.98


@pytest.mark.parametrize("name", [n for n in QUERIES if not n.startswith("op2_")])
def test_empty_table(spark, tmp_path, name):
    cases.write(spark, tmp_path, rows=[], items=[])
    assert QUERIES[name](spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("name", ["op5_positional_index", "op9_line_runs", "op10_circulant_minhash"])
def test_partitions_do_not_matter(spark, folder, tmp_path, name):
    spark.read.parquet(f"{folder}/documents.parquet").repartition(7).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    columns = QUERIES[name](spark, folder).columns
    assert got(spark, folder, name, *columns) == got(spark, str(tmp_path), name, *columns)
