"""GIF media columns: LZW code streams, palettes, disposal and transparency, timed frames, histograms.

``encode_texts`` stores each text's UTF-8 bytes, padded with zero bytes to a positive multiple of 64,
as the indices of grey frames 64 pixels wide. ``frames`` decodes any GIF87a/89a column to one row
per frame: its time, its place and the canvas as shown, with a colour histogram. Code streams of a
batch are expanded together: a code's phrase is the phrase of an earlier code and one byte more, so
phrase lengths and first bytes come from pointer doubling over all codes at once.

Defined results: null and empty texts are 64 zero bytes; texts longer than a frame take several
frames; media that cannot be decoded, and null media, give one row with null frame columns and the
reason in ``error``; equal inputs give equal outputs; repeated rows each return; an empty table gives
no rows. Only the id and the text or media column are read.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tapeloom.llm.common import session_setup, table

WIDTH, FRAME_ROWS, DELAY_CS = 64, 1024, 10
MAX_CODES = 4096
GREY = bytes(v for i in range(256) for v in (i, i, i))


# ---- writing ----

@functools.lru_cache(maxsize=16)
def code_widths(min_size: int) -> np.ndarray:
    """Bits of the j-th code after a clear code, while the table fills."""
    j = np.arange(MAX_CODES + 1)
    next_code = np.minimum((1 << min_size) + 2 + np.maximum(j - 1, 0), MAX_CODES - 1)
    return np.maximum(np.floor(np.log2(next_code)).astype(np.int64) + 1, min_size + 1)


def lzw_codes(data: bytes, min_size: int = 8) -> list[list[int]]:
    """Phrase codes of ``data`` (not empty), a list for each table: the table starts anew when full."""
    first = (1 << min_size) + 2
    segments, out, phrases, following = [], [], {}, first
    code = data[0]
    for byte in data[1:]:
        key = code << 8 | byte
        found = phrases.get(key)
        if found is None:
            out.append(code)
            if following < MAX_CODES:
                phrases[key] = following
                following += 1
            else:
                segments.append(out)
                out, phrases, following = [], {}, first
            code = byte
        else:
            code = found
    out.append(code)
    segments.append(out)
    return segments


def lzw_encode(data: bytes, min_size: int = 8) -> bytes:
    clear, end = 1 << min_size, (1 << min_size) + 1
    of = code_widths(min_size)
    codes, widths = [[clear]], [np.array([min_size + 1])]
    segments = lzw_codes(data, min_size)
    for k, segment in enumerate(segments):
        codes.append([*segment, end if k == len(segments) - 1 else clear])
        widths.append(of[: len(segment) + 1])
    values, bits = np.concatenate([np.asarray(c, np.uint32) for c in codes]), np.concatenate(widths)
    at = np.cumsum(bits) - bits
    out = np.zeros((int(at[-1] + bits[-1]) + 7) // 8 + 3, np.uint32)
    shifted = values << (at & 7).astype(np.uint32)
    for k in range(3):  # codes never share bits, so a sum is a union
        np.add.at(out, (at >> 3) + k, shifted >> np.uint32(8 * k) & np.uint32(255))
    return out[:-3].astype(np.uint8).tobytes()


def sub_blocks(data: bytes) -> bytes:
    return b"".join(bytes([len(data[i : i + 255])]) + data[i : i + 255] for i in range(0, len(data), 255)) + b"\0"


def payload_of(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    size = max(64, -(-len(raw) // 64) * 64)
    return raw.ljust(size, b"\0"), len(raw)


def write_gif(payload: bytes) -> bytes:
    """A GIF of grey frames whose indices are ``payload`` (a positive multiple of 64 bytes)."""
    step = WIDTH * FRAME_ROWS
    rows = min(len(payload), step) // WIDTH
    parts = [b"GIF89a", struct.pack("<HHBBB", WIDTH, rows, 0xF7, 0, 0), GREY]
    for at in range(0, len(payload), step):
        data = payload[at : at + step]
        parts.append(b"\x21\xf9\x04" + struct.pack("<BHB", 1 << 2, DELAY_CS, 0) + b"\0")
        parts.append(b"\x2c" + struct.pack("<HHHHB", 0, 0, WIDTH, len(data) // WIDTH, 0) + b"\x08")
        parts.append(sub_blocks(lzw_encode(data)))
    return b"".join([*parts, b"\x3b"])


# ---- reading ----

@dataclass
class Image:
    left: int
    top: int
    width: int
    height: int
    interlaced: bool
    palette: np.ndarray
    min_size: int
    stream: bytes
    delay_cs: int
    disposal: int
    transparent: int | None


def parse(media: bytes) -> tuple[int, int, list[Image]]:
    """Canvas width and height, and the images in order."""
    if media[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    width, height, packed = struct.unpack_from("<HHB", media, 6)
    at = 13

    def colours(flags: int) -> np.ndarray:
        nonlocal at
        n = 2 << (flags & 7)
        found = np.frombuffer(media[at : at + 3 * n], np.uint8).reshape(n, 3)
        at += 3 * n
        return found

    def blocks() -> bytes:
        nonlocal at
        parts = []
        while n := media[at]:
            parts.append(media[at + 1 : at + 1 + n])
            at += 1 + n
        at += 1
        return b"".join(parts)

    shared = colours(packed) if packed & 0x80 else np.zeros((1, 3), np.uint8)
    images, delay, disposal, transparent = [], 0, 0, None
    while True:
        kind = media[at]
        at += 1
        if kind == 0x3B:
            return width, height, images
        if kind == 0x21:
            label = media[at]
            at += 1
            data = blocks()
            if label == 0xF9:
                flags, delay, colour = struct.unpack_from("<BHB", data)
                disposal, transparent = flags >> 2 & 7, colour if flags & 1 else None
        elif kind == 0x2C:
            left, top, w, h, flags = struct.unpack_from("<HHHHB", media, at)
            at += 9
            palette = colours(flags) if flags & 0x80 else shared
            size = media[at]
            at += 1
            images.append(Image(left, top, w, h, bool(flags & 0x40), palette, size, blocks(), delay, disposal, transparent))
            delay, disposal, transparent = 0, 0, None
        else:
            raise ValueError("unknown block")


def unpack(stream: bytes, min_size: int) -> list[np.ndarray]:
    """The phrase codes of a code stream, an array for each table."""
    if not 1 <= min_size <= 8:
        raise ValueError("code size")
    clear, end = 1 << min_size, (1 << min_size) + 1
    d = np.frombuffer(stream + b"\0\0\0", np.uint8).astype(np.uint32)
    total, bit, segments = len(stream) * 8, 0, []
    of = code_widths(min_size)
    starts = np.concatenate([[0], np.cumsum(of)])
    current: list[np.ndarray] = []
    j = 0  # codes read since the last clear code
    while bit + min_size < total:
        if j < MAX_CODES:
            at = bit + starts[j : MAX_CODES + 1] - starts[j]
            widths = of[j : MAX_CODES + 1]
        else:
            at, widths = bit + 12 * np.arange(MAX_CODES), np.full(MAX_CODES, 12)
        n = int(np.searchsorted(at + widths, total, "right"))
        if not n:
            break
        at, widths = at[:n], widths[:n]
        byte = at >> 3
        codes = (d[byte] | d[byte + 1] << 8 | d[byte + 2] << 16) >> (at & 7).astype(np.uint32) & ((1 << widths) - 1).astype(np.uint32)
        stops = np.flatnonzero((codes == clear) | (codes == end))
        if len(stops):
            k = int(stops[0])
            current.append(codes[:k])
            segments.append(np.concatenate(current))
            if codes[k] == end:
                return [s for s in segments if len(s)]
            bit, j, current = int(at[k] + widths[k]), 0, []
        else:
            current.append(codes)
            bit, j = int(at[-1] + widths[-1]), j + n
    return [s for s in [*segments, *([np.concatenate(current)] if current else [])] if len(s)]


def expand(segments: list[np.ndarray], clears: list[int]) -> list[np.ndarray]:
    """The bytes of each segment of codes; all segments at once."""
    if not segments:
        return []
    sizes = np.array([len(s) for s in segments])
    base = np.cumsum(sizes) - sizes
    codes = np.concatenate(segments).astype(np.int64)
    first = np.repeat(np.array(clears), sizes) + 2
    here = np.arange(len(codes))
    literal = codes < first - 2
    parent = np.where(literal, here, np.repeat(base, sizes) + codes - first)
    if (parent > here).any() or (parent[~literal] >= here[~literal]).any():
        raise ValueError("a code before its phrase")
    jump, length = parent.copy(), (~literal).astype(np.int64)
    while True:
        further = jump[jump]
        if (further == jump).all():
            break
        length += length[jump]
        jump = further
    length += 1
    root = codes[jump]
    last = np.where(literal, codes, root[np.minimum(parent + 1, len(codes) - 1)])
    ends = np.cumsum(length)
    out = np.empty(int(ends[-1]), np.uint8)
    place, now = ends - 1, here
    while len(now):
        out[place] = last[now]
        more = ~literal[now]
        place, now = place[more] - 1, parent[now[more]]
    return np.split(out, ends[base + sizes - 1][:-1])


def expand_images(images: list[Image]) -> list[np.ndarray]:
    """Palette indices, height by width, of every image; code streams are expanded together."""
    segments, clears, owners = [], [], []
    for i, image in enumerate(images):
        found = unpack(image.stream, image.min_size)
        segments += found
        clears += [1 << image.min_size] * len(found)
        owners += [i] * len(found)
    parts: list[list[np.ndarray]] = [[] for _ in images]
    for i, data in zip(owners, expand(segments, clears)):
        parts[i].append(data)
    out = []
    for image, data in zip(images, parts):
        flat = np.concatenate(data) if data else np.zeros(0, np.uint8)
        n = image.width * image.height
        if len(flat) < n:
            raise ValueError("too few pixels")
        grid = flat[:n].reshape(image.height, image.width)
        if image.interlaced:
            order = np.concatenate([np.arange(s, image.height, d) for s, d in ((0, 8), (4, 8), (2, 4), (1, 2))])
            grid = grid[np.argsort(order)]
        out.append(grid)
    return out


def shown(width: int, height: int, images: list[Image], indices: list[np.ndarray]) -> Iterator[np.ndarray]:
    """The canvas (height, width, RGB) while each image is shown."""
    canvas = np.zeros((height, width, 3), np.uint8)
    for image, grid in zip(images, indices):
        rows, cols = slice(image.top, image.top + image.height), slice(image.left, image.left + image.width)
        before = canvas[rows, cols].copy() if image.disposal == 3 else None
        if int(grid.max(initial=0)) >= len(image.palette):
            raise ValueError("colour outside the palette")
        colour = image.palette[grid]
        if image.transparent is not None:
            colour = np.where((grid == image.transparent)[..., None], canvas[rows, cols], colour)
        canvas[rows, cols] = colour
        yield canvas
        if image.disposal == 2:
            canvas[rows, cols] = 0
        elif before is not None:
            canvas[rows, cols] = before


def colour_histogram(canvas: np.ndarray) -> np.ndarray:
    """Pixels in 64 colour cells: two high bits of red, green and blue."""
    high = canvas.reshape(-1, 3) >> 6
    return np.bincount(high[:, 0].astype(np.int64) * 16 + high[:, 1] * 4 + high[:, 2], minlength=64)


# ---- columns ----

def encode_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, media)``: the GIF of each text's bytes."""
    session_setup(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            media = [write_gif(payload_of(t.as_py())[0]) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(media, pa.binary())], [id_col, "media"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, media binary")


def frames(media: DataFrame, id_col: str = "doc_id", media_col: str = "media", max_pixels: int = 1 << 26) -> DataFrame:
    """One row per frame: number, start and length in ms, place, canvas pixels (RGB), histogram.

    Null media, bytes that are no GIF, a GIF without images, and a canvas of more than ``max_pixels`` pixels have one row
    with nulls and the ``error``; a GIF that breaks off has the frames before, then such a row.
    """
    session_setup(media.sparkSession)
    kind = media.schema[id_col].dataType.simpleString()
    schema = (f"`{id_col}` {kind}, frame_no int, start_ms bigint, delay_ms bigint, left int, top int, width int, height int, "
              "canvas_width int, canvas_height int, pixels binary, histogram array<bigint>, error string")
    names = ["frame_no", "start_ms", "delay_ms", "left", "top", "width", "height", "canvas_width", "canvas_height", "pixels", "histogram", "error"]
    types = [pa.int32(), pa.int64(), pa.int64(), *[pa.int32()] * 6, pa.binary(), pa.list_(pa.int64()), pa.string()]

    def decoded(data: bytes | None) -> Iterator[tuple]:
        try:
            if data is None:
                raise ValueError("no media")
            width, height, images = parse(data)
            if not images:
                raise ValueError("no images")
            if width * height > max_pixels:
                raise ValueError("canvas too large")
            found, start = expand_images(images), 0
            for k, (image, canvas) in enumerate(zip(images, shown(width, height, images, found))):
                yield (k, start, image.delay_cs * 10, image.left, image.top, image.width, image.height, width, height,
                       canvas.tobytes(), colour_histogram(canvas).tolist(), None)
                start += image.delay_cs * 10
        except (ValueError, IndexError, struct.error) as e:
            yield (*[None] * 11, str(e) or type(e).__name__)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                rows = list(zip(*decoded(b.column(1)[i].as_py())))
                if rows:
                    ids = b.column(0).take(pa.array([i] * len(rows[0])))
                    yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, t) for c, t in zip(rows, types))], [id_col, *names])

    return media.select(id_col, media_col).mapInArrow(run, schema)


def digests(docs: DataFrame) -> DataFrame:
    """Write each text as a GIF, read its frames back and digest both; one row per document row."""
    session_setup(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_frames"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, media = [], []
            for text in b.column(1):
                payload, n = payload_of(text.as_py())
                sizes.append(n)
                media.append(write_gif(payload))
            parsed = [parse(m) for m in media]
            indices = iter(expand_images([image for _, _, images in parsed for image in images]))
            rows = []
            for n, m, (width, height, images) in zip(sizes, media, parsed):
                grids = [next(indices) for _ in images]
                parts, bins = [], np.zeros(64, np.int64)
                for image, canvas in zip(images, shown(width, height, images, grids)):
                    region = canvas[image.top : image.top + image.height, image.left : image.left + image.width]
                    parts.append(region[..., 0].tobytes())  # grey palette: the colour is the index
                    bins += colour_histogram(region)
                back = b"".join(parts)
                feature = ",".join(map(str, bins[[0, 21, 42, 63]]))  # the grey cells; others are empty
                rows.append((n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(m), hashlib.sha256(m).hexdigest(), feature, len(images)))
            columns = [pa.array(c) for c in zip(*rows)]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], names)

    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, n_frames bigint")


def op4_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
