"""Byte-level BPE encoding and decoding with a local rank file.

Every text is encoded as the tiktoken library does without special tokens. Long texts are cut at
places where the pre-splitting pattern must end a match anyway (an ASCII letter or digit followed by
a space or line feed: no alternative of the pattern crosses from a non-space to a space), so each
call of the library sees a bounded text and the ids are the same as for the whole text.

Null texts count as empty; empty texts have no ids. Texts without a safe place are encoded whole.
Rows are independent: repeated rows, ties and repeated ids need no rule. An empty table gives an
empty result. Input columns other than the two named are not read.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tapeloom.llm.common import session_setup, table

#: Characters of a text above which it is cut at safe places.
PIECE_CHARS = 200_000
_SAFE = re.compile(r"[A-Za-z0-9](?=[ \n])")


@functools.lru_cache(maxsize=4)
def load_encoding(ranks_path: str, pattern: str):
    """The encoder for a rank file of lines ``base64 rank``; one per Python worker."""
    import tiktoken

    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def safe_pieces(text: str, size: int = PIECE_CHARS) -> Iterator[str]:
    """``text`` in pieces of about ``size`` characters, cut only where every match ends."""
    start = 0
    while len(text) - start > size:
        cut = _SAFE.search(text, start + size)
        if cut is None:
            break
        yield text[start : cut.end()]
        start = cut.end()
    yield text[start:]


def encode_ids(encoding, text: str, size: int = PIECE_CHARS) -> np.ndarray:
    """Ids of ``text`` as little-endian unsigned 32-bit integers."""
    if len(text) <= size:
        return np.asarray(encoding.encode_ordinary(text), dtype="<u4")
    parts = [np.asarray(encoding.encode_ordinary(p), dtype="<u4") for p in safe_pieces(text, size)]
    return np.concatenate(parts)


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id, ``ids`` (array of long) and ``n_tokens``."""
    session_setup(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = load_encoding(ranks_path, pattern)
        for b in batches:
            ids = [encode_ids(encoding, t or "") for t in b.column(1).to_pylist()]
            ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
            flat = np.concatenate(ids).astype(np.int64) if ids else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
            counts = pa.array(np.diff(ends).astype(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), lists, counts], [id_col, "ids", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids array<bigint>, n_tokens bigint")


def decode(rows: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per input row: the id and ``bytes``, the raw bytes of its ids (null ids: empty)."""
    session_setup(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = load_encoding(ranks_path, pattern)
        for b in batches:
            raw = [encoding.decode_bytes(ids or []) for ids in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(raw, pa.binary())], [id_col, "bytes"])

    kind = rows.schema[id_col].dataType.simpleString()
    return rows.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {kind}, bytes binary")


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Encode and decode in one pass: counts and digests and, with ``keep_ids``, the ids."""
    session_setup(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = load_encoding(ranks_path, pattern)
        for b in batches:
            counts, of_ids, of_bytes, kept = [], [], [], []
            for text in b.column(1):
                ids = encode_ids(encoding, text.as_py() or "")
                counts.append(len(ids))
                of_ids.append(hashlib.sha256(ids.tobytes()).hexdigest())
                of_bytes.append(hashlib.sha256(encoding.decode_bytes(ids.tolist())).hexdigest())
                if keep_ids:
                    kept.append(ids.astype(np.int32))
            columns = [b.column(0), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())]
            if keep_ids:
                flat = np.concatenate(kept) if kept else np.zeros(0, np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(np.cumsum([0, *counts], dtype=np.int32)), pa.array(flat)))
            yield pa.RecordBatch.from_arrays(columns, [id_col, "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: len(columns)])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(
        run, f"`{id_col}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids
    )


def multi_50k() -> tuple[str, str]:
    """Rank file and pattern of the multilingual vocabulary that the queries use."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), *multi_50k())
