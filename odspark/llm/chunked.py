"""Documents grouped into chunks of bounded size.

Operators that pass over the texts several times (hash, compare, rewrite) do
so per chunk: a group of documents chosen by a hash of the key. All passes of a
plan read the same exchange of the texts, so they are shuffled once, and small
per-chunk results are joined back to their chunk by ``cogroup``.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from odspark.llm.staging import text_volume

CHUNK, KEY, ROW = "_chunk", "_doc", "_row"
MIN_CHUNK, MAX_CHUNK = 4 << 20, 64 << 20
SMALLEST = -(1 << 63)


def chunk_bytes(volume: int) -> int:
    """Chunks grow with the square root of the data, within fixed bounds."""
    return int(min(MAX_CHUNK, max(MIN_CHUNK, math.sqrt(volume * (16 << 10)))))


def _key(key: str):
    return F.coalesce(F.col(key).cast("long"), F.lit(SMALLEST))


def chunk_of(col: str, chunks: int):
    return F.pmod(F.xxhash64(col), F.lit(chunks)).cast("int")


def rows_of(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(_row, text) of every document, unshuffled."""
    return docs.select(F.xxhash64(_key(key), text).alias(ROW), F.col(text).alias(text))


def chunk_documents(docs: DataFrame, key: str, text: str,
                    with_row: bool = False) -> tuple[DataFrame, int, int]:
    """(documents with _chunk and _doc, number of chunks, bytes of text).

    ``_doc`` is the key as a long; null becomes the smallest long. ``with_row``
    adds ``_row``, a fingerprint of key and text (equal rows share it), and
    chunks by it."""
    rows = docs.withColumn(KEY, _key(key))
    _, volume = text_volume(docs, text)
    chunks = max(1, -(-volume // chunk_bytes(volume)))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = KEY
    if with_row:
        rows, by = rows.withColumn(ROW, F.xxhash64(KEY, text)), ROW
    rows = rows.withColumn(CHUNK, chunk_of(by, chunks))
    return rows.repartition(max(1, min(n, chunks)), CHUNK), chunks, volume


def ordered(table: pa.Table, text: str) -> pa.Table:
    """A chunk's rows in a fixed order: by key, then text."""
    return table.take(pc.sort_indices(table, sort_keys=[(KEY, "ascending"), (text, "ascending")]))


def pack(values: np.ndarray) -> bytes:
    """Numbers as compressed byte planes."""
    import zstandard

    if not len(values):
        return b""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(data: bytes, dtype) -> np.ndarray:
    import zstandard

    if not data:
        return np.empty(0, dtype)
    raw = zstandard.ZstdDecompressor().decompress(data)
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(dtype).reshape(-1)
