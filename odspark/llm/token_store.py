"""Token ids in seekable zstandard files.

File format (all numbers little-endian): independent zstandard frames, each
holding the ids of whole documents as unsigned 32-bit integers; then a skippable
zstandard frame with the seek table:

    magic 0x184D2A5E, payload size (u4), payload =
      documents: n x (doc_id i8, first id u8, ids u8)   in ascending doc_id
      frames:    m x (first document u8, file offset u8, stored size u8,
                      raw size u8, crc32 of the raw bytes u4, zero u4)
      footer:    n u8, m u8, crc32 of the payload before the footer u4, magic u4

A plain zstandard decoder reads the file as one stream of ids and skips the
table. A reader fetches the footer, the table and then only the frames that
hold requested documents, and checks each frame's checksum. A document longer
than a frame has a frame of its own.

``write_store`` range-partitions documents by id (bounds from a scan of the id
column, sizes taken into account), encodes inside the writing task and writes
one file per range. A task writes to an attempt-unique name and returns it; the
manifest table lists only names of finished tasks, so a repeated or lost task
leaves at most an unlisted file. The folder must be reachable by all executors
through an Arrow file system (``file://``, ``s3://``, ``hdfs://``, ``gs://``).

Defined results: null and empty texts hold the end id only; repeated doc_ids
keep their rows, in the order of their text; a null doc_id is stored before all
others as the smallest id; an empty table gives an empty manifest.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from odspark.llm.bpe import encoder
from odspark.llm.staging import staged, text_size, text_volume
from odspark.session import staged_path

MAGIC_SKIP = 0x184D2A5E
MAGIC_FOOT = 0x4F445A53
FRAME_BYTES = 1 << 18
DOC = np.dtype([("doc_id", "<i8"), ("first", "<u8"), ("ids", "<u8")])
FRAME = np.dtype([("doc", "<u8"), ("offset", "<u8"), ("stored", "<u8"), ("raw", "<u8"), ("crc", "<u4"), ("zero", "<u4")])
FOOTER = struct.Struct("<QQII")
NULL_ID = -(1 << 63)
MAX_DOCS_PER_FILE = 1_000_000


class StoreWriter:
    """Appends documents to one open binary file."""

    def __init__(self, out, frame_bytes: int = FRAME_BYTES, level: int = 3):
        import zstandard

        self.out, self.limit = out, frame_bytes
        self.codec = zstandard.ZstdCompressor(level=level)
        self.docs, self.frames, self.open, self.size = [], [], [], 0
        self.offset = self.ids = 0
        self.open_doc = 0

    def add(self, doc_id: int, ids: bytes) -> None:
        if self.size and self.size + len(ids) > self.limit:
            self._flush()
        self.docs.append((doc_id, self.ids, len(ids) // 4))
        self.ids += len(ids) // 4
        self.open.append(ids)
        self.size += len(ids)

    def _flush(self) -> None:
        raw = b"".join(self.open)
        stored = self.codec.compress(raw)
        self.frames.append((self.open_doc, self.offset, len(stored), len(raw), zlib.crc32(raw), 0))
        self.out.write(stored)
        self.offset += len(stored)
        self.open, self.size, self.open_doc = [], 0, len(self.docs)

    def close(self) -> None:
        if self.open:
            self._flush()
        body = np.array(self.docs, DOC).tobytes() + np.array(self.frames, FRAME).tobytes()
        size = len(body) + FOOTER.size
        self.out.write(struct.pack("<II", MAGIC_SKIP, size) + body
                       + FOOTER.pack(len(self.docs), len(self.frames), zlib.crc32(body), MAGIC_FOOT))


class StoreReader:
    """Reads documents of one file; ``fetched`` counts the frames decompressed."""

    def __init__(self, file, size: int):
        self.file, self.fetched = file, 0
        n, m, crc, magic = FOOTER.unpack(self._read(size - FOOTER.size, FOOTER.size))
        if magic != MAGIC_FOOT:
            raise ValueError("no seek table at the end of the file")
        body = self._read(size - FOOTER.size - n * DOC.itemsize - m * FRAME.itemsize,
                          n * DOC.itemsize + m * FRAME.itemsize)
        if zlib.crc32(body) != crc:
            raise ValueError("seek table checksum")
        self.docs = np.frombuffer(body, DOC, n)
        self.frames = np.frombuffer(body, FRAME, m, n * DOC.itemsize)

    def _read(self, at: int, size: int) -> bytes:
        self.file.seek(at)
        return self.file.read(size)

    def frame(self, k: int) -> np.ndarray:
        import zstandard

        f = self.frames[k]
        raw = zstandard.ZstdDecompressor().decompress(self._read(int(f["offset"]), int(f["stored"])),
                                                      max_output_size=int(f["raw"]) or 1) if f["raw"] else b""
        if zlib.crc32(raw) != f["crc"]:
            raise ValueError(f"frame {k} checksum")
        self.fetched += 1
        return np.frombuffer(raw, "<u4")

    def documents(self, wanted: set[int] | None = None):
        """(doc_id, first id in the file, ids) in file order, of all or the wanted ids."""
        held, ids = -1, None
        rows = range(len(self.docs)) if wanted is None else np.flatnonzero(
            np.isin(self.docs["doc_id"], list(wanted)))
        for r in rows:
            k = int(np.searchsorted(self.frames["doc"], r, "right")) - 1
            if k != held:
                held, ids = k, self.frame(k)
            d = self.docs[r]
            a = int(d["first"] - self.docs[int(self.frames[k]["doc"])]["first"])
            yield int(d["doc_id"]), int(d["first"]), ids[a:a + int(d["ids"])]


def _open(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")


def _range_of(cuts: list[int]):
    """Index of the id range of a document: one bound per file, searched in Arrow batches."""
    bounds = np.array(cuts, np.int64)

    @F.pandas_udf("long")
    def range_of(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, ids.to_numpy(np.int64), "right"))

    return range_of


def write_store(docs: DataFrame, folder: str, tokenizer_path: str, spaces: str = "dropped",
                end_id: int = 1, key: str = "doc_id", text: str = "text",
                bytes_per_file: int = 32 << 20) -> DataFrame:
    """Write all documents; returns the staged manifest: one row per file with its
    range, name, first doc_id, documents, ids, size and the ids of all files before it."""
    rows = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(NULL_ID)).alias("doc_id"),
                       F.col(text).alias("text"))
    n, volume = text_volume(rows)
    files = max(1, -(-volume // bytes_per_file), -(-n // MAX_DOCS_PER_FILE))
    cuts = sorted({int(c) for c in rows.approxQuantile(
        "doc_id", [i / files for i in range(1, files)], 0.1 / files)}) if files > 1 else []

    def write(batches):
        enc = encoder(tokenizer_path, spaces)
        end = struct.pack("<I", end_id)
        filesystem, base = _open(folder)
        state = {}

        def finish():
            w = state["writer"]
            w.close()
            size = state["out"].tell()
            state["out"].close()
            return pa.RecordBatch.from_arrays(
                [pa.array([state["bucket"]], pa.int64()), pa.array([state["name"]]),
                 pa.array([w.docs[0][0]], pa.int64()), pa.array([len(w.docs)], pa.int64()), pa.array([w.ids], pa.int64()), pa.array([size], pa.int64())],
                names=["range", "file", "first_doc", "n_docs", "n_ids", "size"])

        for b in batches:
            for r, doc_id, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), enc.encode_column(b.column(2))):
                if r != state.get("bucket"):
                    if state:
                        yield finish()
                    name = f"part-{r:06d}-{uuid.uuid4().hex}.idz"
                    filesystem.create_dir(base, recursive=True)
                    out = filesystem.open_output_stream(f"{base}/{name}")
                    state = {"bucket": r, "name": name, "out": out, "writer": StoreWriter(out)}
                state["writer"].add(doc_id, ids + end)
        if state:
            yield finish()

    manifest = (rows.select(_range_of(cuts)("doc_id").alias("range"), "doc_id", "text")
                .repartitionById(files, F.col("range").cast("int")).sortWithinPartitions("range", "doc_id", "text")
                .mapInArrow(write, "`range` long, file string, first_doc long, n_docs long, n_ids long, size long"))
    # one row per file: the running start over all files is a small window
    start = F.sum("n_ids").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    return staged(staged(manifest, "manifest").withColumn("start", F.coalesce(start, F.lit(0)))
                  .withColumn("folder", F.lit(folder)), "manifest-start")


def read_store(manifest: DataFrame, wanted: DataFrame | None = None, key: str = "doc_id") -> DataFrame:
    """(doc_id, start, ids) of all documents, or of those whose id is in ``wanted``.

    ``start`` is the number of ids of all documents before it. With ``wanted``
    (a table of ids) the ids travel to the file whose range holds them and
    only their frames are fetched and decompressed."""
    cols = ["folder", "file", "size", "start"]
    out = "doc_id long, start long, ids binary"

    def read(folder, file, size, start, ids=None):
        filesystem, base = _open(folder)
        with filesystem.open_input_file(f"{base}/{file}") as f:
            got, parts = [], 0
            for doc_id, first, tok in StoreReader(f, size).documents(None if ids is None else set(ids)):
                got.append((None if doc_id == NULL_ID else doc_id, start + first, tok.tobytes()))
                parts += len(tok)
                if parts > 1 << 20:
                    yield _batch(got)
                    got, parts = [], 0
            if got:
                yield _batch(got)

    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                yield from read(**row)

    if wanted is not None:
        # one first id per file is held on the driver, as any file index is;
        # a file's list of wanted ids is bounded by MAX_DOCS_PER_FILE
        index = manifest.select("first_doc").orderBy("range").toPandas()["first_doc"].tolist()
        asked = (wanted.select(F.coalesce(F.col(key).cast("long"), F.lit(NULL_ID)).alias("_id")).distinct()
                 .groupBy((_range_of(index)("_id") - 1).alias("_nth")).agg(F.collect_list("_id").alias("ids")))
        nth = F.row_number().over(Window.orderBy("range")) - 1
        manifest = manifest.withColumn("_nth", nth.cast("long")).join(asked, "_nth")
        cols = [*cols, "ids"]
    files = manifest.select(cols)
    return files.repartition(max(1, manifest.count())).mapInArrow(run, out)


def _batch(rows):
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
         pa.array([r[2] for r in rows], pa.binary())], names=["doc_id", "start", "ids"])


def new_folder(spark: SparkSession) -> str:
    return staged_path(spark, "token-store")
