"""Sequence packing over the length histogram, shortest pack first.

Documents are tokenised and cut into pieces of at most ``size`` ids: full
pieces, then the rest. Only the histogram of piece lengths (at most ``size``
rows) reaches the driver. There, lengths are placed longest first; each goes
to the emptiest open packing pattern that still has room (the shortest pack),
splitting a pattern's count when it holds more packs than there are pieces
left. The result is a small table of slots: for one length, the range of
piece ranks it takes, the first sequence id and the offset.

Pieces get a rank within their length without a sort or a window over pieces:
every task numbers its own pieces per length while cutting, the counts per
(task, length) give each task's first rank, and rank = first rank + number.
Pieces then join the slots by length and rank range. Cut pieces are staged, so
the numbering is fixed once.

A sequence of fill f is padded to ``size``, except when f is a power of two:
such a sequence is kept at f. ``padding`` per sequence follows that rule.

Defined results: null and empty texts hold the end id only; repeated rows are
packed each; an empty table gives no pieces; further columns are not read; a
null doc_id is kept.
"""

from __future__ import annotations

import struct
import zlib
from collections import defaultdict
from heapq import heappop, heappush

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from odspark.llm.bpe import encoder
from odspark.llm.staging import staged

SIZE = 1024


def cut_pieces(docs: DataFrame, tokenizer_path: str, end_id: int = 0, size: int = SIZE, key: str = "doc_id",
               text: str = "text", spaces: str = "leading", with_ids: bool = True) -> DataFrame:
    """Staged pieces: doc_id, start, length, ids_crc32, doc_tokens, ids, and the
    numbering (part, nth) of equal lengths within the writing task."""
    def run(batches):
        enc, end = encoder(tokenizer_path, spaces), struct.pack("<I", end_id)
        part, seen = TaskContext.get().partitionId(), defaultdict(int)
        for b in batches:
            out = []
            for doc_id, ids in zip(b.column(0).to_pylist(), enc.encode_column(b.column(1))):
                ids += end
                total = len(ids) // 4
                for a in range(0, total, size):
                    piece = ids[4 * a:4 * (a + size)]
                    n = len(piece) // 4
                    out.append((doc_id, a, n, zlib.crc32(piece), total, piece if with_ids else None, part, seen[n]))
                    seen[n] += 1
            for i in range(0, len(out), 4096):
                cols = list(zip(*out[i:i + 4096]))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids", "part", "nth"]
    kinds = [pa.int64()] * 5 + [pa.binary(), pa.int32(), pa.int64()]
    return staged(rows.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
                                       "ids binary, part int, nth long"), "pieces")


def shortest_pack_first(histogram: dict[int, int], size: int = SIZE) -> list[tuple[int, int, int, int, int]]:
    """Slots (length, first rank, end rank, first sequence, offset).

    Patterns are kept by fill; a heap gives the emptiest. All packs of one
    pattern are alike, so the work depends on the number of lengths and
    patterns, not of pieces."""
    slots = []
    packs: dict[int, list[tuple[int, int]]] = defaultdict(list)  # fill -> [(first sequence, count)]
    fills: list[int] = []
    sequences = 0

    def put(fill: int, first: int, count: int) -> None:
        if fill < size:
            if fill not in packs:
                heappush(fills, fill)
            packs[fill].append((first, count))

    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            # emptiest pattern first; when that one has no room, none has
            if fills and fills[0] + length <= size:
                fill = fills[0]
                first, count = packs[fill].pop()
                used = min(count, left)
                if used < count:
                    packs[fill].append((first + used, count - used))
                if not packs[fill]:
                    del packs[fill]
                    heappop(fills)
            else:
                # as many packs as equal pieces need when each holds several
                fill, first, used = 0, sequences, -(-left // (size // length))
                sequences += used
            slots.append((length, rank, rank + used, first, fill))
            put(fill + length, first, used)
            rank, left = rank + used, left - used
    return slots


def pack_pieces(pieces: DataFrame, size: int = SIZE) -> DataFrame:
    """Pieces with sequence_id and offset; sequences are filled gaplessly from 0."""
    spark: SparkSession = pieces.sparkSession
    counts = staged(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "piece-counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = spark.createDataFrame(shortest_pack_first(histogram, size) or [(0, 0, 0, 0, 0)],
                                  "length long, lo long, hi long, first long, offset long")
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    firsts = counts.select("part", "length", F.coalesce(before, F.lit(0)).alias("first_rank"))
    ranked = (pieces.join(firsts, ["part", "length"])
              .withColumn("rank", F.col("first_rank") + F.col("nth")).drop("part", "nth", "first_rank"))
    # the slots are a few rows per length: bounded by the histogram
    s = F.broadcast(slots)
    return (ranked.join(s, (ranked["length"] == s["length"]) & (F.col("rank") >= F.col("lo"))
                        & (F.col("rank") < F.col("hi")))
            .select(*[ranked[c] for c in ranked.columns if c != "rank"],
                    (F.col("first") + F.col("rank") - F.col("lo")).alias("sequence_id"), s["offset"]))


def padding(fill: Column, size: int = SIZE) -> Column:
    """Padding ids of a sequence: none at a power of two, else up to ``size``."""
    return F.when(F.bit_count(fill) == 1, 0).otherwise(size - fill)
