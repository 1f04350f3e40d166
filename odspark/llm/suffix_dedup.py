"""Removal of every byte covered by a long string that occurs elsewhere.

A string of ``length`` bytes is a window. Suffixes are not sorted at every
position: each window has an anchor, the leftmost smallest hash among its
``GRAM``-byte grams, which depends on the window's content only, so equal
windows have their anchors at the same place. Consecutive windows with one
anchor make a run. The steps, all keyed by hashes and never by document:

1. Runs with the same text form a class (anchor hash and digest of the text).
   Classes are counted in Spark; every window of a class with two runs or more
   occurs elsewhere. This settles copies, however many there are. A document's
   runs of one class travel in one row, so that a line repeated all over a
   document counts once there.
2. One run of each class stays. Anchors that only one class has are done.
3. For the other anchors the text around them is sorted: suffixes forward from
   the anchor and prefixes backward from it (``suffix_sort``: hash comparison,
   binary search, mergesort, byte-by-byte verification). A window that reaches
   ``o`` bytes back and ``length - o`` bytes forward occurs elsewhere when some
   other run agrees with it ``o`` bytes back and ``length - o`` forward: the
   pair of its classes in the two sorted orders then occurs twice.
   Anchors are dealt to tasks by hash. An anchor with more than ``MAX_GROUP``
   different runs is not brought together: the digests of its windows are
   counted in Spark instead, which gives the same answer without a limit.
4. Chunks of documents get their marked windows, merge them into maximal
   spans and drop the bytes.

The digests that are counted without a look at the bytes are keyed anew in each
call: for a fixed hash, texts can be made that share it (for the polynomial
one, from two dozen letters on).

Texts count as UTF-8 bytes; windows never cross documents and are judged on the
input. Defined results: null and empty texts have no windows; texts shorter
than ``length`` stay; repeated rows are separate documents (so they remove each
other); an empty table gives an empty result; input columns are kept, those
named like an output column are dropped.
"""

from __future__ import annotations

import os
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from odspark.llm import rolling as R
from odspark.llm.chunked import CHUNK, ROW, chunk_documents, chunk_of, rows_of
from odspark.llm.staging import staged
from odspark.llm.suffix_sort import Suffixes, classes

LENGTH = 400
GRAM = 48
MAX_GROUP = 20_000
# Runs in one row, and rows in one batch: their places stay below 2 GB.
ROW_RUNS, BATCH_ROWS = 4096, 1 << 16
# Low bits of the window minimum hold the position: texts up to 4 GB.
_LOW = np.uint64(32)


def _digests(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: bytes) -> np.ndarray:
    view = memoryview(data)
    return np.frombuffer(b"".join(blake2b(view[a:b], digest_size=8, key=seed).digest()
                                  for a, b in zip(start.tolist(), end.tolist())), np.uint64)


class _Runs:
    """Anchored runs of windows of consecutive texts: document index, first
    window (in the document), number of windows, anchor (in the document),
    anchor hash, class digest."""

    FIELDS = ("doc", "start", "n", "anchor", "gram", "cls")

    def __init__(self, data: np.ndarray, off: np.ndarray, length: int, gram: int, seed: bytes = b""):
        R.drop_memos()
        self.length, self.size, self.seed = length, gram, seed
        parts = []
        for i, j in R.slices(off):
            if j == i + 1:  # a long text goes piece by piece; its runs may be cut, which harms nothing
                step, end = 1 << 21, off[j]
                parts += [self._slice(data[x:min(x + step + length - 1, end)], None, i, x - off[i])
                          for x in range(off[i], max(off[i] + 1, end - length + 1), step)]
            else:
                parts.append(self._slice(data[off[i]:off[j]], off[i:j + 1] - off[i], i, 0))
        for k, name in enumerate(self.FIELDS):
            kind = np.uint64 if k > 3 else np.int64
            setattr(self, name, np.concatenate([p[k] for p in parts] or [np.empty(0, kind)]))

    def _slice(self, data, off, first_doc, shift):
        length, gram = self.length, self.size
        none = [np.empty(0, np.int64)] * 4 + [np.empty(0, np.uint64)] * 2
        if len(data) < length:
            return none
        off = np.array([0, len(data)]) if off is None else off
        h = R.byte_prefix(data)
        at = np.arange(len(data) - gram + 1)
        g = R.byte_span(h, at, at + gram)
        least = (g >> _LOW << _LOW) | at.astype(np.uint64)
        span, width = length - gram + 1, 1
        while width * 2 <= span:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if rest := span - width:
            least = np.minimum(least[:-rest], least[rest:])
        inside = np.zeros(len(data) + 1, np.int32)
        np.add.at(inside, off[:-1], 1)
        np.add.at(inside, np.maximum(off[1:] - length + 1, off[:-1]), -1)
        s = np.flatnonzero(np.cumsum(inside[:len(least)]) > 0)
        if not len(s):
            return none
        p = (least[s] & ((np.uint64(1) << _LOW) - np.uint64(1))).astype(np.int64)
        doc = np.searchsorted(off, s, "right") - 1
        new = np.ones(len(s), bool)
        new[1:] = (p[1:] != p[:-1]) | (doc[1:] != doc[:-1])
        a = np.flatnonzero(new)
        n, start, anchor, doc = np.diff(np.append(a, len(s))), s[a], p[a], doc[a]
        inner = shift - off[:-1][doc]
        return [doc + first_doc, start + inner, n, anchor + inner, g[anchor],
                _digests(data, start, start + n - 1 + length, self.seed)]

    def rows(self):
        """Per document and class: document, first window of the first run, number of windows, anchor hash,
        class digest, first windows of the other runs (8 bytes each). Very many runs make several rows."""
        order = np.lexsort((self.start, self.cls, self.gram, self.doc))
        new = np.ones(len(order), bool)
        new[1:] = np.any([v[order][1:] != v[order][:-1] for v in (self.doc, self.gram, self.cls)], axis=0)
        first = np.flatnonzero(new)
        at = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
        first = np.flatnonzero(at % ROW_RUNS == 0)
        for x in range(0, len(first), BATCH_ROWS):
            a = first[x:x + BATCH_ROWS]
            end = first[x + BATCH_ROWS] if x + BATCH_ROWS < len(first) else len(order)
            rest = np.ones(end - a[0], bool)
            rest[a - a[0]] = False
            sizes = np.diff(np.append(a, end)) - 1
            more = pa.Array.from_buffers(pa.binary(), len(a), [
                None, pa.py_buffer(np.concatenate(([0], np.cumsum(sizes) * 8)).astype(np.int32)),
                pa.py_buffer(self.start[order[a[0]:end][rest]])])
            use = order[a]
            yield self.doc[use], self.start[use], self.n[use], self.gram[use], self.cls[use], more


def _anchor(data, off, n, group, length, gram) -> np.ndarray:
    """Anchor of each run, from its body: the leftmost gram with the run's hash
    that lies in all its windows."""
    h = R.byte_prefix(data)
    back = np.full(len(n), -1, np.int64)
    todo = np.arange(len(n))
    k = 0
    while len(todo):
        # a run's anchor is at its last window's start or behind it
        at = off[:-1][todo] + n[todo] - 1 + k
        found = R.byte_span(h, at, at + gram) == group[todo]
        back[todo[found]] = at[found] - off[:-1][todo[found]]
        todo, k = todo[~found], k + 1
        if k > length:
            raise RuntimeError("a run without its anchor")
    return back


def _rows(cols, schema: pa.Schema) -> pa.Table:
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)


def _schema(**kinds) -> pa.Schema:
    return pa.schema(list(kinds.items()))


def remove_repeats(docs: DataFrame, length: int = LENGTH, key: str = "doc_id", text: str = "text",
                   gram: int = GRAM, max_group: int = MAX_GROUP) -> DataFrame:
    """All columns with ``text`` as the remaining bytes (binary), n_bytes, n_removed, n_spans."""
    gram = min(gram, length)
    added = ("n_bytes", "n_removed", "n_spans")
    docs = docs.select(*[c for c in docs.columns if c not in added])
    names = docs.columns
    seed = os.urandom(16)
    rows, chunks, volume = chunk_documents(docs, key, text, with_row=True)

    def find(batches):
        for b in batches:
            data, off = R.text_bytes(b.column(1))
            for i, j in R.slices(off, 8 << 20):
                r = _Runs(data[off[i]:off[j]], off[i:j + 1] - off[i], length, gram, seed)
                for doc, start, n, g, cls, more in r.rows():
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0).take(pa.array(doc + i)), pa.array(start), pa.array(n.astype(np.int32)),
                         pa.array(g.view(np.int64)), pa.array(cls.view(np.int64)), more],
                        names=["row", "start", "n", "gram", "cls", "more"])

    # no shuffle of texts: runs are told by row fingerprint and first window
    runs = staged(rows_of(docs, key, text).mapInArrow(find, "row long, start long, n int, gram long, cls long, more binary"),
                  "runs")
    times = F.sum(1 + F.floor(F.octet_length("more") / 8))
    # one row per anchor and task goes through this shuffle; most anchors occur once and end here
    # written before the join, so that both of its sides are plain shuffles and a hot anchor can be split
    again = staged(runs.groupBy("gram").agg(times.alias("c"), (F.min("cls") != F.max("cls")).alias("mixed"))
                   .where("c > 1").select("gram", "mixed"), "shared-anchors")
    runs = staged(runs.join(again, "gram"), "shared-runs")
    kinds = runs.groupBy("gram", "cls").agg(times.alias("c"), F.max("mixed").alias("mixed"),
                                            F.min(F.struct("row", "start", "n")).alias("rep"))
    kinds = staged(kinds, "run-classes")
    copied = (runs.join(kinds.where("c > 1").select("gram", "cls"), ["gram", "cls"])
              .select("row", "start", "n", F.lit(None).cast("binary").alias("at"), "more"))
    members = kinds.where("mixed").groupBy("gram").agg(F.count("*").alias("m"))
    hot = members.where(F.col("m") > max_group).select("gram")
    compared = kinds.where("mixed").select("gram", "rep.row", "rep.start", "rep.n")
    any_hot = not hot.isEmpty()

    # the text around the anchors of the runs to compare
    def around(table: pa.Table, wanted: pa.Table) -> pa.Table:
        if not wanted.num_rows or not table.num_rows:
            return around_schema.empty_table()
        data, off = R.text_bytes(table.column(text))
        order = np.argsort(table.column(ROW).to_numpy(), kind="stable")
        ids = table.column(ROW).to_numpy()[order]
        row, start, n = (wanted.column(c).to_numpy() for c in ("row", "start", "n"))
        a = off[:-1][order[np.searchsorted(ids, row)]] + start
        body = [data[x:x + m - 1 + length] for x, m in zip(a, n)]
        return _rows([wanted.column("gram").combine_chunks(), row, start, n, [x.tobytes() for x in body]], around_schema)

    around_schema = _schema(gram=pa.int64(), row=pa.int64(), start=pa.int64(), n=pa.int32(), body=pa.binary())

    def context(wanted: DataFrame) -> DataFrame:
        chunked = wanted.withColumn(CHUNK, chunk_of("row", chunks))
        return rows.groupBy(CHUNK).cogroup(chunked.groupBy(CHUNK)).applyInArrow(
            around, "gram long, row long, start long, n int, body binary")

    def compare(table: pa.Table) -> pa.Table:
        data, off = R.text_bytes(table.column("body"))
        n = table.column("n").to_numpy().astype(np.int64)
        group = table.column("gram").to_numpy()
        # the anchor is where the gram with the group's hash first stands among the windows' grams
        back = _anchor(data, off, n, group.view(np.uint64), length, gram)
        p = off[:-1] + back
        forward = Suffixes(data, p, off[1:], group)
        flipped = len(data) - off
        backward = Suffixes(data[::-1].copy(), len(data) - p, flipped[:-1], group)
        marked: list[list[int]] = [[] for _ in range(len(n))]
        for o in range(0, length - gram + 1):
            have = np.flatnonzero((back - n + 1 <= o) & (o <= back))
            if len(have) < 2:
                continue
            pair = classes(forward, length - o)[have] * (len(n) + 1) + classes(backward, o)[have]
            order = np.argsort(pair, kind="stable")
            same = pair[order][1:] == pair[order][:-1]
            twice = np.zeros(len(have), bool)
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
            for m in have[twice]:
                marked[m].append(back[m] - o)
        hit = [m for m in range(len(n)) if marked[m]]
        return _rows([table.column("row").to_numpy()[hit], table.column("start").to_numpy()[hit],
                      [np.array(marked[m], np.uint16).tobytes() for m in hit]], marks_schema)

    marks_schema = _schema(row=pa.int64(), start=pa.int64(), at=pa.binary())
    tasks = max(1, volume // (4 << 20))
    cold = compared.join(hot, "gram", "left_anti") if any_hot else compared
    marked = (context(cold).withColumn("task", F.pmod(F.xxhash64("gram"), F.lit(tasks)).cast("int"))
              .groupBy("task").applyInArrow(compare, "row long, start long, at binary")
              .select("row", "start", F.lit(1).alias("n"), "at", F.lit(b"").alias("more")))
    marks = copied.unionByName(marked)

    if any_hot:
        # anchors with very many different runs: their windows are counted by digest
        def window_hashes(batches):
            for b in batches:
                data, off = R.text_bytes(b.column(4))
                n = b.column(3).to_numpy().astype(np.int64)
                which = np.repeat(np.arange(len(n)), n)
                at = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
                w = off[:-1][which] + at
                start = b.column(2).to_numpy()[which] + at
                yield pa.RecordBatch.from_arrays(
                    [pa.array(b.column(0).to_numpy()[which]), pa.array(b.column(1).to_numpy()[which]), pa.array(start),
                     pa.array(_digests(data, w, w + length, seed).view(np.int64))], names=["gram", "row", "start", "hash"])

        counted = staged(context(compared.join(hot, "gram", "left_semi"))
                         .mapInArrow(window_hashes, "gram long, row long, start long, hash long"), "window-hashes")
        often = counted.groupBy("gram", "hash").agg(F.count("*").alias("c")).where("c > 1").select("gram", "hash")
        marks = marks.unionByName(counted.join(often, ["gram", "hash"]).select(
            "row", "start", F.lit(1).alias("n"), F.lit(None).cast("binary").alias("at"), F.lit(b"").alias("more")))

    def rewrite(table: pa.Table, mark: pa.Table) -> pa.Table:
        data, off = R.text_bytes(table.column(text))
        cover = np.zeros(len(data) + 1, np.int32)
        if mark.num_rows:
            ids = table.column(ROW).to_numpy()
            order = np.argsort(ids, kind="stable")
            row, start, n = (mark.column(c).to_numpy() for c in ("row", "start", "n"))
            at = mark.column("at")
            counts = np.array([len(x) // 2 if x else 1 for x in at.to_pylist()])
            inner = np.frombuffer(b"".join(x or bytes(2) for x in at.to_pylist()), np.uint16).astype(np.int64)
            more = mark.column("more").to_pylist()
            others = np.repeat(np.arange(len(row)), [len(x) // 8 for x in more])
            start = np.concatenate((np.repeat(start, counts) + inner, np.frombuffer(b"".join(more), np.int64)))
            row, n = (np.concatenate((np.repeat(v, counts), v[others])) for v in (row, n))
            lo, hi = np.searchsorted(ids[order], row), np.searchsorted(ids[order], row, "right")
            for copy in range(int((hi - lo).max())):  # equal rows share their marks
                use = lo + copy < hi
                first = off[:-1][order[lo[use] + copy]] + start[use]
                np.add.at(cover, first, 1)
                np.add.at(cover, first + n[use] - 1 + length, -1)
        gone = np.cumsum(cover[:-1]) > 0
        cum = np.concatenate(([0], np.cumsum(gone)))
        begin = gone.copy()
        begin[1:] &= ~gone[:-1]
        heads = off[:-1][off[:-1] < len(gone)]
        begin[heads] = gone[heads]  # a span never crosses documents
        spans = np.concatenate(([0], np.cumsum(begin)))
        out = R.replace_text(table.select(names), text, data, off, ~gone, binary=True)
        for name, v in (("n_bytes", np.diff(off)), ("n_removed", np.diff(cum[off])), ("n_spans", np.diff(spans[off]))):
            out = out.append_column(name, pa.array(v.astype(np.int64)))
        return out.cast(result)

    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema
    schema = T.StructType([T.StructField(f.name, T.BinaryType() if f.name == text else f.dataType) for f in docs.schema]
                          + [T.StructField(c, T.LongType()) for c in added])
    result = to_arrow_schema(schema)
    marks = marks.withColumn(CHUNK, chunk_of("row", chunks))
    return rows.groupBy(CHUNK).cogroup(marks.groupBy(CHUNK)).applyInArrow(
        lambda left, right: rewrite(left, right) if left.num_rows else result.empty_table(), schema)
