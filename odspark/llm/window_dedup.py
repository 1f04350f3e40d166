"""Removal of repeated word windows across documents.

Every window of ``k`` consecutive words gets a Rabin-Karp hash (a polynomial
over word hashes, rolled by prefix values). A window goes when its word
sequence also starts in a document with a smaller id; windows that go are
merged into maximal intervals and their words are cut from the text. Windows
are judged on the input, not on what is left.

One row per window would be many times the text, so hashes travel packed: a
chunk of documents sends its distinct hashes, sorted and delta-coded, with the
smallest document that has each; the hash space is divided into ranges, and
each range finds the smallest document of every hash. It answers one bit per
hash: "a smaller document has it elsewhere". The chunk hashes its texts again
and applies the bits. A passage in a third of all documents is one entry per
chunk, whatever the number of documents.

Words are maximal runs of bytes other than space, \\t, \\n, \\v, \\f, \\r. Hashes
are 64 bits wide: among n windows about n * n / 2**65 pairs collide.

Defined results: null and empty texts stay as they are with 0 words; texts
shorter than a window stay; rows with one id are one document (none is smaller
than the other, so both stay); a null id is smaller than all others; an empty
table gives an empty result. All input columns are kept, with the text
rewritten; input columns named like an output column are dropped.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from odspark.llm import rolling as R
from odspark.llm.chunked import CHUNK, KEY, chunk_documents, ordered, pack, unpack

WORDS = 13
HASHES_PER_RANGE = 800_000


class _Windows:
    """Window hashes of one chunk, with the documents they start in."""

    def __init__(self, table: pa.Table, text: str, k: int):
        R.drop_memos()
        self.table = ordered(table, text)
        self.docs = self.table.column(KEY).to_numpy()
        self.data, self.off = R.text_bytes(self.table.column(text))
        self.k, self.parts = k, []
        hashes, doc = [], []
        for i, j in R.slices(self.off):
            d, o = self.data[self.off[i]:self.off[j]], self.off[i:j + 1] - self.off[i]
            s, e, w = R.words(d, o)
            h, at = R.windows(R.word_hashes(d, s, e), w, k)
            hashes.append(h)
            doc.append((w[at] + i).astype(np.int32))
            self.parts.append((i, j, s, e, w, at))
        self.hashes = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
        self.row = np.concatenate(doc) if doc else np.empty(0, np.int32)
        # rows are in order of id: the first row with a hash has its smallest id
        self.order = np.argsort(self.hashes, kind="stable").astype(np.int32)
        sorted_h = self.hashes[self.order]
        new = np.ones(len(sorted_h), bool)
        new[1:] = sorted_h[1:] != sorted_h[:-1]
        self.starts = np.flatnonzero(new)
        self.distinct = sorted_h[self.starts]
        self.first = self.row[self.order[self.starts]]
        self.nth = np.cumsum(new, dtype=np.int32) - 1  # distinct index of each sorted hash


def _ranges(distinct: np.ndarray, bits: int) -> np.ndarray:
    bounds = (np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)) if bits else np.empty(0, np.uint64)
    return np.concatenate(([0], np.searchsorted(distinct, bounds), [len(distinct)]))


def remove_repeats(docs: DataFrame, k: int = WORDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All columns, the text without repeated windows, n_words and n_removed."""
    added = ("n_words", "n_removed")
    docs = docs.select(*[c for c in docs.columns if c not in added])
    names = docs.columns
    rows, _, volume = chunk_documents(docs, key, text)
    bits = max(0, math.ceil(math.log2(max(1, volume / 6 / HASHES_PER_RANGE))))

    def send(table: pa.Table) -> pa.Table:
        w = _Windows(table, text, k)
        cut, out = _ranges(w.distinct, bits), []
        chunk = table.column(CHUNK)[0].as_py()
        for r in np.flatnonzero(np.diff(cut)):
            a, b = cut[r], cut[r + 1]
            local, who = np.unique(w.docs[w.first[a:b]], return_inverse=True)
            out.append((int(r), chunk, pack(np.diff(w.distinct[a:b], prepend=np.uint64(0))),
                        pack(np.diff(local, prepend=0)), pack(who.astype(np.uint32))))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), sent)], schema=sent) \
            if out else sent.empty_table()

    def judge(table: pa.Table) -> pa.Table:
        R.drop_memos()
        got = table.to_pydict()
        hashes = [np.cumsum(unpack(h, np.uint64), dtype=np.uint64) for h in got["hashes"]]
        first = [np.cumsum(unpack(d, np.int64))[unpack(w, np.uint32)] for d, w in zip(got["docs"], got["who"])]
        h, f = np.concatenate(hashes), np.concatenate(first)
        order = np.argsort(h, kind="stable")
        starts = np.flatnonzero(np.concatenate(([True], h[order][1:] != h[order][:-1])))
        least = np.repeat(np.minimum.reduceat(f[order], starts), np.diff(np.append(starts, len(h))))
        later = np.empty(len(h), bool)
        later[order] = f[order] > least
        ends = np.cumsum([len(x) for x in hashes])
        bits_of = [np.packbits(later[e - len(x):e]).tobytes() for x, e in zip(hashes, ends)]
        return pa.Table.from_arrays([pa.array(got[CHUNK], pa.int32()), pa.array(got["range"], pa.int32()),
                                     pa.array([len(x) for x in hashes], pa.int32()), pa.array(bits_of, pa.binary())],
                                    schema=answered)

    def rewrite(table: pa.Table, answers: pa.Table) -> pa.Table:
        w = _Windows(table, text, k)
        later = np.zeros(len(w.distinct), bool)
        cut = _ranges(w.distinct, bits)
        for r, n, flags in zip(*(answers.column(c).to_pylist() for c in ("range", "n", "flags"))):
            later[cut[r]:cut[r] + n] = np.unpackbits(np.frombuffer(flags, np.uint8), count=n).astype(bool)
        # a window goes when a smaller document has it elsewhere or in this chunk
        goes = np.empty(len(w.hashes), bool)
        own = w.docs[w.row[w.order]] > w.docs[w.first[w.nth]]
        goes[w.order] = later[w.nth] | own
        n = w.table.num_rows
        n_words, n_removed = np.zeros(n, np.int64), np.zeros(n, np.int64)
        kept, seen = np.ones(len(w.data), bool), 0
        for i, j, s, e, doc, at in w.parts:
            out = R.covered(at[goes[seen:seen + len(at)]], k, len(s))
            seen += len(at)
            n_words[i:j] = np.bincount(doc, minlength=j - i)
            n_removed[i:j] = R.sums_by_doc(out, doc, j - i)
            # a removed word goes with the space up to the next word of its document
            base = w.off[i]
            nxt = np.append(s[1:], w.off[j] - base)
            nxt = np.minimum(nxt, w.off[i + 1:j + 1][doc] - base)
            gone = np.zeros(int(w.off[j] - base) + 1, np.int8)
            np.add.at(gone, s[out], 1)
            np.add.at(gone, nxt[out], -1)
            kept[base:w.off[j]] = np.cumsum(gone[:-1]) == 0
        return R.replace_text(w.table.select(names), text, w.data, w.off, kept).append_column(
            "n_words", pa.array(n_words)).append_column("n_removed", pa.array(n_removed)).cast(result)

    sent = pa.schema([("range", pa.int32()), (CHUNK, pa.int32()), ("hashes", pa.binary()), ("docs", pa.binary()),
                      ("who", pa.binary())])
    answered = pa.schema([(CHUNK, pa.int32()), ("range", pa.int32()), ("n", pa.int32()), ("flags", pa.binary())])
    from pyspark.sql.pandas.types import to_arrow_schema
    schema = docs.schema.add("n_words", "long").add("n_removed", "long")
    result = to_arrow_schema(schema)
    hashes = rows.groupBy(CHUNK).applyInArrow(
        send, f"range int, {CHUNK} int, hashes binary, docs binary, who binary")
    answers = hashes.groupBy("range").applyInArrow(judge, f"{CHUNK} int, range int, n int, flags binary")
    return rows.groupBy(CHUNK).cogroup(answers.groupBy(CHUNK)).applyInArrow(
        lambda left, right: rewrite(left, right) if left.num_rows else result.empty_table(), schema)
