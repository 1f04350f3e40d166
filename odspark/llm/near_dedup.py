"""Near-duplicate components by MinHash bands and odd sketches.

A text's set holds its distinct five-word shingles (A-Z lower-cased; the whole
sequence when it is shorter). Two texts are linked when 100 * intersection >=
75 * union; components of links are the groups.

1. One pass over the texts makes a small row per document: set size, a
   128-bit digest of the whole set, 32 band keys of four MinHash values each, and an odd sketch:
   the MinHash samples are folded into a parity bitmap, so the bits in which
   two sketches differ estimate how many samples differ. A pair at similarity
   0.75 shares no band with probability 5e-6.
2. Documents with equal sets (size and digest) are one class, which gets a
   number of its own; the rest works on classes.
3. A bucket is a band key with two classes or more; its hub is the smallest
   class. All classes of a bucket stand under its hub, so every candidate
   pair meets in the group of some hub, once per hub instead of per band.
4. Groups are dealt to tasks in blocks bounded in classes and shingles (a group
   of any size is a triangle of block pairs). Inside a block, sketches select pairs whose
   estimate is not below the limit by more than their error; these are
   verified on the full sets, and only a spanning set of links leaves the
   task: a row per class, never a row per pair.
5. Connected components over the links.

Defined results: null, empty and blank texts have an empty set and are their
own component; repeated rows are classes of equal sets; a null id counts as
smaller than all others (component_id null); an empty table gives an empty
result; only the key and the text are read, so other columns cannot clash.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from odspark.llm import rolling as R
from odspark.llm.chunked import ROW, SMALLEST, _key
from odspark.llm.components import components
from odspark.llm.staging import staged

SHINGLE, PERCENT = 5, 75
BANDS, ROWS = 32, 4
SAMPLES = BANDS * ROWS
SKETCH_BITS = 256
# Pairs estimated this far below the limit are still verified: MARGIN for the
# error of 128 samples at a similarity of 0.75, FOLDING for that of their parity
# bits. A true link at 0.75 is lost with 1.9e-6 (4.4e-4 without FOLDING).
MARGIN = 0.2
FOLDING = 0.1
# Of one block's two sides: at most so many classes and, on average, shingles.
BLOCK = 2048
BLOCK_SHINGLES = 1 << 20
# The digest of a set, in two halves.
SET = ["set_a", "set_b"]
_BATCH_BYTES = 4 << 20

_rng = np.random.Generator(np.random.PCG64(5))
_MUL = _rng.integers(0, 1 << 31, SAMPLES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_ADD = _rng.integers(0, 1 << 32, SAMPLES, dtype=np.uint32)


def shingle_sets(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, shingle hash) of all distinct shingles, in order of document and hash."""
    R.drop_memos()
    data = R.lower_ascii(data)
    s, e, doc = R.words(data, off)
    wh = R.word_hashes(data, s, e)
    h, at = R.windows(wh, doc, SHINGLE)
    n = np.bincount(doc, minlength=len(off) - 1)
    d = doc[at]
    short = np.flatnonzero((n > 0) & (n < SHINGLE))
    if len(short):
        first = np.searchsorted(doc, short)
        whole = R.run_hashes(wh, first, first + n[short])
        h, d = np.concatenate((h, whole)), np.concatenate((d, short))
    order = np.argsort(h, kind="stable")
    order = order[np.argsort(d[order].astype(np.int32), kind="stable")]
    h, d = h[order], d[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    return d[new], h[new]


def signatures(d: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """MinHash samples (n x SAMPLES) and odd sketches (n x words); rows of empty sets are zero."""
    mins = np.zeros((n, SAMPLES), np.uint32)
    sketch = np.zeros((n, SKETCH_BITS // 64), np.uint64)
    if not len(d):
        return mins, sketch
    first = np.flatnonzero(np.concatenate(([True], d[1:] != d[:-1])))
    rows = d[first]
    x = (h >> np.uint64(32)).astype(np.uint32)
    for i in range(SAMPLES):
        mins[rows, i] = np.minimum.reduceat(x * _MUL[i] + _ADD[i], first)
    bit = R.mix(mins.astype(np.uint64) + (np.arange(SAMPLES, dtype=np.uint64) << np.uint64(32))) % np.uint64(SKETCH_BITS)
    for i in range(SAMPLES):
        b = bit[rows, i]
        sketch[rows, (b >> np.uint64(6)).astype(np.int64)] ^= np.uint64(1) << (b & np.uint64(63))
    return mins, sketch


def estimate(differing: np.ndarray) -> np.ndarray:
    """Similarity from the number of differing sketch bits."""
    left = np.maximum(1 - 2 * differing / SKETCH_BITS, 1e-9)
    return 1 + SKETCH_BITS / (4 * SAMPLES) * np.log(left)


def document_rows(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One small row per document: id, row fingerprint, set size and digest, sketch, bands."""
    def run(batches):
        for b in batches:
            data, off = R.text_bytes(b.column(2))
            for i, j in R.slices(off):
                n = j - i
                d, h = shingle_sets(data[off[i]:off[j]], off[i:j + 1] - off[i])
                size = np.bincount(d, minlength=n)
                ends = np.cumsum(size)
                # the shingles of a set are in order, so equal sets have equal bytes
                whole = np.frombuffer(b"".join(blake2b(h[z - c:z], digest_size=16).digest()
                                               for z, c in zip(ends.tolist(), size.tolist())), "<i8").reshape(n, 2)
                mins, sketch = signatures(d, h, n)
                bands = np.zeros((n, BANDS), np.uint64)
                for k in range(BANDS):
                    v = np.full(n, k + 1, np.uint64)
                    for c in range(ROWS):
                        v = R.mix(v + mins[:, k * ROWS + c])
                    bands[:, k] = v
                lists = lambda m: pa.ListArray.from_arrays(
                    pa.array(np.arange(n + 1, dtype=np.int32) * m.shape[1]), pa.array(m.reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, n), b.column(1).slice(i, n), pa.array(size.astype(np.int64)),
                     pa.array(whole[:, 0]), pa.array(whole[:, 1]), lists(sketch), lists(bands)],
                    names=["_doc", ROW, "n_shingles", *SET, "sketch", "bands"])

    rows = docs.select(_key(key).alias("_doc"), F.xxhash64(_key(key), text).alias(ROW), F.col(text).alias("_text"))
    return rows.mapInArrow(run, f"_doc long, {ROW} long, n_shingles long, {SET[0]} long, {SET[1]} long, "
                                "sketch array<long>, bands array<long>")


def _links(nodes: np.ndarray, sets: list[np.ndarray], sketch: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """A spanning set of the verified links among one block's classes."""
    m = len(nodes)
    size = np.array([len(s) for s in sets])
    root = np.arange(m)

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    links, index = [], None
    for i in range(m - 1):
        j = np.arange(i + 1, m)
        differ = np.bitwise_count(sketch[i] ^ sketch[j]).sum(axis=1)
        ok = (estimate(differ) >= percent / 100 - MARGIN - FOLDING) & (
            100 * np.minimum(size[i], size[j]) >= percent * np.maximum(size[i], size[j]))
        j = j[ok]
        mine = find(i)
        j = j[[find(x) != mine for x in j]]
        if not len(j):
            continue
        if len(j) == 1:
            both = np.array([len(np.intersect1d(sets[i], sets[j[0]], assume_unique=True))])
        else:
            if index is None:  # all sets of the block, for lookups of one set in many
                flat, ends = np.concatenate(sets), np.cumsum(size)
                index = np.concatenate(([0], ends))
            here = sets[i]
            both = np.empty(len(j), np.int64)
            for a in range(0, len(j), 256):
                part = j[a:a + 256]
                joined = np.concatenate([flat[index[x]:index[x + 1]] for x in part])
                at = np.minimum(np.searchsorted(here, joined), len(here) - 1)
                both[a:a + 256] = np.add.reduceat(here[at] == joined, np.cumsum(size[part]) - size[part])
        union = size[i] + size[j] - both
        for x in j[100 * both >= percent * union]:
            r = find(x)
            if r != find(i):
                root[r] = find(i)
                links.append((int(nodes[i]), int(nodes[x])))
    return links


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT,
                    block: int = BLOCK) -> DataFrame:
    """One row per document: key, n_shingles, component_id, kept."""
    rows = staged(document_rows(docs, key, text), "near-rows")
    full = rows.where("n_shingles > 0")
    # the numbers are fixed by the write: each committed partition has a range of its own
    classes = staged(full.groupBy(*SET).agg(F.min("_doc").alias("least"),
                                            F.min_by(F.struct(ROW, "bands", "n_shingles"), "_doc").alias("one"))
                     .select(F.monotonically_increasing_id().alias("node"), *SET, "least", f"one.{ROW}", "one.bands",
                             "one.n_shingles"), "near-classes")
    member = classes.select("node", "n_shingles", F.explode("bands").alias("band"))
    buckets = (member.groupBy("band").agg(F.count("*").alias("c"), F.min("node").alias("hub"))
               .where("c > 1").select("band", "hub"))
    under = staged(member.join(buckets, "band").select("hub", "node", "n_shingles").distinct(), "near-groups")
    parts = staged(under.groupBy("hub").agg(F.ceil(F.greatest(
        F.count("*") / F.lit(block), F.sum("n_shingles") / F.lit(BLOCK_SHINGLES))).cast("int").alias("parts")), "near-parts")
    mine = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    placed = (under.join(parts, "hub").select("hub", "node", mine.alias("p"), "parts")
              .select("hub", "node", "p", other.alias("q"))
              .select("node", F.xxhash64("hub", F.least("p", "q"), F.greatest("p", "q")).alias("block")))
    wanted = (placed.groupBy("node").agg(F.collect_list("block").alias("blocks"))
              .join(classes.select("node", ROW), "node").select(F.col(ROW).alias("_r"), "node", "blocks"))

    def sets(batches):
        for b in batches:
            data, off = R.text_bytes(b.column(0))
            for i, j in R.slices(off):
                n = j - i
                d, h = shingle_sets(data[off[i]:off[j]], off[i:j + 1] - off[i])
                _, sketch = signatures(d, h, n)
                ends = np.cumsum(np.bincount(d, minlength=n))
                out = []
                for k, (node, blocks) in enumerate(zip(b.column(1).slice(i, n).to_pylist(),
                                                       b.column(2).slice(i, n).to_pylist())):
                    s = h[ends[k - 1] if k else 0:ends[k]].tobytes()
                    out += [(x, node, s, sketch[k].tobytes()) for x in blocks]
                size = np.cumsum([len(x[2]) + 64 for x in out], dtype=np.int64)
                cuts = np.flatnonzero(np.diff(size // _BATCH_BYTES)) + 1
                for a, z in zip([0, *cuts], [*cuts, len(out)] if out else []):
                    cols = list(zip(*out[a:z]))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.binary(), pa.binary()))],
                        names=["block", "node", "members", "sketch"])

    texts = docs.select(F.xxhash64(_key(key), text).alias("_r"), F.col(text).alias("_text"))
    shipped = (texts.join(wanted, "_r").select("_text", "node", "blocks")
               .mapInArrow(sets, "block long, node long, members binary, sketch binary"))

    def verify(table: pa.Table) -> pa.Table:
        block_of = table.column("block").to_numpy()
        node = table.column("node").to_numpy()
        order = np.lexsort((node, block_of))
        new = np.ones(len(order), bool)
        new[1:] = (block_of[order][1:] != block_of[order][:-1]) | (node[order][1:] != node[order][:-1])
        order = order[new]  # equal rows of one document arrive twice
        starts = np.flatnonzero(np.concatenate(([True], block_of[order][1:] != block_of[order][:-1])))
        members, sketch = table.column("members"), table.column("sketch")
        links = []
        for a, b in zip(starts, np.append(starts[1:], len(order))):
            at = order[a:b]
            if len(at) > 1:
                links += _links(node[at], [np.frombuffer(members[int(x)].as_buffer(), np.uint64) for x in at],
                                np.stack([np.frombuffer(sketch[int(x)].as_buffer(), np.uint64) for x in at]), percent)
        return pa.table({"a": pa.array([x[0] for x in links], pa.int64()),
                         "b": pa.array([x[1] for x in links], pa.int64())})

    tasks = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    links = (shipped.withColumn("task", F.pmod(F.xxhash64("block"), F.lit(tasks)))
             .groupBy("task").applyInArrow(verify, "a long, b long"))
    group = components(links)
    roots = group.join(classes.select("node", "least"), "node").groupBy("component").agg(
        F.min("least").alias("component_id"))
    named = group.join(roots, "component").select("node", "component_id")
    out = rows.join(classes.select(*SET, "node", "least"), SET, "left").join(named, "node", "left")
    own = F.when(F.col("n_shingles") == 0, F.col("_doc")).otherwise(F.coalesce("component_id", "least"))
    shown = lambda c: F.when(c != F.lit(SMALLEST), c)
    return out.select(shown(F.col("_doc")).alias(key), "n_shingles", shown(own).alias("component_id"),
                      (F.col("_doc") == own).alias("kept"), F.col(ROW).alias("row"))


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", **limits) -> DataFrame:
    """The documents without near-duplicates of smaller id, all columns kept; of equal rows one stays."""
    judged = staged(near_duplicates(docs, key, text, **limits), "near-judged")
    kept = judged.where("kept").groupBy(F.col("row").alias("_r")).agg(F.count("*").alias("_c"))
    rows = docs.withColumn("_r", F.xxhash64(_key(key), text)).join(kept.select("_r"), "_r", "left_semi")
    if not kept.where("_c > 1").isEmpty():
        rows = rows.dropDuplicates(["_r"])
    return rows.drop("_r")
