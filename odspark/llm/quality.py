"""Quality rules: text statistics and cross-document line frequency.

Per text: word and symbol counts, repeated lines, words in repeated three-word
windows. Across documents: lines are normalised (A-Z lower-cased, digits and
outer white space dropped, inner white space runs as one space), hashed, and
for every host the number of documents with the line is counted; exact copies
of one text count as one document, so a copied page does not outlaw its own
lines. A line above the host's limit is removed from all its documents; a
document left with too small a share of its words is rejected.

The text is read once to make a small staged table (counts and line hashes);
frequencies come from that table: distinct (host, line, text) triples, then a
count per (host, line) with partial aggregation, so a line in a third of all
documents is one row per task. Lines are matched back by a join in which the
frequent lines are the small side; a hot line is a skewed join key that Spark
can split. ``clean_documents`` joins the removal lists back to the texts.

Defined results: null and empty texts have no words and fail the base rule; a
null host is a host of its own; repeated rows are judged row by row (rows are
told apart by an internal number); an empty table gives an empty result;
further columns are neither read nor clash (``clean_documents`` keeps them).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from odspark.llm import rolling as R
from odspark.llm.staging import staged

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
# A line is removed from a host when more than both of these hold it.
LINE_MIN_DOCS = 25
LINE_MAX_SHARE = 0.2
# A document that keeps less than this share of its words is rejected.
MIN_KEPT_SHARE = 0.3

_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True

STATS = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
         "lines array<long>, line_words array<int>")


def _normal_lines(data, s, e, w0, w1) -> np.ndarray:
    """Hashes of normalised lines, line i holding the words [w0[i], w1[i])."""
    keep = ~_DIGIT[data]
    moved = np.concatenate(([0], np.cumsum(keep)))
    a, b = moved[s], moved[e]
    left = b > a  # a word of digits only leaves nothing
    h = R.word_hashes(R.lower_ascii(data)[keep], a[left], b[left])
    nth = np.concatenate(([0], np.cumsum(left)))
    return R.run_hashes(h, nth[w0], nth[w1])


def line_hashes(lines: list[str]) -> np.ndarray:
    """Normalised hash of each given line."""
    data, off = R.text_bytes(pa.array(lines, pa.large_string()))
    s, e, _ = R.words(data, off)
    return _normal_lines(data, s, e, np.searchsorted(s, off[:-1]), np.searchsorted(s, off[1:])).view(np.int64)


def _slice_stats(data: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    R.drop_memos()
    n = len(off) - 1
    s, e, doc = R.words(data, off)
    h = R.byte_prefix(data)
    wh = R.span_hashes(data, h, s, e)
    cum = lambda mask: np.concatenate(([0], np.cumsum(mask)))
    heads = cum((data & 0xC0) != 0x80)
    symbols = cum(_SYMBOLS[data])
    # three-word windows: equal hashes within one document
    win, at = R.windows(wh, doc, 3)
    key = R.mix(win + doc[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) if len(at) else win
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    repeated = R.covered(at[twice], 3, len(wh))

    # \n-split lines with a word
    nl = np.flatnonzero(data == 10)
    ls = np.sort(np.concatenate((off[:-1], nl + 1)))
    ldoc = np.searchsorted(off, ls, "right") - 1
    # a line break as the last byte opens an empty line of its own document;
    # it has no word, so its owner does not matter
    ends = np.concatenate((nl, off[1:]))
    le = np.sort(ends)
    ldoc = np.minimum(ldoc, n - 1)
    w0, w1 = np.searchsorted(s, ls, "left"), np.searchsorted(s, le, "left")
    full = np.flatnonzero(w1 > w0)
    ls, le, w0, w1, ldoc = ls[full], le[full], w0[full], w1[full], ldoc[full]
    raw = R.span_hashes(data, h, ls, le)
    pair = np.unique(np.stack((ldoc.astype(np.uint64), raw), 1), axis=0) if len(raw) else np.empty((0, 2), np.uint64)
    distinct = np.bincount(pair[:, 0].astype(np.int64), minlength=n)

    line = _normal_lines(data, s, e, w0, w1)
    words = w1 - w0
    if len(line):
        order = np.lexsort((line, ldoc))
        line, ldoc_s, words = line[order], ldoc[order], words[order]
        first = np.ones(len(line), bool)
        first[1:] = (line[1:] != line[:-1]) | (ldoc_s[1:] != ldoc_s[:-1])
        starts = np.flatnonzero(first)
        words = np.add.reduceat(words, starts)
        line, ldoc_s = line[starts], ldoc_s[starts]
    else:
        ldoc_s = ldoc
    per_doc = np.concatenate(([0], np.cumsum(np.bincount(ldoc_s, minlength=n))))
    return {
        "n_words": np.bincount(doc, minlength=n),
        "word_chars": R.sums_by_doc(heads[e] - heads[s], doc, n),
        "n_symbols": symbols[off[1:]] - symbols[off[:-1]],
        "n_dup_lines": np.bincount(ldoc, minlength=n) - distinct,
        "n_repeat_words": R.sums_by_doc(repeated, doc, n),
        "line_off": per_doc, "lines": line.view(np.int64), "line_words": words,
    }


def text_stats(docs: DataFrame, key: str = "doc_id", host: str = "source", text: str = "text") -> DataFrame:
    """Row number, key, host, text fingerprint, base counts and the distinct line hashes of each text."""
    def run(batches):
        for b in batches:
            data, off = R.text_bytes(b.column(4))
            for i, j in R.slices(off):
                st = _slice_stats(data[off[i]:off[j]], off[i:j + 1] - off[i])
                lo = pa.array(st["line_off"], pa.int32())
                cols = [c.slice(i, j - i) for c in b.columns[:4]]
                cols += [pa.array(st[c], pa.int64()) for c in
                         ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
                cols += [pa.ListArray.from_arrays(lo, pa.array(st["lines"], pa.int64())),
                         pa.ListArray.from_arrays(lo, pa.array(st["line_words"], pa.int32()))]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    rows = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(key).alias("_key"),
                       F.col(host).cast("string").alias("_host"), F.xxhash64(text).alias("text_hash"),
                       F.col(text).cast("string").alias("_text"))
    schema = (f"_row long, _key {rows.schema['_key'].dataType.simpleString()}, _host string, "
              f"text_hash long, {STATS}")
    names = [c.strip().split(" ")[0] for c in schema.split(",")]
    return rows.mapInArrow(run, schema)


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < MIN_WORDS) | (100 * n_repeat_words > MAX_REPEAT_PERCENT * n_words)


def frequent_lines(stats: DataFrame, min_docs: int = LINE_MIN_DOCS, max_share: float = LINE_MAX_SHARE) -> DataFrame:
    """(host, line, n_docs) of the lines above the limit of their host."""
    host = F.coalesce(F.concat(F.lit("="), F.col("_host")), F.lit("")).alias("host")
    copies = stats.select(host, "text_hash", "lines")
    per_host = copies.groupBy("host", "text_hash").agg(F.lit(1)).groupBy("host").agg(F.count("*").alias("host_docs"))
    lines = (copies.select("host", "text_hash", F.explode("lines").alias("line")).distinct()
             .groupBy("host", "line").agg(F.count("*").alias("n_docs")).where(F.col("n_docs") > min_docs))
    return (lines.join(per_host, "host").where(F.col("n_docs") > max_share * F.col("host_docs"))
            .select("host", "line", "n_docs"))


def judge_documents(docs: DataFrame, key: str = "doc_id", host: str = "source", text: str = "text",
                    min_docs: int = LINE_MIN_DOCS, max_share: float = LINE_MAX_SHARE,
                    min_kept_share: float = MIN_KEPT_SHARE) -> DataFrame:
    """One row per document: base counts, removed words and lines, and the verdict.

    ``removed_lines`` holds the hashes of the lines that go (null: none)."""
    stats = staged(text_stats(docs, key, host, text), "quality-stats")
    frequent = staged(frequent_lines(stats, min_docs, max_share), "quality-lines")
    host_key = F.coalesce(F.concat(F.lit("="), F.col("_host")), F.lit("")).alias("host")
    held = stats.select("_row", host_key, F.explode(F.arrays_zip("lines", "line_words")).alias("l"))
    hit = (held.select("_row", "host", F.col("l.lines").alias("line"), F.col("l.line_words").alias("words"))
           .join(frequent, ["host", "line"])
           .groupBy("_row").agg(F.sum("words").alias("removed"), F.collect_list("line").alias("removed_lines")))
    failed = base_failed(F.col("n_words"), F.col("n_repeat_words"))
    removed = F.coalesce("removed", F.lit(0)).cast("long")
    return (stats.drop("lines", "line_words").join(hit, "_row", "left")
            .select("_row", F.col("_key").alias(key), F.col("_host").alias(host), "text_hash", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                    "n_repeat_words", removed.alias("n_line_words_removed"), "removed_lines",
                    failed.alias("base_failed"),
                    (~failed & (F.col("n_words") - removed >= min_kept_share * F.col("n_words"))).alias("kept")))


def clean_documents(docs: DataFrame, key: str = "doc_id", host: str = "source", text: str = "text",
                    **limits) -> DataFrame:
    """The kept documents with all their columns, without the lines above the limits."""
    verdict = (judge_documents(docs, key, host, text, **limits).where("kept")
               .groupBy(F.col(key).alias("_k"), F.col(host).alias("_h"), F.col("text_hash").alias("_x"))
               .agg(F.first("removed_lines").alias("_gone")))  # equal rows have equal verdicts
    d = docs.withColumn("_t", F.xxhash64(text))
    joined = d.join(verdict, d[key].eqNullSafe(F.col("_k")) & d[host].cast("string").eqNullSafe(F.col("_h"))
                    & (F.col("_t") == F.col("_x"))).select(*docs.columns, "_gone")

    def run(batches):
        for b in batches:
            gone = b.column(b.num_columns - 1)
            at = b.schema.get_field_index(text)
            if gone.null_count < len(gone):
                new = [_without(t, set(g)) if g else t
                       for t, g in zip(b.column(at).to_pylist(), gone.to_pylist())]
                b = b.set_column(at, b.schema.field(at), pa.array(new, b.schema.field(at).type))
            yield b.select(list(range(b.num_columns - 1)))

    return joined.mapInArrow(run, docs.schema)


def _without(text: str, gone: set[int]) -> str:
    lines = text.split("\n")
    return "\n".join(x for x, h in zip(lines, line_hashes(lines).tolist()) if h not in gone or not x.strip())
