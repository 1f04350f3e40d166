"""Benchmark decontamination by SimHash over item-sized windows.

A document is contaminated by a benchmark item when one of its windows of as
many words as the item (the whole document if it is shorter) has a weighted
shingle similarity of at least 75 percent with it: shingles are five words (the
whole item when it is shorter), weighted by how often they occur, and the
similarity is the sum of smaller weights over the sum of larger ones.

1. Windows that share no shingle with any item have similarity 0. So documents
   are first matched shingle by shingle with the items; a document goes on only
   if it holds enough of an item's shingles anywhere. Every match gives a
   window: the item laid so that the two shingles coincide, moved inside the
   document. Matches that follow one another in document and item lay one
   window; only the first of such a run lays it and carries its shingle hashes.
   So a match is one row per document shingle and item, even where both
   repeat one word, and the texts are read once and never shuffled.
2. Each window gets a 64-bit SimHash of its weighted shingles.
3. Multi-index blocks: fingerprints within ``radius`` bits agree in at least one
   of ``radius + 1`` blocks (pigeonhole), so an equi-join on blocks finds every
   such pair; the pairs are then cut to the radius. At similarity 0.75 the
   fingerprints differ in 11 bits on average with a standard deviation of 3;
   the radius of 26 leaves out about two in a million when every shingle
   weighs 1, and step 5 judges those again. A heavier shingle swings all bits at once, so pairs whose item or
   window repeats a shingle skip the blocks and go to step 4.
4. The exact similarity of the remaining pairs decides.
5. An item whose parts stand in another order has its best window between the
   laid ones. So pairs of step 1 that no laid window confirms are judged at
   every window start, exactly and in one pass over their matches
   (``sliding_best``). The verdict is that of all windows; the window shown is
   the best laid one, or the best of all when no laid one verifies.

Only DataFrame functions are used. The table of item shingles is broadcast
after its rows are counted (MAX_BROADCAST); beyond that it is shuffled.

Defined results: null, empty and blank texts hold no shingles and are never
contaminated; items without words match nothing; repeated documents are judged
alike, repeated items give a row each; empty tables give an empty result; only
keys and texts are read, so further columns cannot clash.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from odspark.llm.staging import staged

SHINGLE, PERCENT, RADIUS = 5, 75, 26
BITS = 64
MAX_BROADCAST = 2_000_000
_SPACE = " \t\n\x0b\f\r"


def words_of(text: Column) -> Column:
    plain = F.btrim(F.lower(text), F.lit(_SPACE))
    return F.when(F.length(plain) > 0, F.split(plain, "[ \\t\\n\\x0b\\f\\r]+")).otherwise(F.array().cast("array<string>"))


def _with_shingles(rows: DataFrame, k: int) -> DataFrame:
    """rows(…, wh array<long>) with sh: the hash of each k-word sequence by its start."""
    n = F.size("wh") - (k - 1)
    follow = lambda x, i: F.xxhash64(x, *[F.get(F.col("wh"), i + c) for c in range(1, k)])
    return rows.withColumn("sh", F.when(n > 0, F.transform(F.slice("wh", 1, F.greatest(n, F.lit(0))), follow))
                           .otherwise(F.array().cast("array<bigint>")))


def _word_hashes(rows: DataFrame, text: str) -> DataFrame:
    words = rows.withColumn("wh", words_of(F.col(text))).drop(text)
    return words.withColumn("wh", F.transform("wh", lambda w: F.xxhash64(w)))


def _row_id(key: str, text: str) -> Column:
    return F.xxhash64(F.col(key).cast("string"), F.col(text)).alias("row")


def item_shingles(items: DataFrame, key: str, text: str, shingle: int) -> DataFrame:
    """(item, n, k, j, h, prev): every shingle of every item; n words, size k, start j,
    prev the shingle that starts a word before (null: none)."""
    base = _word_hashes(items.select(F.col(key).alias("item"), F.col(text).alias("_text")), "_text").where(
        F.size("wh") > 0).withColumn("item_row", F.monotonically_increasing_id())
    base = staged(base, "items")
    out = None
    for k in range(1, shingle + 1):
        mine = base.where(F.size("wh") >= k if k == shingle else F.size("wh") == k)
        part = (_with_shingles(mine, k).select("item_row", "item", F.size("wh").alias("n"), F.lit(k).alias("k"), "sh",
                                               F.posexplode("sh").alias("j", "h"))
                .withColumn("prev", F.get("sh", F.col("j") - 1)).drop("sh"))
        out = part if out is None else out.unionByName(part)
    return staged(out, "item-shingles")


def simhash(h: Column, weight: Column) -> list[Column]:
    """One signed sum per bit: aggregates over the weighted shingles of a window."""
    return [F.sum(F.when(F.shiftright(h, b).bitwiseAND(F.lit(1)) == 1, weight).otherwise(-weight)).alias(f"b{b}")
            for b in range(BITS)]


def fingerprint() -> Column:
    return reduce(lambda a, b: a.bitwiseOR(b),
                  [F.when(F.col(f"b{b}") > 0, F.shiftleft(F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long"))
                   for b in range(BITS)])


def blocks(fp: Column, radius: int) -> Column:
    """radius + 1 disjoint bit ranges of a fingerprint as (block, bits)."""
    cuts = [BITS * i // (radius + 1) for i in range(radius + 2)]
    return F.explode(F.array(*[
        F.struct(F.lit(i).alias("block"), F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << (b - a)) - 1)).alias("bits"))
        for i, (a, b) in enumerate(zip(cuts, cuts[1:]))])).alias("_b")


def sliding_best(matches: DataFrame, weights: DataFrame, small) -> DataFrame:
    """The window of most common weight, and its lowest start, over all window starts of each pair.

    matches(row, _key, item_row, k, i, h, words, width). A shingle at i counts in
    the windows that hold it but not as many equal ones before it as the item has:
    an interval of starts. So the common weight by start is a running sum over the
    interval ends, which rises at interval starts only."""
    pair = ["row", "_key", "item_row", "k", "words", "width"]
    seen = (matches.groupBy(*pair, "h").agg(F.sort_array(F.collect_set("i")).alias("at"))
            .join(small(weights), ["item_row", "h"]))
    first = lambda i, x: F.greatest(F.lit(0), i - (F.col("width") - F.col("k")),
                                    F.coalesce(F.get("at", x - F.col("w").cast("int")) + 1, F.lit(0)))
    spans = seen.select(*pair, F.explode(F.transform("at", lambda i, x: F.struct(first(i, x).alias("a"), i.alias("b")))).alias("s"))
    steps = (spans.select(*pair, F.explode(F.array(F.struct(F.col("s.a").alias("at"), F.lit(1).alias("d")),
                                                   F.struct((F.col("s.b") + 1).alias("at"), F.lit(-1).alias("d")))).alias("e"))
             .groupBy(*pair, F.col("e.at").alias("start")).agg(F.sum("e.d").alias("d")))
    common = F.sum("d").over(Window.partitionBy(*pair).orderBy("start").rowsBetween(Window.unboundedPreceding, 0))
    return (steps.withColumn("n_common", common).where(F.col("start") <= F.col("words") - F.col("width"))
            .groupBy(*pair).agg(F.max(F.struct("n_common", (-F.col("start")).alias("p"))).alias("m"))
            .select("row", "_key", "item_row", (-F.col("m.p")).alias("start"), "width",
                    (F.col("width") - (F.col("k") - 1)).cast("long").alias("size"), F.col("m.n_common").alias("n_common")))


def contaminated(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text",
                 item_key: str = "item_id", item_text: str = "text", shingle: int = SHINGLE,
                 percent: int = PERCENT, radius: int = RADIUS) -> DataFrame:
    """(row, doc_id, item_id, item_row, window_start, window_words, n_common, n_union):
    the best window of each contaminated document and item."""
    table = item_shingles(items, item_key, item_text, shingle)
    sizes = [r["k"] for r in table.select("k").distinct().collect()]  # at most `shingle` values
    # one row per item and distinct shingle, with all its places in the item
    lookup = table.groupBy("item_row", "n", "k", "h").agg(F.collect_list(F.struct("j", "prev")).alias("at"))
    bounded = table.count() <= MAX_BROADCAST
    small = F.broadcast if bounded else (lambda d: d)
    texts = docs.select(_row_id(key, text), F.col(key).alias("_key"), F.col(text).alias("_text"))
    base = _word_hashes(texts, "_text")
    width = F.least("n", "words")
    place_of = lambda j: F.least(F.greatest(F.col("i") - j, F.lit(0)), F.col("words") - width)
    opens = F.filter("at", lambda a: a["prev"].isNull() | F.col("before").isNull() | (a["prev"] != F.col("before")))
    hits = None
    for k in sizes:
        own = lookup.where(F.col("k") == k).drop("k")
        # the outer form: Spark would else filter on the array's size, and evaluate it twice for that
        part = (_with_shingles(base, k)
                .select("row", "_key", "sh", F.size("wh").alias("words"), F.posexplode_outer("sh").alias("i", "h"))
                .withColumn("before", F.get("sh", F.col("i") - 1)))
        body = lambda j: F.slice("sh", place_of(j) + 1, width - (k - 1)) if bounded else F.lit(None).cast("array<bigint>")
        lays = F.transform(opens, lambda a: F.struct(place_of(a["j"]).alias("start"), body(a["j"]).alias("body")))
        part = (part if bounded else part.drop("sh")).join(small(own), "h").select(
            "row", "_key", "item_row", F.lit(k).alias("k"), "i", "h", "words", width.alias("width"), lays.alias("lays"))
        hits = part if hits is None else hits.unionByName(part)
    if hits is None:
        hits = docs.sparkSession.createDataFrame(
            [], f"row long, _key {docs.schema[key].dataType.simpleString()}, item_row long, k int, i int, h long, "
                "words int, width int, lays array<struct<start int, body array<long>>>")
    hits = staged(hits, "hits")

    # an item's weight by shingle, and its total
    weights = table.groupBy("item_row", "h").agg(F.count("*").alias("w"))
    totals = table.groupBy("item_row").agg(F.count("*").alias("total"))
    # common weight of the whole document with the item bounds that of any window
    held = (hits.groupBy("row", "item_row", "h").agg(F.countDistinct("i").alias("c"))
            .join(small(weights), ["item_row", "h"])
            .groupBy("row", "item_row").agg(F.sum(F.least("c", "w")).alias("common"))
            .join(small(totals), "item_row").where(100 * F.col("common") >= percent * F.col("total"))
            .select("row", "item_row"))
    place = ["row", "k", "start", "width"]
    held_hits = staged(hits.join(held, ["row", "item_row"]), "held-hits")
    laid_at = held_hits.select("row", "_key", "item_row", "k", "width", F.explode("lays").alias("l")).select(
        "row", "_key", "item_row", "k", "l.start", "width", "l.body")
    windows = laid_at.select("row", "_key", "item_row", *place[1:]).distinct()

    # shingles of the windows: brought along by the hits, or read again
    if bounded or not sizes:
        parts = laid_at.dropDuplicates(place).select(*place, F.explode_outer("body").alias("h"))
    else:
        per_row = windows.groupBy("row").agg(F.collect_set(F.struct("k", "start", "width")).alias("ws"))
        again = _word_hashes(texts.join(per_row.hint("merge"), "row").dropDuplicates(["row"]), "_text")
        parts = None
        for k in sizes:
            part = (_with_shingles(again, k).select("row", "sh", F.explode("ws").alias("w")).where(F.col("w.k") == k)
                    .select("row", "w.*", F.explode_outer(
                        F.slice("sh", F.col("w.start") + 1, F.col("w.width") - (k - 1))).alias("h")))
            parts = part if parts is None else parts.unionByName(part)
    counts = staged(parts.groupBy(*place, "h").agg(F.count("*").alias("c")), "window-shingles")
    window_fp = (counts.groupBy("row", "k", "start", "width")
                 .agg(*simhash(F.col("h"), F.col("c")), F.sum("c").alias("size"), F.max("c").alias("top"))
                 .select("row", "k", "start", "width", "size", (F.col("top") > 1).alias("heavy"), fingerprint().alias("fp")))
    item_fp = (weights.groupBy("item_row").agg(*simhash(F.col("h"), F.col("w")), F.max("w").alias("top"))
               .select("item_row", (F.col("top") > 1).alias("item_heavy"), fingerprint().alias("item_fp")))

    # multi-index Hamming join: equal block, then the distance
    pairs = windows.join(window_fp, place).join(small(item_fp.select("item_row", "item_heavy")), "item_row")
    unit = ~F.col("heavy") & ~F.col("item_heavy")
    shown = ["row", "_key", "item_row", "k", "start", "width", "size"]
    left = (pairs.where(unit)
            .select("row", "_key", "item_row", "k", "start", "width", "size", "fp", blocks(F.col("fp"), radius))
            .select("*", "_b.*").drop("_b"))
    right = (item_fp.select("item_row", "item_fp", blocks(F.col("item_fp"), radius))
             .select("*", "_b.*").drop("_b"))
    near = (left.join(right, ["item_row", "block", "bits"])
            .where(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= radius)
            .select(*shown).distinct()
            .unionByName(pairs.where(~unit).select(*shown)))

    # exact weighted similarity of the pairs that are left
    verified = lambda pairs: (pairs.join(small(totals), "item_row")
                              .withColumn("n_union", F.col("size") + F.col("total") - F.col("n_common"))
                              .where(100 * F.col("n_common") >= percent * F.col("n_union")).drop("total"))
    laid = staged(verified(near.join(counts, place).join(small(weights), ["item_row", "h"])
                           .groupBy("row", "_key", "item_row", "start", "width", "size")
                           .agg(F.sum(F.least("c", "w")).alias("n_common"))), "laid")

    # every window start of the pairs that no laid window confirms
    rest = held_hits.select("row", "_key", "item_row", "k", "i", "h", "words", "width").join(
        laid.select("row", "item_row").distinct(), ["row", "item_row"], "left_anti")
    exact = laid.unionByName(verified(sliding_best(rest, weights, small)))
    rank = F.struct((F.col("n_common") / F.col("n_union")).alias("s"), (-F.col("start")).alias("p"))
    best = exact.groupBy("row", "_key", "item_row").agg(F.max_by(F.struct("start", "width", "n_common", "n_union"), rank).alias("b"))
    ids = table.select("item_row", F.col("item").alias(item_key)).distinct()
    return (best.join(ids, "item_row")
            .select("row", F.col("_key").alias(key), item_key, "item_row", F.col("b.start").alias("window_start"),
                    F.col("b.width").alias("window_words"), "b.n_common", "b.n_union"))


def clean_documents(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents that no item contaminates, all columns kept."""
    bad = contaminated(docs, items, key, text, **options).select("row").distinct()
    return docs.withColumn("row#", _row_id(key, text)).join(bad.withColumnRenamed("row", "row#"), "row#", "left_anti").drop("row#")
