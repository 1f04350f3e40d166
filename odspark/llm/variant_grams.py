"""Spelling variants of words by a variable-length gram index.

1. Words and their counts come from one pass over the texts.
2. Gram dictionary, pruned by frequency: all grams of SHORTEST code points; a
   gram on more than PRUNE word places is too frequent and gives way to its
   extensions by one code point, up to LONGEST. Only the frequent grams have to
   be known to decompose a word: at most 90**2 + 90**3 texts of 2 or 3 code
   points, since a word has 90 different ones; that is the broadcast's bound.
3. A word's decomposition has, at every place, the shortest gram that is not
   frequent (the longest in the dictionary). Such a gram depends on its own code
   points alone, so an edit changes only grams that cover its place.
4. Affected-gram bound: the largest number of a word's grams that cover one
   place (at most LONGEST). All grams but so many survive one edit; words of six
   code points and more always keep one.
5. Lists: of a word's grams in order of frequency, the bound plus one rarest are
   its probes: two near words share one. As one edit leaves everything on the
   one or on the other side of a shared gram alone, a probe's list is named by
   the whole beginning up to the gram's end, or the whole rest from its start.
   Lists are merged by a self-join whose condition holds the count bound and the
   exact check, so only near pairs leave it.
6. A list with over MAX_LIST words is not merged pair by pair: its words meet
   under their one-deletion variants, of which one is reached by at most
   90 * length + 1 words. This covers the rest exactly; nothing is capped.

Near words differ by exactly one inserted, deleted or replaced code point; a
word's form is its near word of largest count (ties: smallest in code-point
order) if that count is FACTOR times the word's; the root follows forms to the
last. Counts grow by FACTOR along forms, so pointer jumping ends after about
log2(log5(largest count)) rounds.

Defined results: null and empty texts have no words; a null id is written as
nothing in front of the colon that the run's checksum covers; repeated rows count
again; a very long text is cut into runs in one task; a text without spaces is
one long word; an empty table gives an empty result; only the id and the text
are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from odspark.llm.staging import staged

MIN_LENGTH, MIN_COUNT = 6, 5
SLIP = 199
FACTOR = 5
SHORTEST, LONGEST = 2, 4
PRUNE = 64
MAX_LIST = 256
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def word_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = MIN_COUNT) -> DataFrame:
    """(word, n) of the words of MIN_LENGTH code points and more. A run whose
    checksum with its document's id is a multiple of SLIP loses one code point."""
    long_runs = F.regexp_extract_all(F.col(text).cast("string"), F.lit(f"([A-Za-zÀ-ÿ]{{{MIN_LENGTH},}})"), F.lit(1))
    runs = (docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("_id"), F.explode(long_runs).alias("_run"))
            .select("_id", F.translate("_run", _UPPER, _LOWER).alias("run")))
    h = F.crc32(F.concat("_id", F.lit(":"), "run"))
    at = F.pmod("h", F.length("run").cast("long")).cast("int")
    slipped = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))
    words = runs.select("run", h.alias("h")).select(
        F.when(F.col("h") % SLIP == 0, slipped).otherwise(F.col("run")).alias("word"))
    return (words.groupBy("word").agg(F.count("*").alias("n"))
            .where((F.length("word") >= MIN_LENGTH) & (F.col("n") >= least)))


def _piece(at: Column, size: int) -> Column:
    """The gram of ``size`` code points at ``at`` (from 0); null if the word ends before."""
    return F.when(at + size <= F.length("word"), F.substr("word", at + 1, F.lit(size)))


def frequent_grams(words: DataFrame, prune: int = PRUNE) -> DataFrame:
    """Grams of SHORTEST to LONGEST - 1 code points on more than ``prune`` word places."""
    places = words.select("word", F.explode(F.sequence(F.lit(0), F.length("word") - SHORTEST)).alias("p"))
    grams = places.select(F.explode(F.array(*[_piece(F.col("p"), q) for q in range(SHORTEST, LONGEST)])).alias("gram"))
    return grams.where("gram is not null").groupBy("gram").count().where(F.col("count") > prune).select("gram")


def decomposed(words: DataFrame, prune: int = PRUNE) -> DataFrame:
    """Staged (word, p, gram): the variable-length gram at every place of every word."""
    frequent = staged(frequent_grams(words, prune), "frequent-grams")
    rows = words.select("word", F.explode(F.sequence(F.lit(0), F.length("word") - SHORTEST)).alias("p"))
    gram, open_ = _piece(F.col("p"), SHORTEST), F.lit(True)
    for q in range(SHORTEST, LONGEST):
        name = f"f{q}"
        # bounded by the alphabet: see the module's text
        known = F.broadcast(frequent.where(F.length("gram") == q).select(F.col("gram").alias(name)))
        rows = rows.join(known, _piece(F.col("p"), q) == F.col(name), "left")
        open_ &= F.col(name).isNotNull()
        gram = F.when(open_, F.coalesce(_piece(F.col("p"), q + 1), gram)).otherwise(gram)
    return staged(rows.select("word", "p", gram.alias("gram")), "word-grams")


def index(words: DataFrame, prune: int = PRUNE) -> DataFrame:
    """Staged rows per word: grams from the left and from the right, the number
    that survives any edit, and the names of the lists its probes stand in."""
    grams = decomposed(words, prune)
    used = staged(grams.groupBy("gram").agg(F.count("*").alias("c")), "gram-dictionary")
    own = (grams.join(used, "gram").groupBy("word")
           .agg(F.array_sort(F.collect_list(F.struct("c", "gram", "p"))).alias("grams")))
    covering = F.transform(F.sequence(F.lit(0), F.length("word") - 1), lambda i: F.size(F.filter(
        F.col("grams"), lambda g: (g["p"] <= i) & (i < g["p"] + F.length(g["gram"])))))
    bounded = own.withColumn("affected", F.array_max(covering))
    lists = F.flatten(F.transform(F.slice("grams", F.lit(1), F.col("affected") + 1), lambda g: F.array(
        F.concat(F.lit("<"), F.substr("word", F.lit(1), g["p"] + F.length(g["gram"]))),
        F.concat(F.lit(">"), F.substr("word", g["p"] + 1)))))
    left = F.transform("grams", lambda g: F.concat_ws(":", g["p"], g["gram"]))
    right = F.transform("grams", lambda g: F.concat_ws(":", F.length("word") - g["p"], g["gram"]))
    return staged(bounded.select("word", left.alias("left"), right.alias("right"),
                                 (F.size("grams") - F.col("affected")).alias("surviving"),
                                 F.array_distinct(lists).alias("lists")), "gram-index")


def _near(a: str, b: str) -> Column:
    return F.expr(f"abs(length({a}) - length({b})) <= 1") & F.expr(f"levenshtein({a}, {b}, 1) = 1")


def near_pairs(words: DataFrame, prune: int = PRUNE, max_list: int = MAX_LIST) -> DataFrame:
    """Staged pairs (a, b), a < b, of words at distance one."""
    rows = index(words, prune)
    entries = staged(rows.select("word", "left", "right", "surviving", F.explode("lists").alias("list")), "gram-lists")
    sizes = staged(entries.groupBy("list").agg(F.count("*").alias("c")).where("c > 1")
                   .select("list", (F.col("c") > max_list).alias("long")), "list-sizes")
    short = entries.join(sizes.where(~F.col("long")), "list").drop("long")
    side = lambda c: short.select("list", *[F.col(x).alias(f"{x}_{c}") for x in ("word", "left", "right", "surviving")])
    shared = F.size(F.array_intersect("left_a", "left_b")) + F.size(F.array_intersect("right_a", "right_b"))
    merged = (side("a").join(side("b").withColumnRenamed("list", "_list"), (F.col("list") == F.col("_list"))
                             & (F.col("word_a") < F.col("word_b"))
                             & (F.expr("abs(length(word_a) - length(word_b)) <= 1"))
                             & (shared >= F.greatest("surviving_a", "surviving_b"))
                             & _near("word_a", "word_b"))
              .select(F.col("word_a").alias("a"), F.col("word_b").alias("b")))
    crowded = entries.join(sizes.where("long"), "list", "left_semi").select("word").distinct()
    cut = F.transform(F.sequence(F.lit(1), F.length("word")), lambda i: F.concat(
        F.substr("word", F.lit(1), i - 1), F.substr("word", i + 1)))
    variants = staged(crowded.select("word", F.explode(F.array_distinct(F.concat(F.array("word"), cut))).alias("variant")),
                      "word-variants")
    met = (variants.withColumnRenamed("word", "a").join(
        variants.select(F.col("word").alias("b"), F.col("variant").alias("_v")),
        (F.col("variant") == F.col("_v")) & (F.col("a") < F.col("b")) & _near("a", "b")).select("a", "b"))
    return staged(merged.union(met).distinct(), "near-words")


def group_variants(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = MIN_COUNT,
                   factor: int = FACTOR, prune: int = PRUNE, max_list: int = MAX_LIST) -> DataFrame:
    """One row per word: word, n, n_near, form, form_n, root."""
    words = staged(word_counts(docs, key, text, least), "words")
    pairs = near_pairs(words, prune, max_list)
    both = pairs.union(pairs.select("b", "a"))
    counted = both.join(words.select(F.col("word").alias("b"), F.col("n").alias("n_b")), "b")
    best = counted.groupBy(F.col("a").alias("word")).agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("n_b")).alias("minus"), F.col("b").alias("name"))).alias("best"))
    near = staged(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(-F.col("best.minus") >= factor * F.col("n"), F.col("best")).alias("best"))
        .select("word", "n", "n_near", F.col("best.name").alias("form"), (-F.col("best.minus")).alias("form_n")), "forms")
    reach = near.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        on = reach.select(F.col("word").alias("_w"), F.col("root").alias("_next"))
        reach = staged(reach.join(on, F.col("root") == F.col("_w"), "left")
                       .select("word", F.coalesce("_next", "root").alias("root"), F.col("_w").isNotNull().alias("moved")), "roots")
        if reach.where("moved").isEmpty():
            break
        reach = reach.select("word", "root")
    return near.join(reach.select("word", F.col("root").alias("_root")), "word", "left").select(
        "word", "form", F.coalesce("_root", "word").alias("root"), "n", "n_near", "form_n")
