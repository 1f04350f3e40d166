"""Data-quality corrections of the OD fact (all dates at once).

Spark has no row UPDATE: each step is one projection in which every SET
column is computed from the *old* row (``_update``), so copying four
boarding fields onto the alighting end can never read a half-updated row.
Row-local steps collapse into a single projection; steps that need a
per-key statistic (route max seq, seq mode, alighting-seq spread, next
stop) aggregate first — partial aggregation, no window over raw rows —
stage the small result and join it back, in the same scan, to the rows that
can change (``_beside``).

Every step adds a boolean tag column (``t_<step>``) so affected-row counts
come from one aggregate at the end instead of one job per step.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from odspark.constants import (BIDIRECTIONAL_MAX_SEQ, CASE_C1_SEQ_RANGE, CASE_C2_MAX_PCT,
                               CASE_C2_MIN_SEQ, EXEMPT_ARS, FIRST_FILL_YEAR_PREFIX, OD_COLUMNS,
                               SEQ_SPREAD_MAX, TERMINAL_VIRTUAL_CODE, VIRTUAL_ARS,
                               VIRTUAL_NAME_KEYWORDS)
from odspark.session import cut_lineage

ROUTE = ["service_date", "route_name"]
DEDUP_KEY = ["service_date", "route_name", "route_id", "board_seq", "board_ars", "board_name",
             "alight_seq", "alight_ars", "alight_name"]

BOARD4 = ["board_seq", "board_ars", "board_code", "board_name"]
ALIGHT4 = ["alight_seq", "alight_ars", "alight_code", "alight_name"]

c = F.col


def _update(df: DataFrame, tag: str | None, pred: Column, sets: dict) -> DataFrame:
    """``UPDATE df SET sets WHERE pred`` with simultaneous assignment.
    A NULL predicate is false, as in SQL."""
    hit = F.coalesce(pred, F.lit(False))
    cols = [F.when(hit, sets[n]).otherwise(c(n)).alias(n) if n in sets else c(n)
            for n in df.columns]
    if tag:
        cols.append(hit.alias(tag))
    return df.select(*cols)


# Rows that are no candidates are dealt to so many join keys of their own.
SPREAD = 1 << 14


def _staged_side(small: DataFrame, name: str) -> DataFrame:
    """The small side of ``_beside``: written first, so that its size is known
    when the join is planned. ``_deal`` is stored (a literal would be folded
    into the condition and leave the join key)."""
    return cut_lineage(small.withColumn("_deal", F.lit(0)), name)


def _beside(rows: DataFrame, candidates: Column, small: DataFrame, key: list, name: str | None = None) -> DataFrame:
    """``rows`` with the columns of ``small`` (one row per key) beside the
    candidates; the other rows, which cannot change, get NULLs.

    One scan and one left join: a row that is no candidate has NULL keys, so it
    matches nothing. While the staged ``small`` is below the broadcast limit the
    fact is not shuffled; beyond it both sides are plain shuffles, in which the
    candidates can be split at a hot key by Spark and the others, whatever
    share they have, are dealt evenly by a hash of the row. ``small`` comes
    from ``_staged_side`` unless ``name`` says how to stage it."""
    if name is not None:
        small = _staged_side(small, name)
    is_candidate = F.coalesce(candidates, F.lit(False))
    new = [n for n in small.columns if n not in key and n != "_deal"]
    even = F.pmod(F.xxhash64(*rows.columns), F.lit(SPREAD)).cast("int") + 1
    left = rows.select("*", F.when(is_candidate, 0).otherwise(even).alias("_own_deal"),
                       *[F.when(is_candidate, c(k)).alias(f"_key_{k}") for k in key])
    right = small.select("_deal", *[c(k).alias(f"_small_{k}") for k in key], *new)
    same = reduce(lambda x, y: x & y, [c(f"_key_{k}") == c(f"_small_{k}") for k in key], c("_own_deal") == c("_deal"))
    return left.join(right, same, "left").select(*rows.columns, *new)


def _most(n: str, *ties: str) -> Column:
    """Aggregate: the tie columns of the largest count, smallest ties first
    with NULLs last. A minimum combines on the map side; no window, no sort."""
    order = [x for t in ties for x in (c(t).isNull().alias(f"{t}_null"), c(t).alias(t))]
    return F.min(F.struct((-c(n)).alias("less"), *order))


def _virtual_name(col: str) -> Column:
    cond = None
    for kw in VIRTUAL_NAME_KEYWORDS:
        p = c(col).contains(kw)
        cond = p if cond is None else cond | p
    return cond


def od_only(df: DataFrame) -> DataFrame:
    return df.select(*OD_COLUMNS)


def tags(df: DataFrame) -> list[str]:
    return [n for n in df.columns if n.startswith("t_")]


# --------------------------------------------------------------------------
# Group 1: virtual stops
def c1_virtual_boarding_ars(df):
    pred = _virtual_name("board_name") & ((c("board_ars") != EXEMPT_ARS) | c("board_ars").isNull())
    return _update(df, "t_c1", pred, {"board_ars": F.lit(VIRTUAL_ARS)})


def c2_virtual_alighting_ars(df):
    pred = _virtual_name("alight_name") & ((c("alight_ars") != EXEMPT_ARS) | c("alight_ars").isNull())
    return _update(df, "t_c2", pred, {"alight_ars": F.lit(VIRTUAL_ARS)})


def c4_origin_virtual_seq(df):
    pred = (c("board_ars") == VIRTUAL_ARS) & c("board_seq").isNull()
    return _update(df, "t_c4", pred, {"board_seq": F.lit(0)})


def route_max_seq(df: DataFrame) -> DataFrame:
    """Per (date, route): max boarding seq (partial aggregation; tiny)."""
    return (df.where(c("board_seq").isNotNull()).groupBy(*ROUTE)
            .agg(F.max("board_seq").alias("route_max_seq")))


def c5_terminal_virtual_seq(df):
    """Cases A, C1, C2 (flag only: ``t_c5c2`` rows move to anomalies), B."""
    a = _update(df, "t_c5a",
                (c("board_seq") == 0) & (c("board_ars") == VIRTUAL_ARS)
                & (c("alight_ars") == VIRTUAL_ARS) & c("alight_seq").isNull(),
                {"alight_seq": F.lit(0)})
    lo, hi = CASE_C1_SEQ_RANGE
    c1 = _update(a, "t_c5c1",
                 (c("alight_ars") == VIRTUAL_ARS) & c("alight_seq").isNull()
                 & c("board_seq").between(lo, hi),
                 dict(zip(ALIGHT4, [c(x) for x in BOARD4])))
    # the route max is constant from here to case B: no step in between
    # changes board_seq, and C2 never removes the max row (its ratio is 100).
    # Only rows without an alighting seq at the virtual stop look at it.
    tail = (c("alight_ars") == VIRTUAL_ARS) & c("alight_seq").isNull()
    j = _beside(c1, tail, route_max_seq(c1), ROUTE, "route-max")
    c2 = j.withColumn("t_c5c2", F.coalesce(
        tail & (c("board_seq") * 100 < c("route_max_seq") * CASE_C2_MAX_PCT)
        & (c("board_seq") >= CASE_C2_MIN_SEQ), F.lit(False)))
    b = _update(c2, "t_c5b", ~c("t_c5c2") & tail & c("route_max_seq").isNotNull(),
                {"alight_seq": c("route_max_seq") + 1})
    return b.drop("route_max_seq")


def _alive(df) -> Column:
    return ~c("t_c5c2") if "t_c5c2" in df.columns else F.lit(True)


def c6_empty_terminal_name(df):
    pred = _alive(df) & (c("alight_name").isNull() | (c("alight_name") == "")) & (
        c("alight_code") == TERMINAL_VIRTUAL_CODE)
    return _update(df, "t_c6", pred, {"alight_name": c("board_name")})


def c7_virtual_alighting_to_self(df):
    pred = _alive(df) & (c("board_ars") != VIRTUAL_ARS) & (c("alight_ars") == VIRTUAL_ARS) & (
        c("alight_seq").isNotNull())
    return _update(df, "t_c7", pred, dict(zip(ALIGHT4, [c(x) for x in BOARD4])))


def c8_mid_virtual_boarding(df):
    pred = _alive(df) & (c("board_ars") == VIRTUAL_ARS) & (c("board_seq") != 0)
    return _update(df, "t_c8", pred, dict(zip(BOARD4, [c(x) for x in ALIGHT4])))


def c9_virtual_same_od(df):
    pred = _alive(df) & (c("board_ars") == VIRTUAL_ARS) & (c("alight_ars") == VIRTUAL_ARS) & (
        c("board_seq") == c("alight_seq"))
    return _update(df, "t_c9", pred, {"alight_seq": c("board_seq") + 1})


GROUP1_STEPS = [
    ("c1", c1_virtual_boarding_ars), ("c2", c2_virtual_alighting_ars),
    ("c4", c4_origin_virtual_seq), ("c5", c5_terminal_virtual_seq),
    ("c6", c6_empty_terminal_name), ("c7", c7_virtual_alighting_to_self),
    ("c8", c8_mid_virtual_boarding), ("c9", c9_virtual_same_od),
]


def group1_tagged(od: DataFrame, upto: str | None = None) -> DataFrame:
    """Group 1 steps (before dedup), tagged; ``t_c5c2`` marks anomalies."""
    df = od
    for name, fn in GROUP1_STEPS:
        df = fn(df)
        if name == upto:
            break
    return df


def fix_virtual_stop(od: DataFrame) -> DataFrame:
    """K9: group 1 steps, anomalies removed, then dedup."""
    df = group1_tagged(od)
    return dedup_sum(od_only(df.where(~c("t_c5c2"))))


def anomaly_rows(od: DataFrame) -> DataFrame:
    """C5c2: rows moved out of the fact (short trips to the terminal
    virtual stop that cannot be placed)."""
    df = group1_tagged(od, upto="c5")
    return od_only(df.where(c("t_c5c2")))


def detect_bidirectional(od: DataFrame) -> DataFrame:
    """Routes with a seq-0 virtual origin and a real max seq above 100."""
    big = (od.where(c("board_seq").isNotNull() & (c("board_ars") != VIRTUAL_ARS))
           .groupBy(*ROUTE).agg(F.max("board_seq").alias("m"))
           .where(c("m") > BIDIRECTIONAL_MAX_SEQ).select(*ROUTE))
    return (od.where((c("board_seq") == 0) & (c("board_ars") == VIRTUAL_ARS))
            .select(*ROUTE).distinct()
            .join(big, ROUTE, "left_semi"))


def residual_counts(df: DataFrame) -> DataFrame:
    """Rows each group-1 rule should have fixed, per date."""
    def vname(end):
        return _virtual_name(f"{end}_name") & (c(f"{end}_ars") != VIRTUAL_ARS) & (
            c(f"{end}_ars") != EXEMPT_ARS)
    return df.groupBy("service_date").agg(
        F.count_if(vname("board")).alias("unfixed_virtual_board_ars"),
        F.count_if(vname("alight")).alias("unfixed_virtual_alight_ars"),
        F.count_if((c("board_ars") == VIRTUAL_ARS) & c("board_seq").isNull()).alias(
            "null_board_seq"),
        F.count_if((c("alight_ars") == VIRTUAL_ARS) & c("alight_seq").isNull()).alias(
            "null_alight_seq"),
        F.count_if((c("alight_name").isNull() | (c("alight_name") == ""))
                   & (c("alight_code") == TERMINAL_VIRTUAL_CODE)).alias("empty_terminal_name"))


# --------------------------------------------------------------------------
# Group 2: sequences
def k10_seq_by_mode(df: DataFrame) -> DataFrame:
    """Rows whose boarding seq differs from the most frequent seq of their
    (date, route, boarding ARS) take it. Ties: smaller seq; a NULL mode
    updates nothing."""
    key = ROUTE + ["board_ars"]
    counts = (df.where(c("board_ars") != VIRTUAL_ARS)
              .groupBy(*key, "board_seq").agg(F.count(F.lit(1)).alias("n")))
    mode = counts.groupBy(*key).agg(_most("n", "board_seq").alias("m")).select(*key, c("m.board_seq").alias("mode_seq"))
    movable = (c("board_ars") != VIRTUAL_ARS) & c("board_seq").isNotNull()
    j = _beside(df, movable, mode, key, "seq-mode")
    return _update(j, "t_k10", c("board_seq") != c("mode_seq"),
                   {"board_seq": c("mode_seq")}).drop("mode_seq")


def k11_alight_seq_spread(df: DataFrame) -> DataFrame:
    """Per (date, route, board seq, board ARS, alight ARS), both real: when
    alighting seqs take 2+ values within a spread of 2, use the minimum.
    (count(distinct) > 1 is max > min, so no distinct aggregation.)"""
    key = ROUTE + ["board_seq", "board_ars", "alight_ars"]
    spread = (df.where((c("board_ars") != VIRTUAL_ARS) & (c("alight_ars") != VIRTUAL_ARS))
              .groupBy(*key).agg(F.min("alight_seq").alias("min_alight_seq"),
                                 F.max("alight_seq").alias("max_alight_seq"))
              .where((c("max_alight_seq") - c("min_alight_seq")).between(1, SEQ_SPREAD_MAX))
              .drop("max_alight_seq"))
    movable = ((c("board_ars") != VIRTUAL_ARS) & (c("alight_ars") != VIRTUAL_ARS)
               & c("board_seq").isNotNull() & c("alight_seq").isNotNull())
    j = _beside(df, movable, spread, key, "seq-spread")
    return _update(j, "t_k11", c("alight_seq") != c("min_alight_seq"),
                   {"alight_seq": c("min_alight_seq")}).drop("min_alight_seq")


def sequence_fixes(od: DataFrame) -> DataFrame:
    """K10 then K11 from one pre-aggregate (tagged ``t_k10``, ``t_k11``).

    K10 only rewrites ``board_seq``, so both the mode (K10) and the
    alighting-seq spread over K10's output (K11) follow from one aggregate
    per (date, route, board ARS, board seq, alight ARS) holding the row
    count and the min / max alighting seq: the seq of each group is mapped
    through the mode and the spreads are re-aggregated. The aggregate is
    staged, and so are mode and spread (see ``_beside``): every shuffle is
    map-side combined and none carries OD rows while they are small.
    """
    key = ROUTE + ["board_ars"]
    g = cut_lineage(od.where(c("board_ars") != VIRTUAL_ARS)
                    .groupBy(*key, "board_seq", "alight_ars")
                    .agg(F.count(F.lit(1)).alias("n"), F.min("alight_seq").alias("lo"),
                         F.max("alight_seq").alias("hi")), "seq-groups")
    counts = g.groupBy(*key, "board_seq").agg(F.sum("n").alias("n"))
    mode = _staged_side(counts.groupBy(*key).agg(_most("n", "board_seq").alias("m"))
                        .select(*key, c("m.board_seq").alias("mode_seq")), "seq-mode")
    moved = F.coalesce(c("board_seq") != c("mode_seq"), F.lit(False))
    spread = (g.where(c("alight_ars") != VIRTUAL_ARS).join(mode, key, "left")
              .withColumn("board_seq", F.when(moved, c("mode_seq")).otherwise(c("board_seq")))
              .groupBy(*key, "board_seq", "alight_ars")
              .agg(F.min("lo").alias("min_alight_seq"), F.max("hi").alias("max_alight_seq"))
              .where((c("max_alight_seq") - c("min_alight_seq")).between(1, SEQ_SPREAD_MAX))
              .drop("max_alight_seq"))
    movable = (c("board_ars") != VIRTUAL_ARS) & c("board_seq").isNotNull()
    k10 = _update(_beside(od, movable, mode, key), "t_k10", c("board_seq") != c("mode_seq"),
                  {"board_seq": c("mode_seq")}).drop("mode_seq")
    both = movable & (c("alight_ars") != VIRTUAL_ARS) & c("alight_seq").isNotNull()
    j = _beside(k10, both, spread, key + ["board_seq", "alight_ars"], "seq-spread")
    return _update(j, "t_k11", c("alight_seq") != c("min_alight_seq"),
                   {"alight_seq": c("min_alight_seq")}).drop("min_alight_seq")


def fix_sequence(od: DataFrame) -> DataFrame:
    """K11g: K10, K11, dedup."""
    return dedup_sum(od_only(sequence_fixes(od)))


# --------------------------------------------------------------------------
# Group 3: same boarding and alighting stop
def k12a_same_stop_by_seq(df):
    pred = (c("board_seq") == c("alight_seq")) & (c("board_ars") == c("alight_ars")) & (
        c("board_ars") != VIRTUAL_ARS)
    return _update(df, "t_k12a", pred, {"alight_seq": c("board_seq") + 1})


def next_stop_donors(df: DataFrame) -> DataFrame:
    """Per (date, route, boarding seq): the boarding stop seen there — most
    rows first, then the smallest (ARS, code, name)."""
    key = ROUTE + ["board_seq"]
    counts = (df.where(c("board_seq").isNotNull())
              .groupBy(*key, "board_ars", "board_code", "board_name")
              .agg(F.count(F.lit(1)).alias("n")))
    best = counts.groupBy(*key).agg(_most("n", "board_ars", "board_code", "board_name").alias("m"))
    return best.select(*ROUTE, c("board_seq").alias("next_seq"), c("m.board_ars").alias("next_ars"),
                       c("m.board_code").alias("next_code"), c("m.board_name").alias("next_name"),
                       F.lit(True).alias("has_next"))


def k12b_same_stop_by_ars(df: DataFrame) -> DataFrame:
    """Equal ARS at both ends (virtual included) and a stop at seq+1 on the
    same route and date: alight there. Rows with different ARS pass by."""
    same = c("board_ars") == c("alight_ars")
    rows = df.withColumn("next_seq", c("board_seq") + 1)
    j = _beside(rows, same, next_stop_donors(df), ROUTE + ["next_seq"], "next-stop")
    out = _update(j, "t_k12b", same & c("has_next"),
                  {"alight_seq": c("next_seq"), "alight_ars": c("next_ars"),
                   "alight_code": c("next_code"), "alight_name": c("next_name")})
    return out.drop("next_seq", "next_ars", "next_code", "next_name", "has_next")


def fix_same_stop_od(od: DataFrame) -> DataFrame:
    """K12g: K12a, K12b, dedup."""
    return dedup_sum(od_only(k12b_same_stop_by_ars(k12a_same_stop_by_seq(od))))


# --------------------------------------------------------------------------
# K14 dedup
def dedup_sum(od: DataFrame) -> DataFrame:
    """Collapse duplicate OD rows: null-safe key of date, route, route id,
    boarding seq/ARS/name, alighting seq/ARS/name; riders summed; the
    smallest non-null codes kept. Total riders are unchanged.

    Two aggregates: first a hash aggregate on key + both codes (collapses
    exact duplicates, and a hot key, map-side), then the per-key minimum of
    the codes. ``min`` over text needs a sort-based aggregate; running it on
    the collapsed rows instead of the raw ones halves the cost.
    """
    return _smallest_codes(od.groupBy(*DEDUP_KEY, "board_code", "alight_code")
                           .agg(F.sum("riders").alias("riders")))


def _smallest_codes(pre: DataFrame) -> DataFrame:
    return (pre.groupBy(*DEDUP_KEY)
            .agg(F.min("board_code").alias("board_code"), F.min("alight_code").alias("alight_code"),
                 F.sum("riders").cast("int").alias("riders"))
            .select(*OD_COLUMNS))


# Copies of one row are made in steps of so many.
COPIES = 10_000


class FoldedGroup1:
    """The rows of ``group1_tagged``, folded by dedup's first aggregate: a row
    per dedup key, codes and tags (bits of ``_tags``) with riders ``riders`` and
    ``_n`` rows; anomalies also per ``_own``, the riders of each. Nothing is
    lost: step counts, anomalies and the deduplicated rest follow from the
    folded rows, so the rows need not be stored before they meet the shuffle."""

    def __init__(self, tagged: DataFrame):
        self.tags = tags(tagged)
        bits = [F.when(c(t), 1 << i).otherwise(0) for i, t in enumerate(self.tags)]
        self.rows = (tagged.withColumn("_tags", reduce(lambda x, y: x + y, bits))
                     .withColumn("_own", F.when(c("t_c5c2"), c("riders")))
                     .groupBy(*DEDUP_KEY, "board_code", "alight_code", "_tags", "_own")
                     .agg(F.sum("riders").alias("riders"), F.count(F.lit(1)).alias("_n")))

    def _has(self, tag: str) -> Column:
        return c("_tags").bitwiseAND(1 << self.tags.index(tag)) != 0

    def counts(self) -> DataFrame:
        """Affected rows per step and date."""
        return self.rows.groupBy("service_date").agg(
            *[F.sum(F.when(self._has(t), c("_n")).otherwise(0)).alias(t[2:]) for t in self.tags])

    def anomalies(self) -> DataFrame:
        """The rows taken out, each as often as it came."""
        steps = F.explode(F.sequence(F.lit(1), c("_n"), F.lit(COPIES)))
        copies = F.explode(F.sequence(c("_from"), F.least(c("_n"), c("_from") + (COPIES - 1))))
        return od_only(self.rows.where(self._has("t_c5c2")).withColumn("_from", steps).withColumn("_copy", copies)
                       .withColumn("riders", c("_own")))

    def dedup(self) -> DataFrame:
        """``dedup_sum`` of the rows that stay."""
        return _smallest_codes(self.rows.where(~self._has("t_c5c2")))


def duplicate_groups(od: DataFrame) -> DataFrame:
    """Returned count of dedup: groups with more than one row, per date."""
    return (od.groupBy(*DEDUP_KEY).agg(F.count(F.lit(1)).alias("n")).where(c("n") > 1)
            .groupBy("service_date").agg(F.count(F.lit(1)).alias("duplicate_groups")))


# --------------------------------------------------------------------------
# Fill NULL standard codes from other dates
def fill_null_codes(od: DataFrame, end: str = "board") -> DataFrame:
    """Stage 1: donors from dates starting with 2025 (the date itself
    included); stage 2, for codes still NULL: donors from any other date.
    Donor per ARS = the code on most rows, then the smallest. Donors come
    from the input snapshot, so the result does not depend on date order."""
    ars, code = f"{end}_ars", f"{end}_code"
    donors = (od.where(c(code).isNotNull() & c(ars).isNotNull())
              .groupBy(c(ars).alias("ars"), "service_date", c(code).alias("code"))
              .agg(F.count(F.lit(1)).alias("n")))
    by_code = donors.groupBy("ars", "code").agg(
        F.sum("n").alias("n"), F.sum(F.when(c("service_date").startswith(FIRST_FILL_YEAR_PREFIX), c("n"))).alias("n1"))
    # the codes of every ARS in order of preference over all dates
    place = F.row_number().over(Window.partitionBy("ars").orderBy(c("n").desc(), c("code").asc())) - 1
    ranking = cut_lineage(by_code.select("ars", "code", "n", "n1", place.alias("place")), "code-ranking")
    s1 = (ranking.where(c("n1").isNotNull()).groupBy("ars").agg(_most("n1", "code").alias("m"))
          .select("ars", c("m.code").alias("code1")))
    targets = (od.where(c(code).isNull() & c(ars).isNotNull())
               .select("service_date", c(ars).alias("ars")).distinct())
    # A date's own rows lower the counts of its own codes only. So its best donor
    # is the best of its own codes, lowered, or the first place of the ranking
    # that none of its own codes has: behind the run 0, 1, 2, ... of own places.
    own = (donors.withColumnRenamed("n", "own").join(targets, ["service_date", "ars"], "left_semi")
           .join(ranking, ["ars", "code"]))
    nth = F.row_number().over(Window.partitionBy("service_date", "ars").orderBy("place")) - 1
    lowered = F.struct((c("own") - c("n")).alias("less"), "code")
    walked = (own.withColumn("nth", nth).groupBy("service_date", "ars")
              .agg(F.count_if(c("place") == c("nth")).alias("first"),
                   F.min(F.when(c("n") > c("own"), lowered)).alias("mine")))
    free = ranking.select("ars", c("place").alias("first"), F.struct((-c("n")).alias("less"), "code").alias("other"))
    s2 = (targets.join(walked, ["service_date", "ars"], "left")
          .withColumn("first", F.coalesce("first", F.lit(0)).cast("int")).join(free, ["ars", "first"], "left")
          .select("service_date", "ars", F.when(c("mine") < c("other"), c("mine")).otherwise(
              F.coalesce("other", "mine"))["code"].alias("code2")))
    # only rows with an ARS and no code can be filled: the others pass through
    # untouched (no shuffle), and each half's filter reaches the scan; the
    # donors are staged, so their size is known when the join is planned
    wanted = c(code).isNull() & c(ars).isNotNull()
    both = (targets.join(s1, "ars", "left").join(s2, ["service_date", "ars"], "left")
            .select("service_date", c("ars").alias(ars), F.coalesce("code1", "code2").alias("_code"))
            .where(c("_code").isNotNull()))
    known = od.where(~wanted).select(*OD_COLUMNS)
    filled = (od.where(wanted).drop(code).join(cut_lineage(both, "code-donors"), ["service_date", ars], "left")
              .withColumnRenamed("_code", code).select(*OD_COLUMNS))
    return known.unionByName(filled)


# --------------------------------------------------------------------------
# Targeted code update (batch form)
def apply_code_updates(od: DataFrame, updates: DataFrame, end: str = "board") -> DataFrame:
    """``updates`` (service_date, route_name, board_ars, alight_ars, code):
    matching rows get that ``{end}_code`` (the smallest when a key repeats)."""
    key = ["service_date", "route_name", "board_ars", "alight_ars"]
    u = updates.where(c("code").isNotNull()).groupBy(*key).agg(F.min("code").alias("_code"))
    j = _beside(od, reduce(lambda x, y: x & y, [c(k).isNotNull() for k in key]), u, key, "code-updates")
    code = f"{end}_code"
    return j.select(*[F.coalesce(c("_code"), c(code)).alias(code) if n == code else c(n)
                      for n in OD_COLUMNS])


# --------------------------------------------------------------------------
# The nightly chain
def correct_pipeline(od: DataFrame, cut=None) -> DataFrame:
    """Group 1 -> group 2 -> group 3, each ending in dedup. ``cut`` (e.g.
    ``session.cut_lineage``) is applied at each group boundary so the plan
    does not grow with every aggregate-and-join step."""
    cut = cut or (lambda d: d)
    g1 = cut(fix_virtual_stop(od))
    g2 = cut(fix_sequence(g1))
    return fix_same_stop_od(g2)
