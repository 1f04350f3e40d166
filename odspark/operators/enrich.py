"""Enrichment of a raw target-day OD table from a reference day (K1..K8).

Steps: normalise text -> vote a route id per route name -> attach standard
codes by (route id, seq) -> zero-pad ARS -> fill NULL codes by ARS, then
by stop name, then across ends.

Every lookup table is first reduced to one row per join key (so no join
can fan out) with a deterministic pick — the value on most rows, then the
smallest — where the original keeps "the first row in file order", which
a distributed table does not have. Keys are SQL keys: NULL never matches.

At scale the maps are small (routes x seqs, stops); each is staged before it
meets the rows, so its stored size decides on a broadcast before the target
table is shuffled. That table is scanned once per stage and never shuffled on
a hot key without AQE skew splitting available.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from functools import reduce

from pyspark.sql import functions as F

from odspark.functions.text import remove_quotes, strip, to_number, zfill
from odspark.session import cut_lineage

c = F.col

OUT_COLUMNS = ["service_date", "route_name", "route_id", "board_seq", "board_ars", "board_code",
               "board_name", "alight_seq", "alight_ars", "alight_code", "alight_name", "riders"]


def strip_column_names(df: DataFrame) -> DataFrame:
    """Trim header names."""
    return df.toDF(*[n.strip() for n in df.columns])


def normalise_target(df: DataFrame) -> DataFrame:
    """K1 (target day): names trimmed, quotes removed and values stripped
    in every column, numeric seq keys added."""
    df = strip_column_names(df)
    df = df.select(*[strip(remove_quotes(c(n))).alias(n) for n in df.columns])
    return (df.withColumn("board_seq_num", to_number("board_seq"))
              .withColumn("alight_seq_num", to_number("alight_seq")))


def normalise_reference(df: DataFrame) -> DataFrame:
    """K1 (reference day): values stripped, numeric seq keys added."""
    df = strip_column_names(df)
    df = df.select(*[strip(c(n)).alias(n) for n in df.columns])
    return (df.withColumn("board_seq_num", to_number("board_seq"))
              .withColumn("alight_seq_num", to_number("alight_seq")))


def _most_frequent(df: DataFrame, key: list, value: str, out: str) -> DataFrame:
    """One row per ``key``: the non-NULL ``value`` on most rows, then the
    smallest."""
    counts = df.where(c(value).isNotNull()).groupBy(*key, value).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*key).orderBy(c("_n").desc(), c(value).asc())
    return (counts.withColumn("_rn", F.row_number().over(w)).where(c("_rn") == 1)
            .select(*key, c(value).alias(out)))


def _match(left: DataFrame, right: DataFrame, key: list, how: str, null_keys: str) -> DataFrame:
    """Equi-join on ``key``; ``null_keys="match"`` also joins missing keys
    with each other (as data-frame merges do), ``"drop"`` does not (SQL)."""
    if null_keys not in ("drop", "match"):
        raise ValueError(f"null_keys: {null_keys}")
    if null_keys == "drop":
        return left.join(right, key, how)
    r = right.select(*[c(k).alias(f"_r_{k}") if k in key else c(k) for k in right.columns])
    cond = reduce(lambda x, y: x & y, [c(k).eqNullSafe(c(f"_r_{k}")) for k in key])
    return left.join(r, cond, how).drop(*[f"_r_{k}" for k in key])


# A pair is common when matching its routes directly would give more than so
# many rows for each route that has it.
COMMON = 64


def best_overlap(a: DataFrame, b: DataFrame, who: str, whom: str, elements: list, null_keys: str = "drop",
                 common: int = COMMON) -> DataFrame:
    """For every ``who`` of ``a`` the ``whom`` of ``b`` that shares the most
    distinct elements with it: (who, whom, matches); ties go to the smaller.

    Rare elements first: they are matched directly, which gives at most
    ``common`` rows for each row of the sides. The common ones of a ``who``, h in
    number, can lift a candidate by h at most, so only candidates within h of its
    best are counted over them. Only where the rare ones give the best no more
    than h can somebody without a rare match win; there the sets of common
    elements decide alone, and routes with equal sets count as one (the smallest
    name stands for them). So an element that all routes have does not pair them.

    NULL elements match each other only with ``null_keys="match"``; a NULL
    ``who`` or ``whom`` takes no part."""
    if null_keys not in ("drop", "match"):
        raise ValueError(f"null_keys: {null_keys}")

    def side(df, name):
        df = df.where(c(name).isNotNull())
        if null_keys == "drop":
            df = df.where(reduce(lambda x, y: x & y, [c(e).isNotNull() for e in elements]))
        return df.select(c(name), F.struct(*elements).alias("e")).distinct()  # NULL fields of structs are equal
    a, b = cut_lineage(side(a, who), "vote-left"), cut_lineage(side(b, whom), "vote-right")
    n_a, n_b = (df.groupBy("e").agg(F.count("*").alias(n)) for df, n in ((a, "na"), (b, "nb")))
    kinds = cut_lineage(n_a.join(n_b, "e").select(
        "e", (c("na") * c("nb") > common * (c("na") + c("nb"))).alias("common")), "vote-elements")
    many = kinds.where("common").select("e")
    if many.isEmpty():
        votes = a.join(b, "e").groupBy(who, whom).agg(F.count("*").alias("matches"))
    else:
        few = kinds.where(~c("common")).select("e")
        rare = cut_lineage(a.join(few, "e").join(b, "e").groupBy(who, whom).agg(F.count("*").alias("m")), "vote-rare")
        a_many, b_many = (cut_lineage(df.join(many, "e", "left_semi"), "vote-common") for df in (a, b))
        limits = cut_lineage(a_many.groupBy(who).agg(F.count("*").alias("h"))
                             .join(rare.groupBy(who).agg(F.max("m").alias("best")), who, "full")
                             .select(who, F.coalesce("h", F.lit(0)).alias("h"), F.coalesce("best", F.lit(0)).alias("best")),
                             "vote-limits")
        able = rare.join(limits, who).where(c("m") + c("h") >= c("best")).select(who, whom, "m")
        lifted = (able.join(a_many, who).join(b_many, [whom, "e"]).groupBy(who, whom).agg(F.count("*").alias("more")))
        votes = able.join(lifted, [who, whom], "left").select(
            who, whom, (c("m") + F.coalesce("more", F.lit(0))).alias("matches"))
        sets = lambda df, name: df.groupBy(name).agg(F.array_sort(F.collect_list("e")).alias("set"))
        open_ = sets(a_many.join(limits.where(c("h") >= c("best")), who, "left_semi"), who)
        kinds_a = cut_lineage(open_.withColumn("kind", F.sha2(F.to_json(F.struct("set")), 256)), "vote-sets")
        kinds_b = sets(b_many, whom).groupBy("set").agg(F.min(whom).alias(whom))
        shared = (kinds_a.select("kind", "set").distinct().select("kind", F.explode("set").alias("e"))
                  .join(kinds_b.select(whom, F.explode("set").alias("e")), "e")
                  .groupBy("kind", whom).agg(F.count("*").alias("matches")))
        first = shared.groupBy("kind").agg(_foremost(whom).alias("v")).select("kind", "v")
        alone = kinds_a.join(first, "kind").select(who, c(f"v.{whom}").alias(whom), (-c("v.less")).alias("matches"))
        votes = votes.unionByName(alone)
    return votes.groupBy(who).agg(_foremost(whom).alias("v")).select(
        who, c(f"v.{whom}").alias(whom), (-c("v.less")).alias("matches"))


def _foremost(name: str):
    """Aggregate: most matches, then the smallest name."""
    return F.min(F.struct((-c("matches")).alias("less"), c(name).alias(name)))


def route_vote(tgt: DataFrame, ref: DataFrame, null_keys: str = "drop") -> DataFrame:
    """K2: per route name, the reference route id sharing the most distinct
    (boarding stop name, seq) pairs; ties go to the smaller id."""
    return best_overlap(tgt, ref, "route_name", "route_id", ["board_name", "board_seq_num"], null_keys)


def route_name_vote(tgt: DataFrame, ref: DataFrame) -> DataFrame:
    """The vote turned round — per reference route id, the target route
    name sharing the most (stop name, seq) pairs; ties to the smaller name."""
    return best_overlap(ref, tgt, "route_id", "route_name", ["board_name", "board_seq_num"])


def attach_codes(tgt: DataFrame, ref: DataFrame, null_keys: str = "drop") -> DataFrame:
    """K3: route id by vote, then boarding / alighting standard codes by
    (route id, seq) from the reference day (whose 9-char ARS is the code).
    ``null_keys="match"``: a missing seq takes the code of the route's
    missing seq, as the original's merges do."""
    routes = cut_lineage(route_vote(tgt, ref, null_keys).drop("matches"), "route-ids")
    known = (lambda n: F.lit(True)) if null_keys == "match" else (lambda n: c(n).isNotNull())
    bmap = _most_frequent(ref.where(known("board_seq_num")),
                          ["route_id", "board_seq_num"], "board_ars", "board_code")
    amap = _most_frequent(ref.where(known("alight_seq_num")),
                          ["route_id", "alight_seq_num"], "alight_ars", "alight_code")
    out = tgt.join(routes, "route_name", "left")
    out = _match(out, cut_lineage(bmap, "board-map"), ["route_id", "board_seq_num"], "left", null_keys)
    return _match(out, cut_lineage(amap, "alight-map"), ["route_id", "alight_seq_num"], "left", null_keys)


def _mode_map(side: DataFrame, key: str, code: str) -> DataFrame:
    """Donor map from a weighted side table: per ``key`` the code on most
    rows (sum of ``n``), then the smallest."""
    sums = (side.where(c(key).isNotNull() & c(code).isNotNull())
            .groupBy(c(key).alias("_k"), c(code).alias("_v")).agg(F.sum("n").alias("_n")))
    w = Window.partitionBy("_k").orderBy(c("_n").desc(), c("_v").asc())
    return (sums.withColumn("_rn", F.row_number().over(w)).where(c("_rn") == 1)
            .select("_k", c("_v").alias("_fill")))


def _fill_within(side: DataFrame, key: str, code: str) -> DataFrame:
    """Fill ``code`` from the same side table by ``key`` with windows (no
    self-join, so the plan stays linear): the donor is the known code with
    the largest row weight for that key, then the smallest code."""
    known = c(key).isNotNull() & c(code).isNotNull()
    weight = F.when(known, F.sum(F.when(known, c("n"))).over(Window.partitionBy(key, code)))
    side = side.withColumn("_w", weight)
    best = (Window.partitionBy(key).orderBy(c("_w").desc_nulls_last(), c(code).asc_nulls_last())
            .rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    donor = F.first(F.when(c("_w").isNotNull(), c(code)), ignorenulls=True).over(best)
    return (side.withColumn(code, F.when(c(key).isNotNull(), F.coalesce(c(code), donor))
                            .otherwise(c(code))).drop("_w"))


def _fill(side: DataFrame, key: str, code: str, donors: DataFrame) -> DataFrame:
    return (side.join(donors, c(key) == c("_k"), "left")
            .withColumn(code, F.coalesce(c(code), c("_fill"))).drop("_k", "_fill"))


def fill_codes(df: DataFrame, fill_stages: int = 3) -> DataFrame:
    """K5..K7 on the enriched rows.

    A fill only looks at (ARS, name, code) of one end, so the cascade runs
    on two small side tables — the distinct (ARS, name, code) of each end
    weighted by their row counts — and the final codes are joined back to
    the rows whose code was NULL. The row table is read a fixed number of
    times whatever the number of stages; the plan no longer doubles per
    stage.
    """
    b_side = df.groupBy("board_ars", "board_name", "board_code").agg(F.count(F.lit(1)).alias("n"))
    a_side = df.groupBy("alight_ars", "alight_name", "alight_code").agg(F.count(F.lit(1)).alias("n"))
    b = b_side.withColumn("orig_code", c("board_code"))
    a = a_side.withColumn("orig_code", c("alight_code"))
    # stage 1: by ARS (donor maps from the same snapshot, each end its own)
    b = _fill_within(b, "board_ars", "board_code")
    a = _fill_within(a, "alight_ars", "alight_code")
    if fill_stages >= 2:  # by stop name; donors include the stage-1 fills
        b = _fill_within(b, "board_name", "board_code")
        a = _fill_within(a, "alight_name", "alight_code")
    if fill_stages >= 3:  # across ends: alighting first, then boarding from the updated alighting
        # the side tables are small (distinct stops x codes); materialised so
        # the two cross-end joins do not re-run each other's window chains
        b, a = cut_lineage(b), cut_lineage(a)
        a = _fill(a, "alight_ars", "alight_code", _mode_map(b, "board_ars", "board_code"))
        a = cut_lineage(a)
        b = _fill(b, "board_ars", "board_code", _mode_map(a, "alight_ars", "alight_code"))
    # only rows with a NULL code can change: they alone are joined back (on
    # the end's ARS and name, null-safe, to the side rows whose code was NULL);
    # fully coded rows pass through without a shuffle
    b = (b.where(c("orig_code").isNull())
         .select(c("board_ars").alias("_ba"), c("board_name").alias("_bn"),
                 c("board_code").alias("_board_code")))
    a = (a.where(c("orig_code").isNull())
         .select(c("alight_ars").alias("_aa"), c("alight_name").alias("_an"),
                 c("alight_code").alias("_alight_code")))
    b, a = cut_lineage(b, "board-fills"), cut_lineage(a, "alight-fills")
    known = df.where(c("board_code").isNotNull() & c("alight_code").isNotNull())
    need = df.where(c("board_code").isNull() | c("alight_code").isNull())
    out = (need.join(b, c("board_code").isNull() & c("board_ars").eqNullSafe(c("_ba"))
                     & c("board_name").eqNullSafe(c("_bn")), "left")
               .join(a, c("alight_code").isNull() & c("alight_ars").eqNullSafe(c("_aa"))
                     & c("alight_name").eqNullSafe(c("_an")), "left"))
    filled = (out.withColumn("board_code", F.coalesce(c("board_code"), c("_board_code")))
              .withColumn("alight_code", F.coalesce(c("alight_code"), c("_alight_code")))
              .select(*df.columns))
    return known.unionByName(filled)


def enrich_od(target_raw: DataFrame, reference_raw: DataFrame, fill_stages: int = 3,
              null_keys: str = "drop") -> DataFrame:
    """K1..K8. ``fill_stages``: 1 = by ARS, 2 = + by stop name,
    3 = + across ends (alighting from boarding first, then boarding from the
    updated alighting). Output: the 12 columns, all text."""
    tgt = normalise_target(target_raw)
    ref = normalise_reference(reference_raw)
    df = attach_codes(tgt, ref, null_keys)
    df = df.withColumn("board_ars", zfill("board_ars")).withColumn("alight_ars", zfill("alight_ars"))
    df = df.select(*[c(n).cast("string").alias(n) for n in OUT_COLUMNS])
    # staged once: the fill cascade reads these rows three times (two side
    # tables and the final join), so they are materialised instead of being
    # re-derived (vote, maps, joins) inside every consumer
    return fill_codes(cut_lineage(df), fill_stages)


def null_report(df: DataFrame) -> DataFrame:
    """Row count and NULL count per key column, one aggregate pass."""
    return df.agg(F.count(F.lit(1)).alias("total_rows"),
                  F.count_if(c("route_id").isNull()).alias("null_route_id"),
                  F.count_if(c("board_code").isNull()).alias("null_board_code"),
                  F.count_if(c("alight_code").isNull()).alias("null_alight_code"))
