"""Merkle manifest of a dataset by a nested-struct rollup.

Leaves are hashed where their rows are, ranked within their group, and rolled
up in bounded blocks: a block holds 2**BITS consecutive ranks, its rank digits
(bits) are grouped away one after another, and each grouping nests the child
structs {h, kids} in their parent and hashes it. Rows are dealt by (group, block)
once, so no grouping of a block shuffles. The blocks' hashes are the next
round's nodes, whose rank is the block number, until every group has one.

Proofs go the other way: a nested transform over a block carries the siblings
on the way down to each node, and one explode emits them, without a join inside
a block. One row cannot hold the whole dataset, so blocks of one round take the
part of the proof above them by a join on (group, block): a row per block.

A step of a proof is {h, left}: the sibling's hash (null where a run has one
node) and the side it stands on. ``folded`` recomputes a root from a leaf.

Ranks come from a range partitioning by group, order columns and a row number:
a group with a third of all rows, or equal rows, is cut like any other. Only
the number of rows per (group, range partition) is summed up to give offsets.

Defined results: null fields are hashed as "-"; null ids come first, null groups
are a group of their own and come first; rows with equal ids are ordered by leaf
hash, so equal rows are leaves of their own side by side; an empty table gives
an empty manifest (no root); other columns are not read. Very long texts are
hashed in their task and never shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from odspark.llm.staging import staged

BITS = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_STEPS = "array<struct<h:string,left:boolean>>"
_INDEX = (1 << 33) - 1


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def _field(value: Column) -> Column:
    s = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf_hash(values: list[Column]) -> Column:
    """H of the fields, each with its size in front."""
    return digest(*[_field(v) for v in values])


def folded(leaf: Column, steps: Column) -> Column:
    """The root that a leaf and the steps above it give."""
    def up(h, s):
        other = F.coalesce(s["h"], F.lit(""))
        return F.when(s["left"], digest(other, h)).otherwise(digest(h, other))
    return F.aggregate(steps, leaf, up)


@dataclass
class Tree:
    blocks: list[DataFrame]  # by round: g, n, block, node
    roots: DataFrame  # g, h


def ranked(nodes: DataFrame, order: list[str]) -> DataFrame:
    """Staged nodes (g, h, leaf) with their rank in group g and the group's size n."""
    keys = ["g", *order, "h", "_row"]
    rows = staged(nodes.withColumn("_row", F.monotonically_increasing_id())
                  .repartitionByRange(*keys).sortWithinPartitions(*keys)
                  .select("g", "h", "leaf", F.spark_partition_id().alias("part"),
                          F.monotonically_increasing_id().bitwiseAND(F.lit(_INDEX)).alias("at")), "merkle-sorted")
    counts = rows.groupBy("g", "part").agg(F.count("*").alias("c"), F.min("at").alias("first"))
    group = Window.partitionBy("g")
    before = F.sum("c").over(group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = staged(counts.select(F.col("g").alias("_g"), F.col("part").alias("_p"), F.sum("c").over(group).alias("n"),
                                   (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift")), "merkle-offsets")
    return (rows.join(offsets, F.col("g").eqNullSafe(F.col("_g")) & (F.col("part") == F.col("_p")))
            .select("g", "n", (F.col("at") + F.col("shift")).alias("rank"), "h", "leaf"))


def roll_up(nodes: DataFrame, bits: int) -> DataFrame:
    """One round: blocks of ``nodes`` (g, n, rank, h, leaf) as nested nodes."""
    digit = lambda i: F.shiftright("rank", i).bitwiseAND(F.lit(1)).cast("int").alias(f"d{i}")
    block = F.shiftright("rank", bits).alias("block")
    level = (nodes.select("g", "n", block, *[digit(i) for i in range(bits)], F.struct("h", "leaf").alias("node"))
             .repartition("g", "block"))
    for i in range(bits):
        runs = level.groupBy("g", "n", "block", *[f"d{k}" for k in range(i + 1, bits)]).agg(
            F.array_sort(F.collect_list(F.struct(f"d{i}", "node"))).alias("run"))
        kids, hs = F.col("run.node"), F.col("run.node.h")
        # a group that is down to one node stays as it is
        h = F.when(F.col("n") > 1 << i, digest(F.array_join(hs, ""))).otherwise(F.get(hs, 0))
        level = runs.select(*[c for c in runs.columns if c != "run"], F.struct(h.alias("h"), kids.alias("kids")).alias("node"))
    return level


def build(nodes: DataFrame, order: list[str], bits: int = BITS) -> Tree:
    """The trees of all groups: ``nodes`` has g, h, a struct leaf and the order columns."""
    level = ranked(nodes, order)
    top = level.agg(F.max("n")).first()[0] or 1
    blocks = []
    while True:
        blocks.append(staged(roll_up(level, bits), "merkle-blocks"))
        if top <= 1 << bits:
            return Tree(blocks, blocks[-1].select("g", F.col("node.h").alias("h")))
        top = -(-top >> bits)
        level = blocks[-1].select("g", F.ceil(F.col("n") / (1 << bits)).cast("long").alias("n"), F.col("block").alias("rank"),
                                  F.col("node.h").alias("h"), F.struct(F.lit(None).cast("int").alias("none")).alias("leaf"))


def _emitted(bits: int) -> Column:
    """Array of {h, leaf, steps} of a block, in order of rank."""
    applied = sum((F.col("n") > 1 << i).cast("int") for i in range(bits))

    def walk(node, height, below):
        if not height:
            steps = F.concat(F.slice(F.array(*below), F.lit(1), applied), F.col("up"))
            return F.array(F.struct(node["h"].alias("h"), node["leaf"].alias("leaf"), steps.alias("steps")))
        kids = node["kids"]
        step = lambda i: F.struct(F.get(kids, 1 - i)["h"].alias("h"), (i == 1).alias("left"))
        return F.flatten(F.transform(kids, lambda kid, i: walk(kid, height - 1, [step(i), *below])))
    return walk(F.col("node"), bits, [])


def proofs(tree: Tree, above: DataFrame, bits: int = BITS) -> DataFrame:
    """Leaves of the trees with their steps: ``above`` has g, the steps ``up``
    above each group's root, and columns to carry to all its leaves."""
    carried = [c for c in above.columns if c not in ("g", "up")]
    paths = above.withColumn("rank", F.lit(0).cast("long"))
    for blocks in reversed(tree.blocks):
        p = paths.select(F.col("g").alias("_g"), F.col("rank").alias("_rank"), "up", *carried)
        met = blocks.join(p, F.col("g").eqNullSafe(F.col("_g")) & (F.col("block") == F.col("_rank")))
        rows = met.select("g", "block", *carried, F.posexplode(_emitted(bits)).alias("pos", "item"))
        paths = rows.select("g", (F.shiftleft("block", bits) + F.col("pos")).alias("rank"), *carried,
                            F.col("item.h").alias("h"), F.col("item.leaf").alias("leaf"), F.col("item.steps").alias("up"))
    return paths.withColumnRenamed("up", "steps")


def manifest(leaves: DataFrame, order: list[str], bits: int = BITS) -> DataFrame:
    """Two levels of trees, one per group g and one over the groups' roots:
    g, h, leaf, steps (up to the root), subroot, root. ``leaves`` must be staged."""
    groups = build(leaves, order, bits)
    subroots = staged(groups.roots.select(F.lit(0).alias("g"), "h", F.struct(F.col("g").alias("name")).alias("leaf"),
                                          F.col("g").alias("name")), "merkle-subroots")
    whole = build(subroots, ["name"], bits)
    top = whole.roots.select("g", F.col("h").alias("root"), F.array().cast(_STEPS).alias("up"))
    above = proofs(whole, top, bits).select(F.col("leaf.name").alias("g"), F.col("h").alias("subroot"), "root",
                                            F.col("steps").alias("up"))
    return proofs(groups, above, bits)


def document_manifest(docs: DataFrame, bits: int = BITS, changed: Column | None = None, n_chars: str = "n_chars") -> DataFrame:
    """Manifest of a documents table by language: doc_id, leaf, subroot, root,
    steps, and check_leaf, the leaf recomputed with ``n_chars`` + 1 where
    ``changed`` holds (a null stays null), as a later reader would find it."""
    def hashed(touched):
        return leaf_hash([F.col(c).cast("string") if c != n_chars else F.col(c) + int(touched) for c in FIELDS])
    found = hashed(False)
    later = F.when(changed, hashed(True)) if changed is not None else F.lit(None).cast("string")
    leaves = staged(docs.select(F.col("lang").alias("g"), "doc_id", found.alias("h"), later.alias("later"))
                    .select("g", "h", "doc_id", F.struct("doc_id", "later").alias("leaf")), "merkle-leaves")
    return manifest(leaves, ["doc_id"], bits).select(
        F.col("leaf.doc_id").alias("doc_id"), F.col("h").alias("leaf"), "subroot", "root", "steps",
        F.coalesce(F.col("leaf.later"), F.col("h")).alias("check_leaf"))
