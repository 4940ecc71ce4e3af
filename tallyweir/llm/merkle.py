"""A Merkle manifest of a dataset: a digest per row, a tree per source, a root over all, and the proof of every row.

Proofs come by pointer jumping. A node starts with the digests beside it on the way to its parent (left and right of it in
its run); in each round it joins the node it points to, appends that one's segment to its own and points as far again. After as many rounds
as the height has bits, every node holds the way to the root. The leaves, by far the most rows, are not sent through the rounds: a run of
leaves travels as one node and its members take its finished way in one last join, on at most ``arity`` rows a run.

Nodes are (tree, level, idx): tree is the position of the source's first leaf among all leaves, or -1 for the tree over the sources.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.numbering import numbered
from .common import materialize

ARITY = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
NODE = ["tree", "level", "idx"]
STEP = "struct<left: string, right: string>"
TOP = -1


def digest(value: Column) -> Column:
    return F.sha2(value.cast("binary"), 256)


def field(value: Column) -> Column:
    """`-` for null, else the value's UTF-8 byte count, a colon and the value: no two rows give the same bytes."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def row_digest(fields: tuple[str, ...] = FIELDS, **changed: Column) -> Column:
    """The leaf of a row; changed gives other values for some of its fields."""
    return digest(F.concat(*[field(changed.get(c, F.col(f"`{c}`"))) for c in fields]))


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    upper = "".join(map(chr, range(65, 91)))
    return F.translate(text, upper, upper.lower())


def _joined(members: Column) -> Column:
    return F.concat_ws("", F.transform(members, lambda m: m["digest"]))


def _beside(members: str, pos: str) -> Column:
    """What stands left and right of member pos in its run."""
    left = F.slice(members, F.lit(1), F.col(pos))
    right = F.slice(members, F.col(pos) + 2, F.size(members))
    return F.struct(_joined(left).alias("left"), _joined(right).alias("right"))


@dataclass
class Tree:
    """leaves: rid and what came with it, leaf, leaf_no, tree, run, n (leaves of its source). ways: a row per run of leaves with way (steps to the root) and subroot. root: the digest over all; null of an empty table."""

    leaves: DataFrame
    sources: DataFrame
    ways: DataFrame
    root: str | None


def _climb(level: DataFrame, arity: int, height: int) -> tuple[list[DataFrame], DataFrame | None]:
    """Steps of all nodes to their parents and the tops, from level (NODE, n nodes of the tree's level, digest) upwards."""
    steps, tops = [], None
    for _ in range(height + 1):
        ends = level.filter("n = 1").select(*NODE, "digest")
        tops = ends if tops is None else tops.unionByName(ends)
        members = F.array_sort(F.collect_list(F.struct("idx", "digest")))
        runs = level.filter("n > 1").groupBy("tree", "level", "n", F.floor(F.col("idx") / arity).alias("up")).agg(members.alias("members"))
        runs = materialize(runs, "merkle_runs")
        one = runs.select("tree", "level", "n", "up", "members", F.posexplode("members").alias("pos", "m"))
        steps.append(one.select("tree", "level", F.col("m.idx").alias("idx"), F.col("tree").alias("up_tree"), (F.col("level") + 1).alias("up_level"), F.col("up").alias("up_idx"), F.array(_beside("members", "pos")).alias("way")))
        level = runs.select("tree", (F.col("level") + 1).alias("level"), F.col("up").alias("idx"), F.ceil(F.col("n") / arity).alias("n"), digest(_joined(F.col("members"))).alias("digest"))
    return steps, tops


def _height(n: int, arity: int) -> int:
    levels = 0
    while n > 1:
        n, levels = -(-n // arity), levels + 1
    return levels


def build(rows: DataFrame, source: Column, order: Column, arity: int = ARITY) -> Tree:
    """The trees over rows, which have rid (unique, stored) and leaf; source and order are read from them.

    Leaves of a source ascend by order (null first; equal ones by leaf), sources by UTF-8 bytes (null first).
    """
    keyed = rows.withColumns({"__tw_source": source.cast("string"), "__tw_order": order})
    placed = materialize(numbered(keyed, F.asc_nulls_first("__tw_source"), F.asc_nulls_first("__tw_order"), F.col("leaf"), F.col("rid"), name="leaf_no"), "merkle_leaves")
    found = placed.groupBy("__tw_source").agg(F.min("leaf_no").alias("tree"), F.count("*").alias("n"))
    sources = materialize(numbered(found, F.asc_nulls_first("__tw_source"), name="source_no"), "merkle_sources")
    most, total = sources.agg(F.max("n"), F.count("*")).first()
    trees = sources.select(F.col("__tw_source").alias("__tw_s"), "tree", "n", "source_no")
    leaves = placed.join(trees.drop("source_no"), F.col("__tw_source").eqNullSafe(F.col("__tw_s"))).drop("__tw_s", "__tw_order").withColumn("run", F.floor((F.col("leaf_no") - F.col("tree")) / arity))
    leaves = materialize(leaves, "merkle_placed")
    tall, wide = _height(most or 0, arity), _height(total, arity)

    members = F.array_sort(F.collect_list(F.struct("leaf_no", F.col("leaf").alias("digest"))))
    lowest = leaves.groupBy("tree", "run", "n").agg(members.alias("members"))
    lowest = lowest.select("tree", F.lit(1).alias("level"), F.col("run").alias("idx"), F.ceil(F.col("n") / arity).alias("n"), F.when(F.col("n") > 1, digest(_joined(F.col("members")))).otherwise(F.get("members", 0)["digest"]).alias("digest"))
    lowest = materialize(lowest, "merkle_level")
    below, subroots = _climb(lowest, arity, max(0, tall - 1))
    subroots = materialize(subroots.join(trees.select("tree", "source_no"), "tree"), "merkle_subroots")
    above, tops = _climb(subroots.select(F.lit(TOP).cast("long").alias("tree"), F.lit(0).alias("level"), F.col("source_no").alias("idx"), F.lit(total).cast("long").alias("n"), "digest"), arity, wide)
    root = next((r["digest"] for r in tops.select("digest").collect()), None)  # one row

    # a subroot is the end of its source's tree and a leaf of the upper one
    up = above[0].withColumnRenamed("idx", "source_no").drop("tree", "level")
    ends = subroots.join(up, "source_no", "left").select(*NODE, "up_tree", "up_level", "up_idx", F.coalesce("way", F.array().cast(f"array<{STEP}>")).alias("way"), F.col("digest").alias("subroot"))
    nodes = reduce(DataFrame.unionByName, [ends, *[s.withColumn("subroot", F.lit(None).cast("string")) for s in below + above[1:]]])
    return Tree(leaves, sources, _jumped(materialize(nodes, "merkle_nodes"), max(0, tall - 1), wide), root)


def _jumped(nodes: DataFrame, tall: int, wide: int) -> DataFrame:
    """nodes with the whole way to the root: each round joins what a node points to and doubles the distance.

    Only nodes with others so far below them can be pointed to, so the joined side shrinks with the square and the last rounds broadcast it if its stored size allows.
    """
    for r in range(math.ceil(math.log2(tall + wide + 1))):  # far enough to meet the top itself, which may be the subroot
        far = nodes.filter((F.col("tree") == TOP) | (F.col("level") + F.lit(wide) > 2**r))
        target = far.select(*[F.col(c).alias(f"up_{c}") for c in NODE], F.col("up_tree").alias("t"), F.col("up_level").alias("l"), F.col("up_idx").alias("i"), F.col("way").alias("more"), F.col("subroot").alias("s"))
        hop = nodes.join(target, [f"up_{c}" for c in NODE], "left")
        nodes = materialize(hop.select(*NODE, F.col("t").alias("up_tree"), F.col("l").alias("up_level"), F.col("i").alias("up_idx"), F.when(F.col("more").isNull(), F.col("way")).otherwise(F.concat("way", "more")).alias("way"), F.coalesce("subroot", "s").alias("subroot")), "merkle_jump")
    return nodes.filter(F.col("level") == 1).filter(F.col("tree") != TOP).select("tree", F.col("idx").alias("run"), "way", "subroot")


def fold(leaf: Column, way: Column) -> Column:
    """The root that a leaf and its way give."""
    return F.aggregate(way, leaf, lambda d, s: digest(F.concat(s["left"], d, s["right"])))


def proofs(tree: Tree, *carried: str) -> DataFrame:
    """rid, carried columns, leaf, way (left and right siblings of each level, from the leaf up) and subroot of every leaf."""
    at = F.struct("leaf_no", F.col("leaf").alias("digest"), "rid", *[F.col(c) for c in carried])
    runs = tree.leaves.groupBy("tree", "run", "n").agg(F.array_sort(F.collect_list(at)).alias("members"))
    met = runs.join(tree.ways, ["tree", "run"]).select("n", "way", "subroot", "members", F.posexplode("members").alias("pos", "m"))
    own = F.when(F.col("n") > 1, F.array(_beside("members", "pos"))).otherwise(F.array().cast(f"array<{STEP}>"))
    return met.select("m.rid", *[F.col(f"m.{c}").alias(c) for c in carried], F.col("m.digest").alias("leaf"), F.concat(own, F.col("way")).alias("way"), "subroot")


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256 of every row of docs, and folded_root and verified after the tampering of op12.

    The text of documents where 5 divides the crc32 of the decimal doc_id is held in lower case (A-Z) and its leaf folded with the original siblings.
    Null fields count as `-`, unlike empty ones. Null doc_ids come first in their source and are not tampered with; rows that
    repeat a doc_id follow each other by leaf. The null source is a source of its own. A lone row is its source's subroot, a lone subroot the root:
    there the proof is the digest of nothing. An empty table gives an empty frame; columns besides the five are not part of a leaf.
    """
    hit = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))
    rows = materialize(docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), row_digest().alias("leaf"),
                                   F.when(hit, row_digest(text=lower_ascii(F.col("text")))).alias("tampered")), "merkle_rows")
    tree = build(rows, F.col("source"), F.col("doc_id"))
    out = proofs(tree, "doc_id", "tampered")
    siblings = F.concat_ws("", F.transform("way", lambda s: F.concat(s["left"], s["right"])))
    root = F.lit(tree.root).cast("string")
    return (out.select("doc_id", "leaf", "subroot", root.alias("root"), digest(siblings).alias("proof_sha256"), fold(F.coalesce("tampered", "leaf"), F.col("way")).alias("folded_root"))
            .withColumn("verified", F.col("folded_root") == F.col("root")))


def verify(docs: DataFrame, proofs_: DataFrame, root: str) -> DataFrame:
    """docs (unique doc_ids) against kept proofs (doc_id, way): doc_id and verified, false where the row changed or has no proof."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_digest().alias("leaf"))
    return own.join(proofs_.select("doc_id", "way"), "doc_id", "left").select("doc_id", F.coalesce(fold(F.col("leaf"), F.col("way")) == F.lit(root), F.lit(False)).alias("verified"))
