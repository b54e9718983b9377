"""Merkle manifest of a table: one tree for each group of rows, and a tree over the groups' roots.

Rows are leaves, placed by a sort in ranges: each range counts its rows, and the sums of the counts before it are joined
back, so no task holds a group. A level's nodes become the next by a slot pivot: rows are grouped by parent, conditional aggregates
spread a parent's children into FANOUT columns, and the columns' concatenation is hashed. On the way down, the
columns without a node's own slot are its siblings; each node joins its parent, so a leaf meets its whole proof in one join for each level.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import scratch, staged

FANOUT = 3
SLOTS = tuple(f"c{k}" for k in range(FANOUT))


def row_hash(values: Sequence[Column]) -> Column:
    """Hex sha256 of the values, each `-` if null, else its UTF-8 byte count, `:` and itself as text."""
    return F.sha2(F.concat(*[F.when(v.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string"))) for v in values]), 256)


def _placed(nodes: DataFrame) -> DataFrame:
    """nodes (tree, ord, hash, ...) with pos, the place in the tree by ord and hash (null first), and n, the tree's number of nodes."""
    ranges = nodes.repartitionByRange("tree", "ord", "hash").sortWithinPartitions("tree", "ord", "hash")
    dealt = staged(ranges.withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("at", 33)), "ranges", compression="zstd")
    counts = dealt.groupBy("tree", "part").agg(F.count("*").alias("rows"), F.min("at").alias("first"))
    of_tree = Window.partitionBy("tree")  # of the few rows of counts, one for each range that the tree is in
    before = F.coalesce(F.sum("rows").over(of_tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = counts.select("tree", "part", (before - F.col("first")).alias("shift"), F.sum("rows").over(of_tree).alias("n"))
    return dealt.join(shifts, ["tree", "part"]).withColumn("pos", F.col("at") + F.col("shift")).drop("at", "part", "shift", "ord")


def _parents(nodes: DataFrame) -> DataFrame:
    """The level above nodes (tree, pos, n, hash): tree, pos, n, hash, and the children's hashes in columns."""
    slot = F.col("pos") % FANOUT
    pivot = [F.max(F.when(slot == k, F.col("hash"))).alias(c) for k, c in enumerate(SLOTS)]
    above = nodes.groupBy("tree", F.expr(f"pos div {FANOUT}").alias("pos")).agg(F.expr(f"(max(n) + {FANOUT - 1}) div {FANOUT}").alias("n"), *pivot)
    return above.withColumn("hash", F.sha2(F.concat_ws("", *SLOTS), 256))


def _with_step(nodes: DataFrame, above: DataFrame) -> DataFrame:
    """nodes with the proof of their parents in above, and before it their own siblings."""
    slot = F.col("pos") % FANOUT
    siblings = F.struct(
        F.concat_ws("", *[F.when(slot > k, F.col(f"up.{c}")) for k, c in enumerate(SLOTS)]).alias("left"),
        F.concat_ws("", *[F.when(slot < k, F.col(f"up.{c}")) for k, c in enumerate(SLOTS)]).alias("right"),
    )
    up = above.select(F.col("tree").alias("__tree"), F.col("pos").alias("__pos"), F.struct(*SLOTS, "proof", "subroot").alias("up"))
    joined = nodes.join(up, (F.col("tree") == F.col("__tree")) & (F.expr(f"pos div {FANOUT}") == F.col("__pos")))
    return joined.select(*nodes.columns, F.concat(F.array(siblings), F.col("up.proof")).alias("proof"), F.col("up.subroot").alias("subroot"))


def _built(leaves: DataFrame) -> tuple[DataFrame, list[DataFrame], DataFrame]:
    """Placed leaves, the levels above those of trees that have several nodes, and the root of each tree (tree, hash)."""
    placed = staged(_placed(leaves), "placed", compression="zstd")
    most = placed.agg(F.max("n")).first()[0] or 0
    levels, nodes = [], placed
    while most > 1:
        nodes = staged(_parents(nodes.filter("n > 1").select("tree", "pos", "n", "hash")), "level", compression="zstd")
        levels.append(nodes)
        most = -(-most // FANOUT)
    roots = reduce(DataFrame.unionByName, [x.filter("n = 1").select("tree", "hash") for x in (placed, *levels)])
    return placed, levels, roots


def _proven(placed: DataFrame, levels: list[DataFrame], tops: DataFrame) -> DataFrame:
    """placed with proof, from the leaf up, and subroot; tops has tree, proof and subroot of each tree's root."""
    above = None
    for nodes in (*reversed(levels), placed):
        found = nodes.filter("n = 1").join(tops, "tree").select(*nodes.columns, "proof", "subroot")
        if above is not None:
            found = found.unionByName(_with_step(nodes.filter("n > 1"), above))
        above = found
    return above


def merkle_tree(rows: DataFrame) -> DataFrame:
    """rows (tree string, ord, hash, and more) with n, pos, subroot, root and proof.

    Each tree's leaves ascend by ord (null first; equal ones by hash). While several nodes remain, each FANOUT consecutive ones (the last run may have
    fewer) become the hash of their concatenated hashes; a lone leaf is its tree's root. The trees' roots, ascending by tree bytewise,
    are the leaves of a last tree. ``proof`` has for each level above the leaf up to the root the concatenated hashes of the siblings left and right of the
    node, empty where there are none. A tree must not be null. Repeated rows are leaves of their own. An empty table gives no rows.
    """
    with scratch(rows.sparkSession):
        return staged(_merkle_tree(rows), "merkle", outlives=True, compression="zstd")


def _merkle_tree(rows: DataFrame) -> DataFrame:
    step = "array<struct<left: string, right: string>>"
    placed, levels, roots = _built(rows)
    top, top_levels, root = _built(roots.select(F.lit("").alias("tree"), F.col("tree").alias("ord"), "hash", F.col("tree").alias("group")))
    found = root.first()
    last = F.lit(found["hash"] if found else None).cast("string")
    of_root = root.select("tree", F.array().cast(step).alias("proof"), F.col("hash").alias("subroot"))
    tops = staged(_proven(top, top_levels, of_root).select(F.col("group").alias("tree"), "proof", F.col("hash").alias("subroot")), "tops")
    return _proven(placed, levels, tops).withColumn("root", last)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf's hash and its proof lead to."""
    return F.aggregate(proof, leaf, lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]), 256))


def merkle_manifest(docs: DataFrame, fields: Sequence[str], group: str, order: str, changed: dict[str, Column] | None = None) -> DataFrame:
    """One row for each row of docs: the column ``order``, leaf, subroot, root, proof, folded_root and verified.

    A leaf is the hash of ``fields`` in order; leaves of one ``group`` form a tree, and a null group is the first. ``changed`` gives fields other values,
    as a copy of the table has them: ``folded_root`` is what these values and the proof lead to, ``verified`` whether that is the root. Nulls are hashed as
    ``-``; columns that aren't in ``fields`` don't count, and their names don't matter. Texts of any length, empty ones and repeated rows are leaves like any other.
    """
    own = [docs[c] for c in fields]
    other = [(changed or {}).get(c, docs[c]) for c in fields]
    tree = F.when(docs[group].isNull(), F.lit("")).otherwise(F.concat(F.lit("+"), docs[group].cast("string")))
    leaves = docs.select(tree.alias("tree"), docs[order].alias("ord"), row_hash(own).alias("hash"), docs[order].alias("key"), row_hash(other).alias("other"))
    with scratch(docs.sparkSession):
        first = leaves.withColumn("other", F.when(F.col("other") != F.col("hash"), F.col("other")))
        proven = merkle_tree(staged(first, "leaves", compression="zstd"))
        report = proven.select(F.col("key").alias(order), F.col("hash").alias("leaf"), "subroot", "root", "proof", folded(F.coalesce("other", "hash"), F.col("proof")).alias("folded_root"))
        return staged(report.withColumn("verified", F.col("folded_root") == F.col("root")), "manifest", outlives=True, compression="zstd")


def merkle_report(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified; line ends are deleted from the text where the crc32 of the decimal doc_id is even (never where it is null)."""
    text = F.when(F.crc32(docs["doc_id"].cast("string")) % 2 == 0, F.replace(docs["text"], F.lit("\n"), F.lit(""))).otherwise(docs["text"])
    found = merkle_manifest(docs, ("doc_id", "source", "lang", "n_chars", "text"), "source", "doc_id", {"text": text})
    siblings = F.array_join(F.transform("proof", lambda s: F.concat(s["left"], s["right"])), "")
    return found.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), "folded_root", "verified")
