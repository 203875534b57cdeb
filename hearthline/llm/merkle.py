"""A Merkle manifest: trees of eight children a node over ordered rows, stored as blocks in van Emde Boas order.

A block is an aligned subtree over at most 4096 nodes of the level below. Its digests lie in one array: the upper half of its levels
first, then each subtree of the lower half, every part laid out in the same way. `address` finds a node there from its depth and number
alone. The roots of the blocks are the leaves of the next level of blocks, and the roots of all trees those of the top tree, so a table of
any size is a few rounds of blocks that are built, and later read for siblings, one by one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import kept
from .words import packed, unpacked

ARITY = 8
HEIGHT = 4  # levels of hashing in a block
LEAVES = ARITY**HEIGHT
RANGE_ROWS = 1_000_000  # rows in a range of the ordering, at most; small tables are cut finer
LEAST_ROWS = 20_000
BLOCK = "tree string, block long, total long, nodes binary, digest string"
PATH = "tree string, place long, path array<string>"


# --- layout ---------------------------------------------------------------------------------


def size(levels: int) -> int:
    """Nodes of a complete subtree."""
    return (ARITY**levels - 1) // (ARITY - 1)


def address(levels: int, depth: int, index: np.ndarray) -> np.ndarray:
    """Where the nodes `index` at `depth` (the root's is 0) of a subtree of so many levels lie in van Emde Boas order."""
    if levels == 1:
        return np.zeros_like(index)
    top = levels // 2
    if depth < top:
        return address(top, depth, index)
    below = ARITY ** (depth - top)
    return size(top) + index // below * size(levels - top) + address(levels - top, depth - top, index % below)


def height(total: int) -> int:
    """Levels of hashing in the blocks of a level of `total` nodes."""
    h = 0
    while h < HEIGHT and ARITY**h < total:
        h += 1
    return h


def digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def laid(leaves: list[str], high: int) -> np.ndarray:
    """A block of height `high` over digests in hex: its nodes in van Emde Boas order, 32 bytes each; places without a node hold zeros."""
    nodes = np.zeros((size(high + 1), 32), np.uint8)
    row = leaves
    for depth in range(high, -1, -1):
        nodes[address(high + 1, depth, np.arange(len(row)))] = np.frombuffer(bytes.fromhex("".join(row)), np.uint8).reshape(-1, 32)
        if depth:
            row = [digest("".join(row[i : i + ARITY])) for i in range(0, len(row), ARITY)]
    return nodes


def sibling_paths(nodes: np.ndarray, high: int, leaves: int, above: list[str]) -> list[list[str]]:
    """For each leaf of a block the digests left and right of it in its run, then those of its parent, up through `above`."""
    counts = [leaves]
    for _ in range(high):
        counts.append(-(-counts[-1] // ARITY))
    paths = [above]
    for depth in range(1, high + 1):
        n = counts[high - depth]
        text = nodes[address(high + 1, depth, np.arange(n))].tobytes().hex()
        row = [text[64 * i : 64 * i + 64] for i in range(n)]
        paths = [["".join(row[i // ARITY * ARITY : i]), "".join(row[i + 1 : min(n, i // ARITY * ARITY + ARITY)]), *paths[i // ARITY]] for i in range(n)]
    return paths


def folded(leaf: str, path: list[str]) -> str:
    """The root that a leaf and its siblings give."""
    for left, right in zip(path[::2], path[1::2]):
        leaf = digest(left + leaf + right)
    return leaf


# --- leaves ---------------------------------------------------------------------------------


def field(value: Column) -> Column:
    """`-` for null, else the length in UTF-8 bytes, a colon, and the value as text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(*values: Column) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]).cast("binary"), 256)


def tree_name(key: Column) -> Column:
    """Names that sort as the keys do, null first, and are never null themselves."""
    return F.coalesce(F.concat(F.lit("="), key.cast("string")), F.lit("-"))


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """`rows` with place (from 0) in their `tree` along `order`, and the tree's total.

    Rows are cut into ranges of (tree, order), written once; the ranges' counts give the offsets. `order` must tell all rows apart, so that
    no tree, id or group of copies fills one task."""
    n = rows.count()
    parts = max(n // RANGE_ROWS + 1, min(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), n // LEAST_ROWS + 1))
    ranged = kept(rows.repartitionByRange(parts, "tree", *order).withColumn("hl_range", F.spark_partition_id()), name)
    sums = ranged.groupBy("tree", "hl_range").agg(F.count("*").alias("n"))
    tree = Window.partitionBy("tree")
    before = F.sum("n").over(tree.orderBy("hl_range").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sums.select("tree", "hl_range", F.coalesce(before, F.lit(0)).alias("hl_before"), F.sum("n").over(tree).alias("total"))
    inside = F.row_number().over(Window.partitionBy("tree", "hl_range").orderBy(*order))
    placed = ranged.withColumn("hl_inside", inside).join(offsets, ["tree", "hl_range"])
    return placed.select(*rows.columns, (F.col("hl_before") + F.col("hl_inside") - 1).alias("place"), "total")


# --- building -------------------------------------------------------------------------------


def _build(group: pa.Table) -> pa.Table:
    group = group.combine_chunks().sort_by("place")
    total = group.column("total")[0].as_py()
    nodes = laid(group.column("digest").to_pylist(), height(total))
    first = {c: [group.column(c)[0].as_py()] for c in ("tree", "block", "total")}
    return pa.table(first | {"nodes": pa.chunked_array([packed(nodes)]), "digest": [nodes[0].tobytes().hex()]})


def grown(nodes: DataFrame, name: str) -> list[DataFrame]:
    """The levels of blocks over `nodes` (tree, place, total, digest), each written to the shared folder; a tree ends at the level where it is one block."""
    most, levels = nodes.agg(F.max("total")).first()[0] or 0, []
    while most:
        blocks = nodes.select("tree", F.expr(f"place div {LEAVES}").alias("block"), "place", "total", "digest").groupBy("tree", "block").applyInArrow(_build, BLOCK)
        levels.append(kept(blocks, name))
        more = levels[-1].where(F.col("total") > LEAVES)
        nodes = more.select("tree", F.col("block").alias("place"), F.ceil(F.col("total") / LEAVES).alias("total"), "digest")
        most = 0 if most <= LEAVES else -(-most // LEAVES)
    return levels


def roots(levels: list[DataFrame]) -> DataFrame:
    """(tree, digest): the last block of each tree holds its root."""
    return reduce(DataFrame.unionByName, [b.where(F.col("total") <= LEAVES).select("tree", "digest") for b in levels])


@dataclass
class Manifest:
    """The leaves with their places, the blocks of all trees, and those of the top tree over the trees' roots."""

    leaves: DataFrame
    levels: list[DataFrame]
    subroots: DataFrame
    top: list[DataFrame]


def manifest(rows: DataFrame, order: list[str]) -> Manifest | None:
    """Trees over `rows` (tree, digest, and more columns), leaves along `order`, which must tell all rows of a tree apart, and a top tree over
    the trees by name. None if there are no rows."""
    leaves = kept(numbered(rows, order, "leaf-ranges"), "leaves")
    levels = grown(leaves, "merkle-blocks")
    if not levels:
        return None
    named = roots(levels).select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest")
    subroots = kept(numbered(named, ["name"], "root-ranges"), "subroots")
    return Manifest(leaves, levels, subroots, grown(subroots, "top-blocks"))


# --- proofs ---------------------------------------------------------------------------------


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks with the path above them -> the path of each of their leaves."""
    for batch in batches:
        for tree, block, total, nodes, above in zip(*(batch.column(c) for c in ("tree", "block", "total", "nodes", "path"))):
            block, total = block.as_py(), total.as_py()
            paths = sibling_paths(np.frombuffer(nodes.as_py(), np.uint8).reshape(-1, 32), height(total), min(LEAVES, total - block * LEAVES), above.as_py())
            places = pa.array(range(block * LEAVES, block * LEAVES + len(paths)), pa.int64())
            yield pa.RecordBatch.from_pydict({"tree": pa.array([tree.as_py()] * len(paths), pa.string()), "place": places, "path": pa.array(paths, pa.list_(pa.string()))})


def under(levels: list[DataFrame], above: DataFrame) -> DataFrame:
    """The blocks of the lowest level with the path above each, where `above` has the path of every tree's root."""
    spread = None
    for blocks in reversed(levels):
        last = blocks.where(F.col("total") <= LEAVES).join(above, "tree")
        if spread is not None:
            inner = blocks.where(F.col("total") > LEAVES).join(spread.withColumnRenamed("place", "block"), ["tree", "block"])
            last = last.unionByName(inner)
        spread = last.mapInArrow(_spread, PATH)
    return last


def root(made: Manifest) -> str:
    return made.top[-1].where(F.col("total") <= LEAVES).first()["digest"]


def proofs(made: Manifest, claimed: str, carry: list[str]) -> DataFrame:
    """For each leaf: `carry`, digest, hl_subroot, hl_root, hl_proof (the digest of all siblings from the leaf up), hl_folded (the root that the
    leaf in column `claimed` gives with these siblings) and hl_verified.

    A task holds one block of nodes and its leaves; the paths above blocks are worked out once a block, from the top down."""
    spark = made.leaves.sparkSession
    outer = spark.createDataFrame([("", [])], "tree string, path array<string>")
    of_trees = under(made.top, outer).mapInArrow(_spread, PATH)
    above = made.subroots.drop("tree").join(of_trees.select("place", "path"), "place").select(F.col("name").alias("tree"), "path", F.col("digest").alias("hl_subroot"))
    blocks = under(made.levels, above.select("tree", "path")).select("tree", "block", "total", "nodes", "path").join(above.select("tree", "hl_subroot"), "tree")
    whole = root(made)
    leaves = made.leaves.select(*carry, "tree", "place", F.expr(f"place div {LEAVES}").alias("block"), "digest", F.col(claimed).alias("hl_claimed"))

    def prove(rows: pa.Table, block: pa.Table) -> pa.Table:
        rows = rows.combine_chunks().sort_by("place")
        total = block.column("total")[0].as_py()
        nodes = unpacked(block.column("nodes"), np.uint8)[0].reshape(-1, 32)
        paths = sibling_paths(nodes, height(total), rows.num_rows, block.column("path")[0].as_py())
        results = [folded(leaf, path) for leaf, path in zip(rows.column("hl_claimed").to_pylist(), paths)]
        return rows.select([*carry, "digest"]).append_column("hl_subroot", pa.array(block.column("hl_subroot").to_pylist() * rows.num_rows, pa.string())).append_column(
            "hl_root", pa.array([whole] * rows.num_rows, pa.string())).append_column(
            "hl_proof", pa.array([digest("".join(path)) for path in paths], pa.string())).append_column(
            "hl_folded", pa.array(results, pa.string())).append_column("hl_verified", pa.array([r == whole for r in results]))

    kinds = {f.name: f.dataType.simpleString() for f in leaves.schema.fields}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in [*carry, "digest"]) + ", hl_subroot string, hl_root string, hl_proof string, hl_folded string, hl_verified boolean"
    return leaves.groupBy("tree", "block").cogroup(blocks.groupBy("tree", "block")).applyInArrow(prove, schema)


PROVED = "doc_id {0}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def prove_documents(docs: DataFrame, tampered: Column) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified for each row of `docs`.

    A leaf is the digest of doc_id, source, lang, n_chars and text. A tree for each lang (null is one, and first) holds its leaves by doc_id
    (null first; equal ids by leaf; rows alike in all have leaves alike, in any order). Where `tampered` holds, the text is claimed with A-Z
    lower-cased, and its proof fails if that changes it. No rows give no rows.
    """
    cols = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    changed = F.when(tampered, leaf_of(*cols[:-1], F.translate("text", upper, upper.lower())))
    rows = docs.select("doc_id", tree_name(F.col("lang")).alias("tree"), leaf_of(*cols).alias("digest"), changed.alias("changed"))
    rows = rows.withColumn("claimed", F.coalesce("changed", "digest")).drop("changed").withColumn("tie", F.monotonically_increasing_id())
    made = manifest(kept(rows, "digests"), ["doc_id", "digest", "tie"])
    if made is None:
        return docs.sparkSession.createDataFrame([], PROVED.format(docs.schema["doc_id"].dataType.simpleString()))
    names = {"digest": "leaf", "hl_subroot": "subroot", "hl_root": "root", "hl_proof": "proof_sha256", "hl_folded": "folded_root", "hl_verified": "verified"}
    return proofs(made, "claimed", ["doc_id"]).withColumnsRenamed(names)
