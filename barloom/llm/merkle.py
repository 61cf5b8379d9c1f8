"""Merkle manifest of a dataset, stored in van Emde Boas layout.

A row's leaf is the SHA-256 of its columns, each with its length before it.  Leaves of one tree (one value of the tree
column) ascend by id; every two neighbours become the hash of both, a lone last one the hash of itself, until one is left,
the subroot.  Subroots, in the order of their tree, are the leaves of the same kind of tree, whose end is the root.

A tree of height H is cut at half its height into a top and aligned bottom subtrees, and those again, until a piece
is at most BLOCK levels high: a row of the manifest.  Inside a row the digests lie in the same recursive order, so that
``address`` finds any node's place by arithmetic alone, and a walk from leaf to root touches neighbours whatever the
sizes of caches and pages are.  The rows of one layer are built from the roots of the layer below, and a leaf's siblings are read
back layer by layer: those of a block's root once per block, not once per leaf.

Places in a tree come from one sort by ranges and counts per range; a tree may hold any share of the rows.

Defined results: null columns count as `-`, and a null tree value is a tree of its own, the first; null ids come
first in it; rows of one id go by their leaf; repeated rows are leaves each, and get the siblings of their places; texts of any length
count whole; an empty table has no tree and gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from barloom.llm.shared import Scratch

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: Most levels of edges in one row of the manifest: 2^BLOCK leaves and less than twice as many digests.
BLOCK = 10
DIGEST = 32
#: Steps of a path: no sibling, sibling to the right, sibling to the left.
LONE, RIGHT, LEFT = 0, 1, 2


def address(levels: int, depth: int, index: np.ndarray) -> np.ndarray:
    """Places of nodes (depth below the root, number in it) of a complete binary tree of so many levels in van Emde Boas order."""
    index = np.asarray(index, np.int64)
    at = np.zeros_like(index)
    while levels > 1:
        top = levels // 2
        bottom = levels - top
        if depth < top:
            levels = top
            continue
        subtree = index >> (depth - top)
        at += (1 << top) - 1 + subtree * ((1 << bottom) - 1)
        depth -= top
        index = index & ((1 << depth) - 1)
        levels = bottom
    return at


@functools.lru_cache(maxsize=256)
def layers(height: int, most: int = BLOCK) -> tuple[int, ...]:
    """Heights of the pieces, from the leaves up, that halving leaves of a tree."""
    if height <= most:
        return (height,)
    return layers(height - height // 2, most) + layers(height // 2, most)


def parent(run: bytes) -> bytes:
    """Hash of hexadecimal digests one after the other, as hexadecimal."""
    return hashlib.sha256(run).hexdigest().encode()


def leaf_digest(columns: dict[str, Column]) -> Column:
    def part(c: Column) -> Column:
        s = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))

    return F.unhex(F.sha2(F.concat(*map(part, columns.values())), 256))


def leaves(docs: DataFrame, id_col: str, tree_col: str, columns: tuple[str, ...], claimed: dict[str, Column]) -> DataFrame:
    """(tree, id, digest, claim, row): claim is the leaf with other values of the claimed columns, null where it is the same."""
    real = {c: F.col(f"`{c}`") for c in columns}
    both = docs.select(F.col(f"`{tree_col}`").alias("tree"), F.col(f"`{id_col}`").alias("id"), leaf_digest(real).alias("digest"), leaf_digest(real | claimed).alias("claim"))
    return both.withColumn("claim", F.nullif("claim", "digest")).withColumn("row", F.monotonically_increasing_id())


def numbered(rows: DataFrame, order: list[str], scratch: Scratch, name: str) -> DataFrame:
    """rows with idx, their place in their tree by the order, and n, the rows of the tree."""
    keys = [F.col(c).asc_nulls_first() for c in ("tree", *order)]
    laid = scratch.put(name, rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id()))
    laid = laid.withColumn("range", F.shiftright("at", 33))
    counted = laid.groupBy("tree", "range").agg(F.count("*").alias("c"), F.min("at").alias("first"))
    in_tree = Window.partitionBy("tree")
    before = F.coalesce(F.sum("c").over(in_tree.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counted.select(F.col("tree").alias("tree_"), F.col("range").alias("range_"), "first", before.alias("before"), F.sum("c").over(in_tree).alias("n"))
    met = laid.join(starts, F.col("tree").eqNullSafe(F.col("tree_")) & (F.col("range") == F.col("range_")))
    return met.withColumn("idx", F.col("at") - F.col("first") + F.col("before")).drop("at", "range", "tree_", "range_", "first", "before")


def height_of(n: int) -> int:
    return (n - 1).bit_length()


def _height(layer: int, most: int) -> Column:
    """Height of the layer's blocks in a tree of n leaves; null if the tree has no such layer."""
    tall = F.when(F.col("n") > 1, F.length(F.bin(F.col("n") - 1))).otherwise(0)
    known = [layers(h, most) for h in range(64)]
    return F.element_at(F.lit([x[layer] if layer < len(x) else -1 for x in known]), tall + 1)


def _layer(nodes: DataFrame, layer: int, most: int, lists: list[str]) -> DataFrame:
    """Blocks (tree, n, block, nodes, root, last, and the lists of their leaves' columns) over nodes (tree, n, idx, digest, ...)."""
    dealt = nodes.withColumn("height", _height(layer, most)).where("height >= 0").withColumn("block", F.expr("shiftright(idx, height)"))
    fields = [
        dealt.schema["tree"],
        *(T.StructField(c, T.LongType()) for c in ("n", "block")),
        *(T.StructField(c, T.BinaryType()) for c in ("nodes", "root")),
        T.StructField("last", T.BooleanType()),
        *(T.StructField(c, T.ArrayType(dealt.schema[c].dataType)) for c in lists),
    ]
    schema = T.StructType(fields)
    arrow = to_arrow_schema(schema)

    def build(group: pa.Table) -> pa.Table:
        group = group.sort_by("idx")
        n, height, block = (group.column(c)[0].as_py() for c in ("n", "height", "block"))
        level = [d.hex().encode() for d in group.column("digest").to_pylist()]
        held = np.zeros(((2 << height) - 1, DIGEST), np.uint8)
        for depth in range(height, -1, -1):
            held[address(height + 1, depth, np.arange(len(level)))] = np.frombuffer(bytes.fromhex(b"".join(level).decode()), np.uint8).reshape(-1, DIGEST)
            if depth:
                level = [parent(b"".join(level[i : i + 2])) for i in range(0, len(level), 2)]
        made = {"tree": group.column("tree")[0].as_py(), "n": n, "block": block, "nodes": held.tobytes(), "root": held[0].tobytes(), "last": layer == len(layers(height_of(n), most)) - 1}
        made |= {c: group.column(c).to_pylist() for c in lists}
        return pa.Table.from_pydict({c: [x] for c, x in made.items()}, schema=arrow)

    return dealt.groupBy("tree", "n", "block").applyInArrow(build, schema)


def siblings(nodes: np.ndarray, n: int, layer: int, block: int, index: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Steps (leaf, level) and sibling digests (leaf, level, byte) of leaves (numbers in their tree's layer) of a block, from the leaf up."""
    heights = layers(height_of(n), most)
    base, height = sum(heights[:layer]), heights[layer]
    steps = np.zeros((len(index), height), np.uint8)
    found = np.zeros((len(index), height, DIGEST), np.uint8)
    for up in range(height):
        at = index >> up
        other = at ^ 1
        there = other < -(-n >> (base + up))
        steps[:, up] = np.where(there, np.where(at & 1, LEFT, RIGHT), LONE)
        inside = other - (block << (height - up))
        found[there, up] = nodes[address(height + 1, height - up, inside[there])]
    return steps, found


def _packed(steps: np.ndarray, found: np.ndarray) -> list[bytes]:
    """Per leaf its steps, each a byte and the sibling's digest after it."""
    whole = np.concatenate([steps[:, :, None], found], axis=2)
    return [w.tobytes() for w in whole]


def unpack(path: bytes) -> list[tuple[int, bytes]]:
    return [(path[i], path[i + 1 : i + 1 + DIGEST].hex().encode()) for i in range(0, len(path), DIGEST + 1)]


def fold(leaf: bytes, path: list[tuple[int, bytes]]) -> bytes:
    """The root that a leaf and its siblings give."""
    for step, other in path:
        leaf = parent(leaf if step == LONE else leaf + other if step == RIGHT else other + leaf)
    return leaf


class Tree:
    """Layers of blocks over numbered leaves (tree, n, idx, digest), each a table in the scratch folder."""

    def __init__(self, nodes: DataFrame, scratch: Scratch, name: str, most: int, lists: list[str] | None = None):
        self.most, self.layers = most, []
        while True:
            at = len(self.layers)
            made = scratch.put(f"{name}{at}", _layer(nodes, at, most, lists or [] if not at else []))
            if at and made.isEmpty():
                break
            self.layers.append(made)
            nodes = made.where("not last").select("tree", "n", F.col("block").alias("idx"), F.col("root").alias("digest"))

    def ends(self) -> DataFrame:
        """(tree, digest): the last node of each tree."""
        return functools.reduce(DataFrame.unionByName, [x.where("last").select("tree", F.col("root").alias("digest")) for x in self.layers])

    def walk(self, above: DataFrame, down_to: int) -> DataFrame:
        """(tree, idx, path, and above's other columns) of the leaves of a layer; above has (tree, path) of each tree's end."""
        extra = [c for c in above.columns if c not in ("tree", "path")]
        met = None
        for at in range(len(self.layers) - 1, down_to - 1, -1):
            met = self._under(self.met(at, above, met), at, extra)
        return met

    def met(self, at: int, above: DataFrame, deeper: DataFrame | None) -> DataFrame:
        """The layer's blocks with the path of each block's root: from the tree's end, or from the layer above."""
        known = above.select(F.col("tree").alias("tree_"), F.lit(0).cast("long").alias("block_"), F.lit(True).alias("last_"), *[c for c in above.columns if c != "tree"])
        if deeper is not None:
            known = known.unionByName(deeper.select(F.col("tree").alias("tree_"), F.col("idx").alias("block_"), F.lit(False).alias("last_"), *[c for c in above.columns if c != "tree"]))
        return self.layers[at].join(known, F.col("tree").eqNullSafe(F.col("tree_")) & (F.col("block") == F.col("block_")) & (F.col("last") == F.col("last_"))).drop("tree_", "block_", "last_")

    def _under(self, blocks: DataFrame, at: int, extra: list[str]) -> DataFrame:
        source = blocks.select("tree", "n", "block", "nodes", "path", *extra)
        schema = T.StructType([source.schema["tree"], T.StructField("idx", T.LongType()), T.StructField("path", T.BinaryType()), *(source.schema[c] for c in extra)])
        arrow, most = to_arrow_schema(schema), self.most

        def run(batches):
            for batch in batches:
                for i in range(batch.num_rows):
                    tree, n, block, nodes, path, *rest = (c[i].as_py() for c in batch.columns)
                    heights = layers(height_of(n), most)
                    size = -(-n >> sum(heights[:at]))
                    index = np.arange(block << heights[at], min(size, (block + 1) << heights[at]), dtype=np.int64)
                    own = _packed(*siblings(np.frombuffer(nodes, np.uint8).reshape(-1, DIGEST), n, at, block, index, most))
                    cols = [[tree] * len(index), index, [p + path for p in own], *([x] * len(index) for x in rest)]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(cols, arrow, strict=True)], schema=arrow)

        return source.mapInArrow(run, schema)


class Manifest:
    """Blocks of all trees and of the tree of their ends."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", tree_col: str = "lang", columns: tuple[str, ...] = COLUMNS, claimed: dict[str, Column] | None = None, block: int = BLOCK):
        self.scratch, self.id_col = Scratch(docs.sparkSession, "merkle"), id_col
        rows = self.scratch.put("leaves", leaves(docs, id_col, tree_col, columns, claimed or {}))
        self.tree = Tree(numbered(rows, ["id", "digest", "row"], self.scratch, "ordered"), self.scratch, "layer", block, ["id", "claim"])
        self.scratch.drop("leaves", "ordered")
        tops = self.tree.ends().select(F.lit(0).alias("tree"), F.col("tree").alias("of"), F.col("digest"))
        self.ends = self.scratch.put("ends", numbered(tops, ["of"], self.scratch, "tops"))
        self.top = Tree(self.ends, self.scratch, "top", block)

    def root(self) -> str | None:
        found = self.top.ends().collect()  # one row at most
        return found[0].digest.hex() if found else None

    def proofs(self, paths: bool = False) -> DataFrame:
        """Per leaf: id, leaf, subroot, root, proof_sha256, folded_root (from the claimed leaf if there is one), verified; with paths, also the siblings."""
        root = self.root()
        start = self.top.ends().select("tree", F.lit(b"").alias("path"))  # the root's path is empty
        of = self.top.walk(start, 0).select("idx", "path")
        named = self.ends.select(F.col("of").alias("tree"), F.hex("digest").alias("subroot"), "idx").join(of, "idx").select("tree", F.lower("subroot").alias("subroot"), "path")
        deeper = self.tree.walk(named, 1) if len(self.tree.layers) > 1 else None
        blocks = self.tree.met(0, named, deeper).select("n", "block", "nodes", "path", "subroot", "id", "claim")
        fields = [T.StructField("id", blocks.schema["id"].dataType.elementType), *(T.StructField(c, T.StringType()) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")), T.StructField("verified", T.BooleanType())]
        if paths:
            fields.append(T.StructField("siblings", T.ArrayType(T.StringType())))
        schema = T.StructType(fields)
        arrow, most = to_arrow_schema(schema), self.tree.most

        def run(batches):
            for batch in batches:
                for i in range(batch.num_rows):
                    n, block, nodes, path, subroot, _, claims = (c[i].as_py() for c in batch.columns)
                    height = layers(height_of(n), most)[0]
                    held = np.frombuffer(nodes, np.uint8).reshape(-1, DIGEST)
                    inside = np.arange(len(claims), dtype=np.int64)
                    own = _packed(*siblings(held, n, 0, block, (block << height) + inside, most))
                    real = [x.tobytes().hex() for x in held[address(height + 1, height, inside)]]
                    upper = unpack(path)
                    proofs, folded, listed = [], [], []
                    for leaf, claim, p in zip(real, claims, own, strict=True):
                        steps = unpack(p) + upper
                        others = [s for step, s in steps if step != LONE]
                        proofs.append(parent(b"".join(others)).decode())
                        folded.append(fold(claim.hex().encode() if claim is not None else leaf.encode(), steps).decode())
                        listed.append([s.decode() for s in others] if paths else None)
                    cols = [batch.column(5)[i].values, real, [subroot] * len(real), [root] * len(real), proofs, folded, [f == root for f in folded]]
                    cols += [listed] if paths else []
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) if isinstance(c, list) else c for c, t in zip(cols, arrow, strict=True)], schema=arrow)

        return blocks.mapInArrow(run, schema).withColumnRenamed("id", self.id_col)


def tampered() -> dict[str, Column]:
    """n_chars one more where 7 divides the CRC-32 of the decimal doc_id."""
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    return {"n_chars": F.when(hit, F.try_add(F.col("n_chars"), F.lit(1))).otherwise(F.col("n_chars"))}
