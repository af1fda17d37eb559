"""Merkle manifest of a dataset in van Emde Boas layout, with sibling proofs.

A leaf is the digest of a row's fields. The leaves of a source, in ascending doc_id, form a tree in
which every 16 consecutive nodes have one parent; the sources' roots form a tree in turn. Trees are
cut into aligned blocks of at most 16 ** 3 leaves. A block is one row: its nodes stand in van Emde
Boas order, where a subtree is its upper half followed by its lower subtrees, each laid out alike,
so that a walk between leaf and root stays in few stretches of the file whatever the page size.
The roots of the blocks are the leaves of the next blocks, until a tree has one block.

Proofs go the other way: the path from the root to a block is computed once for the block and
handed down to the blocks below it, a task meeting one block with its path at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .tables import stored

FAN = 16
#: Levels between a block's leaves and its root, at most: 4,096 leaves.
HEIGHT = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

BLOCK = "tree string, block long, size int, height int, alone boolean, cells binary, root binary"
_PATH = "array<struct<at:int,run:binary>>"
CLIMB = f"tree string, rank long, digest binary, subroot binary, path {_PATH}"
_PATH_ARROW = pa.list_(pa.struct([("at", pa.int32()), ("run", pa.binary())]))


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


@lru_cache(maxsize=64)
def addresses(height: int, depth: int) -> np.ndarray:
    """Where the nodes at ``depth`` below the root stand in a tree of ``height`` levels of children,
    from left to right: the upper half of the levels first, then each lower subtree."""
    if height == 0:
        return np.zeros(1, dtype=np.int64)
    upper = (height + 1) // 2                                  # levels of the upper half
    if depth < upper:
        return addresses(upper - 1, depth)
    above, below = cells(upper - 1), cells(height - upper)
    inner = addresses(height - upper, depth - upper)
    return (above + below * np.arange(FAN ** upper)[:, None] + inner[None, :]).ravel()


def cells(height: int) -> int:
    """Nodes of a full tree."""
    return (FAN ** (height + 1) - 1) // (FAN - 1)


def height_of(leaves: int) -> int:
    """Levels until one node is left."""
    height = 0
    while FAN ** height < leaves:
        height += 1
    return height


def widths(leaves: int, height: int) -> list[int]:
    """Nodes at each depth, from the root to the leaves."""
    out = [leaves]
    for _ in range(height):
        out.append(-(-out[-1] // FAN))
    return out[::-1]


def build(leaves: np.ndarray, height: int) -> tuple[bytes, bytes]:
    """Leaves (n x 32 bytes) -> (nodes in van Emde Boas order, root). What is missing on the right
    of an incomplete tree is left out at the end and zero inside."""
    width = widths(len(leaves), height)
    where = [addresses(height, depth)[:width[depth]] for depth in range(height + 1)]
    out = np.zeros((max(int(x[-1]) for x in where) + 1, 32), dtype=np.uint8)
    out[where[height]] = leaves
    for depth in range(height, 0, -1):
        text = out[where[depth]].tobytes().hex()
        runs = (hashlib.sha256(text[a:a + 64 * FAN].encode()).digest() for a in range(0, len(text), 64 * FAN))
        out[where[depth - 1]] = np.frombuffer(b"".join(runs), dtype=np.uint8).reshape(-1, 32)
    return out.tobytes(), out[0].tobytes()


class Block:
    """A stored block: its leaves and, for each leaf, the runs of siblings up to the block's root."""

    def __init__(self, cell_bytes: bytes, size: int, height: int):
        nodes = np.frombuffer(cell_bytes, dtype=np.uint8).reshape(-1, 32)
        width = widths(size, height)
        #: Hex text of the nodes of each level, from the leaves to the root's children.
        self.levels = [nodes[addresses(height, depth)[:width[depth]]].tobytes().hex() for depth in range(height, 0, -1)]
        self.root, self.size = nodes[0].tobytes().hex(), size
        self.leaves = self.levels[0] if height else self.root

    def path(self, i: int) -> list[tuple[int, str]]:
        """(place in its run, hex text of the run) of leaf i and of its ancestors below the root."""
        out = []
        for text in self.levels:
            run = i // FAN * FAN
            out.append((i - run, text[64 * run:64 * (run + FAN)]))
            i //= FAN
        return out


def fold(node: str, path: list[tuple[int, str]]) -> str:
    """The root that a node and the siblings on its path give."""
    for at, run in path:
        node = digest(run[:64 * at] + node + run[64 * at + 64:])
    return node


def siblings(path: list[tuple[int, str]]) -> str:
    """The digests of a proof, level by level, left to right."""
    return "".join(run[:64 * at] + run[64 * at + 64:] for at, run in path)


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(columns: dict[str, Column]) -> Column:
    """The 32 bytes of a row's leaf."""
    return F.unhex(F.sha2(F.concat(*[_field(columns[c]) for c in FIELDS]).cast("binary"), 256))


def ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows (tree, ..., item) -> the same with rank (from 0) in the order of its tree and total, the
    rows of the tree. ``item`` is different in every row, so no value fills a range partition."""
    sorted_ = rows.repartitionByRange("tree", *order, "item").sortWithinPartitions("tree", *order, "item")
    numbered = F.monotonically_increasing_id()
    placed = stored(sorted_.withColumn("line", numbered).withColumn("part", F.shiftright("line", 33)), "ranked")
    # One row for each tree of each part: a tree lies in as many of them as parts it spans.
    sums = placed.groupBy("tree", "part").agg(F.count(F.lit(1)).alias("n"), F.min("line").alias("first"))
    tree = Window.partitionBy("tree")
    sums = sums.select("tree", "part", (F.sum("n").over(tree.orderBy("part")) - F.col("n") - F.col("first")).alias("shift"),
                       F.sum("n").over(tree).alias("total"))
    return placed.join(sums, ["tree", "part"]).withColumn("rank", F.col("line") + F.col("shift")).drop("line", "part", "shift", "item")


def blocks(nodes: DataFrame, height: int = HEIGHT) -> DataFrame:
    """nodes (tree, rank, total, digest) -> one row for each block of BLOCK; ``alone`` marks the
    only block of a tree, whose root is the tree's."""
    leaves = FAN ** height
    rows = nodes.select("tree", F.expr(f"rank div {leaves}").alias("block"), "rank", "digest", "total")
    rows = rows.repartition("tree", "block").sortWithinPartitions("tree", "block", "rank")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, held, total = None, [], 0

        def close() -> list:
            alone = total <= leaves
            top = height_of(total) if alone else height
            cell_bytes, root = build(np.frombuffer(b"".join(held), dtype=np.uint8).reshape(-1, 32), top)
            return [*name, len(held), top, alone, cell_bytes, root]

        def batch_of(rows: list[list]) -> pa.RecordBatch:
            kinds = (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
                                              names=["tree", "block", "size", "height", "alone", "cells", "root"])
        for batch in batches:
            done = []
            for tree, block, node, n in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3, 4))):
                if (tree, block) != name:
                    if held:
                        done.append(close())
                    name, held, total = (tree, block), [], n
                held.append(node)
            if done:
                yield batch_of(done)
        if held:
            yield batch_of([close()])
    return rows.mapInArrow(run, BLOCK)


def built(nodes: DataFrame, height: int = HEIGHT) -> list[DataFrame]:
    """The stored blocks of all trees, level by level; the last level has one block for each tree left."""
    out = []
    while True:
        level = stored(blocks(nodes, height), "blocks")
        out.append(level)
        rest = level.where("NOT alone")
        if rest.isEmpty():
            return out
        counts = rest.groupBy("tree").agg(F.count(F.lit(1)).alias("total"))
        nodes = rest.select("tree", F.col("block").alias("rank"), F.col("root").alias("digest")).join(counts, "tree")


def _above(climbs: DataFrame) -> DataFrame:
    return climbs.select("tree", F.col("rank").alias("block"), "subroot", "path")


def climbs(level: DataFrame, above: DataFrame) -> DataFrame:
    """Blocks and the path above each (tree, block, subroot, path) -> CLIMB: every leaf of the
    blocks with its path up to the root."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tree, number, size, height, cell_bytes, subroot, path in zip(*(c.to_pylist() for c in batch.columns)):
                block = Block(cell_bytes, size, height)
                every = [[{"at": at, "run": bytes.fromhex(run)} for at, run in block.path(i)] + path for i in range(size)]
                text = bytes.fromhex(block.leaves)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([tree] * size, pa.string()), pa.array(np.arange(size) + number * FAN ** height),
                     pa.array([text[a:a + 32] for a in range(0, len(text), 32)], pa.binary()),
                     pa.array([subroot] * size, pa.binary()), pa.array(every, _PATH_ARROW)], names=["tree", "rank", "digest", "subroot", "path"])
    return level.join(above, ["tree", "block"]).select("tree", "block", "size", "height", "cells", "subroot", "path").mapInArrow(run, CLIMB)


class Manifest:
    """The trees of a dataset: ``rows`` (tree, rank, doc_id, source, digest, claim), the blocks of
    the sources' trees, those of the tree over the sources, and the root (None of an empty table).
    ``claim`` is the leaf a row is said to have, null where it is the row's own."""

    def __init__(self, rows: DataFrame, height: int = HEIGHT):
        """``rows`` (doc_id, source, digest, claim): doc_ids ascend, null ones first; rows with one
        doc_id ascend by digest, and equal ones stand side by side."""
        self.height = height
        named = stored(rows.withColumn("tree", F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))), "leaves")
        self.rows = stored(ranked(named.withColumn("item", F.monotonically_increasing_id()), ["doc_id", "digest"]), "manifest-rows")
        self.levels = built(self.rows.select("tree", "rank", "total", "digest"), height)
        roots = [level.where("alone").select("tree", F.col("root").alias("digest")) for level in self.levels]
        self.subroots = roots[0]
        for more in roots[1:]:
            self.subroots = self.subroots.unionByName(more)
        tops = self.subroots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest", F.monotonically_increasing_id().alias("item"))
        self.sources = stored(ranked(tops, ["name"]), "sources")
        self.tops = built(self.sources.select("tree", "rank", "total", "digest"), height)
        last = self.tops[-1].first()
        self.root: str | None = last["root"].hex() if last else None

    def source_paths(self) -> DataFrame:
        """(tree, subroot, path): the way from each source's root to the root of all."""
        above = self.tops[-1].select("tree", "block", F.lit(None).cast("binary").alias("subroot"), F.array().cast(_PATH).alias("path"))
        for level in self.tops[:0:-1]:
            above = _above(climbs(level, above))
        found = climbs(self.tops[0], above)
        return found.select("rank", F.col("digest").alias("subroot"), "path").join(self.sources.select("rank", F.col("name").alias("tree")), "rank").select(
            "tree", "subroot", "path")

    def block_paths(self) -> DataFrame:
        """(tree, block, subroot, path) of every block of leaves."""
        sources = stored(self.source_paths(), "paths")
        above = None
        for number, level in reversed(list(enumerate(self.levels))):
            own = level.where("alone").select("tree", "block").join(sources, "tree")
            above = own if above is None else own.unionByName(_above(above))
            if number:
                above = climbs(level, above)
        return stored(above, "paths")

    def proofs(self, wanted: DataFrame | None = None) -> DataFrame:
        """(doc_id, source, leaf, path) of the rows whose doc_id stands in wanted (doc_id), or of all."""
        rows = self.rows if wanted is None else self.rows.join(wanted.select("doc_id").distinct(), "doc_id", "left_semi")
        hit = rows.select("tree", F.expr(f"rank div {FAN ** self.height}").alias("block")).distinct()
        found = climbs(self.levels[0].join(hit, ["tree", "block"], "left_semi"), self.block_paths())
        return rows.join(found.select("tree", "rank", "path"), ["tree", "rank"]).select("doc_id", "source", F.col("digest").alias("leaf"), "path")

    def verified(self) -> DataFrame:
        """Every row's claim folded with its siblings: (doc_id, source, leaf, subroot, root,
        proof_sha256, folded_root, verified). ``verified`` tells whether the claim gives the root."""
        leaves, root = FAN ** self.height, self.root
        # At most 4,096 claims meet their block and its path.
        claims = self.rows.groupBy("tree", F.expr(f"rank div {leaves}").alias("block")).agg(
            F.first("source").alias("source"), F.collect_list(F.struct("rank", "doc_id", "claim")).alias("claims"))
        met = claims.join(self.levels[0], ["tree", "block"]).join(self.block_paths(), ["tree", "block"]).select(
            "source", "claims", "size", "height", "cells", "subroot", "path")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for source, claims, size, height, cell_bytes, subroot, above in zip(*(c.to_pylist() for c in batch.columns)):
                    block = Block(cell_bytes, size, height)
                    upper = [(x["at"], x["run"].hex()) for x in above]
                    rest, ends = siblings(upper), {}                  # most claims reach the same block root
                    out = []
                    for claim in claims:
                        i = claim["rank"] % leaves
                        own, path = block.leaves[64 * i:64 * i + 64], block.path(i)
                        reached = fold(own if claim["claim"] is None else claim["claim"].hex(), path)
                        if reached not in ends:
                            ends[reached] = fold(reached, upper)
                        out.append((claim["doc_id"], own, digest(siblings(path) + rest), ends[reached], ends[reached] == root))
                    doc_ids, own, proof, folded, same = zip(*out)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(doc_ids, pa.int64()), pa.array([source] * len(out), pa.string()), pa.array(own), pa.array([subroot.hex()] * len(out)),
                         pa.array([root] * len(out), pa.string()), pa.array(proof), pa.array(folded), pa.array(same)],
                        names=["doc_id", "source", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])
        return met.mapInArrow(run, "doc_id long, source string, leaf string, subroot string, root string, proof_sha256 string, "
                                   "folded_root string, verified boolean")


_UPPER = "".join(map(chr, range(65, 91)))


def documents(docs: DataFrame, height: int = HEIGHT) -> Manifest:
    """The manifest of docs (doc_id, source, lang, n_chars, text, ...). Nulls are fields of their
    own, empty texts too; an empty table has no root. Where 5 divides crc32(doc_id as text), the
    claim is the leaf of the row with the A-Z of its text lower-cased; other rows (those without
    doc_id included) claim their own leaf."""
    columns = {c: F.col(c) for c in FIELDS}
    changed = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    claim = F.when(changed, leaf({**columns, "text": F.translate("text", _UPPER, _UPPER.lower())}))
    return Manifest(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", leaf(columns).alias("digest"), claim.alias("claim")), height)
