"""SimHash near-duplicates through a Gray-order hierarchical index.

Fingerprints are 64 bits over word shingles. Two fingerprints that differ in at most four bits
agree on at least two of six bit blocks, so the fifteen masks of two blocks are the upper nodes of
the index: a masked bit pattern is the partitioning key, and every link lies below one of them.
Below a node the codes are sorted by Gray rank, in which neighbours differ in few bits. Runs of
codes are factored into inner nodes that hold the bits shared by the whole run; the differences of
two nodes on their shared bits bound those of all their codes, so whole groups are pruned together.
Each node is reduced to a forest before it leaves its task: no more edges than codes.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .components import components
from .tables import stored

SHINGLE_WORDS = 4
MAX_BITS = 4
SEED = 42
#: Codes below one upper node that one task compares; larger nodes are cut into tiles.
TILE_CODES = 4096
#: Codes of a leaf, and children of an inner node.
LEAF = 16
_BLOCKS = (11, 11, 11, 11, 10, 10)
_PIECE = 1 << 16


def _masks() -> list[int]:
    ends = np.cumsum((0, *_BLOCKS))
    parts = [((1 << int(b)) - 1) ^ ((1 << int(a)) - 1) for a, b in zip(ends, ends[1:])]
    return [a | b for a, b in combinations(parts, len(_BLOCKS) - MAX_BITS)]


MASKS = np.array(_masks(), dtype=np.uint64)


def fingerprint(text: bytes | None, words_each: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """Unsigned fingerprint of a UTF-8 text: A-Z lower-cased, words between ASCII white space,
    shingles with repeats. A text without words (null included) has fingerprint 0."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined, each = b" ".join(words), min(words_each, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - each + 1]
    ends = ends[each - 1:]
    ones, digest = np.zeros(64, dtype=np.int64), xxhash.xxh64_intdigest
    for at in range(0, len(starts), _PIECE):
        pieces = zip(starts[at:at + _PIECE].tolist(), ends[at:at + _PIECE].tolist())
        hashes = np.array([digest(joined[a:b], seed) for a, b in pieces], dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    bits = np.packbits(2 * ones > len(starts), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, words_each: int = SHINGLE_WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, code): one row for each row of docs; code is the fingerprint as a signed long."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            codes = np.array([fingerprint(t.as_py(), words_each, seed) for t in texts], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(codes.view(np.int64))], names=["doc_id", "code"])
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, code long")


def _gray_rank(code: Column) -> Column:
    for shift in (1, 2, 4, 8, 16, 32):
        code = code.bitwiseXOR(F.shiftrightunsigned(code, shift))
    return code


def _shared(values: np.ndarray, known: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Factor runs of ``size`` nodes: the bits that all of a run know and agree on."""
    at = np.arange(0, len(values), size)
    ones = np.bitwise_and.reduceat(values & known, at)
    zeros = np.bitwise_and.reduceat(~values & known, at)
    return ones, ones | zeros


def index_pairs(codes: np.ndarray, most: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Positions i < j of codes (unsigned, in Gray order) that differ in at most ``most`` bits."""
    levels = [(codes, np.full(len(codes), ~np.uint64(0)))]
    while len(levels[-1][0]) > LEAF:
        levels.append(_shared(*levels[-1], LEAF))
    a, b = np.triu_indices(len(levels[-1][0]))
    for depth in range(len(levels) - 1, -1, -1):
        values, known = levels[depth]
        near = np.bitwise_count((values[a] ^ values[b]) & known[a] & known[b]) <= most
        a, b = a[near], b[near]
        if depth:
            n, child = len(levels[depth - 1][0]), np.arange(LEAF)
            left = (a[:, None, None] * LEAF + child[:, None]) + np.zeros((1, 1, LEAF), dtype=np.int64)
            right = (b[:, None, None] * LEAF + child[None, :]) + np.zeros((1, LEAF, 1), dtype=np.int64)
            ok = (left <= right) & (right < n)
            a, b = left[ok], right[ok]
    apart = a < b
    return a[apart], b[apart]


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest position that each of n positions reaches over the links a-b."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _links(node: np.ndarray, codes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Forest edges of all nodes of one stretch of rows, sorted by node and Gray rank."""
    starts = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1])))
    sizes = np.diff(np.append(starts, len(node)))
    firsts, seconds = [], []
    small = np.repeat(sizes <= 2 * LEAF, sizes)
    for lag in range(1, min(2 * LEAF, int(sizes.max(initial=0)))):
        at = np.flatnonzero((node[lag:] == node[:-lag]) & small[lag:])
        at = at[np.bitwise_count(codes[at] ^ codes[at + lag]) <= most]
        firsts.append(at)
        seconds.append(at + lag)
    for start, size in zip(starts[sizes > 2 * LEAF], sizes[sizes > 2 * LEAF]):
        a, b = index_pairs(codes[start:start + size], most)
        firsts.append(a + start)
        seconds.append(b + start)
    if not firsts:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    root = _forest(len(codes), np.concatenate(firsts), np.concatenate(seconds))
    at = np.flatnonzero(root != np.arange(len(codes)))
    return at, root[at]


def linked_codes(codes: DataFrame, most: int = MAX_BITS, tile: int = TILE_CODES) -> DataFrame:
    """codes: distinct (code) -> edges (u, v) whose components are those of all links of at most
    ``most`` (up to 4) differing bits."""
    if most > MAX_BITS:
        raise ValueError(f"the masks find links of at most {MAX_BITS} bits")
    masks = F.array(*[F.lit(int(m)) for m in MASKS.view(np.int64)])
    keyed = codes.select("code", F.posexplode(masks).alias("mask_no", "mask")).select(
        F.col("mask_no").cast("byte").alias("mask_no"), F.col("code").bitwiseAND(F.col("mask")).alias("node"), "code")
    # A node with more codes than a tile is cut into slices; each pair of slices is a tile.
    large = keyed.groupBy("mask_no", "node").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > tile).select(
        "mask_no", "node", F.ceil(F.col("n") / tile).cast("long").alias("slices"))
    cut = keyed.join(large, ["mask_no", "node"], "left")
    own = F.pmod(F.xxhash64("code"), F.col("slices"))
    tiles = F.when(F.col("slices").isNull(), F.array(F.lit(0).cast("long"))).otherwise(F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("slices") - 1),
        lambda other: F.least(own, other) * F.col("slices") + F.greatest(own, other)))
    rows = cut.select("mask_no", "node", "code", F.explode(tiles).alias("tile"))
    rows = rows.repartition("mask_no", "node", "tile").sortWithinPartitions(
        "mask_no", "node", "tile", F.shiftrightunsigned(_gray_rank(F.col("code")), 1), _gray_rank(F.col("code")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None

        def edges(part: list[np.ndarray]) -> pa.RecordBatch:
            new = np.zeros(len(part[0]), dtype=bool)
            new[1:] = (part[0][1:] != part[0][:-1]) | (part[1][1:] != part[1][:-1]) | (part[3][1:] != part[3][:-1])
            a, b = _links(np.cumsum(new), part[2].view(np.uint64), most)
            return pa.RecordBatch.from_arrays([pa.array(part[2][a]), pa.array(part[2][b])], names=["u", "v"])

        for batch in batches:
            now = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if not len(now[0]):
                continue
            if held is not None:
                now = [np.concatenate(x) for x in zip(held, now)]
            last = [x[-1] for x in now]
            open_at = len(now[0]) - int(np.argmin(np.append(
                ((now[0] == last[0]) & (now[1] == last[1]) & (now[3] == last[3]))[::-1], False)))
            held = [x[open_at:] for x in now]
            if open_at:
                yield edges([x[:open_at] for x in now])
        if held is not None:
            yield edges(held)
    return rows.mapInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame, words_each: int = SHINGLE_WORDS, most: int = MAX_BITS, seed: int = SEED) -> DataFrame:
    """(doc_id, fingerprint, component_id), one row for each row of docs (doc_id, text, ...).

    Null and blank texts have fingerprint zero and are linked like any other. component_id is the
    smallest doc_id of the component; rows without doc_id take part, and it is null only where no
    row of the component has one. Repeated rows give repeated result rows. Other columns of docs
    are not read. Exact copies meet in one code before anything is compared."""
    marked = stored(fingerprints(docs, words_each, seed), "codes")
    classes = stored(marked.groupBy("code").agg(F.min("doc_id").alias("least")), "classes")
    roots = components(linked_codes(classes.select("code"), most))
    named = classes.join(roots.withColumnRenamed("node", "code"), "code", "left").select(
        "code", "least", F.coalesce("root", "code").alias("root"))
    smallest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    whole = named.select("code", "root").join(smallest, "root").select(F.col("code").alias("class_code"), "component_id")
    return marked.join(whole, marked["code"] == whole["class_code"]).select(
        "doc_id", F.lpad(F.lower(F.hex("code")), 16, "0").alias("fingerprint"), "component_id")


def representatives(docs: DataFrame, classes: DataFrame | None = None) -> DataFrame:
    """The rows of docs, all columns, that stay when each component keeps its smallest doc_id. Of
    rows that repeat this doc_id one stays (the smallest by its text). Rows without doc_id stay.
    ``classes`` (doc_id, component_id) are those of near_duplicates() where none are given."""
    if classes is None:
        classes = near_duplicates(docs.select("doc_id", "text"))
    chosen = stored(classes.where("doc_id = component_id").groupBy(F.col("doc_id").alias("chosen_id")).agg(
        F.count(F.lit(1)).alias("times")), "chosen")

    def named(times: str) -> DataFrame:
        # One shuffle of docs at every size: both calls share its exchange.
        ids = chosen.where(times).select("chosen_id").hint("merge")
        return docs.join(ids, docs["doc_id"].cast("long") == ids["chosen_id"], "left_semi")
    single, repeated = named("times = 1"), named("times > 1")
    one = repeated.select("doc_id", F.struct("text", F.xxhash64(*docs.columns)).alias("place"),
                          F.struct(*[F.col(c) for c in docs.columns]).alias("whole")).groupBy("doc_id").agg(
        F.min_by("whole", "place").alias("whole")).select("whole.*")
    return single.unionByName(one).unionByName(docs.where(F.col("doc_id").isNull()))
