"""Best-fit packing of tokenised documents, certified by lower bounds, with repacking.

Documents become pieces of at most one sequence. Pieces are dealt to groups by a hash; a group packs
its pieces best-fit decreasing and compares its number of sequences with the largest of several
dual-feasible-function bounds. Where they are equal no packing of that group is better and it is
final. A group with a gap releases its loosest sequences, as many as hold the gap in free places;
released sequences of all groups are dealt anew, whole, to groups of the same size and repacked, as
long as that saves sequences. A round moves a small part of the round before, and no group grows.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .tables import stored
from .tokens import file_encoder

SEQUENCE = 4096
END_ID = 1
#: Pieces of a group, at most but for chance: a group is one task's work, and is dealt four fifths of this.
GROUP_PIECES = 1 << 16
Encode = Callable[[list[str]], list[bytes]]

PIECE = "item long, doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = f"{PIECE}, sequence_id long, offset long, loose boolean"


def pieces(docs: DataFrame, encode: Callable[[], Encode], sequence: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """One row for each piece of each document: ids with the end id, cut every ``sequence`` ids.
    A null text is an empty one. ``item`` numbers the pieces of this table."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, end = encode(), np.array([end_id], dtype="<u4").tobytes()
        item = TaskContext.get().partitionId() << 40
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for doc, ids in zip(batch.column(0).to_pylist(), ids_of([x or "" for x in batch.column(1).to_pylist()])):
                ids += end
                for piece, at in enumerate(range(0, len(ids), 4 * sequence)):
                    part = ids[at:at + 4 * sequence]
                    for column, value in zip(out, (item, doc, piece, at // 4, len(part) // 4, zlib.crc32(part))):
                        column.append(value)
                    item += 1
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)],
                                             names=["item", "doc_id", "piece", "start", "length", "ids_crc32"])
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECE)


def lower_bound(lengths: np.ndarray, sequence: int = SEQUENCE) -> int:
    """The largest of the bounds by dual-feasible functions: rounding to the k-th parts of a
    sequence, and, for every cut c up to half a sequence, counting pieces above sequence - c as
    whole and leaving out those below c."""
    count = np.bincount(lengths, minlength=sequence + 1)
    size = np.arange(sequence + 1)
    whole, load = np.cumsum(count[::-1])[::-1], np.cumsum((count * size)[::-1])[::-1]
    whole, load = np.append(whole, 0), np.append(load, 0)
    c = np.arange(sequence // 2 + 1)
    best = int(np.max(-(-(whole[sequence - c + 1] * sequence + load[c] - load[sequence - c + 1]) // sequence)))
    for k in range(1, 33):
        scaled = (k + 1) * size
        exact = scaled % sequence == 0
        # In units of sequence * k: exact sizes keep their value, others lose their fraction.
        value = np.where(exact, size * k, scaled // sequence * sequence)
        best = max(best, -(-int((count * value).sum()) // (sequence * k)))
    return best


def best_fit(lengths: np.ndarray, sequence: int = SEQUENCE) -> tuple[np.ndarray, np.ndarray, int]:
    """Best-fit decreasing: (sequence number, offset) of each length, and the sequences used."""
    bins, offsets, used = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0
    free: list[list[int]] = [[] for _ in range(sequence + 1)]
    some = 0                                        # bit r: a sequence with r free places is open
    for i in np.argsort(-lengths, kind="stable").tolist():
        length = int(lengths[i])
        fit = some >> length
        if fit:
            room = length + (fit & -fit).bit_length() - 1
            into = free[room].pop()
            if not free[room]:
                some ^= 1 << room
        else:
            room, into = sequence, used
            used += 1
        bins[i], offsets[i] = into, sequence - room
        if room > length:
            free[room - length].append(into)
            some |= 1 << (room - length)
    return bins, offsets, used


def loosest(free: np.ndarray, gap: int, sequence: int = SEQUENCE) -> np.ndarray:
    """The sequences with most free places that together have the gap in them."""
    order = np.argsort(-free, kind="stable")
    return order[:int(np.searchsorted(np.cumsum(free[order]), gap * sequence)) + 1]


def _packed(items: DataFrame, groups: int, attempt: int, sequence: int) -> DataFrame:
    """Items (of whole sequences, from the second attempt on) packed in groups; ``loose`` marks the
    sequences that a group with a gap releases. A group that saves nothing keeps what it was dealt."""
    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        part = int(rows["part"].iloc[0])
        rows = rows.drop(columns="part").sort_values("item", ignore_index=True)
        lengths = rows["length"].to_numpy()
        bins, offsets, used = best_fit(lengths, sequence)
        if attempt and used >= rows["sequence_id"].nunique():
            return rows.assign(loose=False)
        gap, loose = used - lower_bound(lengths, sequence), np.zeros(used, dtype=bool)
        if gap:
            loose[loosest(sequence - np.bincount(bins, weights=lengths).astype(np.int64), gap, sequence)] = True
        return rows.assign(sequence_id=((attempt << 56) | (part << 28)) + bins, offset=offsets, loose=loose[bins])
    dealt = items.select(*(c for c in items.columns if c != "loose"), F.pmod(
        F.xxhash64("sequence_id" if attempt else "item", F.lit(attempt)), F.lit(groups)).alias("part"))
    return dealt.groupBy("part").applyInPandas(pack, PACKED)


def pack(cut: DataFrame, sequence: int = SEQUENCE, group_pieces: int = GROUP_PIECES, rounds: int | None = None) -> DataFrame:
    """pieces() -> the same rows with sequence_id and offset. Pieces as long as a sequence stand
    alone. An empty table gives an empty result; equal lengths and repeated rows are just more pieces,
    placed in the order of ``item``. Released sequences are exchanged until fewer than two groups
    release any, a round saves nothing, or for ``rounds``."""
    cut = stored(cut, "pieces")
    unplaced = cut.withColumn("sequence_id", -F.col("item") - 1).withColumn("offset", F.lit(0).cast("long")).withColumn("loose", F.lit(False))
    done, pool, saved = [unplaced.where(F.col("length") == sequence)], unplaced.where(F.col("length") < sequence), True
    for attempt in count():
        n = pool.agg(F.count(F.lit(1)), F.count_distinct("sequence_id")).first()
        if not n[0] or not saved or attempt == rounds:
            break
        packed = stored(_packed(pool, max(1, -(-5 * n[0] // (4 * group_pieces))), attempt, sequence), "packed")
        after = packed.agg(F.count_distinct("sequence_id"), F.count_distinct(F.when(F.col("loose"), F.shiftright("sequence_id", 28)))).first()
        saved = after[0] < n[1]
        if after[1] < 2:
            return _all([*done, packed])
        done, pool = [*done, packed.where(~F.col("loose"))], packed.where("loose")
    return _all([*done, pool])


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.drop("loose", "item")


def packed_documents(docs: DataFrame, tokenizer: str, sequence: int = SEQUENCE, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """docs (doc_id, text, ...) -> (doc_id, piece, start, length, ids_crc32, sequence_id, offset).
    ``tokenizer`` is the path of a vocabulary that drops white space. Null texts are empty (one
    piece, the end id), null doc_ids are kept as null, repeated rows are packed each."""
    return pack(pieces(docs, lambda: file_encoder(tokenizer, words=True).ids, sequence), sequence, group_pieces)
