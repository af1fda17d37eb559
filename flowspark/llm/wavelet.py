"""Token shards as wavelet matrices: one compressed file per shard that answers token access,
counting and occurrence lookup.

A shard is a run of whole documents in doc_id order. Its ids are stored as bit planes: plane 0 has
the top bit of every id in order; before each further plane the ids are split stably, zeros first.
Following one id through the planes by rank gives its value, counting and looking up a value go the
same way. ``WaveletFile`` is such a file; Spark keeps the files of a corpus as binary rows of a
Parquet table, so that they are committed and found like any table.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from .tables import stored
from .tokens import file_encoder

END_ID = 0
#: A shard is closed by the document that brings it to so many ids.
SHARD_TOKENS = 1 << 20
_MAGIC = b"WVMX"
_WORDS = 8                    # a rank entry for each 8 words of 64 bits

Encode = Callable[[list[str]], list[bytes]]


def _rank_directory(plane: np.ndarray) -> np.ndarray:
    """Ones before each block of 512 bits of a plane (uint64 words)."""
    ones = np.add.reduceat(np.bitwise_count(plane).astype(np.uint64), np.arange(0, max(len(plane), 1), _WORDS)) if len(plane) else np.zeros(0, np.uint64)
    return np.concatenate(([0], np.cumsum(ones))).astype("<u8")


class WaveletFile:
    """Ids of one shard and the documents they belong to."""

    def __init__(self, n: int, bits: int, zeros: list[int], planes: list[np.ndarray], ranks: list[np.ndarray],
                 docs: list[int | None], lengths: np.ndarray):
        self.n, self.bits, self.zeros, self.planes, self.ranks, self.docs, self.lengths = n, bits, zeros, planes, ranks, docs, lengths

    @classmethod
    def build(cls, ids: np.ndarray, docs: list[int | None], lengths: np.ndarray) -> WaveletFile:
        bits = max(int(ids.max(initial=0)).bit_length(), 1)
        order, zeros, planes = ids.astype(np.uint16 if bits <= 16 else np.uint32), [], []
        for level in range(bits - 1, -1, -1):
            ones = (order & order.dtype.type(1 << level)) != 0
            packed = np.packbits(ones, bitorder="little")
            plane = np.zeros(-(-len(ids) // 64), dtype="<u8")
            plane.view(np.uint8)[:len(packed)] = packed
            planes.append(plane)
            low = order[~ones]
            zeros.append(len(low))
            order = np.concatenate([low, order[ones]])
        return cls(len(ids), bits, zeros, planes, [_rank_directory(p) for p in planes], docs, lengths)

    def to_bytes(self) -> bytes:
        known = np.array([d is not None for d in self.docs], dtype=bool)
        head = struct.pack("<4sIQQ", _MAGIC, self.bits, self.n, len(self.docs))
        sections = [np.array(self.zeros, "<u8"), np.array([d or 0 for d in self.docs], "<i8"), np.packbits(known),
                    self.lengths.astype("<u8"), *self.planes, *self.ranks]
        packer = zstandard.ZstdCompressor(level=1)
        out = [head]
        for section in sections:
            body = packer.compress(section.tobytes())
            out += [struct.pack("<Q", len(body)), body]
        return b"".join(out)

    @classmethod
    def from_bytes(cls, data: bytes) -> WaveletFile:
        magic, bits, n, docs = struct.unpack_from("<4sIQQ", data)
        if magic != _MAGIC:
            raise ValueError("not a wavelet file")
        at, unpack, parts = struct.calcsize("<4sIQQ"), zstandard.ZstdDecompressor(), []
        while at < len(data):
            size, = struct.unpack_from("<Q", data, at)
            parts.append(unpack.decompress(data[at + 8:at + 8 + size]))
            at += 8 + size
        known = np.unpackbits(np.frombuffer(parts[2], np.uint8))[:docs].astype(bool)
        ids = np.frombuffer(parts[1], "<i8")
        return cls(n, bits, np.frombuffer(parts[0], "<u8").tolist(), [np.frombuffer(x, "<u8") for x in parts[4:4 + bits]],
                   [np.frombuffer(x, "<u8") for x in parts[4 + bits:4 + 2 * bits]],
                   [int(d) if k else None for d, k in zip(ids, known)], np.frombuffer(parts[3], "<u8").astype(np.int64))

    def _ones(self, level: int) -> np.ndarray:
        return np.unpackbits(self.planes[level].view(np.uint8), count=self.n, bitorder="little").view(bool)

    def _rank1(self, level: int, i: int) -> int:
        """Ones among the first i bits of a plane."""
        plane, block = self.planes[level], i // 64 // _WORDS
        total = int(self.ranks[level][block]) + int(np.bitwise_count(plane[block * _WORDS:i // 64]).sum())
        return total + ((int(plane[i // 64]) & ((1 << (i % 64)) - 1)).bit_count() if i % 64 else 0)

    def _select(self, level: int, one: bool, k: int) -> int:
        """Position of the k-th (from 0) bit of this value in a plane."""
        low, high = 0, self.n
        while low + 1 < high:                      # the last position with at most k before it
            middle = (low + high) // 2
            before = self._rank1(level, middle)
            low, high = (middle, high) if (before if one else middle - before) <= k else (low, middle)
        return low

    def access(self, i: int) -> int:
        """The id at position i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level in range(self.bits):
            ones, one = self._rank1(level, i), (int(self.planes[level][i // 64]) >> (i % 64)) & 1
            i = self.zeros[level] + ones if one else i - ones
            value = value << 1 | one
        return value

    def _range(self, token: int, a: int, b: int) -> tuple[int, int]:
        for level in range(self.bits):
            x, y = self._rank1(level, a), self._rank1(level, b)
            one = token >> (self.bits - 1 - level) & 1
            a, b = (self.zeros[level] + x, self.zeros[level] + y) if one else (a - x, b - y)
        return a, b

    def count(self, token: int, start: int = 0, end: int | None = None) -> int:
        """Occurrences of an id at positions start <= i < end."""
        if token >> self.bits:
            return 0
        a, b = self._range(token, start, self.n if end is None else end)
        return b - a

    def occurrence(self, token: int, k: int) -> int:
        """Position of the k-th (from 0) occurrence of an id."""
        if not 0 <= k < self.count(token):
            raise IndexError(k)
        i = self._range(token, 0, self.n)[0] + k
        for level in range(self.bits - 1, -1, -1):
            one = bool(token >> (self.bits - 1 - level) & 1)
            i = self._select(level, one, i - self.zeros[level] if one else i)
        return i

    def ids(self) -> np.ndarray:
        """All ids in order: the planes' splits undone from the last to the first."""
        values = np.zeros(self.n, dtype=np.uint16 if self.bits <= 16 else np.uint32)
        for level in range(self.bits - 1, -1, -1):
            ones, before = self._ones(level), np.empty_like(values)
            zeros = self.zeros[level]
            before[~ones] = values[:zeros]
            before[ones] = values[zeros:] | values.dtype.type(1 << (self.bits - 1 - level))
            values = before
        return values.astype("<u4")


def shards(docs: DataFrame, encode: Callable[[], Encode], shard_tokens: int = SHARD_TOKENS, end_id: int = END_ID) -> DataFrame:
    """docs (doc_id, text, ...) -> (part, shard, n_tokens, file): the whole corpus in ascending
    doc_id order of (part, shard). Null texts are empty, null doc_ids come first; repeated doc_ids
    are ordered by a hash of the text, equal rows stand side by side. A task holds one shard."""
    sorted_ = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tie"),
                          F.monotonically_increasing_id().alias("row"))
    sorted_ = sorted_.repartitionByRange("doc_id", "tie", "row").sortWithinPartitions("doc_id", "tie", "row").select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, end, part = encode(), np.array([end_id], dtype="<u4").tobytes(), TaskContext.get().partitionId()
        held: list[tuple[int | None, bytes]] = []
        size = number = 0

        def close() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(x for _, x in held), dtype="<u4")
            lengths = np.array([len(x) // 4 for _, x in held], dtype=np.int64)
            file = WaveletFile.build(ids, [d for d, _ in held], lengths).to_bytes()
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([len(ids)], pa.int64()),
                                               pa.array([file], pa.binary())], names=["part", "shard", "n_tokens", "file"])
        for batch in batches:
            for doc, ids in zip(batch.column(0).to_pylist(), ids_of([x or "" for x in batch.column(1).to_pylist()])):
                held.append((doc, ids + end))
                size += len(ids) // 4 + 1
                if size >= shard_tokens:
                    yield close()
                    held, size, number = [], 0, number + 1
        if held:
            yield close()
    return sorted_.mapInArrow(run, "part int, shard int, n_tokens long, file binary")


def shard_starts(files: DataFrame) -> DataFrame:
    """(part, shard, first): ids of the corpus before each shard, from the sums of the parts (one
    row for each written part) and running sums inside them."""
    sums = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    parts = sums.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    inside = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("shard")) - F.col("n_tokens")
    return files.select("part", "shard", inside.alias("inside")).join(parts, "part").select(
        "part", "shard", (F.col("base") + F.col("inside")).alias("first"))


def documents_of(files: DataFrame) -> DataFrame:
    """Read the files back: (doc_id, start, n_tokens, ids_crc32) of every document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, shard, data in zip(batch.column(0), batch.column(1), batch.column(2)):
                file = WaveletFile.from_bytes(data.as_py())
                ids, ends = file.ids(), np.cumsum(file.lengths)
                starts = ends - file.lengths
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(starts.tolist(), ends.tolist())]
                n = len(crc)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part.as_py()] * n, pa.int32()), pa.array([shard.as_py()] * n, pa.int32()), pa.array(file.docs, pa.int64()),
                     pa.array(starts), pa.array(file.lengths), pa.array(crc, pa.int64())],
                    names=["part", "shard", "doc_id", "inside", "n_tokens", "ids_crc32"])
    rows = files.select("part", "shard", "file").mapInArrow(
        run, "part int, shard int, doc_id long, inside long, n_tokens long, ids_crc32 long")
    return rows.join(shard_starts(files), ["part", "shard"]).select(
        "doc_id", (F.col("first") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def written(docs: DataFrame, tokenizer: str, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """The stored table of wavelet files of docs; ``tokenizer`` is the path of a byte-level vocabulary."""
    return stored(shards(docs, lambda: file_encoder(tokenizer).ids, shard_tokens), "wavelet")
