"""Byte-level BPE from a rank file by the tokenizers library, with offsets, and its inverse.

A rank file lists byte strings by rank. The library works on characters, so each byte is mapped to
a printable character; every split of a token into two tokens becomes a merge, in the order of the
merged token's rank. Decoding maps ids back to bytes; characters split over tokens come together
when the bytes are joined, and ``decode_text`` shows what is no UTF-8 by the replacement character.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .tokens import UnitEncoder, byte_characters


@lru_cache(maxsize=4)
def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def build_tokenizer(ranks: dict[bytes, int], pattern: str):
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers
    letters = byte_characters()
    spelt = {token: "".join(letters[b] for b in token) for token in ranks}
    merges = []
    for token, _ in sorted(ranks.items(), key=lambda x: x[1]):
        merges += [(spelt[token[:i]], spelt[token[i:]]) for i in range(1, len(token)) if token[:i] in ranks and token[i:] in ranks]
    tokenizer = Tokenizer(models.BPE(vocab={spelt[t]: r for t, r in ranks.items()}, merges=merges, ignore_merges=True))
    tokenizer.pre_tokenizer = pre_tokenizers.Sequence([
        pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return tokenizer


def encoder(path: str, pattern: str) -> UnitEncoder:
    return UnitEncoder.of((path, pattern), lambda: (build_tokenizer(read_ranks(path), pattern), False))


@lru_cache(maxsize=4)
def byte_table(path: str) -> list[bytes]:
    ranks = read_ranks(path)
    table = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        table[rank] = token
    return table


@lru_cache(maxsize=4)
def byte_lengths(path: str) -> np.ndarray:
    return np.array([len(x) for x in byte_table(path)], dtype=np.int64)


def decode(path: str, ids: np.ndarray) -> bytes:
    """The bytes of a list of ids; an id outside the table is an error."""
    return b"".join(map(byte_table(path).__getitem__, ids.tolist()))


def decode_text(path: str, ids: np.ndarray) -> str:
    return decode(path, ids).decode("utf-8", "replace")


def offsets(path: str, ids: np.ndarray) -> np.ndarray:
    """The byte position at which each id starts in its text, and the text's length in bytes."""
    return np.concatenate(([0], np.cumsum(byte_lengths(path)[ids])))


def _encoded(batches: Iterator[pa.RecordBatch], path: str, pattern: str) -> Iterator[tuple[pa.Array, list[np.ndarray], list[np.ndarray]]]:
    """For each batch (doc_id, text): doc_ids, ids, and byte offsets of the ids with the text's end."""
    coder = encoder(path, pattern)
    for batch in batches:
        ids = [np.frombuffer(x, dtype="<u4") for x in coder.ids([x or "" for x in batch.column(1).to_pylist()])]
        yield batch.column(0), ids, [offsets(path, x) for x in ids]


def encoded(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """docs (doc_id, text, ...) -> (doc_id, ids, starts): ids of the whole text and the byte
    position of each; null texts are empty, null doc_ids and repeated rows stay as they are."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_ids, ids, at in _encoded(batches, path, pattern):
            yield pa.RecordBatch.from_arrays([doc_ids, pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())),
                                              pa.array([x[:-1] for x in at], pa.list_(pa.int64()))], names=["doc_id", "ids", "starts"])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, ids array<int>, starts array<long>")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, n_bytes, ids_sha256, decoded_sha256) of whole texts: the rows of encoded()
    decoded and digested in the task that made them, so ids do not travel. Offsets that do not end
    where the decoded bytes end are an error."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_ids, ids, at in _encoded(batches, path, pattern):
            ends, found = [int(x[-1]) for x in at], []
            for of_doc, end in zip(ids, ends):
                back = decode(path, of_doc)
                if len(back) != end:
                    raise ValueError(f"offsets end at byte {end} of {len(back)}")
                found.append((hashlib.sha256(of_doc.tobytes()).hexdigest(), hashlib.sha256(back).hexdigest()))
            yield pa.RecordBatch.from_arrays(
                [doc_ids, pa.array([len(x) for x in ids], pa.int64()), pa.array(ends, pa.int64()),
                 *[pa.array([x[i] for x in found], pa.string()) for i in (0, 1)]],
                names=["doc_id", "n_tokens", "n_bytes", "ids_sha256", "decoded_sha256"])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, n_tokens long, n_bytes long, ids_sha256 string, decoded_sha256 string")
