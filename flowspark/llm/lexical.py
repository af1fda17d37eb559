"""Ranked lexical search without a document index: an Aho-Corasick scan of whole texts.

The terms of all items form one automaton, each between two boundary characters, so that only whole
terms match. It is sent to every task and counts the items' terms straight from the text; its outputs
map to items. One pass over the documents leaves their lengths and the counts of the items' terms,
from which the statistics of the corpus follow. Scores are computed where the counts lie, and every
task keeps the best documents of each item before anything is shuffled.

Items are the query set. They are met in blocks of bounded size, each with an automaton and a pass
of its own, so an item table of any size passes through in turn.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .tables import stored

TOP = 10
#: Terms (with repeats) of the items of one block: what is sent to every task.
BLOCK_TERMS = 1 << 17
#: Characters of a text scanned in one step, and cells of a table of scores.
_CELLS = 1 << 21
#: Of ASCII only letters and digits belong to terms; all that is not ASCII does.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: Bytes of a text: A-Z lower-cased, what separates terms as a space.
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def plain(text: str | None) -> bytes:
    """The terms of a text in UTF-8 between single or repeated spaces, with one at both ends."""
    return b" " + (text or "").encode().translate(_PLAIN) + b" "


def terms(text: str | None) -> list[bytes]:
    return plain(text).split()


def automaton(words: list[bytes]) -> ahocorasick.Automaton:
    """Finds every whole term of ``words`` in a plain() text; outputs are their positions in the list."""
    out = ahocorasick.Automaton()
    for number, word in enumerate(words):
        out.add_word(f" {word.decode('latin-1')} ", number)
    if words:
        out.make_automaton()
    return out


def frequencies(found: ahocorasick.Automaton, text: bytes) -> tuple[list[int], list[int]]:
    """(positions of the words found in a plain() text, occurrences of each)."""
    if not len(found):
        return [], []
    # One character a byte: neighbours of a term share its boundary, which the automaton allows.
    counts = Counter(map(itemgetter(1), found.iter(text.decode("latin-1"))))
    return list(counts), list(counts.values())


class Items:
    """A block of items: ``words`` are its distinct terms; of word w the items item[start[w]:start[w + 1]]
    hold it times[...] times."""

    def __init__(self, rows: list[tuple[int | None, str | None]]):
        self.key = uuid.uuid4().hex
        self.ids = [item for item, _ in rows]
        number: dict[bytes, int] = {}
        pairs = Counter((number.setdefault(term, len(number)), item) for item, (_, text) in enumerate(rows) for term in terms(text))
        self.words = list(number)
        ordered = sorted(pairs.items())
        self.item = np.array([item for (_, item), _ in ordered], dtype=np.int64)
        self.times = np.array([n for _, n in ordered], dtype=np.int64)
        self.start = np.searchsorted([word for (word, _), _ in ordered], np.arange(len(number) + 1))


_AUTOMATA: dict[str, ahocorasick.Automaton] = {}


def _of(items: Items) -> ahocorasick.Automaton:
    """The automaton of this worker process; later tasks of the block find it ready."""
    if items.key not in _AUTOMATA:
        _AUTOMATA.clear()
        _AUTOMATA[items.key] = automaton(items.words)
    return _AUTOMATA[items.key]


def counted(docs: DataFrame, items: Items) -> DataFrame:
    """docs (doc_id, text, ...) -> (doc_id, n, word, tf): length in terms of each document that has
    one, and the item terms it holds."""
    shared = docs.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _of(shared.value)
        for batch in batches:
            ids, sizes, words, tfs = [], [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                text = plain(text)
                spaces = np.frombuffer(text, dtype=np.uint8) == 32
                n = int(np.count_nonzero(spaces[:-1] & ~spaces[1:]))
                if n:
                    word, tf = frequencies(found, text)
                    ids.append(doc)
                    sizes.append(n)
                    words.append(word)
                    tfs.append(tf)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(words, pa.list_(pa.int32())),
                                              pa.array(tfs, pa.list_(pa.int64()))], names=["doc_id", "n", "word", "tf"])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n long, word array<int>, tf array<long>")


def _best(item: np.ndarray, doc: np.ndarray, blank: np.ndarray, score: np.ndarray, top: int) -> np.ndarray:
    """Positions of each item's best: highest score, then smallest doc_id, null ones last."""
    order = np.lexsort((doc, blank, -score, item))
    item = item[order]
    new = np.flatnonzero(np.append(True, item[1:] != item[:-1])) if len(item) else np.empty(0, np.int64)
    place = np.arange(len(item)) - np.repeat(new, np.diff(np.append(new, len(item))))
    return order[place < top]


def scored(rows: DataFrame, items: Items, weight: np.ndarray, documents: int, length: int, top: int = TOP) -> DataFrame:
    """counted() rows -> (item, doc_id, score): for each task and item the ``top`` best documents."""
    shared = rows.sparkSession.sparkContext.broadcast((items, weight))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, w = shared.value
        each, step = np.diff(block.start), max(1, _CELLS // max(1, len(block.ids)))
        kept = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool), np.empty(0, np.int64)]
        least = np.ones(len(block.ids), dtype=np.int64)              # a score below can't be among the best
        for whole in batches:
            for batch in (whole.slice(a, step) for a in range(0, whole.num_rows, step)):
                doc, n, word = batch.column(0), batch.column(1).to_numpy(), batch.column(2)
                blank = doc.is_null().to_numpy(zero_copy_only=False)
                doc = doc.fill_null(0).to_numpy()
                row = np.repeat(np.arange(batch.num_rows), word.value_lengths().to_numpy())
                word, tf = word.flatten().to_numpy().astype(np.int64), batch.column(3).flatten().to_numpy()
                m = 25 + 75 * n * documents // length
                part = w[word] * (1_000_000_000 * tf // (1000 * tf + 8 * m[row]))
                # Every hit goes to the items of its word.
                wide = each[word]
                at = np.arange(int(wide.sum())) - np.repeat(np.cumsum(wide) - wide - block.start[word], wide)
                table = np.zeros(batch.num_rows * len(block.ids), dtype=np.int64)
                np.add.at(table, np.repeat(row, wide) * len(block.ids) + block.item[at], np.repeat(part, wide) * block.times[at])
                table = table.reshape(batch.num_rows, len(block.ids))
                row, item = np.nonzero(table >= least)
                kept = [np.concatenate(x) for x in zip(kept, (item, doc[row], blank[row], table[row, item]))]
                best = _best(*kept, top)
                kept = [x[best] for x in kept]
                full = np.flatnonzero(np.bincount(kept[0], minlength=len(block.ids)) == top)
                low = np.full(len(block.ids), np.iinfo(np.int64).max)
                np.minimum.at(low, kept[0], kept[3])
                least[full] = low[full]
        item, doc, blank, score = kept
        yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array(doc, pa.int64(), mask=blank), pa.array(score, pa.int64())],
                                         names=["item", "doc_id", "score"])
    return rows.select("doc_id", "n", "word", "tf").mapInArrow(run, "item long, doc_id long, score long")


def _blocks(items: DataFrame, block_terms: int) -> Iterator[Items]:
    """The items by blocks of about ``block_terms`` terms, dealt by a hash; an item is in one block."""
    sized = items.select(F.col("item_id").cast("long").alias("item_id"), "text").withColumn(
        "size", F.size(F.regexp_extract_all("text", F.lit(TERM), F.lit(0))))
    whole = sized.where("size > 0").agg(F.sum("size")).first()[0]
    blocks = -(-(whole or 0) // block_terms)
    for number in range(blocks):
        rows = sized.where("size > 0").where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == number).select("item_id", "text").collect()
        if rows:
            yield Items(sorted(map(tuple, rows), key=lambda r: (r[0] is None, r[0] or 0, r[1])))


def search(docs: DataFrame, items: DataFrame, top: int = TOP, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """docs (doc_id, text, ...), items (item_id, text, ...) -> (item_id, rank, doc_id, score): the
    ``top`` documents of each item with the highest scores above 0; equal scores by doc_id, null ones
    last. Every row of items is an item and every row of docs a document, repeated ones too. Null and
    empty texts hold no term; an item without terms, or an empty table on either side, gives no row."""
    out = docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for block in _blocks(items, block_terms):
        rows = stored(counted(docs, block), "counted")
        documents, length = rows.agg(F.count(F.lit(1)), F.sum("n")).first()
        if not documents:
            return out
        # At most one row for each term of the block.
        df = rows.select(F.explode("word").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("df"))
        w = np.zeros(len(block.words), dtype=np.int64)
        for word, value in df.select("word", F.floor(1000 * F.log(F.lit(2.0 * documents + 2) / (2 * F.col("df") + 1))).cast("long")).collect():
            w[word] = value
        ids = docs.sparkSession.createDataFrame(list(enumerate(block.ids)), "item long, item_id long")
        place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
        best = scored(rows, block, w, documents, length, top).withColumn("rank", place).where(F.col("rank") <= top)
        # One row for each item of the block, which is bounded by its terms.
        out = out.unionByName(best.join(F.broadcast(ids), "item").select("item_id", "rank", "doc_id", "score"))
    return out
