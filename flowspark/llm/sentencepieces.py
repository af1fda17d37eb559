"""SentencePiece BPE in vectorised merge rounds, and its inverse.

Characters become numbers in flat arrays. Two characters that stand side by side in no piece are
never joined, so texts are cut there, first into words before each space symbol, then into
segments. In a round every segment finds the best-scored pair it holds (a segmented minimum over
ranks) and joins its leftmost occurrences, all segments at once; segments without a pair leave the
arrays. Where joining an occurrence makes a pair that comes before the next occurrence, those behind
it wait for another round: the result is that of a queue of single merges.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .tokens import _gather

SPACE = "▁"
#: Words, and characters of words, whose ids a worker keeps for later batches.
KEPT_WORDS, KEPT_CHARACTERS = 1 << 19, 1 << 23
_NONE = np.int64(1) << 40


class _Numbers(dict):
    """word -> number in order of arrival; ``fresh`` lists the words not yet encoded."""

    def __init__(self):
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        self.fresh.append(word)
        return number


class PieceModel:
    """A byte-fallback BPE model file, which keeps white space, as flat arrays."""

    def __init__(self, path: str):
        import sentencepiece
        self.library = library = sentencepiece.SentencePieceProcessor(model_file=path)
        size = library.get_piece_size()
        names = [library.id_to_piece(i) for i in range(size)]
        hidden = [library.is_control(i) for i in range(size)]
        raw = [i for i in range(size) if library.is_byte(i)]
        if any(map(library.is_unused, range(size))) or len(raw) != 256 or library.normalize("a  b").lstrip(SPACE) != f"a{SPACE}{SPACE}b":
            raise ValueError("only models with byte fallback, without unused pieces, that keep white space")
        self.begin, self.end = library.bos_id(), library.eos_id()
        self.byte_ids = np.array(raw, dtype="<u4")                       # in the order of the bytes
        pieces = {names[i]: i for i in range(size) if not (hidden[i] or library.is_byte(i) or library.is_unknown(i))}
        self._merges(pieces, np.array([library.get_score(i) for i in range(size)]))
        splits = any(SPACE in name.lstrip(SPACE) for name in pieces)
        self.words = re.compile(r"(?s).+" if splits else f"{SPACE}*[^{SPACE}]+|{SPACE}+").findall
        prefixed = library.normalize("a").startswith(SPACE)
        self.leads = np.array([prefixed and name.startswith(SPACE) for name in names])
        self.hidden = np.array(hidden)
        shown = [b"" if hidden[i] else name.replace(SPACE, " ").encode() for i, name in enumerate(names)]
        for byte, i in enumerate(raw):
            shown[i] = bytes([byte])
        shown[library.unk_id()] = " ⁇ ".encode()
        self.shown_size = np.array([len(x) for x in shown], dtype=np.int64)
        self.shown_start = np.cumsum(self.shown_size) - self.shown_size
        self.shown = np.frombuffer(b"".join(shown), dtype=np.uint8)
        self.forget()

    def _merges(self, pieces: dict[str, int], scores: np.ndarray) -> None:
        symbols = dict(pieces)
        for name in pieces:
            for character in name:
                symbols.setdefault(character, len(scores) + len(symbols))
        self.stride = len(scores) + len(symbols)
        self.pieces = len(scores)
        characters = sorted((ord(x), number) for x, number in symbols.items() if len(x) == 1)
        self.points = np.array([x for x, _ in characters], dtype=np.int64)
        self.symbols = np.array([x for _, x in characters], dtype=np.int64)
        rank = np.unique(-scores, return_inverse=True)[1]
        self.early = np.zeros(len(scores), dtype=bool)                   # part of a piece that comes first
        keys, products, beside = [], [], set()
        for name, number in pieces.items():
            for cut in range(1, len(name)):
                left, right = symbols.get(name[:cut]), symbols.get(name[cut:])
                beside.add(ord(name[cut - 1]) << 21 | ord(name[cut]))
                if left is not None and right is not None:
                    keys.append(left * self.stride + right)
                    products.append(number)
                for part in (left, right):
                    if part is not None and part < self.pieces and rank[number] <= rank[part]:
                        self.early[part] = True
        order = np.argsort(keys)
        self.keys = np.append(np.array(keys, dtype=np.int64)[order], np.iinfo(np.int64).max)
        self.products = np.append(np.array(products, dtype=np.int64)[order], 0)
        self.rank = rank.astype(np.int64)
        self.beside = np.append(np.sort(np.fromiter(beside, dtype=np.int64, count=len(beside))), np.iinfo(np.int64).max)
        # A long run of space symbols falls into pieces of one length from the left, if its pieces have
        # one score, are all that hold two space symbols, and the longest comes out of such a run.
        runs = [name for name in pieces if SPACE * 2 in name]
        longest = max(map(len, runs), default=0)
        alike = longest > 0 and not any(name.strip(SPACE) for name in runs) and len({scores[pieces[name]] for name in runs}) == 1
        whole = self.merged(np.full(longest, symbols.get(SPACE, -1)), np.zeros(longest, np.int64))[0]
        self.run = longest if alike and whole.tolist() == [pieces[SPACE * longest]] else 0

    def forget(self) -> None:
        self.numbers = _Numbers()
        self.pool, self.starts, self.each = np.empty(0, "<u4"), np.empty(0, np.int64), np.empty(0, np.int64)

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, product) of pairs of symbols; rank _NONE where they don't join."""
        key = np.where((left >= 0) & (right >= 0), left * self.stride + right, -1)
        at = np.searchsorted(self.keys, key)
        product = self.products[at]
        return np.where(self.keys[at] == key, self.rank[product], _NONE), product

    def _undisturbed(self, symbols: np.ndarray, segment: np.ndarray, at: np.ndarray, product: np.ndarray, best: np.ndarray) -> np.ndarray:
        """Which of the joins at ``at`` come one after the other: those up to the first of a segment
        that makes a pair which does not come after the pairs of this round."""
        new = np.append(True, segment[at[1:]] != segment[at[:-1]])
        rank, upset = best[np.cumsum(new) - 1], np.zeros(len(at), dtype=bool)
        risky = np.flatnonzero(self.early[product[at]])
        if not len(risky):
            return np.ones(len(at), dtype=bool)
        here, own = at[risky], product[at[risky]]
        right = np.minimum(here + 2, len(symbols) - 1)
        after = self._pairs(own, np.where(segment[right] == segment[here], symbols[right], -1))[0]
        after[here + 2 >= len(symbols)] = _NONE
        left = np.maximum(here - 1, 0)
        beside = np.where((risky > 0) & (at[risky - 1] == here - 2), product[at[risky - 1]], symbols[left])
        before = self._pairs(np.where((here > 0) & (segment[left] == segment[here]), beside, -1), own)[0]
        upset[risky] = np.minimum(before, after) <= rank[risky]
        seen = np.cumsum(upset) - upset                                  # disturbing joins before this one
        return seen == seen[np.flatnonzero(new)][np.cumsum(new) - 1]

    def merged(self, symbols: np.ndarray, segment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """symbols, and the segment of each (ascending) -> the symbols left and their first positions."""
        place = np.arange(len(symbols))
        done: list[tuple[np.ndarray, np.ndarray]] = []
        rank, product = np.full(len(symbols), _NONE), np.zeros(len(symbols), np.int64)   # of the pair that starts here
        inside = np.flatnonzero(segment[1:] == segment[:-1])
        rank[inside], product[inside] = self._pairs(symbols[inside], symbols[inside + 1])
        while len(symbols):
            new = np.flatnonzero(np.append(True, segment[1:] != segment[:-1]))
            sizes = np.diff(np.append(new, len(symbols)))
            best = np.minimum.reduceat(rank, new)
            ended = best == _NONE
            if ended.any():
                out = np.repeat(ended, sizes)
                done.append((symbols[out], place[out]))
                symbols, place, segment, rank, product = (x[~out] for x in (symbols, place, segment, rank, product))
                sizes, best = sizes[~ended], best[~ended]
                if not len(symbols):
                    break
            joins = rank == np.repeat(best, sizes)
            at = np.flatnonzero(joins)
            # Of candidates that follow each other, every other one from the left.
            run = np.flatnonzero(np.append(True, (at[1:] != at[:-1] + 1) | (segment[at[1:]] != segment[at[:-1]])))
            at = at[(np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))) % 2 == 0]
            at = at[self._undisturbed(symbols, segment, at, product, best)]
            symbols[at] = product[at]
            kept = np.ones(len(symbols), dtype=bool)
            kept[at + 1] = False
            touched = np.zeros(len(symbols), dtype=bool)
            touched[at] = True
            symbols, place, segment, rank, product, touched = (x[kept] for x in (symbols, place, segment, rank, product, touched))
            again = np.flatnonzero(touched | np.append(touched[1:], False))
            rank[again] = _NONE
            again = again[again + 1 < len(symbols)]
            again = again[segment[again] == segment[again + 1]]
            rank[again], product[again] = self._pairs(symbols[again], symbols[again + 1])
        if not done:
            return symbols, place
        symbols, place = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(place, kind="stable")
        return symbols[order], place[order]

    def _encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words one after the other, number of ids of each)."""
        length = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        points = np.frombuffer("".join(words).encode("utf-32-le"), dtype="<u4").astype(np.int64)
        at = np.minimum(np.searchsorted(self.points, points), len(self.points) - 1)
        symbols = np.where(self.points[at] == points, self.symbols[at], -1 - points)
        cut = np.zeros(len(points), dtype=bool)
        cut[np.cumsum(length) - length] = True
        both = points[:-1] << 21 | points[1:]
        cut[1:] |= self.beside[np.searchsorted(self.beside, both)] != both
        if self.run:
            blank, last = points == ord(SPACE), np.append(cut[1:], True)
            begin = np.flatnonzero(blank & cut)                          # only at a segment's start
            end = np.flatnonzero(~blank | last)
            stop = end[np.searchsorted(end, begin)]
            end = np.where(blank[stop], stop + 1, stop)
            for a, b in zip(begin.tolist(), end.tolist()):
                if b - a > 2 * self.run:
                    cut[a:b - self.run:self.run] = True
        symbols, place = self.merged(symbols, np.cumsum(cut))
        kinds, code = np.unique(np.where(symbols < self.pieces, symbols, -1 - points[place]), return_inverse=True)
        spelt = [np.array([x], "<u4") if x >= 0 else self.byte_ids[list(chr(-1 - x).encode())] for x in kinds.tolist()]
        each = np.array([len(x) for x in spelt], dtype=np.int64)
        ids = _gather(np.concatenate(spelt), (np.cumsum(each) - each)[code], each[code])
        word = np.repeat(np.arange(len(words)), length)
        return ids, np.bincount(word[place], weights=each[code], minlength=len(words)).astype(np.int64)

    def ids(self, texts: list[str]) -> list[bytes]:
        """The ids of each text with begin and end ids, as little-endian unsigned 32-bit integers."""
        number, codes = self.numbers.__getitem__, []
        for text in texts:
            words = self.words(self.library.normalize(text)) if text else []
            codes.append(np.fromiter(map(number, words), dtype=np.int64, count=len(words)))
        fresh = self.numbers.fresh
        if fresh:
            ids, each = self._encode(fresh)
            self.starts = np.concatenate([self.starts, np.cumsum(each) - each + len(self.pool)])
            self.pool, self.each = np.concatenate([self.pool, ids]), np.concatenate([self.each, each])
            self.numbers.fresh = []
        first, last = (np.array([x], "<u4").tobytes() for x in (self.begin, self.end))
        out = [first + _gather(self.pool, self.starts[code], self.each[code]).astype("<u4", copy=False).tobytes() + last for code in codes]
        if len(self.numbers) > KEPT_WORDS or len(self.pool) > KEPT_CHARACTERS:
            self.forget()
        return out

    def text(self, ids: np.ndarray) -> str:
        """What a list of ids stands for; a byte that belongs to no character shows as U+FFFD."""
        at = np.flatnonzero(~self.hidden[ids])
        if not len(at):
            return ""
        ids = ids[at[0]:at[-1] + 1]
        raw, start = _gather(self.shown, self.shown_start[ids], self.shown_size[ids]).tobytes(), int(self.leads[ids[0]])
        try:
            return raw[start:].decode() if len(at) == len(ids) else self._mended(ids)[start:]
        except UnicodeDecodeError:
            return self._mended(ids)[start:]

    def _mended(self, ids: np.ndarray) -> str:
        """The characters of stretches of bytes that are no text; a piece, hidden or not, ends a stretch."""
        is_byte = np.isin(ids, self.byte_ids)
        ends = np.flatnonzero(np.append(is_byte[1:] != is_byte[:-1], True)) + 1
        out = []
        for a, b in zip([0, *ends[:-1].tolist()], ends.tolist()):
            part = ids[a:b][~self.hidden[ids[a:b]]]
            raw, at = _gather(self.shown, self.shown_start[part], self.shown_size[part]).tobytes(), 0
            while at < len(raw):
                try:
                    out.append(raw[at:].decode())
                    break
                except UnicodeDecodeError as bad:
                    out.append(raw[at:at + bad.start].decode() + "�")
                    at += bad.start + 1
        return "".join(out)


@lru_cache(maxsize=2)
def model(path: str) -> PieceModel:
    """The model of this worker process; later tasks find it ready, with the words it has met."""
    return PieceModel(path)


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """docs (doc_id, text, ...) -> (doc_id, ids): ids of the whole text between begin and end ids, as
    little-endian unsigned 32-bit integers. Null texts are empty, null doc_ids and repeated rows stay
    as they are, other columns are not read."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model(path).ids([x or "" for x in batch.column(1).to_pylist()]), pa.binary())],
                                             names=["doc_id", "ids"])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids binary")


def decoded(rows: DataFrame, path: str) -> DataFrame:
    """encoded() rows with the text their ids stand for; null ids give a null text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if x is None else model(path).text(np.frombuffer(x, dtype="<u4")) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=["doc_id", "ids", "text"])
    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, text string")


def digests(rows: DataFrame) -> DataFrame:
    """decoded() rows -> (doc_id, n_tokens, ids_sha256, decoded_sha256)."""
    return rows.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
                       F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))
