"""Token ids of whole texts by the tokenizers library, each distinct unit of a batch encoded once.

A unit is a stretch of text whose ids do not depend on what stands around it. A batch of texts is
cut into units by Arrow, the distinct ones that no batch had before are encoded, and the ids of the
texts are gathered from theirs. Units of Latin letters and a punctuation tail, nearly all there are, need no normaliser or
pattern: the library's model gets their letters directly, many words in one call."""

from __future__ import annotations

import os
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")   # Spark's tasks use the cores
os.environ.setdefault("ARROW_NUM_THREADS", "1")

#: Units whose ids a worker keeps for later batches.
KEPT_UNITS = 1 << 19
#: White space where the pattern of byte-level vocabularies looks further than one character.
_RARE = ("  ", "\n\n", " \n", "\n ", *(chr(c) for c in range(1 << 16) if chr(c).isspace() and chr(c) not in " \n"))
#: Letters that every Unicode version and the normaliser (lower case, composition) treat alike,
#: then a run of ASCII punctuation without the apostrophe: two matches of the patterns.
_SIMPLE = (r"^(?P<open>\n?)(?P<stem>[A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{12F}\x{131}-\x{24F}]+)"
           r"(?P<tail>[!-&(-/:-@\[-`{-~]*)$")
_TOGETHER = 2048


def byte_characters() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: printable Latin-1 stands
    for itself, the others follow from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


_SPELT = {b: c for b, c in enumerate(byte_characters())}


def _spell(stem: str) -> str:
    return stem.encode().decode("latin-1").translate(_SPELT)


def _gather(pool: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The stretches pool[start:start + length], one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return pool[np.repeat(starts - ends + lengths, lengths) + np.arange(total)]


_ENCODERS: dict[object, UnitEncoder] = {}


class UnitEncoder:
    """ids(texts) -> the ids of each text, as little-endian unsigned 32-bit integers.

    ``words``: the vocabulary drops white space and case, and units stand between white space.
    Otherwise it is byte-level: a match never runs over a single space or line break between two
    other characters, it starts with the space, and the break is a match of its own; texts with
    other white space are encoded whole."""

    def __init__(self, tokenizer, words: bool):
        from tokenizers import Tokenizer, pre_tokenizers
        self.tokenizer, self.words = tokenizer, words
        self.spelt = Tokenizer(tokenizer.model)             # takes spelt words between spaces
        self.spelt.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        end = tokenizer.model.end_of_word_suffix or ""
        vocabulary = tokenizer.get_vocab(with_added_tokens=False)
        self.lengths = np.zeros(max(vocabulary.values()) + 1, dtype=np.int64)
        for token, number in vocabulary.items():
            self.lengths[number] = len(token) - (len(end) if end and token.endswith(end) else 0)
        self.break_ids = self._whole("\n")
        self.kept, self.pool = pa.array([], pa.string()), np.empty(0, "<u4")
        self.starts, self.each = np.empty(0, np.int64), np.empty(0, np.int64)

    @staticmethod
    def of(key: object, build: Callable[[], tuple[object, bool]]) -> UnitEncoder:
        """The encoder of this worker process for ``key``; later tasks find it ready."""
        if key not in _ENCODERS:
            _ENCODERS[key] = UnitEncoder(*build())
        return _ENCODERS[key]

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")

    def _stems(self, stems: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """(ids, ids of each) of runs of letters, spelt in the vocabulary's characters."""
        out: list[tuple[np.ndarray, np.ndarray]] = []
        for at in range(0, len(stems), _TOGETHER):
            part = stems[at:at + _TOGETHER]
            ids = np.array(self.spelt.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, dtype="<u4")
            ends = np.cumsum(self.lengths[ids])
            wanted = np.cumsum(np.fromiter(map(len, part), dtype=np.int64, count=len(part)))
            if not len(ends) or ends[-1] != wanted[-1]:
                raise ValueError("the vocabulary lacks characters")
            cuts = np.searchsorted(ends, wanted) + 1
            out.append((ids, np.diff(cuts, prepend=0)))
        return out

    def _units(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pool of ids, start, length) of distinct units."""
        found = pc.extract_regex(units, pattern=_SIMPLE)
        simple = found.is_valid().to_numpy(zero_copy_only=False)
        pools, sizes = [np.empty(0, "<u4")], [0]
        lengths = np.zeros((3, len(units)), dtype=np.int64)
        starts = np.zeros((3, len(units)), dtype=np.int64)

        def put(row: int, where: np.ndarray, ids: np.ndarray, each: np.ndarray, codes: np.ndarray | None) -> None:
            at = np.cumsum(each) - each + sizes[0]
            starts[row, where], lengths[row, where] = (at, each) if codes is None else (at[codes], each[codes])
            pools.append(ids)
            sizes[0] += len(ids)
        if simple.any():
            found = found.filter(pa.array(simple))
            stem, tail = found.field("stem"), found.field("tail").dictionary_encode()
            opens = pc.equal(found.field("open"), "\n").to_numpy(zero_copy_only=False)
            if self.words:
                stem = pc.utf8_lower(stem)
            else:
                stem = pc.binary_join_element_wise(pa.array(np.where(opens, "", " "), pa.string()), stem, "")
            stem = stem.dictionary_encode()
            space = _SPELT[32]
            parts = self._stems([(space + x[1:] if x[0] == " " else x) if x.isascii() else _spell(x) for x in stem.dictionary.to_pylist()])
            put(1, simple, np.concatenate([p for p, _ in parts]), np.concatenate([n for _, n in parts]), stem.indices.to_numpy())
            tails = [self._whole(x) for x in tail.dictionary.to_pylist()]
            put(2, simple, np.concatenate(tails), np.array([len(x) for x in tails]), tail.indices.to_numpy())
            if not self.words:
                put(0, simple, self.break_ids, np.array([len(self.break_ids)]), np.zeros(int(simple.sum()), dtype=np.int64))
                lengths[0, np.flatnonzero(simple)[~opens]] = 0
        if not simple.all():
            texts = units.filter(pa.array(~simple)).to_pylist()
            if self.words:
                others = [self._whole(x) for x in texts]
            else:
                others = [np.concatenate([self.break_ids, self._whole(x[1:])]) if x[:1] == "\n" else self._whole(" " + x) for x in texts]
            put(1, ~simple, np.concatenate(others), np.array([len(x) for x in others]), None)
        pool = _gather(np.concatenate(pools), starts.T.ravel(), lengths.T.ravel())
        each = lengths.sum(axis=0)
        return pool, np.cumsum(each) - each, each

    def _known(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """_units() with what is kept from earlier batches; keeps new units while there is room."""
        at = pc.index_in(units, value_set=self.kept)
        new = at.is_null().to_numpy(zero_copy_only=False)
        fresh = units.filter(pa.array(new))
        pool, starts, each = self._units(fresh)
        at = at.fill_null(0).to_numpy()
        all_starts, all_each = np.empty(len(units), np.int64), np.empty(len(units), np.int64)
        all_starts[~new], all_each[~new] = self.starts[at[~new]], self.each[at[~new]]
        all_starts[new], all_each[new] = starts + len(self.pool), each
        whole = np.concatenate([self.pool, pool])
        if len(self.kept) + len(fresh) <= KEPT_UNITS and len(whole) <= 8 * KEPT_UNITS:
            self.kept = pa.concat_arrays([self.kept, fresh])
            self.starts, self.each = np.concatenate([self.starts, starts + len(self.pool)]), np.concatenate([self.each, each])
            self.pool = whole
        return whole, all_starts, all_each

    def ids(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = [b""] * len(texts)
        plain = [i for i, x in enumerate(texts) if x and (self.words or not any(r in x for r in _RARE))]
        for i in set(range(len(texts))).difference(plain):
            if texts[i]:
                out[i] = self._whole(texts[i]).tobytes()
        if not plain:
            return out
        # A unit starts at each space (left out) and, if breaks count, at each break; a break put
        # before a byte-level text makes its first unit one without a space, and is taken off again.
        cut = [texts[i].replace("\n", " ") if self.words else " \n" + texts[i].replace("\n", " \n") for i in plain]
        lists = pc.split_pattern(pa.array(cut, pa.large_string()), " ")
        units = lists.flatten().dictionary_encode()
        pool, starts, lengths = self._known(units.dictionary.cast(pa.string()))
        codes = units.indices.to_numpy().astype(np.int64)
        firsts = lists.offsets.to_numpy()
        per_unit = lengths[codes]
        if not self.words:
            per_unit[firsts[:-1]] = 0                       # the empty unit before the break put there
        flat = _gather(pool, starts[codes], per_unit)
        ends = np.concatenate(([0], np.cumsum(per_unit)))[firsts]
        raw, skip = flat.astype("<u4", copy=False).tobytes(), 0 if self.words else len(self.break_ids)
        for i, a, b in zip(plain, ends.tolist(), ends[1:].tolist()):
            out[i] = raw[4 * (a + skip):4 * b]
        return out


def file_encoder(path: str, words: bool = False) -> UnitEncoder:
    """The encoder of a tokenizer file; strings of special tokens are ordinary text."""
    def build():
        from tokenizers import Tokenizer
        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True
        return tokenizer, words
    return UnitEncoder.of((path, words), build)
