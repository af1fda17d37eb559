"""Language identification by a bidirectional gated recurrent network over bytes.

The network is trained in numpy by backpropagation through time. It reads a text word by word (the
lower-cased bytes between white space, framed by spaces, long words in segments), labels every byte
position with a probability for each language, and a document's probabilities are the mean over the
positions of all its words that hold a letter. As a word's positions depend on nothing outside it,
a worker keeps the sums of words it has met.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Documents of each language the network is fitted on (in expectation; drawn by hash of doc_id),
#: words taken from each of them, and characters of a word, from a random place of a longer one.
SAMPLE_DOCS = 500
SAMPLE_WORDS = 40
SAMPLE_CHARACTERS = 200
HIDDEN = 12
SEGMENT = 24
EPOCHS = 3
UNKNOWN = "und"
KEPT_WORDS = 1 << 19
_FOLDS, _HELD = 5, 0


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class _Direction:
    """One gated recurrent layer; gates z, r and candidate n side by side."""

    def __init__(self, hidden: int, draw: np.random.Generator):
        scale = 1 / np.sqrt(hidden)
        self.p = {"x": draw.normal(0, 0.3, (256, 3 * hidden)).astype(np.float32),
                  "u": draw.uniform(-scale, scale, (hidden, 3 * hidden)).astype(np.float32),
                  "b": np.zeros(3 * hidden, dtype=np.float32)}
        self.h = hidden

    def forward(self, data: np.ndarray, keep: list | None = None) -> np.ndarray:
        """data: (n, steps) bytes -> states (steps, n, hidden); keep gathers what backward needs."""
        n, steps = data.shape
        k, h = self.h, np.zeros((n, self.h), dtype=np.float32)
        out = np.empty((steps, n, k), dtype=np.float32)
        for t in range(steps):
            fed, held = self.p["x"][data[:, t]] + self.p["b"], h @ self.p["u"]
            gates = _sigmoid(fed[:, :2 * k] + held[:, :2 * k])
            z, r = gates[:, :k], gates[:, k:]
            new = np.tanh(fed[:, 2 * k:] + r * held[:, 2 * k:])
            if keep is not None:
                keep.append((h, z, r, new, held[:, 2 * k:]))
            h = new + z * (h - new)
            out[t] = h
        return out

    def backward(self, data: np.ndarray, kept: list, d_out: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients by backpropagation through time; d_out: (steps, n, hidden)."""
        k, grad = self.h, {name: np.zeros_like(v) for name, v in self.p.items()}
        dh = np.zeros_like(d_out[0])
        for t in range(data.shape[1] - 1, -1, -1):
            h, z, r, new, held = kept[t]
            dh = dh + d_out[t]
            d_new = dh * (1 - z) * (1 - new * new)
            d_z = dh * (h - new) * z * (1 - z)
            d_r = d_new * held * r * (1 - r)
            d_fed = np.concatenate([d_z, d_r, d_new], axis=1)
            d_held = np.concatenate([d_z, d_r, d_new * r], axis=1)
            np.add.at(grad["x"], data[:, t], d_fed)
            grad["b"] += d_fed.sum(axis=0)
            grad["u"] += h.T @ d_held
            dh = dh * z + d_held @ self.p["u"].T
        return grad


@dataclass
class Network:
    languages: list[str]
    hidden: int = HIDDEN
    seed: int = 3
    key: str = ""
    parts: list[_Direction] = field(default_factory=list)
    head: dict[str, np.ndarray] = field(default_factory=dict)

    def __post_init__(self):
        draw = np.random.default_rng(self.seed)
        self.parts = [_Direction(self.hidden, draw), _Direction(self.hidden, draw)]
        self.head = {"w": draw.normal(0, 0.1, (2 * self.hidden, len(self.languages))).astype(np.float32),
                     "c": np.zeros(len(self.languages), dtype=np.float32)}

    def label(self, data: np.ndarray, kept: tuple[list, list] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Byte rows of one length -> probabilities (steps, n, languages), and the states."""
        ahead = self.parts[0].forward(data, kept and kept[0])
        back = self.parts[1].forward(data[:, ::-1], kept and kept[1])[::-1]
        states = np.concatenate([ahead, back], axis=2)
        raw = states @ self.head["w"] + self.head["c"]
        raw = np.exp(raw - raw.max(axis=2, keepdims=True))
        return raw / raw.sum(axis=2, keepdims=True), states

    def gradients(self, data: np.ndarray, target: np.ndarray, weight: np.ndarray) -> tuple[float, list[tuple[np.ndarray, np.ndarray]]]:
        """Loss of every position against its word's language, and (parameter, gradient) pairs."""
        kept: tuple[list, list] = ([], [])
        p, states = self.label(data, kept)
        n, rows = data.shape[0] * data.shape[1], np.arange(len(target))
        loss = -float((np.log(p[:, rows, target] + 1e-12) * weight).sum()) / n
        d = p.copy()
        d[:, rows, target] -= 1
        d *= (weight / n).astype(np.float32)[None, :, None]
        d_states = d @ self.head["w"].T
        k = self.hidden
        found = [(self.head["w"], np.einsum("tni,tnj->ij", states, d)), (self.head["c"], d.sum(axis=(0, 1)))]
        for part, rows_, keep, slope in ((self.parts[0], data, kept[0], d_states[:, :, :k]),
                                         (self.parts[1], data[:, ::-1], kept[1], d_states[::-1, :, k:])):
            grad = part.backward(rows_, keep, slope)
            found += [(part.p[name], grad[name]) for name in part.p]
        return loss, found


def segments(word: bytes) -> list[bytes]:
    framed = b" " + word + b" "
    return [framed[i:i + SEGMENT] for i in range(0, len(framed), SEGMENT)]


def stretch(word: str, draw: np.random.Generator) -> str:
    """SAMPLE_CHARACTERS of a long word, from any place: a text without spaces is one word."""
    at = int(draw.integers(0, len(word) - SAMPLE_CHARACTERS + 1))
    return word[at:at + SAMPLE_CHARACTERS]


def fit(words: list[tuple[bytes, int]], languages: list[str], hidden: int = HIDDEN, epochs: int = EPOCHS, batch: int = 256) -> Network:
    """words: (bytes, language number). Adam over batches of segments of one length; languages
    weigh alike."""
    net = Network(languages, hidden)
    by_length: dict[int, list[tuple[bytes, int]]] = {}
    for word, lang in words:
        for part in segments(word):
            by_length.setdefault(len(part), []).append((part, lang))
    seen = np.bincount([lang for _, lang in words], minlength=len(languages))
    weights = len(words) / np.maximum(seen, 1) / max(len(languages), 1)
    sets = [(np.frombuffer(b"".join(x for x, _ in rows), dtype=np.uint8).reshape(len(rows), size), np.array([y for _, y in rows]))
            for size, rows in sorted(by_length.items())]
    batches = [(i, at) for i, (data, _) in enumerate(sets) for at in range(0, len(data), batch)]
    draw, moments, step = np.random.default_rng(5), {}, 0
    for epoch in range(epochs):
        order = [draw.permutation(len(data)) for data, _ in sets]
        for b in draw.permutation(len(batches)):
            i, at = batches[b]
            rows = order[i][at:at + batch]
            data, target = sets[i][0][rows], sets[i][1][rows]
            step += 1
            rate = 0.01 / (1 + epoch)
            for value, grad in net.gradients(data, target, weights[target])[1]:
                m, v = moments.setdefault(id(value), (np.zeros_like(value), np.zeros_like(value)))
                m += 0.1 * (grad - m)
                v += 0.001 * (grad * grad - v)
                value -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    net.key = hashlib.sha256(b"".join(x.tobytes() for part in net.parts for x in part.p.values()) + net.head["w"].tobytes()).hexdigest()
    return net


class _Words:
    """Sums of position probabilities of the words a worker has met."""

    def __init__(self, net: Network):
        self.net = net
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.sums = np.empty((1024, len(self.net.languages) + 1), dtype=np.float32)

    def learn(self, needed: set[str]) -> list[str]:
        new = needed.difference(self.at)
        if len(self.at) + len(new) > KEPT_WORDS:
            self.clear()
            new = needed
        order = sorted(new)
        first = len(self.at)
        while len(self.sums) < first + len(order):
            self.sums = np.concatenate([self.sums, np.empty_like(self.sums)])
        self.at.update(zip(order, range(first, first + len(order))))
        self.sums[first:first + len(order)] = 0
        by_length: dict[int, tuple[list[int], list[bytes]]] = {}
        for row, word in enumerate(order, first):
            if word.isascii() and word.isalpha() or any(map(str.isalpha, word)):
                for part in segments(word.encode()):
                    rows, parts = by_length.setdefault(len(part), ([], []))
                    rows.append(row)
                    parts.append(part)
        for size, (rows, parts) in by_length.items():
            for i in range(0, len(parts), 4096):
                data = np.frombuffer(b"".join(parts[i:i + 4096]), dtype=np.uint8).reshape(-1, size)
                p = self.net.label(data)[0].sum(axis=0)
                np.add.at(self.sums, rows[i:i + 4096], np.concatenate([p, np.full((len(p), 1), size, dtype=np.float32)], axis=1))
        return [w for w in order if len(w) > 64]


_MET: dict[str, _Words] = {}


def predict(net: Network, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """Language and its probability for whole texts; ``und`` with 0 for null texts, texts without
    a letter, and everything if no language was learned."""
    if not net.languages:
        return [UNKNOWN] * len(texts), np.zeros(len(texts))
    if net.key not in _MET:
        _MET.clear()
        _MET[net.key] = _Words(net)
    met, cut = _MET[net.key], [(x or "").lower().split() for x in texts]
    long = met.learn(set().union(*cut))
    pooled = np.zeros((len(texts), len(net.languages) + 1))
    for i, words in enumerate(cut):
        if words:
            pooled[i] = met.sums[list(map(met.at.__getitem__, words))].sum(axis=0, dtype=np.float64)
    if long:                                    # huge words are not worth keeping
        met.clear()
    p = pooled[:, :-1] / np.maximum(pooled[:, -1:], 1)
    best = p.argmax(axis=1)
    known = pooled[:, -1] > 0
    return [net.languages[b] if k else UNKNOWN for b, k in zip(best, known)], np.where(known, np.minimum(p.max(axis=1), 1.0), 0.0)


def held_out(doc_id: str) -> F.Column:
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(_FOLDS)) == _HELD, F.lit(False))


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_words: int = SAMPLE_WORDS) -> Network:
    """Fit on documents outside the held-out fifth, about sample_docs of each language (rows
    without text, language or doc_id are not learned from; of repeated doc_ids one row)."""
    usable = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").where(
        F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
    counts = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.approx_count_distinct("doc_id").alias("n")).collect()}
    languages = sorted(counts)
    if not languages:
        return Network([])
    share = F.create_map(*[F.lit(x) for lang in languages for x in (lang, min(1.0, sample_docs / max(counts[lang], 1)))])
    drawn = usable.where(F.xxhash64("doc_id", F.lit(13)).cast("double") / 2.0**64 + 0.5 <= share[F.col("lang")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = [w for w in text.lower().split() if any(map(str.isalpha, w))]
                draw = np.random.default_rng(doc & (1 << 63) - 1)
                chosen = [words[i] for i in draw.integers(0, len(words), sample_words)] if words else []
                out.append([stretch(w, draw) if len(w) > SAMPLE_CHARACTERS else w for w in chosen])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.string())), batch.column(2)],
                                             names=["doc_id", "words", "lang"])
    rows = drawn.mapInArrow(run, "doc_id long, words array<string>, lang string").groupBy("doc_id").agg(
        F.min(F.struct("lang", "words")).alias("r")).orderBy("doc_id").select("r.*").collect()
    number = {lang: i for i, lang in enumerate(languages)}
    return fit([(w.encode(), number[r["lang"]]) for r in rows for w in r["words"]], languages)


def predicted(docs: DataFrame, net: Network) -> DataFrame:
    """(doc_id, held_out, lang_pred, score), one row for each row of docs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, score = predict(net, batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score)],
                                             names=["doc_id", "lang_pred", "score"])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, lang_pred string, score double").select(
        "doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")


def kept(docs: DataFrame, net: Network, least: float = 0.0) -> DataFrame:
    """The rows of docs, all columns, whose text is in a learned language with a probability above
    ``least``."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(predict(net, batch.column(at).to_pylist())[1] > least))
    return docs.mapInArrow(run, docs.schema)
