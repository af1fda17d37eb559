"""SentencePiece rounds against the sentencepiece library."""
from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import sentencepiece

import __spark_entry__ as entry
from flowspark.llm import sentencepieces
from test_texts import odd_texts

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def mixed_texts(n, seed):
    draw = random.Random(seed)
    parts = ["the", "and", "an", " ", "r", "ll", "her", "aa", "t", "h", "e", "  ", "▁", "\n", "中", "é", "<s>", "�", "👩"]
    return ["".join(draw.choice(parts) for _ in range(draw.randint(1, 60))) for _ in range(n)] + [
        " " * draw.randint(1, 120) + draw.choice(["", "the", "x"]) + " " * draw.randint(0, 99) for _ in range(n // 8)]


def test_ids_and_texts_of_the_library(library, monkeypatch):
    model = sentencepieces.PieceModel(PATH)
    texts = ["", " ", "<s> </s> <unk> <0x41>", "\x00a", *odd_texts(3000, 4), *mixed_texts(3000, 5)]
    want = library.encode(texts, add_bos=True, add_eos=True, num_threads=1)
    got = [np.frombuffer(x, "<u4") for x in model.ids(texts)]
    assert [x.tolist() for x in got] == want
    assert [model.text(x) for x in got] == [library.decode(x) for x in want]
    assert [np.frombuffer(x, "<u4").tolist() for x in model.ids(texts[:200])] == want[:200]      # words it has met
    monkeypatch.setattr(sentencepieces, "KEPT_WORDS", 5)
    assert [np.frombuffer(model.ids([x])[0], "<u4").tolist() for x in texts[:200]] == want[:200]
    assert len(model.numbers) < 200


@pytest.mark.parametrize("text", ["x" * 70_000, "the" * 20_000, "antherble" * 5000, " " * 50_000 + "the", " a" * 20_000, "中文字" * 9000])
def test_long_repeats(library, text):
    assert np.frombuffer(sentencepieces.model(PATH).ids([text])[0], "<u4").tolist() == library.encode(text, add_bos=True, add_eos=True)


def test_any_ids_decode_as_in_the_library(library):
    draw, model = random.Random(3), sentencepieces.model(PATH)
    for _ in range(3000):
        ids = [draw.choice([draw.randrange(300), draw.randrange(32000), 28705, 0, 1, 2]) for _ in range(draw.randint(0, 9))]
        assert model.text(np.array(ids, dtype=np.int64)) == library.decode(ids)


def test_rounds_are_single_merges_from_the_left():
    """Flat segments against a loop that joins one pair at a time."""
    model, draw = sentencepieces.model(PATH), random.Random(9)
    rank = dict(zip(model.keys.tolist(), zip(model.rank[model.products].tolist(), model.products.tolist())))
    letters = [int(model.symbols[np.searchsorted(model.points, ord(c))]) for c in "theranio▁"]
    segments = [[draw.choice(letters) for _ in range(draw.randint(1, 40))] for _ in range(400)]
    want = []
    for one in segments:
        one = list(one)
        while pairs := [(rank[k][0], i, rank[k][1]) for i in range(len(one) - 1) if (k := one[i] * model.stride + one[i + 1]) in rank]:
            _, i, product = min(pairs)
            one[i:i + 2] = [product]
        want += one
    flat = np.array([x for one in segments for x in one], dtype=np.int64)
    got, place = model.merged(flat.copy(), np.repeat(np.arange(len(segments)), [len(x) for x in segments]))
    assert got.tolist() == want and (np.diff(place) > 0).all()


def test_query_against_the_library(spark, library):
    folder = "/root/testdata/sf0.001"
    got = {r["doc_id"]: r for r in entry.queries()["op12_sentencepiece"](spark, folder).collect()}
    docs = pq.read_table(f"{folder}/documents.parquet").to_pylist()
    assert len(got) == len(docs)
    for doc in docs:
        ids, r = library.encode(doc["text"] or "", add_bos=True, add_eos=True), got[doc["doc_id"]]
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (
            len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())


def test_messy_and_empty_tables(spark, messy, library):
    rows = sentencepieces.decoded(sentencepieces.encoded(messy, PATH), PATH).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, np.frombuffer(r["ids"], "<u4").tolist(), r["text"]) for r in rows) == sorted(
        (r["doc_id"] is None, r["doc_id"] or 0, ids, library.decode(ids)) for r in messy.collect() for ids in [library.encode(r["text"] or "", add_bos=True, add_eos=True)])
    assert sentencepieces.digests(sentencepieces.decoded(sentencepieces.encoded(messy.limit(0), PATH), PATH)).count() == 0
