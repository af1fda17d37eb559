"""Tokens, packing, quality, language, near duplicates and the pipeline on documents."""
from __future__ import annotations

import base64
import hashlib
import random
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from flowspark.llm import bytepair, langid, packing, quality, shingles, simhash, tokens, wavelet
from flowspark.llm.components import components

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
ODD = list(" \n\t\r\u00a0\u3000\x1c\x85'stredvml.,!-_=0123²½Ⅷaébñ中字한ΣςİıſḰ̈👩\u200dαβ\x00ABC")


def library(path):
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


def odd_texts(n, seed=1):
    draw = random.Random(seed)
    out = ["<|endoftext|>", "a <|endoftext|> b", "-" * 300, "ab" * 200, "don't  stop", " 's\n\n x"]
    for _ in range(n):
        kind = draw.random()
        out.append("".join(draw.choice(ODD) for _ in range(draw.randint(0, 30))) if kind < .6 else draw.choice(ODD) * draw.randint(1, 99) if kind < .8
                   else "".join(chr(draw.choice([draw.randint(1, 0x2ff), draw.randint(0x300, 0xd7ff), draw.randint(0xe000, 0x2ffff)])) for _ in range(12)))
    return out


@pytest.mark.parametrize("path, words", [(BYTES, False), (WORDS, True)])
def test_units_give_the_ids_of_whole_texts(path, words, monkeypatch):
    coder, whole, texts = tokens.file_encoder(path, words), library(path), odd_texts(4000)
    want = [whole.encode(text, add_special_tokens=False).ids for text in texts]
    assert [np.frombuffer(x, "<u4").tolist() for x in coder.ids(texts)] == want
    assert [np.frombuffer(coder.ids([x])[0], "<u4").tolist() for x in texts[:300]] == want[:300]
    coder.kept, coder.pool, coder.starts, coder.each = coder.kept[:0], coder.pool[:0], coder.starts[:0], coder.each[:0]
    monkeypatch.setattr(tokens, "KEPT_UNITS", 40)             # a full store keeps no more
    assert [np.frombuffer(x, "<u4").tolist() for at in range(0, 400, 7) for x in coder.ids(texts[at:at + 7])] == want[:len(range(0, 400, 7)) * 7]
    assert 0 < len(coder.kept) <= 40
    assert coder.ids([]) == [] and coder.ids(["", "\n"]) == [b"", b"" if words else coder.break_ids.tobytes()]


def test_rank_file_as_the_rank_library():
    ranks = bytepair.read_ranks(RANKS)
    assert ranks[base64.b64decode(open(RANKS, "rb").readline().split()[0])] == 0
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    coder = bytepair.encoder(RANKS, public_tokenizers.PATTERN)
    for text in odd_texts(3000, 2):
        ids = np.frombuffer(coder.ids([text])[0], "<u4")
        assert ids.tolist() == plain.encode_ordinary(text)
        assert bytepair.decode_text(RANKS, ids) == text
        at = bytepair.offsets(RANKS, ids)
        assert [text.encode()[a:b] for a, b in zip(at, at[1:])] == [bytepair.decode(RANKS, ids[i:i + 1]) for i in range(len(ids))]
    assert bytepair.decode_text(RANKS, np.frombuffer(coder.ids(["👩"])[0], "<u4")[:1]) == "\ufffd"      # half a character


def test_byte_pairs_of_messy_documents(spark, messy):
    got = bytepair.round_trip(messy, RANKS, public_tokenizers.PATTERN).collect()
    assert len(got) == messy.count()
    assert {r["n_tokens"] for r in got if r["doc_id"] in (0, 1)} == {0}
    rows = bytepair.encoded(messy, RANKS, public_tokenizers.PATTERN).collect()
    digests = Counter((r["doc_id"], len(r["ids"]), hashlib.sha256(np.array(r["ids"], "<u4").tobytes()).hexdigest()) for r in rows)
    assert digests == Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"]) for r in got)
    texts = Counter((r["doc_id"], len((r["text"] or "").encode())) for r in messy.collect())
    assert texts == Counter((r["doc_id"], r["n_bytes"]) for r in got)
    for r in rows:
        assert r["starts"] == bytepair.offsets(RANKS, np.array(r["ids"], dtype=np.int64))[:-1].tolist()
    assert bytepair.round_trip(messy.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


def test_wavelet_file_against_a_list():
    draw = np.random.default_rng(1)
    for n, top in ((0, 1), (1, 5), (700, 3), (5000, 50_257), (1500, 70_000)):
        ids = draw.integers(0, top, n).astype("<u4")
        file = wavelet.WaveletFile.from_bytes(wavelet.WaveletFile.build(ids, [4, None], np.array([n, 0])).to_bytes())
        assert file.ids().tolist() == ids.tolist() and file.docs == [4, None]
        for i in draw.integers(0, n, 20) if n else ():
            token, a = int(ids[i]), int(draw.integers(0, n))
            assert file.access(int(i)) == token
            assert file.count(token, a) == (ids[a:] == token).sum()
            where = np.flatnonzero(ids == token)
            assert [file.occurrence(token, k) for k in range(min(len(where), 5))] == where[:5].tolist()
        assert file.count(1 << 20) == 0


def test_wavelet_shards_of_messy_documents(messy):
    files = wavelet.written(messy, BYTES, shard_tokens=50)
    assert files.count() > 2
    got = sorted(wavelet.documents_of(files).collect(), key=lambda r: r["start"])
    whole, at = library(BYTES), 0
    assert [r["doc_id"] for r in got] == sorted((r["doc_id"] for r in messy.collect()), key=lambda d: (d is not None, d or 0))
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == Counter(
        (r["doc_id"], len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for r in messy.collect()
        for ids in [whole.encode(r["text"] or "", add_special_tokens=False).ids + [0]])
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
    assert wavelet.documents_of(wavelet.written(messy.limit(0), BYTES)).count() == 0


def fewest(lengths, size):
    """Bins of a best packing, by trying everything."""
    best, order = len(lengths), sorted(lengths, reverse=True)

    def place(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(order):
            best = len(bins)
            return
        for j in {b: k for k, b in enumerate(bins)}.values():
            if bins[j] + order[i] <= size:
                place(i + 1, bins[:j] + [bins[j] + order[i]] + bins[j + 1:])
        place(i + 1, bins + [order[i]])
    place(0, [])
    return best


def test_bounds_and_best_fit():
    draw = random.Random(3)
    tight = 0
    for _ in range(150):
        lengths = np.array([draw.randint(1, 20) for _ in range(draw.randint(1, 9))])
        bins, offsets, used = packing.best_fit(lengths, 20)
        assert packing.lower_bound(lengths, 20) <= fewest(lengths.tolist(), 20) <= used
        tight += packing.lower_bound(lengths, 20) == used
        for b in range(used):
            inside = sorted(zip(offsets[bins == b], lengths[bins == b]))
            assert inside[0][0] == 0 and all(a + n == c for (a, n), (c, _) in zip(inside, inside[1:])) and sum(inside[-1]) <= 20
    assert tight > 130
    assert packing.lower_bound(np.array([11] * 7), 20) == 7 and packing.lower_bound(np.array([7] * 6), 20) == 3


def placed(rows, size):
    for _, group in pa_groups(rows):
        at = 0
        for r in sorted(group, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= size


def pa_groups(rows):
    out = {}
    for r in rows:
        out.setdefault(r["sequence_id"], []).append(r)
    return out.items()


def test_packing_of_messy_documents(messy):
    got = packing.packed_documents(messy, WORDS, sequence=4096).collect()
    whole = library(WORDS)
    want = Counter((r["doc_id"], i, 4096 * i, len(ids[4096 * i:4096 * (i + 1)]), zlib.crc32(np.array(ids[4096 * i:4096 * (i + 1)], "<u4").tobytes()))
                   for r in messy.collect() for ids in [whole.encode(r["text"] or "", add_special_tokens=False).ids + [1]] for i in range(-(-len(ids) // 4096)))
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    placed(got, 4096)
    assert packing.packed_documents(messy.limit(0), WORDS).count() == 0


def test_groups_with_a_gap_are_packed_again(spark):
    draw = np.random.default_rng(4)
    rows = [(i, i, 0, 0, int(n), 0) for i, n in enumerate(draw.integers(30, 45, 400))]
    cut = spark.createDataFrame(rows, packing.PIECE)
    once, more = (packing.pack(cut, 100, 10, rounds).collect() for rounds in (1, 4))
    for got in (once, more):
        placed(got, 100)
        assert sorted((r["doc_id"], r["length"]) for r in got) == sorted((r[1], r[4]) for r in rows)
    bins = [len({r["sequence_id"] for r in got}) for got in (once, more)]
    assert packing.lower_bound(np.array([r[4] for r in rows]), 100) <= bins[1] < bins[0]


def test_rounds_move_fewer_pieces_and_no_group_grows(spark, monkeypatch):
    """Probe of every round: pieces dealt, and the largest group."""
    draw, plain, seen = np.random.default_rng(4), packing._packed, []

    def probe(items, groups, attempt, sequence):
        dealt = items.groupBy(F.pmod(F.xxhash64("sequence_id" if attempt else "item", F.lit(attempt)), F.lit(groups))).count().collect()
        seen.append((sum(r[1] for r in dealt), max(r[1] for r in dealt)))
        return plain(items, groups, attempt, sequence)
    monkeypatch.setattr(packing, "_packed", probe)
    cut = spark.createDataFrame([(i, i, 0, 0, int(n), 0) for i, n in enumerate(draw.integers(1, 60, 20_000))], packing.PIECE)
    got = packing.pack(cut, 100, 200).collect()
    placed(got, 100)
    assert sorted(r["doc_id"] for r in got) == list(range(20_000))
    sizes = [n for n, _ in seen]
    assert len(sizes) > 1 and all(b < a / 4 for a, b in zip(sizes, sizes[1:])) and max(m for _, m in seen) <= 220
    first = len({r["sequence_id"] for r in packing.pack(cut, 100, 200, 1).collect()})
    assert len({r["sequence_id"] for r in got}) <= first


def test_loosest_sequences_hold_the_gap():
    free = np.array([0, 90, 5, 60, 40])
    assert packing.loosest(free, 1, 100).tolist() == [1, 3] and packing.loosest(free, 1, 90).tolist() == [1]


def test_packing_query_against_whole_texts(spark):
    """The registered query: every piece of every document once, gapless places, near the least number."""
    docs, whole = pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pylist(), library(WORDS)
    got = [r.asDict() for r in entry.queries()["op4_packing"](spark, "/root/testdata/sf0.001").collect()]
    want = Counter((r["doc_id"], i, 4096 * i, len(ids[4096 * i:4096 * (i + 1)]), zlib.crc32(np.array(ids[4096 * i:4096 * (i + 1)], "<u4").tobytes()))
                   for r in docs for ids in [whole.encode(r["text"] or "", add_special_tokens=False).ids + [1]] for i in range(-(-len(ids) // 4096)))
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    placed(got, 4096)
    assert len(pa_groups(got)) <= packing.lower_bound(np.array([r["length"] for r in got])) + 1


def test_simhash_query_against_all_pairs(spark):
    docs = pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pylist()
    docs.sort(key=lambda r: r["doc_id"])
    codes = [simhash.fingerprint((r["text"] or "").encode()) for r in docs]
    want = {(r["doc_id"], f"{c:016x}", docs[i]["doc_id"]) for r, c, i in zip(docs, codes, reach(codes))}
    assert {tuple(r) for r in entry.queries()["op9_simhash"](spark, "/root/testdata/sf0.001").select("doc_id", "fingerprint", "component_id").collect()} == want


def test_quality_ranking(spark, messy):
    good, bad = "Was there ing of the ble. ", "Was$$$ there### ing&&& "
    rows = [(i, (good if i % 4 else bad) * (1 + i % 7), 0) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int")
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(120)] + [(5, 0), (5, 0), (5, 0), (8, None), (None, 1)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    got = quality.scored(docs, model).collect()
    assert all(r["predicted"] == int(r["doc_id"] % 4 > 0) for r in got) and {r["held_out"] for r in got} == {True, False}
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and r["predicted"] == int(r["score"] >= .5) for r in got)
    assert {r["doc_id"] for r in quality.kept(docs, model).collect()} == {i for i in range(120) if i % 4}
    some = quality.scored(messy, model).collect()
    assert len(some) == messy.count() and all(0 <= r["score"] <= 1 for r in some)
    assert quality.kept(messy, model).schema == messy.schema
    none = quality.train(docs, labels.limit(0))
    assert {r["score"] for r in quality.scored(messy, none).collect()} == {0.5}
    assert quality.scored(messy.limit(0), model).count() == 0


def test_quality_learns_from_every_labelled_document(spark):
    """The threshold cuts all 30,000 training documents at their share of bad ones, not a sample of them."""
    rows = [(i, "a" * (i % 97 + 1) + " " + "$" * (i % 89) + f" {i}", int(zlib.crc32(b"%d" % (i * 3)) % 5 > 0)) for i in range(45_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    model = quality.train(docs.select("doc_id", "text"), docs.select("doc_id", "quality"))
    seen = quality.scored(docs.select("doc_id", "text"), model).where("NOT held_out").join(docs, "doc_id")
    assert abs(seen.where("predicted = 1").count() - seen.where("quality = 1").count()) <= 8


def test_quality_pairs_reach_every_document(spark):
    """Two bad documents among 1,000: the bad ones go round, every good one meets one of them."""
    x = [float(j) for j in range(quality.N_FEATURES)]
    marked = spark.createDataFrame([(i, i >= 2, [float(i)] + x[1:]) for i in range(1000)], "doc_id long, good boolean, x array<double>")
    groups = quality._groups(marked, 998, 2).collect()
    better = [v for g in groups for v in g["better"][::quality.N_FEATURES]]
    assert len(groups) > 1 and all(g["worse"][::quality.N_FEATURES] == [0.0, 1.0] for g in groups)
    assert sorted(better) == [float(i) for i in range(2, 1000)]


def test_labels_of_the_held_out_third_change_nothing(spark):
    docs = spark.createDataFrame([(i, "good text here" if i % 2 else "bad$$$ text###") for i in range(60)], "doc_id long, text string")
    labels = [(i, i % 2) for i in range(60)]
    turned = [(i, q if zlib.crc32(str(i).encode()) % 3 != 1 else 1 - q) for i, q in labels]
    a, b = (quality.train(docs, spark.createDataFrame(x, "doc_id long, quality int")) for x in (labels, turned))
    assert (a.weights == b.weights).all() and a.threshold == b.threshold


def test_backpropagation_through_time():
    net = langid.Network(["a", "b", "c"], hidden=4)
    draw = np.random.default_rng(2)
    data, target, weight = draw.integers(0, 255, (6, 5)).astype(np.uint8), draw.integers(0, 3, 6), np.ones(6)
    for part in net.parts:
        part.p = {k: v.astype(np.float64) for k, v in part.p.items()}
    net.head = {k: v.astype(np.float64) for k, v in net.head.items()}
    for value, grad in net.gradients(data, target, weight)[1]:
        for at in np.argwhere(np.abs(grad) > 1e-4)[:3]:
            at, step = tuple(at), 1e-3
            old = value[at]
            value[at] = old + step
            up = net.gradients(data, target, weight)[0]
            value[at] = old - step
            down = net.gradients(data, target, weight)[0]
            value[at] = old
            assert grad[at] == pytest.approx((up - down) / (2 * step), rel=0.05, abs=2e-4)


def test_language(spark, messy):
    draw = random.Random(5)
    stems = {"en": ("the", "ing", "wh", "th"), "fr": ("eau", "que", "oi", "ç"), "de": ("sch", "ung", "ß", "ein")}
    rows = [(i, " ".join("".join(draw.choice(stems[lang]) for _ in range(3)) for _ in range(30)), lang) for i in range(150) for lang in [draw.choice(list(stems))]]
    docs = spark.createDataFrame(rows + [(900, "12 ??", "en"), (901, None, "fr"), (902, "ing the", None)], "doc_id long, text string, lang string")
    net = langid.train(docs)
    got = {r["doc_id"]: r for r in langid.predicted(docs, net).collect()}
    assert net.languages == ["de", "en", "fr"] and len(got) == 153
    assert np.mean([got[i]["lang_pred"] == lang for i, _, lang in rows if got[i]["held_out"]]) > 0.97
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    assert got[900]["lang_pred"] == got[901]["lang_pred"] == "und" and got[900]["score"] == 0 and got[902]["lang_pred"] == "en"
    some = langid.predicted(messy, net).collect()
    assert len(some) == messy.count() and all(0 <= r["score"] <= 1 for r in some)
    assert langid.kept(messy, net).schema == messy.schema
    assert {r["lang_pred"] for r in langid.predicted(messy, langid.train(messy.limit(0))).collect()} == {"und"}
    assert "en" in langid.train(messy).languages


def test_kept_words_change_no_prediction(monkeypatch):
    net = langid.fit([(b"the", 0), (b"eau", 1)] * 50, ["en", "fr"])
    texts = ["the eau the", "eau " * 9 + "x" * 100, None, "the"]
    want = langid.predict(net, texts)
    monkeypatch.setattr(langid, "KEPT_WORDS", 1)
    langid._MET.clear()
    for text, lang, score in zip(texts, *want):
        assert langid.predict(net, [text]) == ([lang], pytest.approx([score], abs=1e-6))


def reach(codes, most=4):
    """Smallest position that each position reaches, by comparing all pairs."""
    root = list(range(len(codes)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for a, b in combinations(range(len(codes)), 2):
        if (codes[a] ^ codes[b]).bit_count() <= most:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    return [find(i) for i in range(len(codes))]


def codes_with_clusters(n=900, seed=6):
    draw = random.Random(seed)
    out = [draw.getrandbits(64) for _ in range(n // 3)]
    while len(out) < n:
        code = draw.choice(out)
        for _ in range(draw.randint(1, 6)):
            code ^= 1 << draw.randrange(64)
        out.append(code)
    return list(dict.fromkeys([0, (1 << 64) - 1, *out]))


def test_gray_index_finds_all_pairs():
    codes = np.array(sorted(codes_with_clusters()), dtype=np.uint64)
    a, b = simhash.index_pairs(codes)
    want = {(i, j) for i, j in combinations(range(len(codes)), 2) if (int(codes[i]) ^ int(codes[j])).bit_count() <= 4}
    assert set(zip(a.tolist(), b.tolist())) == want and len(want) > 200


@pytest.mark.parametrize("tile", [4096, 3])
def test_linked_codes_against_all_pairs(spark, tile):
    codes = codes_with_clusters(300)
    signed = [c - (1 << 64) if c >> 63 else c for c in codes]
    edges = simhash.linked_codes(spark.createDataFrame([(c,) for c in signed], "code long"), tile=tile)
    root = {r["node"]: r["root"] for r in components(edges).collect()}
    want = reach(codes)
    groups = {}
    for c, w in zip(signed, want):
        groups.setdefault(w, set()).add(c)
    for group in groups.values():
        assert {root.get(c, c) for c in group} == {min(group)}


def test_fingerprint_by_hand():
    import xxhash
    for text in ("The cat sat on the mat", "One", "", " \n", "É x y z É x y z É x y z", "a b c d"):
        words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text).split()
        shingles = [" ".join(words[i:i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        assert simhash.fingerprint(text.encode()) == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert simhash.fingerprint(None) == 0


def test_near_duplicates_of_messy_documents(messy):
    got = simhash.near_duplicates(messy).collect()
    rows = [(r["doc_id"], simhash.fingerprint((r["text"] or "").encode())) for r in messy.collect()]
    root = reach([c for _, c in rows])
    least = {}
    for (doc, _), r in zip(rows, root):
        least[r] = min([d for d in (least.get(r), doc) if d is not None], default=None)
    assert Counter(tuple(r) for r in got) == Counter((doc, f"{code:016x}", least[r]) for (doc, code), r in zip(rows, root))
    assert simhash.near_duplicates(messy.limit(0)).count() == 0
    kept = simhash.representatives(messy)
    ids = [r["doc_id"] for r in kept.collect()]
    assert kept.schema == messy.schema and Counter(i for i in ids if i is not None) == Counter({d for d in least.values() if d is not None})
    assert ids.count(None) == 2


def similar(texts):
    """The first text that each reaches over pairs of a similarity of 0.8 or more, of all pairs and whole sets."""
    sets = []
    for text in texts:
        words = re.sub("[A-Z]", lambda m: m[0].lower(), text or "").split()
        sets.append({tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    root = list(range(len(texts)))
    for a, b in combinations(range(len(texts)), 2):
        if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
            low, high = sorted((root[a], root[b]))
            root = [low if r == high else r for r in root]
    return root


def edited_texts(n=60, seed=8):
    """Texts, and copies of each in which a few words are other ones."""
    draw, out = random.Random(seed), []
    for i in range(n):
        words = [f"w{draw.randrange(5000)}" for _ in range(draw.randint(20, 300))]
        out.append(" ".join(words))
        for _ in range(i % 4):
            words = [f"x{draw.randrange(5000)}" if draw.random() < 0.02 else w for w in words]
            out.append(" ".join(words))
    return out


@pytest.mark.parametrize("tile", [shingles.TILE_SHINGLES, 300])
def test_near_duplicates_by_shingles_against_all_pairs(spark, tile):
    texts = [*edited_texts(), None, "", "one", "One ", "a b c d e", "a b c d e a b c d e"]
    root, codes = similar(texts), [simhash.fingerprint((t or "").encode()) for t in texts]
    assert sum((codes[i] ^ codes[r]).bit_count() > 4 for i, r in enumerate(root)) > 10
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in shingles.near_duplicates(docs, tile=tile).collect()}
    assert got == dict(enumerate(root))


def test_long_words_are_drawn_from_any_place():
    word = "".join(chr(0x4e00 + i) for i in range(1000))
    parts = [langid.stretch(word, np.random.default_rng(i)) for i in range(50)]
    assert all(len(p) == langid.SAMPLE_CHARACTERS and p in word for p in parts)
    assert min(word.index(p) for p in parts) < 100 and max(word.index(p) for p in parts) > 700


def test_pipeline_drops_copies_with_some_other_words(spark):
    docs = spark.createDataFrame(list(enumerate(edited_texts(8))), "doc_id long, text string")
    kept = corpus_pipeline.deduplicated(spark, docs, "")
    assert kept.schema == docs.schema and kept.count() < simhash.representatives(docs).count()


def test_pipeline_against_a_plain_version(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows = docs.collect()
    spoken = langid.predict(langid.train(docs), [r["text"] for r in rows])[1] > corpus_pipeline.LEAST_LANGUAGE
    rows = [r for r, ok in zip(rows, spoken) if ok]
    model = quality.train(spark.createDataFrame(rows, docs.schema), labels)
    rows = [r for r in rows if model.score(quality.features((r["text"] or "").encode())[None])[0] >= 0.5]
    rows.sort(key=lambda r: r["doc_id"])
    root = similar([r["text"] for r in rows])
    rows = [r for i, r in enumerate(rows) if root[i] == i]
    got = corpus_pipeline.run(spark, folder).collect()
    whole = library(WORDS)
    want = Counter((r["doc_id"], i, len(ids[4096 * i:4096 * (i + 1)])) for r in rows for ids in [whole.encode(r["text"] or "", add_special_tokens=False).ids + [1]]
                   for i in range(-(-len(ids) // 4096)))
    assert Counter((r["doc_id"], r["piece"], r["length"]) for r in got) == want
    placed(got, 4096)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "quality", "near_duplicates", "packing"]


def test_stages_take_messy_and_empty_tables(spark, messy):
    for docs in (messy, messy.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, "/root/testdata/sf0.001")
            assert out.count() >= 0 and (name == "packing" or out.schema == docs.schema)
