"""URL filter, chat windows and the two vector searches."""
from __future__ import annotations

import hashlib

import numpy as np
import public_tokenizers
import pytest

from flowspark.llm import chat, neighbours, pivots, urls
from flowspark.llm.tables import prepare

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
BYTES = public_tokenizers.path("byte_bpe_50k.json")


def judge(spark, links, policy=None):
    rows = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(links)], "page_id long, url string, html string, host string")
    return {r["page_id"]: r for r in urls.judged(rows, policy or urls.Policy(RULES)).collect()}


def test_hosts_rules_and_terms(spark):
    cases = [
        (None, "", "", None, "allow"), ("", "", "", None, "allow"), ("no scheme/casino", "", "", None, "block"), ("no scheme/mycasino", "", "", None, "allow"),
        ("https://a.example/?q=porn", "a.example", "/", None, "block"), ("https://a.example/#Free-Bets", "a.example", "/", None, "block"),
        ("https://a.example/?q=freebets", "a.example", "/", None, "allow"), ("https://a.org/fr/?q=porn", "a.org", "/fr/", "org/fr/", "allow"),
        ("https://a.example/?q=Épornö", "a.example", "/", None, "block"),
        ("http://A.Example.NET/en/x?q#f", "a.example.net", "/en/x", "example.net/en/", "allow"),
        ("http://example.net/de/", "example.net", "/de/", "net/", "block"), ("http://example.net", "example.net", "", None, "allow"),
        ("http://notexample.com/de/", "notexample.com", "/de/", None, "allow"), ("x://b.example.com/de/casino", "b.example.com", "/de/casino", "example.com/de/", "block"),
        ("http://a.org/fr/casino", "a.org", "/fr/casino", "org/fr/", "allow"), ("http://a.org#/fr/", "a.org", "", None, "allow"),
        ("https://casino-win.example.com/en/1", "casino-win.example.com", "/en/1", None, "block"), ("https://mycasino.example.com/", "mycasino.example.com", "/", None, "allow"),
        ("https://free.example.com/free/free", "free.example.com", "/free/free", None, "allow"), ("https://free-bets.example.com", "free-bets.example.com", "", None, "block"),
        ("https://ÀB.com/Ü", "Àb.com", "/Ü", None, "allow"), ("http://a://b/c", "a:", "//b/c", None, "allow"), ("http://" + "a" * 70_000, "a" * 70_000, "", None, "allow"),
        ("http://free-bets.example.com", "free-bets.example.com", "", None, "block"), ("http://free-bets.example.com", "free-bets.example.com", "", None, "block")]
    got = judge(spark, [c[0] for c in cases])
    for i, (_, *want) in enumerate(cases):
        assert [got[i][c] for c in ("host", "path", "rule", "verdict")] == want, cases[i]
    assert judge(spark, []) == {}
    assert {r["verdict"] for r in judge(spark, ["http://a.com/casino"], urls.Policy([], (), {})).values()} == {"allow"}


def talk(spark, rows):
    prepare(spark)
    return spark.createDataFrame([(*r, "1", None) for r in rows], "conv_id long, turn long, role string, text string, place string, block string")


def digest(rows):
    texts = "".join(f"{r or ''}\n{t or ''}\n" for r, t in rows)
    loss = "".join(t or "" for r, t in rows if r == "assistant")
    return len(rows), hashlib.sha256(texts.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


@pytest.mark.parametrize("budget, history, block", [(2048, 256, 1 << 16), (40, 15, 90), (1, 0, 5)])
def test_windows_round_trip(spark, budget, history, block):
    draw = np.random.default_rng(1)
    bits = ["\\", "###", "### Assistant: ", "</turn>", "\n", ": ", "x", "é👩", "=", "</turn>\n", " word", "\\:"]
    rows = {}
    for conv in range(12):
        roles = ["system"] * (conv % 3 == 0) + ["user", "assistant", "a:b", "", "system"] * (60 if conv == 6 else 2)
        rows[conv] = [(r, "".join(draw.choice(bits, draw.integers(0, 9)))) for r in roles]
    flat = [(c, i, r, t) for c, x in rows.items() for i, (r, t) in enumerate(x)]
    made = chat.windows(talk(spark, flat).repartition(5), BYTES, budget, history, block)
    got = {r["conv_id"]: tuple(r)[1:5] for r in chat.read_back(made).collect()}
    assert got == {c: digest(x) for c, x in rows.items()}
    found = made.collect()
    for w in found:
        turns = chat.read_turns(w["text"])
        assert len(turns) == w["repeated"] + w["own"] and w["own"] > 0
        assert w["tokens"] <= budget or w["own"] == 1
        if rows[w["conv_id"]][0][0] == "system":
            assert turns[0] == rows[w["conv_id"]][0]
    assert sum(w["own"] for w in found) == len(flat)
    if budget == 40:
        assert max(w["repeated"] for w in found) > 1


def test_messy_conversations(spark):
    tricky = "\\### Assistant: </turn> ok"
    rows = [(1, 0, "user", None), (1, 1, None, "x"), (1, None, "assistant", "first"), (None, 0, "assistant", "no id"), (2, 0, "user", "same"), (2, 0, "user", "same"),
            (3, 5, "assistant", "y " * 30_000), (-7, 0, "user", tricky), (-7, 1, "assistant", tricky)]
    got = {r["conv_id"]: tuple(r)[1:5] for r in chat.read_back(chat.windows(talk(spark, rows), BYTES)).collect()}
    assert got == {1: digest([("assistant", "first"), ("user", ""), ("", "x")]), None: digest([("assistant", "no id")]), 2: digest([("user", "same")] * 2),
                   3: digest([("assistant", "y " * 30_000)]), -7: digest([("user", tricky), ("assistant", tricky)])}
    assert chat.read_back(chat.windows(talk(spark, rows).limit(0), BYTES)).count() == 0


def embeddings(spark, rows):
    prepare(spark)
    return spark.createDataFrame([(i, None if x is None else [None if v is None else float(v) for v in x], "7", 3) for i, x in rows],
                                 "vec_id long, embedding array<double>, dim string, score int")


def sound(x, zero):
    return x is not None and len(x) > 0 and all(v is not None and np.isfinite(v) for v in x) and (zero or any(x))


def brute(rows, every, k, zero, measure):
    rows = [(i, x) for i, x in rows if i is not None and sound(x, zero)]
    out = set()
    for q, x in rows:
        if q % every == 0:
            best = sorted((-measure(x, y), i) for i, y in rows if i != q and len(y) == len(x))[:k]
            out |= {(q, n, i, -s) for n, (s, i) in enumerate(best, 1)}
    return out


def some_vectors():
    draw = np.random.default_rng(9)
    base = draw.normal(size=(40, 6)).round(2)
    rows = [(i, (base[i % 40] if i % 3 else draw.normal(size=6)).tolist()) for i in range(260)]
    same = [(1000 + i, rows[1][1]) for i in range(70)]                       # a hot vector
    bad = [(300, None), (320, []), (340, [0.0] * 6), (360, [1, None, 2, 3, 4, 5]), (380, [float("nan")] + [1.0] * 5), (400, [float("inf")] * 6), (None, [1.0] * 6),
           (420, [1.0, 2.0]), (421, [2.0, 2.0]), (440, [1e6] * 6)]
    return rows + same + bad


def test_block_matrix_join(spark):
    rows = some_vectors()
    got = {tuple(r) for r in neighbours.nearest(embeddings(spark, rows), k=7, every=20, queries=5, candidates=32).collect()}
    want = brute(rows, 20, 7, False, lambda x, y: float(neighbours.exact(np.array([x], float), np.array([y], float))[0]))
    assert got == want
    assert neighbours.nearest(embeddings(spark, rows).limit(0)).count() == 0
    assert len(neighbours.nearest(embeddings(spark, [(0, [1.0]), (1, [2.0]), (2, [-1.0])]), k=20).collect()) == 2


def test_quantisation_never_loses_a_neighbour():
    draw = np.random.default_rng(3)
    for scale in (1e-6, 1, 1e5):
        q, x = draw.normal(size=(8, 48)) * scale, draw.normal(size=(500, 48)) * draw.lognormal(size=(500, 1))
        for i, ids, score in neighbours.tile(np.arange(8) + 9000, q, np.arange(500), x, 10):
            want = np.lexsort((np.arange(500), -neighbours.exact(q[i][None], x)))[:10]
            assert ids.tolist() == want.tolist()


def test_pivot_index(spark):
    rows = some_vectors()
    got = {tuple(r) for r in pivots.nearest(embeddings(spark, rows), k=5, every=20, pivots=6, rings=4, sample=120).collect()}
    floors = [(i, None if not sound(x, True) else np.floor(1024 * np.array(x)).astype(int).tolist()) for i, x in rows]
    assert got == brute(floors, 20, 5, True, lambda x, y: int(np.dot(x, y)))
    assert pivots.nearest(embeddings(spark, rows).limit(0)).count() == 0
    assert len(pivots.nearest(embeddings(spark, [(0, [1.0]), (1, [2.0])]), k=20).collect()) == 1


def test_annuli_prune_far_vectors():
    draw = np.random.default_rng(1)
    centres = np.eye(8) * 5000
    x = np.floor(np.concatenate([c + draw.normal(size=(200, 8)) * 20 for c in centres]))
    space = pivots.fit(np.arange(len(x)), x, float(np.square(x).sum(axis=1).max()))
    pivot, ring, near = space.keys(x)
    assert len(np.unique(pivot)) > 4 and (near >= 0).all() and ring.max() < pivots.RINGS
