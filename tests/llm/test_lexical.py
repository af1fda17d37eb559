"""Ranked search by document scans against SQL and a plain version."""
from __future__ import annotations

import math
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from flowspark.llm import lexical
from test_texts import odd_texts
from verify import normal

FOLDER = "/root/testdata/sf0.001"


def words(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(lexical.TERM, lower)


def plain(docs, items, top=10):
    """(item_id, rank, doc_id, score) from counters of every text."""
    held = [(doc, Counter(found), len(found)) for doc, text in docs for found in [words(text)] if found]
    n_docs, length = len(held), sum(n for *_, n in held)
    df = Counter(term for _, c, _ in held for term in c)
    out = []
    for item, text in items:
        scores = []
        for doc, c, n in held:
            m = 100 - 75 + (75 * n * n_docs) // length
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t in words(text) if c[t])
            if score > 0:
                scores.append((-score, doc is None, doc or 0))
        out += [(item, i + 1, None if none else doc, -score) for i, (score, none, doc) in enumerate(sorted(scores)[:top])]
    return sorted(out, key=repr)


def test_automaton_finds_whole_terms_only():
    names = ["the", "he", "é", "a1", "the2", "日本"]
    found = lexical.automaton([x.encode() for x in names])
    for text in ["the the he", "The-HE,tHe", "then the2 2the", "é É caféé é", "a1.A1\x7fa1\x00a1", "日本 日本語", "", " ", *odd_texts(500, 6)]:
        word, tf = lexical.frequencies(found, lexical.plain(text))
        assert dict(zip((names[i] for i in word), tf)) == {k: v for k, v in Counter(words(text)).items() if k in names}
        assert [x.decode() for x in lexical.terms(text)] == words(text)
    assert lexical.frequencies(lexical.automaton([]), lexical.plain("the")) == ([], [])


def test_best_keeps_ties_by_document():
    item, doc = np.array([0, 0, 0, 0, 1]), np.array([5, 3, 0, 4, 9])
    blank, score = np.array([False, False, True, False, False]), np.array([7, 7, 7, 8, 1])
    assert doc[lexical._best(item, doc, blank, score, 3)].tolist() == [4, 3, 5, 9]
    assert len(lexical._best(*(x[:0] for x in (item, doc, blank, score)), 3)) == 0


def test_query_equals_sql(spark):
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    got = entry.queries()["op13_lexical"](spark, FOLDER).toPandas()
    assert len(got) and normal(got) == normal(con.sql(entry.oracle_sql()["op13_lexical"]).df())


@pytest.mark.parametrize("block_terms, cells", [(lexical.BLOCK_TERMS, lexical._CELLS), (12, 7)])
def test_search_in_blocks(spark, messy, monkeypatch, block_terms, cells):
    """Null and repeated rows, ties, clashing columns, and blocks of few terms."""
    monkeypatch.setattr(lexical, "_CELLS", cells)
    items = [(1, "was there ing"), (2, None), (3, ""), (4, "!!"), (5, "AN an anan there"), (6, "ñandú 123 of the ofthe"), (None, "null x"), (7, "null id a a a"), (8, "nowhere")]
    rows = spark.createDataFrame([(*r, "7", 1) for r in items], "item_id long, text string, item string, score int").repartition(2)
    got = lexical.search(messy, rows, 4, block_terms)
    assert sorted(map(tuple, got.collect()), key=repr) == plain([(r["doc_id"], r["text"]) for r in messy.collect()], items, 4)
    assert got.schema.simpleString() == "struct<item_id:bigint,rank:int,doc_id:bigint,score:bigint>"


def test_empty_tables(spark, messy):
    items = spark.createDataFrame([(1, "was there ing")], "item_id long, text string")
    assert lexical.search(messy.limit(0), items).count() == 0 and lexical.search(messy, items.limit(0)).count() == 0
    assert lexical.search(messy.where("text IS NULL OR text = ''"), items).count() == 0
