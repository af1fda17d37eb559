"""The registered queries on the smallest tables, against SQL or plain Python."""
from __future__ import annotations

import hashlib
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import tiktoken
from tokenizers import Tokenizer

import __spark_entry__ as entry
from flowspark.llm import bytepair, neighbours
from verify import normal

FOLDER = "/root/testdata/sf0.001"


def rows(name):
    return pq.read_table(f"{FOLDER}/{name}.parquet").to_pylist()


def run(spark, name):
    return [r.asDict() for r in entry.queries()[name](spark, FOLDER).collect()]


def test_one_query_for_each_operator():
    names = [n for n in entry.queries() if re.match(r"op\d+_", n)]
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in names) == list(range(1, 14)) and "pipeline" in entry.queries()


@pytest.mark.parametrize("name", ["op3_urls", "op10_pivots"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("pages", "embeddings"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    assert normal(entry.queries()[name](spark, FOLDER).toPandas()) == normal(con.sql(entry.oracle_sql()[name]).df())


def test_token_queries(spark):
    docs = sorted(rows("documents"), key=lambda r: r["doc_id"])
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, special_tokens={},
                              mergeable_ranks=bytepair.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")))
    shards, pairs = ({r["doc_id"]: r for r in run(spark, name)} for name in ("op1_wavelet", "op5_bytepair"))
    start = 0
    for doc in docs:
        ids = np.array(whole.encode(doc["text"], add_special_tokens=False).ids + [0], "<u4")
        r = shards[doc["doc_id"]]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
        ids, r = np.array(plain.encode_ordinary(doc["text"]), "<u4"), pairs[doc["doc_id"]]
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (
            len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(doc["text"].encode()).hexdigest())


def test_labels_of_held_out_documents(spark):
    docs, labels = {r["doc_id"]: r for r in rows("documents")}, {r["doc_id"]: r["quality"] for r in rows("labels")}
    found = {r["doc_id"]: r for r in run(spark, "op2_quality")}
    held = [i for i in labels if zlib.crc32(str(i).encode()) % 3 == 1]
    assert len(found) == len(docs) and np.mean([found[i]["predicted"] == labels[i] for i in held]) > 0.9
    found = {r["doc_id"]: r for r in run(spark, "op6_langid")}
    held = [i for i in docs if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(found) == len(docs) and np.mean([found[i]["lang_pred"] == docs[i]["lang"] for i in held]) > 0.9


def test_inner_products(spark):
    x = {r["vec_id"]: np.array(r["embedding"], float) for r in rows("embeddings")}
    got = {}
    for r in run(spark, "op7_neighbours"):
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    for q in [i for i in x if i % 20 == 0]:
        best = sorted((-float(neighbours.exact(x[q][None], y[None])[0]), i) for i, y in x.items() if i != q)[:20]
        assert sorted(got.pop(q)) == [(n, i, -s) for n, (s, i) in enumerate(best, 1)]
    assert not got


def test_conversations(spark):
    by = {}
    for r in sorted(rows("conversations"), key=lambda r: r["turn"]):
        by.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    by[-7] = [("user", "\\### Assistant: </turn> ok"), ("assistant", "\\### Assistant: </turn> ok")]
    got = {r["conv_id"]: r for r in run(spark, "op8_chat")}
    assert got.keys() == by.keys()
    for conv, turns in by.items():
        loss = "".join(t for role, t in turns if role == "assistant")
        assert [got[conv][c] for c in ("n_turns", "turns_sha256", "loss_chars", "loss_sha256")] == [
            len(turns), hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()]
