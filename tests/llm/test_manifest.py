"""Merkle manifest against a plain version, its SQL, and by hand."""
from __future__ import annotations

import hashlib
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from flowspark.llm import manifest
from verify import normal

FOLDER = "/root/testdata/sf0.001"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][a:a + 16])) for a in range(0, len(levels[-1]), 16)])
    return levels


def sides(levels, i):
    out = []
    for level in levels[:-1]:
        a = i // 16 * 16
        out.append(("".join(level[a:i]), "".join(level[i + 1:a + 16])))
        i //= 16
    return out


def leaf(row, text):
    fields = [row["doc_id"], row["source"], row["lang"], row["n_chars"], text]
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in fields))


def plain(rows):
    """Whole trees in lists."""
    groups = {}
    for r in rows:
        groups.setdefault(r["source"], []).append((r["doc_id"], leaf(r, r["text"]), r))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for name in names:
        groups[name].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[name] = tree([x[1] for x in groups[name]])
    top, out = tree([trees[name][-1][0] for name in names]), []
    for k, name in enumerate(names):
        for i, (doc, own, r) in enumerate(groups[name]):
            path, now = sides(trees[name], i) + sides(top, k), own
            if doc is not None and zlib.crc32(str(doc).encode()) % 5 == 0 and r["text"] is not None:
                now = leaf(r, "".join(c.lower() if "A" <= c <= "Z" else c for c in r["text"]))
            for a, b in path:
                now = sha(a + now + b)
            out.append((doc, name, own, trees[name][-1][0], top[-1][0], sha("".join(a + b for a, b in path)), now, now == top[-1][0]))
    return out


def by_value(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: [(v is not None, v) for v in r])


def test_layout_is_a_recursive_split():
    """Every full tree: each address once, the upper half first, each lower subtree in one stretch."""
    for height in range(5):
        every = np.concatenate([manifest.addresses(height, depth) for depth in range(height + 1)])
        assert sorted(every.tolist()) == list(range(manifest.cells(height)))
        upper = (height + 1) // 2
        if height:
            top = np.concatenate([manifest.addresses(height, depth) for depth in range(upper)])
            assert sorted(top.tolist()) == list(range(manifest.cells(upper - 1)))
            roots, leaves = manifest.addresses(height, upper), manifest.addresses(height, height).reshape(len(manifest.addresses(height, upper)), -1)
            assert ((leaves >= roots[:, None]) & (leaves < roots[:, None] + manifest.cells(height - upper))).all()
    children = manifest.addresses(3, 3).reshape(-1, 16)
    assert (np.diff(children, axis=1) == 1).all()                          # siblings at the leaves side by side


@pytest.mark.parametrize("size", [1, 2, 15, 16, 17, 255, 256, 257, 1000, 4096])
def test_block_paths_lead_to_the_root(size):
    leaves = [sha(str(i)) for i in range(size)]
    levels, height = tree(leaves), manifest.height_of(size)
    cells, root = manifest.build(np.frombuffer(bytes.fromhex("".join(leaves)), np.uint8).reshape(-1, 32), height)
    block = manifest.Block(cells, size, height)
    assert root.hex() == levels[-1][0] == block.root and len(levels) == height + 1
    assert len(cells) <= 32 * manifest.cells(height)
    for i in {0, 1, size // 2, size - 1} - {1 if size == 1 else -1}:
        path = block.path(i)
        assert manifest.fold(leaves[i], path) == block.root and manifest.fold(sha("other"), path) != block.root
        assert manifest.siblings(path) == "".join(a + b for a, b in sides(levels, i))


@pytest.mark.parametrize("height", [1, manifest.HEIGHT])
def test_manifest_of_documents(spark, height):
    """Small blocks recur over block roots; the large ones hold a source each."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    if height == 1:
        docs = docs.withColumn("source", F.when(F.col("doc_id") % 3 == 0, "hot").otherwise(F.col("source")))
    made = manifest.documents(docs, height)
    assert (len(made.levels) > 1) == (height == 1)
    assert by_value(made.verified().collect()) == by_value(plain(docs.collect()))
    wanted = docs.limit(5).select("doc_id")
    for r in made.proofs(wanted).collect():
        path = [(x["at"], x["run"].hex()) for x in r["path"]]
        assert manifest.fold(r["leaf"].hex(), path) == made.root and manifest.fold(sha("x"), path) != made.root
    assert made.proofs(wanted).count() == 5


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{FOLDER}/documents.parquet'")
    got = entry.queries()["op11_merkle"](spark, FOLDER).toPandas()
    assert normal(got) == normal(con.sql(entry.oracle_sql()["op11_merkle"]).df())
    assert 0 < (~got["verified"]).sum() < len(got) / 3


def test_messy_and_empty_tables(spark, messy):
    made = manifest.documents(messy, 1)
    assert by_value(made.verified().collect()) == by_value(plain(messy.collect()))
    empty = manifest.documents(messy.limit(0))
    assert empty.root is None and empty.verified().count() == 0 and empty.proofs().count() == 0
