"""Ranked lexical search against brute force and the SQL twin; bounds hold; pruning skips documents; odd rows."""

import math
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from reelspark.llm import lexical

DATA = "/root/testdata/sf0.001"


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    held = [(i, Counter(words(t)), len(words(t))) for i, t in docs]
    held = [h for h in held if h[2]]
    n, total = len(held), sum(h[2] for h in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c, k in held:
            m = 100 - 75 + (75 * k * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in words(text) if t in c)
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scores)[:10])]
    return sorted(out, key=str)


def rows(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


def test_twin(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    got = rows(lexical.op11_ball_tree(spark, DATA))
    assert got == sorted(con.execute(lexical.oracle()).fetchall(), key=str)
    assert got == brute(con.execute("select doc_id, text from documents").fetchall(), con.execute("select item_id, text from benchmark").fetchall())


def test_many_small_trees_and_blocks(spark, monkeypatch):
    r = np.random.default_rng(1)
    vocabulary = [f"w{k}" for k in range(60)]
    text = lambda n: " ".join(vocabulary[min(59, int(k))] for k in r.exponential(9, n))
    docs = [(k, text(int(r.integers(1, 30)))) for k in range(400)] + [(500 + k, "w1 w2 w3") for k in range(60)] + [(-5, text(5)), (None, "w1 w2 w3"), (None, "w40 W41"), (7007, None), (8008, " ,;"), (9009, "w59 " * 30_000)]
    items = [(f"i{k}", text(6)) for k in range(30)] + [("same", "w1 w1 W2"), ("same", "w1 w1 W2"), ("none", "unknown"), ("null", None), (None, "w40 w41")]
    monkeypatch.setattr(lexical, "LEAF", 3)
    monkeypatch.setattr(lexical, "LEAF_ROOM", 200)
    d = spark.createDataFrame([(*x, 1, 2, "z") for x in docs], "doc_id long, text string, n int, rank int, item string").repartition(3)
    i = spark.createDataFrame([(*x, 5) for x in items], "item_id string, text string, score int")
    assert rows(lexical.rank(d, i, block_bytes=60)) == brute(docs, items)
    assert rows(lexical.rank(d.where("doc_id in (7007, 8008)"), i)) == [] and rows(lexical.rank(d, i.where("item_id = 'none'"))) == []
    assert rows(lexical.rank(d.where("doc_id > 99999"), i.where("score > 9"))) == []


def test_bounds_hold_and_prune():
    r = np.random.default_rng(2)
    groups = [r.choice(300, 12, replace=False) for _ in range(40)]
    docs = [np.unique(r.choice(groups[k % 40], 6)) for k in range(2000)]
    values = [r.integers(1, 1_000_000, len(d)) for d in docs]
    starts = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    scale = np.sqrt(r.integers(1, 9000, 300).astype(float))
    tree = lexical.Tree(np.concatenate(docs).astype(np.int64), np.concatenate(values), starts, np.arange(2000), scale)
    where = {int(i): k for k, i in enumerate(tree.ids)}
    whole = np.zeros(300, np.int64)
    ids = groups[3][:4]
    whole[ids] = r.integers(1, 9000, 4)
    part = whole / scale
    length = math.sqrt(part @ part) * (1 + 1e-12)
    exact = [int((whole[d] * v).sum()) for d, v in zip(docs, values, strict=True)]
    for n, (*_, left, a, b) in enumerate(tree.nodes):
        if left < 0:
            assert tree.bound(n, whole, part, length) >= max(exact[int(tree.ids[k])] for k in range(a, b))
    assert tree.bound(0, whole, part, length) >= max(exact) and len(where) == 2000
    best = []
    scored = tree.search(whole, part, length, best)
    assert sorted(best, reverse=True) == sorted(((s, -k) for k, s in enumerate(exact) if s > 0), reverse=True)[:10]
    assert scored < 1500
