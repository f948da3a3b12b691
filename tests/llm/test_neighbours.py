"""Nearest neighbours against brute force: recall, exact scores, copies, odd rows."""

import math

import numpy as np
import pytest

from reelspark.llm import neighbours


def brute(rows, every=20, wanted=20):
    """query_id -> (score, vec_id) of all candidates, best first; rows are distinct and usable."""
    out = {}
    for q, (i, x) in enumerate(rows):
        if i is not None and i % every == 0:
            near = []
            for c, (j, y) in enumerate(rows):
                if c != q:
                    s = 0.0
                    for a, b in zip(x, y, strict=True):
                        s += a * b
                    near.append((-s, j))
            out[i] = sorted(near)[:wanted]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((-r["score"], r["vec_id"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


@pytest.mark.parametrize("scale", ["sf0.001", "sf0.01"])
def test_recall_of_the_table(spark, scale):
    got = found(neighbours.op13_posting_lists(spark, f"/root/testdata/{scale}"))
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"/root/testdata/{scale}/embeddings.parquet").collect()]
    true = brute(rows)
    assert got.keys() == true.keys() and all(len(got[q]) == len(true[q]) for q in true)
    hits = sum(len(set(got[q]) & set(true[q])) for q in true)  # the very scores
    assert hits >= 0.9 * sum(map(len, true.values()))


def test_copies_and_lists_beyond_a_bucket(spark, monkeypatch):
    r = np.random.default_rng(3)
    middles = r.normal(size=(12, 8)) * 3
    rows = [(k, (middles[k % 12] + 0.1 * r.normal(size=8)).tolist()) for k in range(900)]
    rows += [(1000 + k, rows[0][1]) for k in range(300)] + [(2000 + k, [2 * v for v in rows[1][1]]) for k in range(40)]
    monkeypatch.setattr(neighbours, "BUCKET", 20)
    monkeypatch.setattr(neighbours, "LEAST", 60)
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    got, true = found(neighbours.search(spark, d)), brute(rows)
    assert got.keys() == true.keys()
    hits = sum(len(set(got[q]) & set(true[q])) for q in true)
    assert hits >= 0.9 * sum(map(len, true.values()))
    near = [i for _, i in got[1000]]
    assert near == [i for _, i in true[1000]] and 1000 not in near  # copies: smallest ids first


def test_odd_rows(spark):
    rows = [(20, [1.0, 0.0]), (20, [1.0, 0.0]), (20, [0.5, 0.5]), (1, [0.0, -0.0]), (2, None), (3, [1.0, None]), (4, [math.nan, 1.0]), (5, [math.inf, 1.0]), (None, [9.0, 9.0]), (6, [1.0, 2.0, 3.0]), (7, [-1.0, 0.25]), (8, [0.0, 1.0]), (40, [0.0, 1.0]), (-20, [3.0, -0.0])]
    d = spark.createDataFrame([(i, x, "q", 1, 2.0) for i, x in rows], "vec_id long, embedding array<double>, query_id string, rank int, score double").repartition(3)
    ids = neighbours.search(spark, d).groupBy("query_id").count().collect()
    assert {(r["query_id"], r["count"]) for r in ids} == {(20, 10), (40, 5), (-20, 5)}  # id 20 has two vectors, each finds the other
    got = found(neighbours.search(spark, d).where("query_id <> 20"))
    assert got[40] == [(-1.0, 8), (-0.5, 20), (-0.25, 7), (-0.0, -20), (-0.0, 20)]
    assert got[-20] == [(-3.0, 20), (-1.5, 20), (0.0, 8), (0.0, 40), (3.0, 7)]
    assert neighbours.search(spark, d.where("vec_id = 2")).count() == 0 and neighbours.search(spark, d.where("vec_id > 99")).count() == 0
    assert neighbours.search(spark, d.where("vec_id = 40")).count() == 0  # no other row
