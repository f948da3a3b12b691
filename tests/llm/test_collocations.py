"""Phrases by stripes against brute force and the SQL twin; sharded and shared bits; odd rows."""

import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from reelspark.llm import collocations


def brute(docs, floor=30, ranks=2000):
    f, n = {}, Counter()
    for lang, text in docs:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    f.setdefault(lang or "und", Counter())[tuple(w[i : i + k])] += 1
    out = []
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if a >= floor}
        rows = []
        for p, a in found.items():
            if len(p) < 2:
                continue
            longer = [b for q, b in found.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))]
            if any(100 * b >= 80 * a for b in longer):
                continue
            score, _, l, r = min((2000000 * a // (found[p[:k]] + found[p[k:]]), k, found[p[:k]], found[p[k:]]) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, k + 1, p.decode(), -a, l, r, n[lang], -s) for k, (s, a, p, l, r) in enumerate(sorted(rows)[:ranks])]
    return sorted(out)


def rows(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.mark.parametrize("scale", ["sf0.001", "sf0.01"])
def test_twin(spark, scale):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '/root/testdata/{scale}/documents.parquet'")
    got = rows(collocations.op12_stripes(spark, f"/root/testdata/{scale}"))
    assert got == sorted(con.execute(collocations.oracle()).fetchall()) and len(got) >= 50


@pytest.mark.parametrize("bits,heavy,size", [(15, 40, 300), (26, 10**9, 8_000_000)])
def test_brute_force(spark, monkeypatch, bits, heavy, size):
    r = np.random.default_rng(4)
    vocabulary = ["the", "The", "of", "a", "b", "c", "déjà", "vu", "new", "york", "city", "\x1c", "\x00", " x"] + [f"w{k}" for k in range(3000)]
    docs = []
    for k in range(900):
        w = [vocabulary[min(len(vocabulary) - 1, int(x))] for x in r.exponential(6, r.integers(0, 25))]
        docs.append((["en", "fr", None, "und"][k % 4], "".join(x + r.choice([" ", "  ", "\t", ". ", ",", "\n"], p=[0.7, 0.1, 0.1, 0.04, 0.03, 0.03]) for x in w)))
    docs += [("en", "new york city of déjà vu")] * 40 + [("fr", "a b " * 4000), ("en", None), ("en", ""), ("en", "..."), ("xx", "rare words"), ("de", "." + "q r s t u. " * 50)]
    monkeypatch.setattr(collocations, "BITS", bits)
    monkeypatch.setattr(collocations, "HEAVY", heavy)
    monkeypatch.setattr(collocations, "SLICE_BYTES", size)
    monkeypatch.setattr(collocations, "RANKS", 60)
    d = spark.createDataFrame([(*x, "z", 1, 2) for x in docs], "lang string, text string, phrase string, rank int, f int").repartition(3)
    assert rows(collocations.collocations(d)) == brute(docs, ranks=60)


def test_none(spark):
    d = spark.createDataFrame([(None, "a b c"), ("en", None)], "lang string, text string")
    assert rows(collocations.collocations(d)) == [] and rows(collocations.collocations(d.where("lang = 'zz'"))) == []


def test_bitmap_knows_all_frequent(spark):
    d = spark.createDataFrame([("en", f"w{k} w{k + 1}", 30 + k) for k in range(500)], "lang string, phrase string, f long")
    known, heavy = collocations.bitmaps(d)
    import pyarrow as pa

    for k in range(500):
        w = collocations.Words(pa.array([f"w{k} w{k + 1}"]))
        own = w.hashes("en")[w.code]
        assert collocations.has(known, collocations.chain(own[:1], own[1]))[0]
