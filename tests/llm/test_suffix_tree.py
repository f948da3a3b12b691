"""The suffix tree against counts in dictionaries, and the sums by key ranges with and without relays."""

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow.compute as pc
import pytest

from reelspark.llm import common, suffix_tree

DATA = "/root/testdata/sf0.001"


def brute(rows, depth, smooth, diverge):
    """doc_id -> the contract's columns and the tree's score, by plain counts of word tuples."""
    out, grams, contexts = {}, Counter(), Counter()
    split = [(i, (t or "").encode().lower().split(), zlib.crc32(str(i).encode()) % 5 == 1 if i is not None else False) for i, t in rows]
    seqs = [(i, [b"<s>"] * depth + w + [b"</s>"], held) for i, w, held in split]
    for _, s, held in seqs:
        if not held:
            for at in range(depth, len(s)):
                for d in range(depth + 1):
                    grams[tuple(s[at - d : at + 1])] += 1
                    contexts[tuple(s[at - d : at])] += 1
    n = sum(v for k, v in grams.items() if len(k) == 1)
    room = n + 0.5 * (sum(len(k) == 1 for k in grams) + 1)

    def p(context, symbol):
        if not context:
            return (grams[(symbol,)] + 0.5) / room
        up = p(context[1:], symbol)
        return (grams[(*context, symbol)] + smooth * up) / (contexts[context] + smooth) if contexts[context] else up

    gain = Counter()
    for g, c in grams.items():
        if len(g) > 1 and contexts[g[:-1]] > 1:
            up = p(g[1:-1], g[-1])
            gain[g[:-1]] += c * math.log((c - 1 + smooth * up) / ((contexts[g[:-1]] - 1 + smooth) * up))
    for i, s, held in seqs:
        base = score = 0.0
        for at in range(depth, len(s)):
            state = next((tuple(s[at - d : at]) for d in range(depth, 0, -1) if gain[tuple(s[at - d : at])] > diverge), ())
            base += math.log10(p((), s[at]))
            score += math.log10(p(state, s[at]))
        known = sum(grams[(w,)] > 0 for w in s[depth:])
        out.setdefault(i, []).append((held, len(s) - depth, known, n, base, score))
    return out


ROWS = [(k, t) for k, t in enumerate(["a b c a b c a b d", None, "", "a b c a b c", "  \n", "x y z", "a b C", "the cat the dog the cat sat", "the cat the dog", "é ß é ß é", "A\u00a0b a"] * 4)] + [(None, "a b"), (3, "a b c a b c"), (7, "w " * 3000)]


@pytest.mark.parametrize("depth,fan,per_range,size", [(3, 64, 3, 8_000_000), (2, 2, 1, 2000), (5, 3, 2, 500)])
def test_against_brute_force(spark, depth, fan, per_range, size):
    d = spark.createDataFrame([(i, t, "x", 1.0) for i, t in ROWS], "doc_id long, text string, score string, chunk double").repartition(3)
    got = {}
    for r in suffix_tree.score(d, depth=depth, fan=fan, per_range=per_range, slice_bytes=size).collect():
        got.setdefault(r["doc_id"], []).append(tuple(r)[1:])
    want = brute(ROWS, depth, suffix_tree.SMOOTH, suffix_tree.DIVERGE)
    assert set(got) == set(want)
    for i, rows in want.items():
        for a, b in zip(sorted(got[i]), sorted(rows), strict=True):
            assert a[:4] == b[:4] and a[4:] == pytest.approx(b[4:], rel=1e-9)


def test_empty_and_no_training(spark):
    d = spark.createDataFrame([], "doc_id long, text string")
    assert suffix_tree.score(d).count() == 0
    held = next(i for i in range(50) if zlib.crc32(str(i).encode()) % 5 == 1)
    r = suffix_tree.score(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).first()
    assert r["held_out"] and r["n_known"] == 0 and r["train_tokens"] == 0 and r["score"] == r["base_score"] == pytest.approx(0.0)


def test_held_out_text_scores_above_its_base(spark):
    r = suffix_tree.op1_suffix_tree(spark, DATA).where("held_out").agg({"score": "sum", "base_score": "sum"}).first()
    assert r["sum(score)"] > r["sum(base_score)"]


def test_tally_moves_rows_in_proportion_to_senders(spark):
    def asks(senders, parts):
        rows = []
        for s in range(senders):
            keys = np.unique(np.random.default_rng(s).integers(0, 1 << 64, 50, dtype=np.uint64) | np.uint64(1))
            rows += common.ask_table(s, keys, np.arange(len(keys)), parts, 0).to_pylist()
        return spark.createDataFrame(rows, common.ASK)

    counts = {}
    for n in (8, 16, 32):
        a = asks(n, 4)
        got = common.tally(a, n, 4, n * 2, 0, np.int64, lambda sums: sums)
        assert got.count() == a.count() == 4 * n
        for r in got.where("sender = 3").collect():
            mine = a.where(f"sender = 3 and place = {r['place']}").first()
            assert np.array_equal(common.unpack(r["reply"], np.int64), common.unpack(mine["values"], np.int64))
        counts[n] = a.count()
    assert counts[16] == 2 * counts[8] and counts[32] == 4 * counts[8]


def test_packed_keys():
    keys = np.unique(np.concatenate([np.arange(0, 1 << 40, 1 << 30, dtype=np.uint64), np.array([3, 7, 2**63 + 1], np.uint64)]))
    assert np.array_equal(common.unpack_keys(common.pack_keys(keys, 8), 8), keys) and len(common.unpack_keys(common.pack_keys(keys[:0], 8), 8)) == 0


def test_further_sums_without_keys_are_smaller_and_the_same():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 64, 1000, dtype=np.uint64) >> np.uint64(8) << np.uint64(8))
    values = np.random.default_rng(2).integers(-(1 << 23), 1 << 23, len(keys))
    values[::3] = 0
    more = common.more_table(5, [keys, keys[:0]], [values, values[:0]], 4)
    assert np.array_equal(np.concatenate([common.unpack_sparse(m[0]) for m in more["more"].to_pylist()]), values)
    assert all(len(common.unpack_sparse(m[1])) == 0 for m in more["more"].to_pylist())
    asks = common.ask_table(5, keys, values, 4, 8)
    size = lambda t, *names: sum(len(b) for n in names for b in t[n].to_pylist())
    assert sum(len(m[0]) for m in more["more"].to_pylist()) < size(asks, "keys", "values") / 2


@pytest.mark.parametrize("ranges", [4, 12])
def test_retally(spark, ranges):
    names = {s: np.unique(np.random.default_rng(s % 3).integers(0, 1 << 64, 40, dtype=np.uint64) | np.uint64(1)) for s in range(6)}
    asks = spark.createDataFrame([r for s, k in names.items() for r in common.ask_table(s, k, np.arange(len(k)), 4, 0).to_pylist()], common.ASK)
    more = spark.createDataFrame([r for s, k in names.items() for r in common.more_table(s, [k[:0], k], [np.zeros(0, np.int64), np.arange(len(k)) - s], 4).to_pylist()], common.MORE)
    got = common.retally(common.relayed(asks, 6, 4, ranges, 0, np.int64), more, 1, 0, lambda sums: sums).toArrow()
    for s, k in names.items():
        mine = common.joined(got.filter(pc.equal(got["sender"], s)), np.int64)
        assert np.array_equal(mine, sum(np.arange(len(k)) - x for x in names if x % 3 == s % 3))
