"""The corpus pipeline against a plain version of its stages, on a small table with copies, benchmark passages, secrets and junk."""

import re
from collections import defaultdict

import numpy as np
import pytest

import corpus_pipeline
from reelspark.llm import decontaminate, quality, secrets

VOCABULARY = ["".join(chr(97 + c) for c in np.random.default_rng(k).integers(0, 26, 3 + k % 5)) for k in range(400)]


def prose(seed, n):
    r = np.random.default_rng(seed)
    return " ".join(VOCABULARY[k] for k in r.integers(0, 400, n))


def shingles(text):
    w = re.sub("[A-Z]", lambda m: m[0].lower(), text or "").encode().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("corpus")
    items = [(f"i{k}", prose(900 + k, 30)) for k in range(4)]
    texts = [prose(k, 120) for k in range(120)]
    texts += [texts[3], texts[3], texts[5] + " and more", texts[7].replace(texts[7].split()[60], "changed", 1)]  # exact and near copies
    texts += [prose(300, 60) + " " + items[1][1] + " " + prose(301, 60), prose(302, 100) + " token=abcdefgh12345 " + prose(303, 30), prose(304, 20), "# * " * 60, None, "", prose(305, 3000)]
    rows = [(k, t, "en", f"s{k % 3}", len(t or ""), "extra") for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, fp string").repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(items, "item_id string, text string").write.parquet(f"{at}/benchmark.parquet")
    spark.createDataFrame([(k, 1, 0) for k in range(100)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return f"file:{at}", rows, items


def plain(rows, items):
    """doc_id -> text after the first four stages."""
    left = {}
    for i, t, *_ in rows:
        n, _, _, _, _, repeat = quality.measures(None if t is None else t.encode())
        if n >= 50 and 100 * repeat <= 50 * n:
            left[i] = t
    sets = {i: shingles(t) for i, t in left.items()}
    group = {i: i for i in left}

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for a in left:
        for b in left:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                group[y] = x
    left = {i: t for i, t in left.items() if root(i) == i}
    windows = set().union(*(decontaminate.item_windows(t.encode()) for _, t in items))
    out = {}
    for i, t in left.items():
        w = decontaminate.words(t.encode())
        hit = {p for k in range(len(w) - 12) if b" ".join(w[k : k + 13]) in windows for p in range(k, k + 13)}
        if not (hit and 20 * len(hit) >= len(w)):
            for r in secrets.RULES:
                t = re.sub(r.pattern, lambda m: "[SECRET]" if len(m[r.group]) >= r.least else m[0], t)
            out[i] = t
    return out


def test_pipeline(spark, table):
    at, rows, items = table
    want = plain(rows, items)
    assert 120 not in want and 121 not in want and 122 not in want and 123 not in want and 124 not in want and "[SECRET]" in want[125]
    pieces = defaultdict(list)
    sequences = defaultdict(list)
    for r in corpus_pipeline.run(spark, at).collect():
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(pieces) == set(want)
    for i, ps in pieces.items():
        ps.sort(key=lambda r: r["start"])
        assert [p["start"] for p in ps] == np.cumsum([0, *(p["length"] for p in ps[:-1])]).tolist() and sum(p["length"] for p in ps) == ps[0]["doc_tokens"]
    for s in sequences.values():
        s.sort()
        assert [o for o, _ in s] == np.cumsum([0, *(n for _, n in s[:-1])]).tolist() and sum(n for _, n in s) <= 1024


def test_stages_keep_columns_and_leave_clean_documents(spark, table):
    at, rows, items = table
    docs = spark.read.parquet(f"{at}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, at)
        assert kept.schema == docs.schema, name
        ids = {r["doc_id"] for r in kept.collect()}
        clean = set(range(120)) - {3, 5, 7}
        assert clean <= ids, name


def test_stages_of_an_empty_table(spark, table):
    at, *_ = table
    docs = spark.read.parquet(f"{at}/documents.parquet").where("doc_id < 0")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, at).count() == 0, name
