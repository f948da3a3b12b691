"""Language identification by a blended-spectrum string kernel, Nystroem landmarks and one-versus-rest ridge regression.

The kernel of two texts is the share of letter n-grams (1 to ORDERS letters, words padded by a space, of which only the one behind
tells grams apart) present in both: |A n B| / sqrt(|A| |B|). It is learnt on a bounded, documented sample: at most PER_LANG texts a language and about SAMPLE in
all, however many languages there are, chosen by the hash of doc_id; LANDMARKS of them (2 a language where that is more, up
to LANDMARKS_MOST) span the Nystroem map K_mm^(-1/2). Prediction multiplies batches of presence rows with the landmarks'
presence matrix, then with the map and the ridge weights. No language is left out of the sample for being rare.

Null texts and texts without a letter are `und` with score 0; if nothing was learnt, all are. Labels that are null are never
learnt from, nor are rows with a null doc_id, whose held_out is false. Ties go to the language first in order. Repeated rows
get equal results; extra columns, whatever their names, are ignored; an empty table gives no rows; texts are read whole.
"""

from __future__ import annotations

import unicodedata
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import few, saved

#: Parameters of the bounded sample and the kernel.
PER_LANG, SAMPLE, LANDMARKS, LANDMARKS_MOST, ORDERS, RIDGE = 300, 60_000, 192, 1024, 3, 1e-3
BITS = 17
_BATCH = 128


def _letters() -> np.ndarray:
    """Code points to what the kernel sees: a lower-case letter's number, or 0 (a gap) for anything else."""
    out = np.zeros(0x10000, np.uint32)
    for c in range(0x10000):
        s = chr(c)
        if s.isalpha():
            low = s.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


_TABLE: list[np.ndarray] = []


def grams(text: str | None) -> np.ndarray:
    """Buckets of the n-grams present, once each; empty if there is no letter."""
    if not _TABLE:
        _TABLE.append(_letters())
    cp = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)
    x = _TABLE[0][np.minimum(cp, 0xFFFF)]
    far = np.flatnonzero(cp > 0xFFFF)
    if len(far):
        x[far] = [ord(c) if unicodedata.category(c)[0] == "L" else 0 for c in map(chr, cp[far].tolist())]
    if not x.any():
        return np.zeros(0, np.int64)
    x = np.concatenate([[0], x, [0]]).astype(np.uint64)
    seen = np.zeros(1 << BITS, bool)
    h = np.zeros(len(x), np.uint64)
    for n in range(ORDERS):
        h = (h[: len(x) - n] * np.uint64(0x2545F4914F6CDD1D)) + x[n:]
        real = (x[: len(h)] != 0) | (x[n:] != 0)  # a gram of gaps alone says nothing
        m = h[real] * np.uint64(0x9E3779B97F4A7C15)
        seen[(m >> np.uint64(64 - BITS)).astype(np.int64)] = True
    return np.flatnonzero(seen)


class Model:
    """scores(list of presence arrays) -> one row a text, one column a language."""

    def __init__(self, langs: list[str], labels: np.ndarray, sets: list[np.ndarray]):
        self.langs = langs
        n = max(LANDMARKS, min(2 * len(langs), LANDMARKS_MOST))
        order = np.argsort(np.arange(len(sets)) % max(1, len(sets) // n), kind="stable")[:n]
        marks = [sets[k] for k in order]
        used = np.unique(np.concatenate(marks)) if marks else np.zeros(0, np.int64)
        self.column = np.full(1 << BITS, len(used), np.int32)
        self.column[used] = np.arange(len(used))
        self.marks = np.zeros((len(used) + 1, len(marks)), np.float32)
        for k, m in enumerate(marks):
            self.marks[self.column[m], k] = 1
        self.norm = np.sqrt(np.array([len(m) for m in marks], np.float32))
        k = self.kernel(marks).astype(np.float64)
        w, v = np.linalg.eigh((k + k.T) / 2)
        keep = w > 1e-8
        self.map = (v[:, keep] / np.sqrt(w[keep])) @ v[:, keep].T
        phi = np.concatenate([self.kernel(sets[i : i + _BATCH]) for i in range(0, len(sets), _BATCH)]) @ self.map
        phi = np.c_[phi, np.ones(len(phi))]
        y = np.where(labels[:, None] == np.arange(len(langs)), 1.0, -1.0)
        share = 1.0 / np.bincount(labels, minlength=len(langs))[labels]  # each language weighs the same
        self.weights = np.linalg.solve(phi.T @ (phi * share[:, None]) + RIDGE * np.eye(phi.shape[1]), phi.T @ (y * share[:, None]))
        self.final = (self.map @ self.weights[:-1]).astype(np.float32)

    def kernel(self, sets: list[np.ndarray]) -> np.ndarray:
        x = np.zeros((len(sets), len(self.marks)), np.float32)
        for k, s in enumerate(sets):
            x[k, self.column[s]] = 1
        x[:, -1] = 0  # grams of no landmark
        size = np.sqrt(np.array([max(1, len(s)) for s in sets], np.float32))
        return (x @ self.marks) / (size[:, None] * self.norm)

    def scores(self, sets: list[np.ndarray]) -> np.ndarray:
        return self.kernel(sets) @ self.final + self.weights[-1]


def held_out(doc_id) -> F.Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0


def sample(docs: DataFrame, per_lang: int = PER_LANG) -> DataFrame:
    """Up to about per_lang labelled rows a language with text, by the hash of doc_id: doc_id, lang, text."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull())
    sizes = saved(known.groupBy("lang").agg(F.count("*").alias("__n")))
    each = max(1, min(per_lang, SAMPLE // max(1, sizes.count())))
    spot = F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    return known.select("doc_id", "lang", "text", spot.alias("__spot")).join(few(sizes), "lang").where(F.col("__spot") < F.lit(each) / F.col("__n")).select("doc_id", "lang", "text")


def fit(docs: DataFrame, per_lang: int = PER_LANG) -> Model | None:
    def rows(batches):
        for b in batches:
            sets = [np.packbits(np.isin(np.arange(1 << BITS), grams(t))).tobytes() for t in b["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["lang"], pa.array([zlib.compress(s, 1) for s in sets], pa.binary())], ["doc_id", "lang", "bits"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    got = sorted(((r["lang"], r["doc_id"], bytes(r["bits"])) for r in sample(docs, per_lang).mapInArrow(rows, f"doc_id {kind}, lang string, bits binary").toLocalIterator()), key=lambda x: x[:2])
    sets = [np.flatnonzero(np.unpackbits(np.frombuffer(zlib.decompress(x[2]), np.uint8))) for x in got]
    got, sets = zip(*[(g, s) for g, s in zip(got, sets, strict=True) if len(s)], strict=True) if any(map(len, sets)) else ((), ())
    if not got:
        return None
    number = {lang: k for k, lang in enumerate(sorted({g[0] for g in got}))}
    return Model(list(number), np.array([number[g[0]] for g in got]), list(sets))


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """Per row: doc_id, held_out, lang_pred and score, the softmax share of its language's ridge output."""
    kind, shared = docs.schema["doc_id"].dataType.simpleString(), docs.sparkSession.sparkContext.broadcast(model)

    def rows(batches):
        m = shared.value
        for b in batches:
            texts, lang, score = b["text"].to_pylist(), [], []
            for k in range(0, len(texts), _BATCH):
                sets = [grams(t) for t in texts[k : k + _BATCH]]
                if m is None:
                    lang += ["und"] * len(sets)
                    score += [0.0] * len(sets)
                    continue
                s = 4 * m.scores(sets)
                e = np.exp(s - s.max(axis=1, keepdims=True))
                best = e.argmax(axis=1)
                p = e[np.arange(len(s)), best] / e.sum(axis=1)
                lang += [m.langs[i] if len(x) else "und" for i, x in zip(best, sets, strict=True)]
                score += [float(v) if len(x) else 0.0 for v, x in zip(p, sets, strict=True)]
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["held_out"], pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    out = docs.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "text")
    return out.mapInArrow(rows, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def op9_language(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return predict(docs, fit(docs))
