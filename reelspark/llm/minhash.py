"""Near copies: texts whose sets of 5-word shingles have a Jaccard similarity of at least 0.8, checked exactly.

Candidates share one of BANDS keys, each made of ROWS minima of the shingles' hashes (MinHash): a pair of similarity s
is compared with probability 1 - (1 - s^ROWS)^BANDS, 0.99992 at 0.8 and more above it. Whoever calls can name more
keys; simhash.py names the groups of its fingerprints. Keys that stand for the same texts are compared once. All pairs of a key are decided by the sets themselves; a key of more than BLOCK_BYTES of sets is
split into blocks and the pairs of blocks are dealt to tasks. Within a task, pairs already linked are not compared again.

Words are split at ASCII white space, A-Z lower-cased; a text under five words is one shingle of all its words. Texts of
equal sets are one node, so exact copies, however many, add no pairs; null and wordless texts are node zero.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import majority, mix, seem_among

SHINGLE, SIMILARITY, BANDS, ROWS, SEED = 5, (4, 5), 24, 5, 42
#: Bytes of shingle sets in one block of a key.
BLOCK_BYTES = 8_000_000
#: Bytes that one call compares at least, if there are as many.
CALL_BYTES = 16_000_000
_PART = 2048
_ODD = np.uint64(0x9E3779B97F4A7C15)
_TIMES, _PLUS = np.random.default_rng(SEED).integers(0, 1 << 63, (2, BANDS * ROWS, 1), dtype=np.uint64)
_TIMES = 2 * _TIMES + np.uint64(1)


def shingles(text: bytes | None) -> np.ndarray:
    """The distinct shingles' hashes, ascending."""
    words = (text or b"").lower().split()  # bytes.lower(): A-Z alone
    if not words:
        return np.zeros(0, np.uint64)
    w = np.array([xxhash.xxh64_intdigest(x, SEED) for x in words], np.uint64)
    n = max(1, len(w) - SHINGLE + 1)
    h = np.zeros(n, np.uint64)
    for j in range(min(SHINGLE, len(w))):
        h = mix(h * _ODD + w[j : j + n])
    return np.unique(h)


def node(s: np.ndarray) -> int:
    """A set's number, signed; zero for none."""
    return int(np.uint64(xxhash.xxh64_intdigest(s.tobytes(), SEED)).astype(np.int64)) if len(s) else 0


def bands(s: np.ndarray) -> np.ndarray:
    """The keys of a set, which is not empty."""
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(s), _PART):
        np.minimum(low, (s[k : k + _PART] * _TIMES + _PLUS).min(axis=1), out=low)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in low.reshape(BANDS, ROWS).T:
        key = mix(key * _ODD + column)
    return key.view(np.int64)


def row_key() -> Column:
    """A row's document and text in one number."""
    return F.xxhash64("doc_id", "text")


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, row (its row_key), node, n_bytes of the set, its keys and fp, the SimHash fingerprint of the set (zero for none)."""

    def rows(batches):
        for b in batches:
            for k in range(0, len(b), 512):
                part = b.slice(k, 512)
                sets = [shingles(t) for t in part["text"].to_pylist()]
                keys = [bands(s) if len(s) else [] for s in sets]
                fp = np.array([majority(s) if len(s) else 0 for s in sets], np.uint64)
                yield pa.RecordBatch.from_arrays([part["doc_id"], part["row"], pa.array(map(node, sets), pa.int64()), pa.array([s.nbytes for s in sets], pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(fp.view(np.int64))], ["doc_id", "row", "node", "n_bytes", "keys", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", row_key().alias("row"), F.col("text").cast("binary").alias("text")).mapInArrow(rows, f"doc_id {kind}, row long, node long, n_bytes long, keys array<long>, fp long")


def shingle_sets(docs: DataFrame) -> DataFrame:
    """node and shingles (bytes), one row a node."""

    def rows(batches):
        for b in batches:
            for k in range(0, len(b), 512):
                sets = {node(s): s.tobytes() for s in map(shingles, b["text"].slice(k, 512).to_pylist())}
                yield pa.RecordBatch.from_arrays([pa.array(sets, pa.int64()), pa.array(sets.values(), pa.binary())], ["node", "shingles"])

    return docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(rows, "node long, shingles binary").dropDuplicates(["node"])


def linked(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links that join the sets as all similar pairs would."""
    num, den = SIMILARITY
    size = np.array([len(s) for s in sets])
    start = np.r_[0, np.cumsum(size)[:-1]]
    number = np.unique(np.concatenate(sets), return_inverse=True)[1]
    mark = np.zeros(number.max() + 1, bool)
    root, out = np.arange(len(sets)), []
    for i in range(len(sets) - 1):
        later = np.arange(i + 1, len(sets))
        later = later[(root[later] != root[i]) & (den * np.minimum(size[later], size[i]) >= num * np.maximum(size[later], size[i]))]
        if not len(later):
            continue
        mine = number[start[i] : start[i] + size[i]]
        mark[mine] = True
        if len(later) * 4 < len(sets) - i:
            both = np.array([np.count_nonzero(mark[number[start[j] : start[j] + size[j]]]) for j in later])
        else:
            both = np.add.reduceat(mark[number[start[i] :]].view(np.uint8), start[i:] - start[i], dtype=np.int64)[later - i]
        mark[mine] = False
        for j in later[den * both >= num * (size[i] + size[later] - both)]:
            if root[j] != root[i]:
                root[root == root[j]] = root[i]
                out.append((i, int(j)))
    return out


def edges(ids: DataFrame, docs: DataFrame, more: DataFrame | None = None) -> DataFrame:
    """a, b: links whose transitive closure is that of all compared pairs that are similar. ids: the saved rows of keyed(docs).
    more: key, node and n_bytes, further groups whose pairs are compared.

    Only texts that share a key with another one are read again for their sets: one row a node, found by its row_key.
    """
    binned = ids.dropDuplicates(["node"]).select(F.explode("keys").alias("key"), "node", "n_bytes")
    if more is not None:
        binned = binned.unionByName(more)
    counts = binned.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor("node").alias("who"), F.sum("n_bytes").alias("n_bytes")).where("n > 1")
    counts = counts.groupBy("n", "who", "n_bytes").agg(F.min("key").alias("key"))
    counts = counts.select("key", F.ceil(F.col("n_bytes") / BLOCK_BYTES).cast("int").alias("blocks"))
    # a pair of blocks is compared whole, so that the pairs within a block need no pair of their own
    spread = F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(
        F.transform(
            F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: j != F.col("mine")),
            lambda j: F.least(j, F.col("mine")) * F.col("blocks") + F.greatest(j, F.col("mine")),
        )
    )
    dealt = (
        binned.select("key", "node")
        .join(counts, "key")
        .withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        .withColumn("pair", F.explode(spread))
        .select(F.xxhash64("key", "pair").alias("grp"), "node")
    )

    def rows(batches):
        held, size = [], 0
        for b in batches:
            held.append(b)
            size += b.nbytes
            if size >= CALL_BYTES:  # whole groups go; the last may still grow
                t = pa.Table.from_batches(held)
                g = t["grp"].to_numpy()
                cut = int(np.searchsorted(g, g[-1]))
                if cut:
                    yield compared(t.slice(0, cut))
                    held = t.slice(cut).to_batches()
                    size = t.slice(cut).nbytes
        if held:
            yield compared(pa.Table.from_batches(held))

    def compared(t):
        g, who, body = t["grp"].to_numpy(), t["node"].to_numpy(), t["shingles"]
        ends = [*(np.flatnonzero(g[1:] != g[:-1]) + 1).tolist(), len(g)]
        a, b, begin = [], [], 0
        for end in ends:
            if end - begin > 1:
                for i, j in linked([np.frombuffer(x, np.uint64) for x in body.slice(begin, end - begin).to_pylist()]):
                    a.append(who[begin + i])
                    b.append(who[begin + j])
            begin = end
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    rows_of = ids.groupBy("node").agg(F.min("row").alias("row")).join(dealt.select("node").distinct(), "node", "left_semi")
    again = seem_among(docs.select("text", row_key().alias("__row")), "__row", rows_of.select(F.col("row").alias("__row")), ids.count())
    return dealt.join(shingle_sets(again), "node").repartition("grp").sortWithinPartitions("grp").mapInArrow(rows, "a long, b long")
