"""SimHash fingerprints and near-duplicate groups by bit-sliced comparison.

Fingerprints that differ in at most RADIUS = 3 bits agree, by the pigeonhole principle, in one of four 16-bit blocks, and
in one of four 12-bit parts of what is left; so each goes into 16 bins of 28 known bits. In a bin they are laid out in
tiles of 64: bit plane b of a tile is one machine word with bit b of its 64 fingerprints. A fingerprint is compared with a
whole tile by XOR with each plane and saturating carry-save counters, and a tile is dropped once all its distances exceed
the radius. Bins of any size are compared whole: one beyond BIN_ROWS is split into blocks and the pairs of blocks are dealt to tasks.

Null and wordless texts have fingerprint zero, which links like any other; equal fingerprints are one node, so exact
copies, however many, add no pairs; rows that repeat keep one result each; a null doc_id is after all others, so it names a
component only if nothing else does; extra columns, whatever their names, are ignored; an empty table gives no rows. Texts are
hashed whole, some thousand shingles at a time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import minhash
from .common import marked, saved

RADIUS, SHINGLE, SEED = 3, 3, 42
#: Fingerprints of a bin that one task compares at once; larger bins are dealt out as pairs of such blocks.
BIN_ROWS = 2048
#: Planes compared between two looks at which tiles are still within the radius.
LOOK = 8
_PART = 4096


def fingerprint(text: bytes | None, size: int = SHINGLE) -> int:
    words = (text or b"").lower().split()  # bytes.lower(): A-Z alone
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    ones = np.zeros(64, np.int64)
    for k in range(0, len(shingles), _PART):
        h = np.array([xxhash.xxh64_intdigest(s, SEED) for s in shingles[k : k + _PART]], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint16)
    return int(np.packbits(2 * ones > len(shingles), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, size: int = SHINGLE, name: str = "fp") -> DataFrame:
    """All columns of docs and the fingerprint as a signed 64-bit integer."""

    def rows(batches):
        for b in batches:
            rest = b.drop_columns(["__text"])
            fp = np.array([fingerprint(t, size) for t in b["__text"].to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(fp)], [*rest.schema.names, name])

    schema = docs.withColumn(name, F.lit(0).cast("long")).schema
    return docs.withColumn("__text", F.col("text").cast("binary")).mapInArrow(rows, schema)


def planes(fp: np.ndarray) -> np.ndarray:
    """(64, tiles) words: bit j of word t of plane b is bit b of fingerprint 64 t + j."""
    bits = np.unpackbits(fp.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").reshape(-1, 64, 64)
    packed = np.ascontiguousarray(np.packbits(bits.transpose(2, 0, 1), axis=2, bitorder="little"))
    return np.ascontiguousarray(packed.view(np.uint64)[:, :, 0])


def near(query: np.ndarray, tiles: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Words of the tiles' members within the radius of query[t], tile by tile; tiles: planes (64, n)."""
    if radius != 3:
        raise ValueError("two counter planes hold distances up to 3")
    out, alive = np.zeros(len(query), np.uint64), np.arange(len(query))
    one = np.zeros(len(query), np.uint64)
    two, over = one.copy(), one.copy()
    for b in range(64):
        x = tiles[b, alive] ^ (np.uint64(0) - ((query[alive] >> np.uint64(b)) & np.uint64(1)))
        carry = one & x
        one ^= x
        over |= two & carry
        two ^= carry
        if b % LOOK == LOOK - 1:
            keep = np.flatnonzero(~over)
            if len(keep) < len(alive):
                alive, one, two, over = alive[keep], one[keep], two[keep], over[keep]
            if not len(alive):
                return out
    out[alive] = ~over
    return out


class _Links:
    """Union-find over the rows of one call."""

    def __init__(self, n: int):
        self.to = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            ra, rb = self.roots(a), self.roots(b)
            k = ra != rb
            a, b = np.maximum(ra[k], rb[k]), np.minimum(ra[k], rb[k])
            np.minimum.at(self.to, a, b)

    def roots(self, a: np.ndarray) -> np.ndarray:
        r = self.to[a]
        while not np.array_equal(r, n := self.to[r]):
            r = n
        return r


def linked(group: np.ndarray, side: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) that join the rows of equal group as all pairs within the radius would; side 0 and 1: only pairs across.

    Rows come ordered by group and side. Side 2 marks groups compared with themselves.
    """
    n = len(fp)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    # a tile holds whole small groups; a group over 64 gets tiles of its own
    start = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]) | (side[1:] != side[:-1])])
    size = np.diff(np.r_[start, n])
    tile_of, slot, first, used, pairs = np.zeros(n, np.int64), np.zeros(n, np.int64), {}, 64, []
    tile = -1
    for s, m in zip(start.tolist(), size.tolist(), strict=True):
        if m <= 64 and side[s] == 2:
            if used + m > 64:
                tile, used = tile + 1, 0
                pairs.append((tile, tile))
            tile_of[s : s + m], slot[s : s + m] = tile, used + np.arange(m)
            used += m
            continue
        k = -(-m // 64)
        tile_of[s : s + m], slot[s : s + m] = tile + 1 + np.arange(m) // 64, np.arange(m) % 64
        mine, tile, used = range(tile + 1, tile + 1 + k), tile + k, 64
        if side[s] == 2:
            pairs += [(i, j) for i in mine for j in mine if i <= j]
        elif side[s] == 0:
            first[int(group[s])] = mine
        else:
            pairs += [(i, j) for i in first.get(int(group[s]), ()) for j in mine]
    at = np.zeros((tile + 1) * 64, np.uint64)
    row = np.full((tile + 1) * 64, -1)
    at[tile_of * 64 + slot], row[tile_of * 64 + slot] = fp, np.arange(n)
    p = planes(at)
    row = row.reshape(-1, 64)
    valid = np.packbits(row >= 0, axis=1, bitorder="little").view(np.uint64)[:, 0]
    links = _Links(n)
    todo = np.array(pairs, np.int64).reshape(-1, 2)
    for k in range(0, len(todo), _PART):
        ta, tb = todo[k : k + _PART].T
        for j in range(64):
            have = row[ta, j] >= 0
            a, b = ta[have], tb[have]
            hits = near(at[a * 64 + j], p[:, b]) & valid[b]
            hits[a == b] &= ~np.uint64((1 << (j + 1)) - 1)  # in its own tile, those behind it
            some = np.flatnonzero(hits)
            if len(some):
                t, bit = np.nonzero(np.unpackbits(hits[some].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
                links.join(row[a[some][t], j], row[b[some][t], bit])
    root = links.roots(np.arange(n))
    k = root != np.arange(n)
    return fp[k], fp[root[k]]


def _bins(column: str = "fp"):
    """The 16 bins of a fingerprint: which blocks they fix (4 bits) and the 28 fixed bits, as one number."""
    fp = F.col(column)

    def bits(shift: int, width: int):
        return F.shiftrightunsigned(fp, shift).bitwiseAND((1 << width) - 1)

    out = []
    for a in range(4):
        rest = [i for i in range(64) if not 16 * a <= i < 16 * a + 16]
        for c in range(4):
            part = rest[12 * c : 12 * c + 12]
            runs, k = [], 0
            while k < 12:  # the 12 bits are one run, or two around the fixed block
                m = k
                while m + 1 < 12 and part[m + 1] == part[m] + 1:
                    m += 1
                runs.append((part[k], m - k + 1))
                k = m + 1
            value = bits(16 * a, 16)
            for s, w in runs:
                value = F.shiftleft(value, w).bitwiseOR(bits(s, w))
            out.append(F.lit((a * 4 + c) << 28).cast("long").bitwiseOR(value))
    return F.array(*out)


def edges(distinct: DataFrame) -> DataFrame:
    """a, b: links whose transitive closure is that of all pairs of fp within the radius. distinct: one row an fp."""
    binned = distinct.select(F.explode(_bins()).alias("bin"), "fp")
    counts = binned.groupBy("bin").agg(F.count("*").alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / BIN_ROWS).cast("int")
    mine = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    # block pairs of a large bin: (i, j) with i <= j; the block is side 0 where it is the first, 1 where it is the second
    spread = F.when(F.col("blocks") == 1, F.array(F.struct(F.lit(0).alias("pair"), F.lit(2).alias("side")))).otherwise(
        F.transform(
            F.sequence(F.lit(0), F.col("blocks") - 1),
            lambda j: F.struct(
                (F.least(j, F.col("mine")) * F.col("blocks") + F.greatest(j, F.col("mine"))).alias("pair"),
                F.when(j == F.col("mine"), F.lit(2)).when(F.col("mine") < j, F.lit(0)).otherwise(F.lit(1)).alias("side"),
            ),
        )
    )
    dealt = (
        binned.join(counts.withColumn("blocks", blocks), "bin")
        .withColumn("mine", mine)
        .withColumn("at", F.explode(spread))
        .select(F.xxhash64("bin", "at.pair").alias("grp"), F.col("at.side").alias("side"), "fp")
    )

    def rows(batches):
        held: list[pa.RecordBatch] = []
        n = 0
        for b in batches:
            held.append(b)
            n += len(b)
            if n >= 200_000:  # whole groups go; the last may still grow
                t = pa.Table.from_batches(held)
                g = t["grp"].to_numpy()
                cut = int(np.searchsorted(g, g[-1]))
                if cut:
                    yield compared(t.slice(0, cut))
                    held = t.slice(cut).to_batches()
                    n -= cut
        if held:
            yield compared(pa.Table.from_batches(held))

    def compared(t):
        a, b = linked(t["grp"].to_numpy(), t["side"].to_numpy(), t["fp"].to_numpy().view(np.uint64))
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    return dealt.repartition("grp").sortWithinPartitions("grp", "side").mapInArrow(rows, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """node, root for every node of the links (a, b); root: one node of its component.

    Alternates the two star steps: each node hands all its larger neighbours, then all smaller ones, to its smallest.
    Every round's links are kept in the shared folder; it ends when a round changes nothing.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else e
        low = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        moved = both.join(low, "a").where(F.col("b") > F.col("a") if large else F.lit(True)).select(F.col("b").alias("x"), F.col("low").alias("y"))
        if not large:
            moved = moved.unionByName(low.select(F.col("a").alias("x"), F.col("low").alias("y")))
        return moved.where("x <> y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()

    e = saved(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        e = saved(star(star(e, True), False))
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        before = now


def _ids(docs: DataFrame, size: int) -> DataFrame:
    return fingerprints(docs.select("doc_id", "text"), size).select("doc_id", "fp")


def groups(ids: DataFrame) -> DataFrame:
    """fp, root and component_id of every distinct fingerprint of ids (doc_id, fp)."""
    nodes = ids.groupBy("fp").agg(F.min("doc_id").alias("low"))
    roots = saved(components(edges(nodes.select("fp"))))
    # rows of one fingerprint meet only after they were reduced to its smallest doc_id
    low = nodes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root"), "low")
    return low.join(low.groupBy("root").agg(F.min("low").alias("component_id")), "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """Per row: doc_id, fingerprint (hex), component_id, the smallest doc_id reachable over links, and fp, the number."""
    ids = saved(_ids(docs, size))
    return ids.join(groups(ids).drop("root"), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "fp")


def candidates(ids: DataFrame) -> DataFrame:
    """key, node and n_bytes: the sets by components of their fingerprints, one row a set. ids: rows of minhash.keyed()."""
    nodes = ids.where("node <> 0").dropDuplicates(["node"]).select("node", "n_bytes", "fp")
    roots = saved(components(edges(nodes.select("fp").distinct())))
    found = nodes.join(roots.withColumnRenamed("node", "of"), F.col("fp") == F.col("of"), "left")
    return found.select(F.xxhash64(F.lit("fingerprints"), F.coalesce("root", "fp")).alias("key"), "node", "n_bytes")


def deduplicated(docs: DataFrame) -> DataFrame:
    """One document of each group of near copies, all columns: the one with the smallest doc_id (null after all others).

    Candidates are what the bit-sliced comparison links by fingerprints of 5-word shingles, and what MinHash adds, as similar sets
    may differ in more than RADIUS bits; the sets decide all of them (minhash.py).
    """
    ids = saved(minhash.keyed(docs))
    roots = saved(components(minhash.edges(ids, docs, candidates(ids))))
    # rows of one node meet only after they were reduced to its smallest doc_id
    low = ids.groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("best"))
    best = low.join(roots, "node", "left").groupBy(F.coalesce("root", "node")).agg(F.min("best").alias("best"))
    keys = ["__none", "__id", "__row"]  # plain equality on these, so that join and dropDuplicates share one exchange
    keyed = lambda df, row: df.withColumns({"__none": F.col("doc_id").isNull(), "__id": F.coalesce("doc_id", F.lit(0).cast(docs.schema["doc_id"].dataType)), "__row": row})
    best = saved(keyed(best.select("best.doc_id", "best.row"), F.col("row")).select(*keys))
    # a row that goes, or is there more than once, is looked up exactly; all others stay where they are
    doubtful = keyed(ids, F.col("row")).groupBy(*keys).agg(F.count("*").alias("__n")).join(best.withColumn("__stays", F.lit(True)), keys, "left").where(F.col("__stays").isNull() | (F.col("__n") > 1))
    rows = marked(keyed(docs, minhash.row_key()), "__row", saved(doubtful.select("__row")), ids.count(), "__doubt")
    exact = rows.where("__doubt").join(best, keys, "left_semi").dropDuplicates(keys)
    return rows.where(~F.col("__doubt")).unionByName(exact).select(*docs.columns)


def op3_simhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("fp")
