"""Exact ranked lexical search: documents as sparse vectors in ball trees, searched best-first for the largest inner product.

A document's component for a term is (10**9 * tf) div (1000 * tf + 8 * m), an item's is the term's weight times its occurrences;
the score is their inner product in 64-bit integers. Weights and m need the whole table: how many documents have terms, how many
terms they have, and in how many documents each term stands.

Documents are read and cut into terms once a block of items; what is kept, in the shared folder, is each document's term count and
the occurrences of the block's terms. Each task then gathers documents up to LEAF_ROOM components at a time into a ball tree: a
node is cut in halves along the line between two far documents, and holds its documents' mean, the radius around it, and for each
term how far above its mean a document is at most. The metric weighs each component by the root of its term's weight. The bound
of a node for an item is the lower of <item, mean> + |item| * radius and the inner product with the mean raised by the terms'
own radii; the latter prunes more, as an item has few of the terms in which documents differ. Means, radii and the first bound
are doubles and are rounded up by more than their errors can add up to; the second is kept in whole numbers.
An item looks at nodes by falling bound and stops at the first that is below its tenth best score so far (not at one that equals
it, so that ties are seen); leaves are scored exactly. A task's best are carried from tree to tree and are all that it returns:
at most TOP rows an item.

Items are a stated set of queries, searched in blocks: items with equal texts are searched once, and distinct texts are dealt by
hash into blocks of about BLOCK_BYTES, so what the driver and each task hold of them has a bound. Each block reads all documents.

Null and termless texts of documents have no terms, are not counted and are never found; null and termless items find nothing.
Rows may repeat: a repeated document is found as often as it stands there, a repeated item ranks for itself each time. Documents
with equal scores go by ascending doc_id, null ones last. Very long texts are cut as a whole. Extra columns are ignored whatever
their names; with no documents or no items there are no rows.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import pack, split_words, unpack, written

TOP, LEAF, LEAF_ROOM, BLOCK_BYTES, SLICE_BYTES = 10, 24, 600_000, 4_000_000, 8_000_000
#: Bytes of letters, digits and all beyond ASCII make terms; A-Z becomes a-z.
_KIND = np.array([0 if bytes([b]).isalnum() or b > 127 else 1 for b in range(256)], np.uint8)
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
_FOUND = "item string, doc_id long, score long"


def terms(text: str | None) -> list[bytes]:
    distinct, code, *_ = split_words(pa.array([text or ""]), _KIND, _LOWER)
    return distinct.take(pa.array(code)).to_pylist()


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def norming(n_terms: int, n: int, total: int) -> int:
    """A document's m, from its terms, the documents with terms and all their terms."""
    return 100 - 75 + (75 * n_terms * n) // total


class Tree:
    """A ball tree over sparse documents: numbers of terms, components of 64-bit integers, where each document begins, and ids."""

    def __init__(self, term: np.ndarray, value: np.ndarray, starts: np.ndarray, ids: np.ndarray, scale: np.ndarray):
        self.term, self.value, self.ids = term, value, ids
        self.sizes, self.scale = np.diff(starts), scale
        self.nodes: list[tuple] = []  # mean's terms, mean, raised mean, radius, left, right; in place of children -1, first and last document
        self._build(0, len(ids))
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])

    def _build(self, a: int, b: int) -> int:
        """Node of documents a to b, which get into the order of its leaves."""
        lo, hi = int(self.sizes[:a].sum()), int(self.sizes[:b].sum())
        sizes = self.sizes[a:b]
        idx, at = np.unique(self.term[lo:hi], return_inverse=True)
        x = self.value[lo:hi] * self.scale[self.term[lo:hi]]
        doc = np.repeat(np.arange(b - a), sizes)
        mean = np.bincount(at, x, len(idx)) / (b - a)
        most = np.zeros(len(idx), np.int64)
        np.maximum.at(most, at, self.value[lo:hi])
        norm, mean2 = np.bincount(doc, x * x, b - a), float(mean @ mean)
        far = norm - 2 * np.bincount(doc, x * mean[at], b - a) + mean2
        # sums of n terms are off by less than n * 2**-52 of the sum of their sizes; 4e-16 * (n + 8) covers that
        slack = 4e-16 * (len(x) + 8) * (norm + mean2 + 2 * np.sqrt(norm * mean2))
        radius = math.sqrt(max(0.0, float((far + slack).max()))) * (1 + 1e-12)
        me = len(self.nodes)
        self.nodes.append(())
        if b - a <= LEAF or not far.max() > 0:
            self.nodes[me] = (idx, mean, most, radius, -1, a, b)
            return me
        one = np.zeros(len(idx))
        first = int(np.argmax(far))
        one[at[doc == first]] = x[doc == first]
        away = norm - 2 * np.bincount(doc, x * one[at], b - a)
        second = int(np.argmax(away))
        one[at[doc == second]] -= x[doc == second]
        order = np.argsort(np.bincount(doc, x * one[at], b - a), kind="stable")
        place = np.argsort(np.argsort(order)[doc], kind="stable")  # components follow their documents
        self.term[lo:hi], self.value[lo:hi] = self.term[lo:hi][place], self.value[lo:hi][place]
        self.ids[a:b], self.sizes[a:b] = self.ids[a:b][order], sizes[order]
        middle = (a + b) // 2
        left = self._build(a, middle)
        self.nodes[me] = (idx, mean, most, radius, left, self._build(middle, b), 0)
        return me

    def bound(self, node: int, whole: np.ndarray, item: np.ndarray, length: float) -> float:
        """At least the score of every document in the node. whole: the item's components; item: these divided by the metric's scale; length: that one's."""
        idx, mean, most, radius, *_ = self.nodes[node]
        ball = (float(item[idx] @ mean) + length * radius) * (1 + 1e-15 * (len(idx) + 64)) + 1
        return min(ball, int(whole[idx] @ most))

    def search(self, whole: np.ndarray, item: np.ndarray, length: float, best: list[tuple]) -> int:
        """Puts what belongs there into best, a heap of the TOP highest (score, -doc_id); returns how many documents were scored."""
        ahead, scored = [(-self.bound(0, whole, item, length), 0)], 0
        while ahead:
            least, node = heapq.heappop(ahead)
            if len(best) == TOP and -least < best[0][0]:
                break
            *_, left, a, b = self.nodes[node]
            if left >= 0:
                for child in (left, a):
                    bound = self.bound(child, whole, item, length)
                    if len(best) < TOP or bound >= best[0][0]:
                        heapq.heappush(ahead, (-bound, child))
                continue
            lo, hi = self.starts[a], self.starts[b]
            scores = np.add.reduceat(whole[self.term[lo:hi]] * self.value[lo:hi], self.starts[a:b] - lo)
            scored += b - a
            least = best[0][0] if len(best) == TOP else 1
            for k in np.nonzero(scores >= max(1, least))[0]:
                got = (int(scores[k]), -int(self.ids[a + k]))
                if len(best) < TOP:
                    heapq.heappush(best, got)
                elif got > best[0]:
                    heapq.heapreplace(best, got)
        return scored


#: Stands for a null doc_id, after all others.
_NULL = (1 << 63) - 1


def vectors(docs: DataFrame, vocabulary) -> DataFrame:
    """doc_id, n (its terms), term (numbers of those in the vocabulary, packed) and tf (packed) of documents with terms. vocabulary: a broadcast dict."""

    def read(batches):
        number = vocabulary.value
        for b in batches:
            sizes = np.cumsum(pc.binary_length(b.column(1)).to_numpy(zero_copy_only=False).astype(np.int64))
            cuts = np.searchsorted(sizes, np.arange(SLICE_BYTES, int(sizes[-1]) if len(sizes) else 0, SLICE_BYTES), "right")
            for lo, hi in pairwise(np.unique([0, *cuts, len(b)]).tolist()):
                part = b.slice(lo, hi - lo)
                distinct, code, doc, _ = split_words(part.column(1), _KIND, _LOWER)
                known = np.array([number.get(t, -1) for t in distinct.to_pylist()], np.int64)
                n, at = np.bincount(doc, minlength=len(part)), known[code] if len(code) else code
                keys, tf = np.unique((doc * len(number) + at)[at >= 0], return_counts=True)
                of, term = keys // max(1, len(number)), keys % max(1, len(number))
                edge = np.searchsorted(of, np.arange(len(part) + 1))
                with_terms = np.nonzero(n)[0]
                packed = [(pack(term[edge[k] : edge[k + 1]].astype(np.int32), True), pack(tf[edge[k] : edge[k + 1]])) for k in with_terms]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(with_terms)), pa.array(n[with_terms]), pa.array([p for p, _ in packed], pa.binary()), pa.array([p for _, p in packed], pa.binary())], names=["doc_id", "n", "term", "tf"])

    return docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).mapInArrow(read, "doc_id long, n long, term binary, tf binary")


def holding(found: DataFrame) -> dict[int, int]:
    """In how many documents each term number of the block stands."""

    def count(batches):
        for b in batches:
            all_ = [unpack(x, np.int32, True) for x in b.column(0).to_pylist()]
            ids, n = np.unique(np.concatenate(all_), return_counts=True) if all_ else (np.zeros(0, np.int32), np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(n, pa.int64())], names=["term", "n"])

    got = found.select("term").mapInArrow(count, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()  # a row a term of the block
    return dict(zip(got["term"].to_pylist(), got["n"].to_pylist(), strict=True))


def best_of_block(docs: DataFrame, items: list[tuple[str, Counter]]) -> DataFrame | None:
    """Rows of _FOUND: for each (key, term counts) its highest documents of every task that has some."""
    spark = docs.sparkSession
    number = {t: k for k, t in enumerate(sorted({t for _, c in items for t in c}))}
    vocabulary = spark.sparkContext.broadcast(number)
    found = written(vectors(docs, vocabulary), "terms")
    n, total = found.agg(F.count("*"), F.sum("n")).first()
    if not n:
        return None
    df = holding(found)
    weights = np.array([weight(n, df.get(k, 0)) for k in range(len(number))], np.int64)
    # an item's components, whole and divided by the metric's scale, term by term
    scale = np.sqrt(np.maximum(weights, 1).astype(np.float64))
    asked = []
    for key, c in items:
        ids = np.array([number[t] for t in c], np.int64)
        whole = np.array(list(c.values()), np.int64) * weights[ids]
        if len(ids):
            part = whole / scale[ids]
            asked.append((key, ids, whole, part, math.sqrt(float(part @ part)) * (1 + 1e-12)))
    told = spark.sparkContext.broadcast((asked, scale))

    def search(batches):
        asked, scale = told.value
        heaps: list[list[tuple]] = [[] for _ in asked]
        whole, part = np.zeros(len(scale), np.int64), np.zeros(len(scale))
        rows: list[tuple] = []
        room = 0

        def through() -> None:
            starts = np.concatenate([[0], np.cumsum([len(r[1]) for r in rows])])
            tree = Tree(np.concatenate([r[1] for r in rows]).astype(np.int64), np.concatenate([r[2] for r in rows]), starts, np.array([r[0] for r in rows], np.int64), scale)
            for (_, ids, w, p, length), heap in zip(asked, heaps, strict=True):
                whole[ids], part[ids] = w, p
                tree.search(whole, part, length, heap)
                whole[ids] = part[ids] = 0
            rows.clear()

        for b in batches:
            for i, n_terms, term, tf in zip(*(c.to_pylist() for c in b.columns), strict=True):
                m, tf = norming(n_terms, n, total), unpack(tf, np.int64)
                if len(tf):
                    rows.append((_NULL if i is None else i, unpack(term, np.int32, True), 1_000_000_000 * tf // (1000 * tf + 8 * m)))
                    room += len(tf)
                if room > LEAF_ROOM:
                    through()
                    room = 0
        if rows:
            through()
        got = [(key, None if -d == _NULL else -d, s) for (key, *_), heap in zip(asked, heaps, strict=True) for s, d in heap]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*got, strict=True) if got else ([],) * 3, (pa.string(), pa.int64(), pa.int64()), strict=True)], names=["item", "doc_id", "score"])

    return found.mapInArrow(search, _FOUND)


def rank(docs: DataFrame, items: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score: the TOP highest documents of each item."""
    spark = docs.sparkSession
    named = items.select("item_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    texts = written(named.select("text").distinct().select("text", F.sha2("text", 256).alias("item")), "items")
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-int(total) // block_bytes))
    parts = []
    for block in range(blocks):
        rows = texts.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == block).collect()  # one block of the stated queries
        if (got := best_of_block(docs, [(r["item"], Counter(terms(r["text"]))) for r in rows])) is not None:
            parts.append(written(got, "found"))
    if not parts:
        return spark.createDataFrame([], items.select("item_id").schema).select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score"))
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= TOP)
    return named.select("item_id", F.sha2("text", 256).alias("item")).join(ranked, "item").select("item_id", "rank", "doc_id", "score")


def op11_ball_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 highest-scoring of all documents for each benchmark item."""
    return rank(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def oracle() -> str:
    """DuckDB SQL for op11_ball_tree."""
    cut = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
    return f"""
with asked as (
    select item_id, term, count(*) as times from (select item_id, unnest({cut}) as term from benchmark) group by item_id, term
), sizes as (
    select doc_id, len({cut}) as n from documents where len({cut}) > 0
), totals as (
    select count(*) as docs, sum(n)::bigint as terms from sizes
), held as (
    select doc_id, term, count(*) as tf from (select doc_id, unnest({cut}) as term from documents)
    where term in (select term from asked) group by doc_id, term
), weighed as (
    select term, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)))::bigint as w from held, totals group by term, docs
), scored as (
    select item_id, doc_id,
        sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * docs) // terms))))::bigint as score
    from asked join held using (term) join weighed using (term) join sizes using (doc_id), totals
    group by item_id, doc_id
), ranked as (
    select item_id, row_number() over (partition by item_id order by score desc, doc_id)::integer as rank, doc_id, score
    from scored where score > 0
)
select item_id, rank, doc_id, score from ranked where rank <= 10
"""
