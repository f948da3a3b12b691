"""Approximate nearest neighbours by inner product, with balanced posting lists.

Index. Vectors get one more component, so that all have the length of the longest; then the largest inner product is the smallest
distance. A sample is cut in two again and again, each time into halves of equal size along the difference of two means, until
there are LISTS * sqrt(n) pieces; their means are the centroids, one posting list each. Every vector goes to its nearest
centroid's list and, as near a border, to up to REPLICAS - 1 more: those at most BORDER times as far. Neighbouring lists share a
bucket of about BUCKET postings; a list that is longer is dealt over buckets of its own, so no list makes a task long.

Search. Centroids are searched by a graph: from some entry points to the nearest neighbours of the nearest, until nothing within
reach is left to expand. A query reads the lists whose centroid is at most PRUNE times as far as the nearest one's: one list where
the query is deep inside a cluster, many where vectors have no structure. Within a list all postings are compared, exactly. If
these lists hold fewer than LEAST vectors, the next nearest are read too.

The centroids are fitted on a sample: the distinct vectors whose hash falls below a bound that lets SAMPLE of them through on
average (all of them in smaller tables). Everything else covers every row. Equal vectors are one posting with the wanted number
of smallest ids; queries with equal vectors are searched once and share the result. So masses of copies cost no pairs.

Vectors that are null, zero or hold null or non-finite components take no part, nor do rows without an id or of another length
than most rows have. Rows equal in id and vector count once; equal ids with other vectors are rows of their own. Equal scores go
by ascending id. Extra columns are ignored whatever their names; an empty table gives no rows. Scores are sums in double
precision over the components in their order, of the vectors as given.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import written

#: How many lists there are, and the bounds of what the driver and each task hold of the index.
LISTS, MOST_LISTS, SAMPLE = 1.0, 16_384, 65_536
REPLICAS, BORDER, PRUNE, LEAST = 2, 1.1, 1.12, 400
BUCKET, DEGREE, BEAM, ENTRIES = 4096, 24, 12, 32
WANTED, EVERY = 20, 20


@dataclass
class Centroids:
    """Points in the lengthened space, their graph, and where a search begins."""

    points: np.ndarray
    graph: np.ndarray
    longest: float

    def lengthened(self, x: np.ndarray) -> np.ndarray:
        rest = np.maximum(0.0, self.longest**2 - np.einsum("ij,ij->i", x, x))
        return np.column_stack([x, np.sqrt(rest)])

    def search(self, x: np.ndarray, reach: float = 1.0, rows: int = 256) -> np.ndarray:
        """Squared distances of lengthened vectors to the centroids that the graph search met, infinite for others. Every one
        among the BEAM nearest, and every one within reach times the nearest distance, has had its neighbours looked at."""
        out = np.full((len(x), len(self.points)), np.inf)
        norm = np.einsum("ij,ij->i", self.points, self.points)
        entries = np.unique(np.linspace(0, len(self.points) - 1, ENTRIES).astype(int))
        step = min(4, len(self.points))
        for at in range(0, len(x), rows):
            q, d = x[at : at + rows], out[at : at + rows]
            own = np.einsum("ij,ij->i", q, q)
            d[:, entries] = np.maximum(0, own[:, None] - 2 * q @ self.points[entries].T + norm[entries])
            todo = np.where(np.isfinite(d), d, np.inf)  # met, not expanded
            live = np.arange(len(q))
            while len(live):
                near = np.argpartition(todo[live], step - 1, 1)[:, :step]
                far = np.take_along_axis(todo[live], near, 1)
                beam = np.partition(d[live], min(BEAM, d.shape[1]) - 1, 1)
                bound = np.maximum(beam[:, min(BEAM, d.shape[1]) - 1], beam[:, : min(BEAM, d.shape[1])].min(1) * reach**2)
                go = (far <= bound[:, None]) & np.isfinite(far)
                who, which = np.nonzero(go)
                if not len(who):
                    break
                row, node = live[who], near[who, which]
                todo[row, node] = np.inf
                to = self.graph[node]
                dist = np.maximum(0, own[row][:, None] - 2 * np.einsum("kd,knd->kn", q[row], self.points[to]) + norm[to])
                r = np.repeat(row, to.shape[1])
                new = ~np.isfinite(d[r, to.ravel()])
                d[r[new], to.ravel()[new]] = dist.ravel()[new]
                todo[r[new], to.ravel()[new]] = dist.ravel()[new]
                live = live[go.any(1)]
        return out


def balanced_means(x: np.ndarray, pieces: int) -> np.ndarray:
    """Means of so many pieces of equal size, neighbouring ones next to each other."""
    out: list[np.ndarray] = []

    def cut(rows: np.ndarray, k: int) -> None:
        part = x[rows]
        if k == 1 or len(rows) < 2:
            out.append(part.mean(0))
            return
        left = k // 2
        size = max(1, round(len(rows) * left / k))
        middle = part.mean(0)
        a = part[np.argmax(((part - middle) ** 2).sum(1))]
        b = part[np.argmax(((part - a) ** 2).sum(1))]
        for _ in range(6):
            order = np.argsort(part @ (b - a), kind="stable")
            a, b = part[order[:size]].mean(0), part[order[size:]].mean(0)
        cut(rows[order[:size]], left)
        cut(rows[order[size:]], k - left)

    cut(np.arange(len(x)), pieces)
    return np.array(out)


def neighbour_graph(points: np.ndarray, degree: int = DEGREE) -> np.ndarray:
    """Each point's nearest others, and links to the points a power of two further on, so that every point can be reached."""
    n = len(points)
    norm, near = np.einsum("ij,ij->i", points, points), []
    k = min(degree, n - 1)
    for at in range(0, n, 512):
        d = norm - 2 * points[at : at + 512] @ points.T
        d[np.arange(len(d)), np.arange(at, at + len(d))] = np.inf
        near.append(np.argpartition(d, k - 1, 1)[:, :k] if k else np.zeros((len(d), 0), int))
    steps = [1 << b for b in range(n.bit_length()) if 1 << b < n]
    far = [(np.arange(n) + s) % n for s in steps]
    return np.column_stack([np.concatenate(near), *far]).astype(np.int64) if n > 1 else np.zeros((1, 1), np.int64)


def fit(sample: np.ndarray, n: int, longest: float) -> Centroids:
    """Centroids for a table of n distinct vectors from a sample of them; longest: the largest length of all."""
    model = Centroids(np.zeros((0, 0)), np.zeros((0, 0), np.int64), longest)
    lists = max(1, min(MOST_LISTS, len(sample), round(LISTS * math.sqrt(n))))
    model.points = balanced_means(model.lengthened(sample), lists)
    model.graph = neighbour_graph(model.points)
    return model


def homes(model: Centroids, x: np.ndarray) -> np.ndarray:
    """Of lengthened vectors, the lists they go to, nearest first, -1 where there are no more."""
    d = model.search(x)
    k = min(REPLICAS, d.shape[1])
    near = np.argpartition(d, k - 1, 1)[:, :k]
    near = np.take_along_axis(near, np.argsort(np.take_along_axis(d, near, 1), 1, kind="stable"), 1)
    far = np.take_along_axis(d, near, 1)
    return np.where(far <= far[:, :1] * BORDER**2, near, -1)


def routes(model: Centroids, x: np.ndarray, sizes: np.ndarray, least: int) -> list[np.ndarray]:
    """Of lengthened queries, the lists to read. sizes: how many vectors have each list as their nearest."""
    d = model.search(x, PRUNE)
    out = []
    for k, far in enumerate(d):
        read = np.nonzero(far <= far.min() * PRUNE**2)[0]
        if sizes[read].sum() < least:  # too few vectors there: the nearest lists that hold enough
            order = np.argsort(((model.points - x[k]) ** 2).sum(1), kind="stable")
            read = np.union1d(read, order[: np.searchsorted(np.cumsum(sizes[order]), least) + 1])
        out.append(read)
    return out


def exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of paired rows, summed in the order of the components."""
    s = np.zeros(len(x))
    for d in range(x.shape[1]):
        s += q[:, d] * x[:, d]
    return s


def _matrix(column: pa.ChunkedArray, kind, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, dim).astype(np.float64)


def usable(embeddings: DataFrame, kind) -> DataFrame:
    """vec_id, vec as bytes, dim and norm of the rows that take part, apart from their length."""

    def clean(batches):
        for b in batches:
            ids, vecs = b.column(0), b.column(1)
            n = vecs.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = vecs.flatten()
            at, values = np.cumsum(n) - n, flat.fill_null(float("nan")).to_numpy(zero_copy_only=False).astype(kind) + kind(0)  # no negative zeros
            of = np.repeat(np.arange(len(n)), n)
            with np.errstate(over="ignore", invalid="ignore"):
                norm = np.bincount(of, values.astype(np.float64) ** 2, len(n))
            good = np.nonzero(np.isfinite(norm) & (np.bincount(of, values != 0, len(n)) > 0) & ids.is_valid().to_numpy(zero_copy_only=False))[0]
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(good)), pa.array([values[at[k] : at[k] + n[k]].tobytes() for k in good], pa.binary()), pa.array(n[good].astype(np.int32)), pa.array(np.sqrt(norm[good]))], names=["vec_id", "vec", "dim", "norm"])

    return embeddings.select(F.col("vec_id").cast("long"), "embedding").mapInArrow(clean, "vec_id long, vec binary, dim int, norm double")


def search(spark: SparkSession, embeddings: DataFrame, every: int = EVERY, wanted: int = WANTED, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id, score: the nearest found of each row whose vec_id is divisible by every."""
    element = embeddings.schema["embedding"].dataType.elementType
    kind = np.float32 if isinstance(element, T.FloatType) else np.float64
    rows = written(usable(embeddings, kind).distinct(), "vectors")
    most = rows.groupBy("dim").count().orderBy(F.desc("count"), "dim").first()
    none = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if most is None:
        return none
    dim, keep = most["dim"], wanted + 1
    rows = rows.where(F.col("dim") == dim)
    asked = rows.where(F.pmod("vec_id", F.lit(every)) == 0).select("vec_id", "vec")
    place = F.row_number().over(Window.partitionBy("vec").orderBy("vec_id"))
    classes = (
        rows.withColumn("__place", place).where(F.col("__place") <= keep).groupBy("vec").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"), F.max("norm").alias("norm"))
        .join(asked.select("vec", F.lit(True).alias("asked")).distinct(), "vec", "left")
        .select("vec", "ids", "norm", F.coalesce("asked", F.lit(False)).alias("asked"), F.monotonically_increasing_id().alias("class"))
    )
    classes = written(classes, "classes")  # a class keeps its number from here on
    n, longest = classes.agg(F.count("*"), F.max("norm")).first()
    share = min(1.0, sample / n)
    part = classes.select("vec") if share == 1 else classes.where(F.pmod(F.xxhash64("vec"), F.lit(1 << 32)) < int(share * (1 << 32))).select("vec")
    got = part.orderBy("vec").toArrow()
    model = spark.sparkContext.broadcast(fit(_matrix(got["vec"], kind, dim), n, longest))

    def post(batches):
        for b in batches:
            for at in range(0, len(b), 2048):
                t = pa.table(b.slice(at, 2048))
                chosen = homes(model.value, model.value.lengthened(_matrix(t["vec"], kind, dim)))
                row, order = np.nonzero(chosen >= 0)
                yield pa.RecordBatch.from_arrays([t["vec"].combine_chunks().take(pa.array(row)), t["ids"].combine_chunks().take(pa.array(row)), t["class"].combine_chunks().take(pa.array(row)), pa.array(chosen[row, order].astype(np.int32)), pa.array(order == 0)], names=["vec", "ids", "class", "list", "first"])

    postings = written(classes.select("vec", "ids", "class").mapInArrow(post, "vec binary, ids array<long>, class long, list int, first boolean"), "postings")
    lists = len(model.value.points)
    size, firsts = np.zeros(lists, np.int64), np.zeros(lists, np.int64)
    for r in postings.groupBy("list").agg(F.count("*").alias("n"), F.count_if("first").alias("f")).collect():  # a row a list
        size[r["list"]], firsts[r["list"]] = r["n"], r["f"]
    parts, start, bucket, filled = np.maximum(1, -(-size // BUCKET)), np.zeros(lists, np.int64), 0, 0
    for k in range(lists):
        if filled and filled + size[k] > BUCKET:
            bucket, filled = bucket + 1, 0
        start[k] = bucket
        bucket, filled = (bucket + parts[k], 0) if parts[k] > 1 else (bucket, filled + size[k])
    layout = spark.sparkContext.broadcast((parts, start, firsts))

    def placed(batches):
        parts, start, _ = layout.value
        for b in batches:
            k = b.column("list").to_numpy()
            yield pa.RecordBatch.from_arrays([b.column("vec"), b.column("ids"), b.column("class"), b.column("list"), pa.array((start[k] + b.column("class").to_numpy() % parts[k]).astype(np.int32))], names=["vec", "ids", "class", "list", "bucket"])

    def route(batches):
        parts, start, firsts = layout.value
        for b in batches:
            for at in range(0, len(b), 1024):
                t = pa.table(b.slice(at, 1024))
                who, where, which = [], [], []
                for k, read in enumerate(routes(model.value, model.value.lengthened(_matrix(t["vec"], kind, dim)), firsts, max(LEAST, keep))):
                    to = np.repeat(start[read], parts[read]) + (np.arange(parts[read].sum()) - np.repeat(np.cumsum(parts[read]) - parts[read], parts[read]))
                    for p, l in _grouped(to, np.repeat(read, parts[read])):
                        who.append(k)
                        where.append(p)
                        which.append(l)
                yield pa.RecordBatch.from_arrays([t["class"].combine_chunks().take(pa.array(who, pa.int64())), t["vec"].combine_chunks().take(pa.array(who, pa.int64())), pa.array(where, pa.int32()), pa.array(which, pa.list_(pa.int32()))], names=["class", "vec", "bucket", "lists"])

    def compare(t: pa.Table, asks: pa.Table) -> pa.Table:
        found = nearest(_matrix(t["vec"], kind, dim), t["list"].to_numpy(), [i[0] for i in t["ids"].to_pylist()], t["class"].to_numpy(), _matrix(asks["vec"], kind, dim), asks["lists"].to_pylist(), keep)
        ids, cls = t["ids"].to_pylist(), t["class"].to_pylist()
        return pa.table({"class": asks["class"], "found": pa.array([[{"neg": -s, "ids": ids[p], "class": cls[p]} for s, p in f] for f in found], pa.list_(pa.struct([("neg", pa.float64()), ("ids", pa.list_(pa.int64())), ("class", pa.int64())])))})

    asks = classes.where("asked").select("class", "vec").mapInArrow(route, "class long, vec binary, bucket int, lists array<int>")
    there = postings.select("vec", "ids", "class", "list").mapInArrow(placed, "vec binary, ids array<long>, class long, list int, bucket int")
    found = there.groupBy("bucket").cogroup(asks.groupBy("bucket")).applyInArrow(compare, "class long, found array<struct<neg double, ids array<long>, class long>>")
    # a class in several lists is found several times, with the same score
    best = found.groupBy("class").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("found")))), 1, keep).alias("best"))
    listed = best.select("class", F.slice(F.array_sort(F.flatten(F.transform("best", lambda x: F.transform(x["ids"], lambda i: F.struct(x["neg"].alias("neg"), i.alias("id"), x["class"].alias("class")))))), 1, keep).alias("best"))
    queries = asked.join(classes.where("asked").select("vec", "class"), "vec").select("vec_id", "class").join(listed, "class")
    others = F.filter("best", lambda x: (x["id"] != F.col("vec_id")) | (x["class"] != F.col("class")))
    return queries.select(F.col("vec_id").alias("query_id"), F.posexplode(F.slice(others, 1, wanted)).alias("at", "x")).select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.id").alias("vec_id"), (F.lit(0.0) - F.col("x.neg")).alias("score")
    )


def _grouped(keys: np.ndarray, values: np.ndarray) -> list[tuple[int, list[int]]]:
    """Values by key."""
    order = np.argsort(keys, kind="stable")
    edges = np.nonzero(np.diff(keys[order]))[0] + 1
    return [(int(k[0]), v.tolist()) for k, v in zip(np.split(keys[order], edges), np.split(values[order], edges), strict=True)] if len(keys) else []


def nearest(x: np.ndarray, list_of: np.ndarray, first_id: list[int], class_of: np.ndarray, q: np.ndarray, lists: list[list[int]], keep: int, rows: int = 512) -> list[list[tuple[float, int]]]:
    """Of each query, the keep best postings of its lists by score, then first id, as (score, place)."""
    order = np.argsort(list_of, kind="stable")
    of = list_of[order]
    first = np.array(first_id, np.int64)
    asked: dict[int, list[int]] = {}
    for k, read in enumerate(lists):
        for one in read:
            asked.setdefault(one, []).append(k)
    best: list[list[tuple[float, int]]] = [[] for _ in q]
    for one, who in asked.items():
        places = order[np.searchsorted(of, one) : np.searchsorted(of, one, "right")]
        if not len(places):
            continue
        k = min(keep, len(places))
        for at in range(0, len(who), rows):
            some = np.array(who[at : at + rows])
            near = q[some] @ x[places].T
            least = np.partition(near, len(places) - k, 1)[:, len(places) - k]
            slack = 1e-9 * (1 + np.abs(near).max(1))  # the product's order of summing differs
            r, c = np.nonzero(near >= (least - slack)[:, None])
            score = exact(q[some[r]], x[places[c]])
            for a, s, p in zip(some[r].tolist(), score.tolist(), places[c].tolist(), strict=True):
                best[a].append((s, p))
    out = []
    for b in best:
        seen, some = set(), []
        for s, p in sorted(b, key=lambda y: (-y[0], first[y[1]])):
            if class_of[p] not in seen:
                seen.add(class_of[p])
                some.append((s, p))
            if len(some) == keep:
                break
        out.append(some)
    return out


def op13_posting_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found of each row of embeddings whose vec_id is divisible by 20, by inner product."""
    return search(spark, spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
