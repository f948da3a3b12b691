"""Phrase collocations by stripes: each prefix of 0 to 3 words keys an associative counter of its next words.

Tasks count a slice of texts into stripes (prefix -> next word -> count), stripes of a prefix are merged elementwise, and what has
FLOOR occurrences or more stays. The merged stripes answer all questions: a stripe's entries are the extensions of its prefix, the
entry of a phrase's last word in its prefix's stripe is the phrase's own total, and the largest entry among the phrases one word
longer on either side decides whether a phrase is subsumed (a phrase two words longer that occurs often enough lies around one
that is one word longer and occurs as often).

Levels follow each other: a phrase can only reach FLOOR if both phrases one word shorter inside it do, so a task counts only those
whose two parts are among the frequent of the level before. It knows them by a bitmap of their hashes, 2**BITS bits at most; where
bits are shared more is counted, which the exact totals then drop. Nothing is ever dropped by the bitmap that could count.

No stripe makes a task long: the root's stripe (all words) is cut into ROOT shards by the next word's hash, and so is every stripe
whose prefix occurs HEAVY times or more, into SHARDS; shards are merged by Spark's sums, which spill. Joins are on whole phrases,
one side having each once, so Spark can split the other. Lists of the first RANKS a language are cut before they are shuffled.

Null texts have no words; a null lang is `und`, as is one that is called so. Texts without words give nothing; repeated rows count
each time; texts are read whole, SLICE_BYTES of them at once or one longer one; extra columns are ignored whatever their names; no
rows, or no phrase that occurs often enough, give no rows. Equal scores go by count, then phrase in the order of its bytes.
"""

from __future__ import annotations

from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import PIECE, mix, split_words, written

LONGEST, FLOOR, SUBSUMED, RANKS = 4, 30, 80, 2000
ROOT, SHARDS, HEAVY = 256, 64, 100_000
BITS, SLICE_BYTES = 26, 8_000_000
U = np.uint64
_KIND = np.array([2 if b in b".,;:!?\n\x0b\x0c\r" else 1 if b in b" \t" else 0 for b in range(256)], np.uint8)
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
#: A stripe's next words and their counts are one text each, parted by spaces, which no word has: half as long as arrays.
_STRIPES = "lang string, prefix string, shard int, nexts string, counts string"


class Words:
    """Words of texts of one language: their places in a list of distinct words, and whether a word follows the one before it in its piece."""

    def __init__(self, texts: pa.Array):
        self.distinct, self.code, _, piece = split_words(texts, _KIND, _LOWER)
        self.follows = np.zeros(len(piece), bool)
        self.follows[1:] = piece[1:] == piece[:-1]

    def hashes(self, lang: str) -> np.ndarray:
        seed = xxhash.xxh64_intdigest(lang.encode(), 11)
        return np.array([xxhash.xxh64_intdigest(w, seed) for w in self.distinct.to_pylist()], U)


def chain(h: np.ndarray, more: np.ndarray) -> np.ndarray:
    """Hash of a phrase from that of its beginning and its last word's."""
    return mix(h * U(0x9E3779B97F4A7C15) + more)


def has(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether the hashes' bits are set in a bitmap of bytes, a power of two long."""
    spot = h & U(8 * len(bitmap) - 1)
    return (bitmap[(spot >> U(3)).astype(np.int64)] >> (spot & U(7)).astype(np.uint8)) & 1 > 0


def count(texts: pa.Array, lang: str, level: int, known: list) -> tuple | None:
    """prefixes, shards, next words and counts of the stripes of phrases of level words. known: bitmaps (frequent, heavy) of the shorter levels."""
    w = Words(texts)
    if not len(w.code):
        return None
    n, own = len(w.distinct), w.hashes(lang)
    if level == 1:
        code, total = np.arange(n), np.bincount(w.code, minlength=n)
        return [pa.array([""] * n)], (own % U(ROOT)).astype(np.int64), np.zeros(n, np.int64), code, total, w
    h, good = own[w.code], has(known[0][0], own)[w.code]
    phrase, run = w.code, np.ones(len(h), bool)  # numbers of the phrases that end here; whether there is one
    for k in range(2, level + 1):
        run = w.follows & good
        run[1:] &= good[:-1]
        run[0] = False
        end = np.nonzero(run)[0]
        if not len(end):
            return None
        keys, first, at, sums = np.unique(phrase[end - 1] * n + w.code[end], return_index=True, return_inverse=True, return_counts=True)
        before, word = h.copy(), w.code
        if k < level:
            phrase = np.zeros(len(h), np.int64)
            phrase[end] = at
            new = h.copy()
            new[end] = chain(before[end - 1], own[word[end]])
            h, good = new, np.zeros(len(h), bool)
            good[end] = has(known[k - 1][0], h[end])
    spot = end[first]
    heavy = has(known[level - 2][1], h[spot - 1])
    shard = np.where(heavy, own[w.code[spot]] % U(SHARDS), U(0)).astype(np.int64)
    return [w.distinct.take(pa.array(w.code[spot - j])) for j in range(level - 1, 0, -1)], shard, keys // n, w.code[spot], sums, w


def stripes_of(texts: pa.Array, lang: str, level: int, known: list) -> pa.RecordBatch | None:
    got = count(texts, lang, level, known)
    if got is None:
        return None
    words, shard, prefix, code, sums, w = got
    order = np.lexsort((shard, prefix))
    prefix, shard = prefix[order], shard[order]
    edge = np.append(np.nonzero(np.append(True, (np.diff(prefix) != 0) | (np.diff(shard) != 0)))[0], len(order)).astype(np.int32)
    one = pa.array(order[edge[:-1]])
    names = [c.take(one).cast(pa.string()) for c in words]
    name = names[0] if len(names) == 1 else pc.binary_join_element_wise(*names, " ")
    listed = lambda values: pc.binary_join(pa.ListArray.from_arrays(pa.array(edge), values.cast(pa.string())), " ")
    return pa.RecordBatch.from_arrays(
        [pa.array([lang] * len(name), pa.string()), name, pa.array(shard[edge[:-1]].astype(np.int32)), listed(w.distinct.take(pa.array(code[order]))), listed(pa.array(sums[order]))],
        names=["lang", "prefix", "shard", "nexts", "counts"],
    )


def counted(docs: DataFrame, level: int, known) -> DataFrame:
    """Rows of _STRIPES of all texts, slice by slice. docs: lang, text; known: a broadcast list of bitmaps."""

    def read(batches):
        for b in batches:
            sizes = np.cumsum(pc.binary_length(b.column("text")).to_numpy(zero_copy_only=False).astype(np.int64))
            cuts = np.searchsorted(sizes, np.arange(SLICE_BYTES, int(sizes[-1]) if len(sizes) else 0, SLICE_BYTES), "right")
            for lo, hi in pairwise(np.unique([0, *cuts, len(b)]).tolist()):
                part = b.slice(lo, hi - lo)
                for lang in sorted(part.column("lang").unique().to_pylist()):
                    out = stripes_of(part.column("text").filter(pc.equal(part.column("lang"), lang)), lang, level, known.value)
                    if out is not None:
                        yield from (out.slice(k, 20_000) for k in range(0, len(out), 20_000))

    return docs.mapInArrow(read, _STRIPES)


def merged(stripes: DataFrame) -> DataFrame:
    """lang, prefix, next, f: stripes added up entry by entry where their shard was dealt to."""
    pairs = stripes.repartition("lang", "prefix", "shard").select("lang", "prefix", "shard", F.explode(F.arrays_zip(F.split("nexts", " ").alias("next"), F.split("counts", " ").alias("count"))).alias("x"))
    return pairs.groupBy("lang", "prefix", "shard", F.col("x.next").alias("next")).agg(F.sum(F.col("x.count").cast("long")).alias("f")).drop("shard")


def bitmaps(frequent: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Of the phrases (lang, phrase, f), those with FLOOR occurrences and those with HEAVY, as bitmaps of their hashes."""

    def spots(batches):
        for b in batches:
            h = []
            for lang, phrase in zip(b.column("lang").to_pylist(), b.column("phrase").to_pylist(), strict=True):
                seed = xxhash.xxh64_intdigest(lang.encode(), 11)
                words = [np.array([xxhash.xxh64_intdigest(x.encode(), seed)], U) for x in phrase.split(" ")]
                x = words[0]
                for y in words[1:]:
                    x = chain(x, y)
                h.append(x[0])
            spot = np.array(h, U) & U((1 << bits) - 1)
            yield pa.RecordBatch.from_arrays([pa.array((spot >> U(PIECE)).astype(np.int64)), pa.array((spot & U((1 << PIECE) - 1)).astype(np.int64)), b.column("heavy")], names=["piece", "bit", "heavy"])

    bits = max(PIECE, min(BITS, (16 * frequent.count()).bit_length()))
    found = frequent.select("lang", "phrase", (F.col("f") >= HEAVY).alias("heavy")).mapInArrow(spots, "piece long, bit long, heavy boolean")
    out = []
    for rows in (found, found.where("heavy")):
        whole = np.zeros(1 << bits >> 3, np.uint8)
        for r in rows.groupBy("piece").agg(F.bitmap_construct_agg("bit").alias("map")).collect():  # 2**BITS bits at most
            at = r["piece"] << PIECE >> 3
            whole[at : at + (1 << PIECE >> 3)] = np.frombuffer(r["map"], np.uint8)
        out.append(whole)
    return out[0], out[1]


def frequencies(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """lang, prefix, next, phrase, words, f of all phrases of 1 to LONGEST words with FLOOR occurrences; and lang, n."""
    sc = docs.sparkSession.sparkContext
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    known, levels, sizes = [], [], None
    for level in range(1, LONGEST + 1):
        sums = merged(counted(texts, level, sc.broadcast(known)))
        if level == 1:
            sums = written(sums, "words")
            sizes = sums.groupBy("lang").agg(F.sum("f").alias("n"))
        phrase = F.col("next") if level == 1 else F.concat_ws(" ", "prefix", "next")
        found = written(sums.where(F.col("f") >= FLOOR).select("lang", "prefix", "next", phrase.alias("phrase"), F.lit(level).alias("words"), "f"), "phrases")
        levels.append(found)
        if level < LONGEST:
            known.append(bitmaps(found))
    out = levels[0]
    for x in levels[1:]:
        out = out.unionByName(x)
    return out, sizes


def collocations(docs: DataFrame) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first RANKS phrases of each language."""
    found, sizes = frequencies(docs)
    phrases = found.where("words > 1")
    # each cut into two parts, whose totals stand in the stripes of shorter phrases
    word = F.split("phrase", " ")
    side = lambda name, a, b: F.concat_ws(" ", F.slice(word, a, b)).alias(name)
    cuts = phrases.select("lang", "phrase", "words", "f", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k")).select(
        "lang", "phrase", F.col("f").alias("a"), "k", side("first", F.lit(1), F.col("k")), side("rest", F.col("k") + 1, F.col("words") - F.col("k"))
    )
    total = found.where(F.col("words") < LONGEST)
    both = cuts.join(total.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"]).join(
        total.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"]
    )
    score = F.expr("cast(cast(2000000 as decimal(8,0)) * cast(a as decimal(19,0)) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0))) as bigint)")
    lowest = both.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("x"))
    around = phrases.where("words > 2").select("lang", "f", F.explode(F.array(side("p", F.lit(1), F.col("words") - 1), side("p", F.lit(2), F.col("words") - 1))).alias("phrase"))
    most = around.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    free = lowest.join(most, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (wide("longer") * 100 < wide("a") * SUBSUMED))
    order = Window.partitionBy("lang").orderBy(F.desc("x.score"), F.desc("a"), "phrase")
    first = free.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= RANKS)
    return first.join(sizes, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", F.col("x.l").alias("l"), F.col("x.r").alias("r"), "n", F.col("x.score").alias("score"))


def op12_stripes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collocations of all documents, the first 2000 a language."""
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def oracle() -> str:
    """DuckDB SQL for op12_stripes."""
    return r"""
with pieces as (
    select coalesce(lang, 'und') as lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece
    from documents
), lists as (
    select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from pieces
), places as (
    select lang, w, unnest(range(1, len(w) + 1)) as i from lists
), sizes as (
    select lang, sum(len(w))::bigint as n from lists group by lang
), phrases as (
    select lang, k as words, array_to_string(w[i:i + k - 1], ' ') as phrase, count(*) as f
    from places, (values (1), (2), (3), (4)) as s(k) where i + k - 1 <= len(w) group by all having count(*) >= 30
), cuts as (
    select lang, phrase, words, f as a, k, array_to_string(string_split(phrase, ' ')[1:k], ' ') as first, array_to_string(string_split(phrase, ' ')[k + 1:], ' ') as rest
    from phrases, (values (1), (2), (3)) as s(k) where k < words
), scored as (
    select c.lang, c.phrase, c.words, c.a, c.k, x.f as l, y.f as r, ((2000000::hugeint * c.a) // (x.f::hugeint + y.f))::bigint as score
    from cuts c join phrases x on x.lang = c.lang and x.phrase = c.first join phrases y on y.lang = c.lang and y.phrase = c.rest
), lowest as (
    select * from scored qualify row_number() over (partition by lang, phrase order by score, k) = 1
), free as (
    select * from lowest c where not exists (
        select 1 from phrases p where p.lang = c.lang and p.words > c.words and 100::hugeint * p.f >= 80::hugeint * c.a
        and contains(' ' || p.phrase || ' ', ' ' || c.phrase || ' '))
)
select lang, rank, phrase, a, l, r, n, score from (
    select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from free
) join sizes using (lang) where rank <= 2000
"""
