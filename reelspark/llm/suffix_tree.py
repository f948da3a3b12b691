"""Scores of texts under a probabilistic suffix tree over words, learnt and applied on Spark.

A text is its lower-cased words, then an end symbol. The tree's nodes are contexts of 0 to depth preceding words (a start
symbol stands before the first). The root's distribution is the base: (c + 1/2) / (N + (V + 1) / 2). A longer context x, seen
T times, has p(s | x) = (n(x, s) + SMOOTH * p(s | x without its first word)) / (T + SMOOTH). It is retained if it occurs twice
or more and its training counts diverge from what its parent predicts: if the sum, over each time t it was followed by s, of
log(((n(x, s) - 1) + SMOOTH * p) / ((T - 1 + SMOOTH) * p)), p = p(s | parent), exceeds DIVERGE nats; one occurrence is left
out each time, so that a context that merely repeats itself by chance isn't retained. A symbol is scored in the state of the
longest retained suffix of what precedes it.

Nothing whole goes through the driver, one task or one group. Tasks code what they read, slice by slice, into numbers of words;
the slices are exchanged once, the texts never. Then the tree grows level by level: each level's sequences (context and symbol)
are counted over all slices by sums over hashed keys (common.tally), but only where the level above has shown that the context
occurs twice, as no other can be retained or have a longer one that is; so most longer sequences are never sent. A last round
sums the contexts' divergences: a context is a sequence that has been asked for, so its part goes, without its key, to where
that has been counted. A context's T is the count of a sequence one shorter, so no row ever stands for a whole context,
and no frequent word gathers its followers anywhere. A slice sends a bounded number of messages a round. Words are
told apart by 63-bit hashes, longer sequences by hashes with SPARE bits more than the table's bytes need: one in 4 million meets
another, at any size. Divergences are summed in whole 2**-20 parts of a nat, a slice's part being rounded.

Null and wordless texts are the end token alone. Null doc_ids count as training. Rows may repeat and count each time; extra
columns, whatever their names, are ignored; an empty table gives no rows; with no training rows every symbol has the base's
probability. A long text makes its slice longer, as a text is coded whole. depth is a parameter: each further level is one more
round over the slices.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import ASK, CHUNK_BYTES, FAN, MORE, ask_table, joined, mix, more_table, pack, relayed, retally, saved, tally, unpack

#: NAT: divergences are summed in whole parts of a nat, so that their order doesn't matter.
#: SPARE: bits of a sequence's key beyond those that tell as many keys apart as the table has bytes.
DEPTH, SMOOTH, DIVERGE, NAT, SPARE = 3, 2.0, 0.0, 1 << 20, 22
U = np.uint64
_STEP, _NEXT = U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F)
#: Hashes of the symbols that are no words.
END, START = (U(xxhash.xxh64_intdigest(b, 7)) for b in (b"\xff", b"\xfe"))  # not UTF-8


def words_of(texts: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens a text, hashes of the distinct tokens, and all tokens as places among these; each text ends in the end symbol, place 0."""
    lower = pc.ascii_lower(pc.coalesce(texts.cast(pa.string()), pa.scalar(""))).combine_chunks()
    lists = pc.ascii_split_whitespace(lower)
    word, of = lists.flatten(), pc.list_parent_indices(lists).to_numpy()
    real = pc.not_equal(word, "").to_numpy(zero_copy_only=False)
    coded = word.filter(pa.array(real)).dictionary_encode()
    sizes = np.bincount(of[real], minlength=len(texts)).astype(np.int64) + 1
    hashes = np.array([END, *(xxhash.xxh64_intdigest(w, 7) for w in coded.dictionary.cast(pa.binary()).to_pylist())], U)
    out = np.zeros(int(sizes.sum()), np.int64)
    last = np.zeros(len(out), bool)
    last[np.cumsum(sizes) - 1] = True
    out[~last] = coded.indices.to_numpy(zero_copy_only=False) + 1
    return sizes, hashes, out


def before(values: np.ndarray, starts: np.ndarray, first) -> np.ndarray:
    """The value of the position before, in the same document."""
    out = np.empty_like(values)
    out[1:] = values[:-1]
    out[starts] = first
    return out


class Chunk:
    """A slice's positions. Level d is about sequences of d context words and a symbol; take() brings in what is known of a level."""

    def __init__(self, t: pa.Table, shift: int = 1, depth: int = DEPTH):
        self.shift = U(shift)
        row = {n: t[n][0].as_py() for n in ("sizes", "hashes", "words")}
        self.number, self.sizes = t["chunk"][0].as_py(), unpack(row["sizes"], np.int64)
        hashes, self.words = unpack(row["hashes"], U), unpack(row["words"], np.int32).astype(np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.train = ~np.repeat(t["held_out"][0].values.to_numpy(zero_copy_only=False), self.sizes)
        self.symbol = hashes[self.words]
        self.past, self.context = self.symbol, [np.zeros(len(self.symbol), U)]
        self.word_keys = hashes | U(1)
        start = [U(0)]  # contexts of start symbols alone are no sequences, so they get keys beside the words
        for _ in range(depth):
            start.append(mix(np.array([start[-1]], U) * _STEP + START + U(1))[0])
        self.start_keys = np.array(start[1:], U) | U(1)
        self.depth = depth
        self.placed: dict[int, tuple[np.ndarray, np.ndarray | None]] = {}  # of each level asked for, its keys and, below depth, where each position's is, or -1
        self.count: list[np.ndarray] = []  # of each level, how often the sequence that ends here occurred in training
        self.docs = self.room = 0

    def even(self, keys: np.ndarray) -> np.ndarray:
        """Keys without their last bits, so that they pack shorter and differ from those of words, which are odd."""
        return keys >> self.shift << self.shift

    def contexts(self, d: int) -> np.ndarray:
        """Hashes of the d symbols before each position."""
        while len(self.context) <= d:
            self.past = before(self.past, self.starts, START)
            self.context.append(mix(self.context[-1] * _STEP + self.past + U(1)))
        return self.context[d]

    def times(self, d: int) -> np.ndarray:
        """How often the context of level d occurred in training, where that is twice or more; else any number below."""
        return before(self.count[d - 1], self.starts, self.docs)

    def sequences(self, d: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Level d's distinct keys, in order, where each stands, and the positions they stand at: those whose context occurred twice.

        At level 1, which is asked for together with the words, all positions.
        """
        where = np.flatnonzero(self.times(d) > 1) if d > 1 else np.arange(len(self.symbol))
        keys, at = np.unique(self.even(mix(self.contexts(d)[where] * _NEXT + self.symbol[where] + U(d))), return_inverse=True)
        return keys, at, where

    def asked(self, level: int) -> tuple[np.ndarray, np.ndarray, list]:
        """Ascending keys, training counts, and how to take the answers, of level; 1 has the words too."""
        keys, at, where = self.sequences(level)
        n = np.bincount(at[self.train[where]], minlength=len(keys))
        if level > 1:
            return keys, n, [(level, at, where)]
        both = np.concatenate([self.word_keys, self.start_keys, keys])
        up = np.argsort(both, kind="stable")
        place = np.empty(len(up), np.int64)
        place[up] = np.arange(len(up))
        words = len(self.word_keys)
        n = np.concatenate([np.bincount(self.words[self.train], minlength=words), np.zeros(len(self.start_keys), np.int64), n])
        self.start_places = place[words : words + len(self.start_keys)]
        return both[up], n[up], [(0, place[self.words], np.arange(len(self.words))), (1, place[words + len(self.start_keys) + at], where)]

    def take(self, level: int, replies: pa.Table) -> None:
        """The answers to asked(level)."""
        if level == 1:
            distinct, tokens, self.docs = (sum(x) for x in zip(*replies["notes"].to_pylist(), strict=True))
            self.room, self.tokens = tokens + 0.5 * (distinct + 1), tokens
        seen = joined(replies, np.int64)
        keys, _, answers = self.asked(level)
        for d, at, where in answers:
            count = np.zeros(len(self.symbol), np.int64)
            count[where] = seen[at]
            self.count.append(count)
            place = None
            if d < self.depth:
                place = np.full(len(self.symbol), -1, np.int32)
                place[where] = at
            self.placed[d] = keys, place

    def follow(self):
        """Level by level from the root on: the level, probabilities there and above, and how often the context occurred."""
        p = (self.count[0] + 0.5) / self.room
        yield 0, p, None, None
        for d in range(1, len(self.count)):
            above, n = p, self.times(d)
            p = np.where(n > 1, (self.count[d] + SMOOTH * above) / (n + SMOOTH), above)
            yield d, p, above, n

    def states(self):
        """Level by level from 1 on: the level, the positions whose context occurred twice, and where their contexts are.

        A context is the sequence that ends one position before, so it has that one's place among the keys that were asked for
        with level - 1 (from 0 on; level 1's, if the context is a word or start symbols); places go on from level to level.
        """
        for d in range(1, len(self.count)):
            live = np.flatnonzero(self.times(d) > 1)
            at = before(self.placed[d - 1][1] + self.offset(d - 1), self.starts, self.start_places[d - 1])
            yield d, live, at[live]

    def asks(self) -> list[np.ndarray]:
        """The keys of each round."""
        return [self.placed[k][0] for k in range(1, max(2, len(self.count) - 1))]

    def offset(self, level: int) -> int:
        return sum(len(self.placed[k][0]) for k in range(1, level))

    def divergences(self) -> list[np.ndarray]:
        """This chunk's part of the divergence of each context that occurred twice, at its place among the keys of asks(); else zero."""
        keys = self.asks()
        out = np.zeros(sum(map(len, keys)))
        for (d, _, above, n), (_, live, at) in zip(list(self.follow())[1:], self.states(), strict=True):
            t = self.train[live]
            rest, count, up = SMOOTH * above[live][t], self.count[d][live][t], above[live][t]
            out += np.bincount(at[t], np.log((count - 1 + rest) / ((n[live][t] - 1 + SMOOTH) * up)), len(out))
        return np.split(np.rint(out * NAT).astype(np.int64), np.cumsum([len(k) for k in keys])[:-1])

    def scores(self, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """log10 of the base's and the tree's probability, and of known tokens, a document each. kept: a mark for each key of asks()."""
        places = {d: (live, at) for d, live, at in self.states()}
        root = best = None
        for d, p, _, _ in self.follow():
            if d:
                live, at = places[d]
                best[live[kept[at]]] = p[live[kept[at]]]
            else:
                root, best = p, p.copy()
        add = lambda v: np.add.reduceat(v, self.starts)
        return add(np.log10(root)), add(np.log10(best)), add((self.count[0] > 0).astype(np.int64))


def coded(docs: DataFrame, held, slice_bytes: int) -> DataFrame:
    """Slices of about slice_bytes of the texts that a task reads, coded: chunk (its task and place there), doc_id and held_out as arrays, words a text, distinct words' hashes, words by place."""
    kind = docs.schema["doc_id"].dataType

    def read(batches):
        task, n, part, size = TaskContext.get().partitionId(), 0, [], 0

        def row():
            t = pa.Table.from_batches(part)
            sizes, hashes, words = words_of(t["text"])
            up = np.argsort(-np.bincount(words, minlength=len(hashes)), kind="stable")  # frequent words get small numbers, which pack better
            place = np.empty(len(up), np.int32)
            place[up] = np.arange(len(up), dtype=np.int32)
            one = lambda c: pa.ListArray.from_arrays(pa.array([0, len(t)], pa.int32()), t[c].combine_chunks())
            return pa.RecordBatch.from_arrays([pa.array([(task << 24) + n], pa.int64()), one("doc_id"), one("held_out"), pa.array([pack(sizes)]), pa.array([pack(hashes[up])]), pa.array([pack(place[words])])], names=["chunk", "doc_id", "held_out", "sizes", "hashes", "words"])

        for b in batches:
            ends = np.cumsum(pc.binary_length(b.column("text")).to_numpy(zero_copy_only=False).astype(np.int64))
            lo = 0
            while lo < len(b):  # slices fill up over batches
                done = int(ends[lo - 1]) if lo else 0
                hi = min(len(b), int(np.searchsorted(ends, done + slice_bytes - size)) + 1)
                part.append(b.slice(lo, hi - lo))
                size += int(ends[hi - 1]) - done
                lo = hi
                if size >= slice_bytes:
                    yield row()
                    n, size = n + 1, 0
                    part.clear()
        if part:
            yield row()

    body = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    return docs.select("doc_id", held.alias("held_out"), body).mapInArrow(read, f"chunk long, doc_id array<{kind.simpleString()}>, held_out array<boolean>, sizes binary, hashes binary, words binary")


def score(docs: DataFrame, train_when=None, depth: int | None = None, fan: int = FAN, per_range: int = 3, slice_bytes: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row. per_range: slices for each task that sums."""
    depth = DEPTH if depth is None else depth
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 1, F.lit(False)) if train_when is None else ~train_when
    total = docs.select(F.sum(F.octet_length("text"))).first()[0] or 0
    senders = max(1, -(-int(total) // slice_bytes))
    shift = max(1, 64 - SPARE - int(total + 1).bit_length())
    ranges = max(1, senders // per_range)
    cut = min(ranges, fan)
    kind = docs.schema["doc_id"].dataType
    id_type = to_arrow_type(kind)
    # dealt by chunk and without nulls, as the groups and joins below want it, so that all of them read this one exchange
    parts = coded(docs, held, slice_bytes).where(F.col("chunk").isNotNull()).repartition("chunk")

    def known(t: pa.Table, levels: int) -> Chunk:
        c = Chunk(t, shift, depth)
        for d in range(1, levels + 1):
            c.take(d, answers(t, d))
        return c

    def answers(t: pa.Table, k: int) -> pa.Table:
        return pa.Table.from_batches([pa.RecordBatch.from_struct_array(t[f"r{k}"].combine_chunks().values)])

    def ask(level: int):
        """Asks for level, knowing those before."""

        def asked(t: pa.Table) -> pa.Table:
            c = known(t, level - 1)
            keys, n, _ = c.asked(level)
            return ask_table(c.number, keys, n, cut, shift)

        return asked

    def diverged(t: pa.Table) -> pa.Table:
        c = known(t, depth)
        return more_table(c.number, c.asks(), c.divergences(), cut)

    def finish(t: pa.Table) -> pa.Table:
        c = known(t, depth)
        base, best, n_known = c.scores(joined(answers(t, depth + 1), np.uint8) > 0)
        return pa.table({
            "doc_id": t["doc_id"][0].values.cast(id_type), "held_out": t["held_out"][0].values, "n_tokens": pa.array(c.sizes), "n_known": pa.array(n_known),
            "train_tokens": pa.array([c.tokens] * len(c.sizes), pa.int64()), "base_score": pa.array(base), "score": pa.array(best),
        })

    def notes(keys: np.ndarray, sums: np.ndarray) -> list:
        word = (keys & U(1)) > 0
        return [(word & (sums > 0)).sum(), sums[word].sum(), sums[keys == END | U(1)].sum()]

    def answered(got: DataFrame, k: int) -> DataFrame:
        """The slices with the answers to round k beside them."""
        return parts.join(got.groupBy(F.col("sender").alias("chunk")).agg(F.collect_list(F.struct("place", "reply", "notes")).alias(f"r{k}")), "chunk")

    # one plan: slices, asks and each round's answers are exchanged once, and all later rounds read these exchanges
    rounds, hops = range(1, max(2, depth)), {}
    for level in range(1, depth + 1):
        asks = parts.groupBy("chunk").applyInArrow(ask(level), ASK)
        hops[level] = relayed(asks, senders, cut, ranges, shift, np.int64)
        parts = answered(tally(asks, senders, cut, ranges, shift, np.int64, lambda sums: sums, *([notes] if level == 1 else []), hops=hops[level]), level)
    more = parts.groupBy("chunk").applyInArrow(diverged, MORE)
    if depth > DEPTH:  # a plan that held all earlier levels once more a round would be too long
        more = saved(more)
    # the rounds' answers meet the slices in one join, so that the plan grows by a slice's history a round and doesn't double; a round's places follow those of the rounds before
    states = [retally(hops[k], more, k - 1, shift, lambda sums: (sums > DIVERGE * NAT).astype(np.uint8)).withColumn("place", F.col("place") + (k - 1) * cut) for k in rounds]
    parts = answered(reduce(DataFrame.unionByName, states), depth + 1)
    schema = f"doc_id {kind.simpleString()}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return parts.groupBy("chunk").applyInArrow(finish, schema)


def op1_suffix_tree(spark, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
