"""Removal of long repeated byte strings, found with run-length compressed Burrows-Wheeler indexes.

A byte goes if some string of LENGTH = 100 bytes that covers it also starts earlier (smaller doc_id, or earlier in the same
document). Every such string has an anchor, the leftmost smallest hash among its 61 substrings of 40 bytes, so equal strings
have equal anchors at equal places. The steps, each a Spark shuffle of packed arrays:

1. chunks of documents ask how often the hashes of their anchors occur in all (common.tally, a bounded number of messages a chunk);
2. a chunk cuts out the fragment around each repeated anchor (all 100-byte strings that have it); fragments that it has met
   before are repeats as a whole, the others go to the bucket of their anchor's hash;
3. a bucket keeps the first of equal fragments and builds an index of these: the Burrows-Wheeler transform as runs, with
   last-to-first steps at their heads, and a text sample (the smallest position) for every class of suffixes that share 100
   bytes. It streams each fragment backwards through the index; where the class of a position has an earlier member, the
   matching statistic reaches 100 there and the match is marked. Of matching statistics only that much is worked out, and
   samples stand at classes, not at run ends: an end's sample names some member of a class, here the earliest is needed;
4. the marks go back to their chunks, which cut the bytes out.

An anchor that occurs in more than HOT places doesn't bring its fragments together: its chunks send hashes of the single
100-byte strings instead, each to a bucket of its own hash, where all but the first place are marked. So no group has to
fit into one task. Hashes of strings have 128 bits.

Null and empty texts have no bytes; shorter texts than LENGTH lose none. Rows with equal doc_id and text are one document
and each get its result; rows with equal doc_id and other texts are ordered by a hash of the text; null doc_ids come first.
Extra columns, whatever their names, are ignored; an empty table gives no rows. Texts are read whole; a text longer than CHUNK
makes its chunk longer, and its hashing needs some 50 times its size for a moment.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import ASK, FAN, ask_table, by_bucket, chunked, joined, mix, pack, tally, unpack

LENGTH, ANCHOR = 100, 40
SPREAD = LENGTH - ANCHOR + 1
#: Places of one anchor (counted once a chunk and fragment) up to which its fragments meet in one bucket.
HOT = 20_000
#: Bytes of text in a chunk: hashing needs some 50 times as much memory for a moment.
CHUNK = 3_000_000
U = np.uint64


def gram_hashes(b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the 40 bytes from each place on."""
    h, size = b.astype(U) + U(1), 1
    for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63):
        h = h[: max(0, len(h) - size)] * U(m) + h[size:]
        size *= 2
        if size in (4, 32):
            h = mix(h)
        if size == 8:
            eight = h
    n = max(0, len(b) - ANCHOR + 1)  # 32 bytes and the 8 behind them
    return mix(h[:n] * U(0x2545F4914F6CDD1D) + mix(eight[32 : 32 + n]))


class Chunk:
    """A chunk's distinct documents in order, and the runs of strings that share an anchor."""

    def __init__(self, ids: list, texts: list[bytes], hashed: bool = True):
        tie = [xxhash.xxh64_intdigest(t, 11) - (1 << 63) for t in texts]
        order = sorted(range(len(ids)), key=lambda k: (ids[k] is not None, ids[k] if ids[k] is not None else 0, tie[k], texts[k]))
        self.rows: list[int] = [0] * len(ids)  # the document of each row
        docs: list[int] = []
        for k in order:
            if not docs or (ids[docs[-1]], texts[docs[-1]]) != (ids[k], texts[k]):
                docs.append(k)
            self.rows[k] = len(docs) - 1
        self.texts = [texts[k] for k in docs]
        self.ids = [ids[k] for k in docs]
        self.tie = np.array([tie[k] for k in docs], np.int64)
        size = np.array([len(t) for t in self.texts], np.int64)
        self.start = np.cumsum(size) - size
        self.raw = b"".join(self.texts)
        b = np.frombuffer(self.raw, np.uint8)
        self.first = self.last = self.anchor = np.zeros(0, np.int64)
        self.hash = np.zeros(0, U)
        if len(b) < LENGTH or not hashed:
            return
        h = gram_hashes(b)
        bits = max(24, len(h).bit_length())
        least = (h >> U(bits) << U(bits)) | np.arange(len(h), dtype=U)  # the lowest hash, then the leftmost place
        size_ = 1
        while 2 * size_ <= SPREAD:
            least = np.minimum(least[:-size_], least[size_:])
            size_ *= 2
        least = np.minimum(least[: len(h) - SPREAD + 1], least[SPREAD - size_ :])
        at = (least & U((1 << bits) - 1)).astype(np.int64)
        inside = np.zeros(len(at) + 1, np.int64)
        for s, n in zip(self.start.tolist(), size.tolist(), strict=True):
            if n >= LENGTH:
                inside[s] += 1
                inside[s + n - LENGTH + 1] -= 1
        ok = np.cumsum(inside[:-1]) > 0
        new = ok & np.r_[True, (at[1:] != at[:-1]) | ~ok[:-1] | np.isin(np.arange(1, len(at)), self.start)]
        self.first = np.flatnonzero(new)
        end = np.r_[self.first[1:], len(at)]
        dead = np.flatnonzero(~ok)
        stop = np.searchsorted(dead, self.first)
        self.last = np.minimum(end, np.r_[dead, len(at)][stop]) - 1  # last start of the run
        self.anchor = at[self.first]
        self.hash = h[self.anchor] >> U(8)

    def doc_of(self, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.start, place, side="right") - 1

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        """Ascending anchor hashes as keys (their lowest eight bits are zero) and their counts, cut off far beyond HOT."""
        keys, counts = np.unique(self.hash, return_counts=True)
        return keys << U(8), np.minimum(counts, 1 << 20)


def window_hashes(raw: bytes, starts: np.ndarray) -> np.ndarray:
    """128-bit hashes, as two words, of the LENGTH bytes from each start on."""
    d = b"".join(xxhash.xxh3_128_digest(raw[s : s + LENGTH], 5) for s in starts.tolist())
    return np.frombuffer(d, "<u8").reshape(-1, 2).astype(U)


def merged(doc: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping and touching spans of a document as one, in order."""
    if not len(doc):
        return doc, s, e
    o = np.lexsort((s, doc))
    doc, s, e = doc[o], s[o], e[o]
    big = int(e.max()) + 2  # spans of one document never reach the next one's
    top = np.maximum.accumulate(doc * big + e)
    new = np.r_[True, doc[1:] * big + s[1:] > top[:-1]]
    k = np.flatnonzero(new)
    return doc[k], s[k], top[np.r_[k[1:] - 1, len(doc) - 1]] - doc[k] * big


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Of symbols below 256, by doubling: ranks of 8 symbols, then only what still ties is sorted on."""
    n = len(t)
    padded = np.concatenate([t, np.zeros(8, np.uint8)]).astype(U)
    key = np.zeros(n, U)
    for k in range(8):
        key = (key << U(8)) | padded[k : k + n]
    sa = np.argsort(key, kind="stable")
    key = key[sa]
    head = np.r_[True, key[1:] != key[:-1]]
    del key
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    group = np.flatnonzero(head)[np.cumsum(head) - 1]  # a suffix's rank is where its group starts
    rank[sa] = group
    step = 8
    while True:
        size = np.diff(np.r_[np.flatnonzero(head), n])
        tied = np.repeat(size > 1, size)
        at = np.flatnonzero(tied)
        if not len(at):
            return sa
        sub = sa[at]
        second = rank[np.minimum(sub + step, n)]
        o = np.lexsort((second, group[at]))
        sa[at] = sub[o]
        g, second = group[at], second[o]
        head[at] = np.r_[True, (g[1:] != g[:-1]) | (second[1:] != second[:-1])]
        group = np.flatnonzero(head)[np.cumsum(head) - 1]
        rank[sa[at]] = group[at]
        step *= 2


class RunIndex:
    """Burrows-Wheeler transform of fragments in text order, as runs; each fragment ends in symbol 0."""

    def __init__(self, fragments: list[bytes]):
        # bytes become 1..255 and 0 stays the end: 0 and 255 (never in UTF-8) share a symbol's place
        t = np.frombuffer(b"".join(f.replace(b"\x00", b"\xff") + b"\x00" for f in fragments), np.uint8)
        self.n = n = len(t)
        self.size = np.array([len(f) for f in fragments], np.int64)
        self.start = np.cumsum(self.size + 1) - self.size - 1
        sa = suffix_array(t)
        bwt = t[sa - 1]  # before the first symbol stands the last
        self.run = np.flatnonzero(np.r_[True, bwt[1:] != bwt[:-1]])
        self.symbol = bwt[self.run]
        long = np.diff(np.r_[self.run, n])
        total = np.bincount(bwt, minlength=256)
        before = np.cumsum(total) - total
        order = np.argsort(self.symbol, kind="stable")
        inside = np.cumsum(long[order]) - long[order]
        self.lf = np.empty(len(self.run), np.int64)  # where a run's first row goes
        self.lf[order] = inside + (before - (np.cumsum(total) - total))[self.symbol[order]]
        # classes: neighbours whose first LENGTH symbols, none of them an end, agree
        whole = np.zeros(n, bool)
        for s, m in zip(self.start.tolist(), self.size.tolist(), strict=True):
            whole[s : s + max(0, m - LENGTH + 1)] = True
        self.head = np.flatnonzero(self._heads(t, sa, whole))
        self.least = np.minimum.reduceat(sa, self.head)  # the sample of each class: its first place in the text
        self.ends = np.empty(len(fragments), np.int64)  # the row of each fragment's end symbol
        zero = np.flatnonzero(t[sa] == 0)
        self.ends[np.searchsorted(self.start + self.size, sa[zero])] = zero

    @staticmethod
    def _heads(t: np.ndarray, sa: np.ndarray, whole: np.ndarray) -> np.ndarray:
        head = np.ones(len(sa), bool)
        both = np.flatnonzero(whole[sa[1:]] & whole[sa[:-1]]) + 1
        for k in range(0, LENGTH, 10):  # most neighbours part early
            for j in range(k, k + 10):
                both = both[t[sa[both] + j] == t[sa[both - 1] + j]]
        head[both] = False
        return head

    def earlier(self) -> list[np.ndarray]:
        """Of each fragment the starts whose match with something before them has LENGTH bytes or more."""
        out: list[list[int]] = [[] for _ in self.size]
        row, live = self.ends.copy(), np.arange(len(self.size))
        for back in range(1, int(self.size.max(initial=0)) + 1):
            live = live[self.size[live] >= back]
            r = row[live]
            run = np.searchsorted(self.run, r, side="right") - 1
            row[live] = r = self.lf[run] + r - self.run[run]
            if back >= LENGTH:
                own = self.size[live] - back
                first = self.least[np.searchsorted(self.head, r, side="right") - 1]
                for f, p in zip(live[hit := first < self.start[live] + own].tolist(), own[hit].tolist(), strict=True):
                    out[f].append(p)
        return [np.array(x[::-1], np.int64) for x in out]


FRAGMENTS = "bucket int, chunk long, kind int, meta binary, body binary"


def _number(ids: list) -> np.ndarray:
    """doc_ids as numbers in their order; null first."""
    return np.array([-(1 << 63) if i is None else i for i in ids], np.int64)


def cut_repeats(docs: DataFrame, fan: int = FAN) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and spans, the removed byte ranges. doc_id: an integer."""
    import zstandard

    parts, n_chunks = chunked(docs, chunk_bytes=CHUNK)
    parts = parts.withColumn("chunk", F.col("chunk").cast("long"))  # the type of senders, so that both sides hash alike
    ranges, n_cut = max(4, n_chunks // 6), max(4, 2 * n_chunks)
    parts_ = min(ranges, fan)
    kind = docs.schema["doc_id"].dataType
    id_type = to_arrow_type(kind)

    def of(t: pa.Table, hashed: bool = True) -> Chunk:
        return Chunk(t["doc_id"].to_pylist(), t["text"].to_pylist(), hashed)

    def table(rows: list[tuple]) -> pa.Table:
        return pa.table({c: pa.array([r[k] for r in rows], k_) for k, (c, k_) in enumerate((("bucket", pa.int32()), ("chunk", pa.int64()), ("kind", pa.int32()), ("meta", pa.binary()), ("body", pa.binary())))})

    def squeeze(b: bytes) -> bytes:
        return zstandard.ZstdCompressor(level=1).compress(b)

    def packed(*arrays: np.ndarray) -> bytes:
        """Arrays of one length as 64-bit columns."""
        return pack(np.concatenate([a.astype(np.int64) for a in arrays]))

    def columns(b: bytes, k: int) -> np.ndarray:
        return unpack(b, np.int64).reshape(k, -1)

    def anchors(t: pa.Table) -> pa.Table:
        return ask_table(t["chunk"][0].as_py(), *of(t).distinct(), parts_, 8)

    def fragments(t: pa.Table, replies: pa.Table) -> pa.Table:
        c, chunk = of(t), t["chunk"][0].as_py()
        keys, _ = c.distinct()
        state = joined(replies, np.uint8)
        of_run = state[np.searchsorted(keys, c.hash << U(8))] if len(keys) else state
        number, rows = _number(c.ids), []
        md, ms, me = [], [], []  # marks: repeats within the chunk
        seen: set[bytes] = set()
        out: list[int] = []
        for k in np.flatnonzero(of_run == 1).tolist():
            s, e = int(c.first[k]), int(c.last[k]) + LENGTH
            f = c.raw[s:e]
            if f in seen:
                md.append(k)
                ms.append(s)
                me.append(e)
            else:
                seen.add(f)
                out.append(k)
        mark_doc, ms, me = c.doc_of(np.array(ms, np.int64)), np.array(ms, np.int64), np.array(me, np.int64)
        k = np.array(out, np.int64)
        o, ends = by_bucket((mix(c.hash[k] + U(1)) % U(n_cut)).astype(np.int64), n_cut)
        for b, some in enumerate(np.split(k[o], ends[:-1])):
            if len(some):
                d = c.doc_of(c.first[some])
                body = b"".join(c.raw[s : e + LENGTH] for s, e in zip(c.first[some].tolist(), c.last[some].tolist(), strict=True))
                rows.append((b, chunk, 1, packed(number[d], c.tie[d], d, c.first[some] - c.start[d], c.last[some] - c.first[some] + LENGTH), squeeze(body)))
        hot = np.flatnonzero(of_run == 2)
        if len(hot):
            starts = np.concatenate([np.arange(c.first[k], c.last[k] + 1) for k in hot.tolist()])
            h = window_hashes(c.raw, starts)
            o = np.lexsort((starts, h[:, 1], h[:, 0]))
            h, starts = h[o], starts[o]
            new = np.r_[True, (h[1:] != h[:-1]).any(axis=1)]
            twice = starts[~new]
            mark_doc, ms, me = np.concatenate([mark_doc, c.doc_of(twice)]), np.concatenate([ms, twice]), np.concatenate([me, twice + LENGTH])
            h, starts = h[new], starts[new]
            o, ends = by_bucket((mix(h[:, 1]) % U(n_cut)).astype(np.int64), n_cut)
            for b, some in enumerate(np.split(o, ends[:-1])):
                if len(some):
                    d = c.doc_of(starts[some])
                    rows.append((b, chunk, 2, packed(number[d], c.tie[d], d, starts[some] - c.start[d]), packed(h[some, 0].view(np.int64), h[some, 1].view(np.int64))))
        mark_doc, ms, me = merged(mark_doc, ms - c.start[mark_doc], me - c.start[mark_doc])
        rows.append((chunk % n_cut, chunk, 3, packed(mark_doc, ms, me), b""))
        return table(rows)

    def marks(t: pa.Table) -> pa.Table:
        got = list(zip(*(t[c].to_pylist() for c in ("chunk", "kind", "meta", "body")), strict=True))
        out = [(0, c, 3, m, b"") for c, k, m, _ in got if k == 3]
        chunk_of, doc, s, e = [], [], [], []

        def mark(c, d, a, b):
            for x, y in zip((chunk_of, doc, s, e), (c, d, a, b), strict=True):
                x.append(y)

        cut = [(c, columns(m, 5), zstandard.ZstdDecompressor().decompress(b)) for c, k, m, b in got if k == 1]
        if cut:
            cols = np.concatenate([m for _, m, _ in cut], axis=1)
            owner = np.repeat([c for c, _, _ in cut], [m.shape[1] for _, m, _ in cut])
            raw = b"".join(b for _, _, b in cut)
            ends = np.cumsum(cols[4])
            o = np.lexsort((cols[3], cols[1], cols[0]))  # document, its tie, place
            seen: dict[bytes, None] = {}
            first, again = [], []
            for k in o.tolist():
                f = raw[ends[k] - cols[4, k] : ends[k]]
                if f in seen:
                    again.append(k)
                else:
                    seen[f] = None
                    first.append(k)
            k = np.array(again, np.int64)
            mark(owner[k], cols[2, k], cols[3, k], cols[3, k] + cols[4, k])
            hits = RunIndex(list(seen)).earlier()
            k = np.repeat(np.array(first, np.int64), [len(x) for x in hits])
            p = np.concatenate(hits) if hits else np.zeros(0, np.int64)
            mark(owner[k], cols[2, k], cols[3, k] + p, cols[3, k] + p + LENGTH)
        single = [(c, columns(m, 4), columns(b, 2)) for c, k, m, b in got if k == 2]
        if single:
            cols = np.concatenate([np.concatenate([m, h]) for _, m, h in single], axis=1)
            owner = np.repeat([c for c, _, _ in single], [m.shape[1] for _, m, _ in single])
            o = np.lexsort((cols[3], cols[1], cols[0], cols[5], cols[4]))
            later = o[1:][(cols[4:, o[1:]] == cols[4:, o[:-1]]).all(axis=0)]
            mark(owner[later], cols[2, later], cols[3, later], cols[3, later] + LENGTH)
        if doc:
            chunk_of, doc, s, e = (np.concatenate(x).astype(np.int64) for x in (chunk_of, doc, s, e))
            o = np.argsort(chunk_of, kind="stable")
            chunks, at = np.unique(chunk_of[o], return_index=True)
            for c, some in zip(chunks.tolist(), np.split(o, at[1:]), strict=True):
                out.append((0, c, 3, packed(*merged(doc[some], s[some], e[some])), b""))
        return table(out)

    def finish(t: pa.Table, marks: pa.Table) -> pa.Table:
        c = of(t, hashed=False)
        spans = np.concatenate([np.zeros((3, 0), np.int64), *(columns(m, 3) for m in marks["meta"].to_pylist())], axis=1)
        doc, s, e = merged(*spans)
        lo, hi = np.searchsorted(doc, np.arange(len(c.texts))), np.searchsorted(doc, np.arange(len(c.texts)), side="right")
        res = []
        for d, text in enumerate(c.texts):
            cuts, kept, at = list(zip(s[lo[d] : hi[d]].tolist(), e[lo[d] : hi[d]].tolist(), strict=True)), hashlib.sha256(), 0
            for a, b in cuts:
                kept.update(text[at:a])
                at = b
            kept.update(text[at:])
            res.append((len(text), sum(b - a for a, b in cuts), len(cuts), kept.hexdigest(), [{"start": a, "stop": b} for a, b in cuts]))
        rows = [res[d] for d in c.rows]
        types = (("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))))
        return pa.table({"doc_id": t["doc_id"].cast(id_type)} | {name: pa.array([r[k] for r in rows], k_) for k, (name, k_) in enumerate(types)})

    asked = parts.groupBy("chunk").applyInArrow(anchors, ASK)
    replies = tally(asked, n_chunks, parts_, ranges, 8, np.int64, lambda n: (n > 1).astype(np.uint8) + (n > HOT))
    cut = parts.groupBy("chunk").cogroup(replies.groupBy("sender")).applyInArrow(fragments, FRAGMENTS)
    found = cut.groupBy("bucket").applyInArrow(marks, FRAGMENTS)
    schema = f"doc_id {kind.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,stop:long>>"
    return parts.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(finish, schema)


def op7_repeats(spark, sf_dir: str) -> DataFrame:
    return cut_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
