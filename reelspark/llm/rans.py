"""Token ids in binary blocks: static range asymmetric numeral system with interleaved lanes, checkpoints and checksums.

A frequency table over the whole corpus is shared by all blocks. A block holds whole documents; its ids are laid out in
rows of LANES, each lane with a 64-bit state that emits and takes 32-bit words. At every STEP rows the lane states and the
place in the word stream are kept, so the segments between two checkpoints decode side by side; each segment's ids and
each payload have a CRC-32. Files are Parquet rows of one block each, in ascending doc_id order, and a table's frequencies.

Null and empty texts are the end id alone; rows that repeat a doc_id are written as often as they come, ordered by text;
null doc_ids come first; extra columns, whatever their names, are ignored; an empty table gives no blocks and no rows. Texts
are encoded whole; a document is never split, so a very long one makes its block longer.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import new_table, saved
from .tokens import WORD_BPE, encoder, tokenizer_path

LANES, STEP, SCALE = 512, 128, 20
LOW = 1 << 31
#: Ids after which a block is closed; documents are never split, so one longer document makes a longer block.
BLOCK_IDS = 262_144
#: Text pieces whose ids a worker remembers (twice as many at most).
MEMO = 600_000
MAGIC = b"RNSB"
_HEAD = struct.Struct("<4sIIIIII")


def quantised(counts: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """Frequencies that add up to 2**scale, at least 1 wherever a count is."""
    total, room = int(counts.sum()), 1 << scale
    used = np.flatnonzero(counts)
    if len(used) > room:
        raise ValueError("more symbols than the table has room for")
    f = np.zeros(len(counts), np.int64)
    if not total:
        return f
    f[used] = np.maximum(1, np.floor(counts[used] * ((room - len(used)) / total)).astype(np.int64))
    order = used[np.argsort(-f[used], kind="stable")]
    left = room - int(f.sum())
    if left >= 0:
        f[order[0]] += left
    k = 0
    while left < 0:  # rounding up rare symbols is paid for by the common ones
        take = min(-left, int(f[order[k]]) - 1)
        f[order[k]] -= take
        left += take
        k += 1
    return f


class Table:
    """Shared frequencies: what encoder and decoder look up."""

    def __init__(self, freq: np.ndarray):
        self.f = freq.astype(np.uint64)
        self.c = np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)
        self.crc = zlib.crc32(freq.astype("<u4").tobytes())


def encode(ids: np.ndarray, table: Table) -> bytes:
    n = len(ids)
    rows = -(-n // LANES)
    x, words, marks, counts = np.full(LANES, LOW, np.uint64), [], [], np.zeros(rows, np.int64)
    scale, limit, half = np.uint64(SCALE), np.uint64(63 - SCALE), np.uint64(32)
    for t in range(rows - 1, -1, -1):
        s = ids[t * LANES : (t + 1) * LANES]
        y = x[: len(s)]
        f = table.f[s]
        out = y >= f << limit
        w = y[out]
        counts[t] = len(w)
        words.append(w.astype(np.uint32))  # the low half
        y[out] = w >> half
        q = y // f
        y[:] = (q << scale) + (y - q * f) + table.c[s]
        if t % STEP == 0:
            marks.append(x.copy())
    stream = np.concatenate(words[::-1]) if words else np.zeros(0, np.uint32)
    before = np.concatenate([[0], np.cumsum(counts)])[:-1][::STEP] if rows else np.zeros(0, np.int64)
    crcs = np.array([zlib.crc32(ids[k : k + STEP * LANES].astype("<u4").tobytes()) for k in range(0, n, STEP * LANES)], "<u4")
    body = before.astype("<u4").tobytes() + crcs.tobytes() + b"".join(m.astype("<u8").tobytes() for m in marks[::-1]) + stream.astype("<u4").tobytes()
    return _HEAD.pack(MAGIC, n, LANES, STEP, len(stream), table.crc, zlib.crc32(body)) + body


def decode(payload: bytes, table: Table) -> np.ndarray:
    """The ids; raises ValueError where a checksum doesn't hold."""
    magic, n, lanes, step, n_words, table_crc, crc = _HEAD.unpack_from(payload)
    body = payload[_HEAD.size :]
    if magic != MAGIC or zlib.crc32(body) != crc or table_crc != table.crc:
        raise ValueError("damaged block or another frequency table")
    rows = -(-n // lanes)
    segments = -(-rows // step)
    pos = np.frombuffer(body, "<u4", segments).astype(np.int64)
    crcs = np.frombuffer(body, "<u4", segments, 4 * segments)
    x = np.frombuffer(body, "<u8", segments * lanes, 8 * segments).astype(np.uint64).reshape(segments, lanes)
    words = np.frombuffer(body, "<u4", n_words, (8 + 8 * lanes) * segments).astype(np.uint64)
    out = np.zeros((segments, step, lanes), np.uint32)
    scale, mask, low, half = np.uint64(SCALE), np.uint64((1 << SCALE) - 1), np.uint64(LOW), np.uint64(32)
    begin = np.arange(segments) * step * lanes
    for r in range(step):
        have = np.clip(n - begin - r * lanes, 0, lanes)
        live = int((have > 0).sum())
        if not live:
            break
        y = x[:live]
        slot = y & mask
        s = table.symbol[slot]
        out[:live, r] = s
        z = table.f[s] * (y >> scale) + slot - table.c[s]
        need = z < low
        if have[live - 1] < lanes:  # the last row of all may be short
            need[live - 1, have[live - 1] :] = False
            z[live - 1, have[live - 1] :] = y[live - 1, have[live - 1] :]
        took = np.cumsum(need, axis=1)
        at = (pos[:live, None] + took - 1)[need]
        z[need] = (z[need] << half) | words[at]
        pos[:live] += took[:, -1]
        x[:live] = z
    ids = out.reshape(-1)[:n]
    for k in range(segments):
        if zlib.crc32(ids[k * step * lanes : (k + 1) * step * lanes].astype("<u4").tobytes()) != crcs[k]:
            raise ValueError(f"segment {k} doesn't decode to what was written")
    return ids


def _tokenized(docs: DataFrame, path: str, end_id: int, kind) -> DataFrame:
    """part, seq, doc_id and ids (32-bit, packed) in ascending doc_id order: part after part, seq after seq."""
    names = ["part", "seq", "doc_id", "ids"]

    def rows(batches):
        from pyspark import TaskContext

        part, seq, end = TaskContext.get().partitionId(), 0, np.array([end_id], np.uint32)
        for b in batches:
            for k in range(0, len(b), 256):
                piece = b.slice(k, 256)
                ids = [np.concatenate([t, end]) for t in encoder(path, MEMO).encode(piece["text"].to_pylist())]
                n = len(ids)
                yield pa.RecordBatch.from_arrays([pa.array([part] * n, pa.int32()), pa.array(range(seq, seq + n), pa.int64()), piece["doc_id"], pa.array([planes(t) for t in ids], pa.binary())], names)
                seq += n

    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return ordered.mapInArrow(rows, f"part int, seq long, doc_id {kind}, ids binary")


def planes(ids: np.ndarray) -> bytes:
    """Low and high halves of ids below 2**16 as they are, others whole: a first byte tells which."""
    return b"\x02" + ids.astype("<u2").tobytes() if not len(ids) or ids.max() < 65536 else b"\x04" + ids.astype("<u4").tobytes()


def whole(b: bytes) -> np.ndarray:
    return np.frombuffer(b, "<u2" if b[0] == 2 else "<u4", offset=1).astype(np.uint32)


def _counts(tokens: DataFrame) -> DataFrame:
    def rows(batches):
        total = np.zeros(0, np.int64)
        for b in batches:
            for k in range(0, len(b), 1024):
                ids = np.concatenate([whole(x) for x in b["ids"].slice(k, 1024).to_pylist()])
                c = np.bincount(ids, minlength=len(total))
                c[: len(total)] += total
                total = c
        s = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(s, pa.int32()), pa.array(total[s], pa.int64())], ["symbol", "n"])

    return tokens.select("ids").mapInArrow(rows, "symbol int, n long").groupBy("symbol").agg(F.sum("n").alias("n"))


def write(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 2, vocabulary: int = 1 << 17) -> str:
    """Writes the ids of all documents below path (blocks, table); the vocabulary bounds what the driver collects."""
    kind = docs.schema["doc_id"].dataType
    spark, at = docs.sparkSession, new_table(docs.sparkSession, "ids")
    _tokenized(docs, tokenizer or tokenizer_path(WORD_BPE), end_id, kind.simpleString()).write.option("compression", "zstd").parquet(at)
    tokens = spark.read.parquet(at)
    counts = np.zeros(vocabulary, np.int64)
    for r in _counts(tokens).toLocalIterator():
        counts[r["symbol"]] = r["n"]
    freq = quantised(counts)
    used = np.flatnonzero(freq)
    spark.createDataFrame([(int(s), int(freq[s])) for s in used], "symbol int, freq long").coalesce(1).write.parquet(f"{path}/table")
    shared, id_type = spark.sparkContext.broadcast(freq), to_arrow_type(kind)
    names = ["part", "seq", "n_docs", "n_ids", "doc_ids", "lengths", "payload"]

    def rows(batches):
        table = Table(shared.value)
        part, first, ids, lengths, held = None, 0, [], [], []

        def block():
            flat = np.concatenate(held)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([first], pa.int64()), pa.array([len(ids)], pa.int32()), pa.array([len(flat)], pa.int64()), pa.array([ids], pa.list_(id_type)), pa.array([lengths], pa.list_(pa.int32())), pa.array([encode(flat, table)], pa.binary())], names)

        for b in batches:
            for p, s, i, packed in zip(*(b[c].to_pylist() for c in ("part", "seq", "doc_id", "ids")), strict=True):
                if ids and (p != part or s != first + len(ids) or sum(lengths) >= BLOCK_IDS):
                    yield block()
                    ids, lengths, held = [], [], []
                if not ids:
                    part, first = p, s
                ids.append(i)
                held.append(whole(packed))
                lengths.append(len(held[-1]))
        if ids:
            yield block()

    schema = f"part int, seq long, n_docs int, n_ids long, doc_ids array<{kind.simpleString()}>, lengths array<int>, payload binary"
    tokens.mapInArrow(rows, schema).write.option("compression", "uncompressed").parquet(f"{path}/blocks")
    return path


def frequencies(spark: SparkSession, path: str) -> np.ndarray:
    rows = spark.read.parquet(f"{path}/table").collect()
    freq = np.zeros(max((r["symbol"] for r in rows), default=0) + 1, np.int64)
    for r in rows:
        freq[r["symbol"]] = r["freq"]
    return freq


def read(spark: SparkSession, path: str, vocabulary: int = 1 << 17) -> DataFrame:
    """Per document from the files: doc_id, start, n_tokens, ids_crc32. vocabulary: as given to write()."""
    blocks = spark.read.parquet(f"{path}/blocks")
    freq = frequencies(spark, path)
    freq = np.pad(freq, (0, max(0, vocabulary - len(freq))))
    shared = spark.sparkContext.broadcast(freq)
    kind = blocks.schema["doc_ids"].dataType.elementType
    id_type = to_arrow_type(kind)
    names = ["part", "seq", "inside", "doc_id", "n_tokens", "ids_crc32"]

    def rows(batches):
        table = Table(shared.value)
        for b in batches:
            for p, s, doc_ids, lengths, payload in zip(*(b[c].to_pylist() for c in ("part", "seq", "doc_ids", "lengths", "payload")), strict=True):
                ids, ends = decode(payload, table), np.cumsum(lengths)
                crc = [zlib.crc32(ids[e - m : e].astype("<u4").tobytes()) for e, m in zip(ends.tolist(), lengths, strict=True)]
                n = len(doc_ids)
                yield pa.RecordBatch.from_arrays([pa.array([p] * n, pa.int32()), pa.array([s] * n, pa.int64()), pa.array(ends - np.array(lengths), pa.int64()), pa.array(doc_ids, id_type), pa.array(lengths, pa.int64()), pa.array(crc, pa.int64())], names)

    docs = blocks.select("part", "seq", "doc_ids", "lengths", "payload").mapInArrow(rows, f"part int, seq long, inside long, doc_id {kind.simpleString()}, n_tokens long, ids_crc32 long")
    # where blocks start: running sums inside a part, and over the parts' totals (a row a part)
    sizes = saved(blocks.select("part", "seq", "n_ids"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("total")).withColumn("base", F.coalesce(F.sum("total").over(earlier), F.lit(0)))
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("run", F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).join(parts, "part").select("part", "seq", (F.col("base") + F.col("run")).alias("base"))
    return docs.join(starts, ["part", "seq"]).select("doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def op5_rans(spark, sf_dir: str) -> DataFrame:
    path = new_table(spark, "rans")
    return read(spark, write(spark.read.parquet(f"{sf_dir}/documents.parquet"), path))
