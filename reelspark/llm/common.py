"""Shared pieces: the shared folder, packed arrays, chunks of documents, ASCII words."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one chunk holds on average; a chunk is what one Python call has in memory.
CHUNK_BYTES = 8_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session."""
    there = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not there and spark.sparkContext.master.startswith("local"):  # one machine, so its own folder is shared
        there = "file:" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    if not there:
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(there)
    return there


def new_table(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used yet."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame) -> DataFrame:
    """The rows, computed once and kept in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows, written once as Parquet in the shared folder, so that later readers take only the columns they need."""
    there = new_table(df.sparkSession, name)
    df.write.parquet(there)
    return df.sparkSession.read.schema(df.schema).parquet(there)


#: Rows of a table of single numbers or words up to which it is broadcast; beyond it Spark joins by shuffle.
FEW = 100_000


def few(df: DataFrame) -> DataFrame:
    """The rows, to be broadcast if they have been counted as FEW at most. df: cheap to count, as when saved."""
    return F.broadcast(df) if df.limit(FEW + 1).count() <= FEW else df


def pack(a: np.ndarray, ascending: bool = False) -> bytes:
    """An integer or float array as compressed bytes; ascending ones are stored as differences."""
    if ascending and len(a):
        a = np.concatenate([a[:1], a[1:] - a[:-1]])
    raw = np.ascontiguousarray(a)
    if len(raw) and raw.dtype.itemsize > 1:  # byte planes compress better than whole numbers
        raw = raw.view(np.uint8).reshape(len(raw), -1).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(raw).tobytes())


def unpack(b: bytes, dtype, ascending: bool = False) -> np.ndarray:
    kind = np.dtype(dtype)
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8)
    a = np.ascontiguousarray(raw.reshape(kind.itemsize, -1).T).view(kind).ravel() if len(raw) else np.zeros(0, kind)
    return np.cumsum(a, dtype=kind) if ascending and len(a) else a


def chunked(docs: DataFrame, *more, chunk_bytes: int = CHUNK_BYTES) -> tuple[DataFrame, int]:
    """doc_id, text as bytes (null: empty), columns more, and chunk, which deals rows evenly over chunks of about chunk_bytes.

    Rows equal in doc_id and text share a chunk. The second result is the number of chunks.
    """
    total = docs.select(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-int(total) // chunk_bytes))
    body = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", body.cast("binary").alias("text"), *more, F.pmod(F.xxhash64("doc_id", body), F.lit(n)).cast("int").alias("chunk")), n


def split_words(texts: pa.Array, kind: np.ndarray, lower: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts without nulls: their distinct words as bytes, all words as places among these, the text that each stands in, and
    the number of the piece that each stands in, over all texts. kind: of each byte, 0 if it is part of a word, 1 if it parts
    words, 2 if it parts pieces too; lower: what each byte becomes."""
    arr = texts.cast(pa.large_binary())
    offsets = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset : arr.offset + len(arr) + 1]
    raw = np.frombuffer(arr.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    kinds = kind[raw]
    inside = kinds == 0
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    at = (offsets[:-1] - offsets[0])[np.diff(offsets) > 0]  # texts begin here
    begin[at] = inside[at]
    start = np.nonzero(begin)[0]
    bound = np.cumsum(inside)
    edges = np.append(bound[start] - 1, bound[-1:]) if len(start) else np.zeros(1, np.int64)
    coded = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(edges.astype(np.int64).tobytes()), pa.py_buffer(lower[raw][inside].tobytes())]).dictionary_encode()
    kinds[at] = 2  # a text's first byte parts it from the text before
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.searchsorted(offsets - offsets[0], start, "right") - 1, np.cumsum(kinds == 2, dtype=np.int32)[start]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: near inputs give unrelated outputs."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def majority(h: np.ndarray) -> int:
    """A number whose bit k is set if it is in more than half of the 64-bit numbers h, of which there is one at least."""
    ones = np.zeros(64, np.int64)
    for k in range(0, len(h), 4096):
        ones += np.unpackbits(h[k : k + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint16)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def by_bucket(bucket: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """An order that keeps rows of a bucket together, as they came, and where each bucket ends."""
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(n), side="right")


#: Bits of a bitmap of keys: 8 a row of the table, 2**FILTER_BITS (4 MB) at most, in pieces of PIECE bits.
FILTER_BITS, PIECE = 25, 15


def filter_bits(rows: int) -> int:
    return 1 << max(PIECE, min(FILTER_BITS, (8 * rows).bit_length()))


def piece_and_bit(key: Column, bits: int) -> tuple[Column, Column]:
    """Where a key's bit is in a bitmap of so many bits; keys may share one."""
    spot = F.pmod(key, F.lit(bits))
    return F.shiftright(spot, PIECE), spot.bitwiseAND(F.lit((1 << PIECE) - 1))


def is_set(piece: Column, bit: Column) -> Column:
    """Whether the bit is set in its piece of a bitmap; null pieces have none."""
    byte = F.conv(F.hex(F.substring(piece, F.shiftright(bit.cast("int"), 3) + 1, F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.floor(byte / F.pow(F.lit(2), bit.bitwiseAND(F.lit(7)))) % 2 == 1, F.lit(False))


def marked(df: DataFrame, key: str, keys: DataFrame, rows: int, name: str) -> DataFrame:
    """df with a mark on rows whose key is among keys, and on some whose key only shares a bit with one: by a bitmap of bounded size, without a shuffle of df."""
    bits = filter_bits(rows)
    piece, bit = piece_and_bit(F.col(key), bits)
    pieces = keys.groupBy(piece.alias("__piece")).agg(F.bitmap_construct_agg(bit).alias("__map"))
    return df.withColumn("__piece", piece).join(F.broadcast(pieces), "__piece", "left").withColumn(name, is_set(F.col("__map"), bit)).drop("__piece", "__map")


def seem_among(df: DataFrame, key: str, keys: DataFrame, rows: int) -> DataFrame:
    """Rows of df whose key is among keys, and some whose key shares a bit with one."""
    return marked(df, key, keys, rows, "__seems").where("__seems").drop("__seems")


#: Messages that a sender cuts its keys into at most. Where that is too few for tasks to stay small, relays cut them further.
FAN = 64
ASK = "sender long, place long, keys binary, values binary"
REPLY = "sender long, place long, reply binary, notes array<long>"


def pack_keys(keys: np.ndarray, shift: int) -> bytes:
    """Ascending keys; the even ones are multiples of 2**shift and need fewer bytes."""
    odd = (keys & np.uint64(1)) > 0
    whole = pack(keys[odd], True)
    return len(whole).to_bytes(4, "little") + whole + pack(keys[~odd] >> np.uint64(shift), True)


def unpack_keys(b: bytes, shift: int) -> np.ndarray:
    n = 4 + int.from_bytes(b[:4], "little")
    out = np.concatenate([unpack(b[4:n], np.uint64, True), unpack(b[n:], np.uint64, True) << np.uint64(shift)])
    out.sort()
    return out


def _cut(keys: np.ndarray, place: int, parts: int, of: int) -> np.ndarray:
    """Where ascending keys of place (one of `of` equal ranges of all 64-bit numbers) cross into each of its parts."""
    edges = [(place * parts + k) * (1 << 64) // (of * parts) for k in range(1, parts)]
    return np.searchsorted(keys, np.array(edges, np.uint64))


def ask_table(sender: int, keys: np.ndarray, values: np.ndarray, parts: int, shift: int, place: int = 0, of: int = 1) -> pa.Table:
    """Rows of ASK: ascending keys and their values, one message for each part of the range of keys, empty ones too."""
    at = _cut(keys, place, parts, of)
    keys, values = [pack_keys(k, shift) for k in np.split(keys, at)], [pack(v) for v in np.split(values, at)]
    return pa.table({"sender": pa.array([sender] * parts, pa.int64()), "place": pa.array(range(place * parts, (place + 1) * parts), pa.int64()), "keys": pa.array(keys, pa.binary()), "values": pa.array(values, pa.binary())})


def joined(replies: pa.Table, kind) -> np.ndarray:
    """What came back for all keys of a sender, in their order."""
    return np.concatenate([unpack(x, kind) for x in replies.sort_by("place")["reply"].to_pylist()])


def _named(t: pa.Table, shift: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of messages: where each one's keys end, all keys in order, and where each named key is among these."""
    named = [unpack_keys(b, shift) for b in t["keys"].to_pylist()]
    keys, where = np.unique(np.concatenate(named), return_inverse=True)
    return np.cumsum([len(a) for a in named])[:-1], keys, where


def _read(t: pa.Table, shift: int, value: np.dtype) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The same, and the sums of the values."""
    ends, keys, where = _named(t, shift)
    sums = np.bincount(where, np.concatenate([unpack(b, value) for b in t["values"].to_pylist()]), len(keys))
    return ends, keys, where, sums if value.kind == "f" else sums.astype(value)


def _replies(t: pa.Table, replies: list, notes: list) -> pa.Table:
    return pa.table({"sender": t["sender"], "place": t["place"], "reply": pa.array([pack(b) for b in replies], pa.binary()), "notes": pa.array([notes] * len(t), pa.list_(pa.int64()))})


def _home(got: DataFrame, hops: list, shift: int, kind) -> DataFrame:
    """The answers of the last hop, brought back over the relays of all hops before it."""

    def back(t: pa.Table, got: pa.Table) -> pa.Table:
        t = t.sort_by("sender")
        ends, _, where = _named(t, shift)
        return _replies(t.select(["sender", "place"]), np.split(joined(got, kind)[where], ends), [sum(x) for x in zip(*got["notes"].to_pylist(), strict=True)])

    for asks, _, _ in hops[-2::-1]:
        home = got.withColumn("from", F.floor(F.col("place") / FAN).cast("long"))
        got = asks.groupBy("place", "relay").cogroup(home.groupBy("from", "sender")).applyInArrow(back, REPLY)
    return got


def _to_relay(rows: DataFrame, group: int) -> DataFrame:
    return rows.withColumn("relay", F.pmod(F.xxhash64("sender"), F.lit(group)))


def relayed(asks: DataFrame, senders: int, parts: int, ranges: int, shift: int, value) -> list[tuple[DataFrame, int, int]]:
    """The hops of tally(): asks and, where there are more ranges than parts, what relays pass on, each with its senders and parts."""
    value, out = np.dtype(value), []

    def relay(of: int):
        def passed(t: pa.Table) -> pa.Table:
            _, keys, _, sums = _read(t.sort_by("sender"), shift, value)
            return ask_table(t["relay"][0].as_py(), keys, sums.astype(value), FAN, shift, t["place"][0].as_py(), of)

        return passed

    while ranges > parts:
        group = -(-senders // FAN)
        asks = _to_relay(asks, group)
        out.append((asks, senders, parts))
        asks, senders, parts = asks.groupBy("place", "relay").applyInArrow(relay(parts), ASK), group, parts * FAN
    return [*out, (asks, senders, parts)]


def tally(asks: DataFrame, senders: int, parts: int, ranges: int, shift: int, value, answer, notes=lambda keys, sums: [], hops: list | None = None) -> DataFrame:
    """Sums over all senders of the values of each key, sent back to every sender that named the key.

    asks: rows of ask_table(), cut into parts; value: their numpy type; answer(sums) gives the array that is sent back, in the
    order of the sender's keys; notes(keys, sums), a few numbers, add up over what a row stands for. Keys are hashes, so ranges
    of them are even, and a key comes from a sender once: no key is hot. Rows of REPLY come back. ranges: how many tasks the
    sums need. Where it exceeds parts, relays sum the messages of up to FAN senders, cut them on, and pass the answers back; so
    each hop moves as many rows as senders times FAN. hops: relayed() of the same, for a caller that has it.
    """
    value = np.dtype(value)

    def total(t: pa.Table) -> pa.Table:
        ends, keys, where, sums = _read(t, shift, value)
        return _replies(t, np.split(answer(sums)[where], ends), [int(x) for x in notes(keys, sums)])

    hops = hops or relayed(asks, senders, parts, ranges, shift, value)
    return _home(hops[-1][0].groupBy("place").applyInArrow(total, REPLY), hops, shift, answer(np.zeros(0, value)).dtype)


MORE = "sender long, place long, more array<binary>"


def pack_sparse(a: np.ndarray) -> bytes:
    """Whole numbers, zeros as a bit each and the rest without their leading zeros or ones."""
    some = a != 0
    marks = pack(np.packbits(some))
    return len(a).to_bytes(4, "little") + len(marks).to_bytes(4, "little") + marks + pack(((a[some] << 1) ^ (a[some] >> 63)).view(np.uint64))


def unpack_sparse(b: bytes) -> np.ndarray:
    n, end = int.from_bytes(b[:4], "little"), 8 + int.from_bytes(b[4:8], "little")
    out = np.zeros(n, np.int64)
    a = unpack(b[end:], np.uint64)
    out[np.unpackbits(unpack(b[8:end], np.uint8), count=n).astype(bool)] = (a >> np.uint64(1)).view(np.int64) ^ -(a & np.uint64(1)).view(np.int64)
    return out


def more_table(sender: int, keys: list[np.ndarray], values: list[np.ndarray], parts: int, place: int = 0, of: int = 1) -> pa.Table:
    """Rows of MORE: further whole numbers for the keys of one or more ask_table()s, cut as these are, without the keys."""
    cut = [map(pack_sparse, np.split(v, _cut(k, place, parts, of))) for k, v in zip(keys, values, strict=True)]
    return pa.table({"sender": pa.array([sender] * parts, pa.int64()), "place": pa.array(range(place * parts, (place + 1) * parts), pa.int64()), "more": pa.array([list(x) for x in zip(*cut, strict=True)], pa.list_(pa.binary()))})


def retally(hops: list, more: DataFrame, which: int, shift: int, answer) -> DataFrame:
    """tally() of further numbers for keys that have been named, so that keys are not sent again: their exchanges are read again.

    hops: relayed() of the asks that named the keys; more: rows of more_table(), one for each of the asks' rows; which: which of
    its arrays belongs to these keys.
    """

    def read(t: pa.Table, more: pa.Table, at: int):
        t, more = t.sort_by("sender"), more.sort_by("sender")
        ends, keys, where = _named(t, shift)
        return t, ends, keys, where, np.bincount(where, np.concatenate([unpack_sparse(b[at]) for b in more["more"].to_pylist()]), len(keys)).astype(np.int64)

    def relay(of: int, at: int):
        def passed(t: pa.Table, more: pa.Table) -> pa.Table:
            t, _, keys, _, sums = read(t, more, at)
            return more_table(t["relay"][0].as_py(), [keys], [sums], FAN, t["place"][0].as_py(), of)

        return passed

    def total(at: int):
        def summed(t: pa.Table, more: pa.Table) -> pa.Table:
            t, ends, _, where, sums = read(t, more, at)
            return _replies(t, np.split(answer(sums)[where], ends), [])

        return summed

    for asks, senders, parts in hops[:-1]:
        more = asks.groupBy("place", "relay").cogroup(_to_relay(more, -(-senders // FAN)).groupBy("place", "relay")).applyInArrow(relay(parts, which), MORE)
        which = 0
    return _home(hops[-1][0].groupBy("place").cogroup(more.groupBy("place")).applyInArrow(total(which), REPLY), hops, shift, answer(np.zeros(0, np.int64)).dtype)
