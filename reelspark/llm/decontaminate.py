"""Benchmark decontamination: one Aho-Corasick automaton over normalised test texts, one scan of each document.

Null or wordless texts have zero words and no hits; an empty benchmark hits nothing; repeated benchmark rows and equal
windows of several items count for each item once; passages of an item whose item_id is null are hit like any other but
name no item. Repeated documents keep a row each, null doc_ids stay null; columns beyond those named, whatever their names,
are ignored (`scan`) or kept (`clean`); an empty table gives no rows. Texts are scanned whole, SCAN_BYTES of documents at once
or one longer text. The benchmark's windows are a table; GROUP_BYTES of them at a time go to every task. Where they are more, the
documents are scanned once a group and carry what the groups before have found, each scan written to the shared folder; so neither
driver nor tasks hold more of a benchmark of any size, and the result is that of one scan.
"""

from __future__ import annotations

import hashlib
import re
import uuid

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import saved, written

WINDOW = 13
#: Bytes of window text that one automaton holds at most (a state a byte); larger benchmarks are scanned block after block.
BLOCK_BYTES = 4_000_000
#: Bytes of window text (some 13 times the benchmark's own) that driver and tasks hold at a time.
GROUP_BYTES = 48_000_000
#: Bytes of documents scanned with one block's automaton before the next block is loaded.
SCAN_BYTES = 32_000_000

_ASIS = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

RESULT = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans array<struct<start:int,end:int>>"
_TYPES = {"n_words": pa.int64(), "n_hit": pa.int64(), "n_items": pa.int64(), "items_sha256": pa.string(), "contaminated": pa.bool_(), "spans": pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))}


def words(text: bytes | None) -> list[bytes]:
    """Lower-cased words: digits, letters a-z and all beyond ASCII."""
    return (text or b"").translate(_ASIS).split()


def item_windows(text: bytes | None, size: int = WINDOW) -> set[bytes]:
    w = words(text)
    return {b" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def window_rows(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """One row a distinct window: its text and the items that hold it, in order."""

    def rows(batches):
        for b in batches:
            out = [(i, w) for i, t in zip(b["item_id"].to_pylist(), b["text"].to_pylist(), strict=True) for w in sorted(item_windows(t, size))]
            yield pa.RecordBatch.from_arrays([pa.array([x[1] for x in out], pa.binary()), pa.array([x[0] for x in out], pa.string())], ["window", "item"])

    pairs = benchmark.select(F.col("item_id").cast("string"), F.coalesce("text", F.lit("")).cast("binary").alias("text")).mapInArrow(rows, "window binary, item string")
    return pairs.groupBy("window").agg(F.sort_array(F.collect_set("item")).alias("items"))


def groups(benchmark: DataFrame, size: int = WINDOW, block_bytes: int = BLOCK_BYTES):
    """Lists of named broadcast blocks of (window, items): a block has about block_bytes of window text, a list GROUP_BYTES. The
    driver holds one list at a time; there is at least one, maybe empty."""
    sc, out, part, held, whole = benchmark.sparkSession.sparkContext, [], [], 0, 0
    for r in saved(window_rows(benchmark, size)).toLocalIterator():
        part.append((bytes(r["window"]), r["items"]))
        held += len(r["window"]) + 2
        if held >= block_bytes:
            out.append((uuid.uuid4().hex, sc.broadcast(part)))
            whole, part, held = whole + held, [], 0
            if whole >= GROUP_BYTES:
                yield out
                out, whole = [], 0
    yield [*out, (uuid.uuid4().hex, sc.broadcast(part))] if part else out


def automaton(windows: list[tuple[bytes, list[str]]]):
    a = ahocorasick.Automaton()
    for k, (w, _) in enumerate(windows):
        a.add_word(f" {w.decode('latin-1')} ", (k, w.count(b" ") + 1, len(w) + 2))
    a.make_automaton()
    return a


_BUILT: dict[str, tuple] = {}


def _automaton_of(block):
    name, windows = block
    if name not in _BUILT:  # a worker keeps the last one
        _BUILT.clear()
        _BUILT[name] = (automaton(windows.value), [items for _, items in windows.value])
    return _BUILT[name]


class _Seen:
    """What the scans have found in one document so far."""

    __slots__ = ("items", "line", "n_words", "runs")

    def __init__(self, text: bytes | None, found: dict | None = None):
        w = words(text)
        self.n_words, self.runs, self.items = len(w), [], set()
        if found:
            self.runs, self.items = [(x["s"], x["e"]) for x in found["runs"]], set(found["items"])
        self.line = f" {b' '.join(w).decode('latin-1')} " if w else ""

    def scan(self, built, items) -> None:
        found = list(built.iter(self.line)) if self.line else ()
        if found:
            spaces = np.flatnonzero(np.frombuffer(self.line.encode("latin-1"), np.uint8) == 32)
            first = np.searchsorted(spaces, [end - v[2] + 1 for end, v in found])
            self.runs += [(int(i), int(i) + v[1]) for i, (_, v) in zip(first, found, strict=True)]
            for k in {v[0] for _, v in found}:
                self.items.update(items[k])

    def merged(self) -> list[list[int]]:
        out: list[list[int]] = []
        for s, e in sorted(self.runs):
            if out and s <= out[-1][1]:
                out[-1][1] = max(e, out[-1][1])
            else:
                out.append([s, e])
        return out

    def found(self) -> dict:
        return {"runs": [{"s": s, "e": e} for s, e in self.merged()], "items": sorted(self.items)}

    def spans(self, text: bytes) -> tuple[int, list[dict]]:
        """Words inside any occurrence, and their runs as offsets into the original text (code points)."""
        if not self.runs:
            return 0, []
        merged = self.merged()
        at = [m.span() for m in _WORD.finditer(text.decode())]
        return sum(e - s for s, e in merged), [{"start": at[s][0], "end": at[e - 1][1]} for s, e in merged]


def _groups(batches):
    part, held = [], 0
    for b in batches:
        part.append(b)
        held += b.nbytes
        if held >= SCAN_BYTES:
            yield part
            part, held = [], 0
    if held:
        yield part


def _scanned(batch, parts: list) -> list[_Seen]:
    """What there is in each text of a batch (or group of batches), with what it carries; every block's automaton is loaded once for all of them."""
    texts = [t for b in batch for t in b["text"].to_pylist()]
    carried = [f for b in batch for f in (b["__found"].to_pylist() if "__found" in b.schema.names else [None] * len(b))]
    seen = [_Seen(t.encode() if isinstance(t, str) else t, f) for t, f in zip(texts, carried, strict=True)]
    for block in parts:
        built, items = _automaton_of(block)
        for s in seen:
            s.scan(built, items)
    return seen


def _judged(texts: list[bytes | None], seen: list[_Seen]) -> list[tuple]:
    """RESULT's columns of each text."""
    out = []
    for t, s in zip(texts, seen, strict=True):
        n, spans = s.spans(t or b"")
        out.append((s.n_words, n, len(s.items), hashlib.sha256(",".join(sorted(s.items)).encode()).hexdigest(), n > 0 and 20 * n >= s.n_words, spans))
    return out


_CARRIED = "struct<runs:array<struct<s:int,e:int>>,items:array<string>>"
_FOUND = pa.struct([("runs", pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))), ("items", pa.list_(pa.string()))])


def _but_last(docs: DataFrame, benchmark: DataFrame, size: int, block_bytes: int) -> tuple[DataFrame, list]:
    """docs with what all groups of the benchmark but the last have found in them, as __found where there is more than one, and the last group."""
    last = None
    for parts in groups(benchmark, size, block_bytes):
        if last is not None:
            docs = _carrying(docs, last)
        last = parts
    return docs, last


def _carrying(docs: DataFrame, parts: list) -> DataFrame:
    """docs, written, with __found after these blocks."""

    def rows(batches):
        for group in _groups(batches):
            for b in group:
                found = pa.array([s.found() for s in _scanned([b], parts)], _FOUND)
                own = [(n, b[n]) for n in b.schema.names if n != "__found"]
                yield pa.RecordBatch.from_arrays([*(c for _, c in own), found], [*(n for n, _ in own), "__found"])

    plain = docs.drop("__found")
    schema = T.StructType([*plain.schema.fields, T.StructField("__found", T._parse_datatype_string(_CARRIED))])
    out = written(docs.mapInArrow(rows, schema), "scanned")
    for _, block in parts:
        block.unpersist()
    return out


def scan(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document: words, words in occurrences of benchmark windows, items hit, contaminated or not, and the hit spans.

    Contaminated: any hit word and at least one hit word in 20. The documents are read once a group of windows, without a shuffle.
    """
    texts, parts = _but_last(docs.select("doc_id", F.col("text").cast("binary").alias("text")), benchmark, size, block_bytes)

    def rows(batches):
        for group in _groups(batches):
            got = _judged([t for b in group for t in b["text"].to_pylist()], _scanned(group, parts))
            ids = pa.concat_arrays([b["doc_id"] for b in group])
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, k) for c, k in zip(zip(*got, strict=True), _TYPES.values(), strict=True))], ["doc_id", *_TYPES])

    return texts.mapInArrow(rows, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {RESULT}")


def clean(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents, all columns, that are not contaminated."""
    carried, parts = _but_last(docs, benchmark, size, block_bytes)

    def rows(batches):
        for group in _groups(batches):
            for b in group:
                texts = [None if t is None else t.encode() for t in b["text"].to_pylist()]
                keep = pa.array([not g[4] for g in _judged(texts, _scanned([b], parts))], pa.bool_())
                yield b.select([n for n in b.schema.names if n != "__found"]).filter(keep)

    return carried.mapInArrow(rows, docs.schema)


def op2_decontaminate(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
