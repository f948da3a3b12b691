"""Cost-balanced packing of token sequences.

A piece of n ids costs LINEAR * n + QUADRATIC * n * n (attention is quadratic inside a piece). Pieces go, longest first,
to the lowest-cost sequence with room for them; one that fits nowhere is cut where the roomiest sequence ends. Each task
packs its own documents block by block, so nothing is shuffled, and every block but for its last sequence is full.

Null and empty texts are one id (the end); repeated rows are packed as often as they come; ties go by position in the
block, then to the sequence made first; null doc_ids stay null; extra columns, whatever their names, are ignored; an empty
table gives no rows. Texts are encoded whole and cut freely: a very long one fills sequences of its own.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .tokens import BYTE_BPE, MEMO, encoder, tokenizer_path

CAPACITY, LINEAR, QUADRATIC = 1024, 1.0, 1.0 / 1024
#: Ids that one block holds before it is packed.
BLOCK_IDS = 4_000_000
SCHEMA = "doc_id {0}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, cost double"


def assign(lengths: list[int], capacity: int = CAPACITY, linear: float = LINEAR, quadratic: float = QUADRATIC) -> list[tuple[int, int, int, int, int]]:
    """(item, start, length, sequence, offset) of every piece of items of the given lengths."""
    out, todo, n_full = [], [], 0
    for k, n in enumerate(lengths):
        whole = n // capacity
        for j in range(whole):
            out.append((k, j * capacity, capacity, n_full, 0))
            n_full += 1
        if n % capacity:
            todo.append((-(n % capacity), k, whole * capacity))
    if not todo:
        return out
    n_open = -(-sum(-x[0] for x in todo) // capacity)
    cost, room = np.zeros(n_open), np.full(n_open, capacity)
    heapq.heapify(todo)
    while todo:
        n, k, start = heapq.heappop(todo)
        n = -n
        fits = np.where(room >= n, cost, np.inf)
        s = int(fits.argmin())
        if fits[s] == np.inf:
            s = int(room.argmax())
            heapq.heappush(todo, (-(n - int(room[s])), k, start + int(room[s])))
            n = int(room[s])
        out.append((k, start, n, n_full + s, capacity - int(room[s])))
        room[s] -= n
        cost[s] += linear * n + quadratic * n * n
    return out


def pack_documents(docs: DataFrame, path: str | None = None, end_id: int = 0, capacity: int = CAPACITY, memo: int = MEMO) -> DataFrame:
    """One row a piece: document, place in it, CRC-32 of its ids, sequence, offset there, and its cost.

    memo: text pieces whose ids a worker remembers (twice as many at most).
    """
    path = path or tokenizer_path(BYTE_BPE)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def packed(ids, tokens, first):
        sizes = [len(t) for t in tokens]
        got = assign(sizes, capacity)
        n = len({g[3] for g in got})
        seq = first + np.array([g[3] for g in got], np.int64)
        crc = [zlib.crc32(tokens[k][s : s + m].tobytes()) for k, s, m, _, _ in got]
        cost = [LINEAR * m + QUADRATIC * m * m for _, _, m, _, _ in got]
        arrays = [pa.array([ids[g[0]] for g in got]).cast(arrow), pa.array([g[1] for g in got], pa.int64()), pa.array([g[2] for g in got], pa.int64()), pa.array(crc, pa.int64()), pa.array([sizes[g[0]] for g in got], pa.int64()), pa.array(seq), pa.array([g[4] for g in got], pa.int64()), pa.array(cost, pa.float64())]
        return n, pa.RecordBatch.from_arrays(arrays, names)

    from pyspark.sql.pandas.types import to_arrow_type

    arrow = to_arrow_type(docs.schema["doc_id"].dataType)
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "cost"]

    def rows(batches):
        from pyspark import TaskContext

        end, first = np.array([end_id], np.uint32), TaskContext.get().partitionId() << 40
        ids, tokens, held = [], [], 0
        for b in batches:
            texts = b["text"].to_pylist()
            for k in range(0, len(texts), 256):
                new = [np.concatenate([t, end]) for t in encoder(path, memo).encode(texts[k : k + 256])]
                ids += b["doc_id"].slice(k, 256).to_pylist()
                tokens += new
                held += sum(map(len, new))
                if held >= BLOCK_IDS:
                    n, out = packed(ids, tokens, first)
                    yield out
                    ids, tokens, held, first = [], [], 0, first + n
        if ids:
            yield packed(ids, tokens, first)[1]

    return docs.select("doc_id", "text").mapInArrow(rows, SCHEMA.format(kind))


def op4_pack(spark, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), memo=600_000)
