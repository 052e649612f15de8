"""Cost-balanced packing of documents into training sequences.

A document of n tokens costs n + n * n / length (linear layers and its own attention).
Full sequences are cut off long documents first. What is left is dealt, in descending
order, to the sequence of the lowest cost that has room; if none has, the lowest-cost
open sequence takes the head and the rest is dealt again.

Each task packs windows of its own rows, so nothing is shuffled, memory is bounded by
a window and a lost task is simply run again. A window has exactly as many tokens as its
sequences hold: all are full but the last, which is split into powers of two.

Null texts are empty: they hold the end token only. Repeated rows are packed once each.
Ties go to the earlier row. Empty tables give no pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

# Sequences that are filled together.
WINDOW_SEQUENCES = 256


def plan(lengths: np.ndarray, length: int = 4096, quadratic: float = 1.0) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, tokens, sequence, offset) of one window, gapless from 0 in each sequence."""
    pieces, sequences = [], 0
    for doc in np.flatnonzero(lengths >= length):
        for k in range(int(lengths[doc]) // length):
            pieces.append((int(doc), k * length, length, sequences, 0))
            sequences += 1
    rest = lengths % length
    total = int(rest.sum())
    if not total:
        return pieces
    count = -(-total // length)
    size = np.full(count, length, np.int64)
    size[-1] = total - (count - 1) * length
    room, cost = size.copy(), np.zeros(count)
    for doc in np.argsort(-rest, kind="stable"):
        left, start = int(rest[doc]), int(lengths[doc] - rest[doc])
        while left:
            fits = room >= left
            at = int(np.where(fits, cost, np.inf).argmin()) if fits.any() else int(np.where(room > 0, cost, np.inf).argmin())
            n = min(left, int(room[at]))
            pieces += _split(int(doc), start, n, sequences + at, int(size[at] - room[at]), at == count - 1, int(size[at]), sequences + count - 1)
            room[at] -= n
            cost[at] += n + quadratic * n * n / length
            start, left = start + n, left - n
    return pieces


def _split(doc, start, n, seq, offset, last, size, base):
    """Cut a piece of the window's last sequence at the borders of its power-of-two parts."""
    if not last:
        return [(doc, start, n, seq, offset)]
    out, begin, part = [], 0, 0
    for bit in reversed(range(size.bit_length())):
        if size >> bit & 1:
            end = begin + (1 << bit)
            lo, hi = max(offset, begin), min(offset + n, end)
            if lo < hi:
                out.append((doc, start + lo - offset, hi - lo, base + part, lo - begin))
            begin, part = end, part + 1
    return out


def pack(docs: DataFrame, tokenizer: str, end_id: int, length: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: (id, start, length, doc_tokens, sequence_id, offset, ids).

    ``ids`` are the piece's token ids as little-endian unsigned 32-bit integers;
    ``tokenizer`` is the path of a tokenizers file that every worker can read.
    """
    kind = dict(docs.dtypes)[id_col]
    schema = f"_id {kind}, start bigint, length bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary"
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from .units import binary_column, blocks, text_encoder

        encode, end = text_encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        base = TaskContext.get().partitionId() << 33
        keys, held, tokens = [], [], 0

        def flush():
            nonlocal keys, held, tokens, base
            lengths = np.array([len(x) // 4 for x in held], np.int64)
            p = np.array(plan(lengths, length), np.int64).reshape(-1, 5)
            ids = [held[d][4 * s : 4 * (s + n)] for d, s, n in p[:, :3].tolist()]
            keyed = pa.concat_arrays(keys).take(pa.array(p[:, 0]))
            cols = [keyed, p[:, 1], p[:, 2], lengths[p[:, 0]], p[:, 3] + base, p[:, 4], binary_column(ids)]
            out = pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in cols], ["_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])
            base += int(p[:, 3].max()) + 1 if len(p) else 0
            keys, held, tokens = [], [], 0
            return out

        for batch in blocks(batches, "_text"):
            keys.append(batch.column("_id"))
            texts = batch.column("_text").to_pylist()
            cut = 0
            for i, text in enumerate(texts):
                held.append(encode(text) + end)
                tokens += len(held[-1]) // 4
                if tokens >= WINDOW_SEQUENCES * length:
                    keys[-1] = batch.column("_id").slice(cut, i + 1 - cut)
                    cut = i + 1
                    yield flush()
                    keys.append(batch.column("_id").slice(cut))
        if held:
            yield flush()

    return map_arrow(rows, run, schema, caches=True).withColumnRenamed("_id", id_col)
