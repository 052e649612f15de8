"""Byte-level BPE by ranks as a tree of joins.

encode(left + right) is built from encode(left) and encode(right): only tokens near the
border can change. A window around the border is encoded anew and grown until the pairs of
tokens at its two edges are stable: a sequence of tokens is the encoding of its bytes exactly
if each pair of neighbours is the encoding of the pair's bytes. So halves are encoded
recursively and joined; the join is associative, with the empty sequence as its unit.
Decoding concatenates.

Each match of the pattern is encoded separately. A match that is itself a token is that token.
Null texts are empty: no ids. Repeated rows are encoded each; an empty table gives an empty one. A very long
match costs its own bytes and a list of its tokens; what a worker remembers is bounded in bytes. Extra columns
don't pass through encode. Bytes that decode to no valid text are kept as they are.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, map_arrow

# Bytes that are merged directly, pair stabilities that a worker remembers.
LEAF = 24
PAIRS = 400_000


class Ranks:
    """A rank table and the encoding monoid over it."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.stable: dict[int, bool] = {}

    def merge(self, data: bytes) -> list[int]:
        """Merge the neighbours whose union has the lowest rank, the leftmost first, until none has one."""
        if len(data) > 2 * LEAF:
            return self._merge_long(data)
        rank, cuts = self.ranks.get, list(range(len(data) + 1))
        none = len(self.tokens)
        pair = [rank(data[i : i + 2], none) for i in range(len(data) - 1)]
        while pair and (low := min(pair)) < none:
            at = pair.index(low)
            del cuts[at + 1], pair[at]
            if at < len(pair):
                pair[at] = rank(data[cuts[at] : cuts[at + 2]], none)
            if at:
                pair[at - 1] = rank(data[cuts[at - 1] : cuts[at + 1]], none)
        return [self.ranks[data[a:b]] for a, b in zip(cuts, cuts[1:], strict=False)]

    def _merge_long(self, data: bytes) -> list[int]:
        n, rank = len(data), self.ranks.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        alive = [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank(data[i : i + 2])) is not None]
        heapify(heap)
        while heap:
            _, i, end = heappop(heap)
            if not alive[i] or after[i] >= n or after[after[i]] != end:
                continue
            alive[after[i]] = False
            after[i] = end
            if end < n:
                before[end] = i
                if (r := rank(data[i : after[end]])) is not None:
                    heappush(heap, (r, i, after[end]))
            if before[i] >= 0 and (r := rank(data[before[i] : end])) is not None:
                heappush(heap, (r, before[i], end))
        out, i = [], 0
        while i < n:
            out.append(self.ranks[data[i : after[i]]])
            i = after[i]
        return out

    def holds(self, a: int, b: int) -> bool:
        """Two tokens that stay as they are side by side."""
        key = a * len(self.tokens) + b
        known = self.stable.get(key)
        if known is None:
            if len(self.stable) >= PAIRS:
                self.stable.clear()
            known = self.stable[key] = self.merge(self.tokens[a] + self.tokens[b]) == [a, b]
        return known

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of two encodings' bytes side by side."""
        if not left or not right or self.holds(left[-1], right[0]):
            return left + right
        a = b = 1
        while True:
            window = self.merge(self.decode(left[len(left) - a :] + right[:b]))
            lower = a == len(left) or self.holds(left[len(left) - a - 1], window[0])
            upper = b == len(right) or self.holds(window[-1], right[b])
            if lower and upper:
                return left[: len(left) - a] + window + right[b:]
            if not lower:
                a = min(2 * a, len(left))
            if not upper:
                b = min(2 * b, len(right))

    def tree(self, data: bytes) -> list[int]:
        if len(data) <= LEAF:
            return self.merge(data)
        half = len(data) // 2
        return self.join(self.tree(data[:half]), self.tree(data[half:]))

    def encode(self, match: bytes) -> list[int]:
        whole = self.ranks.get(match)
        return self.tree(match) if whole is None else [whole]

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


class TextBpe:
    """Whole texts by a rank file and a pattern; equal units are encoded once per worker."""

    def __init__(self, path: str, pattern: str):
        import regex

        from .units import Spaced, UnitCache

        with open(path, "rb") as f:
            self.bpe = Ranks({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)})
        self.find = regex.compile(pattern).findall
        self.matches = UnitCache(lambda found: [np.array(self.bpe.encode(m.encode()), "<i4").tobytes() for m in found])
        self.spaced = Spaced(self.by_matches)

    def by_matches(self, units: list[str]) -> list[bytes]:
        found = [self.find(u) for u in units]
        ids, at, out = self.matches.of([m for f in found for m in f]), 0, []
        for f in found:
            out.append(ids[at] if len(f) == 1 else b"".join(ids[at : at + len(f)]))
            at += len(f)
        return out

    def ids(self, text: str) -> bytes:
        return b"".join(self.matches.of(self.find(text)))

    def __call__(self, text: str) -> bytes:
        from .units import odd

        return self.ids(text) if odd(text) else self.spaced(text)


@lru_cache(maxsize=2)
def _text_bpe(path: str, pattern: str) -> TextBpe:
    return TextBpe(path, pattern)


@lru_cache(maxsize=2)
def _tokens(path: str) -> list[bytes]:
    """A rank file's tokens by rank: all that decoding needs."""
    with open(path, "rb") as f:
        by_rank = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, f)}
    return [by_rank.get(r, b"") for r in range(max(by_rank) + 1)]


def encode(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """(id, ids array<int>) of every text; ``ranks`` is a rank file that every worker can read.

    With ``decoded``, the ids are decoded again in the same pass, into a column ``decoded``.
    ``pattern`` must treat ASCII white space as the usual patterns do: one space goes with
    the word after it, longer runs are matches of their own.
    """
    from .units import binary_column, blocks

    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _text_bpe(ranks, pattern)
        for batch in blocks(batches, "_text"):
            parts = [bpe(t) for t in batch.column("_text").to_pylist()]
            ends = np.concatenate([[0], np.cumsum([len(p) // 4 for p in parts])]).astype(np.int32)
            out = {"_id": batch.column("_id"), "ids": pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(parts), "<i4")))}
            if decoded:
                out["decoded"] = binary_column([bpe.bpe.decode(np.frombuffer(p, "<i4").tolist()) for p in parts])
            yield pa.RecordBatch.from_pydict(out)

    schema = f"_id {kind}, ids array<int>" + (", decoded binary" if decoded else "")
    return map_arrow(rows, run, schema, caches=True).withColumnRenamed("_id", id_col)


def decode(encoded: DataFrame, ranks: str, ids_col: str = "ids") -> DataFrame:
    """The input's columns and ``decoded`` binary: the tokens' bytes, concatenated. A column of that name gives way to ``decoded_``."""
    from .units import binary_column

    columns, name = encoded.columns, free_name(encoded, "decoded")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = _tokens(ranks).__getitem__
        for batch in batches:
            for lo in range(0, len(batch), 256):
                some = batch.slice(lo, 256)
                ids = some.column(ids_col)
                flat, ends = ids.flatten().to_numpy(), (np.array(ids.offsets) - ids.offsets[0].as_py()).tolist()
                data = [b"".join(map(token, flat[a:b].tolist())) for a, b in zip(ends, ends[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([*some.columns, binary_column(data)], [*columns, name])

    schema = ", ".join(f"`{c}` {t}" for c, t in encoded.dtypes)
    return map_arrow(encoded, run, f"{schema}, {name} binary")
