"""Token counts by two tiers of lookups, without encoding what was encoded before.

Texts fall into pre-tokens: a run of spaces and the word after it. Where no piece of the
vocabulary holds a space after another character, merges never cross from one pre-token
to the next, so a text's count is the sum of theirs.

Tier one is a compact table (texts and one array of lengths) of the most frequent
pre-tokens, at most FREQUENT of them, broadcast once. Tier two is each worker's cache, which
encodes a miss once. No pre-token of the corpus is shuffled. What tier one holds comes from
the tasks' own bounded summaries of all rows (at most SUMMARY entries per task); it decides how
fast a count is found, never what it is.

Null texts are empty and have no tokens. Repeated rows are counted each. Texts that
hold the library's own space sign are given to it whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

FREQUENT = 65_536
SUMMARY = 4_096
# A summary is cut to half this many entries when it grows over it, least frequent first.
SUMMARY_HELD = 200_000
LONGEST = 64

UNIT = re.compile(r" +[^ ]*")
SPACE_SIGN = "▁"


@lru_cache(maxsize=2)
def _model(path: str):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    inner = [p for p in map(model.id_to_piece, range(model.get_piece_size())) if SPACE_SIGN in p.lstrip(SPACE_SIGN)]
    return model, not inner


class Lengths:
    """Token counts of texts; frequent pre-tokens are given, others are encoded once per worker."""

    def __init__(self, path: str, frequent: tuple[str, bytes] = ("", b"")):
        from .units import UnitCache

        self.model, self.splits = _model(path)
        self.cache = UnitCache(self.encode)
        self.first = {" ": 1}
        if frequent[0]:
            self.first.update(zip(frequent[0].split("\0"), np.frombuffer(frequent[1], "<u2").tolist(), strict=True))

    def encode(self, units: list[str]) -> list[int]:
        # The library puts a space before a text itself.
        return [len(x) for x in self.model.encode([u[1:] for u in units], num_threads=1)]

    def __call__(self, text: str) -> int:
        if not text:
            return 0
        if not self.splits or SPACE_SIGN in text:
            return len(self.model.encode(text))
        found = list(map(self.first.get, units := UNIT.findall(" " + text)))
        if (n := found.count(None)) == 0:
            return sum(found)
        missed = [u for u, f in zip(units, found, strict=True) if f is None]
        return sum(filter(None, found)) + sum(self.cache.of(missed)) if n < len(found) else sum(self.cache.of(missed))


@lru_cache(maxsize=2)
def _lengths(path: str, key: str, frequent) -> Lengths:
    return Lengths(path, frequent.value)


def frequent_units(docs: DataFrame, model: str, text_col: str = "text", most: int = FREQUENT) -> tuple[str, bytes]:
    """(pre-tokens joined by NUL, their token counts as unsigned 16-bit integers)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .units import blocks

        seen: Counter = Counter()
        for batch in blocks(batches, "_text"):
            for text in batch.column("_text").to_pylist():
                seen.update(UNIT.findall(" " + text))
            if len(seen) > SUMMARY_HELD:
                seen = Counter(dict(seen.most_common(SUMMARY_HELD // 2)))
        top = [(u, n) for u, n in seen.most_common(SUMMARY) if len(u) <= LONGEST and "\0" not in u and u != " "]
        yield pa.RecordBatch.from_pydict({"unit": [u for u, _ in top], "n": [n for _, n in top]}, pa.schema([("unit", pa.string()), ("n", pa.int64())]))

    texts = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    best = map_arrow(texts, run, "unit string, n bigint").groupBy("unit").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "unit").limit(most)
    units = [r.unit for r in best.select("unit").collect()]
    return "\0".join(units), np.array(Lengths(model).encode(units), "<u2").tobytes() if units else b""


def count(docs: DataFrame, model: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every document by the sentencepiece file at ``model``."""
    import uuid

    kind, key = dict(docs.dtypes)[id_col], uuid.uuid4().hex
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_units(docs, model, text_col))
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .units import blocks

        lengths = _lengths(model, key, frequent)
        for batch in blocks(batches, "_text"):
            texts = batch.column("_text")
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), pc.binary_length(texts).cast(pa.int64()), pa.array([lengths(t) for t in texts.to_pylist()], pa.int64())],
                ["_id", "n_bytes", "n_tokens"])

    out = map_arrow(rows, run, f"_id {kind}, n_bytes bigint, n_tokens bigint", caches=True)
    return out.select(F.col("_id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
