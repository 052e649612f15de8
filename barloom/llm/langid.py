"""Language identification by hyperdimensional profiles.

Every letter has a random vector of DIMENSIONS signs, drawn from its code point, so all workers
agree without sharing a table; what is not a letter is one blank. A gram of three neighbouring
symbols is bound from their vectors, each permuted by its place: rotate(rotate(x)) * rotate(y) * z.
A text bundles its grams: the sum of their vectors. A language bundles its texts, each scaled to
one length so that no long text drowns the others. A text gets the language whose prototype
has the highest cosine with it.

Both bundles are exact: texts are sums of integers, and prototypes add up rounded integers,
so neither order nor partitioning changes a result. Only prototypes are broadcast: one vector per
language, LANGUAGES at most; more than that raise a ValueError.

Null texts and texts without a letter are ``und`` with a score of zero, and so is every text if
nothing was learned; they teach nothing. Of prototypes with the same cosine the first language in
order wins. Repeated rows count each, in learning and as results. Very long texts are worked
through in slices of grams and take memory in proportion to their own length. An empty table
gives an empty result. Columns other than the id don't pass through, so their names can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

DIMENSIONS = 1024
LANGUAGES = 8192
# A text's vector in a prototype's sum, in units.
SCALE = 1_000_000
# A prototype's whole numbers in one.
UNIT = 1 << 20
# Bytes of text at once, distinct grams bound at once, letters whose vectors a worker remembers, partial prototypes a task holds.
BLOCK, GRAMS, LETTERS, HELD = 1 << 20, 4096, 4096, 512


@lru_cache(maxsize=1)
def letter_table() -> np.ndarray:
    """Which code points are letters."""
    return np.array([chr(c).isalpha() for c in range(0x110000)])


@lru_cache(maxsize=LETTERS)
def letter_vector(symbol: int, dimensions: int) -> np.ndarray:
    """The signs of a letter, or of the blank (0)."""
    bits = np.random.PCG64([symbol, dimensions]).random_raw(-(-dimensions // 64)).astype("<u8").view(np.uint8)
    return 2 * np.unpackbits(bits)[:dimensions].astype(np.int8) - 1


def grams_of(text: str) -> np.ndarray:
    """The text's grams as keys of three symbols; runs of other characters are one blank, as are both ends. Empty without a letter."""
    symbols = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    symbols = np.concatenate([[0], np.where(letter_table()[symbols], symbols, 0), [0]])
    symbols = symbols[np.concatenate([[True], (symbols[1:] != 0) | (symbols[:-1] != 0)])]
    return (symbols[:-2] << 42) | (symbols[1:-1] << 21) | symbols[2:]


def bind(grams: np.ndarray, dimensions: int) -> np.ndarray:
    """The vectors of distinct grams, as rows."""
    parts = np.stack([grams >> 42, grams >> 21 & 0x1FFFFF, grams & 0x1FFFFF])
    symbols, where = np.unique(parts, return_inverse=True)
    x, y, z = where.reshape(parts.shape)
    letters = np.stack([letter_vector(s, dimensions) for s in symbols.tolist()])
    return np.roll(letters, 2, axis=1)[x] * np.roll(letters, 1, axis=1)[y] * letters[z]


def bundle(texts: list[str], dimensions: int) -> np.ndarray:
    """A row per text: the sum of its grams' vectors, zero without a letter."""
    grams = [grams_of(t) for t in texts]
    out = np.zeros((len(texts), dimensions))
    flat, text = np.concatenate(grams), np.repeat(np.arange(len(texts)), [len(g) for g in grams])
    distinct, gram = np.unique(flat, return_inverse=True)
    cell, counts = np.unique(gram * len(texts) + text, return_counts=True)
    gram, text = np.divmod(cell, len(texts))
    for lo in range(0, len(distinct), GRAMS):
        a, b = np.searchsorted(gram, (lo, lo + GRAMS))
        vectors = bind(distinct[lo : lo + GRAMS], dimensions)
        own, row = np.unique(text[a:b], return_inverse=True)
        # Counts of a block fit 32-bit floats exactly, and so do sums of them below 2^24.
        kind = np.float32 if counts[a:b].sum() < 1 << 24 else np.float64
        for first in range(0, len(own), 256):
            some = (row >= first) & (row < first + 256)
            table = np.zeros((min(256, len(own) - first), len(vectors)), kind)
            table[row[some] - first, gram[a:b][some] - lo] = counts[a:b][some]
            out[own[first : first + 256]] += table @ vectors.astype(kind)
    return out


def lengths(rows: np.ndarray) -> np.ndarray:
    return np.sqrt(np.einsum("ij,ij->i", rows, rows))


def prototypes(docs: DataFrame, training: Column, lang_col: str = "lang", text_col: str = "text", dimensions: int = DIMENSIONS) -> tuple[list[str], np.ndarray]:
    """Languages in order and their bundles as rows of length one, learned from the rows that ``training`` marks and that have a language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .units import blocks

        def flush():
            rows = pa.array(np.concatenate(list(held.values())) if held else np.zeros(0, np.int64))
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.ListArray.from_arrays(pa.array(np.arange(len(held) + 1, dtype=np.int32) * dimensions), rows)], ["lang", "sums"])

        held: dict[str, np.ndarray] = {}
        for batch in blocks(batches, "text", BLOCK):
            rows = bundle(batch.column("text").to_pylist(), dimensions)
            size = lengths(rows)
            units = np.rint(rows * (SCALE / np.where(size > 0, size, 1))[:, None]).astype(np.int64)
            for name, unit in zip(batch.column("lang").to_pylist(), units, strict=True):
                if name in held:
                    held[name] += unit
                else:
                    held[name] = unit.copy()
            if len(held) > HELD:
                yield flush()
                held.clear()
        yield flush()

    rows = docs.filter(training & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    partial = map_arrow(rows, run, "lang string, sums array<bigint>")
    summed = partial.select("lang", F.posexplode("sums").alias("i", "v")).groupBy("lang", "i").agg(F.sum("v").alias("v"))
    vectors = summed.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("i", "v"))).alias("row"))
    learned = vectors.select("lang", F.col("row.v").alias("v")).limit(LANGUAGES + 1).toArrow().sort_by("lang")
    if len(learned) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    names = learned["lang"].to_pylist()
    table = np.array(learned["v"].to_pylist(), float).reshape(len(names), dimensions)
    size = lengths(table)
    table /= np.where(size > 0, size, 1)[:, None]
    taught = size > 0
    return [n for n, t in zip(names, taught, strict=True) if t], table[taught]


def identify(docs: DataFrame, training: Column, id_col: str = "doc_id", lang_col: str = "lang", text_col: str = "text", dimensions: int = DIMENSIONS) -> DataFrame:
    """(id, training, lang_pred, score) of every document; score is the cosine with the language's prototype, zero if that is negative."""
    kind = dict(docs.dtypes)[id_col]
    names, table = prototypes(docs, training, lang_col, text_col, dimensions)
    sent = docs.sparkSession.sparkContext.broadcast((names, table))
    rows = docs.select(F.col(id_col).alias("_id"), training.alias("training"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .units import blocks

        names, table = sent.value
        # In two parts of whole numbers: their products are exact, so which rows share a block changes no digit.
        high = np.rint(table * UNIT)
        low = np.rint((table * UNIT - high) * UNIT)
        for batch in blocks(batches, "_text", BLOCK):
            own = bundle(batch.column("_text").to_pylist(), dimensions)
            size = lengths(own)
            pred, score = np.full(len(own), "und", object), np.zeros(len(own))
            if names:
                cosine = (own @ high.T + own @ low.T / UNIT) / UNIT / np.where(size > 0, size, 1)[:, None]
                best = cosine.argmax(axis=1)
                pred = np.where(size > 0, np.array(names, object)[best], "und")
                score = np.where(size > 0, cosine[np.arange(len(own)), best].clip(0, 1), 0.0)
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("training"), pa.array(pred, pa.string()), pa.array(score)], ["_id", "training", "lang_pred", "score"])

    return map_arrow(rows, run, f"_id {kind}, training boolean, lang_pred string, score double").withColumnRenamed("_id", id_col)
