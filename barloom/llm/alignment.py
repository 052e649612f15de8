"""Where two tokenizers cut the same text, and how often their tokens lie over each other.

Exact-text deduplication: documents are shuffled by their full text, each distinct text is
tokenised and aligned once, and the corpus-wide count of a pair of ids is the number of
documents that hold it linked, a text's pairs weighted by its copies. Measures go back to all
documents of a text.

Both tokenizers must give back the bytes of a space and the text. Then the ends of their tokens
are positions on one line of bytes: every stretch between two neighbouring ends lies in one
token of each side and is one link; places where both end close a group.

The measures over counts take two tiers. Pairs that hold more than one in FREQUENT of all
(pair, document) incidences, so at most FREQUENT of them, are broadcast; the others of a text are joined by
pair, which can't be a hot key. Both are exact.

Null and empty texts, and texts whose tokens don't give their bytes back, have no tokens: all
numbers are zero and ``groups`` is empty. Repeated rows get a row each. Very long texts take
memory in proportion to their own length. An empty table gives an empty result. Columns other
than the id don't pass through, so their names can't clash. All ties count as best.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import map_arrow, spread_join

FREQUENT = 1 << 20
# Texts of a written table that are worked on at once, distinct pairs held before they are passed on.
ROWS = 256
HELD = 1 << 21

MEASURES = ("n_a", "n_b", "n_groups", "n_links")
ALIGNED = "_key binary, _copies bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, a array<int>, b array<int>, times array<int>"


class Side:
    """A tokenizer's ids of whole texts, and its tokens as bytes."""

    def __init__(self, tokens: list[bytes], encode):
        self.tokens, self.encode = tokens, encode
        self.sizes = np.array([len(t) for t in tokens], np.int64)

    def holds(self, ids: bytes, data: bytes) -> bool:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist())) == data


@lru_cache(maxsize=2)
def byte_level(path: str) -> Side:
    """A byte-level .json file; it is given the space before the text. Its special strings are plain text."""
    from .units import TextEncoder, byte_alphabet

    encoder = TextEncoder(path, plain=True)
    hidden = {c: b for b, c in byte_alphabet().items()}
    tokens = [b""] * encoder.vocab_size
    for token, i in encoder.tok.get_vocab().items():
        tokens[i] = bytes(hidden.get(ord(c), ord(c) & 255) for c in token)
    return Side(tokens, lambda text: encoder(" " + text))


@lru_cache(maxsize=2)
def pieces(path: str) -> Side:
    """A sentencepiece .model file, which puts the space before a text itself. Merges don't cross from a run of spaces and its word to the next."""
    from .tokencount import SPACE_SIGN, UNIT, _model
    from .units import UnitCache

    model, splits = _model(path)
    shown = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    tokens = [bytes([int(p[3:-1], 16)]) if model.is_byte(i) else p.replace(SPACE_SIGN, " ").encode() for i, p in enumerate(shown)]
    pack = lambda ids: np.array(ids, "<u4").tobytes()
    alone = pack([model.piece_to_id(SPACE_SIGN)])
    cache = UnitCache(lambda units: [pack(x) if u != " " else alone for u, x in zip(units, model.encode([u[1:] for u in units], num_threads=1), strict=True)])

    def encode(text: str) -> bytes:
        if not splits or SPACE_SIGN in text:
            return pack(model.encode(text))
        return b"".join(cache.of(UNIT.findall(" " + text)))

    return Side(tokens, encode)


@lru_cache(maxsize=1)
def _marks(n_a: int, n_b: int) -> list[str]:
    """A-ids before a comma or a bar, B-ids before a comma or a semicolon."""
    return [f"{i}{m}" for i in range(n_a) for m in ",|"] + [f"{i}{m}" for i in range(n_b) for m in ",;"]


def align(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, left: Side, right: Side) -> dict[str, list | np.ndarray]:
    """Texts side by side: flat ids and ids per text; both sides of a text have the same bytes, one at least."""
    many, all_a, all_b = len(n_a), len(left.tokens), len(right.tokens)
    end_a, end_b = np.cumsum(left.sizes[a]), np.cumsum(right.sizes[b])
    stops = end_a[np.cumsum(n_a) - 1]
    at_a, at_b = np.zeros(stops[-1] + 1, bool), np.zeros(stops[-1] + 1, bool)
    at_a[end_a] = at_b[end_b] = True
    ends = np.flatnonzero(at_a | at_b)
    at_a, at_b = at_a[ends], at_b[ends]
    both = at_a & at_b
    upto_a, upto_b, group = np.cumsum(at_a), np.cumsum(at_b), np.cumsum(both)
    text = np.searchsorted(stops, ends)
    link = (text * all_a + a[upto_a - at_a]) * all_b + b[upto_b - at_b]
    distinct, times = np.unique(link, return_counts=True)
    pair_text, pair = np.divmod(distinct, all_a * all_b)
    # Each token's place in the text form: own tokens before it, and the other side's of the groups before (A) or up to its own (B).
    closing = np.flatnonzero(both)
    b_before = np.concatenate([[0], upto_b[closing]])
    out = np.empty(len(a) + len(b), np.int64)
    last_a, last_b = np.flatnonzero(at_a), np.flatnonzero(at_b)
    out[np.arange(len(a)) + b_before[group[last_a] - both[last_a]]] = 2 * a + both[last_a]
    out[np.arange(len(b)) + upto_a[closing][group[last_b] - both[last_b]]] = 2 * (all_a + b) + both[last_b]
    shown, marks = np.concatenate([[0], np.cumsum(n_a + n_b)]).tolist(), _marks(all_a, all_b).__getitem__
    return {
        "n_groups": np.bincount(text[closing], minlength=many), "n_links": np.bincount(text, minlength=many),
        "groups": [hashlib.sha256("".join(map(marks, out[x:y].tolist()))[:-1].encode()).hexdigest() for x, y in zip(shown, shown[1:], strict=False)],
        "pairs": np.bincount(pair_text, minlength=many), "a": pair // all_b, "b": pair % all_b, "times": times,
    }


def lists(values: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(values.astype(np.int32)))


def aligned_texts(docs: DataFrame, a: str, b: str, text_col: str = "text") -> DataFrame:
    """One written row per distinct text: digest, copies, measures, and each linked pair of ids with how often it is linked there."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    distinct = docs.groupBy(text.alias("_text")).agg(F.count("*").alias("_copies"))
    rows = distinct.select(F.unhex(F.sha2("_text", 256)).alias("_key"), "_copies", "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .units import blocks

        left, right = byte_level(a), pieces(b)
        for batch in blocks(batches, "_text", 1 << 20):
            own, texts = [], batch.column("_text").to_pylist()
            for i, t in enumerate(texts):
                x, y, data = left.encode(t), right.encode(t), (" " + t).encode()
                if t and left.holds(x, data) and right.holds(y, data):
                    own.append((i, x, y))
            n = {m: np.zeros(len(texts), np.int64) for m in (*MEASURES, "pairs")}
            groups, flat = [""] * len(texts), {m: np.zeros(0, np.int64) for m in ("a", "b", "times")}
            if own:
                at = [i for i, _, _ in own]
                x, y = (np.frombuffer(b"".join(o[k] for o in own), "<u4").astype(np.int64) for k in (1, 2))
                n["n_a"][at], n["n_b"][at] = ([len(o[k]) // 4 for o in own] for k in (1, 2))
                found = align(x, y, n["n_a"][at], n["n_b"][at], left, right)
                for m in ("n_groups", "n_links", "pairs"):
                    n[m][at] = found[m]
                for i, g in zip(at, found["groups"], strict=True):
                    groups[i] = g
                flat = {m: found[m] for m in flat}
            yield pa.RecordBatch.from_arrays(
                [batch.column("_key"), batch.column("_copies"), *[pa.array(n[m]) for m in MEASURES], pa.array(groups, pa.string()),
                 *[lists(flat[m], n["pairs"]) for m in flat]],
                ["_key", "_copies", *MEASURES, "groups_sha256", *flat])

    return materialize(map_arrow(rows, run, ALIGNED, caches=True), "aligned")


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, list[np.ndarray]]]:
    """Some rows at once, their pairs' offsets, and the flat lists a, b and times."""
    for batch in batches:
        for lo in range(0, len(batch), ROWS):
            some = batch.slice(lo, ROWS)
            ends = np.array(some.column("a").offsets).astype(np.int64)
            yield some, ends - ends[0], [some.column(c).flatten().to_numpy().astype(np.int64) for c in ("a", "b", "times")]


def pair_counts(aligned: DataFrame, wide: int) -> DataFrame:
    """(pair, n): documents that hold a pair linked; pair = a * wide + b. Tasks add up their own texts first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        new, fresh = [keys], 0

        def merged():
            order, where = np.unique(np.concatenate(new), return_inverse=True)
            total = np.zeros(len(order), np.int64)
            np.add.at(total, where, np.concatenate(weights))
            return order, total

        weights = [counts]
        for some, ends, (a, b, _) in _slices(batches):
            new.append(a * wide + b)
            weights.append(np.repeat(some.column("_copies").to_numpy(), np.diff(ends)))
            fresh += len(a)
            if fresh > HELD:
                keys, counts = merged()
                if len(keys) > HELD:
                    yield pa.RecordBatch.from_pydict({"pair": keys, "n": counts})
                    keys, counts = keys[:0], counts[:0]
                new, weights, fresh = [keys], [counts], 0
        keys, counts = merged()
        yield pa.RecordBatch.from_pydict({"pair": keys, "n": counts})

    return map_arrow(aligned.select("_copies", "a", "b", F.col("a").alias("times")), run, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))


def cross_align(docs: DataFrame, a: str, b: str, id_col: str = "doc_id", text_col: str = "text", frequent: int = FREQUENT) -> DataFrame:
    """Per document: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    ``a`` is a byte-level tokenizers file, ``b`` a sentencepiece file, both at the same place on every worker. ``n_best``: links
    whose pair has the highest count of all pairs with its A-id; ``count_sum``: the links' pair counts added up.
    """
    spark = docs.sparkSession
    wide = len(pieces(b).tokens)
    aligned = aligned_texts(docs, a, b, text_col)
    counts = materialize(pair_counts(aligned, wide), "pair-counts")
    # One row per A-id, at most the vocabulary.
    best = counts.groupBy(F.expr(f"pair div {wide}").alias("a")).agg(F.max("n").alias("best"))
    bar = (counts.agg(F.sum("n")).first()[0] or 0) // frequent
    common = counts.filter(F.col("n") > bar).orderBy("pair").toArrow()
    highest = best.toArrow()
    top = np.zeros(len(byte_level(a).tokens), np.int64)
    top[highest["a"].to_numpy()] = highest["best"].to_numpy()
    sent = spark.sparkContext.broadcast((common["pair"].to_numpy().tobytes(), common["n"].to_numpy().tobytes(), top.tobytes()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, n, top = (np.frombuffer(x, np.int64) for x in sent.value)
        for some, ends, (x, y, times) in _slices(batches):
            pair = x * wide + y
            at = np.minimum(np.searchsorted(pairs, pair), max(0, len(pairs) - 1))
            known = pairs[at] == pair if len(pairs) else np.zeros(len(pair), bool)
            count = np.where(known, n[at], 0) if len(pairs) else np.zeros(len(pair), np.int64)
            total = lambda v: np.diff(np.concatenate([[0], np.cumsum(v)])[ends])
            missed = total(~known)
            rare = pa.StructArray.from_arrays([pa.array(pair[~known]), pa.array(times[~known])], ["pair", "times"])
            yield pa.RecordBatch.from_arrays(
                [*[some.column(c) for c in ("_key", "_copies", *MEASURES, "groups_sha256")], pa.array(total(count * times)),
                 pa.array(total(times * (known & (count == top[x])))), pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(missed)]).astype(np.int32)), rare)],
                ["_key", "_copies", *MEASURES, "groups_sha256", "count_sum", "n_best", "rare"])

    schema = ALIGNED.split(", a array")[0] + ", count_sum bigint, n_best bigint, rare array<struct<pair: bigint, times: bigint>>"
    scored = materialize(map_arrow(aligned, run, schema), "scored")
    rest = scored.select("_key", F.inline("rare")).join(counts, "pair").withColumn("a", F.expr(f"pair div {wide}")).join(F.broadcast(best), "a")
    rest = rest.groupBy("_key").agg(F.sum(F.col("n") * F.col("times")).alias("_sum"), F.sum(F.when(F.col("n") == F.col("best"), F.col("times")).otherwise(0)).alias("_best"))
    per_text = scored.drop("rare").join(rest, "_key", "left").select(
        "_key", "_copies", *MEASURES, (F.col("n_best") + F.coalesce("_best", F.lit(0))).alias("n_best"), (F.col("count_sum") + F.coalesce("_sum", F.lit(0))).alias("count_sum"), "groups_sha256")
    per_text = materialize(per_text, "text-measures")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = materialize(docs.select(F.col(id_col).alias("_id"), F.unhex(F.sha2(text, 256)).alias("_key")), "keys")
    out = spread_join(rows, per_text, "_key", "_copies", rows.count())
    return out.select(F.col("_id").alias(id_col), *MEASURES, "n_best", "count_sum", "groups_sha256")
