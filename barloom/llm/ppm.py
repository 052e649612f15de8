"""Language-model scores by prediction by partial matching over bytes.

``stream_scores`` is the whole method: a text is the byte stream of its words, a space after each, and one end. Every byte
of every document is predicted from the ORDER bytes before it, over the borders of words, by a trie that is trained on the streams of all training
texts with their counts; escapes and exclusion as below. A stream starts as if after a space. The corpus is reduced to counts of
distinct (context, symbol) events, which are coded once; the EVENTS most frequent are broadcast to the pass over the texts, all others
are joined. Words are counted only for ``base_score``.

``score`` is a coarser model, by words: a text is its words and one end. The longest context of a word is the whole word: one that was seen c times in
N training tokens has (c - d) / N, and the escape takes d for each distinct word; d is estimated from
how many words occur once and twice. After that escape the word is predicted byte by byte from a
trie of byte contexts, up to ORDER bytes back and no further than the space before the word, trained on
distinct words, for it has to spell new ones; words that were seen are excluded. In a context with n occurrences of q different symbols a
symbol seen c times has (2c - 1) / 2n and the escape q / 2n (method D). After an escape the next shorter
context decides, without the symbols of the longer one (exclusion); below the empty context
all symbols left are alike. So all texts' probabilities sum to one. The model is trained on the training texts only.

A word's code length depends on the word alone, so the corpus is reduced to counts of distinct
words first, those to counts of (context, symbol) events, and those to tables of contexts; each step
is map-side combined and covers all rows. Words are then scored once. The documents' words are looked up in two tiers: the
FREQUENT most frequent words are broadcast (a fixed bound), all others are joined by a
shuffle; no such word has more than one in FREQUENT of all tokens, so none is hot.

Null texts are empty: just the end token. Repeated rows are scored each and train each. A null id
counts as the empty text when training rows are chosen. With no training rows every event
falls to the alphabet.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import map_arrow

ORDER = 5
FREQUENT = 200_000
# Events with their code lengths are broadcast up to this many (16 bytes each), and joined beyond.
EVENTS = 4_000_000
# A task hands its word counts on when it holds so many.
HELD = 300_000
# The border of a word, the end of a text, and symbols: all bytes but six kinds of white space, and these two.
SPACE, END, ALPHABET = 0x20, 0x0A, 252

LENGTH_AT = 56

# Bytes of a stream that are looked at together, and the longest words that are broadcast.
PIECE, WORD_MOST = 1 << 20, 64


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, c, a) of (_text, _train): occurrences in training texts and in all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .units import blocks

        seen = (Counter(), Counter())

        def given():
            for train, counts in enumerate(seen):
                n = pa.array(list(counts.values()), pa.int64())
                zero = pa.array(np.zeros(len(counts), np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), n if train else zero, n], ["word", "c", "a"])
                counts.clear()

        for batch in blocks(batches, "_text"):
            for text, train in zip(batch.column("_text").cast(pa.binary()).to_pylist(), batch.column("_train").to_pylist(), strict=True):
                seen[train].update(text.lower().split())
            if sum(map(len, seen)) > HELD:
                yield from given()
        yield from given()

    return map_arrow(texts, run, "word binary, c bigint, a bigint").groupBy("word").agg(F.sum("c").alias("c"), F.sum("a").alias("a"))


def events_of(words: list[bytes], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """(keys, owners): for each byte of each word, and its end, the longest context and the symbol as one number; whose it is.

    A key holds the context's length, its bytes and the symbol: length << 56 | context << 8 | symbol.
    """
    data = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    owner = np.repeat(np.arange(len(words)), sizes + 1)
    at = np.arange(1, len(data))
    begin = np.cumsum(sizes + 1) - (sizes + 1)
    back = at - begin[owner]
    key = data[at].astype(np.int64)
    for j in range(1, order + 1):
        deep = back >= j
        key[deep] |= data[at[deep] - j].astype(np.int64) << (8 * j)
    return key | np.minimum(back, order) << LENGTH_AT, owner


def event_counts(counted: DataFrame) -> DataFrame:
    """(key, c) of (word, c): how often each event occurs in training; events of other words have 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, owner = events_of(batch.column("word").to_pylist())
            own, where = np.unique(keys, return_inverse=True)
            c = np.zeros(len(own), np.int64)
            np.add.at(c, where, batch.column("c").to_numpy()[owner])
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(c)], ["key", "c"])

    return map_arrow(counted.select("word", "c"), run, "key bigint, c bigint").groupBy("key").agg(F.sum("c").alias("c"))


def _bits(value: Column, mask: int) -> Column:
    return value.bitwiseAND(F.lit(mask).cast("bigint"))


def _length(key: Column) -> Column:
    return F.shiftright(key, LENGTH_AT).cast("int")


def _shorter(key: Column, length: int) -> Column:
    """The event with its context cut to the last so many bytes."""
    return _bits(key, (1 << 8 * (length + 1)) - 1).bitwiseOR(F.lit(length << LENGTH_AT).cast("bigint"))


def _context(key: Column) -> Column:
    """The event's context: its key without the symbol."""
    return _bits(key, ~0xFF)


def _orders(key: Column, order: int = ORDER) -> Column:
    """The event at all its context lengths, as an array from the shortest."""
    return F.array_compact(F.array(*[F.when(_length(key) >= k, _shorter(key, k)) for k in range(order + 1)]))


def train(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tables of the trie: counts (key, c), and nodes (ctx, n, q, nx).

    nx is how often the node's own symbols occur in its next shorter context: what exclusion takes from there.
    """
    counts = materialize(events.filter("c > 0").select(F.explode(_orders(F.col("key"))).alias("key"), "c").groupBy("key").agg(F.sum("c").alias("c")), "trie")
    key = F.col("key")
    up = F.coalesce(*[F.when(_length(key) == k, _shorter(key, k - 1)) for k in range(1, ORDER + 1)])
    below = counts.select(F.col("key").alias("up"), F.col("c").alias("cx"))
    full = counts.withColumn("up", up).join(below, "up", "left")
    nodes = full.groupBy(_context(key).alias("ctx")).agg(F.sum("c").alias("n"), F.count("*").alias("q"), F.coalesce(F.sum("cx"), F.lit(0)).alias("nx"))
    return counts, materialize(nodes, "trie-nodes")


def code(events: DataFrame, counts: DataFrame, nodes: DataFrame) -> DataFrame:
    """(key, lp): log10 probability of each event."""
    at = events.select("key").select("key", F.posexplode(_orders(F.col("key"))).alias("k", "tkey"))
    at = at.withColumn("ctx", _context(F.col("tkey"))).join(nodes, "ctx", "left").join(counts.withColumnRenamed("key", "tkey"), "tkey", "left")
    levels = at.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("k", F.coalesce("c", F.lit(0)).alias("c"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("q", F.lit(0)).alias("q"), F.coalesce("nx", F.lit(0)).alias("nx"))), asc=False).alias("levels"))
    state = lambda lp, done, xn, xq: F.struct(lp.cast("double").alias("lp"), done.alias("done"), xn.cast("bigint").alias("xn"), xq.cast("bigint").alias("xq"))

    def step(s, x):
        n, q = x["n"] - s["xn"], x["q"] - s["xq"]
        moved = F.when(q > 0, F.log10(q / (2 * n))).otherwise(F.lit(0.0))
        return (F.when(s["done"] | (x["q"] == 0), s)
                .when(x["c"] > 0, state(s["lp"] + F.log10((2 * x["c"] - 1) / (2 * n)), F.lit(True), s["xn"], s["xq"]))
                .otherwise(state(s["lp"] + moved, F.lit(False), x["nx"], x["q"])))

    start = state(F.lit(0.0), F.lit(False), F.lit(0), F.lit(0))
    lp = F.aggregate("levels", start, step, lambda s: F.when(s["done"], s["lp"]).otherwise(s["lp"] - F.log10(ALPHABET - s["xq"])))
    return levels.select("key", lp.alias("lp"))


def word_codes(counted: DataFrame, coded: DataFrame) -> DataFrame:
    """(word, c, a, lp): log10 probability of each word and its end."""
    if coded.count() > EVENTS:
        def positions(batches):
            for batch in batches:
                keys, owner = events_of(batch.column("word").to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column("word").take(pa.array(owner)), pa.array(keys)], ["word", "key"])
        sums = map_arrow(counted.select("word"), positions, "word binary, key bigint").join(coded, "key").groupBy("word").agg(F.sum("lp").alias("lp"))
        return counted.join(sums, "word")
    table = coded.toArrow()
    key, lp = table["key"].to_numpy(), table["lp"].to_numpy()
    order = np.argsort(key)
    shared = counted.sparkSession.sparkContext.broadcast((key[order], lp[order]))
    del table, key, lp, order

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, lp = shared.value
        for batch in batches:
            own, owner = events_of(batch.column("word").to_pylist())
            total = np.bincount(owner, lp[np.searchsorted(keys, own)], len(batch))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(total)], [*batch.schema.names, "lp"])

    return map_arrow(counted, run, "word binary, c bigint, a bigint, lp double")


def whole_words(words: DataFrame, total: int, distinct: int, ends: int, end_lp: float) -> tuple[DataFrame, float]:
    """Codes with whole words above the trie: (words with their lp, log10 probability of the end)."""
    once, twice, spelled = words.agg(F.count_if(F.col("c") == 1), F.count_if(F.col("c") == 2), F.coalesce(F.sum(F.when(F.col("c") > 0, F.pow(F.lit(10.0), "lp"))), F.lit(0.0))).first()
    if not total:
        return words, end_lp
    cut = once / (once + 2 * twice) if once and twice else 0.5
    free = max(1e-9, 1 - spelled - (10**end_lp if ends else 0))
    escape = math.log10(cut * distinct / total) - math.log10(free)
    lp = F.when(F.col("c") > 0, F.log10((F.col("c") - cut) / total)).otherwise(F.col("lp") + escape)
    return words.withColumn("lp", lp), math.log10((ends - cut) / total) if ends else end_lp + escape


@lru_cache(maxsize=1)
def _frequent(key: str, shared):
    words, c, lp = shared.value
    # One more entry at the end stands for all other words.
    return {w: i for i, w in enumerate(words.split())}, np.append(np.log10(c + 1.0), 0.0), np.append(c > 0, False), np.append(lp, 0.0)


def score(docs: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, training, n_tokens, n_known, train_tokens, base_score, score) of every document.

    ``training`` says which rows the model learns from. ``base_score`` is the unigram code with one added to each count.
    """
    import uuid

    spark, kind = docs.sparkSession, dict(docs.dtypes)[id_col]
    texts = docs.select(F.col(id_col).alias("_id"), training.alias("_train"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    counted = materialize(word_counts(texts.select("_text", "_train")), "words")
    ends = texts.agg(F.count_if("_train")).first()[0]
    sums = counted.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0)).first()
    total, distinct = sums[0] + ends, sums[1] + (ends > 0)

    end_key = (1 << LENGTH_AT) | SPACE << 8 | END
    end_event = spark.createDataFrame([(end_key, int(ends > 0))], "key bigint, c bigint")
    types = counted.select("word", (F.col("c") > 0).cast("bigint").alias("c"))
    events = materialize(event_counts(types).unionByName(end_event), "events")
    coded = materialize(code(events, *train(events)), "event-codes")
    end_lp = coded.filter(F.col("key") == end_key).first().lp
    words = materialize(word_codes(counted, coded), "spelled-words")
    words, end_lp = whole_words(words, total, distinct, ends, end_lp)
    words = materialize(words, "word-codes")

    best = words.orderBy(F.desc("a"), "word").limit(FREQUENT).select("word", "c", "lp").toArrow()
    shared = spark.sparkContext.broadcast((b" ".join(best["word"].to_pylist()), best["c"].to_numpy().astype(np.int64), best["lp"].to_numpy().astype(np.float64)))
    del best
    key = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .units import blocks

        at, base, known, lp = _frequent(key, shared)
        for batch in blocks(batches, "_text"):
            cols: tuple[list, ...] = ([], [], [], [], [])
            for text in batch.column("_text").cast(pa.binary()).to_pylist():
                tokens = text.lower().split()
                i = np.fromiter(map(at.get, tokens, repeat(len(at))), np.int64, len(tokens))
                for col, value in zip(cols, (len(tokens), int(known[i].sum()), float(base[i].sum()), float(lp[i].sum()), [tokens[k] for k in np.flatnonzero(i == len(at))]), strict=True):
                    col.append(value)
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_train"), *map(pa.array, cols[:4]), pa.array(cols[4], pa.list_(pa.binary()))], ["_id", "_train", "n", "known", "base", "lp", "rest"])

    first = map_arrow(texts, run, f"_id {kind}, _train boolean, n bigint, known bigint, base double, lp double, rest array<binary>")
    first = materialize(first.withColumn("place", F.monotonically_increasing_id()), "first-tier")
    rest = first.select("place", F.explode("rest").alias("word")).join(words.select("word", "c", F.col("lp").alias("wlp")), "word")
    rest = rest.groupBy("place").agg(F.count_if(F.col("c") > 0).alias("rknown"), F.sum(F.log10(F.col("c") + 1.0)).alias("rbase"), F.sum("wlp").alias("rlp"))
    both = first.drop("rest").join(rest, "place", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    n = F.col("n") + 1
    return both.select(
        F.col("_id").alias(id_col), F.col("_train").alias("training"), n.alias("n_tokens"), (F.col("known") + F.coalesce("rknown", F.lit(0)) + int(ends > 0)).alias("n_known"),
        F.lit(total).cast("bigint").alias("train_tokens"),
        (F.col("base") + zero(F.col("rbase")) + float(np.log10(ends + 1.0)) - n * float(np.log10(total + distinct + 1.0))).alias("base_score"),
        (F.col("lp") + zero(F.col("rlp")) + end_lp).alias("score"))


def stream_of(text: bytes) -> bytes:
    """What is predicted of a text, and the space before it."""
    words = text.lower().split()
    return b" " + b" ".join(words) + (b" \n" if words else b"\n")


def stream_pieces(streams: list[bytes], order: int = ORDER) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(keys, owners) as in events_of, for every byte of the streams but the first; long streams in pieces, short ones together."""
    held, size = [], 0
    for i, stream in enumerate(streams):
        for at in range(1, len(stream), PIECE):
            lead = min(at, order)
            held.append((i, lead, stream[at - lead:at + PIECE]))
            size += len(held[-1][2])
            if size >= PIECE:
                yield _piece_events(held, order)
                held, size = [], 0
    if held:
        yield _piece_events(held, order)


def _piece_events(held: list[tuple[int, int, bytes]], order: int) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(b"".join(part for _, _, part in held), np.uint8).astype(np.int64)
    sizes = np.array([len(part) for _, _, part in held])
    begin = np.cumsum(sizes) - sizes
    lead = np.array([k for _, k, _ in held])
    key = data.copy()
    for j in range(1, order + 1):
        key[j:] |= data[:-j] << (8 * j)
    key |= order << LENGTH_AT
    own = np.ones(len(data), bool)
    for back in range(order):
        at = begin[sizes > back] + back
        key[at] = key[at] & ((1 << 8 * (back + 1)) - 1) | back << LENGTH_AT
        own[begin[lead > back] + back] = False
    return key[own], np.repeat([i for i, _, _ in held], sizes - lead)


def stream_counts(texts: DataFrame) -> DataFrame:
    """(key, c, a) of (_text, _train): how often each event occurs in training streams and in all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .units import blocks

        def summed(parts):
            keys, where = np.unique(np.concatenate([k for k, _, _ in parts]), return_inverse=True)
            return [(keys, *(np.bincount(where, np.concatenate([p[i] for p in parts]), len(keys)).astype(np.int64) for i in (1, 2)))]

        parts, size, settled = [], 0, 0
        for batch in blocks(batches, "_text"):
            texts, train = batch.column("_text").cast(pa.binary()).to_pylist(), batch.column("_train").to_pylist()
            for flag in (False, True):
                for keys, _ in stream_pieces([stream_of(t) for t, x in zip(texts, train, strict=True) if x == flag]):
                    keys, n = np.unique(keys, return_counts=True)
                    parts.append((keys, n if flag else np.zeros_like(n), n))
                    size += len(keys)
                    if size > 2 * settled + HELD * 4:
                        parts = summed(parts)
                        size = settled = len(parts[0][0])
                        if settled > HELD * 4:
                            yield pa.RecordBatch.from_arrays([*map(pa.array, parts[0])], ["key", "c", "a"])
                            parts, size, settled = [], 0, 0
        if parts:
            yield pa.RecordBatch.from_arrays([*map(pa.array, summed(parts)[0])], ["key", "c", "a"])

    return map_arrow(texts, run, "key bigint, c bigint, a bigint").groupBy("key").agg(F.sum("c").alias("c"), F.sum("a").alias("a"))


@lru_cache(maxsize=1)
def _base_words(key: str, shared):
    words, c = shared.value
    # One more entry at the end stands for all other words.
    return {w: i for i, w in enumerate(words.split())}, np.append(np.log10(c + 1.0), 0.0), np.append(c > 0, False)


def stream_scores(docs: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, training, n_tokens, n_known, train_tokens, base_score, score) of every document; ``score`` is of its byte stream.

    ``training`` and ``base_score`` as in score.
    """
    import uuid

    spark, kind = docs.sparkSession, dict(docs.dtypes)[id_col]
    texts = docs.select(F.col(id_col).alias("_id"), F.coalesce(training, F.lit(False)).alias("_train"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    counted = materialize(word_counts(texts.select("_text", "_train")), "words")
    ends = texts.agg(F.count_if("_train")).first()[0]
    sums = counted.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0)).first()
    total, distinct = sums[0] + ends, sums[1] + (ends > 0)
    best = counted.filter(F.octet_length("word") <= WORD_MOST).orderBy(F.desc("a"), "word").limit(FREQUENT).select("word", "c").toArrow()
    words = spark.sparkContext.broadcast((b" ".join(best["word"].to_pylist()), best["c"].to_numpy().astype(np.int64)))
    del best

    events = materialize(stream_counts(texts.select("_text", "_train")), "stream-events")
    coded = materialize(code(events, *train(events)).join(events.select("key", "a"), "key"), "event-codes")
    top = coded.orderBy(F.desc("a"), "key").limit(EVENTS).select("key", "lp").toArrow()
    keys, lps = top["key"].to_numpy(), top["lp"].to_numpy()
    order = np.argsort(keys)
    codes = spark.sparkContext.broadcast((keys[order], lps[order]))
    del top, keys, lps, order
    key = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .units import blocks

        at, base, known = _base_words(key, words)
        keys, lps = codes.value
        for batch in blocks(batches, "_text"):
            texts, cols = batch.column("_text").cast(pa.binary()).to_pylist(), ([], [], [], [])
            for text in texts:
                tokens = text.lower().split()
                i = np.fromiter(map(at.get, tokens, repeat(len(at))), np.int64, len(tokens))
                for col, value in zip(cols, (len(tokens), int(known[i].sum()), float(base[i].sum()), [tokens[k] for k in np.flatnonzero(i == len(at))]), strict=True):
                    col.append(value)
            lp, rest = np.zeros(len(texts)), [[] for _ in texts]
            for own, owner in stream_pieces([stream_of(t) for t in texts]):
                place = np.minimum(np.searchsorted(keys, own), max(len(keys) - 1, 0))
                found = keys[place] == own if len(keys) else np.zeros(len(own), bool)
                lp += np.bincount(owner[found], lps[place[found]], len(texts))
                for j in np.flatnonzero(~found):
                    rest[owner[j]].append(int(own[j]))
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_train"), *map(pa.array, cols[:3]), pa.array(lp), pa.array(cols[3], pa.list_(pa.binary())), pa.array(rest, pa.list_(pa.int64()))],
                                             ["_id", "_train", "n", "known", "base", "lp", "words", "events"])

    first = map_arrow(texts, run, f"_id {kind}, _train boolean, n bigint, known bigint, base double, lp double, words array<binary>, events array<bigint>")
    first = materialize(first.withColumn("place", F.monotonically_increasing_id()), "first-tier")
    more = first.select("place", F.explode("words").alias("word")).join(counted.select("word", "c"), "word")
    more = more.groupBy("place").agg(F.count_if(F.col("c") > 0).alias("rknown"), F.sum(F.log10(F.col("c") + 1.0)).alias("rbase"))
    rare = first.select("place", F.explode("events").alias("key")).join(coded.select("key", F.col("lp").alias("elp")), "key").groupBy("place").agg(F.sum("elp").alias("rlp"))
    both = first.drop("words", "events").join(more, "place", "left").join(rare, "place", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    n = F.col("n") + 1
    return both.select(
        F.col("_id").alias(id_col), F.col("_train").alias("training"), n.alias("n_tokens"), (F.col("known") + F.coalesce("rknown", F.lit(0)) + int(ends > 0)).alias("n_known"),
        F.lit(total).cast("bigint").alias("train_tokens"),
        (F.col("base") + zero("rbase") + float(np.log10(ends + 1.0)) - n * float(np.log10(total + distinct + 1.0))).alias("base_score"),
        (F.col("lp") + zero("rlp")).alias("score"))
