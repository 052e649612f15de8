"""Substring de-duplication by content-defined chunks.

A gear hash rolls over the last 32 bytes: h = (h << 1) + GEAR[byte]. Where its top bits are zero a chunk may end,
so borders move with the content and an insertion changes the chunks around it only. Chunks have
MIN to MAX bytes, 64 on average, and never part a character. Equal chunks have equal 128-bit digests; all but the first
occurrence are repeats. Neighbouring repeats are united, and runs of at least LEAST bytes are
removed, so single chunks that recur by chance stay.

``passages`` and ``without_passages`` take repeated chunks as anchors only. Blocks of neighbouring anchors are extended to both
sides, byte by byte, as far as the text agrees with what a first occurrence of one of the anchors has there, and the least length
holds for the extended block. So a passage that shares one chunk goes whole. Texts are looked at REACH bytes at a
time, or to the next block; what agrees over all of that looks on. Each byte that goes stands in an earlier place.

Null texts are empty and have no chunks; they stay null. Rows that repeat in id and text
are one document: what the first keeps, all keep. Order of occurrence is by (id,
hash of text, position). Empty tables give empty results.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .common import keyed_texts, let, map_arrow, spread_join
from .spans import cut, later, runs

# Bytes that are compared at first beyond a run of anchors; each further round takes four times as many.
REACH = 256
# No other anchor on that side.
FAR = 1 << 30
MIN, MAX, BITS, LEAST = 32, 256, 5, 96

# One random number for each byte value, by rule.
GEAR = np.array([int.from_bytes(blake2b(bytes([i]), digest_size=4).digest(), "little") for i in range(256)], np.uint32)


def gear(data: np.ndarray) -> np.ndarray:
    """The rolling hash after each byte, over that byte and the 31 before it, by doubling the window."""
    h = GEAR[data]
    for step in (1, 2, 4, 8, 16):
        h[step:] += h[:-step] << np.uint32(step)
    return h


def borders(data: np.ndarray) -> np.ndarray:
    """Where a chunk may end: after a byte whose hash has its top bits zero, before a character begins."""
    ends = np.flatnonzero(gear(data) >> np.uint32(32 - BITS) == 0) + 1
    ends = ends[ends < len(data)]
    return ends[data[ends] & 0xC0 != 0x80]


def cuts(data: np.ndarray, start: int, stop: int, ends: list[int]) -> list[int]:
    """Ends of the chunks of data[start:stop]; ``ends`` are the borders of the whole array."""
    out, at = [], start
    while stop - at > MIN:
        k = bisect_left(ends, at + MIN)
        end = ends[k] if k < len(ends) else stop
        if end > at + MAX:
            end = at + MAX
            while end < stop and data[end] & 0xC0 == 0x80:
                end -= 1
        if end >= stop:
            break
        out.append(end)
        at = end
    if at < stop:
        out.append(stop)
    return out


def chunks(keyed: DataFrame) -> DataFrame:
    """(_id, _hash, start, stop, digest) of the chunks of keyed texts."""
    kind = dict(keyed.dtypes)["_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        from .units import blocks

        for batch in blocks(batches, "_text"):
            texts = batch.column("_text").cast(pa.binary()).to_pylist()
            whole = b"".join(texts)
            data = np.frombuffer(whole, np.uint8)
            ends = borders(data).tolist()
            rows, starts, stops, digests, at = [], [], [], [], 0
            for i, text in enumerate(texts):
                last = at
                for end in cuts(data, at, at + len(text), ends):
                    starts.append(last - at)
                    stops.append(end - at)
                    digests.append(xxh3_128_digest(whole[last:end]))
                    last = end
                rows += [i] * (len(starts) - len(rows))
                at += len(text)
            pick = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("_id").take(pick), batch.column("_hash").take(pick), pa.array(starts, pa.int32()), pa.array(stops, pa.int32()),
                                              pa.array(digests, pa.binary())], ["_id", "_hash", "start", "stop", "digest"])

    return map_arrow(keyed, run, f"_id {kind}, _hash bigint, start int, stop int, digest binary")


def removals(docs: DataFrame, id_col: str, text_col: str, least: int = LEAST) -> DataFrame:
    found = materialize(chunks(keyed_texts(docs, id_col, text_col)), "chunks")
    return runs(later(found, found.count()), least)


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, spans, first_ids) of the documents that lose something: what stays, what goes, and who has it first."""
    return cut(docs, removals(docs, id_col, text_col), id_col, text_col, changed_only=True)


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All documents with all columns, without repeated substrings."""
    return cut(docs, removals(docs, id_col, text_col), id_col, text_col)


def agree(a: bytes, b: bytes, left: bool) -> int:
    """How many bytes agree at the ends, or with ``left`` at the beginnings, of what lies right, or left, of a place."""
    n = min(len(a), len(b))
    a, b = (a[len(a) - n :], b[len(b) - n :]) if left else (a[:n], b[:n])
    if a == b:
        return n
    differ = int.from_bytes(a, "little" if left else "big") ^ int.from_bytes(b, "little" if left else "big")
    return (8 * n - differ.bit_length()) // 8


def _ends(found: DataFrame) -> DataFrame:
    """(_id, _hash, left, at, most, _fid, _fhash, fat): both edges of blocks of neighbouring anchors, at each way that anchors of the block lie in a first occurrence.

    ``most`` is how far the next block is.
    """
    order = Window.partitionBy("_id", "_hash").orderBy("start")
    once = found.select("_id", "_hash", "start", "stop", F.col("first._id").alias("_fid"), F.col("first._hash").alias("_fhash"), (F.col("start") - F.col("first.start")).alias("by")).distinct()
    before, after = F.lag("stop").over(order), F.lead("start").over(order)
    rows = once.withColumn("gap", F.col("start") - before).withColumn("next", after - F.col("stop"))
    rows = rows.withColumn("block", F.sum(F.when(F.col("gap") == 0, 0).otherwise(1)).over(order))
    block = Window.partitionBy("_id", "_hash", "block")
    rows = rows.withColumn("begin", F.min("start").over(block)).withColumn("end", F.max("stop").over(block))
    rows = rows.withColumn("gap", F.max(F.when(F.col("start") == F.col("begin"), F.coalesce("gap", F.lit(FAR)))).over(block))
    rows = rows.withColumn("next", F.max(F.when(F.col("stop") == F.col("end"), F.coalesce("next", F.lit(FAR)))).over(block))
    rows = rows.select("_id", "_hash", "begin", "end", "gap", "next", "_fid", "_fhash", "by").distinct()
    one = lambda left, at, most: F.struct(F.lit(left).alias("left"), at.alias("at"), most.alias("most"), (at - F.col("by")).alias("fat"))
    return rows.select("_id", "_hash", "_fid", "_fhash", F.inline(F.array(one(True, F.col("begin"), F.col("gap")), one(False, F.col("end"), F.col("next"))))).filter("fat >= 0 AND (fat > 0 OR NOT left)")


def _around(places: DataFrame, keyed: DataFrame) -> DataFrame:
    """(_id, _hash, left, at, most, bytes) of distinct places: up to so many bytes that lie left or right of them."""
    wanted = places.groupBy(F.col("_id").alias("_i"), F.col("_hash").alias("_h")).agg(F.collect_set(F.struct("left", "at", "most")).alias("places"))
    both = keyed.join(wanted, keyed["_id"].eqNullSafe(wanted["_i"]) & (keyed["_hash"] == wanted["_h"]))

    def bytes_of(b):
        begin = lambda x: F.when(x["left"], F.greatest(x["at"] - x["most"], F.lit(0))).otherwise(x["at"])
        size = lambda x: F.when(x["left"], F.least(x["at"], x["most"])).otherwise(x["most"])
        return F.transform("places", lambda x: F.struct(x["left"].alias("left"), x["at"].alias("at"), x["most"].alias("most"), F.substring(b, begin(x) + 1, size(x)).alias("bytes")))
    return both.select("_id", "_hash", F.inline(let(F.col("_text").cast("binary"), bytes_of))).dropDuplicates(["_id", "_hash", "left", "at", "most"])


def extended(found: DataFrame, keyed: DataFrame) -> DataFrame:
    """(_id, _hash, start, stop, first) of what lies beside the anchors and agrees with what lies beside their first occurrence."""
    kind, out, reach = dict(keyed.dtypes)["_id"], None, REACH
    ends = materialize(_ends(found), "anchor-ends")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left = batch.column("left").to_pylist()
            own, first = (batch.column(c).to_pylist() for c in ("own", "first"))
            n = [agree(a, b, side) for a, b, side in zip(own, first, left, strict=True)]
            more = [k == most for k, most in zip(n, batch.column("most").to_pylist(), strict=True)]
            for i, (k, a, side) in enumerate(zip(n, own, left, strict=True)):
                # No character is parted; where the texts are looked at on, the next byte is not known, so the last character waits.
                if side:
                    while k and a[len(a) - k] & 0xC0 == 0x80:
                        k -= 1
                else:
                    k -= more[i]
                    while k and k < len(a) and a[k] & 0xC0 == 0x80:
                        k -= 1
                n[i] = k
            keep = [batch.column(c) for c in ("_id", "_hash", "_fid", "_fhash", "left", "at", "fat")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(n, pa.int32()), pa.array(more, pa.bool_())], ["_id", "_hash", "_fid", "_fhash", "left", "at", "fat", "n", "more"])

    while True:
        firsts = ends.groupBy(F.col("_fid").alias("_id"), F.col("_fhash").alias("_hash"), "left", F.col("fat").alias("at")).agg(F.count("*").alias("uses"))
        firsts = firsts.withColumn("most", F.lit(reach))
        ends = ends.withColumn("most", F.least("most", F.lit(reach)))
        texts = materialize(_around(ends.select("_id", "_hash", "left", "at", "most").unionByName(firsts.select("_id", "_hash", "left", "at", "most")), keyed), "beside")
        # Places of first occurrences get a number, so that one which many share is a plain heavy key.
        numbered = materialize(firsts.withColumn("place", F.xxhash64("_id", "_hash", "left", "at")), "first-places")
        match = lambda a, b: a["_id"].eqNullSafe(b["_id"]) & (a["_hash"] == b["_hash"]) & (a["left"] == b["left"]) & (a["at"] == b["at"]) & (a["most"] == b["most"])
        side = numbered.join(texts, match(numbered, texts)).select("place", numbered["_id"].alias("_pid"), numbered["_hash"].alias("_ph"), numbered["at"].alias("_pat"), "uses", F.col("bytes").alias("first"))
        side = materialize(side, "first-sides")
        own = ends.join(texts, match(ends, texts)).select(*(ends[c] for c in ends.columns), F.col("bytes").alias("own"))
        own = materialize(own.withColumn("place", F.xxhash64("_fid", "_fhash", "left", "fat")), "own-sides")
        joined = spread_join(own, side, "place", "uses", own.count())
        joined = joined.filter(F.col("_fid").eqNullSafe(F.col("_pid")) & (F.col("_fhash") == F.col("_ph")) & (F.col("fat") == F.col("_pat")))
        rows = joined.select("_id", "_hash", "_fid", "_fhash", "left", "at", "fat", "most", "own", "first")
        done = materialize(map_arrow(rows, run, f"_id {kind}, _hash bigint, _fid {kind}, _fhash bigint, left boolean, at int, fat int, n int, more boolean"), "extensions")
        shift = F.when(F.col("left"), -F.col("n")).otherwise(F.col("n"))
        spans = done.filter("n > 0").select("_id", "_hash", F.least("at", F.col("at") + shift).alias("start"), F.greatest("at", F.col("at") + shift).alias("stop"),
                                            F.struct(F.col("_fid").alias("_id"), F.col("_fhash").alias("_hash"), F.least("fat", F.col("fat") + shift).alias("start")).alias("first"))
        out = spans if out is None else out.unionByName(spans)
        ends = done.filter("more").select("_id", "_hash", "_fid", "_fhash", "left", (F.col("at") + shift).alias("at"), (F.col("fat") + shift).alias("fat"), F.lit(FAR).alias("most"))
        if done.filter("more").isEmpty():
            return out
        reach *= 4


def passage_removals(docs: DataFrame, id_col: str, text_col: str, least: int = LEAST) -> DataFrame:
    keyed = keyed_texts(docs, id_col, text_col)
    found = materialize(chunks(keyed), "chunks")
    found = materialize(later(found, found.count()).select("_id", "_hash", "start", "stop", "first"), "anchors")
    return runs(found.unionByName(extended(found, keyed)), least)


def passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, spans, first_ids) of the documents that lose something: what stays, what goes, and who has it first."""
    return cut(docs, passage_removals(docs, id_col, text_col), id_col, text_col, changed_only=True)


def without_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All documents with all columns, without repeated passages."""
    return cut(docs, passage_removals(docs, id_col, text_col), id_col, text_col)
