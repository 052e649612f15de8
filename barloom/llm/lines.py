"""Global removal of repeated passages of two lines or more.

``passages`` and ``without_passages`` find repeats by chunks with content-defined borders, as below, and then extend them line by line:
of the lines that no repeated chunk covers, with their neighbours on both sides, every two neighbouring ones with words are looked up too.
So a passage is found wherever it stands: a chunk or pair that has an earlier occurrence goes, and overlapping ones unite to the
whole equal passage. Digests find candidates, and the bytes of all candidates are compared. A pair that
overlaps its own first occurrence stays (three equal lines in a row). Lines without words belong to the pair or chunk
around them. Each line that goes stands in an earlier place; a single repeated line stays.

``repeats`` and ``deduplicate`` are the coarser form by chunks with content-defined borders; it finds only
repeats that hold a whole chunk. Every line is hashed. A rolling hash over the hashes of the last WINDOW lines ends a chunk after a
line if it is divisible by EVERY, so borders depend on nearby lines only and come back after an
insertion. Chunks have at least two lines, and MOST at most; a single line left at the end joins the chunk before it. Chunks whose digests repeat
anywhere are candidates; their bytes are compared (grouped by content, after map-side
combining), and all but the first occurrence are removed.

Chunks of one line, and chunks without words, stay. Null texts are empty and have no chunks; they stay
null. Rows that repeat in id and text are one document: what the first keeps, all keep.
Order of occurrence is by (id, hash of text, position). Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import keyed_texts, let, map_arrow
from .spans import candidates, cut, first_kept, later, runs

WINDOW, EVERY, LEAST, MOST = 2, 3, 2, 64
# Multiplier of the rolling hash, and the 64-bit range.
BASE, RANGE = 0x9E3779B97F4A7C15, (1 << 64) - 1


def chunks_of(text: bytes) -> Iterator[tuple[int, int, int]]:
    """(start, stop, lines) of a text's chunks; together they are the text."""
    from xxhash import xxh64_intdigest

    begin = at = lines = 0
    held = None
    recent: list[int] = []
    for line in _lines(text):
        at += len(line)
        lines += 1
        recent = [*recent, xxh64_intdigest(line.rstrip(b"\n"))][-WINDOW:]
        rolled = 0
        for h in recent:
            rolled = (rolled * BASE + h) & RANGE
        if lines >= MOST or (lines >= LEAST and (rolled >> 32) % EVERY == 0):
            if held:
                yield held
            held = begin, at, lines
            begin, lines = at, 0
    if held and 0 < lines < LEAST:
        held, lines = (held[0], at, held[2] + lines), 0
    if held:
        yield held
    if lines:
        yield begin, at, lines


def _lines(text: bytes) -> list[bytes]:
    parts = text.split(b"\n")
    return [p + b"\n" for p in parts[:-1]] + ([parts[-1]] if parts[-1] else [])


def chunks(keyed: DataFrame) -> DataFrame:
    """(_id, _hash, start, stop, digest, body) of the multi-line chunks of keyed texts."""
    kind = dict(keyed.dtypes)["_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest

        from .units import blocks

        for batch in blocks(batches, "_text"):
            rows, starts, stops, digests, bodies = [], [], [], [], []
            for i, text in enumerate(batch.column("_text").cast(pa.binary()).to_pylist()):
                for start, stop, n in chunks_of(text) if b"\n" in text else ():
                    # The last line of a text has no line break; it equals a line that has one.
                    body = text[start:stop].rstrip(b"\n")
                    if n >= LEAST and body.strip():
                        rows.append(i)
                        starts.append(start)
                        stops.append(stop)
                        digests.append(xxh3_64_intdigest(body) - (1 << 63))
                        bodies.append(body)
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("_id").take(at), batch.column("_hash").take(at), pa.array(starts, pa.int32()), pa.array(stops, pa.int32()),
                                              pa.array(digests, pa.int64()), pa.array(bodies, pa.large_binary()).cast(pa.binary())], ["_id", "_hash", "start", "stop", "digest", "body"])

    return map_arrow(keyed, run, f"_id {kind}, _hash bigint, start int, stop int, digest bigint, body binary")


def removals(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    found = materialize(chunks(keyed_texts(docs, id_col, text_col)), "line-chunks")
    return runs(later(found, found.count(), same=True))


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, spans, first_ids) of the documents that lose lines: what stays, what goes, and who has it first."""
    return cut(docs, removals(docs, id_col, text_col), id_col, text_col, changed_only=True)


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All documents with all columns, without the lines of repeated chunks."""
    return cut(docs, removals(docs, id_col, text_col), id_col, text_col)


def pairs_of(text: bytes) -> Iterator[tuple[int, int]]:
    """(start, stop) of every two neighbouring lines with words, without the last line break."""
    at, held = 0, None
    for line in text.split(b"\n"):
        stop = at + len(line)
        if line.strip():
            if held is not None:
                yield held, stop
            held = at
        at = stop + 1


def whole_chunks(text: bytes) -> Iterator[tuple[int, int]]:
    """(start, stop) from the first to the last line with words of each chunk that has two of them, without the last line break."""
    for start, stop, _ in chunks_of(text):
        inside = list(pairs_of(text[start:stop]))
        if inside:
            yield start + inside[0][0], start + inside[-1][1]


def units(keyed: DataFrame) -> DataFrame:
    """(_id, _hash, start, stop, size, digest, within) of the chunks and line pairs of keyed texts.

    ``within``: start of the chunk that holds a pair, -1 if none does, null for chunks. Stop is after the line break, size before it.
    """
    kind = dict(keyed.dtypes)["_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest

        from .units import blocks

        for batch in blocks(batches, "_text"):
            rows, starts, stops, sizes, digests, holders = [], [], [], [], [], []

            def add(i, text, start, stop, within):
                rows.append(i)
                starts.append(start)
                stops.append(min(stop + 1, len(text)))
                sizes.append(stop - start)
                digests.append(xxh3_64_intdigest(text[start:stop]) - (1 << 63))
                holders.append(within)

            for i, text in enumerate(batch.column("_text").cast(pa.binary()).to_pylist()):
                if b"\n" not in text:
                    continue
                held, at = list(whole_chunks(text)), 0
                for start, stop in held:
                    add(i, text, start, stop, None)
                for start, stop in pairs_of(text):
                    while at < len(held) and held[at][1] <= start:
                        at += 1
                    inside = at < len(held) and held[at][0] <= start and stop <= held[at][1]
                    add(i, text, start, stop, held[at][0] if inside else -1)
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("_id").take(at), batch.column("_hash").take(at), *(pa.array(x, pa.int32()) for x in (starts, stops, sizes)),
                                              pa.array(digests, pa.int64()), pa.array(holders, pa.int32())], ["_id", "_hash", "start", "stop", "size", "digest", "within"])

    return map_arrow(keyed, run, f"_id {kind}, _hash bigint, start int, stop int, size int, digest bigint, within int")


def _with_bodies(rows: DataFrame, keyed: DataFrame) -> DataFrame:
    """The candidates with their bytes, which are read again from the texts."""
    places = rows.groupBy(F.col("_id").alias("_i"), F.col("_hash").alias("_h")).agg(F.collect_set(F.struct("start", "stop", "size", "digest")).alias("at"))
    both = keyed.join(places, keyed["_id"].eqNullSafe(places["_i"]) & (keyed["_hash"] == places["_h"]))

    def bodies(b):
        return F.transform("at", lambda x: F.struct(x["start"].alias("start"), x["stop"].alias("stop"), x["digest"].alias("digest"), F.substring(b, x["start"] + 1, x["size"]).alias("body")))
    found = both.select("_id", "_hash", let(F.col("_text").cast("binary"), bodies).alias("x"))
    return found.select("_id", "_hash", F.inline("x"))


def _repeated(found: DataFrame, keyed: DataFrame) -> DataFrame:
    total = found.count()
    return first_kept(materialize(_with_bodies(candidates(found, total), keyed), "candidates"), total, same=True)


def passage_removals(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    keyed = keyed_texts(docs, id_col, text_col)
    found = materialize(units(keyed), "line-units")
    gone = materialize(_repeated(found.filter("within IS NULL").drop("within"), keyed), "repeated-chunks")
    # No pair of a repeated chunk is the first of its kind, so only the others are looked up.
    covered = gone.select(F.col("_id").alias("_i"), F.col("_hash").alias("_h"), F.col("start").alias("_s")).distinct()
    same = found["_id"].eqNullSafe(F.col("_i")) & (found["_hash"] == F.col("_h")) & (found["within"] == F.col("_s"))
    pairs = materialize(found.filter("within IS NOT NULL").join(covered, same, "left_anti").drop("within"), "line-pairs")
    return runs(gone.unionByName(_repeated(pairs, keyed)))


def passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, spans, first_ids) of the documents that lose lines: what stays, what goes, and who has it first."""
    return cut(docs, passage_removals(docs, id_col, text_col), id_col, text_col, changed_only=True)


def without_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All documents with all columns, without the lines of repeated passages."""
    return cut(docs, passage_removals(docs, id_col, text_col), id_col, text_col)
