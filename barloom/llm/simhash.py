"""Near duplicates by SimHash fingerprints and BK-trees.

Fingerprints that differ in at most ``radius`` of 64 bits agree in one of radius + 1 blocks
of bits. Each block's value is a shard. A shard over SHARD fingerprints is divided again, by
blocks of the bits that are still free, until it is small; distinct fingerprints with few
free bits are few, so this ends. In a shard a BK-tree (children keyed by their Hamming
distance to the parent) takes all its fingerprints as queries at once, and a query follows
only edges within the radius of its own distance to the parent. A tree comes to
its queries by the shard's key; it is no larger than a shard, and nothing is sent to tasks that cannot need it.

Equal fingerprints are joined before. A shard gives a star per group that it finds, never
its pairs, so a group of near copies costs a row for each and shard. Every link within
the radius is found.

Null and empty texts have no shingles and the fingerprint zero, linked like any other. Rows
that repeat in id and text have one result each, the same. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import components, free_name, keyed_texts, least_of, map_arrow, spread_join

# Fingerprints of a shard; flat leaves of a tree; shingles counted at once.
SHARD = 4096
LEAF = 32
BLOCK = 1 << 16


def shingle_hashes(text: bytes, ngram: int) -> np.ndarray:
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    shingles = map(b" ".join, zip(*(words[k:] for k in range(ngram)), strict=False)) if len(words) >= ngram else [b" ".join(words)] if words else []
    return np.fromiter(map(xxh64_intdigest, shingles, repeat(42)), "<u8")


def fingerprint(text: bytes, ngram: int) -> int:
    """Bit k is set if it is set in over half the hashes of the text's word shingles."""
    hashes = shingle_hashes(text, ngram)
    ones = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), BLOCK):
        ones += np.unpackbits(hashes[lo : lo + BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(keyed: DataFrame, ngram: int) -> DataFrame:
    """(_id, _hash, fp) of keyed texts. Case of A-Z is ignored, words lie between ASCII white space."""
    kind = dict(keyed.dtypes)["_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .units import blocks

        for batch in blocks(batches, "_text"):
            texts = batch.column("_text").cast(pa.binary()).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_hash"), pa.array([fingerprint(t, ngram) for t in texts], pa.int64())], ["_id", "_hash", "fp"])

    return map_arrow(keyed, run, f"_id {kind}, _hash bigint, fp bigint")


class Groups:
    """Labels of a shard's fingerprints: the least index of those they are linked to, by any number of links.

    ``prints`` has a row per fingerprint, of one or more unsigned 64-bit words.
    """

    def __init__(self, prints: np.ndarray, radius: int):
        self.prints, self.radius, self.label = prints, radius, np.arange(len(prints))

    def distance(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.bitwise_count(self.prints[a] ^ self.prints[b]).sum(axis=-1, dtype=np.int16)

    def unite(self, linked: np.ndarray) -> None:
        labels = self.label[linked]
        if (labels != labels[0]).any():
            self.label[np.isin(self.label, labels)] = labels.min()

    def tree(self, members: np.ndarray, queries: np.ndarray) -> None:
        """A BK-tree over members in the order given, and what the queries find in it."""
        todo = [(members, queries)]
        while todo:
            members, queries = todo.pop()
            if len(members) <= LEAF:
                near = self.distance(members[:, None], queries[None, :]) <= self.radius
                for k in np.flatnonzero(near.sum(axis=1) > 1):
                    self.unite(np.append(queries[near[k]], members[k]))
                continue
            parent, rest = members[0], members[1:]
            found = self.distance(queries, parent)
            self.unite(np.append(queries[found <= self.radius], parent))
            edge = self.distance(rest, parent)
            for d in np.unique(edge):
                follow = queries[np.abs(found - d) <= self.radius]
                if len(follow):
                    todo.append((rest[edge == d], follow))


def group(prints: np.ndarray, radius: int) -> np.ndarray:
    if len(prints) == 2:
        return np.array([0, int(int(np.bitwise_count(prints[0] ^ prints[1]).sum()) > radius)])
    g = Groups(prints, radius)
    every = np.arange(len(prints))
    g.tree(every, every)
    return g.label


def divide(mask: int, parts: int) -> list[int]:
    """The mask with one of so many blocks of its free bits added, for each block."""
    free = [b for b in range(64) if not mask >> b & 1]
    return [mask | sum(1 << int(b) for b in part) for part in np.array_split(free, parts) if len(part)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _dealt(prints: DataFrame, masks: dict[int, list[int]]) -> DataFrame:
    """Each fingerprint of shards with these masks, in the shards that they are divided into."""
    pick = F.create_map(*[x for m, parts in masks.items() for x in (F.lit(_signed(m)), F.array(*[F.lit(_signed(p)) for p in parts]))])
    return prints.select("fp", F.explode(pick[F.col("mask")]).alias("mask")).select("fp", "mask", F.col("fp").bitwiseAND(F.col("mask")).alias("key"))


def links(prints: DataFrame, radius: int, shard: int = SHARD) -> DataFrame:
    """(a, b): stars over the groups of each shard. ``prints``: distinct values in a column fp, written."""
    rows = _dealt(prints.select("fp", F.lit(0).cast("bigint").alias("mask")), {0: divide(0, radius + 1)})
    found = None
    while True:
        large = materialize(rows.groupBy("mask", "key").count().filter(F.col("count") > shard), "large-shards")
        many = large.count()
        keys = large.select("mask", "key")
        keys = F.broadcast(keys) if many <= 20_000 else keys
        stars = _stars(rows.join(keys, ["mask", "key"], "left_anti") if many else rows, radius)
        found = stars if found is None else found.unionByName(stars)
        if not many:
            return found
        masks = [r.mask for r in large.select("mask").distinct().collect()]
        rows = materialize(_dealt(rows.join(keys, ["mask", "key"]), {m % (1 << 64): divide(m % (1 << 64), radius + 1) for m in masks}), "shards")


def _stars(rows: DataFrame, radius: int) -> DataFrame:
    shards = rows.groupBy("mask", "key").agg(F.collect_list("fp").alias("fps")).filter(F.size("fps") > 1).select("fps")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = batch.column(0)
            flat, ends = col.flatten().to_numpy(), np.array(col.offsets) - col.offsets[0].as_py()
            a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for lo, hi in zip(ends[:-1], ends[1:], strict=True):
                own = np.sort(flat[lo:hi])
                label = group(own.view(np.uint64).reshape(-1, 1), radius)
                moved = np.flatnonzero(label != np.arange(len(own)))
                a.append(own[moved])
                b.append(own[label[moved]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    return map_arrow(shards, run, "a bigint, b bigint")


def near_groups(docs: DataFrame, ngram: int = 3, radius: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_id, _hash, fp, component_id) for every row: the smallest id that links reach, its own included."""
    prints = materialize(fingerprints(keyed_texts(docs, id_col, text_col), ngram), "fingerprints")
    distinct = materialize(prints.groupBy("fp").agg(F.min("_id").alias("low"), F.count("*").alias("n")), "distinct-fingerprints")
    comp = components(materialize(links(distinct.select("fp"), radius), "near-links"))
    roots = distinct.join(comp, distinct["fp"] == comp["node"], "left").select("fp", "low", "n", F.coalesce("root", "fp").alias("root"))
    by_print = materialize(least_of(roots, "low", "component_id"), "print-components")
    total = distinct.agg(F.sum("n")).first()[0] or 0
    return spread_join(prints, by_print, "fp", "n", total)


# Similar texts, not only those that are almost the same: wide fingerprints, whose words are mixed from each
# shingle's hash, and bands of their bits as shards. A shard's tree compares the first SKETCH words only.
WORDS, SKETCH = 8, 2
# Members and bytes of shingle hashes that are verified at once.
BLOCK_MEMBERS, BLOCK_BYTES = 2048, 8 << 20
# Multipliers of a 64-bit finaliser.
MIX1, MIX2, STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def wide_fingerprint(hashes: np.ndarray, words: int = WORDS) -> bytes:
    """64 * words bits, each set if it is set in over half the mixed hashes of the distinct shingles."""
    ones = np.zeros(64 * words, np.int64)
    for lo in range(0, len(hashes), 255):
        h = hashes[lo : lo + 255, None] + STEP * np.arange(1, words + 1, dtype=np.uint64)
        h = (h ^ (h >> np.uint64(30))) * MIX1
        h = (h ^ (h >> np.uint64(27))) * MIX2
        h ^= h >> np.uint64(31)
        ones += np.add.reduce(np.unpackbits(h.view(np.uint8), axis=1, bitorder="little"), axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(hashes), bitorder="little").tobytes()


def widest(similarity: float, words: int) -> int:
    """Bits that may differ between sets of this Jaccard similarity: the mean, highest for sets of equal size, and four deviations."""
    p = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    return int(64 * words * p + 4 * np.sqrt(64 * words * p * (1 - p)))


def similar_groups(docs: DataFrame, ngram: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text", shard: int = SHARD,
                   members: int = BLOCK_MEMBERS) -> DataFrame:
    """(_id, _hash, fid, component_id) for every row: groups of texts linked by a Jaccard similarity of their sets of word shingles.

    Fingerprints only find candidates; a link counts if the sets themselves, as 64-bit hashes of shingles, are similar
    enough. Candidates share one of 64 bands of 16 bits and differ in no more bits than the mean at ``similarity`` and four
    deviations. Bands with over ``shard`` fingerprints of one value are dealt out in pairs of blocks. Groups of candidates are verified in blocks of
    at most about ``members`` sets, each with the group's first set; blocks of a group meet in pairs only if
    it has not become one component by then.

    Texts without words are equal to each other. A text with fewer words than ``ngram`` has one shingle, all its words.
    Null texts are empty, null ids allowed, repeated rows have the same result, an empty table gives an empty one.
    """
    keyed = keyed_texts(docs, id_col, text_col)
    kind = dict(keyed.dtypes)["_id"]

    def fingerprinted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        from .units import blocks

        for batch in blocks(batches, "_text"):
            sets = [np.unique(shingle_hashes(t, ngram)) for t in batch.column("_text").cast(pa.binary()).to_pylist()]
            cols = [pa.array([xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), pa.array([wide_fingerprint(s) for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_hash"), *cols], ["_id", "_hash", "set", "print"])

    prints = materialize(map_arrow(keyed, fingerprinted, f"_id {kind}, _hash bigint, set binary, print binary"), "wide-fingerprints")
    distinct = prints.groupBy("set").agg(F.min(F.struct("_id", "_hash")).alias("first"), F.min("_id").alias("low"), F.count("*").alias("n"), F.min("print").alias("print"))
    distinct = materialize(distinct.withColumn("fid", F.monotonically_increasing_id()), "distinct-sets")
    near = components(materialize(_candidates(distinct.select("fid", "print"), widest(similarity, SKETCH), shard), "candidates"))
    found = _verified_links(keyed, distinct, near, ngram, similarity, members)
    comp = components(materialize(found, "similar-links"))
    roots = distinct.join(comp, distinct["fid"] == comp["node"], "left").select("set", "fid", "low", "n", F.coalesce("root", "fid").alias("root"))
    by_set = materialize(least_of(roots, "low", "component_id"), "set-components")
    return spread_join(prints.drop("print"), by_set, "set", "n", distinct.agg(F.sum("n")).first()[0] or 0).drop("set")


def _candidates(distinct: DataFrame, radius: int, shard: int) -> DataFrame:
    """(a, b): stars over the fingerprints of each band's value that chains within the radius join."""

    def banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.frombuffer(b"".join(batch.column("print").to_pylist()), np.uint8).reshape(-1, 8 * WORDS)
            key = np.arange(8 * WORDS) << 16 | prints.astype(np.int64) << 8 | np.roll(prints, -1, axis=1)
            words = prints.view("<i8")
            each = lambda x: pa.array(np.repeat(x, 8 * WORDS))
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), each(batch.column("fid").to_numpy()), each(words[:, 0]), each(words[:, 1])], ["key", "fid", "p0", "p1"])

    rows = materialize(map_arrow(distinct, banded, "key bigint, fid bigint, p0 bigint, p1 bigint"), "bands")
    large = materialize(rows.groupBy("key").count().filter(F.col("count") > shard), "large-bands")
    few = rows.join(F.broadcast(large), "key", "left_anti").groupBy("key").agg(F.collect_list(F.struct("fid", "p0", "p1")).alias("m"))
    own = rows.join(F.broadcast(large), "key").withColumn("blocks", F.ceil(F.col("count") / shard).cast("int"))
    own = own.withColumn("at", F.pmod(F.xxhash64("fid"), F.col("blocks")).cast("int")).withColumn("to", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = own.groupBy("key", F.least("at", "to"), F.greatest("at", "to")).agg(F.collect_list(F.struct("fid", "p0", "p1")).alias("m"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, ends = _flat(batch)
            fid = flat.field("fid").to_numpy()
            prints = np.stack([flat.field(f"p{k}").to_numpy() for k in range(SKETCH)], axis=1).view(np.uint64)
            yield _starred(_labelled(fid, prints, ends, radius))

    return map_arrow(few.select("m").unionByName(pairs.select("m")).filter(F.size("m") > 1), run, "a bigint, b bigint")


def small_groups(prints: np.ndarray, radius: int) -> np.ndarray:
    """The labels of ``group`` for many groups of one small size at once: prints (groups, members, words), labels (groups, members)."""
    near = np.bitwise_count(prints[:, :, None] ^ prints[:, None]).sum(axis=-1, dtype=np.int16) <= radius
    label = near.argmax(axis=-1)
    while True:
        least = np.where(near, label[:, None], prints.shape[1]).min(axis=-1)
        if (least == label).all():
            return label
        label = least


def _labelled(fid: np.ndarray, prints: np.ndarray, ends: list[tuple[int, int]], radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(members, labels) of groups: small ones many at once by size, trees for the others."""
    lo, hi = np.array(ends, np.int64).reshape(-1, 2).T
    for n in np.unique(hi - lo).tolist():
        starts = lo[hi - lo == n]
        if n > LEAF:
            yield from ((fid[k : k + n], group(prints[k : k + n], radius)) for k in starts.tolist())
            continue
        step = max(1, BLOCK // (n * n))
        for k in range(0, len(starts), step):
            at = starts[k : k + step, None] + np.arange(n)
            label = small_groups(prints[at], radius)
            moved = np.flatnonzero((label != np.arange(n)).any(axis=1))
            yield from zip(fid[at[moved]], label[moved], strict=True)


def _flat(batch: pa.RecordBatch) -> tuple[pa.StructArray, list[tuple[int, int]]]:
    """All members of a batch's groups, and where each group lies."""
    ends = (np.array(batch.column(0).offsets) - batch.column(0).offsets[0].as_py()).tolist()
    return batch.column(0).flatten(), list(zip(ends[:-1], ends[1:], strict=True))


def _starred(groups) -> pa.RecordBatch:
    """(a, b): each member that is not its label's, with the label's member."""
    a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for fid, label in groups:
        moved = np.flatnonzero(label != np.arange(len(fid)))
        if len(moved):
            a.append(fid[moved])
            b.append(fid[label[moved]])
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])


def verified(prints: np.ndarray, sets: list[np.ndarray], known: np.ndarray, similarity: float) -> np.ndarray:
    """Labels, the least index of each component: sets are linked if similar enough; those of equal ``known`` are linked already."""
    order = np.arange(len(sets))
    _, first, which = np.unique(known, return_index=True, return_inverse=True)
    label, size, radius = first[which], np.array([len(s) for s in sets]), widest(similarity, prints.shape[1])
    for i in order[:-1]:
        rest = slice(i + 1, None)
        small, big = np.minimum(size[rest], size[i]), np.maximum(size[rest], size[i])
        # Both quotients are rounded alike, so no pair at the very bound is lost.
        maybe = (label[rest] != label[i]) & (small / np.maximum(big, 1) >= similarity)
        at = order[rest][maybe]
        at = at[np.bitwise_count(prints[at] ^ prints[i]).sum(axis=1) <= radius]
        for j in at:
            if label[j] == label[i]:
                continue
            common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if common / (size[i] + size[j] - common) >= similarity:
                label[(label == label[i]) | (label == label[j])] = min(label[i], label[j])
    return label


def _verified_links(keyed: DataFrame, distinct: DataFrame, near: DataFrame, ngram: int, similarity: float, members: int) -> DataFrame:
    """(a, b): stars over the verified components of each group of candidates (node, root)."""
    nodes = near.unionByName(near.select(F.col("root").alias("node"), "root").distinct())
    chosen = distinct.join(nodes, distinct["fid"] == nodes["node"]).select("fid", "root", "print", F.col("first._id").alias("_i"), F.col("first._hash").alias("_h"))
    texts = keyed.join(chosen, keyed["_id"].eqNullSafe(chosen["_i"]) & (keyed["_hash"] == chosen["_h"])).select("fid", "root", "print", "_text")

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .units import blocks

        for batch in blocks(batches, "_text"):
            sets = [np.unique(shingle_hashes(t, ngram)).tobytes() for t in batch.column("_text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("fid", "root", "print")), pa.array(sets, pa.binary())], ["fid", "root", "print", "hashes"])

    sets = materialize(map_arrow(texts, shingled, "fid bigint, root bigint, print binary, hashes binary").dropDuplicates(["fid"]), "shingle-sets")
    size = sets.groupBy("root").agg(F.count("*").alias("n"), F.sum(F.length("hashes")).alias("bytes"))
    size = size.select("root", "n", F.greatest(F.ceil(F.col("n") / members), F.ceil(F.col("bytes") / BLOCK_BYTES)).cast("int").alias("blocks"))
    own = spread_join(sets, materialize(size, "group-sizes"), "root", "n", sets.count())
    own = materialize(own.withColumn("at", F.pmod(F.xxhash64("fid"), F.col("blocks")).cast("int")), "dealt-sets")

    # Each block by itself, with the group's first set.
    others = F.explode(F.expr("filter(sequence(0, blocks - 1), x -> x <> at)")).alias("to")
    centre = own.filter("fid = root").select(*[c for c in own.columns if c != "at"], others).withColumnRenamed("to", "at")
    links = materialize(_compared(own.unionByName(centre).withColumn("label", F.col("fid")), ["root", "at"], similarity), "block-links")

    # Pairs of blocks, where a group is still in parts.
    comp = components(links).withColumnRenamed("root", "label")
    wide = own.filter("blocks > 1").join(comp, F.col("fid") == F.col("node"), "left").withColumn("label", F.coalesce("label", "fid")).drop("node")
    wide = materialize(wide, "wide-groups")
    parts = wide.groupBy("root").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("n")).filter("lo <> hi").select("root", "n")
    wide = spread_join(wide, materialize(parts, "groups-in-parts"), "root", "n", wide.count())
    pairs = wide.select("*", others).withColumn("lo", F.least("at", "to")).withColumn("hi", F.greatest("at", "to"))
    return links.unionByName(_compared(pairs, ["root", "lo", "hi"], similarity))


def _compared(rows: DataFrame, keys: list[str], similarity: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, ends = _flat(batch)
            fid, known = flat.field("fid").to_numpy(), flat.field("label").to_numpy()
            prints = np.frombuffer(b"".join(flat.field("print").to_pylist()), "<u8").reshape(len(fid), -1)
            sets = [np.frombuffer(s, "<u8") for s in flat.field("hashes").to_pylist()]
            yield _starred((fid[lo:hi], verified(prints[lo:hi], sets[lo:hi], known[lo:hi], similarity)) for lo, hi in ends)

    groups = rows.groupBy(*keys).agg(F.collect_list(F.struct("fid", "label", "print", "hashes")).alias("m"))
    return map_arrow(groups.filter(F.size("m") > 1).select("m"), run, "a bigint, b bigint")


def keep_one(docs: DataFrame, groups: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group, with all its columns: the smallest id's, of equal ids the smallest text hash's."""
    chosen = groups.groupBy("component_id").agg(F.min(F.struct("_id", "_hash")).alias("k")).select(F.col("k._id").alias("_i"), F.col("k._hash").alias("_h"))
    h = free_name(docs, "_hash")
    once = docs.withColumn(h, F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))).dropDuplicates([id_col, h])
    kept = once.join(chosen, once[id_col].eqNullSafe(chosen["_i"]) & (once[h] == chosen["_h"]), "left_semi")
    return kept.drop(h)
