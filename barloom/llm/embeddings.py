"""Near-duplicate vectors by p-stable hashing.

Normalised vectors are projected on Gaussian directions and quantised: floor((a . x + b) / width). Each of
``tables`` keys joins ``projections`` of them. Vectors of one label that share a key are compared
by their exact cosine in double precision. Two unit vectors at cosine t are sqrt(2 - 2t) apart, which gives
the chance of a shared value, and the number of tables for a wanted recall at the threshold itself; pairs above it are
found more surely still.

Equal vectors of a label are one class, with a count. A pair of classes is counted in the first table
where its keys agree only, and a bucket gives a row per linked class and a star, never its pairs. Buckets over
BLOCK classes are dealt out in pairs of blocks.

Rows link with nothing if the label or vector is null, or the vector is empty, zero or holds null, NaN or infinite parts. Vectors of
different lengths don't link. Repeated ids are rows of their own. Empty tables give empty results.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import components, least_of, map_arrow, spread_join

BLOCK = 2048
SEED = 20


def agreement(distance: float, width: float) -> float:
    """Chance that one quantised projection agrees for vectors so far apart."""
    r = width / distance
    return math.erf(r / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def tables_for(threshold: float, projections: int, width: float, recall: float) -> int:
    hit = agreement(math.sqrt(2 - 2 * threshold), width) ** projections
    return math.ceil(math.log(1 - recall) / math.log(1 - hit))


def unit(vectors: np.ndarray) -> np.ndarray:
    scale = np.abs(vectors).max(axis=1, keepdims=True)
    v = vectors / scale
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def keyed(classes: DataFrame, projections: int, tables: int, width: float) -> DataFrame:
    """The classes with ``keys``, a 32-bit key per table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, tuple] = {}
        for batch in batches:
            col = batch.column("vec")
            sizes = np.diff(np.array(col.offsets))
            keys = np.zeros((len(batch), tables), np.int32)
            for d in np.unique(sizes):
                if d not in made:
                    rng = np.random.default_rng([SEED, int(d)])
                    made[d] = rng.normal(size=(int(d), projections * tables)), rng.uniform(0, width, projections * tables), rng.integers(1, 1 << 62, projections, dtype=np.uint64) | np.uint64(1)
                a, b, mix = made[d]
                rows = np.flatnonzero(sizes == d)
                cells = np.floor((unit(matrix(col.take(pa.array(rows)))) @ a + b) / width).astype(np.int64).astype(np.uint64)
                mixed = (cells.reshape(len(rows), tables, projections) * mix).sum(axis=2)
                keys[rows] = (mixed >> np.uint64(32)).astype(np.uint32).view(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, tables, dtype=np.int32)), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], [*batch.schema.names, "keys"])

    schema = ", ".join(f"{c} {t}" for c, t in classes.dtypes)
    return map_arrow(classes, run, f"{schema}, keys array<int>")


def compare(cid, n, vec, keys, side, table, threshold):
    """(links, label) per class: how many vectors it links to, and the least class of its local group."""
    links, label = np.zeros(len(cid), np.int64), np.arange(len(cid))
    v = unit(vec)
    same = (side == side[0]).all()
    left = np.arange(len(cid)) if same else np.flatnonzero(side == side.min())
    right = left if same else np.flatnonzero(side != side.min())
    for lo in range(0, len(left), 256):
        rows = left[lo : lo + 256]
        near = v[rows] @ v[right].T >= threshold
        near &= rows[:, None] != right[None, :]
        for t in range(table):
            if not near.any():
                break
            near &= keys[rows, t][:, None] != keys[right, t][None, :]
        if not near.any():
            continue
        links[rows] += near @ n[right]
        if not same:
            links[right] += n[rows] @ near
        for k in np.flatnonzero(near.any(axis=1)):
            group = np.append(right[near[k]], rows[k])
            labels = label[group]
            if (labels != labels[0]).any():
                label[np.isin(label, labels)] = labels.min()
    return links, label


def _compared(groups: DataFrame, threshold: float) -> DataFrame:
    """(cid, links, root) of (table, members) rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tables, lists = batch.column("table").to_numpy(), batch.column("members")
            flat, ends = lists.flatten(), np.array(lists.offsets) - lists.offsets[0].as_py()
            cid, n, side = (flat.field(f).to_numpy(zero_copy_only=False) for f in ("cid", "n", "side"))
            out: tuple[list, ...] = ([], [], [])
            for table, lo, hi in zip(tables.tolist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                part = flat.slice(lo, hi - lo)
                vec, keys = matrix(part.field("vec")), matrix(part.field("keys")).astype(np.int64)
                links, label = compare(cid[lo:hi], n[lo:hi], vec, keys, side[lo:hi], table, threshold)
                linked = np.flatnonzero(links)
                for o, x in zip(out, (cid[lo:hi][linked], links[linked], cid[lo:hi][label[linked]]), strict=True):
                    o.append(x)
            arrays = [pa.array(np.concatenate(o) if o else np.empty(0, np.int64)) for o in out]
            yield pa.RecordBatch.from_arrays(arrays, ["cid", "links", "root"])

    return map_arrow(groups, run, "cid bigint, links bigint, root bigint")


def near_links(classes: DataFrame, threshold: float, tables: int) -> DataFrame:
    """(cid, links, root) per bucket of keyed classes."""
    bucket = ["label", "dim", "table", "key"]
    light = classes.select("label", "dim", F.posexplode("keys").alias("table", "key"))
    large = materialize(light.groupBy(bucket).count().filter(F.col("count") > BLOCK), "large-buckets")
    many = large.count()
    rows = classes.select("label", "dim", F.posexplode("keys").alias("table", "key"), "cid", "n", "vec", "keys")
    member = lambda side: F.struct("cid", "n", "vec", "keys", side.alias("side"))
    hint = F.broadcast if many <= 20_000 else lambda x: x
    small = rows.join(hint(large.select(bucket)), bucket, "left_anti") if many else rows
    members = small.groupBy(bucket).agg(F.collect_list(member(F.lit(0))).alias("members"))
    found = _compared(members.filter(F.size("members") > 1).select("table", "members"), threshold)
    if not many:
        return found
    blocks = F.ceil(F.col("count") / BLOCK).cast("int")
    own = rows.join(hint(large), bucket).withColumn("blocks", blocks).withColumn("side", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    dealt = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("lo", F.least("side", "other")).withColumn("hi", F.greatest("side", "other"))
    pairs = dealt.groupBy(*bucket, "lo", "hi").agg(F.collect_list(member(F.col("side"))).alias("members"))
    # A pair of different blocks needs rows of both; one block alone holds its own pairs.
    both = pairs.filter((F.col("lo") == F.col("hi")) | (F.size(F.array_distinct(F.transform("members", lambda m: m["side"]))) > 1))
    return found.unionByName(_compared(both.select("table", "members"), threshold))


def near_vectors(rows: DataFrame, threshold: float = 0.98, projections: int = 8, width: float = 1.5, recall: float = 0.9999,
                 id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id, n_links, component_id, kept) for every row."""
    e = F.col(vec_col)
    fine = F.coalesce(F.col(label_col).isNotNull() & (F.size(e) > 0) & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0), F.lit(False))
    digest = F.when(fine, F.sha1(F.concat_ws("|", F.col(label_col).cast("string"), F.array_join(e.cast("array<string>"), ","))))
    base = materialize(rows.select(F.col(id_col).alias("_id"), F.col(label_col).alias("label"), e.alias("vec"), digest.alias("digest")), "vectors")
    good = base.filter("digest is not null")
    classes = good.groupBy("digest").agg(F.min("_id").alias("low"), F.count("*").alias("n"), F.first("label").alias("label"), F.first("vec").alias("vec"))
    tables = tables_for(threshold, projections, width, recall)
    classes = materialize(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    coded = materialize(keyed(classes.select("cid", "n", "label", F.size("vec").alias("dim"), "vec"), projections, tables, width), "keyed-classes")
    links = materialize(near_links(coded, threshold, tables), "vector-links")
    sums = links.groupBy("cid").agg(F.sum("links").alias("links"))
    comp = components(links.select(F.col("cid").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "cid")
    known = classes.select("digest", "cid", "n", "low").join(sums, "cid", "left").join(comp, "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    known = least_of(known, "low", "component_id").select("digest", "n", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).cast("bigint").alias("n_links"), "component_id")
    total = classes.agg(F.sum("n")).first()[0] or 0
    out = spread_join(good.select("_id", "digest"), materialize(known, "class-components"), "digest", "n", total).select("_id", "n_links", "component_id")
    alone = base.filter("digest is null").select("_id", F.lit(0).cast("bigint").alias("n_links"), F.col("_id").alias("component_id"))
    return out.unionByName(alone).select(F.col("_id").alias(id_col), "n_links", "component_id", F.col("_id").eqNullSafe(F.col("component_id")).alias("kept"))
