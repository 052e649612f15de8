"""The trie of conversations' common beginnings, and what its subtrees hold, by an Euler tour.

A node is a distinct sequence of first turns; it is named by its smallest conversation and its depth.
The tour enters and leaves every node once: from a node to its first child, from a child's exit to
the next sibling, from the last one back up. Ranking the tour's arcs as a list gives each its
position and, with the nodes' own values on their entering arcs, prefix sums at these positions; what
a subtree holds is the difference between two of them.

The list is ranked distributedly: arcs lie in blocks by their node's name, each block joins the arcs
that follow each other inside it to segments (pointer doubling over the block), and pointer
jumping over the written table of segments ranks those. Blocks hold about BLOCK nodes, so a list of
up to that size is one segment; order and results don't depend on the blocks.

Sequences are compared by four sums of position-weighted hashes, modulo primes just under 2^31
(about 124 bits). The weights make the sums of a long conversation add up over parts that
different tasks hold, and shift when turns are put before it, so no conversation is
gathered in one task, however long.

Turns are ordered by turn, nulls first; turns that agree in it by a hash of role and text.
Null roles and texts are empty. Rows without a conversation id belong to none and are left out. Repeated rows
are turns of their own. Very long texts are only hashed and counted. An empty table has no nodes.
Columns other than the four named ones don't take part, so their names can't clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .common import map_arrow, spread_join

# Rows that a task orders at once, nodes of a block, conversation ids in a piece of a list.
PART, BLOCK, IDS = 1 << 18, 1 << 18, 4096
# Primes under 2^31 and a base for each.
PRIMES = (2147483647, 2147483629, 2147483587, 2147483579)
BASES = (1103515245, 1664525, 22695477, 1140671485)
SUMS = tuple(f"g{k}" for k in range(4))
WORD = r"[^\x20\x09-\x0D]+"


def power(exponent: Column, prime: int, base: int) -> Column:
    """base ** exponent modulo prime, for exponents from 0 to 2^40."""
    squares = [pow(base, 1 << k, prime) for k in range(40)]
    steps = F.array(*[F.struct(F.lit(1 << k).cast("bigint").alias("bit"), F.lit(s).cast("bigint").alias("by")) for k, s in enumerate(squares)])
    return F.aggregate(steps, F.lit(1).cast("bigint"), lambda acc, s: F.when(exponent.bitwiseAND(s["bit"]) != 0, acc * s["by"] % prime).otherwise(acc))


def powers(exponents: np.ndarray, prime: int, base: int) -> np.ndarray:
    out, square, rest = np.ones(len(exponents), np.int64), base, exponents.copy()
    while rest.any():
        out = np.where(rest & 1, out * square % prime, out)
        square, rest = square * square % prime, rest >> 1
    return out


def numbered_turns(turns: DataFrame, part_rows: int = PART) -> DataFrame:
    """(conv_id, part, place, run, words, g0..g3): each turn with its place among those of its conversation in its part, how many
    these are, and the weighted sums up to it, as a written table.

    Parts divide all turns in order, a long conversation among several.
    """
    h = [F.xxhash64(F.lit(k), "role", "text") for k in (1, 2)]
    rows = turns.filter("conv_id is not null").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").alias("turn"), F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = materialize(rows.select("conv_id", "turn", h[0].alias("h1"), h[1].alias("h2"), F.regexp_count("text", F.lit(WORD)).alias("words")), "turns")
    parts = max(1, -(-rows.count() // part_rows))
    ranged = rows.repartitionByRange(parts, F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("h1"), F.col("h2"))
    ranged = ranged.sortWithinPartitions(F.col("conv_id"), F.col("turn").asc_nulls_first(), "h1", "h2").withColumn("part", F.spark_partition_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = list(batches)
        if not batches:
            return
        rows = pa.Table.from_batches(batches).combine_chunks()
        conv, h1, h2 = (rows[c].to_numpy() for c in ("conv_id", "h1", "h2"))
        if not len(conv):
            return
        first = np.flatnonzero(np.concatenate([[True], conv[1:] != conv[:-1]]))
        sizes = np.diff(np.concatenate([first, [len(conv)]]))
        place = np.arange(len(conv)) - np.repeat(first, sizes)
        halves = [h1 & 0xFFFFFFFF, h1 >> 32 & 0xFFFFFFFF, h2 & 0xFFFFFFFF, h2 >> 32 & 0xFFFFFFFF]
        sums = []
        for half, prime, base in zip(halves, PRIMES, BASES, strict=True):
            total = np.cumsum(half % prime * powers(place, prime, base) % prime)
            before = np.concatenate([[0], total])[first]
            sums.append((total - np.repeat(before, sizes)) % prime)
        yield pa.RecordBatch.from_arrays(
            [pa.array(conv), rows["part"].combine_chunks(), pa.array(place), pa.array(np.repeat(sizes, sizes)), rows["words"].combine_chunks(), *map(pa.array, sums)],
            ["conv_id", "part", "place", "run", "words", *SUMS])

    schema = "conv_id bigint, part int, place bigint, run bigint, words int, " + ", ".join(f"{g} bigint" for g in SUMS)
    return materialize(map_arrow(ranged, run, schema), "numbered-turns")


def rebuilt(turns: DataFrame, own_after: Column, base_of: Column, part_rows: int = PART) -> DataFrame:
    """(conv_id, depth, words, last, g0..g3, p0..p3): every prefix of every rebuilt conversation, the root with it, as a written table.

    A conversation takes the first ``own_after`` turns of the conversation ``base_of`` (columns over conv_id, at most three turns) and then its own after
    that many. g are its prefix's sums and p those of the prefix before; ``last`` marks its whole length.
    """
    rows = numbered_turns(turns, part_rows)
    runs = rows.filter("place = run - 1").select("conv_id", "part", "run", *SUMS)
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("offset", F.coalesce(F.sum("run").over(before), F.lit(0)))
    shifted = [(F.when(F.col("offset") == 0, F.col(g)).otherwise(F.col(g) * power(F.col("offset"), p, b) % p)).alias(g) for g, p, b in zip(SUMS, PRIMES, BASES, strict=True)]
    runs = runs.select("conv_id", "part", "run", "offset", *shifted)
    runs = runs.select("conv_id", "part", "offset", F.sum("run").over(Window.partitionBy("conv_id")).alias("turns"),
                       *[(F.coalesce(F.sum(g).over(before), F.lit(0)) % p).alias(f"in{k}") for k, (g, p) in enumerate(zip(SUMS, PRIMES, strict=True))])
    runs = materialize(runs, "runs")

    # A run with an offset is the first of its part, so these are fewer than the parts.
    later = F.broadcast(runs.filter("offset > 0").select("conv_id", "part", "offset", *[f"in{k}" for k in range(4)]))
    whole = lambda g, k, p, b: ((F.coalesce(F.col(f"in{k}"), F.lit(0)) + F.when(F.coalesce("offset", F.lit(0)) == 0, F.col(g)).otherwise(F.col(g) * power(F.col("offset"), p, b) % p)) % p)
    sums = [whole(g, k, p, b).alias(g) for k, (g, p, b) in enumerate(zip(SUMS, PRIMES, BASES, strict=True))]
    placed = rows.join(later, ["conv_id", "part"], "left").select("conv_id", "part", (F.coalesce("offset", F.lit(0)) + F.col("place")).alias("at"), "words", *sums)
    heads = placed.filter("at < 3").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("at", "words", *SUMS))).alias("head"))
    heads = materialize(heads, "heads")

    convs = heads.select("conv_id", "head", own_after.alias("after"), base_of.alias("base"))
    bases = heads.select(F.col("conv_id").alias("base"), F.col("head").alias("base_head"))
    taken = F.slice(F.coalesce("base_head", F.array().cast(dict(heads.dtypes)["head"])), 1, F.col("after"))
    convs = convs.join(bases, "base", "left").select("conv_id", "after", taken.alias("taken"), F.when(F.col("after") > 0, F.get("head", F.least("after", F.size("head")) - 1)).alias("cut"))
    convs = materialize(convs, "conversations")

    # Own turns: the part and the conversation together are never hot.
    info = runs.join(convs.select("conv_id", "after", F.size("taken").alias("m"), "cut", F.get("taken", F.size("taken") - 1).alias("lead")), "conv_id")
    own = rows.join(info.select("conv_id", "part", "offset", "turns", "after", "m", "cut", "lead", *[f"in{k}" for k in range(4)]), ["conv_id", "part"])
    own = own.withColumn("at", F.col("offset") + F.col("place")).filter("at >= after")
    step = (F.col("m") - F.col("after")).cast("int")
    columns = []
    for k, (g, p, b) in enumerate(zip(SUMS, PRIMES, BASES, strict=True)):
        back = F.element_at(F.array(*[F.lit(pow(b, -s, p)).cast("bigint") for s in range(4)]), 1 - step)
        after_cut = (whole(g, k, p, b) + p - F.coalesce(F.col("cut")[g], F.lit(0))) % p
        columns.append(((F.coalesce(F.col("lead")[g], F.lit(0)) + after_cut * back) % p).alias(g))
    own = own.select("conv_id", (F.col("at") + step + 1).cast("int").alias("depth"), "words", (F.col("at") == F.col("turns") - 1).alias("last"), *columns)

    zero = [F.lit(0).cast("bigint").alias(g) for g in SUMS]
    ends = convs.join(runs.filter("offset = 0").select("conv_id", "turns"), "conv_id").withColumn("short", F.col("turns") <= F.col("after"))
    root = F.struct(F.lit(-1).cast("bigint").alias("at"), F.lit(0).alias("words"), *zero)
    given = ends.select("conv_id", "short", F.size("taken").alias("m"), F.inline(F.concat(F.array(root), "taken")))
    given = given.select("conv_id", (F.col("at") + 1).cast("int").alias("depth"), "words", (F.col("short") & (F.col("at") + 1 == F.col("m"))).alias("last"), *SUMS)
    return materialize(own.unionByName(given), "prefixes")


def trie(turns: DataFrame, own_after: Column, base_of: Column, part_rows: int = PART, block: int = BLOCK) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    prefixes = rebuilt(turns, own_after, base_of, part_rows)
    key = F.struct("depth", *SUMS)
    members = prefixes.groupBy(key.alias("key")).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("words").alias("words"))
    nodes = materialize(members, "nodes")
    # The prefix before a node's is found through its smallest member.
    up = prefixes.select((F.col("depth") + 1).alias("depth"), "conv_id", key.alias("parent"))
    named = nodes.select("key", "conv_id", F.col("key.depth").alias("depth"), "n_convs", "words")
    linked = materialize(named.join(up, ["conv_id", "depth"], "left"), "linked-nodes")
    kids = linked.filter("parent is not null").groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("n_children"), F.min("conv_id").alias("first_child"))
    parents = materialize(kids.join(nodes.select("key", F.col("conv_id").alias("parent_conv_id")), "key"), "parents")
    total = linked.count()
    below = spread_join(linked.withColumn("child", F.col("key")).drop("key").withColumnRenamed("parent", "key"), parents.select("key", "parent_conv_id", "n_children"), "key", "n_children", total, "left")
    inner = parents.select(F.col("key").alias("child"), "n_children", "first_child")
    whole = below.drop("key").join(inner, "child", "left").join(end_digests(prefixes), "child", "left")
    blocks = max(1, -(-total // block))
    whole = whole.drop("child").repartitionByRange(blocks, "conv_id", "depth").withColumn("block", F.spark_partition_id())
    whole = materialize(whole, "blocks")
    sums = subtree_sums(with_siblings(whole), blocks)
    none = F.sha2(F.lit(""), 256)
    return sums.select("conv_id", F.col("depth").cast("bigint").alias("depth"), "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("bigint").alias("n_children"),
                       "n_leaves", "saved_tokens", F.coalesce(F.lower(F.hex("digest")), none).alias("ends_sha256"))


def end_digests(prefixes: DataFrame) -> DataFrame:
    """(child, digest): SHA-256 over the ordered ids of the conversations that end in a node.

    The digest is sequential by definition. Ids are ordered and joined to text in pieces of at most IDS; a task then streams
    a node's pieces through the digest and never holds more than one.
    """
    pieces = prefixes.filter("last").groupBy(F.struct("depth", *SUMS).alias("child"), F.expr(f"conv_id div {IDS} - if(conv_id < 0 and conv_id % {IDS} <> 0, 1, 0)").alias("piece"))
    pieces = pieces.agg(F.sort_array(F.collect_list("conv_id")).alias("ids")).select("child", "piece", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))
    kind = dict(pieces.dtypes)["child"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        child, state = None, None
        for batch in batches:
            own, done = batch.column("child").to_pylist(), []
            for key, ids in zip(own, batch.column("ids").to_pylist(), strict=True):
                if key == child:
                    state.update(b"," + ids.encode())
                else:
                    if state is not None:
                        done.append((child, state.digest()))
                    child, state = key, hashlib.sha256(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], batch.schema.field("child").type), pa.array([d for _, d in done], pa.binary())], ["child", "digest"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([child], batch.schema.field("child").type), pa.array([state.digest()], pa.binary())], ["child", "digest"])

    return map_arrow(pieces.repartition("child").sortWithinPartitions("child", "piece"), run, f"child {kind}, digest binary")


def with_siblings(nodes: DataFrame) -> DataFrame:
    """The nodes with ``sibling``: the next child of their parent by conv_id. No task gathers a parent's children, but those of one block."""
    family = ["parent_conv_id", "depth"]
    inside = Window.partitionBy(*family, "block").orderBy("conv_id")
    own = nodes.withColumn("sibling", F.lead("conv_id").over(inside))
    firsts = nodes.groupBy(*family, "block").agg(F.min("conv_id").alias("first"))
    after = firsts.withColumn("after", F.lead("first").over(Window.partitionBy(*family).orderBy("block"))).filter("after is not null and parent_conv_id is not null").drop("first")
    return own.join(after, [*family, "block"], "left").withColumn("sibling", F.coalesce("sibling", "after")).drop("after")


def contract(conv: np.ndarray, depth: np.ndarray, nexts: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], values: np.ndarray):
    """Arcs of some nodes as segments. Arc 2i enters node i, arc 2i + 1 leaves it; ``nexts`` are (conv, depth, side, exists) of what follows.

    (head of each arc, sums over the segment before each arc, tails): ``tails`` are the last arcs of the segments; values go with entering arcs.
    """
    n = len(conv)
    names, rank = np.unique(conv, return_inverse=True)
    deepest = int(max(depth.max(), max(d.max() for _, d, _, _ in nexts))) + 1
    code = rank * deepest + depth
    order = np.argsort(code, kind="stable")
    code = code[order]
    follow = np.full(2 * n, -1)
    for side, (c, d, leaves, exists) in enumerate(nexts):
        r = np.minimum(np.searchsorted(names, c), len(names) - 1)
        want = r * deepest + d
        at = np.minimum(np.searchsorted(code, want), n - 1)
        inside = exists & (names[r] == c) & (code[at] == want)
        follow[side::2] = np.where(inside, 2 * order[at] + leaves, -1)
    came = np.full(2 * n, -1)
    came[follow[follow >= 0]] = np.flatnonzero(follow >= 0)
    own = np.zeros((2 * n, 3), np.int64)
    own[:, 0] = 1
    own[0::2, 1:] = values
    # Pointer doubling towards the heads: sums over what lies before an arc.
    before = np.where((came >= 0)[:, None], own[came], 0)
    head, jump = np.where(came >= 0, came, np.arange(2 * n)), came
    while (jump >= 0).any():
        far = np.maximum(jump, 0)
        before = before + np.where((jump >= 0)[:, None], before[far], 0)
        head = np.where(jump >= 0, head[far], head)
        jump = np.where(jump >= 0, jump[far], -1)
    return head, before, np.flatnonzero(follow < 0), own


def subtree_sums(nodes: DataFrame, blocks: int) -> DataFrame:
    """The nodes with n_leaves and saved_tokens of their subtrees, by ranking the Euler tour."""
    arc = "struct<c: bigint, d: int, x: boolean>"
    wanted = nodes.select("block", "conv_id", "depth", "parent_conv_id", "first_child", "sibling",
                          F.when(F.col("n_children").isNull(), 1).otherwise(0).cast("bigint").alias("leaf"), ((F.col("n_convs") - 1) * F.col("words")).cast("bigint").alias("saved"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = [b for b in batches if len(b)]
        if not batches:
            return
        rows = pa.Table.from_batches(batches).combine_chunks()
        conv, depth = rows["conv_id"].to_numpy(), rows["depth"].to_numpy().astype(np.int64)
        filled = lambda c: (rows[c].is_valid().to_numpy(), rows[c].fill_null(0).to_numpy())
        (inner, child), (has_next, sibling), (has_parent, parent) = map(filled, ("first_child", "sibling", "parent_conv_id"))
        yes = np.ones(len(conv), bool)
        enter = (np.where(inner, child, conv), np.where(inner, depth + 1, depth), ~inner, yes)
        leave = (np.where(has_next, sibling, parent), np.where(has_next, depth, depth - 1), ~has_next, has_next | has_parent)
        head, before, tails, own = contract(conv, depth, [enter, leave], np.column_stack([rows["leaf"].to_numpy(), rows["saved"].to_numpy()]))
        named = lambda arcs: pa.StructArray.from_arrays([pa.array(conv[arcs // 2]), pa.array(depth[arcs // 2].astype(np.int32)), pa.array(arcs % 2 == 1)], ["c", "d", "x"])
        total = before[tails] + own[tails]
        c, d, x, exists = (np.where(tails % 2 == 0, e[tails // 2], f[tails // 2]) for e, f in zip(enter, leave, strict=True))
        after = pa.StructArray.from_arrays([pa.array(c), pa.array(d.astype(np.int32)), pa.array(x.astype(bool))], ["c", "d", "x"], mask=pa.array(~exists.astype(bool)))
        segments = pa.StructArray.from_arrays([named(head[tails]), after, *[pa.array(total[:, k]) for k in range(3)]], ["head", "next", "arcs", "leaves", "saved"])
        # A row per node; a row's list carries the segments whose last arc is one of the node's.
        per_node = np.bincount(tails // 2, minlength=len(conv))
        ends = pa.array(np.concatenate([[0], np.cumsum(per_node)]).astype(np.int32))
        e, f = before[0::2], before[1::2]
        yield pa.RecordBatch.from_arrays(
            [pa.array(conv), pa.array(depth.astype(np.int32)), named(head[0::2]), named(head[1::2]), *[pa.array(v[:, k]) for v in (e, f) for k in (1, 2)], pa.ListArray.from_arrays(ends, segments)],
            ["conv_id", "depth", "enter", "leave", "e_leaves", "e_saved", "l_leaves", "l_saved", "segments"])

    schema = (f"conv_id bigint, depth int, enter {arc}, leave {arc}, e_leaves bigint, e_saved bigint, l_leaves bigint, l_saved bigint, "
              f"segments array<struct<head: {arc}, next: {arc}, arcs: bigint, leaves: bigint, saved: bigint>>")
    local = materialize(map_arrow(wanted.repartition(blocks, "block"), run, schema), "arcs")
    ranked = rank(local.select(F.inline("segments")))
    # A segment is no longer than a block's arcs, which bounds what one of its keys brings to a task.
    from_end = lambda end: ranked.select(F.col("head").alias(end), F.col("leaves").alias(f"{end}_leaves"), F.col("saved").alias(f"{end}_saved"))
    placed = local.drop("segments").join(from_end("enter"), "enter").join(from_end("leave"), "leave")
    inside = placed.select("conv_id", "depth", *[((F.col(f"enter_{v}") - F.col(f"e_{v}")) - (F.col(f"leave_{v}") - F.col(f"l_{v}"))).alias(out) for v, out in (("leaves", "n_leaves"), ("saved", "saved_tokens"))])
    return nodes.join(inside, ["conv_id", "depth"])


def rank(segments: DataFrame) -> DataFrame:
    """(head, arcs, leaves, saved): sums from each segment to the end of the list, by pointer jumping over written tables."""
    segments = materialize(segments, "segments")
    while segments.filter("next is not null").limit(1).count():
        far = segments.select(F.col("head").alias("next"), F.col("next").alias("_next"), *[F.col(v).alias(f"_{v}") for v in ("arcs", "leaves", "saved")])
        open_ends = segments.filter("next is not null").join(far, "next")
        moved = open_ends.select("head", F.col("_next").alias("next"), *[(F.col(v) + F.col(f"_{v}")).alias(v) for v in ("arcs", "leaves", "saved")])
        segments = materialize(moved.unionByName(segments.filter("next is null")), "segments")
    return segments.drop("next")
