"""Which rows are accepted when that depends on how many rows before them were.

Both rules below read the number of rows accepted so far, of all keys, so they are sequential: one row more or less moves every later
decision of ``novelty``, so guesses of the accepted rows settle only slowly, from the front on. Rows are cut into
tiles of bounded size along the order. A tile is one pass of one task, from the state that the tile before it wrote; the state is bounded by
the window. No task sees more than a tile, and no row is passed over a second time unless a guess of a tile's first state was wrong.

Where the state is soon forgotten (``recent_distinct``), all tiles run at once, each from the state that the rows before it leave behind. A tile
whose state is not the one that the tile before it ended with runs again, so the result is that of a row-by-row pass in any case.
"""

from __future__ import annotations

import hashlib
import sys
import uuid
from collections import deque
from collections.abc import Callable

import pandas as pd
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize, shared_folder
from .selection import runs
from .tiling import running_offset

# Ship this module's functions by value: executors need no copy of the package.
register_pickle_by_value(sys.modules[__name__])

# A part is a range of the order; a tile is about so many parts of rows, and a guess reads about so many parts before it.
PART_ROWS, TILE_PARTS, GUESS_PARTS = 65536, 8, 2
# Rows of a tile as its task reads them, in this order.
STATE, BEFORE, OWN = 0, 1, 2
RESULT = "tile long, kind string, at long, key string, n long"


class Recent:
    """The keys of the last ``window`` accepted rows."""

    def __init__(self, window: int):
        self.window, self.recent, self.held = window, deque(), set()

    def load(self, keys: list, counts: list) -> None:
        self.recent, self.held = deque(keys), set(keys)

    def state(self) -> tuple[list, list]:
        return list(self.recent), [0] * len(self.recent)

    def accepted(self, keys: list) -> list[int]:
        window, recent, held, taken = self.window, self.recent, self.held, []
        for i, key in enumerate(keys):
            if key not in held:
                taken.append(i)
                recent.append(key)
                held.add(key)
                if len(recent) > window:
                    held.discard(recent.popleft())
        return taken


class Novel:
    """Accepted rows by family and their total, halved together when the total passes twice the window."""

    def __init__(self, keep: int, window: int):
        self.keep, self.window, self.counts, self.total = keep, window, {}, 0

    def load(self, keys: list, counts: list) -> None:
        self.total, self.counts = counts[0], dict(zip(keys[1:], counts[1:], strict=True))

    def state(self) -> tuple[list, list]:
        return [None, *self.counts], [self.total, *self.counts.values()]

    def accepted(self, keys: list) -> list[int]:
        keep, most, counts, total, taken = self.keep, 2 * self.window, self.counts, self.total, []
        for i, key in enumerate(keys):
            count = counts.get(key, 0)
            if count < keep:
                counts[key] = count + 1
                total += 1
                taken.append(i)
                if total > most:
                    # At most twice the window of families have a count.
                    counts, total = {k: n >> 1 for k, n in counts.items() if n > 1}, total >> 1
        self.counts, self.total = counts, total
        return taken


def _digest(scan) -> str:
    return hashlib.blake2b(repr(scan.state()).encode(), digest_size=16).hexdigest()


def _scanned(new: Callable[[], Recent | Novel]):
    """Pass the rows of whole tiles, sorted by (tile, role, at), through a scan: accepted rows, the state at the end, digests of both states."""

    def result(tile, kind, at, keys=None, counts=None):
        size = len(at)
        columns = {"tile": [tile] * size, "kind": [kind] * size, "at": at, "key": keys or [None] * size, "n": counts or [0] * size}
        return pd.DataFrame(columns).astype({"tile": "int64", "at": "int64", "n": "int64", "key": "object"})

    def finish(tile, scan, first):
        keys, counts = scan.state()
        yield result(tile, "state", list(range(len(keys))), keys, counts)
        yield result(tile, "came", [0], [first])
        yield result(tile, "left", [0], [_digest(scan)])

    def run(batches):
        tile = scan = first = None
        for pdf in batches:
            if not len(pdf):
                continue
            for piece, edges in runs([pdf], ["tile", "role"]):
                for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                    own, role = int(piece["tile"].iat[lo]), int(piece["role"].iat[lo])
                    if own != tile:
                        if scan is not None:
                            yield from finish(tile, scan, first or _digest(scan))
                        tile, scan, first, held = own, new(), None, ([], [])
                    keys = [None if k is None or k != k else k for k in piece["key"].iloc[lo:hi].tolist()]
                    if role == STATE:
                        held[0].extend(keys)
                        held[1].extend(piece["n"].iloc[lo:hi].tolist())
                        continue
                    if held[1]:
                        scan.load(*held)
                        held = ([], [])
                    if role == OWN and first is None:
                        first = _digest(scan)
                    taken = scan.accepted(keys)
                    if role == OWN and taken:
                        at = piece["at"].iloc[lo:hi].to_numpy()[taken]
                        yield result(tile, "taken", at)
        if scan is not None:
            yield from finish(tile, scan, first or _digest(scan))

    return run


def _tiled(df: DataFrame, key: str, order: str, guess: bool) -> DataFrame:
    """Rows as a written table by tile; with ``guess``, the last rows before a tile lie in it too."""
    rows = df.select(F.col(order).cast("long").alias("at"), F.col(key).cast("string").alias("key")).filter("at IS NOT NULL").withColumn("_part", F.expr(f"at div {PART_ROWS}"))
    sizes = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).withColumn("_all", F.lit(0))
    size = PART_ROWS * TILE_PARTS
    of = running_offset(sizes, ["_all"], "_part", "_n", "_off").select("_part", F.expr(f"_off div {size}").alias("tile"), F.expr(f"(_off + {PART_ROWS * GUESS_PARTS}) div {size}").alias("_next"))
    rows = rows.join(of, "_part")
    if guess:
        roles = F.expr(f"CASE WHEN _next > tile THEN array(struct(tile, {OWN} AS role), struct(_next AS tile, {BEFORE} AS role)) ELSE array(struct(tile, {OWN} AS role)) END")
        rows = rows.withColumn("_r", F.explode(roles)).select("at", "key", "_r.role", "_r.tile")
    else:
        rows = rows.select("at", "key", F.lit(OWN).alias("role"), "tile")
    return materialize(rows.repartition("tile").sortWithinPartitions("tile", "role", "at"), "tiles", by=["tile"])


def accept(df: DataFrame, key: str, order: str, new: Callable[[], Recent | Novel], guess: bool) -> DataFrame:
    """Rows that a pass in ``order`` through ``new()`` accepts, see the module's text."""
    spark, rows, scan = df.sparkSession, _tiled(df, key, order, guess), _scanned(new)
    folder = f"{shared_folder(spark)}/barloom/accepted-{uuid.uuid4().hex}"
    read = lambda *parts: spark.read.schema(RESULT).parquet(*[f"{folder}/{p}" for p in parts])
    last = rows.agg(F.max("tile")).first()[0]
    again, came, left = [], {}, {}
    if guess:
        rows.select("tile", "role", "at", "key", F.lit(0).cast("long").alias("n")).repartition("tile").sortWithinPartitions("tile", "role", "at").mapInPandas(scan, RESULT).write.parquet(f"{folder}/all")
        for r in read("all").filter("kind IN ('came', 'left')").collect():
            (came if r.kind == "came" else left)[r.tile] = r.key
    for tile in range(0 if last is None else last + 1):
        if guess and (tile == 0 or came.get(tile) == left.get(tile - 1)):
            continue
        own = rows.filter((F.col("tile") == tile) & (F.col("role") == OWN)).select("tile", "role", "at", "key", F.lit(0).cast("long").alias("n"))
        if tile:
            state = read(tile - 1 if tile - 1 in again else "all").filter((F.col("tile") == tile - 1) & (F.col("kind") == "state"))
            own = state.select(F.lit(tile).cast("long").alias("tile"), F.lit(STATE).alias("role"), "at", "key", "n").unionByName(own)
        own.coalesce(1).sortWithinPartitions("tile", "role", "at").mapInPandas(scan, RESULT).write.parquet(f"{folder}/{tile}")
        again.append(tile)
        if guess:
            left[tile] = read(tile).filter("kind = 'left'").first().key
    taken = [read("all").filter(~F.col("tile").isin(again))] if guess else []
    taken += [read(*again)] if again else []
    if not taken:
        return df.limit(0)
    at = taken[0] if len(taken) == 1 else taken[0].unionByName(taken[1])
    # Written small, but as many rows as the input may have: not to be broadcast.
    return df.join(at.filter("kind = 'taken'").select(F.col("at").alias(order)).hint("merge"), order, "left_semi")


def recent_distinct(df: DataFrame, key: str, order: str, window: int = 1000) -> DataFrame:
    """Rows whose key none of the last ``window`` accepted rows has. ``order``: distinct long integers, not far apart."""
    return accept(df, key, order, lambda: Recent(window), True)


def novelty(df: DataFrame, family: str, order: str, keep: int = 6, window: int = 5000) -> DataFrame:
    """Rows whose family counts fewer than ``keep`` accepted rows; all counts halve when the accepted rows, halved with them, pass twice the window.

    ``order``: distinct long integers, not far apart.
    """
    return accept(df, family, order, lambda: Novel(keep, window), False)
