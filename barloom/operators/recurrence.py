"""Chunked scan for linear recurrences ``y[t] = a*y[t-1] + b[t]``, ``y[-1] = 0``.

Rows of a series are cut into chunks.  Inside a chunk the recurrence has the
closed form ``a**j * sum(b_i * a**-i)``, a running sum.  The value carried into
a chunk is a weighted sum of earlier chunk totals; for ``a < 1`` the weights
fall below one part in 1e20 after a few chunks, for ``a == 1`` the carry is an
exact two-level running sum.  One plan serves any number of recurrences.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tiling import Tiles, drop_halo, running_offset, with_halo


@dataclass
class Rec:
    """One recurrence: output, decay, input term per row (SQL), averaged column."""

    out: str
    decay: float
    term: str
    source: str | None = None

    def reach(self, chunk: int) -> int:
        """Chunks after which a carried value no longer changes a double."""
        if self.decay <= 0:
            return 1
        return max(1, math.ceil(math.log(1e-20) / (chunk * math.log(self.decay))))


def chunk_carries(df: DataFrame, recs: list[Rec], tiles: Tiles) -> DataFrame:
    """Value of each recurrence at the end of the previous chunk."""
    own = drop_halo(df, tiles.size, keep_tile=True)
    sums = own.groupBy("symbol", "_chunk").agg(
        *[F.expr(f"sum(_b_{r.out} * pow({r.decay!r}D, {tiles.chunk - 1} - _at)) AS {r.out}") for r in recs]
    )
    fading = [r for r in recs if r.decay < 1]
    reach = max([r.reach(tiles.chunk) for r in fading], default=1)
    wide = max(4096, reach)
    spread = with_halo(sums, wide, reach, idx="_chunk", tile="_super")
    over = "OVER (PARTITION BY symbol, _super ORDER BY _chunk)"
    cols = []
    for r in fading:
        whole = r.decay**tiles.chunk
        terms = [
            f"coalesce(lag({r.out}, {k}) {over}, 0D) * {whole ** (k - 1)!r}D"
            for k in range(1, r.reach(tiles.chunk) + 1)
        ]
        cols.append(F.expr(" + ".join(terms) + f" AS _c_{r.out}"))
    out = drop_halo(spread.select("symbol", "_chunk", "_super", *cols), wide, idx="_chunk", tile="_super")
    for r in recs:
        if r.decay >= 1:
            part = sums.select("symbol", "_chunk", r.out)
            totals = running_offset(part, ["symbol"], "_chunk", r.out, f"_c_{r.out}")
            out = out.join(totals.drop(r.out), ["symbol", "_chunk"])
    return out


def scan(df: DataFrame, recs: list[Rec], tiles: Tiles) -> DataFrame:
    """Add one column per recurrence to a tiled frame (halo rows included)."""
    keep = df.columns
    df = df.select(
        "*",
        F.expr(f"bar_idx div {tiles.chunk} AS _chunk"),
        F.expr(f"bar_idx % {tiles.chunk} AS _at"),
        *[F.expr(f"coalesce({r.term}, 0D) AS _b_{r.out}") for r in recs],
    )
    per_tile = tiles.size // tiles.chunk
    carries = with_halo(chunk_carries(df, recs, tiles), per_tile, tiles.halo // tiles.chunk, idx="_chunk")
    over = (
        "OVER (PARTITION BY symbol, tile, _chunk ORDER BY bar_idx "
        "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    )
    local = df.select("*", *[F.expr(f"sum(_b_{r.out} * pow({r.decay!r}D, -_at)) {over} AS _s_{r.out}") for r in recs])
    joined = local.join(carries, ["symbol", "tile", "_chunk"], "left")
    outs = [
        F.expr(
            f"pow({r.decay!r}D, _at) * (_s_{r.out} + {r.decay!r}D * coalesce(_c_{r.out}, 0D)) AS {r.out}"
        )
        for r in recs
    ]
    return joined.select(*keep, *outs)
