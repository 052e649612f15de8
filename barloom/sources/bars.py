"""Bars: reading, building, cleaning, numbering, slicing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from ..operators.tiling import Tiles, number_rows, with_halo, drop_halo, tile_window

HOUR_MS = 3_600_000
DAY_MS = 86_400_000

PRICE = ["open", "high", "low", "close"]
BAR_COLUMNS = [
    "symbol", "bar_idx", "open_ms", "close_ms", "open", "high", "low", "close",
    "volume", "quote_volume", "trades", "taker_base", "taker_quote", "src_row",
]

# The bar file layout.
KLINE_FIELDS = [
    "open_time", "open", "high", "low", "close", "volume",
    "close_time", "quote_volume", "trades", "taker_base", "taker_quote",
]
KLINE_TIME_FORMAT = "yyyy-MM-dd HH:mm:ssXXX"


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def build_bars(
    rows: DataFrame,
    symbol: Column,
    time_us: Column,
    key: Column,
    price: Column,
    volume: Column,
    width_ms: int,
    columns: list[str] | None = None,
) -> DataFrame:
    """Aggregate raw trades/events into bars, one per symbol and time bucket.

    First and last price order by (time, key).  The order key is one decimal so
    that every buffer has a fixed width and the aggregate stays hash-based with
    map-side combine.
    """
    base = rows.select(
        symbol.cast("string").alias("symbol"),
        F.floor(time_us / (width_ms * 1000)).cast("long").alias("slot"),
        (time_us.cast("decimal(38,0)") * F.lit(10**18).cast("decimal(19,0)") + key.cast("decimal(18,0)"))
        .cast("decimal(38,0)").alias("seq"),
        key.alias("key"),
        price.cast("double").alias("p"),
        volume.cast("double").alias("v"),
    )
    even = F.col("key") % 2 == 0
    bars = base.groupBy("symbol", "slot").agg(
        F.min_by("p", "seq").alias("open"),
        F.max("p").alias("high"),
        F.min("p").alias("low"),
        F.max_by("p", "seq").alias("close"),
        F.sum("v").alias("volume"),
        F.sum(F.col("p") * F.col("v")).alias("quote_volume"),
        F.count(F.lit(1)).alias("trades"),
        F.sum(F.when(even, F.col("v")).otherwise(0.0)).alias("taker_base"),
        F.sum(F.when(even, F.col("p") * F.col("v")).otherwise(0.0)).alias("taker_quote"),
    )
    bars = bars.select(
        "*",
        (F.col("slot") * width_ms).alias("open_ms"),
        ((F.col("slot") + 1) * width_ms).alias("close_ms"),
        F.col("slot").alias("src_row"),
    ).drop("slot")
    return index_bars(bars, width_ms, columns)


def index_bars(bars: DataFrame, width_ms: int = HOUR_MS, columns: list[str] | None = None) -> DataFrame:
    """Dense ``bar_idx`` per symbol in close-time order.

    The un-numbered bars are written once, so the raw rows are read once however
    many branches later stages need; the numbering itself stays lazy. With ``columns``, only
    these are built, besides symbol, index and times.
    """
    kept = BAR_COLUMNS if columns is None else [c for c in BAR_COLUMNS if c in ("symbol", "bar_idx", "open_ms", "close_ms", *columns)]
    bars = materialize(bars.select(*[c for c in bars.columns if c in kept]), "bars")
    part = F.expr(f"close_ms div {width_ms * 4096}")
    return number_rows(bars, ["symbol"], [F.col("close_ms")], part, "bar_idx").select(*kept)


# --- driver tables -------------------------------------------------------

def event_bars(events: DataFrame, width_ms: int = HOUR_MS) -> DataFrame:
    return build_bars(
        events, F.col("event_type"), micros(F.col("ts")), F.col("event_id"), F.col("value"), F.lit(1.0), width_ms
    )


def lineitem_bars(lineitem: DataFrame, symbol: str = "l_suppkey", width_ms: int = DAY_MS, columns: list[str] | None = None) -> DataFrame:
    key = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    return build_bars(
        lineitem, F.col(symbol), micros(F.col("l_shipdate")), key,
        F.col("l_extendedprice") / F.col("l_quantity"), F.col("l_quantity"), width_ms, columns,
    )


def order_bars(orders: DataFrame, width_ms: int = DAY_MS) -> DataFrame:
    return build_bars(
        orders, F.col("o_orderpriority"), micros(F.col("o_orderdate")), F.col("o_orderkey"),
        F.col("o_totalprice"), F.lit(1.0), width_ms,
    )


# --- bar files -----------------------------------------------------------

def read_klines(spark: SparkSession, path: str, symbol: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Read a 6- or 11-column bar file.  Returns (good rows, rejected rows).

    ``src_row`` is the position in the file system's line order; rows that do
    not parse go to the second frame instead of failing the job. Without a symbol, files lie in folders ``symbol=...``.
    """
    schema = T.StructType([T.StructField(name, T.StringType()) for name in KLINE_FIELDS])
    raw = (
        spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE")
        .option("enforceSchema", True).csv(path)
        .select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_seq"))
    )
    # Line order: files by path, blocks by place, lines within; ids of a scan only count within a block.
    parts = raw.groupBy("_file", "_block").agg(F.count(F.lit(1)).alias("_n"), F.min("_seq").alias("_first"))
    in_file = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    files = parts.groupBy("_file").agg(F.sum("_n").alias("_lines"))
    files = files.select("_file", F.coalesce(F.sum("_lines").over(Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_from"))
    base = parts.select("_file", "_block", "_first", F.coalesce(F.sum("_n").over(in_file), F.lit(0)).alias("_in")).join(files, "_file")
    raw = raw.join(base, ["_file", "_block"]).withColumn("src_row", F.col("_from") + F.col("_in") + F.col("_seq") - F.col("_first"))
    number = lambda name: F.expr(f"try_cast({name} AS DOUBLE)")
    parsed = raw.select(
        "src_row",
        F.expr(f"unix_millis(try_to_timestamp(open_time, '{KLINE_TIME_FORMAT}'))").alias("open_ms"),
        *[number(c).alias(c) for c in [*PRICE, "volume"]],
        *[F.coalesce(number(c), F.lit(0.0)).alias(c) for c in ["quote_volume", "taker_base", "taker_quote"]],
        F.coalesce(F.expr("try_cast(trades AS BIGINT)"), F.lit(0)).alias("trades"),
        (F.col("symbol").cast("string") if symbol is None else F.lit(symbol)).alias("symbol"),
    )
    bad = F.col("open_ms").isNull()
    for name in [*PRICE, "volume"]:
        bad = bad | F.col(name).isNull()
    return parsed.filter(~bad), parsed.filter(bad)


def sane(bars: DataFrame) -> DataFrame:
    """Keep bars whose prices are positive and whose range holds open and close."""
    return bars.filter(sanity())


def sanity() -> Column:
    o, h, l, c = (F.col(x) for x in PRICE)
    return (o > 0) & (h > 0) & (l > 0) & (c > 0) & (h >= F.greatest(o, c, l)) & (l <= F.least(o, c))


def bar_interval(bars: DataFrame, time: str = "open_ms") -> DataFrame:
    """Upper median of the positive steps, per symbol: ``sorted[n div 2]``.

    Steps repeat heavily, so they are counted per distinct step first and the
    median is read off the running count.
    """
    width = DAY_MS * 32
    # neighbours across a part boundary meet through the last row of each part
    rows = bars.select("symbol", F.col(time).alias("t"), F.floor(F.col(time) / width).alias("part"))
    w = Window.partitionBy("symbol", "part").orderBy("t")
    inner = rows.withColumn("step", F.col("t") - F.lag("t").over(w)).select("symbol", "step")
    ends = rows.groupBy("symbol", "part").agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    we = Window.partitionBy("symbol").orderBy("part")
    across = ends.withColumn("step", F.col("lo") - F.lag("hi").over(we)).select("symbol", "step")
    steps = inner.unionAll(across).filter("step > 0").groupBy("symbol", "step").agg(F.count(F.lit(1)).alias("n"))
    ws = Window.partitionBy("symbol").orderBy("step")
    ranked = steps.select(
        "symbol", "step",
        F.sum("n").over(ws.rowsBetween(Window.unboundedPreceding, 0)).alias("upto"),
        F.sum("n").over(Window.partitionBy("symbol")).alias("total"),
    )
    return (
        ranked.filter(F.col("upto") > F.floor(F.col("total") / 2))
        .groupBy("symbol").agg(F.min("step").alias("interval_ms"))
    )


def close_times(bars: DataFrame) -> DataFrame:
    """Close time is open time plus the symbol's interval."""
    return bars.drop("close_ms").join(bar_interval(bars), "symbol").withColumn(
        "close_ms", F.col("open_ms") + F.col("interval_ms")
    ).drop("interval_ms")


def keep_last(bars: DataFrame) -> DataFrame:
    """One bar per (symbol, close time): the last one in file order."""
    rest = [c for c in bars.columns if c not in ("symbol", "close_ms")]
    picked = bars.groupBy("symbol", "close_ms").agg(
        *[F.max_by(c, "src_row").alias(c) for c in rest if c != "src_row"], F.max("src_row").alias("src_row")
    )
    return picked.select(*bars.columns)


def load_klines(spark: SparkSession, path: str, symbol: str) -> DataFrame:
    good, _ = read_klines(spark, path, symbol)
    return index_bars(keep_last(close_times(sane(good))))


def order_faults(rows: DataFrame, seq: str = "src_row", part_rows: int = 2**20, tiles: Tiles = Tiles()) -> DataFrame:
    """First place per symbol where file order and time order disagree, plus a unit check."""
    numbered = number_rows(rows, ["symbol"], [F.col(seq)], F.expr(f"{seq} div {part_rows}"), "pos")
    tiled = with_halo(numbered, tiles.size, 1, idx="pos")
    w = tile_window(idx="pos")
    marked = drop_halo(tiled.withColumn("prev", F.lag("close_ms").over(w)), tiles.size, idx="pos")
    return marked.groupBy("symbol").agg(
        F.count_if(F.col("close_ms") < F.col("prev")).alias("faults"),
        F.min(F.when(F.col("close_ms") < F.col("prev"), F.col("pos"))).alias("first_bad"),
        F.count_if(F.col("close_ms") < F.lit(10**12)).alias("in_seconds"),
    )


# --- slicing -------------------------------------------------------------

def calendar_split(bars: DataFrame, bounds_ms: list[int], names: list[str]) -> DataFrame:
    """Label each bar by the last boundary at or before its open time."""
    label = F.lit(None).cast("string")
    for bound, name in zip(bounds_ms, names):
        label = F.when(F.col("open_ms") >= bound, F.lit(name)).otherwise(label)
    return bars.withColumn("split", label)


def window_slice(bars: DataFrame, start_ms: int | None = None, end_ms: int | None = None) -> DataFrame:
    """Bars in [start, end); a reversed or empty range means the full series."""
    if start_ms is not None and end_ms is not None and end_ms <= start_ms:
        return bars
    if start_ms is not None:
        bars = bars.filter(F.col("open_ms") >= start_ms)
    return bars if end_ms is None else bars.filter(F.col("open_ms") < end_ms)


def screen_window(bars: DataFrame, minutes: int = 60, days: int = 180) -> DataFrame:
    """The closing stretch of each series: ``days`` worth of bars of ``minutes``."""
    ends = bars.groupBy("symbol").agg((F.max("bar_idx") + 1).alias("_end"))
    return bars.join(ends, "symbol").filter(F.col("bar_idx") >= F.col("_end") - (1440 // minutes) * days).drop("_end")


def bars_per_day(bars: DataFrame) -> DataFrame:
    """From the upper median of about a hundred evenly spaced steps per symbol."""
    sizes = bars.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.withColumn("gap", F.greatest(F.lit(1), F.floor(F.col("n") / 100)))
    picked = bars.join(sizes, "symbol").filter(F.col("bar_idx") % F.col("gap") == 0)
    w = Window.partitionBy("symbol").orderBy("bar_idx")  # about a hundred rows per symbol
    steps = picked.withColumn("step", F.col("close_ms") - F.lag("close_ms").over(w)).filter("step IS NOT NULL")
    ranked = steps.select(
        "symbol", "step", "gap",
        F.row_number().over(Window.partitionBy("symbol").orderBy("step")).alias("r"),
        F.count(F.lit(1)).over(Window.partitionBy("symbol")).alias("m"),
    ).filter("r = floor(m / 2) + 1")
    per_bar = F.floor(F.col("step") / F.col("gap"))
    return ranked.select("symbol", (F.lit(float(DAY_MS)) / per_bar).alias("bars_per_day"))


def timeframe_minutes(text: Column) -> Column:
    """'15m' -> 15, '4h' -> 240; anything else 5."""
    tidy = F.lower(F.trim(text))
    minutes = F.regexp_extract(tidy, r"^([+-]?\d+)m$", 1).try_cast("int")
    hours = F.regexp_extract(tidy, r"^([+-]?\d+)h$", 1).try_cast("int")
    return F.coalesce(minutes, hours * 60, F.lit(5))


def resample(bars: DataFrame, width_ms: int) -> DataFrame:
    """Coarser bars from finer ones."""
    slot = F.floor(F.col("open_ms") / width_ms)
    coarse = bars.groupBy("symbol", slot.alias("slot")).agg(
        F.min_by("open", "bar_idx").alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", "bar_idx").alias("close"),
        *[F.sum(c).alias(c) for c in ["volume", "quote_volume", "trades", "taker_base", "taker_quote"]],
        F.min("src_row").alias("src_row"),
    )
    coarse = coarse.select(
        "*", (F.col("slot") * width_ms).alias("open_ms"), ((F.col("slot") + 1) * width_ms).alias("close_ms")
    ).drop("slot")
    return index_bars(coarse, width_ms)
