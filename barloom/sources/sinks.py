"""Writing and reading results: trades, bar states, traces, winners, reports, snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.proofs import indicators_text
from ..operators.tiling import Tiles, drop_halo


def trade_file(trades: DataFrame, bars: DataFrame, proofs: DataFrame | None = None) -> DataFrame:
    """Trades in the 17-column file layout. ``proofs``: summaries of their signals (``proofs.prove_signals``)."""
    times = bars.select("symbol", F.col("bar_idx").alias("signal_idx"), F.col("open_ms").alias("signal_ms"))
    stamp = lambda ms: f"date_format(timestamp_millis({ms}), \"yyyy-MM-dd'T'HH:mm:ss'Z'\")"
    t = trades.join(times, ["symbol", "signal_idx"])
    t = t.withColumn("summary", F.lit("")) if proofs is None else t.join(proofs.select("strategy", "symbol", "signal_idx", "summary"), ["strategy", "symbol", "signal_idx"], "left")
    return t.selectExpr(
        "concat_ws('-', strategy, symbol, CAST(signal_idx AS STRING)) AS TradeID", "signal_idx AS SignalIndex",
        "entry_idx AS EntryIndex", "exit_idx AS ExitIndex", f"{stamp('signal_ms')} AS SignalTime", f"{stamp('entry_ms')} AS EntryTime",
        f"{stamp('exit_ms')} AS ExitTime", "IF(dir = 1, 'LONG', 'SHORT') AS Direction", "entry_price AS EntryPrice", "exit_price AS ExitPrice", "pnl AS PnL",
        "hold AS HoldBars", "reason AS ExitReason", "stop AS StopPrice", "target AS TPPrice", "trails AS TrailActive",
        "coalesce(summary, '') AS ProofSummary")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def state_file(states: DataFrame, bars: DataFrame) -> DataFrame:
    """Bar states in the plain file layout; a bar on which no signal could pass has none."""
    timed = states.join(bars.select("symbol", "bar_idx", "open_ms"), ["symbol", "bar_idx"])
    return timed.selectExpr("symbol", "strategy", "bar_idx AS BarIndex", "open_ms AS Time", "array_join(array_remove(states, 'filtered'), ',') AS Statuses")


def state_file_with_proofs(states: DataFrame, prep: DataFrame, proofs: DataFrame, shown: list[str], tiles: Tiles = Tiles()) -> DataFrame:
    """Bar states with the proofs of signals; other bars show their values only, and count as not checked.

    ``prep`` is the book's tiled frame, ``proofs`` come from ``proofs.prove_signals`` with the same ``shown``.
    """
    values = drop_halo(prep, tiles.size).select("symbol", "bar_idx", "open_ms", F.expr(indicators_text(shown)).alias("plain"))
    of = proofs.select("strategy", "symbol", F.col("signal_idx").alias("bar_idx"), "regime_ok", "entry_ok", "summary")
    both = states.join(values, ["symbol", "bar_idx"]).join(of, ["strategy", "symbol", "bar_idx"], "left")
    return both.selectExpr("symbol", "strategy", "bar_idx AS BarIndex", "date_format(timestamp_millis(open_ms), 'yyyy-MM-dd HH:mm:ss') AS Time",
                           "array_join(array_remove(states, 'filtered'), ',') AS States", "coalesce(regime_ok, false) AS RegimeOK",
                           "coalesce(entry_ok, false) AS EntryOK", "coalesce(summary, plain) AS ProofSummary")


def trace(states: DataFrame, featured: DataFrame, cols: list[str]) -> DataFrame:
    """Every bar of every strategy with its state, features and rule columns."""
    s = states.select("symbol", "strategy", "bar_idx", F.array_join("states", ",").alias("state"))
    return s.join(featured.select("symbol", "bar_idx", *cols), ["symbol", "bar_idx"])


def diagnostic_points(nearest: DataFrame, featured: DataFrame, cols: list[str]) -> DataFrame:
    """Features at chosen times, taken from the nearest bar; the middle band is the mean of the outer two."""
    return nearest.join(featured, ["symbol", "bar_idx"]).select(
        "symbol", "t", "bar_idx", "gap", *cols, ((F.col("BB_Upper20") + F.col("BB_Lower20")) / 2).alias("SMA20"))


# --- winners as JSON lines -----------------------------------------------------

def write_winners(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_winners(spark: SparkSession, path: str, schema: str, place: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows that parse, broken lines): a bad line never fails the scan.

    ``place`` names a column for the line's place: file, block, order in the block.
    """
    raw = spark.read.text(path)
    where = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("row"))
    raw = raw.select("value", where.alias(place)) if place else raw
    parsed = raw.select("*", F.from_json("value", f"{schema}, _bad STRING", {"columnNameOfCorruptRecord": "_bad"}).alias("r"))
    ok = F.col("r._bad").isNull() & F.col("r").isNotNull()
    return parsed.filter(ok).select("r.*", *[place] * bool(place)).drop("_bad"), parsed.filter(~ok).select("value")


def newest(df: DataFrame, order: str, n: int) -> DataFrame:
    return df.orderBy(F.desc(order)).limit(n)


def by_seed(df: DataFrame, seed) -> DataFrame:
    return df.filter(F.col("seed") == seed)


def first_winner(df: DataFrame, place: str) -> DataFrame:
    """The row of the first line."""
    return df.orderBy(place).limit(1).drop(place)


def completeness(df: DataFrame, cols: list[str]) -> DataFrame:
    """How many rows hold each field."""
    return df.agg(F.count(F.lit(1)).alias("lines"), *[F.count(c).alias(f"with_{c}") for c in cols])


# --- reports ---------------------------------------------------------------------

def reports(ranked: DataFrame) -> DataFrame:
    """One text block per ranked row."""
    return ranked.selectExpr(
        "rank", "format_string('STRATEGY %s (RANK %d)\\nScore: %.4f\\nReturn: %.2f%%\\nMax drawdown: %.2f%%\\nTrades: %d\\nWin rate: %.1f%%', "
        "strategy, rank, score, ret * 100, max_dd * 100, trades, win_rate * 100) AS text")


def write_reports(df: DataFrame, path: str) -> None:
    df.select("rank", "text").write.mode("overwrite").partitionBy("rank").text(path)


def parse_report(text) -> list:
    """Numbers back out of a report block."""
    num = lambda label: F.regexp_extract(text, label + r": (-?[\d.]+)", 1).try_cast("double")
    return [num("Score").alias("score"), num("Return").alias("ret_pct"), num("Max drawdown").alias("dd_pct"), num("Trades").alias("trades")]


# --- snapshots ---------------------------------------------------------------------

def save_snapshot(tables: dict[str, DataFrame], path: str, version: int) -> None:
    """Leaderboards and fingerprints of one version; a version can be loaded once all its tables are written."""
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.write.parquet(f"{path}/v{version}/{name}")
    spark.createDataFrame([(n,) for n in tables], "name string").write.parquet(f"{path}/v{version}/_whole.parquet")


def load_snapshot(spark: SparkSession, path: str, version: int, names: list[str]) -> dict[str, DataFrame]:
    spark.read.schema("name string").parquet(f"{path}/v{version}/_whole.parquet").first()
    return {n: spark.read.parquet(f"{path}/v{version}/{n}") for n in names}
