"""Bars, profiles, sessions and indicators over event streams."""

from __future__ import annotations

import sys
import uuid

import pandas as pd
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder

# Ship this module's functions by value: executors need no copy of the package.
register_pickle_by_value(sys.modules[__name__])

EVENT_SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, folder: str, pattern: str = "events*.parquet", files_per_batch: int = 1) -> DataFrame:
    """Event files as a stream; times become instants for watermarks."""
    raw = spark.readStream.schema(EVENT_SCHEMA).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", pattern).parquet(folder)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def live_bars(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Tumbling OHLCV bars; a bar is final once the watermark passes its end."""
    seq = F.struct("ts", "event_id")
    return (
        events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), F.col("event_type").alias("symbol"))
        .agg(F.min_by("value", seq).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"),
             F.max_by("value", seq).alias("close"), F.count(F.lit(1)).alias("volume"))
        .select("symbol", F.unix_millis("w.start").alias("open_ms"), "open", "high", "low", "close", "volume")
    )


def activity_profile(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Sliding one-hour volume every quarter of an hour."""
    return (
        events.withWatermark("ts", late).groupBy(F.window("ts", "1 hour", "15 minutes").alias("w"), "event_type")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
        .select("event_type", F.unix_millis("w.start").alias("start_ms"), "n", "total")
    )


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Bursts of activity per symbol, closed by a quiet gap."""
    return (
        events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "event_type")
        .agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("peak"))
        .select("event_type", F.unix_micros("w.start").alias("start_us"), F.unix_micros("w.end").alias("end_us"), "n", "peak")
    )


def distinct_events(events: DataFrame, late: str = "2 hours") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def counters(labelled: DataFrame, key: str = "event_type") -> DataFrame:
    """Running totals per key."""
    return labelled.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


# --- stateful indicators -----------------------------------------------------------

ONLINE_OUT = "symbol string, open_ms long, close double, ema_fast double, ema_slow double, atr double, cross_up boolean"
ONLINE_STATE = "n long, close double, fast double, slow double, sum_fast double, sum_slow double, atr double, sum_tr double, above int"


def online_step(fast: int = 10, slow: int = 20, atr_n: int = 14):
    """State function: exponential averages, true range and crossings per symbol, one bar at a time."""
    def step(key, batches, state):
        n, close, ef, es, sf, ss, atr, st, above = state.get if state.exists else (0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0)
        # A key's rows come in several Arrow batches, in no order: all of a micro-batch are put in order first.
        whole = list(batches)
        for pdf in [pd.concat(whole).sort_values("open_ms")] if whole else []:
            out = []
            for ms, h, l, c in zip(pdf["open_ms"], pdf["high"], pdf["low"], pdf["close"]):
                tr = max(h - l, abs(h - close), abs(l - close)) if n else 0.0
                sf, ss = (sf + c if n < fast else sf), (ss + c if n < slow else ss)
                ef = sf / (n + 1) if n < fast else ef + (c - ef) * 2.0 / (fast + 1)
                es = ss / (n + 1) if n < slow else es + (c - es) * 2.0 / (slow + 1)
                st = st + tr if n <= atr_n else st
                atr = 0.0 if n < atr_n else st / atr_n if n == atr_n else (atr * (atr_n - 1) + tr) / atr_n
                now = int(ef > es) if n >= slow else 0
                out.append((key[0], ms, c, ef, es, atr, bool(n > slow and now and not above)))
                n, close, above = n + 1, c, now
            yield pd.DataFrame(out, columns=["symbol", "open_ms", "close", "ema_fast", "ema_slow", "atr", "cross_up"])
        state.update((int(n), float(close), float(ef), float(es), float(sf), float(ss), float(atr), float(st), int(above)))
    return step


def online_indicators(bars: DataFrame) -> DataFrame:
    """Indicators on finished bars in arrival order, state kept per symbol."""
    return bars.groupBy("symbol").applyInPandasWithState(online_step(), ONLINE_OUT, ONLINE_STATE, "append", "NoTimeout")


# --- running a stream to its end -----------------------------------------------------

def run_to_table(stream: DataFrame, mode: str = "append", keys: list[str] | None = None) -> DataFrame:
    """Run over all available files into a table in the shared folder and read it back.

    Update streams keep a current row per key (``upsert``).
    """
    spark = stream.sparkSession
    path = f"{shared_folder(spark)}/barloom/stream-{uuid.uuid4().hex}"
    writer = stream.writeStream.option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True)
    if mode == "append":
        writer.format("parquet").outputMode("append").option("path", f"{path}/data").start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{path}/data")
    writer.outputMode(mode).foreachBatch(upsert(f"{path}/data", keys)).start().awaitTermination()
    return current(spark, f"{path}/data", stream.schema)


def upsert(path: str, keys: list[str]):
    """A batch function that keeps the newest row per key.

    Two copies take turns: batch n is merged with the copy of n - 1 and replaces that of n - 2. A batch that is
    replayed after a failure finds the copy it started from and gives the same table, and the copies hold
    no more rows than there are keys, however many batches came.
    """
    def save(batch: DataFrame, number: int) -> None:
        rest = [c for c in batch.columns if c not in keys]
        rows = batch.withColumn("_version", F.lit(number).cast("long"))
        if number:
            before = batch.sparkSession.read.schema(rows.schema).parquet(f"{path}/{(number - 1) % 2}")
            rows = rows.unionByName(before.withColumn("_version", F.lit(number - 1).cast("long")))
        newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_version").alias("r")).select(*keys, "r.*")
        newest.withColumn("_version", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{path}/{number % 2}")
    return save


def current(spark: SparkSession, path: str, schema) -> DataFrame:
    """The newer copy of an upserted table, once its stream has ended."""
    copies = spark.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in schema)}, _version long").parquet(f"{path}/*")
    newest = copies.agg(F.max("_version").alias("_newest"))
    return copies.join(F.broadcast(newest), F.col("_version") == F.col("_newest"), "left_semi").select(*[f.name for f in schema])


def late_rows(stream: DataFrame, path: str) -> DataFrame:
    """Run over the available files into path/data, going on where the last run ended; (batch, dropped): rows that came after the watermark.

    The figures are the state operator's own. Aggregations count rows after their map-side part.
    """
    query = (stream.writeStream.option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True)
             .format("parquet").outputMode("append").option("path", f"{path}/data").start())
    dropped: dict[int, int] = {}
    ended = False
    while not ended:
        ended = query.awaitTermination(1)
        # The newest hundred are kept by the query, so they are read as it runs.
        for p in query.recentProgress:
            dropped[p.batchId] = max(dropped.get(p.batchId, 0), sum(op.numRowsDroppedByWatermark for op in p.stateOperators))
    return stream.sparkSession.createDataFrame(sorted(dropped.items()), "batch long, dropped long")
