"""Bar cleaning, numbering, sinks and streams."""

import os

from pyspark.sql import functions as F

from barloom.operators.tiling import number_rows
from barloom.sources import bars as B
from barloom.sources import sinks as Z
from barloom.streaming import streams as L

SF = "/root/testdata/sf0.001"


def test_upper_median_interval_and_keep_last(spark):
    times = [0, 60, 120, 240, 360]
    df = spark.createDataFrame([("s", t, i) for i, t in enumerate(times)], "symbol string, open_ms long, src_row long")
    assert B.bar_interval(df).first()["interval_ms"] == 120
    dup = spark.createDataFrame([("s", 1, "a", 0), ("s", 1, "b", 1), ("s", 2, "c", 2)], "symbol string, close_ms long, v string, src_row long")
    assert sorted((r["close_ms"], r["v"]) for r in B.keep_last(dup).collect()) == [(1, "b"), (2, "c")]


def test_six_and_eleven_columns_and_bad_rows(spark, tmp_path):
    six = "t,o,h,l,c,v\n2020-01-01 00:00:00+00:00,1,2,0.5,1.5,10\nbroken,1,2,0.5,1.5,10\n2020-01-01 01:00:00+00:00,1.5,1,0.5,1.5,10\n"
    (tmp_path / "six.csv").write_text(six + "2020-01-01 02:00:00+00:00,1,2,0.5,1.5,11\n")
    good, bad = B.read_klines(spark, str(tmp_path / "six.csv"), "x")
    assert (good.count(), bad.count(), B.sane(good).count()) == (3, 1, 2)
    out = B.load_klines(spark, str(tmp_path / "six.csv"), "x").orderBy("bar_idx").collect()
    assert [r["bar_idx"] for r in out] == [0, 1] and out[0]["close_ms"] - out[0]["open_ms"] == 7200000 and out[0]["trades"] == 0


def test_numbering_is_dense_and_ordered(spark):
    df = spark.range(5000).selectExpr("CAST(id % 3 AS STRING) AS symbol", "id * 7 AS t")
    out = number_rows(df, ["symbol"], [F.col("t")], F.expr("t div 1000"), "i")
    bad = out.selectExpr("*", "row_number() OVER (PARTITION BY symbol ORDER BY t) - 1 AS want").filter("i != want").count()
    assert bad == 0


def test_winner_lines_survive_broken_rows(spark, tmp_path):
    (tmp_path / "w.jsonl").write_text('{"seed": 1, "score": 2.5}\nnot json\n{"seed": 2, "score": 1.0}\n')
    good, bad = Z.read_winners(spark, str(tmp_path / "w.jsonl"), "seed long, score double")
    assert good.count() == 2 and bad.count() == 1 and Z.newest(good, "seed", 1).first()["seed"] == 2


def test_stream_bars_equal_batch_bars_up_to_the_watermark(spark):
    live = L.run_to_table(L.live_bars(L.event_stream(spark, SF, "events.parquet")))
    batch = B.event_bars(spark.read.parquet(f"{SF}/events.parquet")).select("symbol", "open_ms", "open", "high", "low", "close")
    assert live.select(*batch.columns).exceptAll(batch).count() == 0
    assert 0 < batch.count() - live.count() < 20


def test_late_rows_are_dropped_only_beyond_the_watermark(spark, tmp_path):
    # a batch filters by the watermark of the batch before it, so late rows come third
    base = spark.read.parquet(f"{SF}/events.parquet")
    before = lambda day: F.col("ts") < F.expr(f"timestamp_ntz'2024-01-{day:02d} 00:00:00'")
    late = base.filter(before(2)).withColumn("event_id", F.col("event_id") + 10**6)
    parts = [base.filter(before(15)), base.filter(~before(15) & before(20)), late.unionByName(base.filter(~before(20)))]
    folder = tmp_path / "in"
    folder.mkdir()
    for i, part in enumerate(parts):
        part.coalesce(1).write.parquet(str(tmp_path / f"p{i}"))
        target = folder / f"events{i}.parquet"
        target.write_bytes(next((tmp_path / f"p{i}").glob("*.parquet")).read_bytes())
        os.utime(target, (1_600_000_000 + i * 1000,) * 2)
    out = L.run_to_table(L.live_bars(L.event_stream(spark, str(folder))))
    want = B.event_bars(base)
    both = out.join(want.select("symbol", "open_ms", F.col("volume").alias("v")), ["symbol", "open_ms"])
    assert both.filter("volume != v").count() == 0 and both.count() > 100


def test_online_indicators_do_not_depend_on_arrow_batches(spark, tmp_path):
    bars = B.event_bars(spark.read.parquet(f"{SF}/events.parquet")).select("symbol", "open_ms", "high", "low", "close")
    bars.orderBy(F.rand(3)).coalesce(1).write.parquet(str(tmp_path / "bars"))
    run = lambda: L.run_to_table(L.online_indicators(spark.readStream.schema(bars.schema).parquet(str(tmp_path / "bars"))))
    want = run()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = run()
        assert got.exceptAll(want).count() == 0 and got.count() == want.count() == bars.count()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_lines_of_several_files_are_numbered_in_order(spark, tmp_path):
    for name, n in (("a", 3), ("b", 2), ("c", 1)):
        rows = [f"2020-01-01 0{i}:00:00+00:00,1,2,0.5,1.5,{ord(name)}" for i in range(n)]
        (tmp_path / f"{name}.csv").write_text("\n".join(["t,o,h,l,c,v", *rows]) + "\n")
    good, _ = B.read_klines(spark, str(tmp_path), "x")
    assert [(r.src_row, r.volume) for r in good.orderBy("src_row").collect()] == [(0, 97), (1, 97), (2, 97), (3, 98), (4, 98), (5, 99)]


def test_upsert_survives_replay_and_keeps_one_row_per_key(spark, tmp_path):
    save = L.upsert(str(tmp_path / "t"), ["k"])
    want = {}
    for n in range(12):
        rows = [(k, n * 10 + k) for k in range(5) if (k + n) % 3 == 0]
        batch = spark.createDataFrame(rows, "k long, v long")
        for _ in range(2 if n in (0, 4, 11) else 1):
            save(batch, n)
        want |= dict(rows)
        assert dict(map(tuple, L.current(spark, str(tmp_path / "t"), batch.schema).collect())) == want
    assert spark.read.parquet(str(tmp_path / "t" / "*")).count() <= 10


def test_kline_scan_keeps_rows_that_parse(spark, tmp_path):
    from datetime import datetime

    from barloom.registry.bar_queries import kline_scan

    rows = [(i, datetime(2024, 1, 1, i), 1, "view", 0.0 if i == 2 else 5.0, "{}") for i in range(4)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(str(tmp_path / "events.parquet"))
    assert sorted(r.low for r in kline_scan(spark, str(tmp_path)).collect()) == [0.0, 5.0, 5.0, 5.0]


def test_bars_of_some_columns(spark):
    rows = spark.read.parquet(f"{SF}/lineitem.parquet")
    some = B.lineitem_bars(rows, "l_returnflag", columns=["high", "low", "close"])
    assert some.columns == ["symbol", "bar_idx", "open_ms", "close_ms", "high", "low", "close"]
    whole = B.lineitem_bars(rows, "l_returnflag")
    assert whole.columns == B.BAR_COLUMNS and whole.select(*some.columns).exceptAll(some).isEmpty() and whole.count() == some.count()
