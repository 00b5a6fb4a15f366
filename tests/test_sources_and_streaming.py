"""Landed files, upserts, sessions over a clock change, and streaming against batch."""

import datetime as dt
import gzip
import json

from pyspark.sql import functions as F

from eventide.sources import bars as src
from eventide.streaming import bars as stream


def test_session_clock_over_a_change_of_the_clock(spark):
    rows = [("a", dt.datetime(2024, 3, 8, 14, 30)), ("a", dt.datetime(2024, 3, 11, 13, 30)), ("a", dt.datetime(2024, 11, 4, 14, 29)), ("a", dt.datetime(2024, 11, 4, 21, 0))]
    df = spark.createDataFrame(rows, "instrument_id string, ts_utc timestamp_ntz")
    got = [(r.minute_of_day, r.is_rth, r.is_premarket, r.is_after_hours) for r in src.add_session(df, src.SessionSpec()).orderBy("ts_utc").collect()]
    assert got == [(570, True, False, False), (570, True, False, False), (569, False, True, False), (960, False, False, True)]


def test_csv_epochs_and_day_store(spark, tmp_path):
    base = 1_704_207_000
    lines = ["Ticker,Volume,Open,Close,High,Low,Window_Start,Transactions"] + [f"A,10,1,2,3,0.5,{base * k},4" for k in (10**9, 10**6, 10**3, 1)]
    with gzip.open(tmp_path / "x.csv.gz", "wt") as f:
        f.write("\n".join(lines))
    got = src.read_bar_csv(spark, str(tmp_path / "x.csv.gz"))
    assert {r.ts_utc for r in got.collect()} == {dt.datetime(2024, 1, 2, 14, 50)} and got.count() == 4
    path = str(tmp_path / "store")
    src.write_bars(got.limit(1), path)
    src.write_bars(got.limit(1).withColumn("ts_utc", F.lit(dt.datetime(2024, 1, 3)).cast("timestamp_ntz")), path)
    assert src.read_days(spark, path, ["2024-01-03"], ["ticker", "close"]).count() == 1


def test_json_sources(spark, tmp_path):
    (tmp_path / "a.json").write_text("\n".join(json.dumps({"o": 1, "h": 2, "l": 0.5, "c": c, "v": v, "n": 1, "t": 1704207000000}) for c, v in ((1.5, 10), (1.6, 11))))
    got = src.read_aggregates_json(spark, str(tmp_path / "a.json"), "A").collect()
    assert [(r.close, r.volume) for r in got] == [(1.6, 11.0)]
    raw = spark.createDataFrame([("A", "CS", "XNAS", None, "1", True, None, None), ("E", "ETF", "XNAS", "F", "2", True, None, None), ("B", "CS", "OTC", None, None, True, None, None)], "ticker string, type string, primary_exchange string, composite_figi string, cik string, active boolean, list_date string, delisted_utc string")
    assert [(r.instrument_id, r.exchange) for r in src.instruments_from_json(raw).collect()] == [("cik:1", "NASDAQ")]
    split = spark.createDataFrame([("A", "2024-01-05", None, 4, 1), ("B", None, "2024-01-06", 1, 0)], "ticker string, execution_date string, ex_date string, split_to int, split_from int")
    assert [r.ratio for r in src.splits_from_json(split).collect()] == [4.0]
    art = spark.createDataFrame([("1", "2024-01-02T10:00:00Z", "p", ["A", "B"], ["k"], [("A", "Positive"), ("B", "odd"), (None, "neutral")])], "article_id string, published_utc string, publisher string, tickers array<string>, keywords array<string>, insights array<struct<ticker:string,sentiment:string>>")
    assert [(r.ticker, r.sentiment_score, r.article_ticker_count) for r in src.flatten_news(art).collect()] == [("A", 1, 2)]


def test_streamed_bars_equal_batch_bars(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    for i in range(3):
        events.filter(F.col("event_id") % 3 == i).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    s = stream.streaming_bars(stream.tick_stream(spark, str(tmp_path / "in")), late="60 days")
    query = s.writeStream.format("memory").queryName("streamed").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    key = lambda df: {(r.instrument_id, str(r.ts_utc), r.open, r.high, r.low, r.close, r.transactions) for r in df.collect()}
    assert key(spark.table("streamed")) == key(src.bars_from_ticks(events))


def test_state_is_carried_between_runs(spark, tmp_path):
    schema = "instrument_id string, session_date date, rth_close double, volume double"
    day = lambda n: spark.createDataFrame([("a", dt.date(2024, 1, n), float(n), 10.0 * n)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "days"))
    for n in (2, 3):
        day(n)
        days = spark.readStream.schema(schema).parquet(str(tmp_path / "days"))
        stream.run_available(stream.carried_days(days), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("session_date").collect()
    assert [(r.prev_close, r.typ_volume) for r in got] == [(None, None), (2.0, 20.0)]
