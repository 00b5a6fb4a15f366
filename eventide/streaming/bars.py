"""Streaming form of the bar pipeline: watermarked bars, de-duplication, and state carried from day to day."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from eventide.sources.bars import QUARTERS, instrument_of


def tick_stream(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """Ticks that land as Parquet files in a folder."""
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def streaming_bars(ticks: DataFrame, late: str = "2 hours", width: str = f"{QUARTERS.bar_minutes} minutes") -> DataFrame:
    """Bars of each window; ticks that come twice within the lateness bound count once, later ones are dropped."""
    t = ticks.select(instrument_of().alias("instrument_id"), F.col("ts").cast("timestamp").alias("ts"), "event_id", "value")
    t = t.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    at = F.struct("ts", "event_id")
    return t.groupBy("instrument_id", F.window("ts", width).alias("w")).agg(
        F.min_by("value", at).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", at).alias("close"), F.count("*").alias("transactions")
    ).select("instrument_id", F.col("w.start").alias("ts_utc"), "open", "high", "low", "close", "transactions")


STATE = "closes array<double>, volumes array<double>"
OUT = "instrument_id string, session_date date, rth_close double, prev_close double, typ_volume double"


def _carry(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    closes, volumes = (list(x) for x in state.get) if state.exists else ([], [])
    days = pd.concat(list(batches)).sort_values("session_date")
    rows = []
    for r in days.itertuples():
        typical = float(pd.Series(volumes).median()) if volumes else None
        rows.append((key[0], r.session_date, r.rth_close, closes[-1] if closes else None, typical))
        closes, volumes = [*closes, r.rth_close][-5:], [*volumes, r.volume][-20:]
    state.update((closes, volumes))
    yield pd.DataFrame(rows, columns=["instrument_id", "session_date", "rth_close", "prev_close", "typ_volume"])


def carried_days(days: DataFrame) -> DataFrame:
    """Stream of finished days (instrument_id, session_date, rth_close, volume), in order of days: each with the last close and
    the median volume of up to twenty days before it, from state that holds 5 closes and 20 volumes an instrument."""
    return days.groupBy("instrument_id").applyInPandasWithState(_carry, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Processes what has landed since the last run, and ends: resuming is calling it again."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
