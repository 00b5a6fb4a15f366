"""What happened after events: forward returns, barrier touches, excursions."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventide.operators.joins import asof_join, range_join

# Minutes of the horizon units.
UNITS = {"m": 1, "h": 60, "d": 1440}


def horizon_minutes(text: str) -> int:
    m = re.fullmatch(r"(\d+)([mhd])", text.strip())
    if not m:
        raise ValueError(f"no horizon: {text}")
    return int(m[1]) * UNITS[m[2]]


def with_entry(events: DataFrame, bars: DataFrame) -> DataFrame:
    """Entry price: the open of the first bar that starts at or after entry_ts."""
    b = bars.select("instrument_id", F.col("ts_utc").alias("entry_bar_ts"), F.col("open").alias("entry_price"))
    return asof_join(events, b, ["instrument_id"], "entry_ts", "entry_bar_ts", ["entry_price"], "forward")


def forward_returns(events: DataFrame, bars: DataFrame, horizons: dict[str, int], bar_minutes: int) -> DataFrame:
    """events(event_id, instrument_id, entry_ts, side) x horizons (minutes): the close of the bar that ends at the horizon,
    looked up by its exact start, over the entry price; short sides count the other way."""
    hs = F.explode(F.array(*[F.struct(F.lit(n).alias("horizon"), F.lit(m).alias("minutes")) for n, m in horizons.items()]))
    e = with_entry(events, bars).withColumn("_h", hs).select("*", F.col("_h.horizon").alias("horizon"), F.col("_h.minutes").alias("_m")).drop("_h")
    e = e.withColumn("_exit", F.col("entry_ts") + F.make_dt_interval(mins=F.col("_m") - bar_minutes))
    b = bars.select(F.col("instrument_id").alias("_i"), F.col("ts_utc").alias("_t"), F.col("close").alias("exit_price"))
    out = e.join(b, (F.col("instrument_id") == F.col("_i")) & (F.col("_exit") == F.col("_t")), "left")
    move = F.try_divide("exit_price", F.col("entry_price")) - 1
    return out.withColumn("forward_return", F.when(F.col("side") == "SHORT", -move).otherwise(move)).drop("_i", "_t", "_exit", "_m")


def barriers(events: DataFrame, bars: DataFrame, minutes: int, take: float, stop: float) -> DataFrame:
    """First touch of the profit or loss barrier within the horizon. Both in one bar is ambiguous and
    leaves the flags null, and so does a window without a touch.
    Excursions include the touching bar and are at least 0 (favourable) or at most 0 (adverse)."""
    e = with_entry(events.select("event_id", "instrument_id", "entry_ts", "side"), bars)
    b = bars.select("instrument_id", "ts_utc", "high", "low")
    j = range_join(e, b, ["instrument_id"], "entry_ts", "ts_utc", 0, minutes * 60)
    short = F.col("side") == "SHORT"
    up, down = F.try_divide("high", F.col("entry_price")) - 1, F.try_divide("low", F.col("entry_price")) - 1
    j = j.withColumn("_best", F.when(short, -down).otherwise(up)).withColumn("_worst", F.when(short, -up).otherwise(down))
    j = j.withColumn("_tp", F.col("_best") >= take).withColumn("_sl", F.col("_worst") <= -stop)
    first = j.groupBy("event_id").agg(F.min(F.when(F.col("_tp") | F.col("_sl"), F.col("ts_utc"))).alias("_hit"))
    j = j.join(first, "event_id").filter("_hit is null or ts_utc <= _hit")
    at_hit = F.col("ts_utc") == F.col("_hit")
    g = j.groupBy("event_id").agg(
        F.greatest(F.lit(0.0), F.max("_best")).alias("mfe"),
        F.least(F.lit(0.0), F.min("_worst")).alias("mae"),
        F.coalesce(F.bool_or(at_hit & F.col("_tp")), F.lit(False)).alias("_t"),
        F.coalesce(F.bool_or(at_hit & F.col("_sl")), F.lit(False)).alias("_s"),
    )
    g = g.withColumn("ambiguous", F.col("_t") & F.col("_s"))
    return e.join(g, "event_id", "left").select(
        "event_id", "instrument_id", "side", "entry_price", "mfe", "mae", "ambiguous",
        F.when(~F.col("ambiguous") & (F.col("_t") | F.col("_s")), F.col("_t")).alias("target_first"), F.when(~F.col("ambiguous") & (F.col("_t") | F.col("_s")), F.col("_s")).alias("stop_first"),
    )


def excursions(entered: DataFrame, bars: DataFrame, horizons: dict[str, int], take: float, stop: float) -> DataFrame:
    """Events with an entry price (with_entry) -> event_id, horizon, mfe, mae, ambiguous, target_first, stop_first: what
    `barriers` tells, for each horizon by itself.

    Bars are joined once, up to the longest horizon. The first touch doesn't hang on the horizon, so that bars behind it are
    left out once, and every horizon is read off its own part of the rest. A horizon without bars has excursions of 0."""
    longest = max(horizons.values())
    e = entered.filter("entry_price is not null").select("event_id", "instrument_id", "entry_ts", "side", "entry_price")
    j = range_join(e, bars.select("instrument_id", "ts_utc", "high", "low"), ["instrument_id"], "entry_ts", "ts_utc", 0, longest * 60)
    short = F.col("side") == "SHORT"
    up, down = F.try_divide("high", F.col("entry_price")) - 1, F.try_divide("low", F.col("entry_price")) - 1
    j = j.select("event_id", "ts_utc", "entry_ts", F.when(short, -down).otherwise(up).alias("_best"), F.when(short, -up).otherwise(down).alias("_worst"))
    j = j.withColumn("_tp", F.col("_best") >= take).withColumn("_sl", F.col("_worst") <= -stop)
    hit = F.min(F.when(F.col("_tp") | F.col("_sl"), F.col("ts_utc"))).over(Window.partitionBy("event_id"))
    j = j.withColumn("_hit", hit).filter("_hit is null or ts_utc <= _hit")
    touched = lambda c: F.coalesce(F.bool_or(F.when(F.col("ts_utc") == F.col("_hit"), F.col(c))), F.lit(False))
    parts = []
    for i, minutes in enumerate(horizons.values()):
        inside = F.col("ts_utc") < F.col("entry_ts") + F.make_dt_interval(mins=F.lit(minutes))
        parts += [F.max(F.when(inside, F.col("_best"))).alias(f"b{i}"), F.min(F.when(inside, F.col("_worst"))).alias(f"w{i}"), F.bool_or(inside & (F.col("ts_utc") == F.col("_hit"))).alias(f"h{i}")]
    g = e.select("event_id").join(j.groupBy("event_id").agg(*parts, touched("_tp").alias("_t"), touched("_sl").alias("_s")), "event_id", "left")
    each = [F.struct(F.lit(n).alias("horizon"), F.col(f"b{i}").alias("b"), F.col(f"w{i}").alias("w"), F.coalesce(f"h{i}", F.lit(False)).alias("h")) for i, n in enumerate(horizons)]
    g = g.select("event_id", "_t", "_s", F.inline(F.array(*each)))
    t, s = F.col("h") & F.col("_t"), F.col("h") & F.col("_s")
    one = F.coalesce(t != s, F.lit(False))
    return g.select(
        "event_id", "horizon", F.greatest(F.lit(0.0), F.coalesce("b", F.lit(0.0))).alias("mfe"), F.least(F.lit(0.0), F.coalesce("w", F.lit(0.0))).alias("mae"),
        F.coalesce(t & s, F.lit(False)).alias("ambiguous"), F.when(one, t).alias("target_first"), F.when(one, s).alias("stop_first"),
    )


def full_outcomes(events: DataFrame, bars: DataFrame, horizons: dict[str, int], bar_minutes: int, take: float, stop: float) -> DataFrame:
    """One row an event and horizon: forward return, excursions and first touches up to that horizon. Events that no bar
    follows have no outcome."""
    returns = forward_returns(events, bars, horizons, bar_minutes).filter("entry_price is not null")
    entered = with_entry(events.select("event_id", "instrument_id", "entry_ts", "side"), bars)
    return returns.join(excursions(entered, bars, horizons, take, stop), ["event_id", "horizon"], "left")
