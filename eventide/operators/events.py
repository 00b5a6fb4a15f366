"""Event detection: declared conditions, sequential patterns, policies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventide.functions.core import first_per
from eventide.operators.features import by_day

_OPS = {
    ">=": lambda a, b: a >= b,
    "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    "<": lambda a, b: a < b,
    "==": lambda a, b: a == b,
}


def condition(df: DataFrame, conditions: list[tuple[str, str, float]]) -> Column:
    """AND of (feature, operator, value); unknown features are an error, null features never hold."""
    for f, op, _ in conditions:
        if f not in df.columns:
            raise ValueError(f"unknown feature {f}")
        if op not in _OPS:
            raise ValueError(f"unknown operator {op}")
    parts = [F.col(f).isNotNull() & _OPS[op](F.col(f), F.lit(v)) for f, op, v in conditions]
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def stamp(df: DataFrame, experiment: str, side: str | Column, bar_minutes: int, entry_next: bool = True, first_only: bool = True) -> DataFrame:
    """decision_ts, entry_ts, event_id and side; by default only the first row of an instrument and day."""
    df = df.withColumn("decision_ts", F.col("ts_utc") + F.make_dt_interval(mins=F.lit(bar_minutes)))
    df = df.withColumn("entry_ts", F.col("decision_ts") if entry_next else F.col("ts_utc"))
    df = df.withColumn("side", F.lit(side) if isinstance(side, str) else side).filter("side is not null")
    df = df.withColumn("event_id", F.concat_ws("-", F.lit(experiment), "instrument_id", F.date_format("decision_ts", "yyyyMMddHHmm")))
    return first_per(df, ["instrument_id", "session_date"], [F.col("ts_utc")]) if first_only else df


def evaluate(features: DataFrame, experiment: str, conditions: list, side: str, window: tuple[int, int], bar_minutes: int, session: str = "RTH") -> DataFrame:
    """Rows of a session and decision-time window on which all conditions hold, as events (not yet thinned)."""
    where = {"RTH": F.col("is_rth"), "PREMARKET": F.col("is_premarket"), "ANY": F.lit(True)}[session]
    rows = features.filter(where & F.col("minute_of_day").between(*window) & condition(features, conditions))
    return stamp(rows, experiment, side, bar_minutes, first_only=False).dropDuplicates(["event_id"])


def universe(features: DataFrame, instruments: DataFrame, security_type: str, exchanges: list[str], low: float, high: float) -> DataFrame:
    i = instruments.select("instrument_id", "ticker", "exchange", "security_type")
    j = features.join(F.broadcast(i) if i.limit(1_000_001).count() <= 1_000_000 else i, "instrument_id", "left")
    return j.filter((F.col("security_type") == security_type) & F.col("exchange").isin(*exchanges) & F.col("prev_close").between(low, high))


def first_of_day(events: DataFrame) -> DataFrame:
    return first_per(events, ["instrument_id", "session_date"], [F.col("decision_ts"), F.col("event_id")])


def cooldown(events: DataFrame, minutes: int) -> DataFrame:
    """Greedy thinning: an event is kept if it is at least `minutes` after the last kept one of its instrument and day.
    The day's events of an instrument are folded in order; a day holds few."""
    one = F.struct(F.unix_seconds(F.col("decision_ts").cast("timestamp")).alias("t"), "event_id")
    groups = events.groupBy("instrument_id", "session_date").agg(F.array_sort(F.collect_list(one)).alias("_e"))
    start = F.struct(F.lit(None).cast("long").alias("last"), F.array().cast("array<string>").alias("kept"))

    def step(acc: Column, e: Column) -> Column:
        ok = acc["last"].isNull() | (e["t"] >= acc["last"] + minutes * 60)
        return F.struct(F.when(ok, e["t"]).otherwise(acc["last"]).alias("last"), F.when(ok, F.concat(acc["kept"], F.array(e["event_id"]))).otherwise(acc["kept"]).alias("kept"))

    kept = groups.select(F.explode(F.aggregate("_e", start, step, lambda a: a["kept"])).alias("event_id"))
    return events.join(kept, "event_id", "left_semi")


def numbered(bars: DataFrame) -> DataFrame:
    """Bar numbers of a day from 0; pattern windows count bars, not time."""
    return bars.withColumn("bar_no", F.row_number().over(by_day()) - 1)


def hold_near_high(bars: DataFrame, state: DataFrame, window: tuple[int, int], later: tuple[int, int], gap: float, spread: float, near: float) -> DataFrame:
    """Hold near the high: a day that opens at least `gap` over the previous close, whose opening window (minutes of the day,
    end exclusive) has a high above the open, a range of at least `spread` of it, and no close further than `near` below its
    high. The event is the first bar of the later window (end inclusive) that reaches that high."""
    keys, minute, rth = ["instrument_id", "session_date"], F.col("minute_of_day"), bars.filter("is_rth")
    w = rth.filter((minute >= window[0]) & (minute < window[1])).groupBy(*keys).agg(
        F.min_by("open", "ts_utc").alias("open_w"), F.max("high").alias("high_w"), F.min("low").alias("low_w"), F.min("close").alias("min_c")
    )
    jump = F.try_divide("open_w", "prev_close") - 1
    held = w.join(state, keys).filter(
        (jump >= gap) & (F.col("high_w") > F.col("open_w")) & (F.try_divide(F.col("high_w") - F.col("low_w"), F.col("open_w")) >= spread) & (F.col("min_c") >= F.col("high_w") * (1 - near))
    )
    hits = rth.filter(minute.between(*later)).join(held.select(*keys, "high_w"), keys).filter(F.col("high") >= F.col("high_w"))
    return first_per(hits, keys, [F.col("ts_utc")])


def parabolic(features: DataFrame, bars: DataFrame, window: tuple[int, int], ret_15: float, ret_5: float, share: float, rvol: float, growth: float) -> DataFrame:
    """Regular bars of a window (minutes from the open) that rise by ret_15 in fifteen bars, by ret_5 and at least `share` of
    that in the last five, on volume of rvol times the typical and `growth` times that of ten bars ago."""
    before = bars.select("instrument_id", "session_date", "ts_utc", F.sum("volume").over(by_day().rowsBetween(-4, 0)).alias("_v"))
    before = before.select("instrument_id", "ts_utc", F.lag("_v", 10).over(by_day()).alias("volume_before"))
    x = features.join(before, ["instrument_id", "ts_utc"]).filter(F.col("minutes_from_open").between(*window))
    steep = (F.col("ret_15m") >= ret_15) & (F.col("ret_5m") >= ret_5) & (F.col("ret_5m") >= share * F.col("ret_15m"))
    return x.filter(steep & (F.col("rvol_5m") >= rvol) & (F.col("volume_5m") >= growth * F.col("volume_before")))


def impulse_pullback(features: DataFrame, impulse: float, rvol: float, look: int, band: tuple[float, float], push: int, ret: str = "ret_3m", volume: str = "rvol_5m") -> DataFrame:
    """Impulse, pullback, push: a move of at least `impulse` on relative volume of `rvol`; in the next `look` bars a close that
    gives back a band of the move, on less volume a bar than the ten bars up to the impulse; then in the next `push` bars a
    close beyond the three bars before it, in the impulse's direction. The earliest impulse of the day for which all three
    happen. Mean volumes come from running sums; bars meet only within the stated windows."""
    keys = ["instrument_id", "session_date"]
    so_far = by_day().rowsBetween(Window.unboundedPreceding, 0)
    n = numbered(features.filter("is_rth")).select(
        *keys, "ts_utc", "bar_no", "close", F.col(ret).alias("r"), F.col(volume).alias("v"), F.sum("volume_1m").over(so_far).alias("sum_v"), F.avg("volume_1m").over(by_day().rowsBetween(-9, 0)).alias("mean_v"),
        F.lag("hi_3").over(by_day()).alias("hi_before"), F.lag("lo_3").over(by_day()).alias("lo_before"),
    )
    i = n.filter((F.abs("r") >= impulse) & (F.col("v") >= rvol)).select(*keys, F.col("bar_no").alias("i"), F.signum("r").alias("d"), F.col("close").alias("peak"), (F.abs("r") * F.col("close")).alias("size"), F.col("sum_v").alias("sum_i"), "mean_v")
    j = i.join(n.select(*keys, F.col("bar_no").alias("j"), F.col("close").alias("back"), F.col("sum_v").alias("sum_j")), keys).filter(f"j > i and j <= i + {look}")
    part = F.try_divide(F.abs(F.col("back") - F.col("peak")), F.col("size"))
    quiet = (F.col("sum_j") - F.col("sum_i")) / (F.col("j") - F.col("i")) < F.col("mean_v")
    j = first_per(j.filter(((F.col("back") - F.col("peak")) * F.col("d") < 0) & part.between(*band) & quiet), [*keys, "i"], [F.col("j")])
    k = j.select(*keys, "i", "j", "d").join(n.select(*keys, F.col("bar_no").alias("k"), F.col("close").alias("again"), "hi_before", "lo_before", "ts_utc"), keys)
    beyond = ((F.col("d") > 0) & (F.col("again") > F.col("hi_before"))) | ((F.col("d") < 0) & (F.col("again") < F.col("lo_before")))
    k = first_per(k.filter(f"k > j and k <= j + {push}").filter(beyond), [*keys, "i"], [F.col("k")])
    return first_per(k, keys, [F.col("i")]).select(*keys, "i", "j", "k", "ts_utc", F.when(F.col("d") > 0, "LONG").otherwise("SHORT").alias("side"))


def crowded(events: DataFrame, features: DataFrame, gap: float, least: int) -> DataFrame:
    """Events only of days on which at least `least` instruments gap up."""
    opens = first_per(features.filter("is_rth"), ["instrument_id", "session_date"], [F.col("ts_utc")])
    days = opens.filter(F.col("gap_pct") >= gap).groupBy("session_date").count().filter(F.col("count") >= least)
    return events.join(days, "session_date", "left_semi")


def inverted(events: DataFrame) -> DataFrame:
    """The same events on the other side."""
    return events.withColumn("side", F.when(F.col("side") == "LONG", "SHORT").otherwise("LONG"))
