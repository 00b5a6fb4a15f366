"""Event families with a side: conditions, lags within a clock window, and facts of the day's cross-section.

Rows are regular bars with causal features. A clock window is (first, last) in minutes from the open, both included; lags
count the bars of an instrument and day inside the window, since a pattern may not begin before it. Unknown features never
hold. Every family gives its rows with a `side`; `first_per` or `stamp` keeps the first of an instrument and day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventide.functions.core import first_per, small
from eventide.operators.features import by_day

DAY = ["instrument_id", "session_date"]
Clock = tuple[int, int]


def within(features: DataFrame, clock: Clock) -> DataFrame:
    return features.filter(F.col("minutes_from_open").between(*clock))


def sided(up: Column) -> Column:
    """LONG where the condition holds, SHORT where it doesn't or isn't known."""
    return F.when(up, "LONG").otherwise("SHORT")


def after_hours_open(features: DataFrame, least: float, fade: bool = False) -> DataFrame:
    """The first bar of a day after a move of at least `least` in the last after-hours session: with it, or against it."""
    first = first_per(features, DAY, [F.col("ts_utc")]).filter(F.abs("ah_ret") >= least)
    return first.withColumn("side", sided((F.col("ah_ret") > 0) != F.lit(fade)))


# Weights of the two side scores.
SHOCK_SCORE = "2.0 * coalesce(gap_pct, 0) + 1.5 * coalesce(ret_5m, 0) + 0.5 * coalesce(ret_15m, 0) + 0.02 * least(coalesce(rvol_5m, 0), 10.0) / 10 - 0.0004 * coalesce(minutes_from_open, 0)"
GAP_SCORE = "1.5 * coalesce(gap_pct, 0) + 1.2 * coalesce(ret_5m, 0) + 0.4 * coalesce(yday_ret, 0) + 0.015 * least(coalesce(rvol_5m, 0), 12.0) / 12"


def quiet_shock(features: DataFrame, clock: Clock, rvol: float, quiet: float) -> DataFrame:
    """The first bar of a day with relative volume of `rvol` and a move of at most `quiet`."""
    return first_per(within(features, clock).filter((F.col("rvol_5m") >= rvol) & (F.abs("ret_5m") <= quiet)), DAY, [F.col("ts_utc")])


def shock_side(shocks: DataFrame, by: str, near_high: float = 0.6, least_ret: float = 0.004, least_rvol: float = 6.0, least_score: float = 0.012) -> DataFrame:
    """Quiet shocks with the side that `by` tells: mom5, fade5, gap, gap_fade, range, select or score. What the shock at hand
    doesn't qualify for is no event; later shocks of the day don't take its place."""
    score = F.expr(SHOCK_SCORE)
    where, up = {
        "mom5": (F.col("ret_5m") != 0, F.col("ret_5m") > 0),
        "fade5": (F.col("ret_5m") != 0, F.col("ret_5m") <= 0),
        "gap": (F.col("gap_pct") != 0, F.col("gap_pct") > 0),
        "gap_fade": (F.col("gap_pct") != 0, F.col("gap_pct") <= 0),
        "range": (F.lit(True), F.col("close_location_value") >= near_high),
        "select": ((F.abs("ret_5m") >= least_ret) & (F.col("rvol_5m") >= least_rvol), F.col("ret_5m") > 0),
        "score": (F.abs(score) >= least_score, score > 0),
    }[by]
    return shocks.filter(where).withColumn("side", sided(up))


def compression_break(features: DataFrame, clock: Clock, compress: float, hold: int) -> DataFrame:
    """`hold` bars ago the range of fifteen bars was at most `compress` of the median day's and the close broke out of the
    range before it; now the close is still beyond the level that was broken then."""
    level = lambda c: F.lag(c).over(by_day())
    d = within(features, clock).select(
        "*", (F.col("med20").isNotNull() & (F.try_divide(F.col("hi_15") - F.col("lo_15"), "prev_close") <= compress * F.col("med20"))).alias("_tight"), level("hi_15").alias("_high"), level("lo_15").alias("_low")
    )
    then = lambda c: F.lag(c, hold).over(by_day())
    up, down = F.col("close") > F.col("_high"), F.col("close") < F.col("_low")
    d = d.select("*", then(F.col("_tight") & up).alias("_up"), then(F.col("_tight") & down).alias("_down"), then("_high").alias("_high_then"), then("_low").alias("_low_then"))
    side = F.when(F.col("_up") & (F.col("close") > F.col("_high_then")), "LONG").when(F.col("_down") & (F.col("close") < F.col("_low_then")), "SHORT")
    return d.withColumn("side", side).filter("side is not null").drop("_tight", "_high", "_low", "_up", "_down", "_high_then", "_low_then")


def compression_release(features: DataFrame, clock: Clock, compress: float, back: int, rvol: float, up: bool = True) -> DataFrame:
    """`back` bars ago the range of fifteen bars was at most `compress` of the median day's; now the close leaves the range of
    that time on relative volume of `rvol`."""
    then = lambda c: F.lag(c, back).over(by_day())
    d = within(features, clock).select("*", then(F.col("range_15m") <= compress * F.col("med20")).alias("_tight"), then("hi_15").alias("_high"), then("lo_15").alias("_low"))
    out = F.col("close") > F.col("_high") if up else F.col("close") < F.col("_low")
    return d.filter(F.col("_tight") & out & (F.col("rvol_5m") >= rvol)).withColumn("side", F.lit("LONG" if up else "SHORT")).drop("_tight", "_high", "_low")


def last_until(features: DataFrame, until: int) -> DataFrame:
    """The last bar of each instrument and day up to a minute from the open."""
    return first_per(features.filter(F.col("minutes_from_open") <= until), DAY, [F.desc("ts_utc")])


def market_move(features: DataFrame, until: int, least_names: int) -> DataFrame:
    """session_date, market_move: mean move from the open of the names' last bars, of days with enough of them."""
    last = last_until(features, until).filter("rth_open > 0")
    return last.groupBy("session_date").agg(F.avg(F.col("close") / F.col("rth_open") - 1).alias("market_move"), F.count("*").alias("_n")).filter(F.col("_n") >= least_names).drop("_n")


def laggards(features: DataFrame, snapshot: int, clock: Clock, market: float, share: float, rvol: float, least_names: int) -> DataFrame:
    """At the snapshot, with the market up by `market`: names whose move from the open is at most that of the name at `share`
    of the ranking (the nearest place), if their bar lies in the clock window and has volume."""
    last = last_until(features, snapshot)
    ranked = Window.partitionBy("session_date").orderBy("dist_open")
    some = last.filter("dist_open is not null").select("session_date", "dist_open", (F.row_number().over(ranked) - 1).alias("_k"), F.count("*").over(Window.partitionBy("session_date")).alias("_n"))
    cut = some.filter(F.col("_k") == F.round((F.col("_n") - 1) * share)).select("session_date", F.col("dist_open").alias("low_cut"))
    up = market_move(features, snapshot, least_names).filter(F.col("market_move") >= market)
    d = last.join(small(up), "session_date").join(small(cut), "session_date")
    return within(d.filter((F.col("dist_open") <= F.col("low_cut")) & (F.col("rvol_5m") >= rvol)), clock).withColumn("side", F.lit("LONG"))


def contrarian(features: DataFrame, snapshot: int, clock: Clock, market: float, gap: float, least_names: int) -> DataFrame:
    """Names that gapped up by `gap`, in a window after the snapshot, against a market that has moved by more than `market`."""
    move = market_move(features, snapshot, least_names).filter(F.abs("market_move") > market)
    return within(features, clock).filter(F.col("gap_pct") >= gap).join(small(move), "session_date").withColumn("side", sided(F.col("market_move") < 0))


def impulse_pause(features: DataFrame, clock: Clock, impulse: float, pause: float, growth: float, lags: tuple[int, int] = (15, 5), fade: bool = False) -> DataFrame:
    """An impulse `lags[0]` bars ago, a close near it `lags[1]` bars ago, and now volume of `growth` times the pause's: on in the
    impulse's direction; with `fade` against it, if its high (low) hasn't been passed."""
    then = lambda c, k: F.lag(c, k).over(by_day())
    far, near = lags
    d = within(features, clock).select("*", then("ret_5m", far).alias("_imp"), then("close", far).alias("_c"), then("high", far).alias("_high"), then("low", far).alias("_low"), then("close", near).alias("_pause"), then("volume_10m", near).alias("_vol"))
    d = d.filter((F.abs("_imp") >= impulse) & (F.abs(F.try_divide("_pause", F.col("_c")) - 1) <= pause) & (F.col("volume_5m") >= growth * (F.col("_vol") / 2)))
    up = F.col("_imp") > 0
    if fade:
        d = d.filter((up & (F.col("high") < F.col("_high"))) | (~up & (F.col("low") > F.col("_low"))))
    return d.withColumn("side", sided(up != F.lit(fade))).drop("_imp", "_c", "_high", "_low", "_pause", "_vol")


def failed_opening_break(bars: DataFrame, opening: int, later: int, minutes: int) -> DataFrame:
    """Regular bars: range of the first `opening` minutes; from minute `later` on the first close outside it, then the first
    close back inside within so many minutes, against the break."""
    level = bars.filter((F.col("minutes_from_open") >= 0) & (F.col("minutes_from_open") < opening)).groupBy(*DAY).agg(F.max("high").alias("open_high"), F.min("low").alias("open_low"))
    n = bars.filter(F.col("minutes_from_open") >= later).join(level, DAY)
    out = first_per(n.filter((F.col("close") > F.col("open_high")) | (F.col("close") < F.col("open_low"))), DAY, [F.col("ts_utc")])
    first = out.select(*DAY, F.col("ts_utc").alias("break_ts"), (F.col("close") > F.col("open_high")).alias("_up"))
    back = n.join(first, DAY).filter((F.col("ts_utc") > F.col("break_ts")) & (F.col("ts_utc") <= F.col("break_ts") + F.make_dt_interval(mins=F.lit(minutes))) & F.col("close").between(F.col("open_low"), F.col("open_high")))
    return first_per(back, DAY, [F.col("ts_utc")]).withColumn("side", sided(~F.col("_up"))).drop("_up")


def breakout_trap(features: DataFrame, level: str, clock: Clock, minutes: int, up: bool = True) -> DataFrame:
    """First bar that reaches a level of yesterday (its high, or with up=False its low), then the first later bar within so many
    minutes that comes back to it, against the break."""
    rows, at = within(features, clock).filter(F.col(level).isNotNull()), F.col(level)
    touch, back = (F.col("high") >= at, F.col("low") <= at) if up else (F.col("low") <= at, F.col("high") >= at)
    first = first_per(rows.filter(touch), DAY, [F.col("ts_utc")]).select(*DAY, F.col("ts_utc").alias("first_ts"))
    later = (F.col("ts_utc") > F.col("first_ts")) & (F.col("ts_utc") <= F.col("first_ts") + F.make_dt_interval(mins=F.lit(minutes)))
    return first_per(rows.join(first, DAY).filter(later & back), DAY, [F.col("ts_utc")]).withColumn("side", F.lit("SHORT" if up else "LONG"))


def compression_expansion(features: DataFrame, clock: Clock, compress: float, minutes: int, growth: float) -> DataFrame:
    """First bar whose range of fifteen bars is at most `compress` of the median day's, then the first later bar within so many
    minutes that spans by itself `growth` times that range, with the bar's colour."""
    rows = within(features, clock).withColumn("_range", F.col("hi_15") - F.col("lo_15"))
    tight = F.col("med20").isNotNull() & (F.try_divide("_range", "prev_close") <= compress * F.col("med20"))
    first = first_per(rows.filter(tight), DAY, [F.col("ts_utc")]).select(*DAY, F.col("ts_utc").alias("first_ts"), F.try_divide("_range", "prev_close").alias("_then"))
    later = (F.col("ts_utc") > F.col("first_ts")) & (F.col("ts_utc") <= F.col("first_ts") + F.make_dt_interval(mins=F.lit(minutes)))
    wide = F.try_divide(F.col("high") - F.col("low"), "prev_close") >= growth * F.col("_then")
    hits = first_per(rows.join(first, DAY).filter(later & wide), DAY, [F.col("ts_utc")])
    return hits.withColumn("side", sided(F.col("close") >= F.col("open"))).drop("_range", "_then")


def scale_agreement(features: DataFrame, clock: Clock, short: float, rvol: float) -> DataFrame:
    """Moves of five and fifteen bars and of yesterday with one sign, the shortest of at least `short`, with volume, at a close
    no lower than the high of the three bars before."""
    d = within(features, clock).withColumn("_high", F.lag("hi_3").over(by_day()))
    same = (F.signum("ret_5m") == F.signum("ret_15m")) & (F.signum("ret_15m") == F.signum("yday_ret"))
    d = d.filter(same & (F.abs("ret_5m") >= short) & (F.col("rvol_5m") >= rvol) & (F.col("close") >= F.col("_high")))
    return d.withColumn("side", sided(F.col("ret_5m") > 0)).drop("_high")
