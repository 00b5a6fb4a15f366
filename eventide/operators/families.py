"""Event families that read several bars of a day or a whole cross-section.

Windows count bars of a day inside the clock window (minutes from the open, both ends included). A pattern is looked for
from the first bar that starts it; days on which it doesn't start or doesn't end give no row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventide.functions.core import average_rank, first_per
from eventide.operators.directional import DAY, Clock, within
from eventide.operators.events import numbered
from eventide.operators.features import by_day


def with_lags(rows: DataFrame, lags: dict[str, tuple[str, int]]) -> DataFrame:
    """Adds name -> (column, bars back), within the day."""
    return rows.withColumns({name: F.lag(c, k).over(by_day()) for name, (c, k) in lags.items()})


def breakout_window(features: DataFrame, level: str, clock: Clock, bars: int, reject: float, closes: int, volume: float, up: bool = True) -> DataFrame:
    """First bar that goes beyond a level (its high above it, or with up=False its low below) and what the `bars` bars from it
    on make of it: REJECT at the first close `reject` on the other side, against the break; else ACCEPT if at least `closes`
    of them close beyond at a mean relative volume of `volume`, at the last such close and with the break; else OPEN, without
    side and time."""
    n = numbered(within(features, clock))
    touch = F.col("high") > F.col(level) if up else F.col("low") < F.col(level)
    first = first_per(n.filter(touch), DAY, [F.col("bar_no")]).select(*DAY, F.col("bar_no").alias("_first"), F.col("ts_utc").alias("break_ts"))
    w = n.join(first, DAY).filter((F.col("bar_no") >= F.col("_first")) & (F.col("bar_no") < F.col("_first") + bars))
    beyond = F.col("close") > F.col(level) if up else F.col("close") < F.col(level)
    back = F.col("close") <= F.col(level) * (1 - reject) if up else F.col("close") >= F.col(level) * (1 + reject)
    g = w.groupBy(*DAY, "break_ts").agg(
        F.count_if(beyond).alias("n_beyond"), F.avg("rvol_5m").alias("mean_rvol"), F.max(F.when(beyond, F.col("ts_utc"))).alias("_last"), F.min(F.when(back, F.col("ts_utc"))).alias("_back"),
    )
    rejected, accepted = F.col("_back").isNotNull(), (F.col("n_beyond") >= closes) & (F.col("mean_rvol") >= volume)
    g = g.withColumn("outcome", F.when(rejected, "REJECT").when(accepted, "ACCEPT").otherwise("OPEN"))
    g = g.withColumn("ts_utc", F.when(rejected, F.col("_back")).when(accepted, F.col("_last")))
    one, other = ("LONG", "SHORT") if up else ("SHORT", "LONG")
    return g.withColumn("side", F.when(F.col("outcome") == "ACCEPT", one).when(F.col("outcome") == "REJECT", other)).drop("_last", "_back")


#: Tail of the ranking, how far a persisting rank may be from its end and may have slipped, and where it has left the tail.
TAIL, PERSIST, SLIP, OUT = 0.05, 0.10, 0.03, 0.15


def rank_states(features: DataFrame, start: int, every: int, tail: float = TAIL, persist: float = PERSIST, slip: float = SLIP, out: float = OUT) -> DataFrame:
    """States of cross-sectional ranks on snapshots every so many minutes from `start` on, against the snapshot before:
    persist_lead, decay_lead, persist_lag, recover_lag, raw_mom_long, raw_mom_short. The first row of each state, instrument
    and day; a row may be in several states."""
    snaps = features.filter((F.col("minutes_from_open") >= start) & (F.col("minutes_from_open") % every == 0) & F.col("xs_ret_rank").isNotNull() & F.col("ret_15m").isNotNull())
    now, before = F.col("xs_ret_rank"), F.col("_before")
    d = with_lags(snaps, {"_before": ("xs_ret_rank", 1)})
    states = {
        "persist_lead": ((now >= 1 - persist) & (before >= 1 - tail) & (now >= before - slip), "LONG"),
        "decay_lead": ((before >= 1 - tail) & (now < 1 - out) & (F.col("ret_15m") > 0), "SHORT"),
        "persist_lag": ((now <= persist) & (before <= tail) & (now <= before + slip), "SHORT"),
        "recover_lag": ((before <= tail) & (now > out) & (F.col("ret_15m") < 0), "LONG"),
        "raw_mom_long": (now >= 1 - tail, "LONG"),
        "raw_mom_short": (now <= tail, "SHORT"),
    }
    each = F.array(*[F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(s).alias("state"), F.lit(side).alias("side"))) for s, (c, side) in states.items()])
    d = d.select("*", F.inline(F.filter(each, lambda s: s.isNotNull()))).drop("_before")
    return first_per(d, [*DAY, "state"], [F.col("ts_utc")])


def shock_resolution(features: DataFrame, clock: Clock, rvol: float, quiet: float, bars: int, confirm: float) -> DataFrame:
    """First bar with relative volume of `rvol` and a move of at most `quiet`; in the next `bars` bars, against its high and low
    of five bars: res_long and res_short pass and close beyond with relative volume of `confirm`; fail_up and fail_dn pass
    but close back between the two. The first bar of each job, instrument and day."""
    n = numbered(within(features, clock))
    shock = first_per(n.filter((F.col("rvol_5m") >= rvol) & (F.abs("ret_5m") <= quiet)), DAY, [F.col("bar_no")])
    shock = shock.select(*DAY, F.col("bar_no").alias("_first"), F.col("ts_utc").alias("shock_ts"), F.col("hi_5").alias("_hi"), F.col("lo_5").alias("_lo"))
    w = n.join(shock, DAY).filter((F.col("bar_no") > F.col("_first")) & (F.col("bar_no") <= F.col("_first") + bars))
    over, under, close = F.col("high") > F.col("_hi"), F.col("low") < F.col("_lo"), F.col("close")
    inside, loud = (close < F.col("_hi")) & (close > F.col("_lo")), F.col("rvol_5m") >= confirm
    jobs = {
        "res_long": (over & (close > F.col("_hi")) & loud, "LONG"), "res_short": (under & (close < F.col("_lo")) & loud, "SHORT"),
        "fail_up": (over & inside, "SHORT"), "fail_dn": (under & inside, "LONG"),
    }
    each = F.array(*[F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(j).alias("job"), F.lit(side).alias("side"))) for j, (c, side) in jobs.items()])
    w = w.select("*", F.inline(F.filter(each, lambda s: s.isNotNull()))).drop("_first", "_hi", "_lo")
    return first_per(w, [*DAY, "job"], [F.col("bar_no")])


def opening_dislocation(features: DataFrame, snapshot: Clock, later: Clock, extreme: float, collapse: float, least_names: int) -> DataFrame:
    """Names that lead the last bars of the opening window by gap or by move (average rank over all names of the day), at
    their last bar of the later window: cont if they still lead and hold the open, rev if they have fallen out of the top
    and below the open. Days with few names give none."""
    last = lambda clock: first_per(within(features, clock), DAY, [F.desc("ts_utc")])
    snap = last(snapshot).withColumn("_n", F.count("*").over(Window.partitionBy("session_date"))).filter(F.col("_n") >= least_names)
    snap = snap.withColumn("gap_rank", average_rank("gap_pct", ["session_date"])).withColumn("open_ret_rank", average_rank("ret_5m", ["session_date"]))
    leaders = snap.filter((F.col("gap_rank") >= 1 - extreme) | (F.col("open_ret_rank") >= 1 - extreme)).select(*DAY, "gap_rank", "open_ret_rank")
    rank, close, at = F.col("xs_ret_rank"), F.col("close"), F.col("rth_open")
    job = F.when((rank >= 1 - extreme) & (close >= at), "cont").when((rank < 1 - collapse) & (close < at), "rev")
    out = last(later).join(leaders, DAY).withColumn("job", job).filter("job is not null")
    return out.withColumn("side", F.when(F.col("job") == "cont", "LONG").otherwise("SHORT"))


def two_attempts(features: DataFrame, level: str, clock: Clock, gap: int, fail: float, up: bool = True) -> DataFrame:
    """A first touch of a level that closes back on this side of it; among the touches at least `gap` bars later the first
    that closes beyond (succ, with the attempt) and the first that closes `fail` short of it (fail, against it)."""
    n = numbered(within(features, clock))
    at, close = F.col(level), F.col("close")
    touch, back, beyond, short = (F.col("high") >= at, close < at, close > at, close < at * (1 - fail)) if up else (F.col("low") <= at, close > at, close < at, close > at * (1 + fail))
    first = first_per(n.filter(touch & back), DAY, [F.col("bar_no")]).select(*DAY, F.col("bar_no").alias("_first"), F.col("ts_utc").alias("first_ts"))
    again = n.filter(touch).join(first, DAY).filter(F.col("bar_no") >= F.col("_first") + gap)
    again = again.withColumn("job", F.when(beyond, "succ").when(short, "fail")).filter("job is not null").drop("_first")
    return first_per(again, [*DAY, "job"], [F.col("bar_no")]).withColumn("side", F.when((F.col("job") == "succ") == F.lit(up), "LONG").otherwise("SHORT"))
