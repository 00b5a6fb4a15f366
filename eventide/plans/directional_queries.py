"""Registered queries: directional event families, each beside its SQL.

Windows are minutes from the open; thresholds fit the tick table's wide prices, few names and bars of a quarter of an hour.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from eventide.operators import directional as dr
from eventide.operators import events as ev
from eventide.operators import families as fam
from eventide.plans.bars_queries import M
from eventide.plans.base import CAUSAL, causal, register

_W = (30, 780)
_MOST = "minutes_from_open between 30 and 780"
_OF_DAY = "partition by instrument_id, session_date order by"
_DAY = "instrument_id, session_date"


def _family(name: str, rows_sql: str, entry_next: bool = True, first: bool = True):
    """Events of a family: f(features) gives rows with a side, rows_sql the same rows; the first of an instrument and day."""
    thin = f" qualify row_number() over ({_OF_DAY} ts_utc) = 1" if first else ""
    sql = f"""with {CAUSAL}, {rows_sql} select '{name}-' || instrument_id || '-' || strftime(ts_utc + interval 15 minute, '%Y%m%d%H%M') as event_id,
        ts_utc{' + interval 15 minute' if entry_next else ''} as entry_ts, side from hits{thin}"""

    def add(f):
        @register(name, sql)
        def _(spark, d):
            return ev.stamp(f(causal(spark, d)), name, F.col("side"), M, entry_next, first).select("event_id", "entry_ts", "side")

        return f

    return add


# --- after hours, quiet shocks
for _name, _fade in (("e12_after_hours_follow", False), ("e12_after_hours_fade", True)):
    _family(_name, f"""fb as (select * from causal qualify row_number() over ({_OF_DAY} ts_utc) = 1),
    hits as (select *, case when (ah_ret > 0) = {not _fade} then 'LONG' else 'SHORT' end as side from fb where abs(ah_ret) >= 0.2)""", entry_next=False)(lambda x, fade=_fade: dr.after_hours_open(x, 0.2, fade))

_SHOCK = f"sh as (select * from causal where {_MOST} and rvol_5m >= 1.0 and abs(ret_5m) <= 0.8 qualify row_number() over ({_OF_DAY} ts_utc) = 1)"
_SIDES = {
    "momentum": ("mom5", "ret_5m <> 0", "ret_5m > 0"), "fade": ("fade5", "ret_5m <> 0", "ret_5m < 0"), "gap": ("gap", "gap_pct <> 0", "gap_pct > 0"), "gap_fade": ("gap_fade", "gap_pct <> 0", "gap_pct < 0"),
    "range": ("range", "true", "close_location_value >= 0.6"), "select": ("select", "abs(ret_5m) >= 0.3 and rvol_5m >= 1.2", "ret_5m > 0"), "score": ("score", f"abs({dr.SHOCK_SCORE}) >= 0.5", f"{dr.SHOCK_SCORE} > 0"),
}
for _name, (_by, _where, _up) in _SIDES.items():
    _family(f"e15_{_name}_side", f"{_SHOCK}, hits as (select *, case when {_up} then 'LONG' else 'SHORT' end as side from sh where {_where})")(
        lambda x, by=_by: dr.shock_side(dr.quiet_shock(x, _W, 1.0, 0.8), by, 0.6, 0.3, 1.2, 0.5)
    )


# --- compression
_LEVELS = f"lv as (select *, lag(hi_15) over w as high_before, lag(lo_15) over w as low_before from causal where {_MOST} window w as ({_OF_DAY} ts_utc))"


@_family("e17_compression_break", f"""{_LEVELS},
    fl as (select *, med20 is not null and (hi_15 - lo_15) / nullif(prev_close, 0) <= 1.5 * med20 as tight from lv),
    lg as (select *, lag(tight and close > high_before, 2) over w as up, lag(tight and close < low_before, 2) over w as down, lag(high_before, 2) over w as high_then, lag(low_before, 2) over w as low_then from fl window w as ({_OF_DAY} ts_utc)),
    hits as (select *, case when up and close > high_then then 'LONG' else 'SHORT' end as side from lg where (up and close > high_then) or (down and close < low_then))""")
def _(x):
    return dr.compression_break(x, _W, 1.5, 2)


for _name, _up, _past in (("e33_compression_release", True, "close > high_then"), ("e33_compression_release_short", False, "close < low_then")):
    _family(_name, f"""lg as (select *, lag(range_15m <= 1.5 * med20, 2) over w as tight, lag(hi_15, 2) over w as high_then, lag(lo_15, 2) over w as low_then from causal where {_MOST} window w as ({_OF_DAY} ts_utc)),
    hits as (select *, '{'LONG' if _up else 'SHORT'}' as side from lg where tight and {_past} and rvol_5m >= 1)""")(lambda x, up=_up: dr.compression_release(x, _W, 1.5, 2, 1.0, up))


# --- the day's market
def _last(until: int) -> str:
    return f"la as (select * from causal where minutes_from_open <= {until} qualify row_number() over ({_OF_DAY} ts_utc desc) = 1), mm as (select session_date, avg(close / rth_open - 1) as market_move from la where rth_open > 0 group by 1 having count(*) >= 3)"


@_family("e18_laggards", f"""{_last(240)}, qr as (select session_date, dist_open, row_number() over (partition by session_date order by dist_open) - 1 as k, count(*) over (partition by session_date) as n from la where dist_open is not null),
    hits as (select la.*, 'LONG' as side from la join mm using (session_date) join (select session_date, dist_open as cut from qr where k = round((n - 1) * 0.2)) using (session_date)
        where market_move >= 0.002 and dist_open <= cut and rvol_5m >= 0.9 and minutes_from_open between 150 and 240)""")
def _(x):
    return dr.laggards(x, 240, (150, 240), 0.002, 0.2, 0.9, 3)


@_family("e20_contrarian_market", f"""{_last(180)}, hits as (select c.*, case when market_move < 0 then 'LONG' else 'SHORT' end as side from causal c join mm using (session_date)
    where abs(market_move) > 0.003 and gap_pct >= 0.04 and minutes_from_open between 180 and 360)""")
def _(x):
    return dr.contrarian(x, 180, (180, 360), 0.003, 0.04, 3)


# --- impulse, pause, and what follows
for _name, _fade in (("e21_impulse_pause_resume", False), ("e21_impulse_pause_fade", True)):
    _against = "and ((imp > 0 and high < h_imp) or (imp <= 0 and low > l_imp))" if _fade else ""
    _family(_name, f"""lg as (select *, lag(ret_5m, 4) over w as imp, lag(close, 4) over w as c_imp, lag(high, 4) over w as h_imp, lag(low, 4) over w as l_imp, lag(close, 2) over w as c_pause, lag(volume_10m, 2) over w as v_pause
        from causal where {_MOST} window w as ({_OF_DAY} ts_utc)),
    hits as (select *, case when (imp > 0) <> {_fade} then 'LONG' else 'SHORT' end as side from lg where abs(imp) >= 0.2 and abs(c_pause / nullif(c_imp, 0) - 1) <= 0.5 and volume_5m >= 0.8 * (v_pause / 2) {_against})""")(
        lambda x, fade=_fade: dr.impulse_pause(x, _W, 0.2, 0.5, 0.8, (4, 2), fade)
    )


@_family("e22_failed_opening_break", """lv as (select instrument_id, session_date, max(high) as oh, min(low) as ol from causal where minutes_from_open < 60 group by all),
    n as (select c.*, oh, ol from causal c join lv using (instrument_id, session_date) where minutes_from_open >= 60),
    o as (select instrument_id, session_date, ts_utc as out_ts, close > oh as up from n where close > oh or close < ol qualify row_number() over (partition by instrument_id, session_date order by ts_utc) = 1),
    hits as (select n.*, case when up then 'SHORT' else 'LONG' end as side from n join o using (instrument_id, session_date) where ts_utc > out_ts and ts_utc <= out_ts + interval 90 minute and close between ol and oh)""")
def _(x):
    return dr.failed_opening_break(x, 60, 60, 90)


for _name, _level, _up in (("e9_failed_breakout_trap", "yday_high", True), ("e9_failed_breakdown_trap", "yday_low", False)):
    _touch, _back = (f"high >= {_level}", f"low <= {_level}") if _up else (f"low <= {_level}", f"high >= {_level}")
    _family(_name, f"""n as (select * from causal where {_MOST} and {_level} is not null), f as (select {_DAY}, min(ts_utc) as first_ts from n where {_touch} group by all),
    hits as (select n.*, '{'SHORT' if _up else 'LONG'}' as side from n join f using ({_DAY}) where ts_utc > first_ts and ts_utc <= first_ts + interval 90 minute and {_back})""")(lambda x, level=_level, up=_up: dr.breakout_trap(x, level, _W, 90, up))


@_family("e10_compression_expansion", f"""n as (select *, (hi_15 - lo_15) / nullif(prev_close, 0) as rg from causal where {_MOST}),
    f as (select {_DAY}, ts_utc as first_ts, rg as rg_then from n where med20 is not null and rg <= 1.5 * med20 qualify row_number() over ({_OF_DAY} ts_utc) = 1),
    hits as (select n.*, case when close >= open then 'LONG' else 'SHORT' end as side from n join f using ({_DAY}) where ts_utc > first_ts and ts_utc <= first_ts + interval 90 minute and (high - low) / nullif(prev_close, 0) >= 0.3 * rg_then)""")
def _(x):
    return dr.compression_expansion(x, _W, 1.5, 90, 0.3)


@_family("e35_scale_agreement", f"""lg as (select *, lag(hi_3) over w as high_before from causal where {_MOST} window w as ({_OF_DAY} ts_utc)),
    hits as (select *, case when ret_5m > 0 then 'LONG' else 'SHORT' end as side from lg where sign(ret_5m) = sign(ret_15m) and sign(ret_15m) = sign(yday_ret) and abs(ret_5m) >= 0.1 and rvol_5m >= 1 and close >= high_before)""")
def _(x):
    return dr.scale_agreement(x, _W, 0.1, 1.0)


# --- sequences
def _breakout(level: str, up: bool) -> str:
    touch, beyond, back = ("high > lvl", "close > lvl", "close <= lvl * (1 - 0.5)") if up else ("low < lvl", "close < lvl", "close >= lvl * (1 + 0.5)")
    one, other = ("LONG", "SHORT") if up else ("SHORT", "LONG")
    return f"""with {CAUSAL}, n as (select *, {level} as lvl, row_number() over ({_OF_DAY} ts_utc) - 1 as b from causal where {_MOST}),
f as (select {_DAY}, b as first_no, ts_utc as break_ts from n where {touch} qualify row_number() over ({_OF_DAY} b) = 1),
g as (select {_DAY}, break_ts, count(*) filter ({beyond})::bigint as n_beyond, avg(rvol_5m) as mean_rvol, max(ts_utc) filter ({beyond}) as last_ts, min(ts_utc) filter ({back}) as back_ts
    from n join f using ({_DAY}) where b >= first_no and b < first_no + 6 group by all),
o as (select *, case when back_ts is not null then 'REJECT' when n_beyond >= 2 and mean_rvol >= 1.2 then 'ACCEPT' else 'OPEN' end as outcome from g)
select {_DAY}, break_ts, n_beyond, mean_rvol, outcome, case outcome when 'REJECT' then back_ts when 'ACCEPT' then last_ts end as ts_utc, case outcome when 'ACCEPT' then '{one}' when 'REJECT' then '{other}' end as side from o"""


@register("e27_breakout_window", _breakout("yday_high", True), "mean_rvol")
def _(spark, d):
    return fam.breakout_window(causal(spark, d), "yday_high", _W, 6, 0.5, 2, 1.2)


@register("e27_breakdown_window", _breakout("yday_low", False), "mean_rvol")
def _(spark, d):
    return fam.breakout_window(causal(spark, d), "yday_low", _W, 6, 0.5, 2, 1.2, up=False)


@register("e28_rank_states", f"""with {CAUSAL}, sn as (select *, xs_ret_rank as r, lag(xs_ret_rank) over ({_OF_DAY} ts_utc) as b from causal where minutes_from_open >= 30 and minutes_from_open % 30 = 0 and xs_ret_rank is not null and ret_15m is not null),
st as (select *, unnest([case when r >= 1 - 0.4 and b >= 1 - 0.35 and r >= b - 0.03 then 'persist_lead' end, case when b >= 1 - 0.35 and r < 1 - 0.4 and ret_15m > 0 then 'decay_lead' end, case when r <= 0.4 and b <= 0.35 and r <= b + 0.03 then 'persist_lag' end,
    case when b <= 0.35 and r > 0.4 and ret_15m < 0 then 'recover_lag' end, case when r >= 1 - 0.35 then 'raw_mom_long' end, case when r <= 0.35 then 'raw_mom_short' end]) as state from sn)
select instrument_id, session_date, ts_utc, state, case when state in ('persist_lead', 'recover_lag', 'raw_mom_long') then 'LONG' else 'SHORT' end as side from st where state is not null
qualify row_number() over (partition by instrument_id, session_date, state order by ts_utc) = 1""")
def _(spark, d):
    return fam.rank_states(causal(spark, d), 30, 30, 0.35, 0.4, 0.03, 0.4).select("instrument_id", "session_date", "ts_utc", "state", "side")


@register("e30_shock_resolution", f"""with {CAUSAL}, n as (select *, row_number() over ({_OF_DAY} ts_utc) - 1 as b from causal where {_MOST}),
s as (select {_DAY}, b as first_no, ts_utc as shock_ts, hi_5 as hi, lo_5 as lo from n where rvol_5m >= 1.2 and abs(ret_5m) <= 0.8 qualify row_number() over ({_OF_DAY} b) = 1),
w as (select *, unnest([case when high > hi and close > hi and rvol_5m >= 1 then 'res_long' end, case when low < lo and close < lo and rvol_5m >= 1 then 'res_short' end, case when high > hi and close < hi and close > lo then 'fail_up' end,
    case when low < lo and close > lo and close < hi then 'fail_dn' end]) as job from n join s using ({_DAY}) where b > first_no and b <= first_no + 6)
select instrument_id, session_date, job, shock_ts, ts_utc, case when job in ('res_long', 'fail_dn') then 'LONG' else 'SHORT' end as side from w where job is not null qualify row_number() over (partition by {_DAY}, job order by b) = 1""")
def _(spark, d):
    return fam.shock_resolution(causal(spark, d), _W, 1.2, 0.8, 6, 1.0).select("instrument_id", "session_date", "job", "shock_ts", "ts_utc", "side")


@register("e32_opening_dislocation", f"""with {CAUSAL}, s as (select * from causal where minutes_from_open between 0 and 120 qualify row_number() over ({_OF_DAY} ts_utc desc) = 1),
rk as (select instrument_id, session_date, count(*) over x as n, case when gap_pct is not null then (rank() over (partition by session_date order by gap_pct nulls last) + (count(*) over (partition by session_date, gap_pct) - 1) / 2.0) / count(*) over x end as gap_rank,
    case when ret_5m is not null then (rank() over (partition by session_date order by ret_5m nulls last) + (count(*) over (partition by session_date, ret_5m) - 1) / 2.0) / count(*) over x end as open_ret_rank from s window x as (partition by session_date)),
la as (select * from causal where minutes_from_open between 135 and 480 qualify row_number() over ({_OF_DAY} ts_utc desc) = 1),
j as (select la.*, gap_rank, open_ret_rank, case when xs_ret_rank >= 1 - 0.3 and close >= rth_open then 'cont' when xs_ret_rank < 1 - 0.4 and close < rth_open then 'rev' end as job from la join rk using ({_DAY}) where n >= 3 and (gap_rank >= 1 - 0.3 or open_ret_rank >= 1 - 0.3))
select instrument_id, session_date, ts_utc, gap_rank, open_ret_rank, job, case job when 'cont' then 'LONG' else 'SHORT' end as side from j where job is not null""", "gap_rank open_ret_rank")
def _(spark, d):
    return fam.opening_dislocation(causal(spark, d), (0, 120), (135, 480), 0.3, 0.4, 3).select("instrument_id", "session_date", "ts_utc", "gap_rank", "open_ret_rank", "job", "side")


def _attempts(level: str, up: bool) -> str:
    touch, back, beyond, short = ("high >= lvl", "close < lvl", "close > lvl", "close < lvl * (1 - 0.1)") if up else ("low <= lvl", "close > lvl", "close < lvl", "close > lvl * (1 + 0.1)")
    return f"""with {CAUSAL}, n as (select *, {level} as lvl, row_number() over ({_OF_DAY} ts_utc) - 1 as b from causal where {_MOST}),
f as (select {_DAY}, b as first_no, ts_utc as first_ts from n where {touch} and {back} qualify row_number() over ({_OF_DAY} b) = 1),
a as (select *, case when {beyond} then 'succ' when {short} then 'fail' end as job from n join f using ({_DAY}) where {touch} and b >= first_no + 2)
select instrument_id, session_date, first_ts, ts_utc, job, case when (job = 'succ') = {up} then 'LONG' else 'SHORT' end as side from a where job is not null qualify row_number() over (partition by {_DAY}, job order by b) = 1"""


for _name, _level, _up in (("e34_two_attempts", "yday_high", True), ("e34_two_attempts_low", "yday_low", False)):

    @register(_name, _attempts(_level, _up))
    def _(spark, d, level=_level, up=_up):
        return fam.two_attempts(causal(spark, d), level, _W, 2, 0.1, up).select("instrument_id", "session_date", "first_ts", "ts_utc", "job", "side")
